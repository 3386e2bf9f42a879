"""Exact n-gram Jaccard self-join by a token-group matrix, giving connected components.

Documents are sets of five-word shingles (64-bit hashes); two link when 100 * intersection >= 80 * union.

1. Documents with equal sets form one class (128 bits of a digest); it stands for them from here on.
2. Each class posts its rarest shingles only: of n shingles, the n - ceil(0.8 n) + 1 that come first in an order by
   document frequency. Two sets that link share one of these at least, whatever the order; the frequencies are estimates
   from a sketch of fixed size over all documents, so they steer the cost and never the result. A posted shingle that no
   other class posts is dropped; the others are lists.
3. Similar classes are partitioned into groups, before any two are compared: a class belongs to the longest list it is
   in. Near copies post the same shingles, so a cluster of them makes a few groups, however large it is.
4. The token-group matrix has the union of each group's shingles (32 bits of each will do: a chance meeting raises a bound
   and loses nothing), and of each shingle whether two members have it. A class is a query against every group that
   holds posted shingles of it, its own among them, if sizes, places in the order and the number of posted shingles
   allow a link to some member. Of that number: take the one of two posted parts that ends first in the order; shared
   shingles up to its end are posted by both sets, and at most ceil(0.8 n) - 1 of its own set come after it, so a pair
   that links shares at least 0.8 / 1.8 (n + m) - max(ceil(0.8 n), ceil(0.8 m)) + 1 posted ones. Over a range of sizes m
   that is least at its ends; a group's members are looked at in bands of sizes.
5. Every query is bounded by the matrix: no member can share more shingles with it than the union does (in its own group:
   than those that two members have). Only groups that hold 80 % of the query are opened for it.
6. Opened groups are checked member by member, exactly. What is asked for are components, so members already in the
   query's component need no check: the group's first member comes first, then all members that are in other components:
   pair by pair (if they pass the filters of length and place), or in large groups by products of the shingle matrices of
   two blocks. Members of a large group's largest component are not compared with each other.
7. For each document's number of links (`join_links`), every pair of classes of a component is decided: a component is
   cut into blocks of about LINK_BLOCK classes, and a pair of blocks is one product of their shingle matrices. Only
   counts leave it, so no row is made for a link.

Scale: posts are counted with partial sums and joined back, so a list that many classes share is split like any skewed
join; a group's union is cut into segments by shingle and its queries are dealt to salts, both by the group's size; a
class that a third of all rows share meets them by broadcast (`join_facts`). No list, group or component is collected
into one task or the driver.

Edge cases: a null or empty text, or one without words, has an empty set and links with nothing; fewer than five words
are one shingle of the whole sequence; rows that repeat a doc_id are linked with each other only if their sets link,
and each gets its component; a null doc_id keeps its row, but is never a component_id unless all of its component are
null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import join_facts, scratch, table
from typeloom.llm.components import components, joined
from typeloom.llm.kernels import Words, chunks, grams, mix, tidy

SHINGLE = 5
PERCENT = 80
SKETCH_BITS = 22
#: Bands of sizes for a factor of e: sizes in a band differ by 5 % at most.
BANDS = 20
#: Shingles of a segment of a group's union, and queries of a salt, on average.
SEGMENT = 1 << 18
SALT = 1 << 12
#: Groups with at most so many pairs of query and member are checked pair by pair, others by blocks.
DIRECT = 4096
#: Classes of a component or a group in a block, on average.
LINK_BLOCK = 1024
_PIECES = 16
_TOP = -(2**63)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(column, lower=True)
    h = w.hashes()
    g = grams(h, size)
    for a, n in zip(w.first[:-1].tolist(), w.count.tolist(), strict=True):
        if n >= size:
            yield np.unique(g[a : a + n - size + 1])
        elif n:
            x = np.full(1, n, np.uint64)
            for k in range(n):
                x = mix(x + h[a + k])
            yield x
        else:
            yield h[:0]


def least_overlap(percent: int, n: np.ndarray | int) -> np.ndarray | int:
    """ceil(percent * n / 100): the least overlap of a set of n shingles with any set it links with."""
    return -(-percent * n // 100)


def frequency_sketch(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of documents by the leading bits of the shingle hash, over all documents; its size is fixed by `bits`."""
    piece = (1 << bits) // _PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in chunks(batches, "text", 1 << 22):
            sets = [s >> np.uint64(64 - bits) for s in shingle_sets(batch.column(0))]
            total += np.bincount(np.concatenate(sets).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        if total.any():
            parts = [zlib.compress(total[i * piece : (i + 1) * piece].tobytes(), 1) for i in range(_PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_PIECES), pa.int32()), pa.array(parts, pa.binary())], ["piece", "counts"])
        tidy()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(c), np.uint32)
                total[i] = total[i] + x if i in total else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["piece", "counts"])

    schema = "piece int, counts binary"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(count, schema).repartition(_PIECES, "piece").mapInArrow(add, schema)
    out = np.zeros(1 << bits, np.uint32)
    for r in parts.collect():  # _PIECES parts for each task at most, of a fixed size
        out[r["piece"] * piece : (r["piece"] + 1) * piece] += np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return out


def profiles(docs: DataFrame, shared: Broadcast[np.ndarray], percent: int, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, text_hash, n (size of the set), id (128 bits of a digest of the set), posted (its rarest shingles, in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in chunks(batches, "text"):
            n, keys, posted = [], [], []
            for s in shingle_sets(batch.column(2)):
                n.append(len(s))
                keys.append(hashlib.md5(s.tobytes()).digest())
                most = len(s) - least_overlap(percent, len(s)) + 1 if len(s) else 0
                order = np.lexsort((mix(s), counts[(s >> np.uint64(64 - bits)).astype(np.int64)]))
                posted.append(s[order[:most]].view(np.int64))
            ends = np.cumsum([0, *map(len, posted)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(posted)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "text_hash", "n", "id", "posted"])
        del counts
        tidy()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, id binary, posted array<long>")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, shingles of the wanted classes (id, first_doc, text_hash): the sorted set of their first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1))]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["id", "shingles"])
        tidy()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_TOP)).alias("first_doc"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    # rows that repeat both give one; the join has brought them together already
    return rows.join(wanted, ["first_doc", "text_hash"]).groupBy("first_doc", "text_hash").agg(F.first("id").alias("id"), F.first("text").alias("text")).select("id", "text").mapInArrow(run, "id binary, shingles array<long>")


def _may_link(n: Column, at: Column, m: Column, other: Column, percent: int) -> Column:
    """Length and place filters for two sets that share the shingle at these places of their orders: true for every
    linked pair at the first shingle they share."""
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (F.least(n - at, m - other) * (100 + percent) >= (n + m) * percent)


def _images(column: pa.ListArray) -> list[np.ndarray]:
    """The sorted 32-bit images of each set's shingles."""
    flat, ends = column.values.to_numpy().view(np.uint32), column.offsets.to_numpy()
    return [flat[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_CELL = "grp long, seg int, tokens binary, twice binary"


def _union(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of some parts (tokens, those of them that two members have), and those that two members have."""
    tokens, n = np.unique(np.concatenate([p for p, _ in parts]), return_counts=True)
    return tokens, np.union1d(tokens[n > 1], np.concatenate([t for _, t in parts]))


def _cells(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    grp, seg, tokens, twice = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(seg, pa.int32()), pa.array([x.tobytes() for x in tokens], pa.binary()), pa.array([x.tobytes() for x in twice], pa.binary())], ["grp", "seg", "tokens", "twice"])


def _ints(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in column.to_pylist()]


def token_group_matrix(members: DataFrame) -> DataFrame:
    """grp, seg, tokens (the union of the members' tokens in the segment), twice (those that two members have at least).

    `members` has grp, segs and images (the leading 32 bits of the sorted shingles): a row for each class.
    """
    none = np.zeros(0, np.uint32)

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members that a batch has of a group are united before they are sent."""
        for batch in batches:
            held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
            for grp, segs, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _images(batch.column(2)), strict=True):
                x = np.unique(x)
                for seg in [0] if segs == 1 else np.unique(x % segs).tolist():
                    held.setdefault((grp, seg), []).append((x if segs == 1 else x[x % segs == seg], none))
            if held:
                yield _cells([(*k, *_union(v)) if len(v) > 1 else (*k, *v[0]) for k, v in held.items()])

    def wholly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, n = None, [], 0
        for batch in batches:
            for grp, seg, x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _ints(batch.column(2)), _ints(batch.column(3)), strict=True):
                if now != (grp, seg):
                    if parts:
                        yield _cells([(*now, *_union(parts))])
                    now, parts, n = (grp, seg), [], 0
                parts.append((x, t))
                n += len(x)
                if n > 1 << 22:  # parts with the same tokens do not pile up
                    parts = [_union(parts)]
                    n = len(parts[0][0]) // 2
        if parts:
            yield _cells([(*now, *_union(parts))])
        tidy()

    return members.select("grp", "segs", "images").mapInArrow(partly, _CELL).repartition("grp", "seg").sortWithinPartitions("grp", "seg").mapInArrow(wholly, _CELL)


def bounds(asked: DataFrame, matrix: DataFrame) -> DataFrame:
    """id, grp, n, most: the most shingles that a query can share with a member of the group.

    `asked` has id, grp, n, own (is it the query's own group?), segs, salt and images; `matrix` also salts.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (segs, x) in enumerate(zip(batch.column(4).to_pylist(), _images(batch.column(6)), strict=True)):
                for seg in [0] if segs == 1 else np.unique(x % segs).tolist():
                    rows.append((i, seg, (x if segs == 1 else x[x % segs == seg]).tobytes()))
            if rows:
                at, seg, tokens = zip(*rows, strict=True)
                own = batch.take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([own.column(1), pa.array(seg, pa.int32()), own.column(5), own.column(0), own.column(2), own.column(3), pa.array(tokens, pa.binary())], ["grp", "seg", "salt", "id", "n", "own", "tokens"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, union, twice = None, None, None
        for batch in batches:
            out = []
            for i, (grp, seg, salt, ident, own, x, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("grp", "seg", "salt", "id", "own", "tokens", "twice")), strict=True)):
                x = np.frombuffer(x, np.uint32)
                if ident is None:
                    now, union, twice = (grp, seg, salt), x, np.frombuffer(t, np.uint32)
                elif now == (grp, seg, salt) and len(cell := twice if own else union):
                    at = np.searchsorted(cell, x)
                    at[at == len(cell)] = 0
                    if most := int((cell[at] == x).sum()):
                        out.append((i, most))
            if out:
                at, most = zip(*out, strict=True)
                own = batch.select(["id", "grp", "n"]).take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(most, pa.int64())], ["id", "grp", "n", "most"])
        tidy()

    key = ["grp", "seg", "salt"]
    queries = asked.select("id", "grp", "n", "own", "segs", "salt", "images").mapInArrow(cut, "grp long, seg int, salt int, id binary, n long, own boolean, tokens binary").withColumn("twice", F.lit(None).cast("binary"))
    cells = matrix.select("grp", "seg", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("id"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("own"), "tokens", "twice")
    dealt = cells.unionByName(queries).repartition(*key).sortWithinPartitions(*key, F.col("id").isNotNull())
    return dealt.mapInArrow(meet, "id binary, grp long, n long, most long").groupBy("id", "grp", "n").agg(F.sum("most").alias("most"))


def _check(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those that link, by their whole sets."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("both"))
    return both.filter(F.col("both") * 100 >= (F.col("n") + F.col("m") - F.col("both")) * percent).select("a", "b")


def _pairs(rows: DataFrame, one: str, other: str) -> DataFrame:
    """Distinct pairs (a, b) with a < b."""
    x, y = F.col(one), F.col(other)
    return rows.filter(x != y).select(F.when(x < y, x).otherwise(y).alias("a"), F.when(x < y, y).otherwise(x).alias("b")).distinct()


def _opened(lists: DataFrame, homes: DataFrame, sets_of, percent: int, segment: int, salt: int, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, grp) of the groups that the matrix lets a query open; the lists with each class's group; and the sets."""
    cells = table(lists.join(homes.select("id", "grp"), "id"), "cells", folder)
    # what a group shows of a list, by size: enough for the filters of length, place and number of its best member
    band = F.floor(F.log(F.col("n").cast("double")) * BANDS).cast("int")
    shown = cells.groupBy("post", "grp", band.alias("band")).agg(F.count("*").alias("k"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("at")).alias("rest"))
    shown = table(shown.withColumnRenamed("grp", "g"), "shown", folder)
    n = F.col("n").cast("long")
    sized = (n * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= n * percent)
    rest = F.least(n - F.col("at"), F.col("rest"))
    placed = rest * (100 + percent) >= (n + F.greatest(F.col("least"), F.ceil(n * percent / 100))) * percent
    # a pair in two groups is asked once, by the class of the lower group
    met = cells.join(shown, "post").filter(sized & ((F.col("grp") < F.col("g")) | ((F.col("grp") == F.col("g")) & ((F.col("k") > 1) | (F.col("band") != band)))))
    met = met.groupBy("id", n.alias("n"), (F.col("grp") == F.col("g")).alias("own"), F.col("g").alias("grp"), "band").agg(F.count("*").alias("shared"), F.bool_or(placed).alias("placed"), F.min("least").alias("least"), F.max("most").alias("most"))
    up = lambda c: F.ceil(c * percent / 100)
    lo, hi = F.greatest("least", up(F.col("n"))), F.least(F.col("most"), F.floor(F.col("n") * 100 / percent))
    need = lambda m: F.ceil((F.col("n") + m) * percent / (100 + percent)) - F.greatest(up(F.col("n")), up(m)) + 1
    asked = table(met.filter("placed").filter(F.col("shared") >= F.least(need(lo), need(hi))).select("id", "n", "own", "grp").distinct(), "asked", folder)
    groups = homes.groupBy("grp").agg(F.sum("n").alias("tokens")).join(asked.groupBy("grp").agg(F.count("*").alias("queries")), "grp")
    groups = table(groups.select("grp", F.ceil(F.col("tokens") / segment).cast("int").alias("segs"), F.ceil(F.col("queries") / salt).cast("int").alias("salts")), "groups", folder)
    members = homes.join(groups, "grp").select("id", "grp", "segs")
    sets = table(sets_of(members.select("id").union(asked.select("id")).distinct()), "sets", folder)
    images = sets.select("id", F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")).alias("images"))
    matrix = table(token_group_matrix(members.join(images, "id")).join(groups.select("grp", "salts"), "grp"), "matrix", folder)
    dealt = asked.join(groups, "grp").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts").join(images, "id")
    opened = bounds(dealt, matrix).filter(F.col("most") * 100 >= F.col("n") * percent).select("id", "grp")
    return table(opened, "opened", folder), cells, sets


def _shared(left: list[np.ndarray], right: list[np.ndarray], most: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of shingle matrices of at most `most` columns."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    met = n > 1
    column, owner = (np.cumsum(met) - 1)[column][met[column]], owner[met[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(met.sum()), most):
        a, b = np.searchsorted(column, [first, first + most])
        x = np.zeros((len(sets), min(most, int(met.sum()) - first)), np.float32)
        x[owner[a:b], column[a:b] - first] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out.astype(np.int64)


def _weights_of_links(left: list[np.ndarray], right: list[np.ndarray], w_left: np.ndarray, w_right: np.ndarray, same: bool, percent: int, part: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each set of two blocks the summed weights of the sets of the other that it links with; of one block, if `same`."""
    a, b = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    n_left, n_right = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    for i in range(0, len(left), part):
        for j in range(0, len(right), part):
            both = _shared(left[i : i + part], right[j : j + part])
            link = 100 * both >= percent * (n_left[i : i + part, None] + n_right[None, j : j + part] - both)
            if same and i == j:
                np.fill_diagonal(link, False)
            a[i : i + part] += link @ w_right[j : j + part]
            b[j : j + part] += w_left[i : i + part] @ link
    return a, b


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key (the first columns), of batches sorted by it."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(c).to_pylist() for c in range(keys)), strict=True))
        cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if rows[lo] != now:
                if parts:
                    yield now, pa.Table.from_batches(parts).combine_chunks()
                now, parts = rows[lo], []
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield now, pa.Table.from_batches(parts).combine_chunks()


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy().view(np.uint64) for x in column.combine_chunks()]


def _roots(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix of links between left and right ones, the least left one that each can reach (-1: none)."""
    n = len(link)
    left, right = np.arange(n), np.full(link.shape[1], n)
    while True:
        right = np.minimum(right, np.where(link, left[:, None], n).min(0))
        new = np.minimum(left, np.where(link, right, n).min(1))
        if (new == left).all():
            return np.where(link.any(1), left, -1), np.where(right < n, right, -1)
        left = new


def _block_links(opened: DataFrame, homes: DataFrame, large: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, block: int, folder: str) -> DataFrame:
    """(a, b): links that join the queries of large groups with all members they link with, a few for each block.

    Both are cut into blocks, those of the group's largest component apart: two blocks of it are not compared, as their
    classes are joined already. A pair of the group's own classes is compared once.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _by_key(batches, 3):
            side, ids, sets = t.column("side").to_numpy(), t.column("id").combine_chunks(), _sets(t.column("shingles"))
            at = [np.flatnonzero(side == k) for k in (0, 1)]
            if not len(at[0]) or not len(at[1]):
                continue
            left, right = [sets[i] for i in at[0]], [sets[i] for i in at[1]]
            n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
            link = np.zeros((len(left), len(right)), bool)
            for i in range(0, len(left), 256):
                for j in range(0, len(right), 256):
                    both = _shared(left[i : i + 256], right[j : j + 256])
                    link[i : i + 256, j : j + 256] = 100 * both >= percent * (n[i : i + 256, None] + m[None, j : j + 256] - both)
            roots = np.concatenate(_roots(link))
            every = np.concatenate(at)
            held = np.flatnonzero(roots >= 0)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[0][roots[held]])), ids.take(pa.array(every[held]))], ["a", "b"])
        tidy()

    key = ["grp", "lo", "hi"]
    members = homes.select("grp", "id").join(large, "grp").withColumn("side", F.lit(1))
    queries = opened.select("grp", "id").join(large, "grp").withColumn("side", F.lit(0))
    rows = members.unionByName(queries).join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")).join(homes.select("id", F.col("grp").alias("home")), "id")
    rows = table(rows, "large", folder)
    main = rows.groupBy("grp", "comp").agg(F.count("*").alias("k")).groupBy("grp").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"))
    rows = rows.join(main, "grp").withColumn("in_main", F.col("comp") == F.col("main"))
    sizes = rows.groupBy("grp").agg(F.ceil(F.count_if(~F.col("in_main")) / (2 * block)).alias("n_out"), F.ceil(F.count_if("in_main") / (2 * block)).alias("n_main"))
    hash_of = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.col(n), F.lit(1)))
    rows = rows.join(sizes, "grp").withColumn("own", F.when(F.col("in_main"), F.col("n_out") + hash_of("n_main")).otherwise(hash_of("n_out")))
    other = F.sequence(F.lit(0).cast("long"), F.col("n_out") + F.col("n_main") - 1)
    once = (F.col("side") == 1) | (F.col("home") != F.col("grp"))
    rows = rows.withColumn("other", F.explode(F.filter(other, lambda o: ~(F.col("in_main") & (o >= F.col("n_out"))) & (once | (o >= F.col("own"))))))
    dealt = rows.select("grp", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("lo"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("hi"), "side", "id").join(sets, "id").select(*key, "side", "id", "shingles")
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(find, "a binary, b binary").filter("a <> b").distinct()


def _linked(docs: DataFrame, percent: int, folder: str, segment: int = SEGMENT, salt: int = SALT, direct: int = DIRECT, block: int = LINK_BLOCK) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows' sets, their classes, the sets of classes that may link, and the components of linked classes."""
    spark = docs.sparkSession
    with scratch(spark, "join-profiles") as early:
        sketch = spark.sparkContext.broadcast(frequency_sketch(docs))  # of a fixed size
        found = table(profiles(docs, sketch, percent), "profiles", early)
        sketch.destroy()  # the table is written; workers give the sketch up
        rows = table(found.drop("posted"), "rows", folder)
        # 1. classes of equal sets, each standing for its first document
        first = F.min(F.struct(F.col("doc_id").isNull().alias("is_null"), F.coalesce("doc_id", F.lit(_TOP)).alias("first_doc"), "text_hash")).alias("f")
        classes = table(rows.filter("n > 0").groupBy("id").agg(F.first("n").alias("n"), F.count("*").alias("weight"), first).select("id", "n", "weight", "f.*"), "classes", folder)
        # 2. posting lists of two classes or more
        posted = table(found.filter("n > 0").groupBy("id").agg(F.first("n").cast("int").alias("n"), F.first("posted").alias("posted")), "posted", folder)
    posts = posted.select("id", "n", F.posexplode("posted").alias("at", "post"))
    sizes = table(posts.groupBy("post").agg(F.count("*").alias("size")).filter("size > 1"), "list-sizes", folder)
    lists = table(posts.join(sizes, "post"), "lists", folder)
    # 3. groups: the longest list that a class is in
    homes = table(lists.groupBy("id").agg(F.first("n").cast("long").alias("n"), F.max(F.struct("size", "post"))["post"].alias("grp")), "homes", folder)
    # 4., 5. the matrix, and what it opens
    sets_of = lambda ids: _sets_of(docs, classes.select("id", "first_doc", "text_hash").join(ids, "id", "left_semi"))
    opened, cells, sets = _opened(lists, homes, sets_of, percent, segment, salt, folder)
    # 6. exact checks: a group's first member, one member of each component, all members of other components
    leads = homes.groupBy("grp").agg(F.min("id").alias("lead"))
    comps = components(table(_check(_pairs(opened.join(leads, "grp"), "id", "lead"), sets, percent), "links", folder), folder)
    # small groups pair by pair, where a query and a member meet in a list
    size = opened.groupBy("grp").agg(F.count("*").alias("q")).join(homes.groupBy("grp").agg(F.count("*").alias("k")), "grp")
    size = table(size.select("grp", (F.col("q") * F.col("k") > direct).alias("large")), "group-sizes", folder)
    small = opened.join(size.filter("not large").select("grp"), "grp")
    held = cells.join(small.select("grp").distinct(), "grp", "left_semi").join(comps, "id", "left")
    held = held.select("post", "grp", F.col("id").alias("m"), F.col("n").alias("o_n"), F.col("at").alias("o_at"), F.coalesce("comp", "id").alias("c"))
    asked = cells.drop("grp").join(small.join(comps, "id", "left"), "id").withColumn("comp", F.coalesce("comp", "id"))
    pairs = asked.join(held, ["post", "grp"]).filter((F.col("comp") != F.col("c")) & _may_link(F.col("n"), F.col("at"), F.col("o_n"), F.col("o_at"), percent))
    pairs = table(_pairs(pairs, "id", "m"), "pairs", folder)
    comps = joined(comps, table(_check(pairs, sets, percent), "links", folder), folder)
    # large groups member by member, without a row for a pair
    large = size.filter("large").select("grp")
    if large.limit(1).count():
        comps = joined(comps, table(_block_links(opened, homes, large, comps, sets, percent, block, folder), "links", folder), folder)
    return rows, classes, sets, comps


def _facts(classes: DataFrame, comps: DataFrame) -> DataFrame:
    """id, weight, comp, component_id: a row for each class."""
    named = classes.select("id", "weight", "first_doc", "is_null").join(comps, "id", "left")
    named = named.select("id", "weight", F.coalesce("comp", "id").alias("comp"), F.when(~F.col("is_null"), F.col("first_doc")).alias("first_doc"))
    # one row for each class, so a component of many is summed up before it is sent
    least = named.groupBy("comp").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("k"))
    return named.drop("first_doc").join(least, "comp").select("id", "weight", "comp", "component_id")


def _named(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows with the facts of their class; a document without words is alone."""
    none = [F.col("doc_id").alias(c) if c == "component_id" else F.lit(None).cast(t).alias(c) for c, t in facts.dtypes if c != "id"]
    return join_facts(rows.filter("n > 0"), facts, ["id"], "weight").unionByName(rows.filter("n = 0").select("*", *none))


def _component_rows(docs: DataFrame, percent: int, **sizes: int) -> DataFrame:
    """doc_id, text_hash, n, comp (null without words) and component_id: a row for each row of `docs`."""
    with scratch(docs.sparkSession, "join") as folder:
        rows, classes, _, comps = _linked(docs, percent, folder, **sizes)
        found = _named(rows, table(_facts(classes, comps), "facts", folder))
        return table(found.select("doc_id", "text_hash", "n", "comp", "component_id"), "components")


def join_components(docs: DataFrame, percent: int = PERCENT, **sizes: int) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of `docs`."""
    return _component_rows(docs, percent, **sizes).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _count_links(classes: DataFrame, sets: DataFrame, comps: DataFrame, percent: int, block: int, folder: str) -> DataFrame:
    """id, linked: how many rows of other classes each class links with, for all classes of components of two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), t in _by_key(batches, 3):
            side, weight = (t.column(c).to_numpy() for c in ("side", "weight"))
            ids, own = t.column("id").combine_chunks(), _sets(t.column("shingles"))
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if same := lo == hi:
                right = left
            a, b = _weights_of_links([own[i] for i in left], [own[i] for i in right], weight[left], weight[right], same, percent)
            at, out = (left, a) if same else (np.concatenate([left, right]), np.concatenate([a, b]))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(out)], ["id", "linked"])
        tidy()

    sizes = comps.groupBy("comp").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = comps.join(sizes, "comp").join(classes.select("id", "weight"), "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select("comp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "weight")
    key = ["comp", "lo", "hi"]
    dealt = table(pairs, "block-pairs", folder).join(sets, "id").select(*key, "side", "id", "weight", "shingles").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "id binary, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def join_links(docs: DataFrame, percent: int = PERCENT, block: int = LINK_BLOCK, **sizes: int) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, n_equal: a row for each row of `docs`.

    n_links is the number of all other rows it links with, n_equal that of those with an equal set.
    """
    with scratch(docs.sparkSession, "join") as folder:
        rows, classes, sets, comps = _linked(docs, percent, folder, block=block, **sizes)
        comps = table(comps, "components", folder)
        linked = _count_links(classes, sets, comps, percent, block, folder)
        equal = F.col("weight") - 1
        facts = _facts(classes, comps).join(linked, "id", "left").select("id", "weight", "component_id", (equal + F.coalesce("linked", F.lit(0))).alias("n_links"), equal.alias("n_equal"))
        found = _named(rows, table(facts, "facts", folder))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return table(found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", zero("n_links"), zero("n_equal")), "links")


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all columns: that with the smallest doc_id (null ids last), and of rows that
    repeat it one. Documents without words stay, one of each doc_id and text."""
    found = _component_rows(docs, percent)
    none, i, h = F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(_TOP)).alias("i"), F.col("text_hash").alias("h")
    alone = F.when(F.col("comp").isNull(), F.struct(none, i, h))
    kept = found.groupBy("comp", alone.alias("alone")).agg(F.min(F.struct(none, i, h)).alias("k")).select("k.*")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_TOP)).alias("i"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    # the join brings rows that repeat each other together, so no further shuffle takes one of them
    return rows.join(kept, ["none", "i", "h"]).groupBy("none", "i", "h").agg(F.first("doc").alias("doc")).select("doc.*")
