"""Benchmark decontamination: documents that hold a benchmark item within few word edits.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. An item of m words is found where its edit
distance to some stretch of a document is at most `share` percent of m.

1. Places that could hold an item: with e edits an item still shares at least m - 2 - 3 e of its three-word grams with
   the stretch, on diagonals within e of each other. Items for which that is below 1 (five words) have shorter grams,
   k = m / (1 + e) words, so that one is always left. This counting bound loses nothing; it only spares the embedding of
   windows in which no item can be.
2. The item-sized windows that begin on such a place's diagonals are embedded by CGK random walks (a shared random bit
   for each step and word decides whether the walk stays or moves on), which turn edit distance into Hamming distance.
   Bit sampling of the embeddings, repeated with independent walks, retrieves items. The number of repetitions is set for
   each size class so that windows with the most edits allowed meet their item with probability `recall`, by the
   agreement measured on edited copies of all its items, whatever number that takes.
3. Retrieved pairs are verified by the exact edit distance of the item to the best stretch around the window.

The benchmark is a stated query set: it is read in blocks of `block` items and about BLOCK_WORDS words at most, each a
broadcast of bounded size, against all rows.

Edge cases: null or empty items match nothing, items of fewer than five words only exactly; null and empty documents
hold nothing; long texts are read whole; repeated rows are each reported; a null doc_id is kept; an empty documents
or benchmark table gives an empty result (and keeps all documents); extra columns pass through `keep_clean` untouched.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.kernels import LOOSE, Words, chunks, grams, mix, tidy

SHARE = 20
RECALL = 0.999
BLOCK = 20_000
BLOCK_WORDS = 2_000_000
GRAM = 3
SAMPLES = 2
#: Walks by which agreement is measured.
WALKS = 64
#: Edited copies measured in each size class, at least; each item has one or more.
COPIES = 1000
_TABLE_BITS = 22
_PAD = np.uint64(0)


def most_edits(m: np.ndarray | int, share: int = SHARE) -> np.ndarray | int:
    return m * share // 100


def gram_size(m: int, e: int) -> int:
    """The longest grams, of GRAM words at most, of which e edits leave an item of m words at least one."""
    return max(1, min(GRAM, m // (1 + e)))


def walks(h: np.ndarray, start: np.ndarray, stop: np.ndarray, seeds: np.ndarray, steps: int) -> np.ndarray:
    """CGK embeddings, seeds x windows x steps: the word under the walk at each step (0 past the window's end)."""
    at = np.broadcast_to(start, (len(seeds), len(start))).copy()
    out = np.empty((*at.shape, steps), np.uint64)
    for j in range(steps):
        word = np.where(at < stop, h[np.minimum(at, len(h) - 1)], _PAD)
        out[:, :, j] = word
        bit = mix(word + mix(seeds + np.uint64(j))[:, None]) & np.uint64(1)
        at += np.where(at < stop, bit, np.uint64(1)).astype(np.int64)
    return out


def repetitions(q: np.ndarray, recall: float) -> int:
    """How many tables reach the recall over windows whose sampled places all agree with probabilities q > 0."""
    reached = lambda n: np.mean((1 - q) ** n) <= 1 - recall
    most = 16
    while not reached(most):
        most *= 2
    return next(n for n in range(max(16, most // 2), most + 1) if reached(n))


@dataclass
class Index:
    """Of a block of items: words, gram table, and LSH tables by size class."""

    ids: list[int]
    words: list[np.ndarray]
    edits: np.ndarray
    gram_size: np.ndarray
    least: np.ndarray
    gram_keys: np.ndarray
    gram_first: np.ndarray
    gram_item: np.ndarray
    gram_at: np.ndarray
    bitmap: np.ndarray
    sizes: list[int]
    seeds: dict[int, np.ndarray]
    picks: dict[int, np.ndarray]
    tables: dict[tuple[int, int], dict[int, list[int]]]
    known: dict[tuple[int, int], np.ndarray]


def _class(m: int) -> int:
    """Size class: windows of a class have the length of its smallest item."""
    return int(math.log(max(m, 1), 1.25))


def _agreement(words: list[np.ndarray], edits: list[int], size: int, rng: random.Random) -> np.ndarray:
    """Of copies of all items with as many random edits as allowed: the chance that all sampled places of item and window agree."""
    steps, out = max(SAMPLES, int(1.5 * size)), []
    todo = [i for i in range(len(words)) for _ in range(-(-COPIES // len(words)))]
    for part in range(0, len(todo), 256):
        flat, start, n = [], [], 0
        for i in todo[part : part + 256]:
            w, e = words[i].tolist(), edits[i]
            copy = list(enumerate(w))
            for _ in range(e):
                k, kind = rng.randrange(len(copy)), rng.randrange(3)
                copy[k : k + (kind != 1)] = [] if kind == 0 and len(copy) > 1 else [(-9, rng.getrandbits(62))]
            # the window begins where find() has it begin, on the diagonal of most grams kept
            lines = Counter(k - copy[k][0] for k in range(len(copy) - GRAM + 1) if copy[k][0] >= 0 and all(copy[k + j][0] == copy[k][0] + j for j in range(GRAM)))
            line = max(lines, key=lines.get) if lines else 0
            around = [rng.getrandbits(62) for _ in range(2 * e + size)]
            start += [n, n + len(w) + e + line]
            row = [*w, *around[:e], *(x for _, x in copy), *around[e:]]
            flat += row
            n += len(row)
        begin = np.array(start)
        e = walks(np.array(flat, np.uint64), begin, begin + size, mix(np.arange(WALKS, dtype=np.uint64) + np.uint64(1 << 40)), steps)
        agree = (e[:, ::2] == e[:, 1::2]).sum(2) + 0.5  # never quite none
        out.append(((agree / (steps + 1)) ** SAMPLES).mean(0))
    return np.concatenate(out)


def build(items: list[tuple[int, str]], share: int = SHARE, recall: float = RECALL) -> Index:
    w = Words(pa.array([t for _, t in items], pa.string()), lower=True, sep=LOOSE)
    h = w.hashes()
    some = [i for i in range(len(items)) if w.count[i] > 0]
    words = [h[w.first[i] : w.first[i + 1]] for i in some]
    m = np.array([len(x) for x in words], np.int64)
    edits = np.where(m < 5, 0, most_edits(m, share))
    size_of = np.array([gram_size(len(x), int(e)) for x, e in zip(words, edits, strict=True)], np.int64)
    g = [grams(x, int(k)) for x, k in zip(words, size_of, strict=True)]
    keys = np.concatenate(g) if g else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(g)), [len(x) for x in g])
    place = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, item, place = keys[order], item[order], place[order]
    distinct, first = np.unique(keys, return_index=True)
    bitmap = np.zeros(1 << _TABLE_BITS, bool)
    bitmap[(distinct >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    rng = np.random.default_rng(7)
    sizes = sorted({_class(len(x)) for x in words})
    seeds, picks, tables = {}, {}, {}
    for c in sizes:
        members = [i for i, x in enumerate(words) if _class(len(x)) == c]
        size = min(len(words[i]) for i in members)
        reps = repetitions(_agreement([words[i] for i in members], [int(edits[i]) for i in members], size, random.Random(c)), recall)
        seeds[c] = mix(np.arange(1, reps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        picks[c] = np.stack([rng.choice(max(SAMPLES, int(1.5 * size)), SAMPLES, replace=False) for _ in range(reps)])
        flat = np.concatenate([words[i][:size] for i in members])
        start = np.arange(len(members)) * size
        part = _most_windows(reps, size)
        sampled = np.concatenate([_samples(flat, start[k : k + part], start[k : k + part] + size, seeds[c], picks[c]) for k in range(0, len(start), part)], 1)
        for r in range(reps):
            t = tables.setdefault((c, r), {})
            for i, k in zip(members, sampled[r].tolist(), strict=True):
                t.setdefault(k, []).append(i)
        picks[c] = np.concatenate([picks[c], np.full((reps, 1), size)], 1)
    return Index([items[i][0] for i in some], words, edits, size_of, np.maximum(1, m - size_of + 1 - size_of * edits), distinct, np.append(first, len(keys)), item, place, bitmap, sizes, seeds, picks, tables, {k: np.sort(np.fromiter(t, np.uint64, len(t))) for k, t in tables.items()})


def _most_windows(reps: int, size: int) -> int:
    """How many windows are embedded at once, in about 64 MB."""
    return max(1, (1 << 23) // (reps * max(SAMPLES, int(1.5 * size))))


def _samples(h: np.ndarray, start: np.ndarray, stop: np.ndarray, seeds: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """A key for each repetition and window: the embedding at the repetition's sampled places."""
    e = walks(h, start, stop, seeds, int(picks.max()) + 1)
    key = np.zeros(e.shape[:2], np.uint64)
    for s in range(picks.shape[1]):
        key = mix(key + e[np.arange(len(seeds)), :, picks[:, s]])
    return key


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and where that stretch ends."""
    row = np.zeros(len(text) + 1, np.int64)
    ramp = np.arange(len(text) + 1)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min()), int(row.argmin())


def best_stretches(items: list[np.ndarray], h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best_stretch of each item in h[lo:hi], many at once."""
    m, span = np.array([len(x) for x in items]), hi - lo
    edits, ends = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    order, k = np.lexsort((span, m)), 0
    while k < len(order):
        n = max(1, (1 << 18) // (int(span[order[k : k + 512]].max()) + 1))
        at = order[k : k + min(n, 512)]
        k += len(at)
        wide, tall = int(span[at].max()), int(m[at].max())
        place = lo[at, None] + np.arange(wide)
        text = np.where(place < hi[at, None], h[np.minimum(place, len(h) - 1)], _PAD)
        item = np.zeros((len(at), tall), np.uint64)
        for j, i in enumerate(at.tolist()):
            item[j, : len(items[i])] = items[i]
        row, ramp = np.zeros((len(at), wide + 1), np.int32), np.arange(wide + 1, dtype=np.int32)
        for i in range(1, tall + 1):
            new = np.empty_like(row)
            new[:, 0] = i
            new[:, 1:] = np.minimum(row[:, :-1] + (text != item[:, i - 1 : i]), row[:, 1:] + 1)
            row = np.minimum.accumulate(new - ramp, 1) + ramp
            done = np.flatnonzero(m[at] == i)
            edits[at[done]], ends[at[done]] = row[done].min(1), row[done].argmin(1)
    return edits, ends


def find(column: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item number, edits, first word, words) of each item found in the texts of a piece, best place only."""
    w = Words(column, lower=True, sep=LOOSE)
    h = w.hashes()
    if not len(index.words) or not len(h):
        return
    hits = []
    for k in np.unique(index.gram_size).tolist():
        g = grams(h, k)
        at = np.flatnonzero(index.bitmap[(g >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]) if len(g) else np.zeros(0, np.int64)
        at = at[w.row[at] == w.row[at + k - 1]]
        slot = np.searchsorted(index.gram_keys, g[at])
        slot[slot == len(index.gram_keys)] = 0
        ok = index.gram_keys[slot] == g[at]
        at, slot = at[ok], slot[ok]
        n = index.gram_first[slot + 1] - index.gram_first[slot]
        entry = np.repeat(index.gram_first[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        hits.append((np.repeat(at, n), index.gram_item[entry], index.gram_at[entry]))
    at, item, place = (np.concatenate(x) for x in zip(*hits, strict=True))
    if not len(at):
        return
    diagonal = at - place - w.first[w.row[at]] + 4096
    width = np.array([len(x) for x in index.words])[item] + 2 * index.edits[item] + 1
    cell = diagonal // width
    # counts in a cell and the next one; all grams of a find lie in two such cells
    key = np.stack([w.row[at], item, cell], 1)
    cells, inverse, count = _unique_rows(key)
    nxt = np.zeros(len(cells), np.int64)
    follows = (cells[1:, 0] == cells[:-1, 0]) & (cells[1:, 1] == cells[:-1, 1]) & (cells[1:, 2] == cells[:-1, 2] + 1)
    nxt[:-1][follows] = count[1:][follows]
    full = count + nxt >= index.least[cells[:, 1]]
    marked = full.copy()
    marked[1:] |= full[:-1] & follows
    use = marked[inverse.ravel()]
    # windows begin on the diagonal of most hits in each cell
    lines, _, hits_of = _unique_rows(np.stack([w.row[at[use]], item[use], diagonal[use]], 1)) if use.any() else (np.zeros((0, 3), np.int64), None, np.zeros(0, np.int64))
    if not len(lines):
        return
    of_class = np.array([_class(len(x)) for x in index.words])[lines[:, 1]]
    pairs: list[np.ndarray] = []
    for c in np.unique(of_class).tolist():
        size = int(index.picks[c][0, -1])
        starts = np.unique(lines[of_class == c][:, [0, 2]], axis=0)
        most = _most_windows(len(index.seeds[c]), size)
        for part in range(0, len(starts), most):
            r = starts[part : part + most, 0]
            b = np.maximum(starts[part : part + most, 1] - 4096 + w.first[r], w.first[r])
            keys = _samples(h, b, np.minimum(b + size, w.first[r + 1]), index.seeds[c], index.picks[c][:, :-1])
            for rep in range(len(index.seeds[c])):
                t = index.tables[c, rep]
                known = index.known[c, rep]
                at = np.searchsorted(known, keys[rep])
                at[at == len(known)] = 0
                for i in np.flatnonzero(known[at] == keys[rep]).tolist():
                    pairs.append(np.array([(r[i], b[i], x) for x in t[int(keys[rep, i])]]))
    if not pairs:
        return
    r, b, x = np.unique(np.concatenate(pairs), axis=0).T
    e, m = index.edits[x], np.array([len(i) for i in index.words])[x]
    lo, hi = np.maximum(w.first[r], b - e), np.minimum(w.first[r + 1], b + m + 2 * e)
    edits, ends = best_stretches([index.words[i] for i in x.tolist()], h, lo, hi)
    good = np.flatnonzero(edits <= e)
    # the best window of each row and item
    good = good[np.lexsort((b[good], edits[good], x[good], r[good]))]
    lead = np.concatenate([np.ones(min(1, len(good)), bool), (r[good][1:] != r[good][:-1]) | (x[good][1:] != x[good][:-1])])
    for k in good[lead].tolist():
        end = int(lo[k] + ends[k])
        back = best_stretch(index.words[x[k]][::-1], h[lo[k] : end][::-1])[1]
        yield int(r[k]), int(x[k]), int(edits[k]), end - back - int(w.first[r[k]]), int(m[k])


def _unique_rows(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((key[:, 2], key[:, 1], key[:, 0]))
    s = key[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]).any(1)])
    group = np.cumsum(new) - 1
    inverse = np.empty(len(key), np.int64)
    inverse[order] = group
    return s[new], inverse, np.bincount(group)


def blocks(benchmark: DataFrame, block: int, most_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The query set, a bounded block of items at a time, in the order of item_id."""
    rows, part, words = benchmark.filter("text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id").toLocalIterator(), [], 0
    for r in rows:
        part.append((r[0], r[1]))
        words += r[1].count(" ") + 1
        if len(part) == block or words >= most_words:
            yield part
            part, words = [], 0
    if part:
        yield part


def leaks(docs: DataFrame, benchmark: DataFrame, share: int = SHARE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, edits, item_words, first_word: a row for each item in each document that holds it."""
    schema = "doc_id long, item_id long, edits long, item_words long, first_word long"
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], schema)
    for part in blocks(benchmark, block):
        held = docs.sparkSession.sparkContext.broadcast(build(part, share, recall))

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast[Index] = held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in chunks(batches, "text"):
                if found := list(find(batch.column(1), index)):
                    r, x, e, b, n = map(list, zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array([index.ids[i] for i in x], pa.int64()), pa.array(e, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "item_id", "edits", "item_words", "first_word"])

        out = out.unionByName(source.mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, share: int = SHARE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The documents that hold no item, with all columns."""
    for part in blocks(benchmark, block):
        held = docs.sparkSession.sparkContext.broadcast(build(part, share, recall))

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast[Index] = held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in chunks(batches, "text"):
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, *_ in find(batch.column(batch.schema.get_field_index("text")), index)]] = False
                yield batch.filter(pa.array(clean))
            tidy()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
