"""Training-order materialisation of token ids.

Documents are tokenised once with a public byte-level BPE vocabulary, each followed by an end mark. A keyed hash of the
document deals them to buckets of about BUCKET_BYTES of text, where they are put one after the other in the hash's order
and cut into sequences of LENGTH tokens (the last one of a bucket is padded with end marks); neither depends on how the
input was partitioned. A keyed Feistel permutation with cycle-walking gives every sequence a global slot; partitions
that are ranges of slots write shards of fixed-stride records (LENGTH ids of 16 bits, little endian, and one record
mark), so a reader seeks to record k of the order at shard k // per_shard, byte (k % per_shard) * STRIDE, and resumes at
any slot. The listing beside the shards has the true number of tokens, a checksum and the documents of every sequence.

Shards are written in WAVES ranges of slots, one after the other, so that only one range at a time is in the
shuffle's files. The number of sequences before each bucket is a sum over a row for each bucket.

Recovery: the sequences are a table in the shared folder before the first shard is written, so a lost executor costs
its own tasks only; the table goes when the shards are there. `training_order` reads the shards back and fails where a
record differs from its checksum.

Edge cases: null and empty texts are an end mark only; texts are read whole, whatever their length; repeated rows are
put one after the other, as often as they come; a null doc_id stays null in the listing; an empty table writes no shard
and gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from typeloom.llm.common import checked_broadcast, fresh_path, let, scratch, table, writing
from typeloom.llm.kernels import chunks, mix, tidy

LENGTH = 2047
STRIDE = 2 * (LENGTH + 1)
MARK = b"\n\n"
END = 50256
PER_SHARD = 2048
WAVES = 4
BUCKET_BYTES = 1 << 24
ROUNDS = 4
MOST_BUCKETS = 100_000
MOST_TASKS = 20_000
#: The vocabulary's file and the pattern that goes with it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_bytes(text: str | None, encode: Callable[[str], list[int]]) -> bytes:
    """The ids of a text with the end mark, 16 bits each."""
    ids = array("H", encode(text) if text else ())
    ids.append(END)
    return ids.tobytes()


def feistel(slots: np.ndarray, n: int, key: int, backward: bool = False) -> np.ndarray:
    """A keyed permutation of range(n): a balanced Feistel network over the next even power of two, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = slots.astype(np.uint64)
    todo = np.arange(len(x))
    rounds = range(ROUNDS)
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & low
        for r in reversed(rounds) if backward else rounds:
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))
            if backward:
                left, right = right ^ (mix(left + salt) & low), left
            else:
                left, right = right, left ^ (mix(right + salt) & low)
        x[todo] = (left << np.uint64(half)) | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def _tokens(docs: DataFrame, vocabulary: str, key: int, n_buckets: int) -> DataFrame:
    """bucket, place, doc_id, tokens: a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in chunks(batches, "text"):
            tokens = [token_bytes(t, encode) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.binary())], ["place", "doc_id", "tokens"])
        tidy()

    rows = docs.select(F.xxhash64(F.lit(key), F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "place long, doc_id long, tokens binary").withColumn("bucket", F.pmod("place", F.lit(n_buckets)).cast("int"))


class Packer:
    """Cuts one bucket's stream of tokens into sequences."""

    def __init__(self, bucket: int):
        self.bucket, self.index = bucket, 0
        self.rest, self.ids = np.zeros(0, np.uint16), pa.array([], pa.int64())
        self.starts = np.zeros(0, np.int64)

    def take(self, doc_ids: pa.Array, tokens: pa.Array, last: bool) -> Iterator[pa.RecordBatch]:
        """The sequences that are full now, and if `last` the one that is left."""
        n = np.diff(np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]) // 2 if len(tokens) else np.zeros(0, np.int64)
        at = int(np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset]) if len(tokens) else 0
        own = np.frombuffer(tokens.buffers()[2], np.uint8)[at : at + 2 * int(n.sum())].view(np.uint16) if len(tokens) else self.rest[:0]
        starts = np.concatenate([self.starts, len(self.rest) + np.cumsum(n) - n])
        stream, ids = np.concatenate([self.rest, own]), pa.concat_arrays([self.ids, doc_ids])
        full = len(stream) // LENGTH
        used = [LENGTH] * full
        if last and len(stream) > full * LENGTH:
            used.append(len(stream) - full * LENGTH)
            stream = np.concatenate([stream, np.full(LENGTH - used[-1], END, np.uint16)])
            full += 1
        if full:
            body = stream[: full * LENGTH].astype("<u2", copy=False).reshape(full, LENGTH)
            # the documents of a sequence: from the one it begins in to the one it ends in
            heads = np.arange(full) * LENGTH
            first = np.searchsorted(starts, heads, "right") - 1
            stop = np.searchsorted(starts, heads + LENGTH, "left")
            for a in range(0, full, 256):
                z = min(full, a + 256)
                held = np.concatenate([np.arange(first[i], stop[i]) for i in range(a, z)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(stop[a:z] - first[a:z])]).astype(np.int32)), ids.take(pa.array(held)))
                raw = [r.tobytes() for r in body[a:z]]
                yield pa.RecordBatch.from_arrays([pa.array([self.bucket] * (z - a), pa.int32()), pa.array(np.arange(self.index + a, self.index + z)), pa.array(used[a:z], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), lists, pa.array(raw, pa.binary())], ["bucket", "index", "n_tokens", "crc", "doc_ids", "record"])
            self.index += full
        at = full * LENGTH
        self.rest = stream[at:].copy()
        keep = max(0, int(np.searchsorted(starts, at, "right")) - 1) if len(self.rest) else len(starts)
        self.starts, self.ids = starts[keep:] - at, ids[keep:]


def _sequences(tokens: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, index (in the bucket), n_tokens, crc, doc_ids, record: a row for each sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Packer | None = None
        none = (pa.array([], pa.int64()), pa.array([], pa.binary()))
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else [0]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if now is None or now.bucket != bucket[a]:
                    if now is not None:
                        yield from now.take(*none, last=True)
                    now = Packer(int(bucket[a]))
                yield from now.take(batch.column(1).slice(a, z - a), batch.column(2).slice(a, z - a), last=False)
        if now is not None:
            yield from now.take(*none, last=True)
        tidy()

    dealt = tokens.repartitionById(min(n_buckets, MOST_TASKS), F.pmod("bucket", F.lit(MOST_TASKS))).sortWithinPartitions("bucket", "place", "doc_id", "tokens").select("bucket", "doc_id", "tokens")
    return dealt.mapInArrow(run, "bucket int, index long, n_tokens long, crc long, doc_ids array<long>, record binary")


def materialise(docs: DataFrame, path: str | None = None, key: int = 1, vocabulary: str = VOCABULARY, per_shard: int = PER_SHARD, waves: int = WAVES, bucket_bytes: int = BUCKET_BYTES) -> tuple[str, DataFrame, int]:
    """Writes the shards under `path` (else a new one in the shared folder); gives the path, the listing and the number of sequences.

    The listing has slot, n_tokens, crc and doc_ids: a row for each sequence.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    with scratch(spark, "sequences") as folder:
        n_buckets = -(-size // bucket_bytes) or 1
        rows = table(_sequences(_tokens(docs, vocabulary, key, n_buckets), n_buckets), "sequences", folder)
        # a row for each bucket
        counts = table(rows.groupBy("bucket").agg(F.count("*").alias("n")), "counts", folder)
        ahead = counts.select("bucket", F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
        ahead = checked_broadcast(table(ahead, "offsets", folder), MOST_BUCKETS)
        total = counts.agg(F.sum("n")).first()[0] or 0

        @F.arrow_udf("long")
        def slot(index: pa.Array) -> pa.Array:
            return pa.array(feistel(index.to_numpy(), total, key))

        placed = rows.join(ahead, "bucket").withColumn("slot", slot(F.col("ahead") + F.col("index")))
        listing = table(placed.select("slot", "n_tokens", "crc", "doc_ids"), "listing", path)
        n_shards = -(-total // per_shard)
        step = -(-n_shards // waves) or 1
        for first in range(0, n_shards, step):
            n = min(step, n_shards - first)
            own = placed.filter((F.col("slot") >= first * per_shard) & (F.col("slot") < (first + n) * per_shard))
            own = own.select("slot", F.col("record").cast("string").alias("value"), (F.floor(F.col("slot") / per_shard) - first).cast("int").alias("shard"))
            # ranges of slots: shard k is partition k of its wave, and its file holds its slots in order
            with writing(spark):
                own.repartitionById(n, "shard").sortWithinPartitions("slot").select("value").write.option("lineSep", MARK.decode()).text(f"{path}/shards/first={first}")
    return path, listing, total


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, path and content of every shard's file."""
    files = spark.read.format("binaryFile").load(f"{path}/shards").filter(F.col("length") > 0)
    return files.select((F.col("first") + F.regexp_extract("path", "/part-([0-9]+)-[^/]*$", 1).cast("int")).cast("int").alias("shard"), "path", "content")


def read_shards(spark: SparkSession, path: str, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, shard, byte_offset and record, read back from the shards by their stride."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (shard, name) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                raw = batch.column(2)[i].as_buffer()  # not copied
                if raw.size % STRIDE:
                    raise ValueError(f"{name} is not a whole number of records")
                ids = np.frombuffer(raw, "<u2").reshape(-1, LENGTH + 1)
                if (ids[:, LENGTH] != np.frombuffer(MARK, "<u2")[0]).any():
                    raise ValueError(f"{name} has a record without its mark")
                for a in range(0, len(ids), 256):
                    own = [r.tobytes() for r in ids[a : a + 256, :LENGTH]]
                    at = np.arange(a, a + len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(shard * per_shard + at), pa.array([shard] * len(at), pa.int32()), pa.array(at * STRIDE), pa.array(own, pa.binary())], ["slot", "shard", "byte_offset", "record"])
        tidy()

    return _shards(spark, path).mapInArrow(run, "slot long, shard int, byte_offset long, record binary")


def checked_shards(spark: SparkSession, path: str, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, shard, byte_offset and crc of each record, taken from the shards' bytes where they are read; a shard that is no
    whole number of marked records is an error."""
    place = lambda k, more: (k * STRIDE + more + 1).cast("int")
    part = lambda c, k, more, n: F.substring(c, place(k, more), F.lit(n))
    every = F.sequence(F.lit(0), F.floor(F.octet_length("content") / STRIDE).cast("int") - 1)
    # the content is bound once: a column would be copied out of its row for every record
    crcs = let(F.col("content"), lambda c: F.transform(every, lambda k: F.when(part(c, k, 2 * LENGTH, 2) == F.lit(MARK), F.crc32(part(c, k, 0, 2 * LENGTH)))))
    whole = F.octet_length("content") % STRIDE == 0
    rows = _shards(spark, path).select("shard", F.when(whole, crcs).otherwise(F.raise_error(F.concat("path", F.lit(" is not a whole number of records"))).cast("array<bigint>")).alias("crcs"))
    rows = rows.select("shard", F.posexplode("crcs").alias("k", "crc"))
    return rows.select((F.col("shard") * F.lit(per_shard).cast("long") + F.col("k")).alias("slot"), "shard", (F.col("k") * F.lit(STRIDE).cast("long")).alias("byte_offset"), "crc")


def training_order(docs: DataFrame, key: int = 1, vocabulary: str = VOCABULARY, per_shard: int = PER_SHARD, waves: int = WAVES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """slot, shard, byte_offset and crc, read back from the shards, with n_tokens and doc_ids: a row for each sequence."""
    spark = docs.sparkSession
    path, listing, total = materialise(docs, None, key, vocabulary, per_shard, waves, bucket_bytes)
    if not total:
        return spark.createDataFrame([], "slot long, shard int, byte_offset long, n_tokens long, crc long, doc_ids array<long>")
    listed = listing.select("slot", "n_tokens", F.col("crc").alias("listed"), "doc_ids")
    back = checked_shards(spark, path, per_shard).join(listed, "slot", "full")
    same = F.coalesce(F.col("crc") == F.col("listed"), F.lit(False))
    found = back.select("slot", "shard", "byte_offset", "n_tokens", F.when(same, F.col("crc")).otherwise(F.raise_error(F.lit("a shard differs from its listing")).cast("long")).alias("crc"), "doc_ids")
    # the check is done here, with the small batches of a written table
    return table(found, "order", path)
