"""Mixing sources to target weights by a time-varying curriculum.

Each source's weight schedule is a line over the training time t in [0, 1]: w(t) = target * (1 + ramp * (2 t - 1)).
Its integral D(t) is the source's cumulative word demand, with D(1) = target. The k-th pass over a source (from 0) has
its document with `before` words ahead of it in the keyed order at cumulative word c = k * size of the source + before,
and trains it at the t that solves D(t) = middle of the document at c, in closed form. What the mix takes is what that
inverse places inside the training, at t <= 1; documents are range-sorted by it.

Targets: sources by code point, null last, have weights 5, 2, 1, repeating; they share `share` times all words; a
target stops at `most` times its source's size, and the excess is shared again by weight (water filling in closed form).

Scale: the order inside a source is that of a keyed hash of the row, cut into buckets of about BUCKET rows, so one source
that holds a third of all rows is spread like any other. Exact prefix sums run over (source, bucket) sums, and inside
each bucket row by row. Ranks and water filling over sources are running sums over range partitions, so their number may
be large. What is taken (`shares`) moves narrow rows only; texts are shuffled just for the sorted corpus. The (source,
bucket) plan is broadcast only after its row count was checked, and joined by shuffle otherwise.

Edge cases: a null text has size 0; a document of size 0 is never taken; a null source is a source of its own, sorted
last; repeated rows are equal in the keyed order and are taken alike; an empty table gives an empty result; other
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from typeloom.llm.common import checked_broadcast, n_words, scratch, table, text_of
from typeloom.operators.ordering import numbered, running_sums

WEIGHTS = (5.0, 2.0, 1.0)
RAMPS = (-0.5, 0.0, 0.5)
BUCKET = 8192
MOST_PLAN_ROWS = 100_000
_SOURCE = ["is_null", "src"]


def keyed_order(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits of a keyed digest of the row."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)), 1, 15), 16, 10).cast("long")


def _cycle(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, share: float, most: int, folder: str) -> DataFrame:
    """Water filling over (is_null, src, source_size): target = min(cap, level * weight). One row for each source."""
    caps = numbered(sizes, _SOURCE, "rank", folder=folder).withColumns({"weight": _cycle(WEIGHTS, F.col("rank")), "ramp": _cycle(RAMPS, F.col("rank")), "cap": (F.col("source_size") * most).cast("double")}).withColumn("ratio", F.col("cap") / F.col("weight"))
    levels = table(running_sums(caps, ["ratio", *_SOURCE], {"capped": F.col("cap"), "passed": F.col("weight")}, folder), "levels", folder)
    every = levels.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    total, weight = float((every["words"] or 0) * share), float(every["weight"] or 0)
    here = (F.lit(total) - F.col("capped")) / (F.lit(weight) - F.col("passed"))
    # the first source, by ratio, that the level does not fill up
    found = levels.select("ratio", *_SOURCE, here.alias("level")).filter(F.col("level") <= F.col("ratio")).agg(F.min(F.struct("ratio", *_SOURCE, "level"))["level"]).first()[0]
    full = F.lit(True) if found is None else F.col("ratio") <= found
    return levels.select(*_SOURCE, "source_size", "ramp", F.when(full, F.col("cap")).otherwise(F.lit(found) * F.col("weight")).alias("target"))


def _keys(docs: DataFrame, seed: str) -> list[Column]:
    """size, source key and place in the keyed order of each row."""
    text = text_of(F.col("text").cast("string"))
    return [n_words(text).alias("size"), F.col("source").isNull().alias("is_null"), F.coalesce("source", F.lit("")).alias("src"), keyed_order(F.col("doc_id"), text, seed).alias("place")]


def _bucket(bits: int) -> Column:
    return F.shiftright("place", 60 - bits).alias("bucket")


def _plan(rows: DataFrame, bits: int, share: float, most: int, folder: str) -> DataFrame:
    """A row for each (source, bucket): words of the source before the bucket, the source's size, target and ramp."""
    sums = table(rows.groupBy(*_SOURCE, _bucket(bits)).agg(F.sum("size").alias("words")), "mix-sums", folder)
    goals = targets(sums.groupBy(*_SOURCE).agg(F.sum("words").alias("source_size")), share, most, folder)
    ahead = W.partitionBy(*_SOURCE).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn("prefix", F.coalesce(F.sum("words").over(ahead), F.lit(0))).join(goals, _SOURCE).drop("words")


def position(c: Column, target: Column, ramp: Column) -> Column:
    """The time t at which a source's cumulative demand is c: target * ((1 - ramp) * t + ramp * t * t) = c."""
    x = c / target
    root = (ramp - 1 + F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * x)) / (2 * ramp)
    return F.when(ramp == 0, x).otherwise(root)


def _placed(rows: DataFrame, plan: DataFrame, bits: int, most: int) -> DataFrame:
    """`rows` (with size, source key and place) with source_size, target, and positions: one for each time it is taken."""
    joined = rows.withColumn("bucket", _bucket(bits)).join(checked_broadcast(plan, MOST_PLAN_ROWS), [*_SOURCE, "bucket"])
    inside = W.partitionBy(*_SOURCE, "bucket").orderBy("place")
    # rows that repeat are at the same place: they share their middle
    upto = F.col("prefix") + F.sum("size").over(inside.rangeBetween(W.unboundedPreceding, W.currentRow))
    here = F.sum("size").over(W.partitionBy(*_SOURCE, "bucket", "place"))
    middle = joined.withColumn("middle", upto - here / 2.0)
    times = F.transform(F.array(*[F.lit(k) for k in range(most)]), lambda k: k * F.col("source_size") + F.col("middle"))
    inside_demand = F.when(F.col("size") > 0, F.filter(times, lambda c: c <= F.col("target"))).otherwise(F.array().cast("array<double>"))
    # c <= target is t <= 1, without the rounding of the root
    return middle.withColumn("positions", F.transform(inside_demand, lambda c: F.least(F.lit(1.0), position(c, F.col("target"), F.col("ramp")))))


def shares(docs: DataFrame, seed: str = "mix", share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken and positions (one for each time it is taken): a row for each row of `docs`."""
    with scratch(docs.sparkSession, "mix") as folder:
        rows = table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys(docs, seed)), "mix-rows", folder)
        bits = max(0, (rows.count() // BUCKET).bit_length())
        plan = table(_plan(rows, bits, share, most, folder), "mix-plan", folder)
        taken = (F.size("positions") * F.col("size")).alias("taken")
        return table(_placed(rows, plan, bits, most).select("doc_id", "size", "source_size", "target", taken, "positions"), "mix")


def training_positions(docs: DataFrame, seed: str = "mix", share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, pass, position: a row for each time a document is taken, range-sorted by training position."""
    return shares(docs, seed, share, most).select("doc_id", F.posexplode("positions").alias("pass", "position")).orderBy("position", "doc_id", "pass")


def curriculum(docs: DataFrame, seed: str = "mix", share: float = 1.5, most: int = 2) -> DataFrame:
    """The mixed corpus: the columns of `docs`, a row for each time a document is taken, range-sorted by training position."""
    spark = docs.sparkSession
    with scratch(spark, "mix") as folder:
        rows = table(docs.select(*_keys(docs, seed)), "mix-rows", folder)
        bits = max(0, (rows.count() // BUCKET).bit_length())
        plan = table(_plan(rows, bits, share, most, folder), "mix-plan", folder)
        whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_keys(docs, seed))
        # a document goes to its two or more places as one row each
        mixed = _placed(whole, plan, bits, most).select("doc", F.explode("positions").alias("position"))
        return table(mixed.orderBy("position", F.col("doc.doc_id")).select("doc.*"), "mixed")
