"""Refinement: which calls to look at again, and merging of better ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_PRIORITY = {"exact": 5, "closest": 4, "novel": 3, "partial": 2, "missing": 1}


def call_rank(prefix: str = "") -> Column:
    """Order of calls: type, then confidence."""
    kind = F.lit(0)
    for name, p in _PRIORITY.items():
        kind = F.when(F.col(f"{prefix}call_type") == name, p).otherwise(kind)
    return F.struct(kind.alias("p"), F.col(f"{prefix}confidence").alias("c"))


def low_confidence() -> Column:
    poor = F.col("identity").isNotNull() & ((F.col("identity") < 98) | (F.col("coverage") < 0.98))
    return F.coalesce(F.col("multiple_hits") | F.col("call_type").isin("novel", "partial", "missing") | poor, F.lit(False))


def confirm_set(calls: DataFrame, limit: int = 64) -> DataFrame:
    """Closest calls of each sample, poorest first."""
    w = W.partitionBy("sample_id").orderBy(call_rank(), "locus")
    return calls.filter("call_type = 'closest'").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def low_confidence_set(calls: DataFrame, limit: int = 120) -> DataFrame:
    w = W.partitionBy("sample_id").orderBy(call_rank(), "locus")
    return calls.filter(low_confidence()).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def adaptive_budget(n: Column) -> Column:
    """Second-pass loci for n candidates: none, all up to 40, then 40, 60 and 80."""
    return F.when(n <= 0, 0).when(n <= 40, n).when(n <= 120, 40).when(n <= 300, 60).otherwise(80)


def second_pass(calls: DataFrame, budget: int | None = None) -> DataFrame:
    """Partial and closest calls by identity, coverage and confidence, within the sample's budget."""
    mine = W.partitionBy("sample_id")
    order = mine.orderBy(F.desc("identity"), F.desc("coverage"), F.desc("confidence"), "locus")
    some = calls.filter(F.col("call_type").isin("partial", "closest")).withColumns({"n": F.count("*").over(mine), "place": F.row_number().over(order)})
    return some.filter(F.col("place") <= (F.lit(budget) if budget is not None else adaptive_budget(F.col("n")))).drop("n")


def within_limit(chosen: DataFrame, limit: int, unlimited_at_zero: bool = True) -> DataFrame:
    """All or nothing: samples with more chosen loci than the limit have none (0 or less: no limit, or none at all)."""
    if limit <= 0:
        return chosen if unlimited_at_zero else chosen.limit(0)
    return chosen.withColumn("n", F.count("*").over(W.partitionBy("sample_id"))).filter(F.col("n") <= limit).drop("n")


def keep_better(base: DataFrame, other: DataFrame) -> DataFrame:
    """base with calls replaced where the other's rank is strictly greater; loci of only one side are kept."""
    key = ["sample_id", "locus"]
    fields = [c for c in base.columns if c not in key]
    b = base.select(*key, F.struct(*fields).alias("b"), call_rank().alias("rb"))
    o = other.select(*key, F.struct(*fields).alias("o"), call_rank().alias("ro"))
    both = b.join(o, key, "full_outer")
    pick = F.when(F.col("b").isNull() | (F.col("ro") > F.col("rb")), F.coalesce("o", "b")).otherwise(F.col("b"))
    return both.select(*key, pick.alias("p")).select(*key, "p.*")


def prefilter_is_confident(found: DataFrame, total: int, share: float = 0.3) -> DataFrame:
    """One row: do enough loci have candidates? At least max(1, ceil(total * share)) of them."""
    share = min(1.0, max(0.0, share))
    least = max(1, -(-int(round(total * share * 1e9)) // 10**9))
    return found.agg(F.count_distinct("locus").alias("n_loci")).select("n_loci", (F.lit(total > 0) & (F.col("n_loci") >= least)).alias("confident"))
