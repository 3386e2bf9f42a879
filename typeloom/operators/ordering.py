"""Sums and numbers along a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from typeloom.storage import table


def running_sums(rows: DataFrame, order: list[str | Column], sums: dict[str, Column], folder: str | None = None) -> DataFrame:
    """`rows` with, for each name of `sums`, the sum of its column over all rows before this one in the order.

    Rows are range-partitioned by the order and written once; what lies before a partition is a sum over one row for each
    partition, so only that small table is ever in one task. The order must be total for reruns to agree.
    """
    named = rows.withColumns({f"_{k}": c for k, c in sums.items()})
    parts = table(named.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered", folder)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    ahead = table(totals.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_ahead_{k}") for k in sums]), "ahead", folder)
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # a row for each partition
    found = parts.join(F.broadcast(ahead), "_part").withColumns({k: F.col(f"_ahead_{k}") + F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums})
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *sums)


def numbered(rows: DataFrame, order: list[str | Column], name: str, base: int = 0, folder: str | None = None) -> DataFrame:
    """`rows` with their number in the order, from base + 1."""
    return running_sums(rows, order, {name: F.lit(1).cast("long")}, folder).withColumn(name, F.col(name) + base + 1)
