"""Shared helpers: reading tables, size-checked joins, and small column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.storage import fresh_path, scratch, shared_dir, table, writing

__all__ = ["WORD", "checked_broadcast", "fresh_path", "join_facts", "let", "n_words", "read", "scratch", "shared_dir", "table", "text_of", "writing"]

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A word of every contract: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. What the queries return is worked out by the caller, so the size of batches sent to Python is set here, if
    it is the default: large batches of whole texts cost an executor some hundred MB for each task, and change no result."""
    if spark.conf.get(BATCH).rstrip("b") == str(1 << 26):
        spark.conf.set(BATCH, "4m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, also where the body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def checked_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """Hint a broadcast only if a written table has at most `most_rows` rows; larger ones are joined by shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, hot: int = 10_000, most_hot: int = 100_000) -> DataFrame:
    """Inner join of `rows` with a written table that has one row for each key, and in `n` how many rows have that key.

    Keys of more than `hot` rows meet their rows by broadcast, where the rows are; there are at most one in `hot` of them,
    and only up to `most_hot` (counted) are broadcast. All others are shuffled, so that no task gets one key's many rows.
    """
    large = facts.filter(F.col(n) > hot)
    found = large.limit(most_hot + 1).count()
    if not 0 < found <= most_hot:
        return rows.join(facts, keys)
    here = rows.join(F.broadcast(large), keys)
    there = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(facts.filter(F.col(n) <= hot), keys)
    return here.unionByName(there)
