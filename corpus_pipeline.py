"""The corpus pipeline: five stages, each written as Parquet in the shared folder and read again by the next.

Every stage takes any table of documents. Null and empty texts fail the quality rules, so nothing after them sees any;
rows that repeat each other are one group of near copies, of which one stays; a null doc_id or source is kept like any
other; an empty table goes through all stages and gives no sequences; extra columns, whatever their names, pass through
all stages but the last. A document that the mix takes more than once comes as often to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from typeloom.llm import decontam, mixing, ngram_join, quality, token_order
from typeloom.llm.common import read, scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_first(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by training position."""
    return mixing.curriculum(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus as shards of token ids; a row for each sequence."""
    return token_order.training_order(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_distinct), ("decontaminate", keep_uncontaminated), ("mix", mix_sources), ("tokens", write_tokens)]

#: Trained models, tokenizers and approximate search are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with scratch(spark, "stages") as folder:
        for name, stage in STAGES[:-1]:
            docs = table(stage(spark, docs, sf_dir), name, folder)
        return table(STAGES[-1][1](spark, docs, sf_dir), "sequences")
