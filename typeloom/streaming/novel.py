"""Novel alleles from a stream: each micro-batch continues the numbering of the batches before it.

The table has one folder for each batch, so a batch that runs again writes the same rows over its own: it reads only the
batches below its number. An allele seen again keeps its id; its row then holds the samples that the batch adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from typeloom.functions.sequences import normalise_sequence
from typeloom.operators.novel import novel_alleles

ROWS = "locus string, allele_id string, seq string, samples array<string>"


def written(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """locus, allele_id, seq, samples (each once, in order of first sight) over all batches, or those below a number."""
    rows = spark.read.schema(f"{ROWS}, batch int").parquet(path)
    rows = rows if below is None else rows.filter(F.col("batch") < below)
    seen = rows.groupBy("locus", "allele_id", "seq").agg(F.array_sort(F.collect_list(F.struct("batch", "samples"))).alias("s"))
    return seen.select("locus", "allele_id", "seq", F.array_distinct(F.flatten(F.transform("s", lambda x: x["samples"]))).alias("samples"))


def write_batch(found: DataFrame, number: int, path: str) -> None:
    """Writes the alleles of one batch of (locus, sample, seq, ordinal); the first batch has number 0."""
    rows = found.withColumn("seq", normalise_sequence(F.col("seq")))
    if number == 0:
        out = novel_alleles(rows)
    else:
        known = written(found.sparkSession, path, below=number)
        ids = known.select("locus", "seq", "allele_id")
        again = rows.join(ids, ["locus", "seq"]).groupBy("locus", "allele_id", "seq", "sample").agg(F.min("ordinal").alias("o")).groupBy("locus", "allele_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "sample"))), lambda x: x["sample"]).alias("samples"))
        new = novel_alleles(rows.join(ids.select("locus", "seq"), ["locus", "seq"], "left_anti"), known)
        out = new.unionByName(again)
    out.write.mode("overwrite").parquet(f"{path}/batch={number}")


def follow(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over a stream of (locus, sample, seq, ordinal) with the available data; known sequences keep their numbers."""
    return found.writeStream.foreachBatch(lambda rows, number: write_batch(rows, number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
