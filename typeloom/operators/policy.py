"""Surveillance classes of calls: joins of calls with allele lengths, digests and coding sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.functions.labels import chew_class, edge_class, size_class
from typeloom.functions.sequences import digest, upper_letters


def length_stats(alleles: DataFrame) -> DataFrame:
    """Least, most common (ties: smallest) and greatest allele length of each locus."""
    n = F.length("seq")
    return alleles.groupBy("locus").agg(F.min(n).cast("long").alias("min_len"), F.mode(n, True).cast("long").alias("mode_len"), F.max(n).cast("long").alias("max_len"))


def allele_stats(alleles: DataFrame) -> DataFrame:
    n = F.length("seq")
    return alleles.groupBy("locus").agg(F.count("*").alias("n"), F.min(n).cast("long").alias("min_len"), F.max(n).cast("long").alias("max_len"), F.bround(F.avg(n)).cast("long").alias("mean_len"))


def gate(calls: DataFrame, alleles: DataFrame, cds: DataFrame) -> DataFrame:
    """Calls with gate_passes: the called allele's digest is among the sample's coding sequences."""
    known = alleles.select("locus", "allele_id", digest(F.col("seq")).alias("digest"))
    own = cds.select("sample_id", digest(F.col("seq")).alias("digest")).distinct().withColumn("gate_passes", F.lit(True))
    joined = calls.join(known, ["locus", "allele_id"], "left").join(own, ["sample_id", "digest"], "left")
    return joined.withColumn("gate_passes", F.coalesce("gate_passes", F.lit(False))).drop("digest")


def contained(calls: DataFrame, alleles: DataFrame, cds: DataFrame) -> DataFrame:
    """Calls whose allele holds, or is held by, a coding sequence of the sample (substring test within the sample, letter by
    letter without case). A row for each call, also where alleles repeat or the sample has no name."""
    with_seq = calls.select("sample_id", "locus", "allele_id").join(alleles.select("locus", "allele_id", upper_letters(F.col("seq")).alias("a")).distinct(), ["locus", "allele_id"])
    own = cds.select("sample_id", upper_letters(F.col("seq")).alias("c"))
    same = F.col("x.sample_id").eqNullSafe(F.col("y.sample_id"))
    near = same & ((F.instr(F.col("a"), F.col("c")) > 0) | (F.instr(F.col("c"), F.col("a")) > 0))
    return with_seq.alias("x").join(own.alias("y"), near, "left_semi").select("sample_id", "locus", "allele_id").distinct()


def classify(calls: DataFrame, stats: DataFrame, enforce_gate: bool = False) -> DataFrame:
    """Class of each call; `calls` has the match coordinates, and gate_passes and substring if the gate is enforced."""
    edge = edge_class(*[F.col(c) for c in ("contig_length", "q_start", "q_end", "strand", "allele_length", "a_start", "a_end")])
    length = F.coalesce("allele_length", F.length("novel_sequence"))
    fails = ~F.col("gate_passes") if enforce_gate else F.lit(False)
    substring = F.coalesce("substring", F.lit(False)) if enforce_gate else F.lit(False)
    label = chew_class(F.col("call_type"), F.col("allele_id"), F.col("multiple_hits"), fails, substring, edge, size_class(length, F.col("mode_len")))
    return calls.join(stats.select("locus", "mode_len"), "locus", "left").withColumn("label", label).drop("mode_len")
