"""Novel alleles and profiles: numbering, extraction, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.functions.sequences import normalise_sequence
from typeloom.operators.schemefree import dense_numbers


def novel_alleles(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(locus, sample, seq, ordinal) to one row for each novel allele: nK by first appearance (after those known), the
    sequence, and its samples in order of first sight. A repeated allele keeps its number."""
    rows = found.withColumn("seq", normalise_sequence(F.col("seq"))).withColumn("key", F.substring(F.md5("seq"), 1, 16))
    samples = rows.groupBy("locus", "key", "sample").agg(F.min("ordinal").alias("o"), F.min("seq").alias("seq"))
    alleles = samples.groupBy("locus", "key").agg(F.min("seq").alias("seq"), F.min("o").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("o", "sample"))), lambda x: x["sample"]).alias("samples"))
    numbers = dense_numbers(rows, ["locus"], "key", "ordinal", "number").select("locus", "key", "number")
    out = alleles.join(numbers, ["locus", "key"])
    base = F.lit(0)
    if known is not None:
        out = out.join(last_numbers(known), "locus", "left")
        base = F.coalesce("last", F.lit(0))
    return out.select("locus", F.concat(F.lit("n"), (F.col("number") + base).cast("string")).alias("allele_id"), "seq", "samples")


def last_numbers(alleles: DataFrame) -> DataFrame:
    """Last number of each locus: the largest integer after n."""
    return alleles.groupBy("locus").agg(F.max(F.substring("allele_id", 2, 20).try_cast("bigint")).alias("last"))


def complete_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.filter(F.forall("profile", lambda x: x.isNotNull() & ~x.isin("-", "")))


def novel_profiles(profiles: DataFrame, base: int = 0) -> DataFrame:
    """Complete profiles with ST NK by first appearance."""
    keyed = complete_profiles(profiles).withColumn("key", F.array_join("profile", "|"))
    numbers = dense_numbers(keyed, [], "key", "ordinal", "number", base)
    return keyed.join(numbers.select("key", "number"), "key").select("sample", "profile", F.concat(F.lit("N"), F.col("number").cast("string")).alias("st"))


def with_sequences(calls: DataFrame, alleles: DataFrame) -> DataFrame:
    """Calls with their sequence: the novel one, else that of the first allele with the id."""
    first = alleles.groupBy("locus", "allele_id").agg(F.min_by("seq", "allele_ordinal").alias("seq"))
    return calls.join(first, ["locus", "allele_id"], "left").withColumn("seq", F.coalesce("novel_sequence", "seq"))


def unknown_loci(novel: DataFrame, loci: DataFrame) -> DataFrame:
    return novel.select("locus").distinct().join(loci.select("locus").distinct(), "locus", "left_anti")


def remap_alleles(profiles: DataFrame, mapping: DataFrame) -> DataFrame:
    """(sample, locus, allele_id) with ids renamed by (locus, old_id, new_id)."""
    return profiles.join(mapping, (profiles["locus"] == mapping["locus"]) & (profiles["allele_id"] == mapping["old_id"]), "left").select(profiles["sample"], profiles["locus"], F.coalesce("new_id", profiles["allele_id"]).alias("allele_id"))
