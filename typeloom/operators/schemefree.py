"""Scheme-free typing: loci from clusters, allele numbers by first appearance, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from typeloom.functions.sequences import fingerprint
from typeloom.operators.ordering import numbered


def dense_numbers(rows: DataFrame, within: list[str], key: str, ordinal: str, name: str, base: int = 0) -> DataFrame:
    """Numbers keys from base + 1 by first appearance, within groups.

    The keys' first ordinals are found by a grouping, and only the distinct keys are ranked: over range partitions if
    they are not within groups.
    """
    first = rows.groupBy(*within, key).agg(F.min(ordinal).alias("first_seen"))
    if not within:
        return numbered(first, ["first_seen", key], name, base)
    return first.withColumn(name, (F.row_number().over(W.partitionBy(*within).orderBy("first_seen", key)) + base).cast("long"))


def cluster_loci(genes: DataFrame, cluster: Column) -> DataFrame:
    """Genes with their locus: clusters numbered by first appearance over all genes."""
    keyed = genes.withColumn("cluster", cluster)
    first = keyed.groupBy("cluster").agg(F.min("gene_ordinal").alias("first_seen"))
    named = numbered(first, ["first_seen", "cluster"], "number").select("cluster", F.concat(F.lit("locus_"), F.col("number").cast("string")).alias("locus"))
    return keyed.join(named, "cluster")


def longest_genes(genes: DataFrame) -> DataFrame:
    """The longest gene of each sample and locus, the first of equals."""
    rank = F.struct((-F.length("seq")).alias("n"), F.col("gene_ordinal").alias("o"))
    return genes.groupBy("sample_id", "locus").agg(F.min_by(F.struct("gene_ordinal", "seq"), rank).alias("g")).select("sample_id", "locus", "g.*")


def number_alleles(genes: DataFrame, strategy: str = "safe") -> DataFrame:
    """Genes with allele_id locus_N, numbered by first appearance of their content within the locus."""
    keyed = genes.withColumn("content", fingerprint(F.col("seq"), strategy))
    numbers = dense_numbers(keyed, ["locus"], "content", "gene_ordinal", "number")
    return keyed.join(numbers.select("locus", "content", "number"), ["locus", "content"]).withColumn("allele_id", F.concat("locus", F.lit("_"), F.col("number").cast("string"))).drop("content")


def sample_profiles(alleles: DataFrame) -> DataFrame:
    """sample_id, profile map and loci_count."""
    return alleles.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("locus", "allele_id")))).alias("profile")).withColumn("loci_count", F.size("profile").cast("long"))


def table_row(profiles: DataFrame, loci: DataFrame) -> DataFrame:
    """Tab-separated rows in the order of locus names; a missing locus is 0, locus_7 is 7."""
    names = loci.agg(F.array_sort(F.collect_set("locus")).alias("loci"))
    cell = lambda l: F.coalesce(F.regexp_extract(F.element_at("profile", l), "([^_]*)$", 1), F.lit("0"))
    return profiles.join(names).select("sample_id", F.array_join(F.transform("loci", cell), "\t").alias("row"))


def hash_stats(alleles: DataFrame) -> DataFrame:
    return alleles.groupBy("locus").agg(F.count("*").alias("total"), F.count_distinct("allele_id").alias("distinct"))
