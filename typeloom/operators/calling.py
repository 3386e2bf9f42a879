"""Allele calling: best hits, locus calls, filling of missing loci, sequence types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.labels import call_type, confidence

MIN_IDENTITY, MIN_COVERAGE, MIN_DEPTH = 95.0, 0.95, 10.0


def passes(min_identity: float = MIN_IDENTITY, min_coverage: float = MIN_COVERAGE, min_depth: float = MIN_DEPTH) -> Column:
    """Hits over the thresholds; an unknown depth passes."""
    return (F.col("identity") >= min_identity) & (F.col("coverage") >= min_coverage) & (F.col("depth").isNull() | (F.col("depth") >= min_depth))


def best_hits(hits: DataFrame) -> DataFrame:
    """One hit for each (sample, locus, allele): most identity, then coverage, then the first; first_ordinal keeps the order."""
    rank = F.struct((-F.col("identity")).alias("i"), (-F.col("coverage")).alias("c"), F.col("hit_ordinal").alias("o"))
    rest = F.struct(*[c for c in hits.columns if c not in ("sample_id", "locus", "allele_id")])
    best = hits.groupBy("sample_id", "locus", "allele_id").agg(F.min_by(rest, rank).alias("h"), F.min("hit_ordinal").alias("first_ordinal"))
    return best.select("sample_id", "locus", "allele_id", "h.*", "first_ordinal")


def copy_counts(hits: DataFrame) -> DataFrame:
    """Distinct placements (contig and the ordered ends) of each allele, at least one."""
    place = F.struct("query_contig", F.least("query_start", "query_end").alias("a"), F.greatest("query_start", "query_end").alias("b"))
    return hits.groupBy("sample_id", "locus", "allele_id").agg(F.greatest(F.lit(1), F.count_distinct(place)).cast("long").alias("copy_count"))


def _rank() -> Column:
    """Best first: score, coverage, identity, depth (unknown as 0), then input order."""
    return F.struct((-F.col("score")).alias("s"), (-F.col("coverage")).alias("c"), (-F.col("identity")).alias("i"), (-F.coalesce("depth", F.lit(0.0))).alias("d"), F.col("hit_ordinal").alias("o"), F.col("allele_id").alias("a"))


def call_loci(hits: DataFrame, min_identity: float = MIN_IDENTITY, min_coverage: float = MIN_COVERAGE, min_depth: float = MIN_DEPTH) -> DataFrame:
    """A call for each (sample, locus) with hits.

    Among hits over the thresholds the best is called; distinct alleles of exact ones are listed in rank order, two or
    more are multiple_hits. Without any, the best of all hits is partial if some coverage reaches half the threshold,
    else the locus is missing. Hits are grouped by allele first, both groupings have map-side partial results, and the list
    that is kept for a locus is of distinct alleles only; no window over raw hits.
    """
    valid = passes(min_identity, min_coverage, min_depth)
    exact = valid & (F.col("identity") == 100) & (F.col("coverage") >= 1)
    fields = [c for c in ("allele_id", "identity", "coverage", "depth", "score", "copy_count", "sequence") if c in hits.columns]
    row = F.struct(*fields)
    rank = _rank()
    by_allele = hits.groupBy("sample_id", "locus", F.col("allele_id").alias("a")).agg(
        F.min(F.when(valid, F.struct(rank.alias("r"), row.alias("h")))).alias("valid"),
        F.min(F.struct(rank.alias("r"), row.alias("h"))).alias("any"),
        F.min(F.when(exact, rank)).alias("exact"),
        F.max("coverage").alias("coverage"),
    )
    grouped = by_allele.groupBy("sample_id", "locus").agg(
        F.min("valid")["h"].alias("best_valid"),
        F.min("any")["h"].alias("best_any"),
        F.max("coverage").alias("most_coverage"),
        F.array_sort(F.collect_list(F.when(F.col("exact").isNotNull(), F.struct(F.col("exact").alias("r"), "a")))).alias("exact"),
    )
    ids = F.transform("exact", lambda x: x["a"])
    b = F.coalesce("best_valid", F.when(F.col("most_coverage") >= 0.5 * min_coverage, F.col("best_any")))
    out = grouped.select("sample_id", "locus", b.alias("b"), F.col("best_valid").isNotNull().alias("ok"), ids.alias("ids"))
    kind = call_type(F.col("b.identity"), F.col("b.coverage"))
    kind = F.when((kind == "closest") & (F.col("b.identity") == 100) & (F.col("b.coverage") < 1), "partial").otherwise(kind)
    kind = F.when(F.col("b").isNull(), "missing").when(~F.col("ok"), "partial").otherwise(kind)
    listed = F.when(F.col("b").isNull(), F.array().cast("array<string>")).when(~F.col("ok"), F.array("b.allele_id")).otherwise(F.col("ids"))
    conf = F.when(F.col("b").isNull(), 0.0).otherwise(confidence(F.col("b.identity"), F.col("b.coverage"), F.col("b.depth")))
    copies = F.coalesce("b.copy_count", F.lit(1)) if "copy_count" in fields else F.lit(1)
    novel = F.when(kind == "novel", F.replace(F.col("b.sequence"), F.lit("-"), F.lit(""))) if "sequence" in fields else F.lit(None).cast("string")
    return out.select("sample_id", "locus", F.col("b.allele_id").alias("allele_id"), kind.alias("call_type"), conf.alias("confidence"), F.col("b.identity").alias("identity"), F.col("b.coverage").alias("coverage"), (F.col("ok") & (F.size("ids") > 1)).alias("multiple_hits"), listed.alias("allele_ids"), copies.cast("long").alias("copy_count"), novel.alias("novel_sequence"))


def fill_loci(calls: DataFrame, samples: DataFrame, loci: DataFrame) -> DataFrame:
    """A call for every sample and every locus of the scheme; loci without hits are missing.

    The scheme's loci are laid beside each sample as one array, so no row of the samples is shuffled for it.
    """
    names = loci.agg(F.array_sort(F.collect_set("locus")).alias("loci"))
    grid = samples.select("sample_id").distinct().join(names).select("sample_id", F.explode("loci").alias("locus"))
    filled = grid.join(calls, ["sample_id", "locus"], "left")
    return filled.withColumns({"call_type": F.coalesce("call_type", F.lit("missing")), "confidence": F.coalesce("confidence", F.lit(0.0)), "multiple_hits": F.coalesce("multiple_hits", F.lit(False)), "allele_ids": F.coalesce("allele_ids", F.array().cast("array<string>")), "copy_count": F.coalesce("copy_count", F.lit(1).cast("long"))})


def profile_keys(calls: DataFrame) -> DataFrame:
    """sample_id, profile (alleles by locus, missing as -), and whether a locus has several exact alleles or isn't exact."""
    pair = F.struct("locus", F.coalesce("allele_id", F.lit("-")).alias("v"))
    grouped = calls.groupBy("sample_id").agg(F.array_sort(F.collect_list(pair)).alias("p"), F.bool_or("multiple_hits").alias("conflicting"), F.bool_or(F.col("call_type") != "exact").alias("inexact"))
    return grouped.select("sample_id", F.transform("p", lambda x: x["v"]).alias("profile"), "conflicting", "inexact")


def sequence_types(calls: DataFrame, profiles: DataFrame) -> DataFrame:
    """ST of each sample by its whole profile; null without a match, or if a locus has several exact alleles.

    - is a value like any other, so a missing locus can match a profile that has it. Wide keys are compared by digest.
    """
    keyed = profile_keys(calls).withColumn("key", F.md5(F.concat_ws("|", "profile")))
    known = profiles.select(F.md5(F.concat_ws("|", "profile")).alias("key"), "st")
    return keyed.join(known, "key", "left").select("sample_id", F.when(~F.col("conflicting"), F.col("st")).alias("st"), "profile", "conflicting", "inexact")


def last_profiles(rows: DataFrame, loci: list[str]) -> DataFrame:
    """Profiles of a wide table (ST, one column for each locus, row_ordinal): ST must be an integer, no locus empty, and the last row of a key wins."""
    good = F.col("ST").try_cast("int").isNotNull()
    for c in loci:
        good = good & (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    keyed = rows.filter(good).select(F.array(*[F.trim(F.col(c)) for c in loci]).alias("profile"), F.col("ST").try_cast("int").alias("st"), "row_ordinal")
    return keyed.groupBy("profile").agg(F.max_by("st", "row_ordinal").alias("st"))


def failed_loci(loci: DataFrame, hits: DataFrame) -> DataFrame:
    """Loci of the scheme without any hit."""
    return loci.select("locus").distinct().join(hits.select("locus").distinct(), "locus", "left_anti")


def overall_confidence(calls: DataFrame) -> DataFrame:
    """Geometric mean over loci; missing counts 0, partial half."""
    c = F.when(F.col("call_type") == "missing", 0.0).when(F.col("call_type") == "partial", 0.5 * F.col("confidence")).otherwise(F.col("confidence"))
    return calls.groupBy("sample_id").agg(F.pow(F.product(c), 1.0 / F.count("*")).alias("overall_confidence"))
