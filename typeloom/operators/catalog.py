"""Scheme catalogues: filters, names, precedence, change detection; sample and file resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Scheme kinds of the filter "all", keyword cascades of the classifier, and file suffixes in the order they are tried.
SCHEME_TYPES = ("mlst", "cgmlst", "wgmlst", "rmlst")
OTHER_WORDS = ("pgmlst", "agmlst", "vmlst", "pmlst", "virulence", "resistance", "antimicrobial", "antibiotic", "pathogenicity", "plasmid mlst", "genoser")
TYPE_WORDS = (("wgmlst", ("wgmlst", "whole genome mlst", "whole-genome")), ("cgmlst", ("cgmlst", "core genome mlst", "core-genome")), ("mlst", ("mlst",)))
SUFFIXES = ("", ".fasta", ".fa", ".fna", ".ffn", ".frn", ".fastq", ".fq", ".fasta.gz", ".fa.gz", ".fna.gz", ".fastq.gz", ".fq.gz")


def scheme_type(description: Column) -> Column:
    d = F.lower(F.coalesce(description, F.lit("")))
    any_of = lambda words: F.array_contains(F.array(*[d.contains(w) for w in words]), True)
    kind = F.when(any_of(OTHER_WORDS), "other")
    for name, words in TYPE_WORDS:
        kind = kind.when(any_of(words), name)
    return kind.otherwise("other")


def base_name(organism: Column) -> Column:
    """lmonocytogenes for Listeria monocytogenes; the genus alone for spp. and for a second word with a slash."""
    o = F.lower(F.trim(F.coalesce(organism, F.lit(""))))
    w = F.split(o, r"\s+")
    spp = o.contains(" spp.") | o.contains(" sp.") | o.endswith(" spp") | o.endswith(" sp")
    return F.when(o == "", "unknown").when(spp | (F.size(w) < 2), w[0]).when(w[1].contains("/"), w[0]).otherwise(F.concat(F.substring(w[0], 1, 1), w[1]))


def filter_catalog(catalog: DataFrame, provider: str | None = None, kind: str = "all", blocked: DataFrame | None = None) -> DataFrame:
    out = catalog.filter(F.col("provider") == provider) if provider else catalog
    out = out.filter(F.col("scheme_type").isin(*SCHEME_TYPES) if kind == "all" else F.col("scheme_type") == kind)
    if blocked is not None:
        out = out.join(blocked, out["scheme_name"] == blocked["name"], "left_anti").join(blocked, out["directory"] == blocked["name"], "left_anti")
    return out


def search_catalog(catalog: DataFrame, text: str) -> DataFrame:
    t = text.lower()
    hit = F.lit(False)
    for c in ("scheme_name", "organism", "display_name", "provider"):
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False))
    return catalog.filter(hit)


def organism_like(catalog: DataFrame, pattern: str, downloaded: DataFrame | None = None) -> DataFrame:
    """Schemes whose organism matches, letters in either case; of those `downloaded` (scheme_name, provider) only, if given."""
    out = catalog.filter(F.col("organism").rlike(f"(?i){pattern}"))
    return out if downloaded is None else out.join(downloaded.select("scheme_name", "provider").distinct(), ["scheme_name", "provider"], "left_semi")


def reject_blocked(scheme: str, provider: str, directory: str, blocked: DataFrame) -> None:
    """An error if the scheme or its directory is among the provider's blocked names (provider, name)."""
    if blocked.filter((F.col("provider") == provider) & F.col("name").isin(scheme, directory)).limit(1).count():
        raise ValueError(f"scheme {scheme!r} is blocked for provider {provider!r}")


def natural_order(name: Column, downloaded: Column) -> list[Column]:
    """Downloaded first, then base name, then the number after the last underscore."""
    return [~downloaded, F.lower(F.regexp_extract(name, r"^(.*?)(?:_\d+)?$", 1)), F.coalesce(F.regexp_extract(name, r"_(\d+)$", 1).try_cast("bigint"), F.lit(0)), name]


def max_suffix(names: DataFrame) -> DataFrame:
    """Largest numeric suffix of each base name."""
    return names.select(F.regexp_extract("scheme_name", r"^(.*?)_(\d+)$", 1).alias("base"), F.regexp_extract("scheme_name", r"_(\d+)$", 1).try_cast("bigint").alias("n")).filter("base <> ''").groupBy("base").agg(F.max("n").alias("last"))


def rename_schemes(catalog: DataFrame, others: DataFrame, blocked: DataFrame) -> DataFrame:
    """Names base_N: blocked rows go first, then numbers by base in order of the organism's and the row's first sight,
    beyond the largest number other providers use for the base."""
    rows = catalog.join(blocked, catalog["scheme_name"] == blocked["name"], "left_anti").withColumn("base", base_name(F.col("organism")))
    seen = W.partitionBy("base", "organism")
    rows = rows.withColumn("seen", F.min("row_ordinal").over(seen))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("base").orderBy("seen", "row_ordinal"))).join(max_suffix(others), "base", "left")
    return rows.select("row_ordinal", "organism", F.concat("base", F.lit("_"), (F.col("k") + F.coalesce("last", F.lit(0))).cast("string")).alias("scheme_name"))


def by_precedence(candidates: DataFrame, key: str, precedence: str) -> DataFrame:
    """The candidate of least precedence for each key."""
    w = W.partitionBy(key).orderBy(precedence, *[c for c in candidates.columns if c not in (key, precedence)])
    return candidates.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def changed(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys added, removed or with a changed field."""
    a = old.select(key, *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("in_old"))
    b = new.select(key, *fields, F.lit(True).alias("in_new"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"old_{f}"))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~same, "changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).filter("status is not null")


def resolve_files(samples: DataFrame, files: DataFrame) -> DataFrame:
    """sample_id to the file sample_id + suffix of the first suffix that exists; unresolved ones have a null path."""
    tried = samples.select("sample_id", F.posexplode(F.array(*[F.lit(s) for s in SUFFIXES])).alias("place", "suffix"))
    found = tried.join(files, F.concat("sample_id", "suffix") == F.col("name")).groupBy("sample_id").agg(F.min_by("name", "place").alias("path"))
    return samples.select("sample_id").join(found, "sample_id", "left")
