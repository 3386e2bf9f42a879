"""Refinement passes in their fixed order: each looks at some calls again with hits of a further alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from typeloom.operators.calling import call_loci, fill_loci
from typeloom.operators.refine import confirm_set, keep_better, low_confidence, low_confidence_set, second_pass, within_limit

#: What a mode of core-genome typing over one backend sets; an unknown mode counts as fast.
_KNOBS = ("exact_hash_prefilter", "minimap2_hash_prefilter", "minimap2_hash_locus_top_n", "minimap2_hash_refine_max_loci", "minimap2_fasta_emit_cigar", "minimap2_fasta_speed_profile", "minimap2_representative_main_alignment", "minimap2_bsr_confirm_max_loci", "minimap2_ultrafast_second_pass_max_loci", "evidence_fallback_backend", "evidence_fallback_max_loci")
PRESETS = {
    "fast": (True, True, None, 500, True, "default", False, None, None, "blastn", 500),
    "ultrafast": (True, True, None, 0, False, "ultrafast", True, 120, None, "none", 0),
    "balanced": (True, True, None, 500, True, "default", False, None, None, "blastn", 300),
}


def mode_preset(mode: str, scheme_type: str = "cgmlst", backend: str = "minimap2") -> dict[str, object]:
    """The settings of a mode; other schemes and backends have none (both prefilters off)."""
    if scheme_type != "cgmlst" or backend != "minimap2":
        return dict.fromkeys(_KNOBS) | {"exact_hash_prefilter": False, "minimap2_hash_prefilter": False}
    return dict(zip(_KNOBS, PRESETS.get(mode.strip().lower(), PRESETS["fast"]), strict=True))


def union_hits(base: DataFrame, more: DataFrame) -> DataFrame:
    """Both sets of hits; further ones come after a sample's own."""
    last = base.groupBy("sample_id").agg(F.max("hit_ordinal").alias("last"))
    later = more.join(last, "sample_id", "left").withColumn("hit_ordinal", F.col("hit_ordinal") + F.coalesce("last", F.lit(-1)) + 1).drop("last")
    return base.unionByName(later, allowMissingColumns=True)


def only(hits: DataFrame, chosen: DataFrame) -> DataFrame:
    return hits.join(chosen.select("sample_id", "locus"), ["sample_id", "locus"], "left_semi")


def recheck(calls: DataFrame, chosen: DataFrame, hits: DataFrame) -> DataFrame:
    """`calls` with the chosen ones replaced where the other hits give a better one."""
    return keep_better(calls, call_loci(only(hits, chosen)).select(*calls.columns))


def missing_pass(base: DataFrame, more: DataFrame, samples: DataFrame, loci: DataFrame, limit: int) -> DataFrame:
    """R1: samples with missing loci, `limit` at most (0 or less: no sample), get further hits of these loci, and all their
    loci are called anew."""
    calls = fill_loci(call_loci(base), samples, loci)
    chosen = within_limit(calls.filter("call_type = 'missing'"), limit, unlimited_at_zero=False)
    return fill_loci(call_loci(union_hits(base, only(more, chosen))), samples, loci)


def strict_pass(calls: DataFrame, hits: DataFrame, limit: int = 64) -> DataFrame:
    """R2: closest calls, poorest first."""
    return recheck(calls, confirm_set(calls, limit), hits)


def low_confidence_pass(calls: DataFrame, hits: DataFrame, limit: int = 120, ultrafast: bool = False) -> DataFrame:
    """R3: calls of low confidence, poorest first (ultrafast: partial ones first, best hits first)."""
    return recheck(calls, ultrafast_set(calls, limit) if ultrafast else low_confidence_set(calls, limit), hits)


def budget_pass(calls: DataFrame, hits: DataFrame, budget: int | None = None) -> DataFrame:
    """R4: partial and closest calls within a budget, by default one that grows with their number."""
    return recheck(calls, second_pass(calls, budget), hits)


def fallback_pass(calls: DataFrame, hits: DataFrame, limit: int = 500) -> DataFrame:
    """R5: all calls of low confidence of samples that have `limit` at most (0 or less: no limit)."""
    return recheck(calls, within_limit(calls.filter(low_confidence()), limit), hits)


def ultrafast_order() -> list[Column]:
    """Partial, closest, novel, missing, exact; then identity, coverage and confidence, best first."""
    kind = F.lit(5)
    for i, name in enumerate(("partial", "closest", "novel", "missing", "exact")):
        kind = F.when(F.col("call_type") == name, i).otherwise(kind)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return [kind, -zero("identity"), -zero("coverage"), -F.col("confidence"), F.col("locus")]


def ultrafast_set(calls: DataFrame, limit: int = 120) -> DataFrame:
    w = W.partitionBy("sample_id").orderBy(*ultrafast_order())
    return calls.filter(low_confidence()).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)
