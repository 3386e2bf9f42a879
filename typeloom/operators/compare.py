"""Comparison of runs, concordance counters, interval relations and class tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from typeloom.functions.labels import MISSING_REPORT, is_missing, is_numeric


def compare_runs(left_st: DataFrame, right_st: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Samples of two runs: ST status, and how many loci differ over the union of loci (an absent one is empty)."""
    st = left_st.select("sample_id", F.coalesce(F.trim("st"), F.lit("")).alias("left_st"), F.lit(True).alias("l")).join(right_st.select("sample_id", F.coalesce(F.trim("st"), F.lit("")).alias("right_st"), F.lit(True).alias("r")), "sample_id", "full_outer")
    cells = left.select("sample_id", "locus", F.trim("value").alias("a")).join(right.select("sample_id", "locus", F.trim("value").alias("b")), ["sample_id", "locus"], "full_outer")
    differs = cells.filter(F.coalesce("a", F.lit("")) != F.coalesce("b", F.lit(""))).groupBy("sample_id").agg(F.count("*").alias("n"))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    status = F.when(both, F.when(F.col("left_st") == F.col("right_st"), "same_st").otherwise("different_st")).when(F.col("l").isNotNull(), "left_only").otherwise("right_only")
    return st.join(differs, "sample_id", "left").select("sample_id", F.coalesce("left_st", F.lit("")).alias("left_st"), F.coalesce("right_st", F.lit("")).alias("right_st"), status.alias("status"), F.when(both, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("differing_loci_count"))


def one_row_each(rows: DataFrame, what: str = "sample") -> DataFrame:
    """The rows; a sample that comes twice is an error."""
    twice = rows.groupBy("sample_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.min("sample_id")).first()[0]
    if twice is not None:
        raise ValueError(f"duplicate {what} {twice!r}")
    return rows


def differing_loci(left: DataFrame, right: DataFrame) -> DataFrame:
    """sample_id and its differing loci (locus, left, right) in order, for samples of both runs; an absent locus is empty."""
    cells = left.select("sample_id", "locus", F.trim("value").alias("a")).join(right.select("sample_id", "locus", F.trim("value").alias("b")), ["sample_id", "locus"], "full_outer")
    both = left.select("sample_id").distinct().join(right.select("sample_id").distinct(), "sample_id")
    a, b = F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))
    listed = cells.filter(a != b).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("locus", a.alias("left"), b.alias("right")))).alias("loci"))
    return both.join(listed, "sample_id", "left").select("sample_id", F.coalesce("loci", F.array().cast("array<struct<locus: string, left: string, right: string>>")).alias("loci"))


def compare_summary(compared: DataFrame) -> DataFrame:
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return compared.agg(is_("same_st", "different_st").alias("matched_samples"), is_("same_st").alias("same_st"), is_("different_st").alias("different_st"), F.count_if(F.col("differing_loci_count") > 0).alias("samples_with_locus_differences"), is_("left_only").alias("left_only"), is_("right_only").alias("right_only"))


def gate_mismatches(on_st: DataFrame, off_st: DataFrame, on: DataFrame, off: DataFrame) -> DataFrame:
    """Prefilter on against off: mismatch if ST or any locus differs; a locus of one side only is *missing*."""
    cells = on.select("sample_id", "locus", F.col("value").alias("a")).join(off.select("sample_id", "locus", F.col("value").alias("b")), ["sample_id", "locus"], "full_outer")
    a, b = F.coalesce("a", F.lit("*missing*")), F.coalesce("b", F.lit("*missing*"))
    loci = cells.groupBy("sample_id").agg(F.count_if(a != b).alias("n_loci"))
    st = on_st.select("sample_id", F.col("st").alias("on_st")).join(off_st.select("sample_id", F.col("st").alias("off_st")), "sample_id", "full_outer").join(loci, "sample_id", "left")
    n = F.coalesce("n_loci", F.lit(0))
    return st.select("sample_id", (~F.col("on_st").eqNullSafe(F.col("off_st"))).alias("st_differs"), n.alias("n_loci"), (~F.col("on_st").eqNullSafe(F.col("off_st")) | (n > 0)).alias("mismatch"))


def common_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per sample of both runs, over common loci: compared, and differing ones listed."""
    cells = a.select("sample_id", "locus", F.col("value").alias("va")).join(b.select("sample_id", "locus", F.col("value").alias("vb")), ["sample_id", "locus"])
    return cells.groupBy("sample_id").agg(F.count("*").alias("n_loci"), F.count_if(F.col("va") != F.col("vb")).alias("n_differ"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("va") != F.col("vb"), F.col("locus")))), ",").alias("differ"))


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def report_normal(value):
    """Norm of the concordance report: one leading ~ and one trailing ? go, INF- stays."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^~", ""), r"\?$", "")


def concordance(cells: DataFrame) -> DataFrame:
    """Counters over (query, reference) cells of common loci."""
    q, r = report_normal(F.col("query")), report_normal(F.col("reference"))
    qm, rm = F.upper(q).isin(*MISSING_REPORT), F.upper(r).isin(*MISSING_REPORT)
    qt, rt = F.trim(F.coalesce("query", F.lit(""))), F.trim(F.coalesce("reference", F.lit("")))
    strict, loose = is_numeric(qt) & is_numeric(rt), is_numeric(q) & is_numeric(r)
    n = F.count_if
    return cells.agg(
        F.count("*").alias("common_loci"), n(F.coalesce("query", F.lit("")) == F.coalesce("reference", F.lit(""))).alias("strict_equal"), n(q == r).alias("normalized_equal"),
        n(strict & (qt == rt)).alias("strict_numeric_equal"), n(strict & (qt != rt)).alias("strict_numeric_diff"), n(loose & (q == r)).alias("normalized_numeric_equal"), n(loose & (q != r)).alias("normalized_numeric_diff"),
        n(qm & rm).alias("both_missing"), n(qm & ~rm).alias("query_missing_only"), n(rm & ~qm).alias("reference_missing_only"), n(q != r).alias("normalized_diff_total"),
    )


RELATIONS = ("no_overlap", "overlap_only", "same_start_diff_stop", "same_stop_diff_start", "exact")


def interval_relations(query: DataFrame, reference: DataFrame, width: int = 4096) -> DataFrame:
    """Best relation of each query interval (id, contig, strand, start, end; closed) to the reference's on its contig
    and strand.

    No pair of intervals is made, however deep they lie on each other: equal ends are three joins on distinct keys, and an
    interval meets some other if, of those that begin at its end or before, the furthest end reaches its start. That is a
    running maximum along the contig, within bins of `width` and over the bins' maxima.
    """
    key = ["contig", "strand"]
    r = reference.select(*key, "start", "end").distinct()
    q = query.select("id", *key, "start", "end")
    bin_of = lambda at: F.floor(at / width).alias("bin")
    ends = r.select(*key, bin_of(F.col("start")), F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("end").alias("reach"))
    asks = q.select(*key, bin_of(F.col("end")), F.col("end").alias("at"), F.lit(1).alias("kind"), "id", "start", "end")
    before = W.partitionBy(*key).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = ends.groupBy(*key, "bin").agg(F.max("reach").alias("most")).unionByName(asks.select(*key, "bin", F.lit(None).cast("long").alias("most")).distinct()).groupBy(*key, "bin").agg(F.max("most").alias("most"))
    carried = bins.select(*key, "bin", F.max("most").over(before).alias("carried"))
    inside = W.partitionBy(*key, "bin").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = ends.unionByName(asks, allowMissingColumns=True).withColumn("here", F.max("reach").over(inside)).filter("kind = 1").join(carried, [*key, "bin"])
    seen = seen.select("id", *key, "start", "end", F.coalesce(F.greatest("here", "carried") >= F.col("start"), F.lit(False)).alias("meets"))
    flag = lambda cols, name: r.select(*key, *cols).distinct().withColumn(name, F.lit(True))
    both = seen.join(flag(["start", "end"], "same"), [*key, "start", "end"], "left").join(flag(["end"], "same_end"), [*key, "end"], "left").join(flag(["start"], "same_start"), [*key, "start"], "left")
    level = F.when(F.col("same"), 4).when(F.col("same_end"), 3).when(F.col("same_start"), 2).when(F.col("meets"), 1).otherwise(0)
    best = both.groupBy("id", *key, "start", "end").agg(F.max(level).alias("level"))
    return best.select("id", *key, "start", "end", F.element_at(F.array(*[F.lit(x) for x in RELATIONS]), F.col("level") + 1).alias("relation"))


def normal_strand(value):
    v = F.trim(value.cast("string"))
    return F.when(v.isin("1", "+1", "+"), "+").when(v.isin("-1", "-"), "-").otherwise(v)


def last_reasons(reasons: DataFrame) -> DataFrame:
    """(locus, reason, row_ordinal): the last row of each locus."""
    return reasons.groupBy("locus").agg(F.max_by("reason", "row_ordinal").alias("reason"))


def class_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Labels of two class tables by locus: exact matches and the bucket confusion matrix."""
    from typeloom.functions.labels import label_bucket

    both = a.select("key", F.col("label").alias("la")).join(b.select("key", F.col("label").alias("lb")), "key")
    return both.groupBy(label_bucket(F.col("la")).alias("bucket_a"), label_bucket(F.col("lb")).alias("bucket_b")).agg(F.count("*").alias("n"), F.count_if(F.col("la") == F.col("lb")).alias("same_label"))


def benchmark_metrics(runs: DataFrame) -> DataFrame:
    """(backend, seconds, samples, ok, exact, novel, failed) to averages by backend."""
    return runs.groupBy("backend").agg(F.round(F.avg("seconds"), 6).alias("avg_seconds"), F.round(F.stddev_pop("seconds"), 6).alias("pstdev_seconds"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"), F.sum("exact").alias("exact"), F.sum("novel").alias("novel"), F.sum("failed").alias("failed"))


#: Stages in the order that decides between equally many errors.
STAGES = ("input", "assembly", "prediction", "unknown")


def primary_stage(errors: DataFrame, order: tuple[str, ...] = STAGES) -> DataFrame:
    """The stage of most errors, one row; ties by the fixed order, other stages after them by name; unknown without errors."""
    place = F.coalesce(*[F.when(F.col("stage") == s, i) for i, s in enumerate(order)], F.lit(99))
    counts = errors.groupBy("stage").agg(F.count("*").alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), place.alias("place"), "stage")).alias("b"))
    return best.select(F.coalesce("b.stage", F.lit("unknown")).alias("stage"), F.coalesce(-F.col("b.n"), F.lit(0)).alias("n"))


def multi_copy(hits: DataFrame) -> DataFrame:
    """Copies at identity 90 and coverage 0.5 or more, and exact ones."""
    good = (F.col("identity") >= 90) & (F.col("coverage") >= 0.5)
    return hits.groupBy("sample_id", "locus").agg(F.count_if(good).alias("copies"), F.count_if((F.col("identity") == 100) & (F.col("coverage") >= 1)).alias("exact_copies"))


def missing_summary(long: DataFrame) -> DataFrame:
    return long.groupBy("locus_ordinal").agg(F.count("*").alias("n"), F.count_if(is_missing(F.col("value"))).alias("missing"))
