"""Named queries over the model, each with its SQL. A section's comment gives the operators it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions import labels as L
from typeloom.functions import names as N
from typeloom.functions import profiles as P
from typeloom.functions import sequences as S
from typeloom.operators import calling, catalog, compare, graph, matrix, novel, policy, prefilter, refine, schemefree
from typeloom.operators.ordering import numbered
from typeloom.plans import model as M
from typeloom.plans.registry import QUERIES, SQL, query
from typeloom.storage import table

__all__ = ["QUERIES", "SQL"]


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return calling.call_loci(M.hits(spark, d))


def _filled(spark: SparkSession, d: str) -> DataFrame:
    h = M.hits(spark, d)
    return calling.fill_loci(calling.call_loci(h), h, h)


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    filled = table(_filled(spark, d), "filled")
    keyed = calling.profile_keys(filled)
    return filled, keyed.groupBy("profile").agg(F.min("sample_id").alias("st"), F.count("*").alias("n")).filter("n > 1").drop("n")  # the scheme knows profiles of two samples or more


CALL_COLUMNS = "sample_id, locus, allele_id, call_type, round(confidence, 9) as confidence, multiple_hits, allele_ids"


# --- calling: A1-A4, P1-P3, W1, F13, J3, S10, P19, U4 ---
@query(f"with {M.HITS} select sample_id, locus, allele_id, identity, coverage, hit_ordinal from (select *, row_number() over (partition by sample_id, locus, allele_id order by identity desc, coverage desc, hit_ordinal) as r from hits) where r = 1")
def a1_best_hits(spark, d):
    return calling.best_hits(M.hits(spark, d)).select("sample_id", "locus", "allele_id", "identity", "coverage", "hit_ordinal")


@query(f"with {M.HITS} select sample_id, locus, allele_id, greatest(1, count(distinct query_contig || ':' || least(query_start, query_end) || ':' || greatest(query_start, query_end)))::bigint as copy_count from hits group by all")
def a2_copy_counts(spark, d):
    return calling.copy_counts(M.hits(spark, d))


@query(f"with {M.CALLS} select {CALL_COLUMNS} from calls")
def a3_locus_calls(spark, d):
    return _calls(spark, d).select("sample_id", "locus", "allele_id", "call_type", F.round("confidence", 9).alias("confidence"), "multiple_hits", F.array_join("allele_ids", ",").alias("allele_ids"))


@query(f"with {M.FILLED} select {CALL_COLUMNS} from filled")
def a4_all_loci(spark, d):
    return _filled(spark, d).select("sample_id", "locus", "allele_id", "call_type", F.round("confidence", 9).alias("confidence"), "multiple_hits", F.array_join("allele_ids", ",").alias("allele_ids"))


@query(f"with {M.KEYS} select k.sample_id, case when not conflicting then p.st end as st, k.profile, conflicting, inexact from keyed k left join profiles p on k.profile = p.profile")
def j3_sequence_types(spark, d):
    filled, profiles = _keys(spark, d)
    return calling.sequence_types(filled, profiles).withColumn("profile", F.array_join("profile", "|"))


@query(f"""with {M.KEYS}, cells as (select *, case when allele_id is null or call_type = 'missing' then '-' when multiple_hits then (select string_agg(x, ',' order by try_cast(x as int)) from unnest(string_split(allele_ids, ',')) t(x))
 when call_type = 'exact' then allele_id when call_type in ('closest', 'novel') then '~' || allele_id else allele_id || '?' end as cell from filled)
select 'sample' || c.sample_id || chr(9) || 'demo' || chr(9) || max(case when conflicting or inexact or p.st is null then '-' else p.st::varchar end) || chr(9) || string_agg(cell, chr(9) order by locus) as line
from cells c join keyed k on c.sample_id = k.sample_id left join profiles p on p.profile = k.profile group by c.sample_id""")
def k1_typing_rows(spark, d):
    from typeloom.sinks.tables import typing_rows

    filled, profiles = _keys(spark, d)
    st = calling.sequence_types(filled, profiles)
    return typing_rows(filled.withColumn("sample_id", F.concat(F.lit("sample"), F.col("sample_id").cast("string"))), st.withColumn("sample_id", F.concat(F.lit("sample"), F.col("sample_id").cast("string"))), "demo")


@query("with w as (select p_partkey, p_partkey % 11 as a, p_partkey % 3 as b, case when p_partkey % 5 = 0 then 'x' else (p_partkey % 40)::varchar end as st from part) select profile, st from (select (a || '|' || b) as profile, try_cast(st as int) as st, row_number() over (partition by a, b order by p_partkey desc) as r from w where try_cast(st as int) is not null) where r = 1")
def s10_last_profiles(spark, d):
    p = M.read(spark, d, "part")
    st = F.when(F.col("p_partkey") % 5 == 0, "x").otherwise((F.col("p_partkey") % 40).cast("string"))
    rows = p.select(st.alias("ST"), (F.col("p_partkey") % 11).cast("string").alias("a"), (F.col("p_partkey") % 3).cast("string").alias("b"), F.col("p_partkey").alias("row_ordinal"))
    return calling.last_profiles(rows, ["a", "b"]).select(F.array_join("profile", "|").alias("profile"), "st")


@query(f"with {M.FILLED} select sample_id, round(pow(product(case when call_type = 'missing' then 0.0::double when call_type = 'partial' then 0.5::double * confidence else confidence end), 1.0::double / count(*)), 9) as overall_confidence from filled group by 1")
def a10_overall_confidence(spark, d):
    return calling.overall_confidence(_filled(spark, d)).withColumn("overall_confidence", F.round("overall_confidence", 9))


@query(f"with {M.HITS} select l.locus from (select distinct 'L' || (l_linenumber + 1) as locus from lineitem) l where l.locus not in (select locus from hits)")
def u4_failed_loci(spark, d):
    loci = M.read(spark, d, "lineitem").select(F.concat(F.lit("L"), (F.col("l_linenumber") + 1).cast("string")).alias("locus"))
    return calling.failed_loci(loci, M.hits(spark, d))


# --- refinement: P4, P5, O1-O4, U3, R1-R5 ---
_RANK = "case call_type when 'exact' then 5 when 'closest' then 4 when 'novel' then 3 when 'partial' then 2 else 1 end"


@query(f"with {M.FILLED} select sample_id, locus from filled where coalesce(multiple_hits or call_type in ('novel', 'partial', 'missing') or (identity is not null and (identity < 98 or coverage < 0.98::double)), false)")
def p4_low_confidence(spark, d):
    return _filled(spark, d).filter(refine.low_confidence()).select("sample_id", "locus")


@query(f"with {M.FILLED} select sample_id, locus, place from (select *, row_number() over (partition by sample_id order by {_RANK}, confidence, locus) as place from filled where call_type = 'closest') where place <= 2")
def o1_confirm_set(spark, d):
    return refine.confirm_set(_filled(spark, d), 2).select("sample_id", "locus", F.col("place").cast("long").alias("place"))


@query(f"with {M.FILLED} select sample_id, locus, place from (select *, row_number() over (partition by sample_id order by identity desc, coverage desc, confidence desc, locus) as place from filled where call_type in ('partial', 'closest')) where place <= 3")
def o3_second_pass(spark, d):
    return refine.second_pass(_filled(spark, d), 3).select("sample_id", "locus", F.col("place").cast("long").alias("place"))


@query(f"""with {M.FILLED.replace(" as (", " as materialized (")}, r as materialized (select *, {_RANK} as p from filled), o as materialized (select sample_id, case when locus = 'L7' then 'L1' else 'L' || (substr(locus, 2)::int + 1) end as locus, allele_id, call_type, confidence, p from r)
select b.sample_id, b.locus, case when (o.p, o.confidence) > (b.p, b.confidence) then o.allele_id else b.allele_id end as allele_id, case when (o.p, o.confidence) > (b.p, b.confidence) then o.call_type else b.call_type end as call_type
from r b join o on b.sample_id = o.sample_id and b.locus = o.locus""")
def u3_keep_better(spark, d):
    base = table(_filled(spark, d), "filled")
    n = F.substring("locus", 2, 9).cast("int")
    other = base.withColumn("locus", F.when(n == 7, "L1").otherwise(F.concat(F.lit("L"), (n + 1).cast("string"))))
    return refine.keep_better(base, other).select("sample_id", "locus", "allele_id", "call_type")


@query(f"with {M.FILLED} select sample_id, locus from (select *, count(*) over (partition by sample_id) as n from filled where call_type = 'missing') where n <= 3")
def r1_missing_within_limit(spark, d):
    return refine.within_limit(_filled(spark, d).filter("call_type = 'missing'"), 3).select("sample_id", "locus")


@query(f"with {M.CALLS} select count(distinct locus) as n_loci, count(distinct locus) >= 6 as confident from calls where call_type = 'exact'")
def p5_prefilter_confidence(spark, d):
    return refine.prefilter_is_confident(_calls(spark, d).filter("call_type = 'exact'"), 20, 0.3)


# --- pre-resolution: F3-F6, J1, J2, A6, W2, W3, P6, A21 ---
@query("""with idx as (select distinct sha256(upper(text)) as digest, 'l' || n_chars % 97 as locus, n_chars::varchar as allele_id from documents), cds as (select distinct source as sample_id, sha256(upper(text)) as digest from documents)
select sample_id, locus, min(allele_id) as allele_id, 100.0::double as identity, 1.0::double as coverage, 100.0::double as score from cds join idx using (digest) group by sample_id, locus having count(distinct allele_id) = 1""")
def j1_exact_hash(spark, d):
    docs = M.read(spark, d, "documents")
    alleles = docs.select(F.concat(F.lit("l"), (F.col("n_chars") % 97).cast("string")).alias("locus"), F.col("n_chars").cast("string").alias("allele_id"), F.col("text").alias("seq"))
    return prefilter.exact_matches(docs.select(F.col("source").alias("sample_id"), F.col("text").alias("seq")), alleles)


_DNA = "translate(upper({0}), 'EIOUSLNR', 'ACGTACGT')"
_KMER_SQL = f"""with {M.ALLELES}, a0 as (select locus, allele_id, {_DNA.format('seq')} as s from al), c0 as (select doc_id, source, {_DNA.format('text')} as s from documents),
ak as (select distinct locus, allele_id, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) as k from (select locus, allele_id, unnest(list_transform(range(1, len(s) - 9), lambda i: substr(s, i, 11))) as k from a0 where len(s) >= 11) where regexp_matches(k, '^[ACGT]+$')),
ck as (select distinct source, doc_id, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) as k from (select source, doc_id, unnest(list_transform(range(1, len(s) - 9), lambda i: substr(s, i, 11))) as k from c0 where len(s) >= 11) where regexp_matches(k, '^[ACGT]+$')),
n as (select k, count(*) as n from ak group by k), sc as (select source as sample_id, locus, allele_id, round(sum(1.0::double / n), 6) as score from ck join n using (k) join ak using (k) group by all)"""


def _scores(spark, d):
    dna = lambda c: F.translate(F.upper(c), "EIOUSLNR", "ACGTACGT")
    a = M.alleles(spark, d).withColumn("seq", dna("seq"))
    docs = M.read(spark, d, "documents")
    c = docs.select(F.col("source").alias("sample_id"), F.col("doc_id").alias("contig_id"), dna("text").alias("seq"))
    return prefilter.kmer_scores(c, a, 11).withColumn("score", F.round("score", 6))


@query(f"{_KMER_SQL} select * from sc")
def j2_kmer_scores(spark, d):
    return _scores(spark, d)


@query(f"{_KMER_SQL} select sample_id, locus, allele_id, place from (select *, row_number() over (partition by sample_id, locus order by score desc, allele_id::bigint) as place from sc) where place <= 2")
def w2_top_alleles(spark, d):
    return prefilter.top_alleles(_scores(spark, d), 2).select("sample_id", "locus", "allele_id", F.col("place").cast("long").alias("place"))


@query(f"with {M.ALLELES} select locus, min(allele_id::bigint)::varchar as allele_id from al group by 1")
def w3_representatives(spark, d):
    return prefilter.representatives(M.alleles(spark, d)).select("locus", "allele_id")


@query(f"with {M.HITS} select sample_id, locus, round(max(identity * coverage), 9) as value from hits where identity >= 95 and coverage >= 0.8::double group by all")
def a21_candidate_loci(spark, d):
    return prefilter.candidate_loci(M.hits(spark, d), 95.0)


@query(f"with {M.FILLED} select sample_id, locus from filled where call_type <> 'exact'")
def p6_residual_loci(spark, d):
    h = M.hits(spark, d)
    return prefilter.residual_loci(h, h, calling.call_loci(h).filter("call_type = 'exact'"))


@query("select doc_id, sha256(upper(replace(text, 'ß', 's'))) as sha, md5(upper(replace(replace(replace(replace(text, 'ß', 's'), '-', ''), ' ', ''), chr(10), ''))) as safe, reverse(translate(text, 'ACGTacgt', 'TGCAtgca')) as rc from documents")
def f4_fingerprints(spark, d):
    t = F.replace(F.col("text"), F.lit("ß"), F.lit("s"))  # the engines disagree on its upper case
    return M.read(spark, d, "documents").select("doc_id", S.digest(t).alias("sha"), S.fingerprint(t, "safe").alias("safe"), S.reverse_complement(F.col("text")).alias("rc"))


@query("""with n as (select 'loc' || n_nationkey || case when n_nationkey % 3 = 0 then '_a_' || n_nationkey when n_nationkey % 3 = 1 then '-b-' || n_nationkey else '' end as full_id from nation)
select full_id, case when contains(full_id, '_') then regexp_extract(full_id, '^(.*)_([^_]*)$', 1) when contains(full_id, '-') then regexp_extract(full_id, '^(.*)-([^-]*)$', 1) else full_id end as locus,
 case when contains(full_id, '_') then regexp_extract(full_id, '^(.*)_([^_]*)$', 2) when contains(full_id, '-') then regexp_extract(full_id, '^(.*)-([^-]*)$', 2) else '1' end as allele from n""")
def f1_split_allele_id(spark, d):
    k = F.col("n_nationkey")
    tail = F.when(k % 3 == 0, F.concat(F.lit("_a_"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("-b-"), k.cast("string"))).otherwise("")
    full = M.read(spark, d, "nation").select(F.concat(F.lit("loc"), k.cast("string"), tail).alias("full_id"))
    locus, allele = S.split_allele_id(F.col("full_id"))
    return full.select("full_id", locus.alias("locus"), allele.alias("allele"))


@query("""select doc_id, w.start::bigint as start, w."end"::bigint as "end" from (select doc_id, unnest(case when n_chars between 100 and 5000 then [{'start': 1, 'end': n_chars}] else list_filter(list_transform(range(0, greatest(n_chars, 1), 900), lambda i: {'start': i + 1, 'end': least(i + 900, n_chars)}), lambda p: p['end'] - p['start'] + 1 between 100 and 5000) end) as w from documents)""")
def f35_gene_windows(spark, d):
    rows = M.read(spark, d, "documents").select("doc_id", F.explode(S.gene_windows(F.col("n_chars"))).alias("w"))
    return rows.select("doc_id", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"))


# --- policy: A5, A7, F16-F18, J14-J16 ---
@query("with c as (select lang as locus, len(text) as n, count(*) as k from documents group by all) select locus, min(n) as min_len, first(n order by k desc, n) as mode_len, max(n) as max_len from c group by 1")
def a5_length_stats(spark, d):
    return policy.length_stats(M.read(spark, d, "documents").select(F.col("lang").alias("locus"), F.col("text").alias("seq")))


@query(f"with {M.ALLELES} select locus, count(*) as n, min(len(seq))::bigint as min_len, max(len(seq))::bigint as max_len, round_even(avg(len(seq)), 0)::bigint as mean_len from al group by 1")
def a7_allele_stats(spark, d):
    return policy.allele_stats(M.alleles(spark, d))


def _coordinates(spark, d):
    h = M.hits(spark, d).groupBy("sample_id", "locus").agg(F.min(F.struct("hit_ordinal", "contig_length", "query_start", "query_end", "strand", "allele_length")).alias("m")).select("sample_id", "locus", "m.*")
    calls = _calls(spark, d).join(h, ["sample_id", "locus"])
    return calls.select("sample_id", "locus", "allele_id", "call_type", "multiple_hits", "novel_sequence", "contig_length", (F.col("query_start") % 30).alias("q_start"), F.least("query_end", "contig_length").alias("q_end"), "strand", "allele_length", (F.col("query_start") % 7).alias("a_start"), (F.col("allele_length") - F.col("query_end") % 9).alias("a_end"))


_CO = M.CALLS + """, m as (select * from (select *, row_number() over (partition by sample_id, locus order by hit_ordinal, contig_length, query_start, query_end, strand, allele_length) as k from hits) where k = 1),
co as (select c.*, m.contig_length, m.query_start % 30 as q_start, least(m.query_end, m.contig_length) as q_end, m.strand, m.allele_length, m.query_start % 7 as a_start, m.allele_length - m.query_end % 9 as a_end from calls c join m on c.sample_id = m.sample_id and c.locus = m.locus),
cl as (select *, case when contig_length < allele_length then 'LOTSC' when case when strand = '+' then q_start < a_start else contig_length - q_end < a_start end then 'PLOT5'
 when case when strand = '+' then contig_length - q_end < allele_length - a_end else q_start < allele_length - a_end end then 'PLOT3' end as edge, case when allele_length < 80 - 16 then 'ASM' when allele_length > 80 + 16 then 'ALM' end as size from co),
labelled as (select *, case when multiple_hits then case when call_type = 'exact' then 'NIPHEM' else 'NIPH' end when call_type = 'missing' then 'LNF' when call_type = 'exact' and allele_id is not null then allele_id when edge is not null then edge when size is not null then size
 when call_type in ('closest', 'novel') then coalesce('INF-' || allele_id, 'INF') when call_type = 'partial' then 'LNF' else coalesce(allele_id, 'LNF') end as label from cl)"""


def _classes(spark, d):
    stats = spark.range(1, 8).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("locus"), F.lit(80).alias("mode_len"))
    return policy.classify(_coordinates(spark, d), stats)


# an empty or - label is LNF, then numbers, then what begins with INF-, then the twelve names as written, then OTHER
_BUCKET = "case when trim(label) in ('', '-') then 'LNF' when regexp_full_match(trim(label), '[0-9]+') then 'NUMERIC' when starts_with(trim(label), 'INF-') then 'INF' when trim(label) in ('EXC', 'INF', 'LNF', 'PLOT3', 'PLOT5', 'LOTSC', 'NIPH', 'NIPHEM', 'ALM', 'ASM', 'PAMA', 'PLNF') then trim(label) else 'OTHER' end"
_LABELS = ("", "-", " - ", "12", " 7", "INF-3", "inf-3", "INF", "EXC", "PLNF", "plnf", "LNF", "NIPH", "NIPHEM", "ALM", "ASM", "PAMA", "PLOT3", "PLOT5", "LOTSC", "~4", "x")


@query(f"with {_CO} select sample_id, locus, label from labelled")
def f16_chew_classes(spark, d):
    return _classes(spark, d).select("sample_id", "locus", "label")


@query(f"with {_CO} select {_BUCKET} as bucket, count(*) as n from labelled group by 1")
def a15_class_counts(spark, d):
    return _classes(spark, d).groupBy(L.label_bucket(F.col("label")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""with {M.ALLELES} select distinct d.source as sample_id, a.locus, a.allele_id from documents d join al a on contains(upper(d.text), upper(a.seq)) or contains(upper(a.seq), upper(d.text))""")
def j14_contained_alleles(spark, d):
    docs = M.read(spark, d, "documents")
    cds = docs.select(F.col("source").alias("sample_id"), F.col("text").alias("seq"))
    calls = cds.select("sample_id").distinct().join(M.alleles(spark, d).select("locus", "allele_id"))
    return policy.contained(calls, M.alleles(spark, d), cds)


@query(f"with l as (select c_custkey, ({list(_LABELS)!r})[c_custkey % {len(_LABELS)} + 1] as label from customer) select c_custkey, label, {_BUCKET} as bucket from l")
def f23_label_buckets(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("c_custkey") % len(_LABELS) + 1).cast("int"))
    rows = M.read(spark, d, "customer").select("c_custkey", label.alias("label"))
    return rows.withColumn("bucket", L.label_bucket(F.col("label")))


@query(f"""with {M.FILLED}, n as (select *, 'Locus ' || chr(39) || locus || chr(39) as about from filled), w as (select sample_id, locus, unnest([case call_type when 'missing' then about || ' not found in assembly' when 'partial' then about || ' has partial coverage (' || coalesce(round_even(coverage * 100, 0)::bigint || '%', 'unknown') || ')'
 when 'exact' then null else about || ' allele ' || allele_id || ': ' || printf('%.1f', round_even(identity, 1)) || '% identity (possible novel allele)' end, case when multiple_hits then about || ': multiple high-quality hits (possible paralog)' end]) as warning from n)
select * from w where warning is not null""")
def f19_warnings(spark, d):
    w = L.warnings(F.col("locus"), F.col("call_type"), F.col("allele_id"), F.col("identity"), F.col("coverage"), F.col("multiple_hits"))
    return _filled(spark, d).select("sample_id", "locus", F.explode(w).alias("warning"))


# --- profile analytics: F7-F12, A11, A12, A24, J13, G1, G13, J5, A13, F26 ---
def _nodes(spark, d):
    return matrix.to_profiles(M.matrix(spark, d)).select(F.col("sample_ordinal").alias("id"), "profile")


@query(f"with {M.MATRIX} select sample, locus_ordinal, v as value, c is null as missing from cells")
def f7_normalised_cells(spark, d):
    v = L.normalise_allele(F.col("value"))
    return M.matrix(spark, d).select("sample", "locus_ordinal", v.alias("value"), L.is_missing(v).alias("missing"))


@query(f"""with {M.MATRIX}, p as (select sample_ordinal, sample, string_agg(v, '|' order by locus_ordinal) as profile_key from cells group by 1, 2)
select profile_key, first(sample order by sample_ordinal) || case when count(*) > 1 then ' (+' || count(*) - 1 || ')' else '' end as label, string_agg(sample, ',' order by sample_ordinal) as members, count(*) as duplicates from p group by 1""")
def a11_collapsed_profiles(spark, d):
    return matrix.collapse(matrix.to_profiles(M.matrix(spark, d))).select("profile_key", "label", F.array_join("members", ",").alias("members"), "duplicates")


_PAIRS = M.MATRIX + """, prs as (select a.sample_ordinal as source, b.sample_ordinal as target, count(*) filter (a.c <> b.c) as weight, count(*) filter (a.c <> b.c or (a.c is null and b.c is not null)) as asymmetric_weight, count(*) as n,
 count(*) filter (a.c is not null and b.c is not null) as comparable, count(*) filter (a.c is not null) as present, count(*) filter (a.c is not null and coalesce(a.c <> b.c, true)) as differs from cells a join cells b on a.locus_ordinal = b.locus_ordinal and a.sample_ordinal <> b.sample_ordinal group by all)"""


@query(f"with {_PAIRS} select source, target, weight, asymmetric_weight, asymmetric_weight * (greatest(1, n) + 1) + weight as combined_weight from prs")
def j13_directed_edges(spark, d):
    return matrix.pairs(_nodes(spark, d), directed=True)


@query(f"with {_PAIRS} select source, target, round(case when present = 0 then n else differs * n / present end, 9) as asymmetric, round(case when comparable = 0 then n * 0.01::double else (weight + 0.01::double) * n / (comparable + 0.01::double) end, 9) as symmetric from prs")
def f11_normalised_distances(spark, d):
    return matrix.normalised_pairs(_nodes(spark, d))


@query(f"with {M.MATRIX} select a.sample_ordinal as source, b.sample_ordinal as target, coalesce(string_agg('L' || a.locus_ordinal, ',' order by a.locus_ordinal) filter (a.c <> b.c), '') as mismatch_loci from cells a join cells b on a.locus_ordinal = b.locus_ordinal and a.sample_ordinal < b.sample_ordinal group by all")
def g13_pair_mismatches(spark, d):
    return matrix.pair_mismatches(_nodes(spark, d), [f"L{i}" for i in range(1, 8)]).withColumn("mismatch_loci", F.array_join("mismatch_loci", ","))


@query(f"with {M.MATRIX} select sample, count(*) filter (upper(trim(value)) not in ('', '-', 'LNF', 'NIPH', 'NIPHEM', 'ASM', 'ALM', 'PLOT3', 'PLOT5', 'LOTSC', 'PAMA', 'PLNF')) as resolved from mtx group by 1")
def a24_resolved(spark, d):
    long = M.matrix(spark, d)
    p = long.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("locus_ordinal", "value"))).alias("p")).select("sample", F.transform("p", lambda x: x["value"]).alias("profile"))
    return p.select("sample", P.resolved(F.col("profile")).cast("long").alias("resolved"))


@query("select field, value, count(*) as n from (select 'type' as field, event_type as value from events union all select 'user', (user_id % 9)::varchar from events) group by all")
def a12_metadata_breakdown(spark, d):
    e = M.read(spark, d, "events")
    return matrix.metadata_breakdown(e.select(F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), (F.col("user_id") % 9).cast("string")).alias("fields")))


@query("""with v as (select unnest(['type', 'Source ', 'one', 'country_code', 'Year', 'yearly', 'zone', 'host', 'stage']) as field, unnest([event_type, (user_id % 9)::varchar, 'x', (user_id % 4)::varchar, (user_id % 9)::varchar, (user_id % 3)::varchar, (user_id % 2)::varchar, ' ', (user_id % 3) || ' ']) as value from events),
c as (select field, count(distinct trim(value)) as n, lower(trim(field)) as name from v where trim(value) <> '' group by 1 having count(distinct trim(value)) > 1),
r as (select *, coalesce((select min(i) from range(0, 12) t(i) where starts_with(name, (['country', 'location', 'region', 'source', 'host', 'year', 'date', 'serotype', 'lineage', 'clade', 'st', 'scheme'])[i + 1])), 12) as liked from c)
select field, n, place from (select *, row_number() over (order by liked, n, name) as place from r) where place <= 5""")
def a26_colour_fields(spark, d):
    u = F.col("user_id")
    cell = {"type": F.col("event_type"), "Source ": u % 9, "one": F.lit("x"), "country_code": u % 4, "Year": u % 9, "yearly": u % 3, "zone": u % 2, "host": F.lit(" "), "stage": F.concat((u % 3).cast("string"), F.lit(" "))}
    m = M.read(spark, d, "events").select(F.create_map(*[x for k, v in cell.items() for x in (F.lit(k), v.cast("string"))]).alias("fields"))
    return matrix.colour_fields(m).withColumn("place", F.col("place").cast("long"))


@query(f"""with c as (select value, count(*) as n from (select case when p_size = 3 then '' else p_brand || p_size end as value from part) where value <> '' group by 1), o as (select *, row_number() over (order by n desc, value) - 1 as i from c),
h as (select *, i * 137508 % 360000 as mille from o)
select value, n, case when i < {len(matrix.PALETTE)} then ({list(matrix.PALETTE)!r})[i + 1] else 'hcl(' || (mille // 1000) || case when mille % 1000 = 0 then '' else '.' || rtrim(lpad((mille % 1000)::varchar, 3, '0'), '0') end || ', ' || (60 + i % 3 * 15) || '%, ' || (50 + i % 4 * 5) || '%)' end as colour from h""")
def a27_colour_map(spark, d):
    value = F.when(F.col("p_size") == 3, "").otherwise(F.concat("p_brand", F.col("p_size").cast("string")))
    return matrix.colour_map(M.read(spark, d, "part").select(value.alias("value")))


def _runs(spark, d):
    long = M.matrix(spark, d)
    cell = lambda c, keep: long.filter(keep).select(F.col("sample").alias("sample_id"), F.col("locus_ordinal").alias("locus"), F.col(c).alias("value"))
    st = lambda c, keep: long.filter(keep).groupBy(F.col("sample").alias("sample_id")).agg(F.max(c).alias("st"))
    left, right = "sample_ordinal % 10 <> 0", "sample_ordinal % 7 <> 0"
    return st("value", left), st("other", right), cell("value", left), cell("other", right)


_RUNS = M.MATRIX + """, ls as (select sample as sample_id, max(value) as left_st from mtx where sample_ordinal % 10 <> 0 group by 1), rs as (select sample as sample_id, max(other) as right_st from mtx where sample_ordinal % 7 <> 0 group by 1),
df as (select sample as sample_id, count(*) filter (value <> other) as n from mtx group by 1),
cmp as (select coalesce(ls.sample_id, rs.sample_id) as sample_id, coalesce(left_st, '') as left_st, coalesce(right_st, '') as right_st, case when ls.sample_id is not null and rs.sample_id is not null then case when left_st = right_st then 'same_st' else 'different_st' end when ls.sample_id is not null then 'left_only' else 'right_only' end as status,
 case when ls.sample_id is not null and rs.sample_id is not null then df.n else 0 end as differing_loci_count from ls full join rs on ls.sample_id = rs.sample_id join df on df.sample_id = coalesce(ls.sample_id, rs.sample_id))"""


@query(f"with {_RUNS} select * from cmp")
def j5_compare_runs(spark, d):
    return compare.compare_runs(*_runs(spark, d))


@query(f"with {_RUNS} select count(*) filter (status in ('same_st', 'different_st')) as matched_samples, count(*) filter (status = 'same_st') as same_st, count(*) filter (status = 'different_st') as different_st, count(*) filter (differing_loci_count > 0) as samples_with_locus_differences, count(*) filter (status = 'left_only') as left_only, count(*) filter (status = 'right_only') as right_only from cmp")
def a13_compare_summary(spark, d):
    return compare.compare_summary(compare.compare_runs(*_runs(spark, d)))


@query(f"with {_RUNS}, j as (select coalesce(ls.sample_id, rs.sample_id) as sample_id, left_st is distinct from right_st as st_differs, ls.sample_id is null or rs.sample_id is null as one_side from ls full join rs on ls.sample_id = rs.sample_id) select j.sample_id, st_differs, case when one_side then 7 else df.n end as n_loci, st_differs or one_side or df.n > 0 as mismatch from j join df using (sample_id)")
def j6_gate_mismatches(spark, d):
    return compare.gate_mismatches(*_runs(spark, d))


@query("with m as (" + f"with {M.MATRIX} select * from mtx" + ") select sample as sample_id, count(*) as n_loci, count(*) filter (value <> other) as n_differ, coalesce(string_agg(locus_ordinal::varchar, ',' order by locus_ordinal) filter (value <> other), '') as differ from m where sample_ordinal % 10 <> 0 and sample_ordinal % 7 <> 0 group by 1")
def j7_common_differences(spark, d):
    _, _, a, b = _runs(spark, d)
    text = lambda x: x.withColumn("locus", F.col("locus").cast("string"))
    return compare.common_differences(text(a), text(b))


@query(f"""with {M.MATRIX}, x as (select value as q0, other as r0, regexp_replace(regexp_replace(trim(value), '^~', ''), '\\?$', '') as q, regexp_replace(regexp_replace(trim(other), '^~', ''), '\\?$', '') as r from mtx),
y as (select *, upper(q) in ('', '-', 'LNF', 'NIPH', 'ALM', 'ASM', 'PLOT3', 'PLOT5') as qm, upper(r) in ('', '-', 'LNF', 'NIPH', 'ALM', 'ASM', 'PLOT3', 'PLOT5') as rm, regexp_matches(trim(q0), '^[0-9]+$') and regexp_matches(trim(r0), '^[0-9]+$') as s, regexp_matches(q, '^[0-9]+$') and regexp_matches(r, '^[0-9]+$') as l from x)
select count(*) as common_loci, count(*) filter (q0 = r0) as strict_equal, count(*) filter (q = r) as normalized_equal, count(*) filter (s and q0 = r0) as strict_numeric_equal, count(*) filter (s and q0 <> r0) as strict_numeric_diff, count(*) filter (l and q = r) as normalized_numeric_equal, count(*) filter (l and q <> r) as normalized_numeric_diff,
 count(*) filter (qm and rm) as both_missing, count(*) filter (qm and not rm) as query_missing_only, count(*) filter (rm and not qm) as reference_missing_only, count(*) filter (q <> r) as normalized_diff_total from y""")
def a14_concordance(spark, d):
    return compare.concordance(M.matrix(spark, d).select(F.col("value").alias("query"), F.col("other").alias("reference")))


@query(f"with {M.MATRIX} select sample, locus_ordinal, case when l and r then 'both_missing' when l then 'left_missing' when r then 'right_missing' else 'allele_difference' end as type from (select *, upper(value) = 'LNF' as l, other = '2' as r from mtx) where value <> other")
def f26_locus_differences(spark, d):
    right = F.when(F.col("other") == "2", "PAMA").otherwise(F.col("other"))
    return M.matrix(spark, d).filter("value <> other").select("sample", "locus_ordinal", L.locus_diff(F.col("value"), right).alias("type"))


_PAIR_SQL = f"with {M.MATRIX}, g as (select sample, locus_ordinal, case when sample_ordinal % 5 = 0 then '-' else value end as a, case other when '1' then 'NIPH' when '2' then 'INF-2' when '3' then 'LNF' else '4' end as b, sample_ordinal % 2 = 0 as found, locus_ordinal % 2 = 0 as ex, sample_ordinal % 4 as hits from mtx), n as (select *, regexp_replace(regexp_replace(regexp_replace(a, '^INF-', ''), '^~', ''), '\\?$', '') as na, regexp_replace(regexp_replace(regexp_replace(b, '^INF-', ''), '^~', ''), '\\?$', '') as nb from g)"


def _callers(spark, d):
    m = M.matrix(spark, d)
    other = F.when(F.col("other") == "1", "NIPH").when(F.col("other") == "2", "INF-2").when(F.col("other") == "3", "LNF").otherwise("4")
    return m.select("sample", "locus_ordinal", F.when(F.col("sample_ordinal") % 5 == 0, "-").otherwise(F.col("value")).alias("a"), other.alias("b"), (F.col("sample_ordinal") % 2 == 0).alias("found"), (F.col("locus_ordinal") % 2 == 0).alias("ex"), (F.col("sample_ordinal") % 4).alias("hits"))


@query(_PAIR_SQL + """ select sample, locus_ordinal, case when na = nb then 'consistent' when b in ('-', 'LNF') and a not in ('-', 'LNF') then 'chew_LNF_ours_found' when a in ('-', 'LNF') and b not in ('-', 'LNF') then 'ours_LNF_chew_found' when b like 'INF-%' and a not like 'INF%' and a not like '~%' then 'chew_INF_ours_exact'
 when a like 'INF-%' and b not like 'INF-%' and b not like '~%' then 'ours_INF_chew_exact' when (a like 'INF-%' or a like '~%') and b like 'INF-%' then 'both_INF_diff_allele' when a like '~%' and b not like 'INF-%' and b not like '~%' then 'ours_closest_chew_exact' when b in ('NIPH', 'NIPHEM') then 'chew_NIPH' else 'other' end as category from n""")
def f21_diff_categories(spark, d):
    return _callers(spark, d).select("sample", "locus_ordinal", L.diff_category(F.col("a"), F.col("b")).alias("category"))


@query(_PAIR_SQL + """ select verdict, count(*) as n from (select case when b in ('NIPH', 'NIPHEM') then case when hits >= 2 then 'chew_niph_verified' else 'chew_niph_unverified' end when b like 'INF-%' and ex then case when found then 'cds_boundary_diff' else 'chew_inf_bsr_bug' end when b in ('-', 'LNF') and found then 'ours_correct'
 when (a like 'INF-%' or a like '~%') and ex then case when found then 'cds_boundary_diff' else 'chew_correct' end when not (a like 'INF-%' or a like '~%') and a not in ('-', 'LNF') and b in ('-', 'LNF') then 'ours_correct' when found and ex then 'cds_boundary_diff' when found then 'ours_correct' when ex then 'chew_correct' else 'both_unverified' end as verdict from n) group by 1""")
def f21_verdict_counts(spark, d):
    return _callers(spark, d).groupBy(L.verdict(F.col("a"), F.col("b"), F.col("found"), F.col("ex"), F.col("hits")).alias("verdict")).agg(F.count("*").alias("n"))


_DISCREPANCIES = """x as (select sample, locus_ordinal, case when sample_ordinal % 7 = 0 then ' LOTSC' when sample_ordinal % 11 = 0 then 'INF-3' else value end as q, case when sample_ordinal % 13 = 0 then '~9' when sample_ordinal % 17 = 0 then 'plot5' else other end as r,
 case when sample_ordinal % 3 = 0 then 'five_prime_boundary_shift' when sample_ordinal % 3 = 1 then 'three_prime_boundary_shift ' else 'other_reason' end as reason, 'codon' || locus_ordinal % 2 as sub from mtx),
y as (select *, trim(q) as a, trim(r) as b, upper(trim(q)) in ('', '-', 'LNF', 'NIPH', 'ALM', 'ASM', 'PLOT3', 'PLOT5', 'LOTSC') or upper(trim(r)) in ('', '-', 'LNF', 'NIPH', 'ALM', 'ASM', 'PLOT3', 'PLOT5', 'LOTSC') as lost, regexp_full_match(trim(q), '[0-9]+') as an, regexp_full_match(trim(r), '[0-9]+') as bn, regexp_full_match(trim(q), '~[0-9]+') as ax, regexp_full_match(trim(r), '~[0-9]+') as bx, trim(reason) in ('five_prime_boundary_shift', 'three_prime_boundary_shift') as shifted from x)"""


def _decisions(spark, d, anchor):
    m, k = M.matrix(spark, d), F.col("sample_ordinal")
    q = F.when(k % 7 == 0, " LOTSC").when(k % 11 == 0, "INF-3").otherwise(F.col("value"))
    r = F.when(k % 13 == 0, "~9").when(k % 17 == 0, "plot5").otherwise(F.col("other"))
    reason = F.when(k % 3 == 0, "five_prime_boundary_shift").when(k % 3 == 1, "three_prime_boundary_shift ").otherwise("other_reason")
    decision, why, call = L.normalisation_decision(q, r, reason, F.concat(F.lit("codon"), (F.col("locus_ordinal") % 2).cast("string")), anchor)
    return m.select("sample", "locus_ordinal", decision.alias("decision"), why.alias("decision_reason"), call.alias("normalized_call"))


@query(f"""with {M.MATRIX}, {_DISCREPANCIES} select sample, locus_ordinal, case when a = b then 'unchanged' when lost then 'escalate' when an and bn and shifted or ax and bn then 'accept' else 'escalate' end as decision,
 case when a = b then 'raw_equal' when lost then 'missing_or_special_class' when an and bn then case when shifted then 'boundary_shift::' || trim(reason) || '::' || sub else 'strict_numeric_diff_without_boundary_evidence' end when ax and bn then 'prodigal_anchor_reference_numeric_over_non_exact' when an and bx then 'non_exact_reference_requires_manual_review' else 'non_numeric_or_complex_difference' end as decision_reason,
 case when a = b then a when lost then '' when an and bn and shifted or ax and bn then b else '' end as normalized_call from y""")
def f22_normalisation_by_reference(spark, d):
    return _decisions(spark, d, "reference")


@query(f"""with {M.MATRIX}, {_DISCREPANCIES} select sample, locus_ordinal, case when a = b then 'unchanged' when lost then 'escalate' when an and bn and shifted or an and bx then 'accept' else 'escalate' end as decision,
 case when a = b then 'raw_equal' when lost then 'missing_or_special_class' when an and bn then case when shifted then 'boundary_shift::' || trim(reason) || '::' || sub else 'strict_numeric_diff_without_boundary_evidence' end when ax and bn then 'non_exact_query_requires_manual_review' when an and bx then 'prodigal_anchor_query_numeric_over_non_exact' else 'non_numeric_or_complex_difference' end as decision_reason,
 case when a = b then a when lost then '' when an and bn and shifted or an and bx then a else '' end as normalized_call from y""")
def f22_normalisation_by_query(spark, d):
    return _decisions(spark, d, "query")


_IV = "iv as (select l_suppkey % 20 as contig, l_linestatus as strand, l_orderkey as id, l_partkey % 3000 + 1 as start, l_partkey % 3000 + 1 + (l_partkey * 7 + l_linenumber) % 90 as \"end\" from lineitem)"


@query(f"""with {_IV}, q as (select distinct id, contig::varchar as contig, strand, start, "end" from iv where strand = 'O' or contig < 10), r as (select distinct contig::varchar as contig, strand, start as rs, "end" as re from iv where strand = 'F' or contig >= 5)
select q.id, q.contig, q.strand, q.start, q."end", ['no_overlap', 'overlap_only', 'same_start_diff_stop', 'same_stop_diff_start', 'exact'][coalesce(max(case when start = rs and "end" = re then 4 when "end" = re then 3 when start = rs then 2 when "end" >= rs and re >= start then 1 else 0 end), 0) + 1] as relation
from q left join r on q.contig = r.contig and q.strand = r.strand and "end" >= rs and re >= start group by 1, 2, 3, 4, 5""")
def j10_interval_relations(spark, d):
    start = F.col("l_partkey") % 3000 + 1
    iv = M.read(spark, d, "lineitem").select((F.col("l_suppkey") % 20).cast("string").alias("contig"), F.col("l_linestatus").alias("strand"), F.col("l_orderkey").alias("id"), start.alias("start"), (start + (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 90).alias("end")).distinct()
    # the binding's two gene sets
    return compare.interval_relations(iv.filter("strand = 'O' or cast(contig as int) < 10"), iv.filter("strand = 'F' or cast(contig as int) >= 5"), 256)


@query("select p_partkey % 50 as locus, max_by(p_name, p_partkey) as reason from part group by 1")
def j11_last_reasons(spark, d):
    p = M.read(spark, d, "part").select((F.col("p_partkey") % 50).alias("locus"), F.col("p_name").alias("reason"), F.col("p_partkey").alias("row_ordinal"))
    return compare.last_reasons(p)


@query(f"with {M.HITS} select sample_id, locus, count(*) filter (identity >= 90 and coverage >= 0.5::double) as copies, count(*) filter (identity = 100 and coverage >= 1) as exact_copies from hits group by all")
def a25_multi_copy(spark, d):
    return compare.multi_copy(M.hits(spark, d))


@query("select event_type as backend, round(avg(value), 6) as avg_seconds, round(stddev_pop(value), 6) as pstdev_seconds, round(avg((user_id % 5 > 0)::int), 6) as success_rate, sum(user_id % 7)::bigint as exact, sum(user_id % 3)::bigint as novel, sum(user_id % 2)::bigint as failed from events group by 1")
def a16_benchmark_metrics(spark, d):
    u = F.col("user_id")
    return compare.benchmark_metrics(M.read(spark, d, "events").select(F.col("event_type").alias("backend"), F.col("value").alias("seconds"), (u % 5 > 0).alias("ok"), (u % 7).alias("exact"), (u % 3).alias("novel"), (u % 2).alias("failed")))


@query("""with e as (select unnest(['clustering', 'unknown', 'prediction', 'assembly', 'input', 'typing'][1 + user_id % 2 : 2 + user_id % 5]) as stage from events union all select event_type from events),
even as (select distinct stage from e), c as (select stage, count(*) as n from e group by 1 union all select 'tie ' || stage, 5 from even)
select 'most' as part, stage, n from (select * from c where not starts_with(stage, 'tie ') order by n desc, case stage when 'input' then 0 when 'assembly' then 1 when 'prediction' then 2 when 'unknown' then 3 else 99 end, stage limit 1)
union all select 'tie', 'input', 5 from (select 1 where exists (select 1 from even where stage = 'input')) union all select 'tie without input', 'assembly', 5 from (select 1 where exists (select 1 from even where stage = 'assembly')) union all select 'others', 'clustering', 5 union all select 'none', 'unknown', 0""")
def a17_primary_stage(spark, d):
    u = F.col("user_id")
    names = F.slice(F.array(*[F.lit(x) for x in ("clustering", "unknown", "prediction", "assembly", "input", "typing")]), (1 + u % 2).cast("int"), F.greatest(F.lit(0), (2 + u % 5 - u % 2).cast("int")))
    e = M.read(spark, d, "events")
    rows = table(e.select(F.explode(names).alias("stage")).unionByName(e.select(F.col("event_type").alias("stage"))), "stages")
    even = rows.distinct().select("stage", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).drop("k")
    cases = {"most": rows, "tie": even, "tie without input": even.filter("stage <> 'input'"), "others": even.filter("stage in ('typing', 'clustering')"), "none": even.limit(0)}
    out = None
    for name, part in cases.items():
        one = compare.primary_stage(part).select(F.lit(name).alias("part"), "stage", F.col("n").cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# --- graphs: G6 weight, G8, G9 ---
@query(f"""with recursive {_PAIRS}, near as (select source as a, target as b from prs where weight <= 1), reach as (select distinct sample_ordinal as a, sample_ordinal as b from cells union select reach.a, near.b from reach join near on reach.b = near.a)
select a as id, min(b) as cluster from reach group by 1""")
def g9_threshold_clusters(spark, d):
    nodes = _nodes(spark, d)
    near = matrix.pairs(nodes).filter("weight <= 1").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return graph.clusters(nodes.select("id"), near)


@query(None)
def g2_spanning_tree(spark, d):
    """Minimum arborescence over collapsed profiles (edge list)."""
    nodes = matrix.collapse(table(matrix.to_profiles(M.matrix(spark, d)), "profiles")).select(F.col("sample_ordinal").alias("id"), "label", "profile")
    return graph.spanning_tree(nodes, force=True)


@query(f"with {_PAIRS}, e as (select *, asymmetric_weight * (greatest(1, n) + 1) + weight as combined_weight, row_number() over (partition by target order by asymmetric_weight * (greatest(1, n) + 1) + weight, asymmetric_weight, 's' || source, 's' || target, source) as r from prs) select target, source, weight, combined_weight from e where r = 1")
def w8_least_incoming(spark, d):
    nodes = _nodes(spark, d)
    return matrix.least_sources(nodes.withColumn("label", F.concat(F.lit("s"), F.col("id").cast("string"))))


@query(f"""with {_PAIRS}, h as (select source as id, (select count(distinct sample_ordinal) from cells)::double / sum(1 / (weight + 0.1::double)) as h from prs group by 1)
select id, (row_number() over (order by round(h, 9), id) - 1) / (select count(*) from h)::double as weight from h""")
def w6_harmonic_weights(spark, d):
    nodes = _nodes(spark, d).select("id", "profile", F.lit(1).alias("member_count"))
    return graph.harmonic_weights(nodes, matrix.pairs(nodes, directed=True).select("source", F.col("weight").alias("d")))


def _tree(spark, d):
    nodes = matrix.collapse(table(matrix.to_profiles(M.matrix(spark, d)), "profiles")).select(F.col("sample_ordinal").alias("id"), "label", "profile", F.col("duplicates").alias("member_count"))
    return nodes, graph.spanning_tree(nodes, force=True)


@query(None)
def g10_root(spark, d):
    """Root of the spanning tree."""
    return graph.choose_root(*_tree(spark, d))


@query(None)
def g11_rooted_tree(spark, d):
    """The spanning tree hung from its root, with the number of descendants."""
    nodes, tree = _tree(spark, d)
    hung = graph.rooted(tree, graph.choose_root(nodes, tree).first()["id"])
    return hung.join(graph.descendants(hung), "id")


@query(None)
def k17_newick(spark, d):
    """The spanning tree in Newick form."""
    nodes, tree = _tree(spark, d)
    return graph.newick(nodes, graph.rooted(tree, graph.choose_root(nodes, tree).first()["id"]))


# --- scheme-free and novel data: W5, A18, A19, A22, A29, K12, P21, P22, J16, J18-J20 ---
_GENES = """gn as (select source as sample_id, doc_id as gene_ordinal, text as seq, lang from documents), cl as (select md5(seq) as cluster, min(gene_ordinal) as f from gn group by 1), nm as (select cluster, 'locus_' || row_number() over (order by f, cluster) as locus from cl),
lo as (select g.*, n.locus from gn g join nm n on md5(g.seq) = n.cluster)"""


@query(f"with {_GENES} select gene_ordinal, locus from lo")
def w5_cluster_loci(spark, d):
    return schemefree.cluster_loci(M.genes(spark, d), F.md5("seq")).select("gene_ordinal", "locus")


_LANG = "gl as (select source as sample_id, doc_id as gene_ordinal, text as seq, lang as locus from documents), lg as (select * from (select *, row_number() over (partition by sample_id, locus order by len(seq) desc, gene_ordinal) as r from gl) where r = 1), nu as (select locus, k, row_number() over (partition by locus order by f) as number from (select locus, md5(upper(replace(replace(replace(seq, '-', ''), ' ', ''), chr(10), ''))) as k, min(gene_ordinal) as f from lg group by all)), na as (select l.*, l.locus || '_' || n.number as allele_id from lg l join nu n on l.locus = n.locus and md5(upper(replace(replace(replace(seq, '-', ''), ' ', ''), chr(10), ''))) = n.k)"


def _longest(spark, d):
    return schemefree.longest_genes(M.genes(spark, d).withColumn("locus", F.col("lang")))


@query(f"with {_LANG} select sample_id, locus, gene_ordinal from lg")
def a22_longest_genes(spark, d):
    return _longest(spark, d).select("sample_id", "locus", "gene_ordinal")


@query(f"with {_LANG} select sample_id, locus, allele_id from na")
def w5_allele_numbers(spark, d):
    return schemefree.number_alleles(_longest(spark, d)).select("sample_id", "locus", "allele_id")


@query(f"with {_LANG} select sample_id, string_agg(coalesce(regexp_extract(allele_id, '([^_]*)$', 1), '0'), chr(9) order by locus) as row from (select s.sample_id, l.locus, na.allele_id from (select distinct sample_id from na) s cross join (select distinct locus from na) l left join na on na.sample_id = s.sample_id and na.locus = l.locus) group by 1")
def k12_schemefree_rows(spark, d):
    a = schemefree.number_alleles(_longest(spark, d))
    return schemefree.table_row(schemefree.sample_profiles(a), a)


@query(f"with {_LANG} select locus, count(*) as total, count(distinct allele_id) as distinct_ids from na group by 1")
def a18_hash_stats(spark, d):
    return schemefree.hash_stats(schemefree.number_alleles(_longest(spark, d))).withColumnRenamed("distinct", "distinct_ids")


_NOVEL = """f as (select lang as locus, source as sample, upper(replace(replace(replace(text, '-', ''), ' ', ''), chr(10), '')) as seq, doc_id as ordinal from documents), fk as (select *, substr(md5(seq), 1, 16) as k from f),
nn as (select locus, k, 'n' || row_number() over (partition by locus order by min(ordinal), k) as allele_id from fk group by locus, k), sm as (select locus, k, sample, min(ordinal) as o from fk group by all)"""


def _novel(spark, d):
    return novel.novel_alleles(M.read(spark, d, "documents").select(F.col("lang").alias("locus"), F.col("source").alias("sample"), F.col("text").alias("seq"), F.col("doc_id").alias("ordinal")))


@query(f"with {_NOVEL} select nn.locus, allele_id, string_agg(sample, ' ' order by o) as samples from nn join sm on nn.locus = sm.locus and nn.k = sm.k group by 1, 2")
def a29_novel_alleles(spark, d):
    return _novel(spark, d).select("locus", "allele_id", F.array_join("samples", " ").alias("samples"))


@query(f"with {_NOVEL} select locus, max(substr(allele_id, 2)::bigint) as last from nn group by 1")
def a19_last_numbers(spark, d):
    return novel.last_numbers(_novel(spark, d))


@query(f"with {M.KEYS}, ok as (select sample_id, profile from keyed where position('-' in '|' || profile) = 0), nm as (select profile, row_number() over (order by min(sample_id)) as k from ok group by 1) select ok.sample_id as sample, ok.profile, 'N' || nm.k as st from ok join nm using (profile)")
def p21_novel_profiles(spark, d):
    keyed = calling.profile_keys(_filled(spark, d)).select(F.col("sample_id").alias("sample"), "profile", F.col("sample_id").alias("ordinal"))
    return novel.novel_profiles(keyed).select("sample", F.array_join("profile", "|").alias("profile"), "st")


# --- catalogue and names: P9-P12, P16, P17, A20, C3, C4, P20, W10, F24-F28, J18, J21, O5, O9 ---
_TYPE = "case when " + " or ".join(f"contains(lower(description), '{w}')" for w in catalog.OTHER_WORDS) + " then 'other' " + " ".join("when " + " or ".join(f"contains(lower(description), '{w}')" for w in ws) + f" then '{n}'" for n, ws in catalog.TYPE_WORDS) + " else 'other' end"
_BASE = "case when o = '' then 'unknown' when contains(o, ' spp.') or contains(o, ' sp.') or o like '% spp' or o like '% sp' or not contains(o, ' ') then split_part(o, ' ', 1) when contains(split_part(o, ' ', 2), '/') then split_part(o, ' ', 1) else substr(o, 1, 1) || split_part(o, ' ', 2) end"


@query(f"with {M.CATALOG} select row_ordinal, {_TYPE} as scheme_type, {_BASE} as base from (select *, lower(trim(organism)) as o from cat)")
def f27_scheme_names(spark, d):
    return M.catalog(spark, d).select("row_ordinal", catalog.scheme_type(F.col("description")).alias("scheme_type"), catalog.base_name(F.col("organism")).alias("base"))


@query(f"""with {M.CATALOG}, o as (select *, {_BASE} as base from (select *, lower(trim(organism)) as o from cat where row_ordinal % 9 <> 0)), s as (select *, min(row_ordinal) over (partition by base, organism) as seen from o), k as (select *, row_number() over (partition by base order by seen, row_ordinal) as k from s)
select row_ordinal, organism, base || '_' || (k + case base when 'vibrio' then 4 when 'salmonella' then 2 else 0 end) as scheme_name from k""")
def c3_rename_schemes(spark, d):
    c = M.catalog(spark, d)
    blocked = c.filter("row_ordinal % 9 = 0").select(F.col("scheme_name").alias("name"))
    others = spark.sql("select * from values ('vibrio_4'), ('vibrio_3'), ('salmonella_2'), ('x') as t(scheme_name)")
    return catalog.rename_schemes(c, others, blocked)


@query(f"with {M.CATALOG} select row_ordinal from cat where contains(lower(organism), 'coli') or contains(lower(scheme_name), 'coli') or contains(lower(provider), 'coli')")
def p11_search(spark, d):
    return catalog.search_catalog(M.catalog(spark, d).withColumn("display_name", F.lit(None).cast("string")), "Coli").select("row_ordinal")


@query(f"with {M.CATALOG}, t as (select *, {_TYPE} as scheme_type from cat) select row_ordinal, scheme_type from t where provider = 'p1' and scheme_type in ('mlst', 'cgmlst', 'wgmlst', 'rmlst') and row_ordinal % 9 <> 0")
def p9_filter_catalog(spark, d):
    c = M.catalog(spark, d).withColumn("scheme_type", catalog.scheme_type(F.col("description"))).withColumn("directory", F.lit("d"))
    blocked = M.catalog(spark, d).filter("row_ordinal % 9 = 0").select(F.col("scheme_name").alias("name"))
    return catalog.filter_catalog(c, "p1", "all", blocked).select("row_ordinal", "scheme_type")


@query("with a as (select p_partkey as k, p_size as v from part where p_partkey % 7 <> 0), b as (select p_partkey as k, case when p_partkey % 10 = 0 then p_size + 1 else p_size end as v from part where p_partkey % 8 <> 0) select coalesce(a.k, b.k) as k, case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as status from a full join b on a.k = b.k where a.k is null or b.k is null or a.v is distinct from b.v")
def c4_changed(spark, d):
    p = M.read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    return catalog.changed(p.filter("k % 7 <> 0"), p.filter("k % 8 <> 0").withColumn("v", F.when(F.col("k") % 10 == 0, F.col("v") + 1).otherwise(F.col("v"))), "k", ["v"])


_FILES = """fn as (select conv_id, turn, case turn % 5 when 0 then 'iso' || conv_id || '_S' || turn || '_L001_R1_001.fastq.gz' when 1 then 'iso' || conv_id || '_R2.fq' when 2 then 'iso' || conv_id || '.fasta.gz' when 3 then 'iso' || conv_id || '.R1.fastq' else 'Iso' || conv_id || '.FNA' end as name from conversations)"""


def _files(spark, d):
    c, t = F.col("conv_id").cast("string"), F.col("turn")
    name = F.when(t % 5 == 0, F.concat(F.lit("iso"), c, F.lit("_S"), t.cast("string"), F.lit("_L001_R1_001.fastq.gz"))).when(t % 5 == 1, F.concat(F.lit("iso"), c, F.lit("_R2.fq"))).when(t % 5 == 2, F.concat(F.lit("iso"), c, F.lit(".fasta.gz"))).when(t % 5 == 3, F.concat(F.lit("iso"), c, F.lit(".R1.fastq"))).otherwise(F.concat(F.lit("Iso"), c, F.lit(".FNA")))
    return M.read(spark, d, "conversations").select("conv_id", "turn", name.alias("name"))


@query(f"with {_FILES} select conv_id, turn, case when turn % 5 = 4 then 'Iso' || conv_id else 'iso' || conv_id end as sample_id from fn")
def f24_sample_ids(spark, d):
    return _files(spark, d).select("conv_id", "turn", N.sample_id(F.col("name")).alias("sample_id"))


@query(f"with {_FILES} select conv_id, turn, case turn % 5 when 0 then 'iso' || conv_id || '_S' || turn || '_L001' when 1 then 'iso' || conv_id when 3 then 'iso' || conv_id end as pair, case turn % 5 when 0 then 1 when 1 then 2 when 3 then 1 end as mate from fn")
def f25_mates(spark, d):
    pair, mate = N.mate_of(F.col("name"))
    return _files(spark, d).select("conv_id", "turn", pair.alias("pair"), mate.alias("mate"))


_HOSTS = ("10.0.0.1", "10.example.com", "127.0.0.1", "127.1", "2130706433", "0x7f000001", "010.0.0.1", "1.2.3.4.5", "0.0.0.0", "169.254.169.254", "172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.1", "192.168.1.1", "192.169.1.1", "192.0.0.9", "192.0.0.1", "192.0.2.7", "198.18.0.1", "198.20.0.1", "198.51.100.3", "203.0.113.9", "224.0.0.1", "240.0.0.1", "255.255.255.255", "8.8.8.8", "100.64.0.1", "localhost", "[::]", "[::1]", "[::ffff:10.0.0.1]", "[::ffff:8.8.8.8]", "[fe80::1]", "[fd00::1]", "[ff02::1]", "[2001:db8::1]", "[2606:4700::1111]", "[2001:4860:4860::8888]", "[zz]", "")
_URLS = (*(f"http://{h}/x" for h in _HOSTS), "ftp://example.com/", "https://u:p@10.0.0.1:80/", "https://u@v@example.com:443?q", "HTTPS://Example.com", "http://10.0.0.1@example.com/", "mailto:a@b", "")


@query(f"""with u as (select page_id, url from pages union all select -1 - i, ({list(_URLS)!r})[i + 1] from range(0, {len(_URLS)}) t(i)),
h as (select page_id, url, lower(regexp_extract(url, '^(?i:https?)://(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]|[^/:?#\\[\\]]*)(?::[0-9]*)?(?:[/?#]|$)', 1)) as host from u),
q as (select *, regexp_full_match(host, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}') as quad from h)
select page_id, host <> '' and not case when quad then regexp_matches(host, '^(0|10|127|22[4-9]|2[345][0-9])[.]|^169[.]254[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]|^192[.]168[.]|^192[.]0[.]0[.]([0-8]|1[1-9]|[2-9][0-9]|[12][0-9][0-9])$|^192[.]0[.]2[.]|^198[.]1[89][.]|^198[.]51[.]100[.]|^203[.]0[.]113[.]')
 when starts_with(host, '[') then host not in ('[2606:4700::1111]', '[::ffff:8.8.8.8]', '[2001:4860:4860::8888]') else host in ('localhost', '127.1', '2130706433', '0x7f000001', '010.0.0.1', '1.2.3.4.5') end as public from q""")
def p16_public_urls(spark, d):
    pages = M.read(spark, d, "pages").select("page_id", "url")
    more = spark.createDataFrame([(-1 - i, u) for i, u in enumerate(_URLS)], "page_id long, url string")
    return pages.unionByName(more).select("page_id", N.is_public_url(F.col("url")).alias("public"))


@query("select page_id, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))::bigint as n_links, regexp_extract(html, 'href=\"([^\"]+)\"', 1) as first_link from pages")
def s22_links(spark, d):
    from typeloom.sources.remote import links

    return M.read(spark, d, "pages").select("page_id", F.size(links(F.col("html"))).cast("long").alias("n_links"), F.coalesce(F.get(links(F.col("html")), F.lit(0)), F.lit("")).alias("first_link"))


@query("select c_custkey, 'sc_' || (c_custkey % 13) as name, row_number() over (order by c_custkey % 2 = 0, 'sc', c_custkey % 13, c_custkey) as place from customer")
def w10_natural_order(spark, d):
    c = M.read(spark, d, "customer").select("c_custkey", F.concat(F.lit("sc_"), (F.col("c_custkey") % 13).cast("string")).alias("name"))
    return numbered(c, [*catalog.natural_order(F.col("name"), F.col("c_custkey") % 2 != 0), "c_custkey"], "place")


@query("""with s as (select s_suppkey as k, 'iso' || s_suppkey as sample_id from supplier), f as (select sample_id || case k % 3 when 0 then '.fa' when 1 then '.fastq.gz' else '.fna' end as name from s where k % 5 > 0 union all select sample_id || '.fasta' from s where k % 4 = 0 union all select sample_id from s where k % 6 = 0 union all select sample_id || '.fasta.gz' from s where k % 2 = 0 union all select sample_id || '.fq' from s where k % 7 = 0),
o as (select unnest(['', '.fasta', '.fa', '.fna', '.ffn', '.frn', '.fastq', '.fq', '.fasta.gz', '.fa.gz', '.fna.gz', '.fastq.gz', '.fq.gz']) as suffix, unnest(range(0, 13)) as place)
select s.sample_id, min_by(f.name, place) as path from s left join o on true left join f on f.name = s.sample_id || o.suffix group by 1""")
def j21_resolve_files(spark, d):
    k = F.col("s_suppkey")
    s = M.read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("iso"), k.cast("string")).alias("sample_id"))
    ending = F.when(k % 3 == 0, ".fa").when(k % 3 == 1, ".fastq.gz").otherwise(".fna")
    files = s.filter(k % 5 > 0).select(F.concat("sample_id", ending).alias("name"))
    for every, suffix in ((4, ".fasta"), (6, ""), (2, ".fasta.gz"), (7, ".fq")):
        files = files.unionByName(s.filter(k % every == 0).select(F.concat("sample_id", F.lit(suffix)).alias("name")))
    return catalog.resolve_files(s, files)


@query("select event_id, try_cast(json_extract_string(props, '$.n') as bigint) as n from events")
def json_fields(spark, d):
    return M.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.n").try_cast("bigint").alias("n"))
