"""Further named queries: files to calls, refinement passes, inputs and decisions. See `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.operators import calling, inputs, passes, refine
from typeloom.plans import model as M
from typeloom.plans.registry import query
from typeloom.sources import text as T
from typeloom.storage import fresh_path, table

_NEXT = "case when locus = 'L7' then 'L1' else 'L' || (substr(locus, 2)::int + 1) end"
_RANK = "case call_type when 'exact' then 5 when 'closest' then 4 when 'novel' then 3 when 'partial' then 2 else 1 end"
_DONE = M.FILLED.replace(" as (", " as materialized (")


def _next_locus(df: DataFrame) -> DataFrame:
    n = F.substring("locus", 2, 9).cast("int")
    return df.withColumn("locus", F.when(n == 7, "L1").otherwise(F.concat(F.lit("L"), (n + 1).cast("string"))))


def _base(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All calls, and the hits of a further alignment: the sample's hits at the next locus."""
    h = M.hits(spark, d)
    return table(calling.fill_loci(calling.call_loci(h), h, h), "filled"), _next_locus(h)


def _better(chosen: str) -> str:
    """SQL of a pass: the chosen calls replaced by strictly better ones of the further hits."""
    return f"""with {_DONE}, r as materialized (select *, {_RANK} as p from filled), o as materialized (select sample_id, {_NEXT} as locus, allele_id, call_type, confidence, {_RANK} as p from calls),
low as (select * from r where multiple_hits or call_type in ('novel', 'partial', 'missing') or (identity is not null and (identity < 98 or coverage < 0.98::double))), chosen as ({chosen}),
better as (select o.* from o join chosen using (sample_id, locus) join r b using (sample_id, locus) where o.p > b.p or o.p = b.p and o.confidence > b.confidence)
select b.sample_id, b.locus, case when n.p is null then b.allele_id else n.allele_id end as allele_id, coalesce(n.call_type, b.call_type) as call_type from r b left join better n using (sample_id, locus)"""


_CALL = ["sample_id", "locus", "allele_id", "call_type"]


# --- refinement passes: R1-R5, U1, O1-O4, U3 ---
@query(f"""with {M.HITS.replace("hits as (", "base_hits as (")}, seen as (select sample_id, locus, bool_or(identity >= 95 and coverage >= 0.95::double and (depth is null or depth >= 10)) as ok, max(coverage) as mc from base_hits group by all),
every as (select s.sample_id, l.locus from (select distinct sample_id from base_hits) s, (select distinct locus from base_hits) l), lost as (select every.* from every left join seen using (sample_id, locus) where not coalesce(ok or mc >= 0.475::double, false)),
few as (select sample_id from lost group by 1 having count(*) <= 3), top as (select sample_id, max(hit_ordinal) as last from base_hits group by 1),
hits as (select * from base_hits union all select h.* replace ({_NEXT.replace("locus", "h.locus")} as locus, h.hit_ordinal + top.last + 1 as hit_ordinal) from base_hits h join top using (sample_id) where h.sample_id in (select sample_id from few) and (h.sample_id, {_NEXT.replace("locus", "h.locus")}) in (select (sample_id, locus) from lost)){M.FILLED[len(M.HITS):]}
select sample_id, locus, allele_id, call_type from filled""")
def r1_missing_pass(spark, d):
    h = M.hits(spark, d)
    return passes.missing_pass(h, _next_locus(h), h, h, 3).select(*_CALL)


@query(_better("select sample_id, locus from (select *, row_number() over (partition by sample_id order by p, confidence, locus) as k from r where call_type = 'closest') where k <= 2"))
def r2_strict_pass(spark, d):
    return passes.strict_pass(*_base(spark, d), 2).select(*_CALL)


@query(_better("select sample_id, locus from (select *, row_number() over (partition by sample_id order by p, confidence, locus) as k from low) where k <= 3"))
def r3_low_confidence_pass(spark, d):
    return passes.low_confidence_pass(*_base(spark, d), 3).select(*_CALL)


@query(_better("select sample_id, locus from (select *, row_number() over (partition by sample_id order by case call_type when 'partial' then 0 when 'closest' then 1 when 'novel' then 2 when 'missing' then 3 else 4 end, coalesce(identity, 0) desc, coalesce(coverage, 0) desc, confidence desc, locus) as k from low) where k <= 2"))
def r3_ultrafast_pass(spark, d):
    return passes.low_confidence_pass(*_base(spark, d), 2, ultrafast=True).select(*_CALL)


@query(_better("select sample_id, locus from r where call_type in ('partial', 'closest')"))
def r4_budget_pass(spark, d):
    """Seven loci are within the adaptive budget, so all candidates are chosen; o3_adaptive_budget has larger samples."""
    return passes.budget_pass(*_base(spark, d)).select(*_CALL)


@query(_better("select sample_id, locus from (select *, count(*) over (partition by sample_id) as k from low) where k <= 4"))
def r5_fallback_pass(spark, d):
    return passes.fallback_pass(*_base(spark, d), 4).select(*_CALL)


_WIDE = M.CALLS.replace("l_orderkey as sample_id, 'L' || l_linenumber as locus", "l_suppkey % 40 as sample_id, 'P' || (l_partkey % (7 * (1 + l_suppkey % 40))) as locus")


@query(f"""with {_WIDE}, c as (select *, count(*) over (partition by sample_id) as n, row_number() over (partition by sample_id order by identity desc, coverage desc, confidence desc, locus) as place from calls where call_type in ('partial', 'closest'))
select sample_id, locus, place from c where place <= case when n <= 40 then n when n <= 120 then 40 when n <= 300 then 60 else 80 end""")
def o3_adaptive_budget(spark, d):
    sample, part = F.col("l_suppkey") % 40, F.col("l_partkey")
    h = M.hits_of(M.read(spark, d, "lineitem").withColumns({"s": sample, "l": F.concat(F.lit("P"), (part % (7 * (1 + sample))).cast("string"))}), "s", "l")
    return refine.second_pass(calling.call_loci(h)).select("sample_id", "locus", F.col("place").cast("long").alias("place"))


@query(f"with {M.FILLED} select sample_id, bool_or(call_type <> 'exact') as is_novel, bool_and(call_type not in ('missing', 'partial')) as is_complete, bool_or(multiple_hits) as conflicting from filled group by 1")
def p19_sample_flags(spark, d):
    h = M.hits(spark, d)
    return inputs.sample_flags(calling.fill_loci(calling.call_loci(h), h, h))


# --- files to calls: S6-S9, S4, O6, A9, F36 ---
_BY_PART = M.CALLS.replace("l_orderkey as sample_id, 'L' || l_linenumber as locus", "l_suppkey % 25 as sample_id, 'P' || (l_partkey % 30) as locus").replace("case when l_returnflag <> 'A' then l_quantity * 4 end as depth", "null::double as depth")


def _hit_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = M.read(spark, d, "lineitem").withColumns({"s": F.col("l_suppkey") % 25, "l": F.concat(F.lit("P"), (F.col("l_partkey") % 30).cast("string"))})
    return M.hits_of(lines, "s", "l")


def _written(spark: SparkSession, rows: DataFrame, line: list, name: str) -> str:
    """Lines as files in the shared folder, in the order of hits, a folder for each sample."""
    path = fresh_path(spark, name)
    out = rows.select("sample_id", "hit_ordinal", "allele_id", F.concat_ws("\t", *line).alias("value"))
    out.repartition("sample_id").sortWithinPartitions("sample_id", "hit_ordinal", "allele_id", "value").select("sample_id", "value").write.partitionBy("sample_id").text(path)
    return path


@query(f"with {_BY_PART} select sample_id, locus, allele_id, call_type, round(confidence, 9) as confidence, multiple_hits, allele_ids from calls")
def s6_blast_files(spark, d):
    """Hits written as tabular files, read and called."""
    rows, text = _hit_lines(spark, d), lambda c: F.col(c).cast("string")
    length = F.round(F.col("coverage") * 1000).cast("int").cast("string")
    plus = F.col("strand") == "+"
    line = [F.concat("locus", F.lit("_"), "allele_id"), text("query_contig"), text("identity"), length, F.lit("1000"), F.lit("1"), length, F.when(plus, text("query_start")).otherwise(text("query_end")), F.when(plus, text("query_end")).otherwise(text("query_start")), F.lit("0"), text("score")]
    path = _written(spark, rows, line, "blast")
    calls = calling.call_loci(T.read_blast(spark, path, rows.select("locus"), sample=F.col("sample_id").cast("long")))
    return calls.select("sample_id", "locus", "allele_id", "call_type", F.round("confidence", 9).alias("confidence"), "multiple_hits", F.array_join("allele_ids", ",").alias("allele_ids"))


@query("select l_suppkey % 25 as sample_id, 'P' || (l_partkey % 30) as locus, case when l_linenumber = 3 then '' else (l_partkey % 50 + 1)::varchar end as allele_id, round(l_quantity * 2, 6) as identity, round(l_discount * 10, 6) as coverage, l_extendedprice as score, case when l_linenumber < 4 then l_tax * 100 end as depth from lineitem where l_partkey % 30 < 20")
def s9_template_tables(spark, d):
    rows, text = _hit_lines(spark, d), lambda c: F.col(c).cast("string")
    raw = M.read(spark, d, "lineitem").withColumns({"sample_id": F.col("l_suppkey") % 25, "hit_ordinal": F.col("l_orderkey"), "allele_id": (F.col("l_partkey") % 50 + 1).cast("string"), "locus": F.concat(F.lit("P"), (F.col("l_partkey") % 30).cast("string"))})
    loci = rows.select("locus").filter(F.substring("locus", 2, 9).cast("int") < 20)
    template = F.when(F.col("l_linenumber") == 3, F.col("locus")).otherwise(F.concat("locus", F.lit("_"), "allele_id"))
    line = [template, text("l_extendedprice"), (F.col("l_quantity") * 2).cast("string"), F.lit("450"), (F.col("l_discount") * 1000).cast("string"), (F.col("l_tax") * 100).cast("string")]
    head = F.lit("#Template\tScore\tTemplate_Identity\tTemplate_length\tTemplate_Coverage\tDepth")
    paths = []
    for kind, part in (("fastq", raw.filter("l_linenumber < 4")), ("fasta", raw.filter("l_linenumber >= 4"))):
        first = part.select("sample_id").distinct().select("sample_id", F.lit(-1).cast("long").alias("hit_ordinal"), F.lit("").alias("allele_id"), head.alias("value"))
        body = part.select("sample_id", "hit_ordinal", "allele_id", F.concat_ws("\t", *line).alias("value"))
        paths.append((kind, _written(spark, first.unionByName(body), [F.col("value")], f"res-{kind}")))
    hits = [T.read_res(spark, p, loci, sample=F.col("sample_id").cast("long"), reads=kind == "fastq") for kind, p in paths]
    out = hits[0].unionByName(hits[1])
    return out.select("sample_id", "locus", "allele_id", F.round("identity", 6).alias("identity"), F.round("coverage", 6).alias("coverage"), "score", "depth")


@query("select doc_id, 'r' || doc_id as read_id, n_chars, substr(md5(text), 1, 8) as seq from documents where doc_id % 40 < 3")
def s4_fastq_reads(spark, d):
    """Reads written as FASTQ, read back, the first three of each file."""
    docs = M.read(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 40).alias("f"), F.concat(F.lit("@r"), F.col("doc_id").cast("string"), F.lit(" "), F.col("n_chars").cast("string"), F.lit("\n"), F.substring(F.md5("text"), 1, 8), F.lit("\n+\nIIIIIIII")).alias("value"))
    path = fresh_path(spark, "fastq")
    docs.repartition("f").sortWithinPartitions("f", "doc_id").select("f", "value").write.partitionBy("f").text(path)
    reads = T.read_fastq(spark, path, most_reads=3)
    n = F.substring("read_id", 2, 20).cast("long")
    names = M.read(spark, d, "documents").select("doc_id", "n_chars")
    return reads.select(n.alias("doc_id"), "read_id", "seq").join(names, "doc_id")


@query("with f as (select conv_id as sample_id, turn, len(text) * 40000 as bytes from conversations), n as (select *, sum(greatest(bytes // 250, 1)) over (partition by sample_id) * 150 / 5000000 as depth from f) select sample_id, turn, round(depth, 6) as depth, case when depth > 30 then 1000000 end as keep from n")
def o6_reads_to_keep(spark, d):
    files = M.read(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), "turn", (F.length("text") * 40000).cast("long").alias("bytes"))
    return inputs.reads_to_keep(files, 30.0).select("sample_id", "turn", F.round("depth", 6).alias("depth"), "keep")


@query("select count(*) as n_records, sum(len(text))::bigint as total_length, round(sum(len(text)) / 100000, 6) as coverage from documents")
def a9_estimated_coverage(spark, d):
    return inputs.estimated_coverage(M.read(spark, d, "documents").select(F.col("text").alias("seq")), 100_000).withColumn("coverage", F.round("coverage", 6))


@query("select greatest(count(*) filter (trim(url) <> '') - 1, 0)::bigint as n_profiles from pages")
def a8_profile_rows(spark, d):
    return inputs.profile_rows(M.read(spark, d, "pages").select(F.col("url").alias("value")))


@query("select source as file, md5(string_agg(text, '' order by doc_id)) as digest from documents group by 1")
def a23_joined_sequences(spark, d):
    rows = M.read(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("ordinal"), F.col("text").alias("seq"))
    return inputs.joined_sequence(rows).select("file", F.md5("seq").alias("digest"))


@query("""with f as (select doc_id, unnest(string_split(text, chr(10))) as v, doc_id % 3 as k from documents) , l as (select doc_id, case when k = 0 then '>' || v else v end as v from f union all select doc_id, '>h' from f where k = 1)
select doc_id as file, bool_or(starts_with(trim(v), '>')) and bool_or(trim(v) <> '' and not starts_with(trim(v), '>')) as valid from l group by 1""")
def p18_valid_fasta(spark, d):
    rows = M.read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("v"), (F.col("doc_id") % 3).alias("k"))
    lines = rows.select(F.col("doc_id").alias("file"), F.when(F.col("k") == 0, F.concat(F.lit(">"), "v")).otherwise(F.col("v")).alias("value")).unionByName(rows.filter("k = 1").select(F.col("doc_id").alias("file"), F.lit(">h").alias("value")))
    return inputs.valid_fasta(lines)


@query("""with r as (select (doc_id % 97)::varchar as sample_id, doc_id as o, substr(replace(text, chr(10), 'N'), 1, 20 + (doc_id % 97) * 12) as seq from documents where doc_id % 97 <> 5 union all select '5', 0, 'ACGT'), m as (select sample_id, max(len(seq)) as longest, sum(len(seq)) as total, string_agg(seq, '' order by o) as whole from r group by 1),
c as (select r.sample_id, o, r.seq from r where len(seq) >= 400 union all select sample_id, i, substr(whole, (i * 1000 + 1)::bigint, 1000) from m, range(0, 100000) t(i) where longest < 400 and total >= 400 and i * 1000 < total and least(1000, total - i * 1000) >= 400 union all select sample_id, 0, repeat('A', 400) from m where longest < 400 and total < 400)
select sample_id, sample_id || '_contig_' || row_number() over (partition by sample_id order by o) as contig_id, md5(seq) as digest from c""")
def f36_fallback_contigs(spark, d):
    docs = M.read(spark, d, "documents")
    k = F.col("doc_id") % 97
    reads = docs.filter(k != 5).select(k.cast("string").alias("sample_id"), F.col("doc_id").alias("read_ordinal"), F.substring(F.replace("text", F.lit("\n"), F.lit("N")), F.lit(1), (20 + k * 12).cast("int")).alias("seq"))
    reads = reads.unionByName(spark.createDataFrame([("5", 0, "ACGT")], "sample_id string, read_ordinal long, seq string"))
    return inputs.fallback_contigs(reads, 400).select("sample_id", "contig_id", F.md5("seq").alias("digest"))


# --- inputs, decisions, tables: J17, F34, P13, O7, O9, P14, P15, P22, U2 ---
@query("""with f as (select o_orderkey as ordinal, 'iso' || (o_custkey % 400) || case o_orderkey % 4 when 0 then '_R1.fastq.gz' when 1 then '_R2.fastq.gz' when 2 then '.fasta' else '_S1_L001_R1_001.fq' end as name, 'iso' || (o_custkey % 400) || case when o_orderkey % 4 = 3 then '_S1_L001' else '' end as pair, case o_orderkey % 4 when 0 then 1 when 1 then 2 when 3 then 1 end as mate from orders),
p as (select pair, max_by(name, ordinal) filter (mate = 1) as r1, max_by(name, ordinal) filter (mate = 2) as r2, min(ordinal) as ordinal from f where mate is not null group by 1 having count(*) filter (mate = 1) > 0 and count(*) filter (mate = 2) > 0)
select ordinal, pair as sample_id, r1 as name, r2 as mate from p union all select ordinal, regexp_extract(name, '^(iso[0-9]+)', 1), name, null from f where mate is null or pair not in (select pair from p)""")
def j17_pair_mates(spark, d):
    o = M.read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("iso"), (F.col("o_custkey") % 400).cast("string")).alias("s"))
    k = F.col("o_orderkey") % 4
    ending = F.when(k == 0, "_R1.fastq.gz").when(k == 1, "_R2.fastq.gz").when(k == 2, ".fasta").otherwise("_S1_L001_R1_001.fq")
    return inputs.pair_mates(o.select(F.concat("s", ending).alias("name"), F.col("o_orderkey").alias("ordinal")))


@query("""with r as (select c_custkey as run, c_custkey % 3 as good, c_custkey % 4 as bad, (['input', 'assembly', 'prediction', 'unknown', 'other'])[c_custkey % 5 + 1] as stage, c_custkey % 2 = 0 as strict from customer), e as (select *, (MAP {'input': 2, 'assembly': 3, 'prediction': 4})[stage] as code from r)
select run, case when bad = 0 or good > 0 and not strict then 0 else coalesce(code, 5) end as exit_code, case when bad = 0 then 'all_succeeded' when good = 0 then 'all_failed_' || stage when strict then 'partial_failed_strict_' || stage else 'partial_failed_allowed' end as reason, case when bad > 0 then stage end as stage from e""")
def f34_exit_decisions(spark, d):
    k = F.col("c_custkey")
    stage = F.element_at(F.array(*[F.lit(x) for x in ("input", "assembly", "prediction", "unknown", "other")]), (k % 5 + 1).cast("int"))
    runs = M.read(spark, d, "customer").select(k.alias("run"), (k % 3).alias("succeeded"), (k % 4).alias("failed"), stage.alias("stage"), (k % 2 == 0).alias("strict"))
    return inputs.exit_decision(runs, F.col("strict"))


@query("""with s as (select c_custkey, (['mlst', 'cgmlst', 'wgmlst', 'rmlst', null])[c_custkey % 5 + 1] as t, case when c_custkey % 2 = 0 then 'mlst' else 'cgmlst' end as mode from customer)
select c_custkey, t is not null and (mode = 'mlst' and t <> 'mlst' or mode = 'cgmlst' and t not in ('cgmlst', 'wgmlst')) as refused, case when t in ('mlst', 'cgmlst', 'wgmlst') then t else mode end as effective from s""")
def p13_scheme_modes(spark, d):
    k = F.col("c_custkey")
    t = F.element_at(F.array(*[F.lit(x) for x in ("mlst", "cgmlst", "wgmlst", "rmlst")], F.lit(None).cast("string")), (k % 5 + 1).cast("int"))
    mode = F.when(k % 2 == 0, "mlst").otherwise("cgmlst")
    return M.read(spark, d, "customer").select("c_custkey", inputs.mode_problem(t, mode).alias("refused"), inputs.effective_type(t, mode).alias("effective"))


@query("with t as (select s_suppkey as k, case when s_suppkey % 5 = 0 then s_name when s_suppkey % 7 = 0 then '' else (s_acctbal)::varchar end as cell from supplier) select k, row_number() over (order by try_cast(case when cell = '' then '0' else cell end as double) is null desc, try_cast(case when cell = '' then '0' else cell end as double) desc, lower(cell) desc, k) as place from t")
def o7_sorted_rows(spark, d):
    s = M.read(spark, d, "supplier")
    k = F.col("s_suppkey")
    rows = s.select(k.alias("k"), F.when(k % 5 == 0, F.col("s_name")).when(k % 7 == 0, "").otherwise(F.col("s_acctbal").cast("string")).alias("cell"))
    ordered = table(inputs.sorted_rows(rows, "cell", "k", descending=True).select("k", F.monotonically_increasing_id().alias("at")), "sorted")
    from typeloom.operators.ordering import numbered

    return numbered(ordered, ["at"], "place").select("k", "place")


@query("select s_suppkey from supplier where contains(lower(s_name || ' ' || s_suppkey), 'r#0') or contains(lower(s_name || ' ' || s_suppkey), '1 1')")
def p15_matching_rows(spark, d):
    s = M.read(spark, d, "supplier").select("s_name", "s_suppkey")
    one, two = (inputs.matching_rows(s, words, ["s_name", "s_suppkey"]) for words in (" R#0", "1 1 "))
    return one.union(two).select("s_suppkey").distinct()


@query("select count(*) filter (l_quantity <= 7) as rounded, count(*) as every, count(*) as negative from lineitem")
def p14_light_edges(spark, d):
    e = M.read(spark, d, "lineitem").select(F.col("l_quantity").alias("weight"))
    count = lambda most, name: inputs.light_edges(e, most).agg(F.count("*").alias(name))
    return count(" 7.9 ", "rounded").join(count("x", "every")).join(count("-1", "negative"))


# --- trees: G3, G5, W9, F31, G8; edge lengths F32 ---
def _nodes(spark, d):
    from typeloom.operators import matrix

    return matrix.collapse(table(matrix.to_profiles(M.matrix(spark, d)), "profiles")).select(F.col("sample_ordinal").alias("id"), "label", "profile", F.col("duplicates").alias("member_count"))


@query(None)
def g3_recrafted_tree(spark, d):
    """The minimum arborescence with its branches hung anew."""
    from typeloom.operators.recraft import recrafted_tree

    return recrafted_tree(_nodes(spark, d).drop("member_count"), force=True)


@query(None)
def g5_weighted_tree(spark, d):
    """The weighted tree with shortcuts, hung anew."""
    from typeloom.operators.recraft import weighted_tree

    return weighted_tree(_nodes(spark, d), force=True)


@query("select unnest(['kruskal', 'spanning', 'recrafted', 'weighted']) as tree, 0 as edge_count_off, 0 as self_loops, 0 as extra_components")
def g8_tree_faults(spark, d):
    from typeloom.operators import graph, recraft

    nodes = table(_nodes(spark, d), "nodes")
    return graph.forest_faults(nodes, table(recraft.every_tree(nodes, True), "trees"), list(recraft.TREES))


@query("with e as (select l_orderkey, l_linenumber, greatest(1, case when l_quantity::int % 9 = 0 then 1 else l_quantity end) as w, l_linenumber as members from lineitem) select l_orderkey, l_linenumber, 50 * w as linear, round(50 * log2(w + 1), 6) as log, round(50 * sqrt(w), 6) as sqrt, round(least(22, 7 + sqrt(greatest(1, members)) * 3), 6) as scaled, case when members > 1 then 11.0::double else 8.0::double end as plain from e")
def f32_edge_lengths(spark, d):
    from typeloom.functions import layout as Y

    q = F.col("l_quantity")
    w = F.when(q.cast("int") % 9 == 0, 0.0).otherwise(q)
    six = lambda c: F.round(c, 6)
    return M.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", Y.edge_length(w, "linear").alias("linear"), six(Y.edge_length(w, "log")).alias("log"), six(Y.edge_length(w, "sqrt")).alias("sqrt"), six(Y.node_radius(F.col("l_linenumber"), True)).alias("scaled"), Y.node_radius(F.col("l_linenumber"), False).alias("plain"))


# --- comparison lists J5, catalogue by availability P10, metadata A11 J4, class tables J12, heat map, missing loci ---
@query(f"""with {M.MATRIX}, l as (select sample, locus_ordinal, value from mtx where sample_ordinal % 10 <> 0 and locus_ordinal <> sample_ordinal % 7 + 1), r as (select sample, locus_ordinal, other from mtx where sample_ordinal % 7 <> 0),
j as (select coalesce(l.sample, r.sample) as sample, coalesce(l.locus_ordinal, r.locus_ordinal) as locus, coalesce(value, '') as a, coalesce(other, '') as b from l full join r on l.sample = r.sample and l.locus_ordinal = r.locus_ordinal)
select sample as sample_id, coalesce(string_agg(locus || ':' || a || ':' || b, ',' order by locus::varchar) filter (a <> b), '') as loci from j where sample in (select sample from l) and sample in (select sample from r) group by 1""")
def j5_differing_loci(spark, d):
    from typeloom.operators import compare

    m = M.matrix(spark, d).withColumnRenamed("sample", "sample_id").withColumn("locus", F.col("locus_ordinal").cast("string"))
    left = m.filter("sample_ordinal % 10 <> 0 and locus_ordinal <> sample_ordinal % 7 + 1")
    right = m.filter("sample_ordinal % 7 <> 0").drop("value").withColumnRenamed("other", "value")
    found = compare.differing_loci(left, right)
    return found.select("sample_id", F.array_join(F.transform("loci", lambda x: F.concat_ws(":", x["locus"], x["left"], x["right"])), ",").alias("loci"))


@query(f"with {M.CATALOG} select row_ordinal from cat where regexp_matches(organism, '(?i)^(listeria|vibrio)') and row_ordinal % 3 = 0")
def p10_organisms(spark, d):
    from typeloom.operators import catalog

    c = M.catalog(spark, d)
    return catalog.organism_like(c, "^(listeria|vibrio)", c.filter("row_ordinal % 3 = 0")).select("row_ordinal")


@query(f"with {M.MATRIX} select locus_ordinal, count(*) as n, count(*) filter (upper(trim(value)) in ('', '-', 'LNF', 'NIPH', 'NIPHEM', 'ASM', 'ALM', 'PLOT3', 'PLOT5', 'LOTSC', 'PAMA', 'PLNF')) as missing from mtx group by 1")
def a24_missing_by_locus(spark, d):
    from typeloom.operators import compare

    return compare.missing_summary(M.matrix(spark, d))


@query(f"with {M.MATRIX} select sample, locus_ordinal, value, case when upper(trim(value)) in ('', '-', 'LNF', 'NIPH', 'NIPHEM', 'ASM', 'ALM', 'PLOT3', 'PLOT5', 'LOTSC', 'PAMA', 'PLNF') then 'missing_token' else 'present_allele' end as state from mtx")
def g13_heat_map(spark, d):
    from typeloom.operators import matrix

    return matrix.heatmap(M.matrix(spark, d))


@query("""with a as (select (['LNF', '7', 'INF-3', 'NIPH', '-'])[p_partkey % 5 + 1] as la, (['LNF', '8', 'INF-3', 'PLOT5', ''])[p_size % 5 + 1] as lb from part),
b as (select *, case when la in ('', '-') then 'LNF' when la = '7' then 'NUMERIC' when la = 'INF-3' then 'INF' else la end as bucket_a, case when lb in ('', '-') then 'LNF' when lb = '8' then 'NUMERIC' when lb = 'INF-3' then 'INF' else lb end as bucket_b from a)
select bucket_a, bucket_b, count(*) as n, count(*) filter (la = lb) as same_label from b group by all""")
def j12_class_agreement(spark, d):
    from typeloom.operators import compare

    part = M.read(spark, d, "part").withColumn("key", F.col("p_partkey"))
    pick = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), (at % 5 + 1).cast("int"))
    a = part.select("key", pick(("LNF", "7", "INF-3", "NIPH", "-"), F.col("p_partkey")).alias("label"))
    b = part.select("key", pick(("LNF", "8", "INF-3", "PLOT5", ""), F.col("p_size")).alias("label"))
    return compare.class_agreement(a, b)


@query("""with p as (select l_suppkey % 10 as profile_key, l_orderkey * 8 + l_linenumber as o, unnest(['mode', 'flag']) as field, unnest([case when l_linestatus = 'O' then ' ' else l_linestatus || l_linenumber end, l_returnflag]) as value from lineitem),
s as (select profile_key, field, value, min(o) as o from p where trim(value) <> '' group by all) select profile_key, field, string_agg(value, ' | ' order by o, value) as value from s group by all""")
def a11_joined_metadata(spark, d):
    from typeloom.operators import matrix

    line = M.read(spark, d, "lineitem")
    fields = F.explode(F.array(F.struct(F.lit("mode").alias("field"), F.when(F.col("l_linestatus") == "O", " ").otherwise(F.concat("l_linestatus", F.col("l_linenumber").cast("string"))).alias("value")), F.struct(F.lit("flag").alias("field"), F.col("l_returnflag").alias("value")))).alias("x")
    return matrix.collapse_metadata(line.select((F.col("l_suppkey") % 10).alias("profile_key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample_ordinal"), fields).select("profile_key", "sample_ordinal", "x.*"))
