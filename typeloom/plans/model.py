"""A typing model over the general tables: each binding as a DataFrame, and as SQL for the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment hits: an order is a sample, a line number a locus, a part an allele."""
    lines = read(spark, sf_dir, "lineitem").withColumn("locus", F.concat(F.lit("L"), F.col("l_linenumber").cast("string")))
    return hits_of(lines, "l_orderkey", "locus")


def hits_of(lines: DataFrame, sample: str, locus: str) -> DataFrame:
    """Hits of the lines, with these columns as sample and locus."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    identity = F.when(q >= 26, 100.0).when(q >= 6, 95 + q / 10).otherwise(88 + q)
    coverage = F.when(d < 0.05, 1.0).when(d < 0.08, 0.96).otherwise(0.40 + 5 * F.col("l_tax"))
    rows = lines.select(
        F.col(sample).alias("sample_id"), F.col(locus).alias("locus"), (F.col("l_partkey") % 50 + 1).cast("string").alias("allele_id"),
        identity.alias("identity"), coverage.alias("coverage"), F.when(F.col("l_returnflag") != "A", q * 4).alias("depth"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        (F.col("l_suppkey") % 5).alias("query_contig"), (F.col("l_partkey") % 90).alias("query_start"), (F.col("l_partkey") % 90 + F.col("l_suppkey") % 40 + 1).alias("query_end"),
        F.floor(F.col("l_extendedprice") * 100).alias("hit_ordinal"), (F.col("l_suppkey") % 60 + 60).alias("contig_length"), (F.col("l_partkey") % 40 + 80).alias("allele_length"),
    )
    return rows.withColumn("score", F.col("identity") * F.col("coverage"))


HITS = """hits as (select *, identity * coverage as score from (select l_orderkey as sample_id, 'L' || l_linenumber as locus, cast(l_partkey % 50 + 1 as varchar) as allele_id,
 case when l_quantity >= 26 then 100.0::double when l_quantity >= 6 then 95 + l_quantity / 10 else 88 + l_quantity end as identity,
 case when l_discount < 0.05::double then 1.0::double when l_discount < 0.08::double then 0.96::double else 0.40::double + 5 * l_tax end as coverage,
 case when l_returnflag <> 'A' then l_quantity * 4 end as depth, case when l_linestatus = 'O' then '+' else '-' end as strand,
 l_suppkey % 5 as query_contig, l_partkey % 90 as query_start, l_partkey % 90 + l_suppkey % 40 + 1 as query_end, floor(l_extendedprice * 100)::bigint as hit_ordinal,
 l_suppkey % 60 + 60 as contig_length, l_partkey % 40 + 80 as allele_length from lineitem))"""

CALLS = HITS + """,
valid as (select *, identity >= 95 and coverage >= 0.95::double and (depth is null or depth >= 10) as ok, identity = 100 and coverage >= 1 as ex from hits),
ranked as (select *, row_number() over (partition by sample_id, locus order by score desc, coverage desc, identity desc, coalesce(depth, 0) desc, hit_ordinal, allele_id) as r,
 row_number() over (partition by sample_id, locus, ok order by score desc, coverage desc, identity desc, coalesce(depth, 0) desc, hit_ordinal, allele_id) as rv from valid),
firsts as (select sample_id, locus, allele_id, min(r) as r from ranked where ok and ex group by all),
ids as (select sample_id, locus, string_agg(allele_id, ',' order by r) as ids, count(*) as n from firsts group by all),
grp as (select sample_id, locus, bool_or(ok) as ok, max(coverage) as mc from ranked group by all),
b as (select g.sample_id, g.locus, g.ok, g.mc, x.allele_id, x.identity, x.coverage, x.depth, coalesce(i.ids, '') as ids, coalesce(i.n, 0) as n from grp g
 join ranked x on g.sample_id = x.sample_id and g.locus = x.locus and case when g.ok then x.ok and x.rv = 1 else x.r = 1 end left join ids i on g.sample_id = i.sample_id and g.locus = i.locus),
calls as (select sample_id, locus, case when ok or mc >= 0.475::double then allele_id end as allele_id,
 case when not ok then case when mc >= 0.475::double then 'partial' else 'missing' end when identity = 100 and coverage >= 1 then 'exact' when identity = 100 and coverage < 1 then 'partial'
  when identity >= 95 and coverage >= 0.95::double then 'closest' when coverage >= 0.95::double then 'novel' when coverage > 0 then 'partial' else 'missing' end as call_type,
 case when not ok and mc < 0.475::double then 0.0::double when depth is null then identity / 100 * coverage when depth > 300 then identity / 100 * coverage * least(depth / 30, 1.0::double) * 0.9::double else identity / 100 * coverage * least(depth / 30, 1.0::double) end as confidence,
 case when ok or mc >= 0.475::double then identity end as identity, case when ok or mc >= 0.475::double then coverage end as coverage,
 ok and n > 1 as multiple_hits, case when ok then ids when mc >= 0.475::double then allele_id else '' end as allele_ids from b)"""

FILLED = CALLS + """,
grid as (select s.sample_id, l.locus from (select distinct sample_id from hits) s, (select distinct locus from hits) l),
filled as (select g.sample_id, g.locus, c.allele_id, coalesce(c.call_type, 'missing') as call_type, coalesce(c.confidence, 0) as confidence, c.identity, c.coverage, coalesce(c.multiple_hits, false) as multiple_hits, coalesce(c.allele_ids, '') as allele_ids
 from grid g left join calls c on g.sample_id = c.sample_id and g.locus = c.locus)"""

KEYS = FILLED + """,
keyed as (select sample_id, string_agg(coalesce(allele_id, '-'), '|' order by locus) as profile, bool_or(multiple_hits) as conflicting, bool_or(call_type <> 'exact') as inexact from filled group by 1),
profiles as (select profile, min(sample_id) as st from keyed group by 1 having count(*) > 1)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complete profile matrix in long form: suppliers by line numbers, with marked and missing values."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.min("l_partkey").alias("q"))
    v = (F.col("p") % 4 + 1).cast("string")
    value = F.when(F.col("q") % 11 == 0, "LNF").when(F.col("q") % 13 == 0, F.concat(F.lit("~"), v)).when(F.col("q") % 17 == 0, F.concat(F.lit("INF-"), v)).when(F.col("q") % 19 == 0, F.concat(v, F.lit("?"))).otherwise(v)
    return rows.select(F.col("l_suppkey").alias("sample_ordinal"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("sample"), F.col("l_linenumber").cast("long").alias("locus_ordinal"), value.alias("value"), (F.col("q") % 4 + 1).cast("string").alias("other"))


MATRIX = """mtx as (select l_suppkey as sample_ordinal, 's' || l_suppkey as sample, l_linenumber::bigint as locus_ordinal,
 case when q % 11 = 0 then 'LNF' when q % 13 = 0 then '~' || (p % 4 + 1) when q % 17 = 0 then 'INF-' || (p % 4 + 1) when q % 19 = 0 then (p % 4 + 1) || '?' else (p % 4 + 1)::varchar end as value, (q % 4 + 1)::varchar as other
 from (select l_suppkey, l_linenumber, max(l_partkey) as p, min(l_partkey) as q from lineitem group by all)),
cleaned as (select *, regexp_replace(regexp_replace(regexp_replace(trim(value), '^~', ''), '\\?$', ''), '^INF-', '') as v from mtx),
cells as (select *, case when upper(v) in ('', '-', 'LNF', 'NIPH', 'NIPHEM', 'ASM', 'ALM', 'PLOT3', 'PLOT5', 'LOTSC', 'PAMA', 'PLNF') then null else v end as c from cleaned)"""


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele sequences: benchmark texts, four to a locus; other letters than A, C, G, T act as unknown."""
    rows = read(spark, sf_dir, "benchmark")
    return rows.select(F.concat(F.lit("g"), (F.col("item_id") % 7).cast("string")).alias("locus"), F.col("item_id").cast("string").alias("allele_id"), F.col("text").alias("seq"), F.col("item_id").alias("allele_ordinal"))


ALLELES = "al as (select 'g' || item_id % 7 as locus, item_id::varchar as allele_id, text as seq, item_id as allele_ordinal from benchmark)"


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes: documents of a source as a sample."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("sample_id"), F.col("doc_id").alias("gene_ordinal"), F.col("text").alias("seq"), F.col("lang"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows: customers as schemes."""
    c = read(spark, sf_dir, "customer")
    organism = F.element_at(F.array(*[F.lit(x) for x in ORGANISMS]), (F.col("c_custkey") % len(ORGANISMS) + 1).cast("int"))
    described = F.element_at(F.array(*[F.lit(x) for x in DESCRIPTIONS]), (F.col("c_custkey") % len(DESCRIPTIONS) + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("row_ordinal"), organism.alias("organism"), described.alias("description"), F.concat(F.lit("x_"), F.col("c_custkey").cast("string")).alias("scheme_name"), F.concat(F.lit("p"), (F.col("c_custkey") % 4).cast("string")).alias("provider"))


ORGANISMS = ("Listeria monocytogenes", "Salmonella spp.", "Escherichia coli/shigella", "Vibrio", "  Staphylococcus aureus ", "", "Campylobacter jejuni/coli", "Klebsiella pneumoniae species complex")
DESCRIPTIONS = ("MLST", "cgMLST v2", "Whole genome MLST", "virulence genes", "core-genome scheme", "ribosomal", "plasmid MLST", "whole-genome", "antibiotic resistance", "MLST (Achtman)", "other")
CATALOG = f"""cat as (select c_custkey as row_ordinal, ({list(ORGANISMS)!r})[(c_custkey % {len(ORGANISMS)}) + 1] as organism, ({list(DESCRIPTIONS)!r})[(c_custkey % {len(DESCRIPTIONS)}) + 1] as description,
 'x_' || c_custkey as scheme_name, 'p' || c_custkey % 4 as provider from customer)"""
