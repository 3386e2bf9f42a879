"""Samples and schemes before typing: mates, subsampling, checks, fallback contigs, counts, and decisions after a run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from typeloom.functions.names import mate_of, sample_id
from typeloom.operators.ordering import running_sums

#: Assumed genome size, bytes and bases of a read; exit codes of stages; chunks of fallback contigs.
GENOME, READ_BYTES, READ_BASES = 5_000_000, 250, 150
EXIT_CODES = {"input": 2, "assembly": 3, "prediction": 4, "unknown": 5}
CHUNK = 1000


def pair_mates(files: DataFrame) -> DataFrame:
    """(name, ordinal): one row for each input. Mates 1 and 2 of a key become one input where the first of them stands, if
    both are there (the last file of a mate counts); all other files are inputs of their own."""
    pair, mate = mate_of(F.col("name"))
    rows = files.select("name", "ordinal", pair.alias("pair"), mate.alias("mate"))
    last = lambda m: F.max_by("name", F.when(F.col("mate") == m, F.col("ordinal")))
    pairs = rows.filter("pair is not null").groupBy("pair").agg(last(1).alias("r1"), last(2).alias("r2"), F.min("ordinal").alias("first")).filter("r1 is not null and r2 is not null")
    single = rows.join(pairs.select("pair"), "pair", "left_anti")
    both = pairs.select(F.col("first").alias("ordinal"), F.col("r1").alias("name"), F.col("r2").alias("mate"))
    out = both.unionByName(single.select("ordinal", "name", F.lit(None).cast("string").alias("mate")))
    return out.select("ordinal", sample_id(F.col("name")).alias("sample_id"), "name", "mate")


def reads_to_keep(files: DataFrame, most_depth: float) -> DataFrame:
    """(sample_id, file, bytes): how many first reads of each file are kept (null: all). The estimated depth is of reads of
    READ_BYTES bytes, one at least for each file."""
    n = F.sum(F.greatest(F.floor(F.col("bytes") / READ_BYTES), F.lit(1))).over(W.partitionBy("sample_id"))
    return files.withColumn("depth", n * READ_BASES / GENOME).withColumn("keep", F.when(F.col("depth") > most_depth, F.lit(int(most_depth * GENOME / READ_BASES)).cast("long")))


def estimated_coverage(records: DataFrame, genome_size: int) -> DataFrame:
    """One row: records, their total length, and that over the genome's size (0 if the size is none)."""
    total = F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long")
    return records.agg(F.count("*").alias("n_records"), total.alias("total_length"), (total / genome_size if genome_size > 0 else F.lit(0.0)).cast("double").alias("coverage"))


def profile_rows(lines: DataFrame) -> DataFrame:
    """Profiles of a table's lines: those that aren't blank, without the header."""
    return lines.agg(F.greatest(F.count_if(F.trim("value") != "") - 1, F.lit(0)).cast("long").alias("n_profiles"))


def joined_sequence(records: DataFrame) -> DataFrame:
    """(file, ordinal, seq): all records of each file in one sequence. A file's records are one row by definition."""
    return records.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "seq"))), lambda x: x["seq"]), "").alias("seq"))


def valid_fasta(lines: DataFrame) -> DataFrame:
    """(file, value): does each file hold a header and some sequence?"""
    v = F.trim("value")
    return lines.groupBy("file").agg((F.coalesce(F.bool_or(v.startswith(">")), F.lit(False)) & F.coalesce(F.bool_or((v != "") & ~v.startswith(">")), F.lit(False))).alias("valid"))


def fallback_contigs(reads: DataFrame, min_len: int) -> DataFrame:
    """(sample_id, read_ordinal, seq): contigs without an assembler. Reads of `min_len` or more; without any, all reads put
    together and cut into chunks of CHUNK or `min_len` (rests shorter than `min_len` go); else one of A only.

    Reads are cut where they lie by the sum of the lengths before them, so a sample's reads need not be one row.
    """
    rows = reads.select("sample_id", "read_ordinal", "seq", F.length("seq").alias("n"))
    mine = rows.groupBy("sample_id").agg(F.max("n").alias("longest"), F.sum("n").alias("total"))
    long = rows.filter(F.col("n") >= min_len).select("sample_id", F.col("read_ordinal").alias("o"), "seq")
    size = max(min_len, CHUNK)
    short = rows.join(mine.filter((F.col("longest") < min_len) & (F.col("total") >= min_len)), "sample_id")
    placed = running_sums(short, ["sample_id", "read_ordinal"], {"ahead": F.col("n").cast("long")})
    first = placed.groupBy("sample_id").agg(F.min("ahead").alias("first"))
    placed = placed.join(first, "sample_id").withColumn("at", F.col("ahead") - F.col("first")).filter("n > 0")
    parts = placed.withColumn("o", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))))
    begin = F.greatest(F.col("o") * size - F.col("at"), F.lit(0)).cast("int")
    stop = F.least((F.col("o") + 1) * size - F.col("at"), F.col("n")).cast("int")
    cut = parts.select("sample_id", "o", "at", F.substring(F.col("seq"), begin + 1, stop - begin).alias("part"))
    chunks = cut.groupBy("sample_id", "o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("seq")).filter(F.length("seq") >= min_len)
    none = mine.filter((F.coalesce("longest", F.lit(0)) < min_len) & (F.coalesce("total", F.lit(0)) < min_len)).select("sample_id", F.lit(0).cast("long").alias("o"), F.repeat(F.lit("A"), F.lit(min_len)).alias("seq"))
    out = long.select("sample_id", F.col("o").cast("long").alias("o"), "seq").unionByName(chunks).unionByName(none)
    return out.withColumn("k", F.row_number().over(W.partitionBy("sample_id").orderBy("o"))).select("sample_id", F.concat("sample_id", F.lit("_contig_"), F.col("k").cast("string")).alias("contig_id"), "seq")


def exit_decision(runs: DataFrame, fail_on_error: Column) -> DataFrame:
    """(run, succeeded, failed, stage): exit code, reason and stage of each run; see primary_stage for the stage."""
    code = F.coalesce(*[F.when(F.col("stage") == s, c) for s, c in EXIT_CODES.items()], F.lit(5))
    none, all_ = F.col("failed") == 0, F.col("succeeded") == 0
    reason = F.when(none, "all_succeeded").when(all_, F.concat(F.lit("all_failed_"), F.col("stage"))).when(fail_on_error, F.concat(F.lit("partial_failed_strict_"), F.col("stage"))).otherwise("partial_failed_allowed")
    return runs.select("run", F.when(none, 0).when(all_ | fail_on_error, code).otherwise(0).alias("exit_code"), reason.alias("reason"), F.when(~none, F.col("stage")).alias("stage"))


def mode_problem(scheme_type: Column, mode: Column) -> Column:
    """Does the mode refuse a scheme of this type? An unknown type is never refused."""
    return F.coalesce(((mode == "mlst") & (scheme_type != "mlst")) | ((mode == "cgmlst") & ~scheme_type.isin("cgmlst", "wgmlst")), F.lit(False))


def effective_type(scheme_type: Column, mode: Column) -> Column:
    return F.when(scheme_type.isin("mlst", "cgmlst", "wgmlst"), scheme_type).otherwise(F.when(mode == "cgmlst", "cgmlst").otherwise("mlst"))


def seqdef_database(databases: DataFrame, scheme: str, base: str) -> DataFrame:
    """(ordinal, name, href, description, organism, organism_base): the first of the best candidates for a scheme, one row at
    most. Exact names come first, then the mapped organism's, then names and then descriptions that hold it."""
    low = scheme.lower()
    hold = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(low))
    rank = F.when((F.col("name") == f"pubmlst_{low}_seqdef") | (F.col("name") == base), 1).when((F.coalesce("organism_base", F.lit("")) != "") & (F.lower("organism_base") == low), 2).when(hold("name"), 3).when(hold("description") | hold("organism"), 4)
    found = databases.filter(F.col("name").contains("seqdef")).withColumn("rank", rank).filter("rank is not null")
    return found.agg(F.min(F.struct("rank", "ordinal", "href", "name")).alias("b")).filter("b is not null").select("b.href", "b.name", "b.rank")


def sorted_rows(rows: DataFrame, by: str, ordinal: str, descending: bool = False) -> DataFrame:
    """A table by one text column: numbers by value (blank is 0) before text, equal cells in the order they came."""
    n = F.when(F.trim(F.coalesce(F.col(by), F.lit(""))) == "", 0.0).otherwise(F.trim(by).try_cast("double"))
    keys = [n.isNull(), n, F.lower(by)]
    return rows.orderBy(*[k.desc() if descending else k.asc() for k in keys], ordinal)


def matching_rows(rows: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Rows whose columns, put together with spaces, hold the words, letters in either case; no words: all rows."""
    low = words.strip().lower()
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return rows.filter(F.contains(text, F.lit(low))) if low else rows


def light_edges(edges: DataFrame, most: str | None) -> DataFrame:
    """Edges up to a weight, given as text and rounded down; blank, negative or no number: all."""
    try:
        limit = float((most or "").strip())
    except ValueError:
        return edges
    return edges.filter(F.col("weight") <= math.floor(limit)) if 0 <= limit < math.inf else edges


def with_novel(source: DataFrame, novel: DataFrame) -> DataFrame:
    """U2: rows of a scheme and novel ones, source first; `from_novel` tells them apart."""
    return source.withColumn("from_novel", F.lit(False)).unionByName(novel.withColumn("from_novel", F.lit(True)), allowMissingColumns=True)


def novel_calls(calls: DataFrame) -> DataFrame:
    return calls.filter((F.col("call_type") == "novel") & (F.coalesce("novel_sequence", F.lit("")) != ""))


def sample_flags(calls: DataFrame) -> DataFrame:
    """sample_id, is_novel (some locus isn't exact), is_complete (none is missing or partial), conflicting (several exact alleles at some locus)."""
    return calls.groupBy("sample_id").agg(F.bool_or(F.col("call_type") != "exact").alias("is_novel"), F.bool_and(~F.col("call_type").isin("missing", "partial")).alias("is_complete"), F.bool_or("multiple_hits").alias("conflicting"))
