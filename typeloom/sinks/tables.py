"""Rows of text and JSON outputs, and writers of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions.labels import format_cell
from typeloom.functions.sequences import wrapped_fasta


def typing_rows(calls: DataFrame, types: DataFrame, scheme: str, count_same_copy: bool = False) -> DataFrame:
    """The typing table's lines: sample, scheme, ST (- if a call is not exact or copies conflict), cells by locus."""
    cell = format_cell(F.col("call_type"), F.col("allele_id"), F.col("allele_ids"), F.col("multiple_hits"), F.col("copy_count"), F.lit(None).cast("string"), count_same_copy)
    rows = calls.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("locus", cell.alias("c")))).alias("cells")).join(types.select("sample_id", "st", "conflicting", "inexact"), "sample_id")
    st = F.when(F.col("conflicting") | F.col("inexact"), "-").otherwise(F.coalesce(F.col("st").cast("string"), F.lit("-")))
    return rows.select(F.concat_ws("\t", "sample_id", F.lit(scheme), st, F.array_join(F.transform("cells", lambda x: x["c"]), "\t")).alias("line"))


def typing_json(calls: DataFrame, types: DataFrame, scheme: str) -> DataFrame:
    entry = F.struct("locus", F.struct("allele_id", "call_type", "confidence", "multiple_hits", "allele_ids", "copy_count").alias("call"))
    rows = calls.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("allele_calls")).join(types.select("sample_id", "st"), "sample_id")
    return rows.select(F.to_json(F.struct("sample_id", F.lit(scheme).alias("scheme"), "st", "allele_calls")).alias("line"))


def pretty_rows(types: DataFrame) -> DataFrame:
    return types.select(F.format_string("%s: ST=%s", F.col("sample_id").cast("string"), F.coalesce(F.col("st").cast("string"), F.lit("-"))).alias("line"))


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """One text column; a header is its first line (one output file then)."""
    if header is not None:
        head = lines.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit(header).alias("line"))
        lines = head.unionByName(lines.select(F.lit(1).alias("o"), "line")).coalesce(1).sortWithinPartitions("o").select("line")
    lines.write.mode("overwrite").text(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Booleans as 1 and 0, nothing quoted."""
    flags = {c: F.col(c).cast("int") for c, t in df.dtypes if t == "boolean"}
    df.withColumns(flags).write.mode("overwrite").option("header", True).option("quote", "").option("sep", sep).csv(path)


def write_fasta(records: DataFrame, path: str, by_locus: bool = False) -> None:
    """(header, seq[, locus]) as records wrapped at 60."""
    text = wrapped_fasta(F.col("header"), F.col("seq")).alias("value")
    writer = records.select(text, *(["locus"] if by_locus else [])).write.mode("overwrite")
    (writer.partitionBy("locus") if by_locus else writer).text(path)


def grapetree_rows(profiles: DataFrame, loci: list[str]) -> DataFrame:
    """(st, profile map) as #Strain lines: ST<st>, or Unknown for -; an absent allele is -."""
    strain = F.when(F.coalesce("st", F.lit("-")) == "-", "Unknown").otherwise(F.concat(F.lit("ST"), F.col("st")))
    return profiles.select(F.concat_ws("\t", strain, *[F.coalesce(F.element_at("profile", F.lit(x)), F.lit("-")) for x in loci]).alias("line"))


def novel_fasta(alleles: DataFrame) -> DataFrame:
    """(locus, allele_id, seq, samples) to locus and the record >locus_id sample=a b, wrapped at 60."""
    header = F.concat("locus", F.lit("_"), "allele_id", F.lit(" sample="), F.array_join("samples", " "))
    return alleles.select("locus", "allele_id", wrapped_fasta(header, F.col("seq")).alias("value"))


def write_novel_fasta(alleles: DataFrame, path: str) -> None:
    """A folder for each locus, records by the number of their allele."""
    rows = novel_fasta(alleles).withColumn("k", F.substring("allele_id", 2, 20).try_cast("bigint"))
    rows.repartition("locus").sortWithinPartitions("locus", "k", "allele_id").select("locus", "value").write.mode("overwrite").partitionBy("locus").text(path)


def append_novel_profiles(profiles: DataFrame, loci: list[str], path: str) -> None:
    """(st, sample, profile map) as delimited rows added to those at the path; each part names its columns, absent loci are -."""
    cells = [F.coalesce(F.element_at("profile", F.lit(x)), F.lit("-")).alias(x) for x in loci]
    profiles.select(F.col("st").alias("ST"), "sample", *cells).write.mode("append").option("header", True).option("quote", "").option("sep", "\t").csv(path)


#: Columns of the coordinates table.
CDS_COLUMNS = ("sample_id", "gene_id", "contig_id", "start", "end", "strand", "length", "partial_begin", "partial_end", "mode", "training_file", "closed_ends")


def cds_coordinates(genes: DataFrame, mode: str, training_file: str | None = None, closed_ends: bool = False) -> DataFrame:
    """Predicted genes as rows of CDS_COLUMNS: what is unknown (and a coordinate of 0) is empty, flags are 1 and 0."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    place = lambda c: F.when(F.col(c) == 0, "").otherwise(text(c))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    cells = [F.col("sample_id"), F.col("gene_id"), text("contig_id"), place("start"), place("end"), text("strand"), F.coalesce(F.length("seq"), F.lit(0)), flag("partial_begin"), flag("partial_end"), F.lit(mode), F.lit(training_file or ""), F.lit(int(closed_ends))]
    return genes.select(*[c.alias(n) for c, n in zip(cells, CDS_COLUMNS, strict=True)])


def merged_fasta(records: DataFrame) -> DataFrame:
    """(file, ordinal, header, seq) of many files as one text, by path and place: one column of records, in order."""
    return records.orderBy("file", "ordinal").select(wrapped_fasta(F.col("header"), F.col("seq")).alias("value"))


def projected(rows: DataFrame, columns: list[str], metadata: DataFrame | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """The named columns, an unknown one is an error; with a sample's metadata fields in front, prefixed by meta_."""
    unknown = [c for c in columns if c not in rows.columns]
    if unknown:
        raise ValueError(f"unknown columns {', '.join(unknown)}")
    if metadata is None:
        return rows.select(*columns)
    extra = metadata.select(F.col("sample").alias("_sample"), *[F.coalesce(F.element_at("fields", F.lit(f)), F.lit("")).alias(f"meta_{f}") for f in fields])
    joined = rows.join(extra, rows["sample"] == extra["_sample"], "left")
    return joined.select(*columns, *[F.coalesce(F.col(f"meta_{f}"), F.lit("")).alias(f"meta_{f}") for f in fields])


def text_table(rows: DataFrame, ordinal: str) -> DataFrame:
    """A table as text: one row, padded columns, a rule below the header; (no rows) for an empty one. For tables to look at."""
    columns = [c for c in rows.columns if c != ordinal]
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    held = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.array(*[cell(c) for c in columns]).alias("v")))).alias("rows"), *[F.greatest(F.coalesce(F.max(F.length(cell(c))), F.lit(0)), F.lit(len(c))).alias(f"w{i}") for i, c in enumerate(columns)])

    def line(values: list[Column], sep: str) -> Column:
        return F.concat_ws(sep, *[F.rpad(v, F.col(f"w{i}"), F.lit(" ")) for i, v in enumerate(values)])

    head = line([F.lit(c) for c in columns], " | ")
    rule = F.concat_ws("-+-", *[F.repeat(F.lit("-"), F.col(f"w{i}")) for i in range(len(columns))])
    body = F.transform("rows", lambda r: line([r["v"][i] for i in range(len(columns))], " | "))
    return held.select(F.when(F.size("rows") == 0, "(no rows)").otherwise(F.array_join(F.concat(F.array(head, rule), body), "\n")).alias("text"))


def json_payload(rows: DataFrame, ordinal: str, summary: list[str] | None = None) -> DataFrame:
    """One row: {"rows": [...], "summary": [...]} as JSON, rows in order."""
    columns = [c for c in rows.columns if c != ordinal]
    held = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.struct(*columns).alias("r")))).alias("x"))
    parts = [F.transform("x", lambda r: r["r"]).alias("rows")]
    if summary:
        parts.append(F.array(*[F.lit(x) for x in summary]).alias("summary"))
    return held.select(F.to_json(F.struct(*parts)).alias("json"))


def matrix_rows(long: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, column, value) of a square or wide matrix as one delimited line for each row, columns by their ordinal; labels is
    (column, ordinal). The header is the line of ordinal -1."""
    order = labels.agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda x: x["column"]).alias("names"))
    rows = long.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("column", F.col("value").cast("string")))).alias("m"))
    body = rows.join(F.broadcast(order)).select("row", F.concat_ws("\t", F.col("row").cast("string"), F.array_join(F.transform("names", lambda n: F.coalesce(F.element_at("m", n), F.lit(""))), "\t")).alias("line"))
    head = order.select(F.lit(None).cast(dict(long.dtypes)["row"]).alias("row"), F.concat_ws("\t", F.lit("sample_id"), F.array_join(F.transform("names", lambda n: n.cast("string")), "\t")).alias("line"))
    return head.unionByName(body)


def error_report(errors: DataFrame) -> DataFrame:
    """One row: the run's errors by stage and in all, as JSON."""
    counts = errors.groupBy("stage").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("by_stage")).select(F.to_json(F.struct("total", "by_stage")).alias("json"))


def write_scheme(spark: SparkSession, path: str, name: str, alleles: DataFrame, profiles: DataFrame, loci: list[str], metadata: dict[str, object]) -> None:
    """A scheme as tables: alleles by locus as FASTA (source alleles first, then novel ones: from_novel), its profiles with the
    loci in order (absent ones -), and its metadata as JSON."""
    import json

    header = F.concat("locus", F.lit("_"), "allele_id", F.when(F.col("from_novel"), F.concat(F.lit(" sample="), F.array_join(F.coalesce("samples", F.array().cast("array<string>")), " "))).otherwise(""))
    rows = alleles.filter(F.col("locus").isin(loci)).select("locus", "from_novel", "ordinal", wrapped_fasta(header, F.col("seq")).alias("value"))
    rows.repartition("locus").sortWithinPartitions("locus", "from_novel", "ordinal").select("locus", "value").write.mode("overwrite").partitionBy("locus").text(f"{path}/alleles")
    cells = [F.coalesce(F.element_at("profile", F.lit(x)), F.lit("-")).alias(x) for x in loci]
    profiles.orderBy("from_novel", "ordinal").select(F.col("st").alias("ST"), *cells).write.mode("overwrite").option("header", True).option("quote", "").option("sep", "\t").csv(f"{path}/{name}")
    spark.createDataFrame([(json.dumps({"scheme": name, "loci": loci} | metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
