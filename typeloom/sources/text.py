"""Readers of sequence, hit, profile, catalogue and result files. Where the order of lines has a meaning, rows have an
ordinal that rises along their file."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from typeloom.functions.sequences import split_allele_id, split_template
from typeloom.operators.calling import last_profiles
from typeloom.operators.ordering import numbered, running_sums


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, contig_id, header, seq (upper case), length; records split at the line starts with >, so large files are read in parallel."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^>", "").alias("r")).filter(F.trim("r") != "")
    head = F.trim(F.regexp_extract("r", r"^([^\r\n]*)", 1))
    body = F.upper(F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s+", ""))
    return raw.select("file", F.regexp_extract(head, r"^(\S*)", 1).alias("contig_id"), head.alias("header"), body.alias("seq")).withColumn("length", F.length("seq"))


def line_ordinal() -> Column:
    """A number that rises along the lines of each file, without a shuffle: the split's place in the file (in units of 4 KB)
    and the line's place in the task."""
    return F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 12), 33).bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def file_stem() -> Column:
    """The name of the file a row is from, without its last suffix."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def _lines(spark: SparkSession, path: str, sample: Column | None) -> DataFrame:
    """value, sample_id (by default the file's stem) and hit_ordinal of every line."""
    rows = spark.read.text(path)
    return rows.select("value", (file_stem() if sample is None else sample).alias("sample_id"), line_ordinal().alias("hit_ordinal"))


def _cell(i: int, kind: str = "double") -> Column:
    return F.get("c", F.lit(i)).try_cast(kind)


def _known(rows: DataFrame, loci: DataFrame | None) -> DataFrame:
    return rows if loci is None else rows.join(loci.select("locus").distinct(), "locus", "left_semi")


def read_blast(spark: SparkSession, path: str, loci: DataFrame | None = None, sample: Column | None = None) -> DataFrame:
    """Tabular hits of 11 or 12 columns; comments, blank and short lines are skipped, and loci outside the scheme."""
    rows = _lines(spark, path, sample).filter((F.trim("value") != "") & ~F.col("value").startswith("#")).withColumn("c", F.split("value", "\t")).filter(F.size("c") >= 11)
    locus, allele = split_allele_id(F.get("c", F.lit(0)))
    length, qlen, start, end = _cell(3, "int"), _cell(4, "int"), _cell(7, "int"), _cell(8, "int")
    out = rows.select(
        "sample_id", "hit_ordinal", locus.alias("locus"), allele.alias("allele_id"), _cell(2).alias("identity"), F.when(qlen == 0, 0.0).otherwise(length / qlen).alias("coverage"), F.when(start > end, "-").otherwise("+").alias("strand"), _cell(10).alias("score"), F.lit(None).cast("double").alias("depth"),
        F.get("c", F.lit(1)).alias("query_contig"), F.least(start, end).alias("query_start"), F.greatest(start, end).alias("query_end"), length.alias("alignment_length"), qlen.alias("allele_length"), _cell(5, "int").alias("allele_start"), _cell(6, "int").alias("allele_end"), F.get("c", F.lit(11)).alias("sequence"),
    )
    return _known(out, loci)


def read_paf(spark: SparkSession, path: str, loci: DataFrame | None = None, sample: Column | None = None) -> DataFrame:
    """PAF hits: identity from matches and the NM tag, score identity * coverage."""
    rows = _lines(spark, path, sample).withColumn("c", F.split("value", "\t")).filter(F.size("c") >= 12)
    num = lambda i: _cell(i, "int")
    tag = F.get(F.filter(F.slice("c", 13, F.size("c")), lambda x: x.startswith("NM:i:")), F.lit(0))
    nm = F.coalesce(F.substring(tag, 6, 12).try_cast("int"), F.lit(0))
    locus, allele = split_allele_id(F.get("c", F.lit(0)))
    identity = F.when(num(9) + nm == 0, 0.0).otherwise(100.0 * num(9) / (num(9) + nm))
    coverage = F.when(num(1) == 0, 0.0).otherwise((num(3) - num(2)) / num(1))
    out = rows.select("sample_id", "hit_ordinal", locus.alias("locus"), allele.alias("allele_id"), identity.alias("identity"), coverage.alias("coverage"), F.get("c", F.lit(4)).alias("strand"), (identity * coverage).alias("score"), F.lit(None).cast("double").alias("depth"), F.get("c", F.lit(5)).alias("query_contig"), num(6).alias("query_contig_length"), num(7).alias("query_start"), num(8).alias("query_end"), num(10).alias("alignment_length"), num(1).alias("allele_length"), num(2).alias("allele_start"), num(3).alias("allele_end"))
    return _known(out, loci)


def read_coords(spark: SparkSession, path: str, loci: DataFrame | None = None, sample: Column | None = None) -> DataFrame:
    """Tab-separated coordinates: identity in column 7, coverage of the query in column 11, tags in columns 12 and 13."""
    rows = _lines(spark, path, sample).filter(F.col("value").rlike("^[0-9]")).withColumn("c", F.split("value", "\t")).filter(F.size("c") >= 13)
    identity, coverage = _cell(6), _cell(10) / 100
    locus, allele = split_allele_id(F.get("c", F.lit(12)))
    out = rows.select("sample_id", "hit_ordinal", locus.alias("locus"), allele.alias("allele_id"), identity.alias("identity"), coverage.alias("coverage"), F.lit("+").alias("strand"), (identity * coverage / 100).alias("score"), F.lit(None).cast("double").alias("depth"), F.get("c", F.lit(11)).alias("query_contig"), _cell(5, "int").alias("alignment_length")).filter("identity >= 70 and coverage >= 0.5")
    return _known(out, loci)


def read_res(spark: SparkSession, path: str, loci: DataFrame | None = None, sample: Column | None = None, reads: bool = False) -> DataFrame:
    """Template tables: columns by the names in the line that starts with #Template, else by their usual places; the
    coverage is a percentage, and the depth counts for reads only. Hits are not reduced to best ones."""
    raw = _lines(spark, path, sample).filter(F.col("value") != "")
    # the last header line of a file names its columns; files of one run share it, so the header is one small row
    head = raw.filter(F.col("value").startswith("#Template")).select(F.split(F.regexp_replace("value", "^#+", ""), "\t").alias("names")).limit(1)
    rows = raw.filter(~F.col("value").startswith("#")).withColumn("c", F.split("value", "\t")).join(F.broadcast(head))
    at = lambda name, usual: F.get("c", F.when(F.array_position("names", F.lit(name)) > 0, F.array_position("names", F.lit(name)) - 1).otherwise(usual).cast("int"))
    num = lambda name, usual: F.trim(at(name, usual)).try_cast("double")
    locus, allele = split_template(at("Template", 0))
    depth = num("Depth", 8) if reads else F.lit(None).cast("double")
    out = rows.select("sample_id", "hit_ordinal", locus.alias("locus"), allele.alias("allele_id"), num("Template_Identity", 4).alias("identity"), (num("Template_Coverage", 5) / 100).alias("coverage"), F.lit("+").alias("strand"), num("Score", 1).alias("score"), depth.alias("depth"), num("Template_length", 3).cast("int").alias("alignment_length"))
    return _known(out, loci)


def read_fastq(spark: SparkSession, path: str, most_reads: int | None = None) -> DataFrame:
    """file, read_ordinal (from 0), read_id, seq, quality of four-line records; with `most_reads` the first ones of each file.

    A file's lines are numbered along the file without one task that sees all files; an unfinished last record is dropped.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), line_ordinal().alias("o"), "value")
    first = lines.groupBy("file").agg(F.min("o").alias("first"))
    counted = running_sums(lines, ["file", "o"], {"before": F.lit(1).cast("long")})
    start = counted.join(F.broadcast(first), "file").filter("o = first").select("file", F.col("before").alias("start"))
    placed = counted.join(F.broadcast(start), "file").withColumn("line", F.col("before") - F.col("start"))
    placed = placed.withColumn("read_ordinal", F.floor(F.col("line") / 4))
    if most_reads is not None:
        placed = placed.filter(F.col("read_ordinal") < most_reads)
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    reads = placed.groupBy("file", "read_ordinal").agg(part(0).alias("h"), part(1).alias("seq"), part(3).alias("quality"), F.count("*").alias("n")).filter("n = 4")
    return reads.select("file", "read_ordinal", F.regexp_extract("h", r"^@?(\S*)", 1).alias("read_id"), "seq", "quality")


def last_records(records: DataFrame) -> DataFrame:
    """(contig_id, seq, ordinal): one row for each id, the last."""
    return records.groupBy("contig_id").agg(F.max_by("seq", "ordinal").alias("seq"))


def read_st_profiles(spark: SparkSession, path: str, loci: list[str]) -> DataFrame:
    """profile and st of an ST table (column ST or st), the last row of a profile; see last_profiles."""
    wide = spark.read.option("header", True).option("sep", "\t").csv(path)
    st = "ST" if "ST" in wide.columns else "st"
    rows = wide.select(F.col(f"`{st}`").alias("ST"), *[F.col(f"`{x}`") if x in wide.columns else F.lit(None).cast("string").alias(x) for x in loci], line_ordinal().alias("row_ordinal"))
    return last_profiles(rows, loci)


def scheme_files(spark: SparkSession, path: str) -> DataFrame:
    """One row: loci and files of a scheme's folder. Of two allele files of a locus .tfa wins; loci are those of .meta.json in
    its order, then further ones (by suffix, then name); the profile file is the first .txt, else the first .tsv."""
    names = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    stem, suffix = F.regexp_extract("name", r"^(.*)\.([^.]*)$", 1), F.regexp_extract("name", r"^(.*)\.([^.]*)$", 2)
    kinds = names.select("name", stem.alias("stem"), suffix.alias("suffix"))
    alleles = kinds.filter(F.col("suffix").isin("tfa", "fasta")).groupBy(F.col("stem").alias("locus")).agg(F.max(F.struct(F.col("suffix") == "tfa", "name"))["name"].alias("file"))
    found = alleles.agg(F.array_sort(F.collect_list(F.struct((~F.col("file").endswith(".tfa")).alias("late"), "locus", "file"))).alias("a"))
    profile = kinds.filter(F.col("suffix").isin("txt", "tsv")).agg(F.min(F.struct((F.col("suffix") != "txt").alias("late"), "name"))["name"].alias("profile_file"))
    meta = spark.createDataFrame([(json.loads(t).get("loci", []),) for _, t in hidden_texts(spark, f"{path}/.meta.json")] or [([],)], "listed array<string>")
    loci = F.array_distinct(F.concat(F.coalesce("listed", F.array().cast("array<string>")), F.transform("a", lambda x: x["locus"])))
    return found.join(F.broadcast(profile)).join(F.broadcast(meta)).select(loci.alias("loci"), F.map_from_entries(F.transform("a", lambda x: F.struct(x["locus"], x["file"]))).alias("files"), "profile_file")


def hidden_texts(spark: SparkSession, pattern: str) -> list[tuple[str, str]]:
    """(path, text) of the files of a glob, read by the driver: Spark's own sources skip names that begin with a dot. For
    the small metadata files of schemes only."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = where.getFileSystem(conf)
    out = []
    for status in fs.globStatus(where) or []:
        stream = fs.open(status.getPath())
        try:
            out.append((status.getPath().toString(), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()
    return out


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Scheme rows of catalogues {"schemes": [...]}, with the provider (file's stem) and their place."""
    rows = spark.read.option("multiLine", True).json(path)
    fields = rows.schema["schemes"].dataType.elementType.names
    return rows.select(file_stem().alias("provider"), F.posexplode("schemes").alias("row_ordinal", "s")).select("provider", F.col("row_ordinal").cast("long").alias("row_ordinal"), *[F.col(f"s.`{f}`") for f in fields if f != "provider"])


def cached_schemes(spark: SparkSession, root: str) -> DataFrame:
    """provider, scheme, metadata (JSON text) of every <root>/<provider>/<scheme>/.meta.json; folders that begin with _ are none."""
    rows = [(*f.rsplit("/", 3)[1:3], t) for f, t in hidden_texts(spark, f"{root}/*/*/.meta.json")]
    return spark.createDataFrame([r for r in rows if not r[0].startswith("_")], "provider string, scheme string, metadata string")


def read_novel_fasta(spark: SparkSession, path: str) -> DataFrame:
    """locus (of <locus>_novel.fasta), allele_id (after the header's first _), samples (after sample=), seq."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""), "_novel", "").alias("locus"), F.regexp_replace("value", r"^\s*>", "").alias("r")).filter(F.trim("r") != "")
    head = F.trim(F.regexp_extract("r", r"^([^\r\n]*)", 1))
    full, listed = F.regexp_extract(head, "^(.*?)( sample=.*)?$", 1), F.regexp_extract(head, "^.*? sample=(.*)$", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s+", ""))
    return raw.select("locus", F.regexp_extract(full, "^[^_]*_(.*)$", 1).alias("allele_id"), F.filter(F.split(listed, r"\s+"), lambda x: x != "").alias("samples"), body.alias("seq"))


def read_novel_profiles(spark: SparkSession, path: str) -> DataFrame:
    """st, sample, profile: the non-empty cells of every other column, by name."""
    wide = spark.read.option("header", True).option("sep", "\t").csv(path)
    loci = [c for c in wide.columns if c not in ("ST", "sample")]
    cells = F.map_filter(F.create_map(*[x for c in loci for x in (F.lit(c), F.col(f"`{c}`"))]), lambda k, v: F.coalesce(v, F.lit("")) != "")
    cell = lambda c: F.coalesce(F.col(c), F.lit("")) if c in wide.columns else F.lit("")
    return wide.select(cell("ST").alias("st"), cell("sample").alias("sample"), cells.alias("profile"))


_CALL = "struct<allele_id: string, call_type: string, confidence: double, multiple_hits: boolean, allele_ids: array<string>, copy_count: long, novel_sequence: string>"


def read_typing_json(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, scheme, st, locus and the call's fields, of typing results as JSON (one object a line, or a list)."""
    rows = spark.read.schema(f"sample_id string, scheme string, st string, allele_calls map<string, {_CALL}>").option("multiLine", False).json(path)
    return rows.select("sample_id", "scheme", "st", F.explode("allele_calls").alias("locus", "call")).select("sample_id", "scheme", "st", "locus", "call.*")


def read_predicted_genes(spark: SparkSession, path: str, min_len: int = 100, max_len: int = 5000) -> DataFrame:
    """sample_id, gene_id, contig_id, start, end, strand, partial_begin, partial_end, seq of predicted genes whose headers
    read `contig # start # end # strand # attributes`. Genes are numbered along the file before the length filter."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(file_stem().alias("sample_id"), line_ordinal().alias("o"), F.regexp_replace("value", "^>", "").alias("r")).filter(F.trim("r") != "")
    head = F.trim(F.regexp_extract("r", r"^([^\r\n]*)", 1))
    seq = F.upper(F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s+", ""))
    rows = raw.select("sample_id", "o", F.transform(F.split(head, "#"), lambda x: F.trim(x)).alias("h"), seq.alias("seq"))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("sample_id").orderBy("o"))).filter(F.length("seq").between(min_len, max_len))
    full = F.size("h") >= 4
    number = lambda i: F.when(full & F.get("h", F.lit(i)).rlike("^[0-9]+$"), F.get("h", F.lit(i)).cast("int"))
    strand = F.when(full & F.get("h", F.lit(3)).isin("1", "+"), "+").when(full & F.get("h", F.lit(3)).isin("-1", "-"), "-")
    # the first partial= counts, and only if two flags follow it
    flag = lambda g: F.when(F.get("h", F.lit(4)).rlike("^(?:(?!partial=).)*partial=[01][01]"), F.regexp_extract(F.get("h", F.lit(4)), "partial=([01])([01])", g) == "1")
    return rows.select("sample_id", F.concat(F.lit("gene_"), F.col("k").cast("string")).alias("gene_id"), F.get("h", F.lit(0)).alias("contig_id"), number(1).alias("start"), number(2).alias("end"), strand.alias("strand"), flag(1).alias("partial_begin"), flag(2).alias("partial_end"), "seq")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """member and locus of a two-column cluster table; loci are numbered by the first appearance of their representative."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c"), line_ordinal().alias("o")).filter(F.size("c") >= 2).select(F.col("c")[0].alias("rep"), F.col("c")[1].alias("member"), "o")
    numbers = numbered(rows.groupBy("rep").agg(F.min("o").alias("first_seen")), ["first_seen", "rep"], "number")
    return rows.join(numbers.select("rep", "number"), "rep").select("member", F.concat(F.lit("locus_"), F.col("number").cast("string")).alias("locus"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """sample and its map of non-blank fields; the key is the column ID, else the first. The last row of a sample counts."""
    wide = spark.read.option("header", True).option("sep", _separator(spark, path)).csv(path)
    key = "ID" if "ID" in wide.columns else wide.columns[0]
    rest = [c for c in wide.columns if c != key]
    cell = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    fields = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), cell(c))]), lambda k, v: v != "") if rest else F.create_map().cast("map<string,string>")
    rows = wide.select(cell(key).alias("sample"), fields.alias("fields"), line_ordinal().alias("o")).filter("sample <> ''")
    return rows.groupBy("sample").agg(F.max_by("fields", "o").alias("fields"))


def project_profiles(rows: DataFrame, header: list[str], loci: list[str]) -> DataFrame:
    """(cells array) of a fetched profile table to its loci's order: short rows are dropped, absent loci are -."""
    at = {c: i for i, c in enumerate(header)}
    cell = lambda x: F.get("cells", F.lit(at[x])) if x in at else F.lit("-")
    return rows.filter(F.size("cells") >= len(header)).select(F.get("cells", F.lit(0)).alias("ST"), F.array(*[cell(x) for x in loci]).alias("profile"))


def first_sample_cells(wide: DataFrame, key: str, sample: str, ordinal: str) -> DataFrame:
    """locus and value of the first row of a sample in a wide result table."""
    loci = [c for c in wide.columns if c not in (key, ordinal)]
    row = wide.filter(F.col(key) == sample).agg(F.min_by(F.array(*[F.struct(F.lit(c).alias("locus"), F.col(f"`{c}`").alias("value")) for c in loci]), ordinal).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*")


def _separator(spark: SparkSession, path: str) -> str:
    head = spark.read.text(path).limit(10).collect()
    return max(("\t", ",", ";"), key=lambda s: sum(r[0].count(s) for r in head))


def read_profile_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A wide profile table in long form (sample, sample_ordinal, locus, locus_ordinal, value); the delimiter is sniffed from
    the head. The sample column is FILE if there, else the first; rows without a sample are skipped. Only the header is read
    on the driver; see check_matrix for its errors.
    """
    wide = spark.read.option("header", True).option("sep", _separator(spark, path)).csv(path)
    key = "FILE" if "FILE" in wide.columns else wide.columns[0]
    loci = [c for c in wide.columns if c not in ("FILE", "SCHEME", "ST") and c != key]
    if not loci:
        raise ValueError("no locus columns")
    cells = F.array(*[F.struct(F.lit(c).alias("locus"), F.lit(i + 1).cast("long").alias("locus_ordinal"), F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias("value")) for i, c in enumerate(loci)])
    rows = wide.select(F.trim(F.coalesce(F.col(f"`{key}`"), F.lit(""))).alias("sample"), line_ordinal().alias("sample_ordinal"), cells.alias("cells")).filter("sample <> ''")
    return rows.select("sample", "sample_ordinal", F.explode("cells").alias("x")).select("sample", "sample_ordinal", "x.*")


def check_matrix(matrix: DataFrame) -> DataFrame:
    """The matrix; an empty one, or one with a sample twice, is an error."""
    rows = matrix.select("sample", "sample_ordinal").distinct().groupBy("sample").agg(F.count("*").alias("n"))
    n, twice = rows.agg(F.count("*"), F.min(F.when(F.col("n") > 1, F.col("sample")))).first()
    if not n:
        raise ValueError("no sample rows")
    if twice is not None:
        raise ValueError(f"duplicate sample {twice!r}")
    return matrix
