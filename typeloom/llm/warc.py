"""Content-addressed WARC archive.

Payload bytes are stored once under a strong digest (SHA-256 and length), exact record headers apart from them, and
records are put together again by a join on the digest. Every payload is verified against its digest when it is read,
and every record against the SHA-1 that its header declares.

A response's block is an HTTP header and the payload; a revisit's is the HTTP header alone. Only responses need payload
bytes, of which there is one for each digest, so that join has no hot key; what rows need to know of a digest that many
share (the first record, length and SHA-1) comes by `join_facts`, which splits hot digests.

Edge cases: a null html is the empty payload; equal payloads of at least `min_bytes` bytes are one response (the record
with the smallest page_id; rows that repeat that page_id are responses too) and revisits; smaller ones are all
responses. A null page_id sorts last and is written as an empty id; ids of records hold the page_id, the payload's digest
and a hash of the url, so only rows that are equal in all three share one. A null url has no WARC-Target-URI line. CR and
LF in a url are percent-encoded. A damaged payload or header raises an error when it is read. An empty table gives an
empty archive. Other columns of the input are not archived, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.common import fresh_path, join_facts, scratch, table, writing

#: Fixed value: the alphabet of RFC 4648 base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: eight groups of 20 bits, each of five hex digits and four characters."""

    def group(digits: Column, i: Column) -> Column:
        bits = F.array(F.conv(F.substring(digits, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
        return F.transform(bits, lambda b: F.concat(*[F.substring(F.lit(BASE32), F.shiftright(b, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]))[0]

    # variables of lambdas are evaluated once, where a column named twice is hashed twice
    return F.transform(F.array(F.sha1(payload)), lambda digits: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: group(digits, i)), ""))[0]


_KEYS = ["sha256", "n_bytes"]
_HTTP = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", "\r\n\r\n")


def _http(n_bytes: Column) -> Column:
    return F.concat(F.lit(_HTTP[0]), n_bytes.cast("string"), F.lit(_HTTP[1]))


def record_header(date: str) -> Column:
    """Header of a record from columns page_id, url, sha256, sha1, n_bytes, revisit, and first (its response's page_id and url)."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda x, url: F.concat(F.lit("<urn:x-page:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(":"), F.col("sha256"), F.lit(":"), F.hex(F.xxhash64(F.coalesce(url, F.lit("")))), F.lit(">"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("revisit")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"), F.col("url"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("first.page_id"), F.col("first.url"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(_http(F.col("n_bytes"))) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))).cast("string")),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Archive `pages` (page_id, url, html) under `path` (else a new one in the shared folder), which is returned.

    payloads: sha256, n_bytes, payload, one row for each distinct payload. headers: sha256, n_bytes, header.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"sha256": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    with scratch(spark, "warc") as folder, writing(spark):
        # copies meet on the map side first, so a payload that many pages share is sent once by each task
        rows.groupBy(*_KEYS).agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
        keys = table(rows.select("page_id", "url", "sha256", "n_bytes", base32_sha1(F.col("payload")).alias("sha1")), "keys", folder)
        first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("url")))
        facts = table(keys.groupBy(*_KEYS).agg(first.alias("first"), F.count("*").alias("n")), "facts", folder)
        other = (F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
        headers = join_facts(keys, facts, _KEYS, "n").withColumn("revisit", other)
        headers.select(*_KEYS, record_header(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads, each checked against its digest and length; a damaged one raises an error."""
    good = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("n_bytes"))
    return spark.read.parquet(f"{path}/payloads").withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary")))


def field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1)


def parse(headers: DataFrame) -> DataFrame:
    """record_type, page_id, refers_to, declared (SHA-1) and content_length, as the header says; one without a type raises an error."""
    ident = lambda name: F.regexp_extract(field(F.col("header"), name), "^<urn:x-page:([^:]*):", 1).try_cast("long")
    kind = field(F.col("header"), "WARC-Type")
    kind = F.when(kind.isin("response", "revisit"), kind).otherwise(F.raise_error(F.lit("damaged header")))
    return headers.withColumns({"record_type": kind, "page_id": ident("WARC-Record-ID"), "refers_to": ident("WARC-Refers-To"), "declared": F.regexp_extract(field(F.col("header"), "WARC-Payload-Digest"), "^sha1:(.*)$", 1), "content_length": field(F.col("header"), "Content-Length").try_cast("long")})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records: sha256, n_bytes, the parsed header, and block: the bytes that follow it."""
    seen = parse(spark.read.parquet(f"{path}/headers"))
    http = _http(F.col("n_bytes")).cast("binary")
    full = seen.filter("record_type = 'response'").join(read_payloads(spark, path), _KEYS).withColumn("block", F.concat(http, "payload")).drop("payload")
    records = full.unionByName(seen.filter("record_type = 'revisit'").withColumn("block", http))
    good = F.octet_length("block") == F.col("content_length")
    return records.withColumn("block", F.when(good, F.col("block")).otherwise(F.raise_error(F.lit("header and block differ")).cast("binary")))


def write_warc(spark: SparkSession, path: str, out: str, compression: str = "none") -> None:
    """The archive's records as WARC files, any number in a file."""
    record = F.concat(F.col("header").cast("binary"), F.col("block")).cast("string")
    read_records(spark, path).select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(out)


def archive_report(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record read back.

    Length and SHA-1 are taken from the bytes of the response's block; a revisit has those of the response it shares a digest with.
    """
    records = read_records(spark, path)
    body = F.substring("block", F.octet_length(_http(F.col("n_bytes"))) + 1, F.octet_length("block"))
    with scratch(spark, "warc-read") as folder:
        full = records.filter("record_type = 'response'").select(*_KEYS, body.alias("payload")).groupBy(*_KEYS).agg(F.first(F.octet_length("payload").cast("long")).alias("payload_bytes"), F.first(base32_sha1(F.col("payload"))).alias("payload_digest"))
        seen = parse(spark.read.parquet(f"{path}/headers")).select(*_KEYS, "page_id", "declared", "record_type", "refers_to")
        counts = seen.groupBy(*_KEYS).agg(F.count("*").alias("n"))
        facts = table(counts.join(full, _KEYS, "left"), "facts", folder)
        report = table(join_facts(seen, facts, _KEYS, "n"), "report", path)
    checked = F.when(F.col("declared") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload differ")))
    return report.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
