"""Secret scan with multipart credential linking.

Strong kinds (assign, access, hex) are reported wherever they match. Weak kinds (id, secret, endpoint) are only
candidates: an interval join within scopes of `scope` code points links secrets to identifiers and to endpoints, and
only linked ones are reported. An access span serves as an identifier and an assign or hex span as a secret in these
links. Spans are code points, end exclusive.

Scale: one scan computes all spans inside its row with JVM expressions; only span positions (not texts) are shuffled.
The join is on (row key, bin of `scope` code points), so what meets in a task is bounded by the length of a scope, also
in very long texts. No task holds more than one text.

Edge cases: a null text is empty and has no spans; repeated rows (equal doc_id and text) each get the same result; a
null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import let, table, text_of

#: Fixed values, in the order in which spans that begin alike are listed: kind, pattern, group to measure, least length.
STRONG = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a match of the plain run is a maximal run, so asking for the length in the pattern finds the same runs
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("id", r"""(?i)(user|username|login|account|client_?id|access_?key_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 2, 3),
    ("secret", r"[A-Za-z0-9+/_-]{24,}", 0, 24),
    ("endpoint", r"""(https?|ftp|postgresql|mysql|mongodb|redis|s3)://([^\x20\x09-\x0D"'<>]+)""", 2, 4),
)
KINDS = [k for k, *_ in (*STRONG, *WEAK)]
CHUNK = 512


def _running(a: Column) -> Column:
    """Sums before each element."""
    return F.slice(F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)), F.lit(1), F.size(a))


def sums_before(a: Column) -> Column:
    """Exclusive prefix sums in two levels, so that long arrays don't cost the square of their length."""
    return let(a, _sums_before)


def _sums_before(a: Column) -> Column:
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda c: F.slice(a, c * CHUNK + 1, F.lit(CHUNK)))
    ahead = _running(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)))
    return F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(F.zip_with(chunks, ahead, lambda c, o: F.transform(_running(c), lambda x: x + o))))


def spans(text: Column, no: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, kind>>: the pieces between them give the positions."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x).cast("long"))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), lambda x: F.length(x).cast("long")), whole, lambda p, m: p + m)
    found = F.zip_with(F.arrays_zip(sums_before(steps).alias("at"), steps.alias("step"), whole.alias("len")), kept, lambda s, k: F.struct((s["at"] + s["step"] - s["len"]).alias("start"), (s["at"] + s["step"]).alias("end"), F.lit(no).alias("kind"), k.alias("value")))
    good = lambda s: F.length(s["value"]) >= least
    if KINDS[no] == "secret":
        good = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    narrow = F.transform(F.filter(found, good), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return F.when(text.rlike(pattern), narrow).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))


def listed(found: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.concat_ws(",", F.transform(found, lambda s: F.concat(name(s), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))


def scan(docs: DataFrame, scope: int = 256) -> DataFrame:
    """doc_id, strong and linked: spans as array<struct<start, kind, end>>, sorted; one row for each row of `docs`."""
    text = text_of("text")
    columns = {k: spans(F.col("text"), i, p, g, n) for i, (k, p, g, n) in enumerate((*STRONG, *WEAK))}
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", F.md5("text").alias("digest"), *[c.alias(k) for k, c in columns.items()])
    found = rows.select("doc_id", "digest", F.array_sort(F.concat("assign", "access", "hex")).alias("strong"), F.array_sort(F.concat("id", "secret", "endpoint")).alias("weak"))
    found = table(found, "secret-spans")
    key = ["doc", "digest"]
    keyed = found.filter(F.size("weak") > 0).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "digest", F.explode(F.concat("strong", "weak")).alias("s")).select(*key, "s.*").distinct()
    kind = {k: i for i, k in enumerate(KINDS)}
    secret = F.col("kind").isin(kind["secret"], kind["assign"], kind["hex"])
    bin_of = lambda at: F.floor(at / scope)
    # intervals meet if the gap between them is at most `scope`: each secret looks into every bin its widened interval touches
    left = keyed.filter(secret).select(*key, *[F.col(c).alias(f"s_{c}") for c in ("start", "kind", "end")]).withColumn("bin", F.explode(F.sequence(bin_of(F.greatest(F.col("s_start") - scope, F.lit(0))), bin_of(F.col("s_end") + scope))))
    right = keyed.filter(~secret).select(*key, "start", "kind", "end").withColumn("bin", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("end")))))
    near = (F.col("start") - F.col("s_end") <= scope) & (F.col("s_start") - F.col("end") <= scope)
    apart = (F.col("start") >= F.col("s_end")) | (F.col("end") <= F.col("s_start"))
    pairs = left.join(right, [*key, "bin"]).filter(near & apart)
    ends = pairs.select(*key, F.explode(F.array(F.struct(F.col("s_start").alias("start"), F.col("s_kind").alias("kind"), F.col("s_end").alias("end")), F.struct("start", "kind", "end"))).alias("s")).filter(F.col("s.kind") >= len(STRONG))
    linked = ends.groupBy(*key).agg(F.array_sort(F.collect_set("s")).alias("linked"))
    back = found.select("doc_id", "digest", "strong", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")).join(linked, key, "left")
    return back.select("doc_id", "strong", F.coalesce("linked", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("linked"))
