"""Chat formatting with budgeted windows.

The turns of a conversation, in order, are cut into turn-aligned spans chosen from prefix sums of their tokens. Each
span becomes a window: the conversation's first system turn (kept in every window), up to `history` turns repeated
from before the span, then the span itself. Repeated turns are masked; the loss mask covers the texts of the span's
own assistant turns, so every assistant text is a target exactly once.

With budget B, system tokens S, history tokens at most H and turns of at most M tokens, spans hold about
C = B - S - H - M tokens: a turn belongs to span floor(tokens before it / C), and longer turns than M stand alone. So
no window exceeds B tokens unless a single turn (with the system turn) does; such windows have over_budget set, as
turns are never cut. Tokens are runs of letters and digits, or single other marks.

Scale: turns are numbered along the order of all turns by running sums over range partitions, and handled in blocks of
`block` successive turns of a conversation, with the last turns of the block before as a halo. So a conversation of any
length, with any turn numbers, is spread over tasks, and a window's text is bounded by its budget. What belongs to a
conversation (its first place and system turn) comes by `join_facts`, which splits conversations of many turns.

Edge cases: null texts and roles are empty; a null conv_id is a conversation of its own; turns are ordered by turn
(null first), then role, then text, so repeated rows are turns of their own; an empty table gives no windows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from typeloom.llm.common import join_facts, table, text_of
from typeloom.operators.ordering import running_sums

#: The marks of the template, and further control strings that are escaped in texts.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one after the first character of every control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def windows(turns: DataFrame, budget: int = 1024, history: int = 2, history_tokens: int = 128, longest: int = 384, block: int = 512) -> DataFrame:
    """conv_id, block, first_no, n_context, text, loss (array of start and end in text), n_tokens, over_budget.

    n_context turns at the window's start are repeats of turns that another window has as its own.
    """
    key = ["no_conv", "conv"]
    keys = [F.col("conv_id").isNull().alias("no_conv"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv")]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), text_of("text").alias("text"), *keys)
    rows = running_sums(rows, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"], {"place": F.lit(1).cast("long")})
    rows = table(rows.withColumn("n", tokens(F.col("text"))), "chat-turns")
    system = F.min(F.when(F.col("role") == "system", F.struct("place", "text", "n")))
    facts = table(rows.groupBy(*key).agg(F.min("place").alias("begin"), F.count("*").alias("n_turns"), system.alias("sys")), "chat-facts")
    rows = join_facts(rows, facts.select(*key, "begin", "n_turns", F.col("sys.place").alias("sys_place"), F.col("sys.n").alias("sys_n")), key, "n_turns")
    rows = rows.withColumns({"at": F.col("place") - F.col("begin"), "is_sys": F.coalesce(F.col("place") == F.col("sys_place"), F.lit(False))}).withColumn("block", F.floor(F.col("at") / block))
    # the halo: a block also sees the last turns of the block before it, as history only
    halo = rows.filter((F.pmod("at", F.lit(block)) >= block - history) & ~F.col("is_sys")).withColumn("block", F.col("block") + 1).withColumn("halo", F.lit(True))
    rows = rows.withColumn("halo", F.lit(False)).unionByName(halo)
    order = W.partitionBy(*key, "block").orderBy(F.desc("halo"), "place")
    so_far = order.rowsBetween(W.unboundedPreceding, -1)
    own = F.when(F.col("halo"), 0).otherwise(F.col("n"))
    room = F.greatest(F.lit(budget) - F.coalesce("sys_n", F.lit(0)) - history_tokens - longest, F.lit(1))
    rows = rows.withColumns({"no": F.row_number().over(order), "before": F.coalesce(F.sum(own).over(so_far), F.lit(0)), "all_before": F.coalesce(F.sum("n").over(so_far), F.lit(0))})
    rows = rows.withColumn("cell", F.when(F.col("halo"), F.lit(-1)).otherwise(F.floor(F.col("before") / room))).withColumn("long", F.col("n") > longest)
    was = lambda c: F.lag(c).over(order)
    starts = ~F.col("halo") & (was("cell").isNull() | (was("cell") != F.col("cell")) | F.col("long") | was("long"))
    rows = rows.withColumn("starts", F.coalesce(starts, F.lit(True)))
    rows = rows.withColumn("span", F.sum(F.col("starts").cast("long")).over(order))
    # a turn is history of a window that starts within the next `history` turns and history_tokens tokens
    targets = [F.struct(F.col("span").alias("span"), F.lit(0).alias("context"))]
    for d in range(1, history + 1):
        ahead = lambda c, d=d: F.lead(c, d).over(order)
        fits = ahead("starts") & (ahead("all_before") - F.col("all_before") <= history_tokens) & ~F.col("is_sys")
        targets.append(F.when(fits, F.struct(ahead("span").alias("span"), F.lit(1).alias("context"))))
    rows = rows.withColumn("into", F.array(*targets))
    rows = rows.select("conv_id", *key, "block", "no", "role", "text", "n", "is_sys", "halo", F.explode("into").alias("into")).filter("into is not null and not (halo and into.context = 0)")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    shown = rows.select("conv_id", *key, "block", "into.span", "into.context", "no", "n", "is_sys", (F.col("role") == "assistant").alias("assistant"), head.alias("head"), escape(F.col("text")).alias("body"))
    spans = shown.groupBy("conv_id", *key, "block", "span").agg(F.array_sort(F.collect_list(F.struct("no", "context", "head", "body", "assistant"))).alias("turns"), F.sum("n").alias("n"), F.max("is_sys").alias("has_sys"), F.min(F.when(F.col("context") == 0, F.col("no"))).alias("first_no"))
    lead_in = F.when(F.col("sys").isNotNull(), F.struct(F.lit(0).alias("no"), F.lit(1).alias("context"), F.lit(f"{TURN}system{TEXT}").alias("head"), escape(F.col("sys.text")).alias("body"), F.lit(False).alias("assistant")))
    first = facts.select(*key, "n_turns", lead_in.alias("sys"), F.col("sys.n").alias("sys_n"))
    spans = join_facts(spans, first, key, "n_turns").withColumn("add", F.col("sys").isNotNull() & ~F.col("has_sys"))
    spans = spans.withColumn("turns", F.when(F.col("add"), F.concat(F.array("sys"), F.col("turns"))).otherwise(F.col("turns"))).withColumn("n_tokens", F.col("n") + F.when(F.col("add"), F.col("sys_n")).otherwise(0))
    step = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("loss"))

    def lay(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        target = t["assistant"] & (t["context"] == 0)
        return F.struct((end + len(END)).alias("at"), F.when(target, F.array_append(acc["loss"], F.struct(begin.alias("start"), end.alias("end")))).otherwise(acc["loss"]).alias("loss"))

    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    context = F.aggregate("turns", F.lit(0), lambda s, t: s + t["context"])
    return spans.select("conv_id", "block", "first_no", context.alias("n_context"), whole.alias("text"), F.aggregate("turns", step, lay)["loss"].alias("loss"), "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, block, first_no, formatted_chars, turns (role and text of the window's own turns), targets (texts under the loss mask)."""
    parts = F.split("text", r"<\|turn\|>", -1)
    pieces = F.slice(parts, F.col("n_context") + 2, F.size(parts))
    cut_end = lambda p: F.substring(p, F.lit(1), F.length(p) - len(END))
    turn = lambda p: F.struct(unescape(F.split(p, r"<\|text\|>", 2)[0]).alias("role"), unescape(cut_end(F.split(p, r"<\|text\|>", 2)[1])).alias("text"))
    target = lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return formatted.select("conv_id", "block", "first_no", F.length("text").cast("long").alias("formatted_chars"), F.transform(pieces, turn).alias("turns"), F.transform("loss", target).alias("targets"))
