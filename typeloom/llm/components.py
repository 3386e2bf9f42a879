"""Connected components of an edge table, by least labels with pointer jumping; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import table


def components(edges: DataFrame, folder: str | None = None, most_rounds: int = 60) -> DataFrame:
    """(id, comp) for every id of the edges (a, b); comp is the least id of its component.

    Each round takes the least label of all neighbours, then the label of one's label, so the rounds needed grow with
    the logarithm of a component's diameter. Rounds are cut as tables in the shared folder. No edges give no rows.
    """
    both = edges.filter("a <> b").select("a", "b")
    both = table(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", folder)
    labels = table(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"), "labels", folder)
    for _ in range(most_rounds):
        seen = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("least"))
        lower = labels.join(seen, labels["id"] == seen["a"]).select("id", F.least("comp", "least").alias("next"), "comp")
        up = lower.select(F.col("id").alias("up_id"), F.col("next").alias("up"))
        step = table(lower.join(up, lower["next"] == up["up_id"], "left").select("id", F.least("next", F.coalesce("up", "next")).alias("next"), "comp"), "labels", folder)
        moved = step.filter("next <> comp").limit(1).count()
        labels = step.select("id", F.col("next").alias("comp"))
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def joined(comps: DataFrame, links: DataFrame, folder: str | None = None) -> DataFrame:
    """The components (id, comp) after more links (a, b): only the components that the links join are worked on."""
    of = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("a_comp", "a").alias("x"), F.coalesce("b_comp", "b").alias("y"))
    ends = table(ends, "ends", folder)
    moved = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), folder)
    # ids that were in no component are their own
    every = comps.unionByName(ends.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("x").alias("comp")), F.struct(F.col("b").alias("id"), F.col("y").alias("comp")))).alias("e")).select("e.*")).distinct()
    to = moved.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    return table(every.join(to, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "components", folder)
