"""Connected components of a table of edges, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinscope.llm.store import saved


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(c, g): for every end of an edge (a, b) the smallest member of its component.

    Alternating large-star and small-star rounds; each halves the distances or better, and is
    written to scratch. A hub's neighbours stay spread over tasks: only minima are grouped by node,
    pre-aggregated, and joins on a hot node can be split by the planner.
    """
    now = saved(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        after = saved(small, "edges")
        # Stars point at their smallest member and change no more.
        changed = after.join(now, ["u", "v"], "left_anti").isEmpty() and after.count() == now.count()
        now = after
        if changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("c"), F.col("v").alias("g")).unionByName(now.select(F.col("v").alias("c"), F.col("v").alias("g")).distinct())
