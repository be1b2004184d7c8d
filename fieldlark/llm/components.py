"""Connected components by local contraction, all on executors.

Each round every node points at the neighbour (or itself) of least random
priority and the graph is rewritten over those targets, which removes a
constant share of the nodes in expectation, chains included. Rounds go on
until no edge is left; nothing but "is there an edge" reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldlark.llm.common import kept


def _priority(name: str, salt: int):
    return F.struct(F.xxhash64(F.col(name), F.lit(salt)).alias("p"), F.col(name).alias("v"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b).

    ``root`` is some node of the component, the same for all its members.
    Self-loops and repeats are ignored; nodes without an edge to another node
    are absent. An empty input gives an empty result.
    """
    both = edges.select("a", "b").where("a <> b")
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    live = kept(both)
    steps: list[DataFrame] = []
    while not live.isEmpty():
        salt = len(steps)
        best = live.groupBy("a").agg(F.min(_priority("b", salt)).alias("best"))
        step = kept(best.select("a", F.least(F.col("best"), _priority("a", salt))["v"].alias("to")))
        steps.append(step)
        left = live.join(step, "a").select(F.col("to").alias("a"), "b")
        right = step.select(F.col("a").alias("b"), F.col("to").alias("other"))
        live = kept(left.join(right, "b").select("a", F.col("other").alias("b")).where("a <> b").distinct())
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for step in steps[1:]:
        nxt = step.select(F.col("a").alias("root"), "to")
        out = out.join(nxt, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
