"""Connected components with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.store import stage, unstage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every vertex of an undirected edge table with the smallest vertex that it can reach.

    Each round hooks a vertex, and the vertex it points at, to the smallest grandparent among its neighbours and
    then shortens the pointers, so a chain of n vertices needs about log n rounds. Only edges and one pointer a
    vertex move; every aggregate is a ``min``, combined before its shuffle, so hubs do not gather in one task.

    Null ends and loops are ignored; a vertex with loops alone is not returned. An empty table gives an empty
    result. Raises ``RuntimeError`` if ``max_rounds`` do not suffice.

    Returns ``(vertex, root)``.
    """
    linked = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    arcs = stage(linked.union(linked.select("v", "u")).distinct(), "arcs")
    pointers = stage(arcs.groupBy("u").agg(F.least("u", F.min("v")).alias("p")).select(F.col("u").alias("x"), "p"), "pointers")
    for _ in range(max_rounds):
        grand = pointers.join(pointers.select(F.col("x").alias("p"), F.col("p").alias("g")), "p")
        seen = arcs.join(grand.select(F.col("x").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        offers = grand.join(seen.withColumnRenamed("u", "x"), "x").select(
            F.explode(F.array(F.struct("x", F.least("m", "g").alias("p")), F.struct(F.col("p").alias("x"), F.least("m", "g").alias("p")))).alias("o")
        )
        following = stage(offers.select("o.*").groupBy("x").agg(F.min("p").alias("p")), "pointers")
        changed = following.join(pointers.withColumnRenamed("p", "old"), "x").where("p <> old").limit(1).count()
        unstage(pointers)
        pointers = following
        if not changed:
            unstage(arcs)
            return pointers.select(F.col("x").alias("vertex"), F.col("p").alias("root"))
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
