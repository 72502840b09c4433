"""Connected components of an edge table by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import keep


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has an edge to another, and the least node it reaches.

    In a round every node points at its least neighbour if that is less than
    itself; pointers are followed to their ends by doubling; edges between ends
    make the next, smaller graph.  A component of n nodes takes at most log2(n)
    rounds.  Neighbours are reduced by partial aggregates, and joins on a popular
    end are plain equi-joins of two shuffled tables, which adaptive execution
    splits; no group is gathered in one task.

    Self-loops, repeated edges and edges with a null end are ignored.  An empty
    table gives an empty result.
    """
    x, y = F.col(a), F.col(b)
    graph = edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    graph = keep(graph, "graph")
    levels: list[DataFrame] = []
    while not graph.isEmpty():
        # a > b, so b is less than a; b's own least neighbour may be less still
        hook = keep(graph.groupBy("a").agg(F.min("b").alias("to")), "hooks")
        while True:
            then = hook.select(F.col("a").alias("mid"), F.col("to").alias("end"))
            far = keep(
                hook.join(then, hook["to"] == then["mid"], "left").select("a", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().cast("int").alias("moved")),
                "hooks",
            )
            hook = far.select("a", "to")
            if far.where("moved = 1").isEmpty():
                break
        levels.append(hook)
        left = hook.select("a", F.col("to").alias("pa"))
        right = hook.select(F.col("a").alias("b"), F.col("to").alias("pb"))
        met = graph.join(left, "a").join(right, "b", "left").select("pa", F.coalesce("pb", "b").alias("pb"))
        met = met.where("pa != pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
        graph = keep(met.distinct(), "graph")
    if not levels:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # the end of a level is a node of a later one, or a root
    found = levels[-1].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for hook in reversed(levels[:-1]):
        later = found.select(F.col("node").alias("to"), "root")
        found = keep(
            hook.join(later, "to", "left").select(F.col("a").alias("node"), F.coalesce("root", "to").alias("root")).unionByName(found),
            "roots",
        )
    ends = found.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    return found.unionByName(ends)
