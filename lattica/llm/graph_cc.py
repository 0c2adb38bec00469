"""Connected components of an edge table by repeated contraction; nothing is collected and no group is gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, written


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs); roots name the components.

    Each round sends a node to the neighbour (or itself) of the least random rank and contracts the edges; ranks are drawn anew
    every round, so a long path shrinks by a constant factor as well. Self loops and nulls are dropped.
    """
    a, b = F.col("a"), F.col("b")
    left = written(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    result = None
    for k in range(max_rounds):
        if left.isEmpty():
            break
        rank = F.struct(F.xxhash64(F.col("other"), F.lit(k)).alias("h"), F.col("other").alias("id"))
        both = left.select(a.alias("node"), b.alias("other")).union(left.select(b.alias("node"), a.alias("other")))
        best = both.groupBy("node").agg(F.min(rank).alias("m"))
        own = F.struct(F.xxhash64(F.col("node"), F.lit(k)).alias("h"), F.col("node").alias("id"))
        step = written(best.select("node", F.least(own, F.col("m"))["id"].alias("root")), "step")
        result = step if result is None else result.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        before, left = left, written(
            left.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        free(before)
    else:
        raise RuntimeError("connected components did not converge")
    if result is None:
        return left.select(a.alias("node"), b.alias("root"))
    return result
