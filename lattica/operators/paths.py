"""Weighted shortest paths by relaxation: each round joins the nodes that improved with the adjacency."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import BOTH, OUT, Direction, PropertyGraph
from ..storage import cut

Types = str | Iterable[str] | None


@dataclass(frozen=True)
class ShortestPaths:
    """(id, dist, pred) of the nodes that were reached."""

    table: DataFrame
    source: int

    def distances(self) -> DataFrame:
        return self.table.select("id", "dist")

    def reached(self) -> DataFrame:
        return self.table.select("id")

    def distance(self, target: int) -> float | None:
        row = self.table.where(F.col("id") == target).first()
        return None if row is None else row.dist

    def path_to(self, target: int) -> list[int]:
        """Node ids from the source to the target; empty if it wasn't reached. One short look-up for each step of the path."""
        out, at = [], target
        while True:
            row = self.table.where(F.col("id") == at).first()
            if row is None:
                return []
            out.append(at)
            if row.pred is None:
                return out[::-1]
            at = row.pred

    def paths(self, targets: DataFrame, *, max_steps: int = 10_000) -> DataFrame:
        """(target, step, id) for all targets at once, step 0 at the target: predecessors joined step by step."""
        at = cut(targets.select(F.col("id").alias("target")).join(self.table, F.col("target") == F.col("id")).select("target", F.lit(0).alias("step"), "id", "pred"))
        out = at
        for k in range(1, max_steps):
            at = cut(at.where("pred IS NOT NULL").select("target", F.col("pred").alias("id")).join(self.table, "id").select("target", F.lit(k).alias("step"), "id", "pred"))
            if at.isEmpty():
                break
            out = out.unionByName(at)
        else:
            raise RuntimeError(f"a path is longer than {max_steps} steps")
        return out.select("target", "step", "id")


def relax(edges: DataFrame, source: int, *, target: int | None = None, max_rounds: int = 100_000, compact: int = 8) -> DataFrame:
    """(id, dist, pred) from ``edges`` (node, nbr, w >= 0). With a target, nothing farther than the target is followed or kept.

    Edges are dealt by their node once and cached. A round follows the nodes that the last one improved and keeps those it
    improves; what is known is the table of the last compaction and the improvements since, of which the best counts. Every
    ``compact`` rounds it is put together anew and written to the shared folder.
    Of equal distances the smaller predecessor counts. Negative or null weights are left out (a null weight: no passage).
    """
    spark = edges.sparkSession
    edges = edges.where("w >= 0").select("node", F.col("nbr").alias("id"), "w").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node").persist()
    none = F.lit(-1).cast("long")  # the source's predecessor, smaller than any other
    best = lambda df: df.groupBy("id").agg(F.min(F.struct("dist", "pred")).alias("c")).select("id", "c.dist", "c.pred")
    known = front = spark.createDataFrame([(source, 0.0, -1)], "id long, dist double, pred long")
    bound = None
    for k in range(max_rounds):
        step = edges.join(front.select(F.col("id").alias("node"), F.col("dist").alias("_d")), "node").select("id", (F.col("_d") + F.col("w")).alias("dist"), F.col("node").alias("pred"))
        if bound is not None:
            step = step.where(F.col("dist") <= bound)
        # Old and new side by side: an id is improved where the least is a new one.
        both = known.select("id", "dist", "pred", F.lit(0).alias("new")).unionAll(step.select("id", "dist", "pred", F.lit(1).alias("new")))
        least = both.groupBy("id").agg(F.min(F.struct("dist", "pred", "new")).alias("c")).where("c.new = 1")
        front = cut(least.select("id", "c.dist", "c.pred"))
        reached = front.agg(F.count("*"), F.min(F.when(F.col("id") == (target if target is not None else -1), F.col("dist")))).first()
        if not reached[0]:
            break
        if reached[1] is not None:
            bound = reached[1]
        known = known.unionByName(front)
        if k % compact == compact - 1:
            known = cut(best(known))
    else:
        raise RuntimeError(f"distances still improve after {max_rounds} rounds")
    out = best(known).select("id", "dist", F.nullif("pred", none).alias("pred"))
    out = cut(out if bound is None else out.where(F.col("dist") <= bound))
    edges.unpersist()
    return out


def _edges(g: PropertyGraph, direction: Direction | str, types: Types, weight: Column | None) -> DataFrame:
    adj = g.adj(direction, types, props=g.rel_property_keys())
    w = F.lit(1.0) if weight is None else weight
    # Parallel relationships: only the cheapest can matter.
    return adj.select("node", "nbr", w.cast("double").alias("w")).groupBy("node", "nbr").agg(F.min("w").alias("w"))


def dijkstra(g: PropertyGraph, source: int, direction: Direction | str = OUT, types: Types = None, *, weight: Column | None = None, target: int | None = None) -> ShortestPaths:
    """Shortest paths from one node. ``weight`` is an expression over a relationship's columns (None: 1 each)."""
    return ShortestPaths(relax(_edges(g, direction, types, weight), source, target=target), source)


def dijkstra_pair_weights(g: PropertyGraph, source: int, pairs: DataFrame, direction: Direction | str = BOTH, types: Types = None, *, base: float = 0.0, prune_missing: bool = True, target: int | None = None) -> ShortestPaths:
    """Costs 1 / (weight + base) from unordered pair weights (a, b, weight); pairs without one: no passage, or 1 / base."""
    edges = g.adj(direction, types).select("node", "nbr").distinct()
    keyed = edges.join(pairs, (F.least("node", "nbr") == F.col("a")) & (F.greatest("node", "nbr") == F.col("b")), "left")
    cost = F.try_divide(F.lit(1.0), F.col("weight") + F.lit(float(base)))
    if not prune_missing:
        cost = F.coalesce(cost, F.lit(1.0 / base if base else None).cast("double"))
    return ShortestPaths(relax(keyed.select("node", "nbr", cost.alias("w")), source, target=target), source)


def shortest_path(g: PropertyGraph, source: int, target: int, direction: Direction | str = BOTH, types: Types = None, *, weight_property: str | None = None) -> float | None:
    """Cost of the best path, None if there is none. A relationship without the weight property isn't passed."""
    weight = None if weight_property is None else F.col(weight_property)
    if source == target:
        return 0.0
    return dijkstra(g, source, direction, types, weight=weight, target=target).distance(target)


def weighted_shortest_path(g: PropertyGraph, source: int, target: int, direction: Direction | str = OUT, types: Types = None, *, weight: Column | None = None) -> float | None:
    return 0.0 if source == target else dijkstra(g, source, direction, types, weight=weight, target=target).distance(target)


def sssp(g: PropertyGraph, source: int, *, directed: bool = True, weight_key: str | None = None, missing: str = "unit", types: Types = None) -> DataFrame:
    """(id, dist) of every node, infinity where it can't be reached. ``missing``: a lacking weight is 1 ("unit") or no passage ("prune")."""
    weight = None
    if weight_key is not None:
        weight = F.col(weight_key).cast("double")
        weight = F.coalesce(weight, F.lit(1.0)) if missing == "unit" else weight
    found = dijkstra(g, source, OUT if directed else BOTH, types, weight=weight).distances()
    return g.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("dist", F.lit(float("inf"))).alias("dist"))
