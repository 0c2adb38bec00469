"""Breadth-first searches and functional chains. Each level is a join with the adjacency; lineage is cut at every level."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import BOTH, OUT, Direction, PropertyGraph, type_list
from ..storage import cut
from .expand import first_map

Types = str | Iterable[str] | None


def _types(g: PropertyGraph, types: Types, legacy_unknown_types: bool) -> list[str] | None:
    """Unknown types match nothing; with ``legacy_unknown_types`` a filter of unknown types alone is no filter."""
    wanted = type_list(types)
    if wanted and legacy_unknown_types and g.typed(wanted).limit(1).isEmpty():
        return None
    return wanted


def _allowed(g: PropertyGraph, node_filter: Column | Callable[[int], bool] | None) -> DataFrame | None:
    """Ids that pass a filter: a condition on the node table's columns, or a Python function of the id (slower; in Arrow batches)."""
    if node_filter is None:
        return None
    if isinstance(node_filter, Column):
        return g.nodes.where(node_filter).select("id")

    def passing(batches):
        for pdf in batches:
            yield pdf[[bool(node_filter(int(i))) for i in pdf["id"]]]

    return g.nodes.select("id").distinct().mapInPandas(passing, "id long")


def _passable(adj: DataFrame, rel_filter: Column | Callable[[int, int, str, int], bool] | None) -> DataFrame:
    """Adjacency rows that pass a filter: a condition on the relationship's columns, or a Python function of (node, neighbour, type,
    rel_id), in Arrow batches. What the function raises ends the search."""
    if rel_filter is None or isinstance(rel_filter, Column):
        return adj if rel_filter is None else adj.where(rel_filter)

    def passing(batches):
        for pdf in batches:
            yield pdf[[bool(rel_filter(int(a), int(b), t, int(r))) for a, b, t, r in zip(pdf["node"], pdf["nbr"], pdf["rel_type"], pdf["rel_id"], strict=True)]]

    rows = adj.select("node", "nbr", "rel_type", "rel_id")
    return rows.mapInPandas(passing, "node long, nbr long, rel_type string, rel_id long")


def _adjacency(g: PropertyGraph, direction: Direction | str, types: list[str] | None, rel_filter) -> DataFrame:
    return _passable(g.adj(direction, types, props=g.rel_property_keys() if isinstance(rel_filter, Column) else ()), rel_filter)


def bfs_distances(
    g: PropertyGraph, starts: DataFrame, direction: Direction | str = OUT, types: Types = None, *, max_depth: int | None = None,
    node_filter=None, rel_filter=None, legacy_unknown_types: bool = False, until: DataFrame | None = None, within: DataFrame | None = None, include_starts: bool = True,
) -> DataFrame:
    """(id, depth): hops from the nearest start. Starts that fail the filter are dropped. Stops early when ``until`` is met.

    ``within``: ids that the search doesn't leave. ``include_starts`` False leaves the starts (depth 0) out of the result.
    """
    adj = _adjacency(g, direction, _types(g, types, legacy_unknown_types), rel_filter).select("node", "nbr")
    if rel_filter is not None and not isinstance(rel_filter, Column):
        adj = cut(adj)  # the Python function is asked once a relationship, not once a level
    if within is not None:
        adj = adj.join(within.select(F.col("id").alias("nbr")), "nbr", "left_semi").select("node", "nbr")
    good = _allowed(g, node_filter)
    if good is not None:
        adj = adj.join(good.withColumnRenamed("id", "nbr"), "nbr", "left_semi").select("node", "nbr")
        starts = starts.join(good, "id", "left_semi")
    # Each level is cut off: a plan that named all levels before, each of which names those before it, would double at every level.
    fresh = seen = cut(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        if until is not None and not fresh.join(until, "id", "left_semi").isEmpty():
            break
        frontier = fresh.select(F.col("id").alias("node"))
        fresh = cut(adj.join(frontier, "node").select(F.col("nbr").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth + 1)))
        if fresh.isEmpty():
            break
        depth += 1
        seen = seen.unionByName(fresh)
        if depth % 8 == 0:
            seen = cut(seen)
    return seen if include_starts else seen.where("depth > 0")


def bfs(
    g: PropertyGraph, starts: DataFrame, direction: Direction | str = OUT, types: Types = None, *, max_depth: int | None = None, node_filter=None, rel_filter=None,
    legacy_unknown_types: bool = False, include_starts: bool = True, within: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, rels): reached nodes with their depth, and the relationships (rel_id) that were met on the way.

    A relationship from a node that was expanded to a node that passes the filter is met, also when its end was known already.
    ``include_starts`` False: the nodes without the starts.
    """
    reached = bfs_distances(g, starts, direction, types, max_depth=max_depth, node_filter=node_filter, rel_filter=rel_filter, legacy_unknown_types=legacy_unknown_types, within=within)
    expanded = reached if max_depth is None else reached.where(F.col("depth") < max_depth)
    adj = _adjacency(g, direction, _types(g, types, legacy_unknown_types), rel_filter)
    met = adj.join(expanded.select(F.col("id").alias("node")), "node", "left_semi")
    good = _allowed(g, node_filter)
    if good is not None:
        met = met.join(good.withColumnRenamed("id", "nbr"), "nbr", "left_semi")
    return reached if include_starts else reached.where("depth > 0"), met.select("rel_id", "node", "nbr", "rel_type").distinct()


def neighborhood(g: PropertyGraph, seeds: DataFrame, direction: Direction | str, types: Types, lo: int, hi: int) -> DataFrame:
    """(id, depth) of the nodes at a hop distance of ``lo`` to ``hi``."""
    return bfs_distances(g, seeds, direction, types, max_depth=hi).where(F.col("depth") >= lo)


def can_reach(g: PropertyGraph, start: int, target: int, direction: Direction | str = OUT, types: Types = None, *, max_depth: int | None = None, legacy_unknown_types: bool = False) -> bool:
    """Whether a path leads there; a node reaches itself. The search ends at the level that meets the target."""
    if start == target:
        return True
    spark = g.spark
    one = lambda v: spark.createDataFrame([(v,)], "id long")
    reached = bfs_distances(g, one(start), direction, types, max_depth=max_depth, legacy_unknown_types=legacy_unknown_types, until=one(target))
    return not reached.where(F.col("id") == target).isEmpty()


def bidirectional_bfs(
    g: PropertyGraph, sources: DataFrame, targets: DataFrame, direction: Direction | str = OUT, types: Types = None, *, max_depth: int | None = None,
    node_filter=None, rel_filter=None, path_only: bool = False, legacy_unknown_types: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, rels): nodes met from both sides, and the relationships met from either, as (rel_id, node, nbr, rel_type) in the search's
    direction (``path_only``: between nodes met from both sides).

    Where a source is a target already there are no relationships. ``max_depth`` bounds each side; without it the backward side
    keeps to what the forward side reached, as nothing else can lie on a path.
    """
    direction = Direction(direction)
    both = sources.select("id").join(targets.select("id"), "id", "left_semi").distinct()
    if not both.isEmpty():
        return both, g.spark.createDataFrame([], "rel_id long, node long, nbr long, rel_type string")
    kwargs = {"max_depth": max_depth, "node_filter": node_filter, "legacy_unknown_types": legacy_unknown_types}
    back = rel_filter if rel_filter is None or isinstance(rel_filter, Column) else lambda a, b, t, r: rel_filter(b, a, t, r)
    f_nodes, f_rels = bfs(g, sources, direction, types, rel_filter=rel_filter, **kwargs)
    within = f_nodes if max_depth is None else None
    if within is not None:
        targets = targets.join(within, "id", "left_semi")
    b_nodes, b_rels = bfs(g, targets, direction.reversed, types, rel_filter=back, within=within, **kwargs)
    nodes = cut(f_nodes.select("id").join(b_nodes.select("id"), "id", "left_semi"))
    rels = f_rels.unionByName(b_rels.select("rel_id", F.col("nbr").alias("node"), F.col("node").alias("nbr"), "rel_type")).distinct()
    if path_only:
        end = lambda c: nodes.select(F.col("id").alias(c))
        rels = rels.join(end("node"), "node", "left_semi").join(end("nbr"), "nbr", "left_semi")
    return nodes, rels.select("rel_id", "node", "nbr", "rel_type")


def neighbor_via(g: PropertyGraph, rel_type: str, direction: Direction | str = OUT) -> DataFrame:
    """(id, target) of every node: its first neighbour by the type, or null."""
    return g.nodes.select("id").join(first_map(g, direction, rel_type).withColumnRenamed("node", "id"), "id", "left").select("id", F.col("nbr").alias("target"))


def roots_via(g: PropertyGraph, rel_type: str, direction: Direction | str = OUT, *, max_rounds: int = 40) -> DataFrame:
    """(id, target) of every node: the end of its chain of first neighbours; on a cycle, the cycle's least id.

    Pointers double each round, so a chain of n steps takes log2(n) joins. ``low`` is the least id met from a node on.
    """
    step = first_map(g, direction, rel_type)
    at = cut(step.select(F.col("node").alias("id"), F.col("nbr").alias("p"), F.least("node", "nbr").alias("low")))
    n_steps = at.count()
    for k in range(max_rounds):
        ahead = at.select(F.col("id").alias("p"), F.col("p").alias("q"), F.col("low").alias("low_q"))
        moved = at.join(ahead, "p", "left").select("id", F.coalesce("q", "p").alias("p"), F.least("low", "low_q").alias("low"), F.col("q").isNotNull().alias("moved"))
        at = cut(moved)
        if at.where("moved").isEmpty():
            break
        # What still moves after more steps than there are nodes is on, or leads to, a cycle.
        if 2 ** (k + 1) > n_steps:
            cyclic = at.where("moved").join(at.select(F.col("id").alias("p"), F.col("low").alias("cycle_low")), "p").select("id", F.col("cycle_low").alias("p"))
            at = cut(at.where("NOT moved").select("id", "p").unionByName(cyclic))
            break
    return g.nodes.select("id").join(at.select("id", "p"), "id", "left").select("id", F.coalesce("p", "id").alias("target"))


def root_via(g: PropertyGraph, node: int, rel_type: str, direction: Direction | str = OUT) -> int:
    return roots_via(g, rel_type, direction).where(F.col("id") == node).first().target


__all__ = ["BOTH", "bfs", "bfs_distances", "bidirectional_bfs", "can_reach", "neighbor_via", "neighborhood", "root_via", "roots_via"]
