"""Expansion over relationships: joins of a node set with the adjacency.

``sources`` is a table with an ``id`` column. Every function answers for all sources at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import OUT, Direction, PropertyGraph
from .scan import nodes_with_property

Types = str | Iterable[str] | None


def _joined(g: PropertyGraph, sources: DataFrame, direction: Direction | str, types: Types, props: Sequence[str] = ()) -> DataFrame:
    return g.adj(direction, types, props=props).join(sources.select(F.col("id").alias("node")), "node")


def neighbors(g: PropertyGraph, sources: DataFrame, direction: Direction | str = OUT, types: Types = None) -> DataFrame:
    """(node, nbr) as a bag: parallel relationships and, for BOTH, self loops repeat. A source listed twice counts twice."""
    return _joined(g, sources, direction, types).select("node", "nbr")


def neighbor_set(g: PropertyGraph, sources: DataFrame, direction: Direction | str = OUT, types: Types = None) -> DataFrame:
    """(node, nbr) without repeats."""
    return neighbors(g, sources, direction, types).distinct()


def neighbor_nodes(g: PropertyGraph, sources: DataFrame, direction: Direction | str = OUT, types: Types = None) -> DataFrame:
    """Neighbours with their labels and properties."""
    return neighbors(g, sources, direction, types).join(g.nodes.withColumnRenamed("id", "nbr"), "nbr")


def relationships(g: PropertyGraph, sources: DataFrame, direction: Direction | str = OUT, types: Types = None) -> DataFrame:
    """(node, nbr, rel_type, rel_id, dir_ord)."""
    return _joined(g, sources, direction, types)


def rels_with_props(g: PropertyGraph, sources: DataFrame, keys: Sequence[str], direction: Direction | str = OUT, types: Types = None, *, missing=None) -> DataFrame:
    """(node, nbr, rel_id, *keys); absent values are null, or ``missing``."""
    df = _joined(g, sources, direction, types, keys).select("node", "nbr", "rel_id", *keys)
    return df if missing is None else df.fillna(missing, list(keys))


def degree(g: PropertyGraph, sources: DataFrame, direction: Direction | str = OUT, types: Types = None) -> DataFrame:
    """(id, degree) of every source, 0 where nothing is adjacent; BOTH adds in and out."""
    n = _joined(g, sources.distinct(), direction, types).groupBy("node").agg(F.count("*").alias("n"))
    return sources.join(n, F.col("id") == F.col("node"), "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def first_neighbor(g: PropertyGraph, sources: DataFrame, direction: Direction | str = OUT, types: Types = None) -> DataFrame:
    """(node, nbr): the neighbour of the first relationship, outgoing before incoming; no row without one."""
    return first_map(g, direction, types).join(sources.select(F.col("id").alias("node")).distinct(), "node", "left_semi")


def first_map(g: PropertyGraph, direction: Direction | str = OUT, types: Types = None) -> DataFrame:
    """(node, nbr) of the first relationship of every node that has one."""
    return g.adj(direction, types).groupBy("node").agg(F.min_by("nbr", F.struct("dir_ord", "rel_id", "nbr")).alias("nbr"))


def follow(g: PropertyGraph, sources: DataFrame, steps: Sequence[tuple[Direction | str, Types]]) -> DataFrame:
    """(id, target): first neighbours step by step, null where a step has none."""
    at = sources.select("id", F.col("id").alias("target"))
    for direction, types in steps:
        step = first_map(g, direction, types).select(F.col("node").alias("target"), F.col("nbr").alias("_next"))
        at = at.join(step, "target", "left").select("id", F.col("_next").alias("target"))
    return at


def with_rel(g: PropertyGraph, sources: DataFrame, direction: Direction | str = OUT, types: Types = None, *, negate: bool = False) -> DataFrame:
    """The sources that have (or lack) a relationship."""
    there = g.adj(direction, types).select(F.col("node").alias("id"))
    return sources.join(there, "id", "left_anti" if negate else "left_semi")


def with_neighbor_property(g: PropertyGraph, sources: DataFrame, direction: Direction | str, types: Types, label: str, key: str, value, *, negate: bool = False) -> DataFrame:
    """The sources that have (or lack) a neighbour of ``label`` with the property."""
    good = nodes_with_property(g, label, key, value).select(F.col("id").alias("nbr"))
    there = g.adj(direction, types).join(good, "nbr", "left_semi").select(F.col("node").alias("id"))
    return sources.join(there, "id", "left_anti" if negate else "left_semi")


def neighbors_in_set(g: PropertyGraph, sources: DataFrame, direction: Direction | str, types: Types, members: DataFrame) -> DataFrame:
    """(node, nbr) as a bag, of neighbours that are in ``members``."""
    return neighbors(g, sources, direction, types).join(members.select(F.col("id").alias("nbr")), "nbr", "left_semi").select("node", "nbr")


def neighbor_counts(g: PropertyGraph, sources: DataFrame, direction: Direction | str = OUT, types: Types = None) -> DataFrame:
    """(nbr, n): how often each neighbour is met from the sources (repeated sources count again)."""
    return neighbors(g, sources, direction, types).groupBy("nbr").agg(F.count("*").alias("n"))


def popular(g: PropertyGraph, direction: Direction | str, types: Types, k: int, members: DataFrame | None = None) -> DataFrame:
    """(nbr, n): the ``k`` nodes met most often over the relationships, ties by id."""
    adj = g.adj(direction, types)
    if members is not None:
        adj = adj.join(members.select(F.col("id").alias("node")), "node", "left_semi")
    return adj.groupBy("nbr").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "nbr").limit(k)
