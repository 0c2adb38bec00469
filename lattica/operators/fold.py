"""Projections and network folding: pair weights, co-occurrence, cohorts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import OUT, Direction, PropertyGraph
from ..storage import cut
from .expand import first_map

Types = str | Iterable[str] | None


def fold_via(g: PropertyGraph, rel_type: Types, projection: DataFrame, direction: Direction | str = OUT) -> DataFrame:
    """(a, b, weight), a < b: relationships counted between the targets their ends are projected to ((id, target))."""
    p = projection.where("target IS NOT NULL").select("id", "target")
    ends = g.adj(direction, rel_type).join(p.select(F.col("id").alias("node"), F.col("target").alias("pa")), "node").join(p.select(F.col("id").alias("nbr"), F.col("target").alias("pb")), "nbr")
    return ends.where("pa <> pb").groupBy(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.count("*").alias("weight"))


def pair_weight(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(x, y, weight) for asked pairs in either order, null where there is none."""
    key = asked.select("x", "y", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return key.join(pairs, ["a", "b"], "left").select("x", "y", "weight")


def co_occurring(g: PropertyGraph, seed: int, rel_type: Types, direction: Direction | str = OUT, *, distinct_key: str | None = None) -> DataFrame:
    """(id, n): nodes that share centres with the seed, by the number of shared relationships, or of a centre property's values.

    The seed's neighbours by ``direction`` are the centres; other nodes reach them the same way. Centres without the property are skipped.
    """
    adj = g.adj(direction, rel_type).select("node", "nbr")
    centres = adj.where(F.col("node") == seed).select(F.col("nbr").alias("centre"))
    met = adj.where(F.col("node") != seed).select(F.col("node").alias("id"), F.col("nbr").alias("centre")).join(centres, "centre")
    if distinct_key is None:
        return met.groupBy("id").agg(F.count("*").alias("n"))
    value = g.nodes.where(F.col(distinct_key).isNotNull()).select(F.col("id").alias("centre"), F.col(distinct_key).alias("_v"))
    return met.join(value, "centre").groupBy("id").agg(F.countDistinct("_v").alias("n"))


@dataclass(frozen=True)
class NeighborGroups:
    """Neighbours of each source, projected step by step to the groups they belong to."""

    g: PropertyGraph
    sources: DataFrame
    rel_type: Types
    direction: Direction | str = OUT
    steps: tuple[tuple[Types, Direction | str], ...] = ()

    def project(self, *steps: Types | tuple[Types, Direction | str]) -> NeighborGroups:
        """Each step maps to the first neighbour by a type (outgoing unless given); members without one drop out."""
        more = tuple(s if isinstance(s, tuple) else (s, OUT) for s in steps)
        return replace(self, steps=(*self.steps, *more))

    def counts(self) -> DataFrame:
        """(id, grp, n): the members of each group of each source."""
        adj = self.g.adj(self.direction, self.rel_type).select(F.col("node").alias("id"), F.col("nbr").alias("grp")).join(self.sources.select("id").distinct(), "id", "left_semi")
        for types, direction in self.steps:
            step = first_map(self.g, direction, types).select(F.col("node").alias("grp"), F.col("nbr").alias("_next"))
            adj = adj.join(step, "grp").select("id", F.col("_next").alias("grp"))
        return adj.groupBy("id", "grp").agg(F.count("*").alias("n"))

    def sizes(self) -> DataFrame:
        """(id, size): the largest group of each source, 0 without any."""
        best = self.counts().groupBy("id").agg(F.max("n").alias("n"))
        return self.sources.join(best, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("size"))

    def top_by_size(self, n: int, tie: str | None = None) -> DataFrame:
        """The ``n`` sources of the largest groups; ties by a node property (absent: 0), then by id."""
        df = self.sizes()
        if tie is None:
            return df.orderBy(F.desc("size"), "id").limit(n)
        keyed = df.join(self.g.nodes.select("id", F.coalesce(F.col(tie), F.lit(0)).alias("_tie")), "id", "left")
        return keyed.orderBy(F.desc("size"), F.coalesce("_tie", F.lit(0)), "id").limit(n).select("id", "size")


def neighbor_groups(g: PropertyGraph, sources: DataFrame, rel_type: Types, direction: Direction | str = OUT) -> NeighborGroups:
    return NeighborGroups(g, sources, rel_type, direction)


def _paired(m: DataFrame, key: str, value: str, extra: Sequence[str] = (), *, rows: DataFrame | None = None, block: int = 1000) -> DataFrame:
    """(a, b, *extra, *extra of b with a leading _) of every two rows of ``m`` with the same ``key``, a < b by ``value``.

    A key of more than ``block`` rows is cut into blocks by a hash of the value, and each pair of blocks is a join key of its own: no
    task pairs more than two blocks, however many rows a key has. ``rows``: what ``m`` was made from, at least as many rows a
    key, where counting that is cheaper.
    """
    hubs = (m if rows is None else rows).groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("_g")).where("_g > 1")
    a, b = [F.col(value).alias("a"), *extra], [F.col(value).alias("b"), *[F.col(c).alias(f"_{c}") for c in extra]]
    if hubs.isEmpty():
        return m.select(key, *a).join(m.select(key, *b), key).where("a < b").drop(key)
    hubs = cut(hubs)
    plain = m.join(hubs, key, "left_anti")
    cells = m.join(hubs, key).withColumn("_at", F.pmod(F.xxhash64(value), F.col("_g")).cast("int")).withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    left = cells.select(key, F.col("_at").alias("_i"), F.col("_to").alias("_j"), *a)
    right = cells.select(key, F.col("_to").alias("_i"), F.col("_at").alias("_j"), *b)
    big = left.join(right, [key, "_i", "_j"]).where("a < b").drop(key, "_i", "_j")
    return plain.select(key, *a).join(plain.select(key, *b), key).where("a < b").drop(key).unionByName(big)


def pair_counts(g: PropertyGraph, rel_type: Types, direction: Direction | str = OUT, sources: DataFrame | None = None, *, block: int = 1000) -> DataFrame:
    """(a, b, n), a <= b: unordered neighbour pairs of each source, counted over all sources (parallel relationships pair up too).

    A source's neighbours are first counted, so m parallel relationships are one row and give m1*m2 pairs (or m*(m-1)/2 with
    themselves): no more rows than distinct pairs of distinct neighbours.
    """
    adj = g.adj(direction, rel_type)
    if sources is not None:
        adj = adj.join(sources.select(F.col("id").alias("node")), "node", "left_semi")
    m = adj.groupBy("node", "nbr").agg(F.count("*").alias("m"))
    pairs = _paired(m, "node", "nbr", ["m"], rows=adj.select("node"), block=block).select("a", "b", (F.col("m") * F.col("_m")).alias("k"))
    own = m.where("m > 1").select(F.col("nbr").alias("a"), F.col("nbr").alias("b"), F.floor(F.col("m") * (F.col("m") - 1) / 2).alias("k"))
    return pairs.unionByName(own).groupBy("a", "b").agg(F.sum("k").alias("n"))


def shared_neighbors(g: PropertyGraph, rel_type: Types, members: DataFrame, direction: Direction | str = OUT, *, least: int = 1, block: int = 1000) -> DataFrame:
    """(a, b, n), a < b: pairs of members by the number of distinct neighbours they share."""
    adj = g.adj(direction, rel_type).join(members.select(F.col("id").alias("node")), "node", "left_semi").select("node", "nbr")
    return _paired(adj.distinct(), "nbr", "node", rows=adj.select("nbr"), block=block).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def top(df: DataFrame, k: int, by: str = "n", keys: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(by), *keys).limit(k)
