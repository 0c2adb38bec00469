"""The grouped aggregation builder: an immutable chain that becomes one DataFrame plan.

Sources are the nodes of the requested labels; a node that carries two of them counts twice. ``filter`` conditions hold for the
population, which ``total`` counts; ``having`` drops rows after that count and before grouping.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bin_index, compare
from ..graph import OUT, Direction, PropertyGraph


@dataclass(frozen=True)
class AggResult:
    total: int
    rows: DataFrame
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Aggregation:
    g: PropertyGraph
    labels: tuple[str, ...]
    filters: tuple[tuple, ...] = ()
    vias: tuple[tuple, ...] = ()
    havings: tuple[tuple, ...] = ()
    groups: tuple[tuple, ...] = ()
    sum_of: str | None = None
    via: tuple[str, Direction | str] | None = None
    only: DataFrame | None = None
    strict_dense: bool = False

    def where(self, col: str, op: str, value: int) -> Aggregation:
        return replace(self, filters=(*self.filters, (col, op, value)))

    filter = where

    def where_via(self, projection: DataFrame, col: str, allowed: Iterable) -> Aggregation:
        """Keep a source whose projected node ((id, target)) has one of the allowed values."""
        return replace(self, vias=(*self.vias, (projection, col, tuple(allowed))))

    filter_via = where_via

    def having(self, col: str, op: str, value: int) -> Aggregation:
        return replace(self, havings=(*self.havings, (col, op, value)))

    def by_label(self) -> Aggregation:
        return replace(self, groups=(*self.groups, ("label",)))

    def by(self, col: str) -> Aggregation:
        return replace(self, groups=(*self.groups, ("by", col)))

    def bin(self, col: str, bounds: Sequence[int]) -> Aggregation:
        return replace(self, groups=(*self.groups, ("bin", col, tuple(bounds))))

    def sum(self, col: str) -> Aggregation:
        return replace(self, sum_of=col)

    def through(self, rel_type: str, direction: Direction | str = OUT) -> Aggregation:
        """Count relationships, grouped by neighbour; a sum adds the source's value once a relationship."""
        return replace(self, via=(rel_type, direction))

    def only_neighbors(self, members: DataFrame) -> Aggregation:
        return replace(self, only=members)

    # ---- plan ---------------------------------------------------------------------------------------------------------

    def _value(self, col: str):
        self.g.require_property(col, integral=True)
        return F.coalesce(F.col(col), F.lit(0)) if self.strict_dense else F.col(col)

    def population(self) -> DataFrame:
        """The counted sources: a row for each requested label a node carries, with column ``label``."""
        for label in self.labels:
            self.g.require_label(label)
        wanted = F.array(*[F.lit(x) for x in self.labels])
        df = self.g.nodes.withColumn("label", F.explode(F.array_intersect("labels", wanted)))
        for col, op, value in self.filters:
            df = df.where(compare(self._value(col), op, value))
        for projection, col, allowed in self.vias:
            self.g.require_property(col)
            good = self.g.nodes.where(F.col(col).isin(list(allowed))).select(F.col("id").alias("target"))
            df = df.join(projection.join(good, "target", "left_semi").select("id"), "id", "left_semi")
        return df

    def plan(self) -> tuple[DataFrame, tuple[str, ...]]:
        df = self.population()
        for col, op, value in self.havings:
            df = df.where(compare(self._value(col), op, value))
        keys = []
        for group in self.groups:
            if group[0] == "label":
                keys.append(("label", F.col("label")))
            elif group[0] == "by":
                keys.append((group[1], self._value(group[1])))
            else:
                keys.append((f"{group[1]}_bin", bin_index(self._value(group[1]), group[2])))
        measures = [F.count("*").alias("count")]
        df = df.select("id", *[c.alias(f"_k{i}") for i, (_, c) in enumerate(keys)], *([self._value(self.sum_of).alias("_v")] if self.sum_of else []))
        if self.via is not None:
            adj = self.g.adj(self.via[1], self.via[0]).select(F.col("node").alias("id"), F.col("nbr").alias("neighbor"))
            if self.only is not None:
                adj = adj.join(self.only.select(F.col("id").alias("neighbor")), "neighbor", "left_semi")
            df = df.join(adj, "id")
        if self.sum_of:
            measures.append(F.coalesce(F.sum("_v"), F.lit(0)).alias("sum"))
        by = [F.col(f"_k{i}").alias(name) for i, (name, _) in enumerate(keys)] + ([F.col("neighbor")] if self.via is not None else [])
        names = tuple(name for name, _ in keys) + (("neighbor",) if self.via is not None else ())
        out = df.groupBy(*by).agg(*measures) if by else df.agg(*measures)
        return out, (*names, "count", *(("sum",) if self.sum_of else ()))

    def run(self) -> AggResult:
        rows, fields = self.plan()
        return AggResult(self.population().count(), rows, fields)

    def total(self) -> DataFrame:
        return self.population().agg(F.count("*").alias("total"))


def aggregate(g: PropertyGraph, *labels: str, strict_dense: bool = False) -> Aggregation:
    return Aggregation(g, labels, strict_dense=strict_dense)


def group_reduce(df: DataFrame, keys: Sequence[str], sum_of: str | None = None) -> DataFrame:
    """The kernel alone: counts (and one sum) of rows by keys."""
    measures = [F.count("*").alias("count")] + ([F.sum(sum_of).alias("sum")] if sum_of else [])
    return df.groupBy(*keys).agg(*measures)
