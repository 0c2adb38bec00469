"""The property graph: a table of nodes and a table of directed, typed relationships.

nodes: id LONG, labels ARRAY<STRING>, one nullable column for each property key.
rels:  rel_id LONG, src LONG, dst LONG, rel_type STRING, one nullable column for each property key.

Relationships form a multigraph: parallel ones and self loops stay. ``rel_id`` orders them (first match, first neighbour).
A property that isn't set is NULL.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import NotFoundError, SchemaError

NODE_COLUMNS = ("id", "labels")
REL_COLUMNS = ("rel_id", "src", "dst", "rel_type")


class Direction(str, Enum):
    OUT = "out"
    IN = "in"
    BOTH = "both"

    @property
    def reversed(self) -> Direction:
        return {Direction.OUT: Direction.IN, Direction.IN: Direction.OUT}.get(self, Direction.BOTH)


OUT, IN, BOTH = Direction.OUT, Direction.IN, Direction.BOTH


def type_list(rel_types: str | Iterable[str] | None) -> list[str] | None:
    """None: every type. An empty list counts as None, as no filter was given."""
    if rel_types is None:
        return None
    out = [rel_types] if isinstance(rel_types, str) else list(rel_types)
    return out or None


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    rels: DataFrame
    version: str | None = None
    strict_names: bool = field(default=False, compare=False)
    indexes: dict[tuple[str, str], DataFrame] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        for df, needed, what in ((self.nodes, NODE_COLUMNS, "nodes"), (self.rels, REL_COLUMNS, "rels")):
            missing = [c for c in needed if c not in df.columns]
            if missing:
                raise SchemaError(f"{what} lack the columns {missing}")

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_version(self, version: str | None) -> PropertyGraph:
        return replace(self, version=version)

    # ---- relationships as seen from a node ----------------------------------------------------------------------------

    def typed(self, rel_types: str | Iterable[str] | None = None) -> DataFrame:
        """Relationships of the given types; an unknown type matches nothing."""
        wanted = type_list(rel_types)
        return self.rels if wanted is None else self.rels.where(F.col("rel_type").isin(wanted))

    def adj(self, direction: Direction | str = OUT, rel_types: str | Iterable[str] | None = None, *, props: Sequence[str] = ()) -> DataFrame:
        """(node, nbr, rel_type, rel_id, dir_ord, *props). BOTH lists outgoing, then incoming; nothing is made distinct."""
        direction = Direction(direction)
        rels = self.typed(rel_types)
        keep = ["rel_type", "rel_id", *props]
        missing = [p for p in props if p not in rels.columns]
        if missing:
            raise SchemaError(f"relationships have no property {missing}")
        out = rels.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), *keep, F.lit(0).alias("dir_ord"))
        if direction is OUT:
            return out
        back = rels.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), *keep, F.lit(1).alias("dir_ord"))
        return back if direction is IN else out.unionAll(back)

    # ---- nodes --------------------------------------------------------------------------------------------------------

    def has_label(self, label: str) -> Column:
        return F.array_contains("labels", label)

    def with_label(self, label: str) -> DataFrame:
        """Nodes that carry ``label``."""
        return self.nodes.where(self.has_label(label))

    def property_keys(self) -> list[str]:
        return [c for c in self.nodes.columns if c not in NODE_COLUMNS]

    def rel_property_keys(self) -> list[str]:
        return [c for c in self.rels.columns if c not in REL_COLUMNS]

    def require_label(self, label: str) -> None:
        if self.with_label(label).limit(1).isEmpty():
            raise NotFoundError(f"no label {label!r}")

    def require_type(self, rel_type: str) -> None:
        if self.typed(rel_type).limit(1).isEmpty():
            raise NotFoundError(f"no relationship type {rel_type!r}")

    def require_property(self, key: str, *, integral: bool = False) -> None:
        if key not in self.property_keys():
            raise SchemaError(f"nodes have no property {key!r}")
        kind = self.nodes.schema[key].dataType.simpleString()
        if integral and kind not in ("tinyint", "smallint", "int", "bigint"):
            raise SchemaError(f"property {key!r} is {kind}, not an integer")

    # ---- caching ------------------------------------------------------------------------------------------------------

    def persist(self) -> PropertyGraph:
        """Keep both tables in the executors' columnar cache."""
        return replace(self, nodes=self.nodes.persist(), rels=self.rels.persist())

    def unpersist(self) -> PropertyGraph:
        self.nodes.unpersist()
        self.rels.unpersist()
        return self

    def with_indexes(self, pairs: Iterable[tuple[str, str]]) -> PropertyGraph:
        """With look-ups by (label, key) prepared: values and ids dealt by value, kept in the executors' cache. Unknown keys have none."""
        made = dict(self.indexes)
        for label, key in pairs:
            if key in self.property_keys() and (label, key) not in made:
                found = self.with_label(label).where(F.col(key).isNotNull()).select(F.col(key).alias("value"), "id")
                made[label, key] = found.repartition("value").sortWithinPartitions("value").persist()
        return replace(self, indexes=made)

    def simple(self) -> PropertyGraph:
        """Without parallel relationships and self loops (types are told apart)."""
        return replace(self, rels=self.rels.where("src <> dst").dropDuplicates(["src", "dst", "rel_type"]))


def ids(spark: SparkSession, values: Iterable[int]) -> DataFrame:
    """A node set of the given ids."""
    return spark.createDataFrame([(int(v),) for v in values], "id long").distinct()


def bag(spark: SparkSession, values: Iterable[int]) -> DataFrame:
    """The given ids as they come, repeated ones repeated."""
    return spark.createDataFrame([(int(v),) for v in values], "id long")
