"""How loaders refer to nodes and tell relationships apart."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CapacityError, SchemaError

MAX_ID = 2**32 - 1


@dataclass(frozen=True)
class IdRef:
    """The column holds node ids."""

    column: str


@dataclass(frozen=True)
class PropertyRef:
    """The column holds values of a node property (of one label, if given)."""

    column: str
    key: str
    label: str | None = None


@dataclass(frozen=True)
class CompositeRef:
    """The columns hold values of several node properties, all of which must be there."""

    columns: tuple[str, ...]
    keys: tuple[str, ...]
    label: str | None = None


NodeRef = IdRef | PropertyRef | CompositeRef


def as_ref(ref) -> NodeRef:
    """A reference from its short forms: a column name, or a dict with column(s), property/properties and label."""
    if isinstance(ref, str):
        return IdRef(ref)
    if isinstance(ref, dict):
        if "columns" in ref:
            return CompositeRef(tuple(ref["columns"]), tuple(ref["properties"]), ref.get("label"))
        return PropertyRef(ref["column"], ref["property"], ref.get("label")) if "property" in ref else IdRef(ref["column"])
    return ref


class RelDedup(str, Enum):
    CREATE_ALL = "create_all"
    UNIQUE_BY_TYPE = "unique_by_type"
    UNIQUE_BY_TYPE_AND_KEYS = "unique_by_type_and_keys"


def columns_of(ref: NodeRef) -> tuple[str, ...]:
    return ref.columns if isinstance(ref, CompositeRef) else (ref.column,)


def resolve(df: DataFrame, nodes: DataFrame, ref: NodeRef, out: str) -> DataFrame:
    """``df`` with column ``out``: the referred node's id (the least of several), null where none matches."""
    if isinstance(ref, IdRef):
        return df.withColumn(out, F.col(ref.column).cast("long"))
    keys, cols = (ref.keys, ref.columns) if isinstance(ref, CompositeRef) else ((ref.key,), (ref.column,))
    missing = [k for k in keys if k not in nodes.columns]
    if missing:
        raise SchemaError(f"nodes have no property {missing}")
    pool = nodes if ref.label is None else nodes.where(F.array_contains("labels", ref.label))
    for k in keys:
        pool = pool.where(F.col(k).isNotNull())
    found = pool.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("id").alias(out))
    cond = F.lit(True)
    for i, c in enumerate(cols):
        cond = cond & (df[c] == found[f"_k{i}"])
    return df.join(found, cond, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def check_ids(df: DataFrame, column: str) -> None:
    """Raise where an id is negative or beyond 32 bits (one aggregate)."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is not None and (low < 0 or high > MAX_ID):
        raise CapacityError(f"ids in {column!r} go from {low} to {high}")


def dedup_rels(rels: DataFrame, how: RelDedup, keys: Sequence[str], *, null_keys: str) -> DataFrame:
    """The first relationship (by rel_id) of each identity.

    ``null_keys`` "skip": null key parts don't count, and rows without any key part all stay; "present": the parts that are there
    make the key, none included.
    """
    if how is RelDedup.CREATE_ALL:
        return rels
    by = ["src", "dst", "rel_type"]
    if how is RelDedup.UNIQUE_BY_TYPE:
        return _first(rels, [F.col(c) for c in by])
    parts = F.map_from_entries(F.filter(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v"))) for k in sorted(keys)]), lambda x: x.isNotNull()))
    keyed = rels.withColumn("_key", F.to_json(parts))
    if null_keys == "skip":
        none = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNull() if keys else F.lit(True)
        stay = keyed.where(none).drop("_key")
        return _first(keyed.where(~none), [*[F.col(c) for c in by], F.col("_key")]).drop("_key").unionByName(stay)
    return _first(keyed, [*[F.col(c) for c in by], F.col("_key")]).drop("_key")


def _first(rels: DataFrame, by: list) -> DataFrame:
    """One row a group without a window: the struct of the least rel_id, combined before the shuffle."""
    whole = F.struct(*rels.columns)
    return rels.groupBy(*[c.alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.min_by(whole, F.col("rel_id")).alias("_r")).select("_r.*")
