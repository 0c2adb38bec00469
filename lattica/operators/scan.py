"""Node and relationship scans, predicates and point look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..functions.scalar import splitmix64
from ..graph import PropertyGraph


def info(g: PropertyGraph) -> DataFrame:
    """One row: nodes, relationships, version."""
    counts = g.nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(g.rels.agg(F.count("*").alias("relationships"))))
    return counts.withColumn("version", F.lit(g.version).cast("string"))


def node_count(g: PropertyGraph) -> int:
    return g.nodes.count()


def relationship_count(g: PropertyGraph) -> int:
    return g.rels.count()


def nodes_with_label(g: PropertyGraph, label: str) -> DataFrame:
    return g.with_label(label).select("id")


def label_flags(g: PropertyGraph, sources: DataFrame, label: str) -> DataFrame:
    """(id, has_label) for each source; False for an unknown node."""
    found = nodes_with_label(g, label).distinct().withColumn("_yes", F.lit(True))
    return sources.join(found, "id", "left").select("id", F.coalesce("_yes", F.lit(False)).alias("has_label"))


def node_labels(g: PropertyGraph, sources: DataFrame | None = None) -> DataFrame:
    """(id, label), a row for each label of each (source) node."""
    nodes = g.nodes if sources is None else g.nodes.join(sources, "id", "left_semi")
    return nodes.select("id", F.explode("labels").alias("label"))


def labels(g: PropertyGraph) -> DataFrame:
    return node_labels(g).select("label").distinct()


def label_counts(g: PropertyGraph) -> DataFrame:
    return node_labels(g).groupBy("label").agg(F.count("*").alias("n"))


def relationship_types(g: PropertyGraph) -> DataFrame:
    return g.rels.select("rel_type").distinct()


def type_counts(g: PropertyGraph) -> DataFrame:
    return g.rels.groupBy("rel_type").agg(F.count("*").alias("n"))


def _comparable(g: PropertyGraph, key: str, value) -> bool:
    """Types are held apart: a number never equals a text, an integer never a fraction's column."""
    if key not in g.property_keys():
        return False
    kind = g.nodes.schema[key].dataType.simpleString()
    fits = {bool: kind == "boolean", str: kind == "string", int: kind in ("bigint", "int", "smallint", "tinyint"), float: kind in ("double", "float")}
    return fits.get(type(value), False)


def _equals(g: PropertyGraph, key: str, value, column: str | None = None) -> Column:
    return F.col(column or key) == F.lit(value) if _comparable(g, key, value) else F.lit(False)


def nodes_with_property(g: PropertyGraph, label: str, key: str, value) -> DataFrame:
    """(id) of the label's nodes with the value; from the prepared look-up where the graph has one."""
    if (label, key) in g.indexes:
        return g.indexes[label, key].where(_equals(g, key, value, "value")).select("id")
    return g.with_label(label).where(_equals(g, key, value)).select("id")


def node_with_property(g: PropertyGraph, key: str, value) -> DataFrame:
    """One row: the smallest id of any label with the property (null if there is none)."""
    return g.nodes.where(_equals(g, key, value)).agg(F.min("id").alias("id"))


def node_with_label_property(g: PropertyGraph, label: str, key: str, value) -> DataFrame:
    return nodes_with_property(g, label, key, value).agg(F.min("id").alias("id"))


def prop(g: PropertyGraph, key: str, sources: DataFrame | None = None, *, default=None, empty_is_absent: bool = False) -> DataFrame:
    """(id, value) of a node property; an unknown key is absent everywhere."""
    nodes = g.nodes if sources is None else g.nodes.join(sources, "id", "left_semi")
    value = F.col(key) if key in g.property_keys() else F.lit(None).cast("string")
    if empty_is_absent:
        value = F.nullif(value, F.lit(""))
    if default is not None:
        value = F.coalesce(value, F.lit(default))
    return nodes.select("id", value.alias("value"))


def rel_prop(g: PropertyGraph, key: str, rel_types: str | Sequence[str] | None = None) -> DataFrame:
    """(rel_id, src, dst, value) of a relationship property."""
    rels = g.typed(rel_types)
    value = F.col(key) if key in g.rel_property_keys() else F.lit(None).cast("string")
    return rels.select("rel_id", "src", "dst", value.alias("value"))


def column(g: PropertyGraph, key: str, *, rels: bool = False) -> DataFrame:
    """A whole property column with its ids; ``toArrow()`` or ``toPandas()`` exports it."""
    df, name = (g.rels, "rel_id") if rels else (g.nodes, "id")
    if key not in df.columns:
        raise SchemaError(f"no property {key!r}")
    return df.select(name, key)


def dtype(g: PropertyGraph, key: str) -> str | None:
    return g.nodes.schema[key].dataType.simpleString() if key in g.property_keys() else None


def all_nodes(g: PropertyGraph) -> DataFrame:
    """Ids that carry a label or a property, or that a relationship touches."""
    known = F.size("labels") > 0
    for k in g.property_keys():
        known = known | F.col(k).isNotNull()
    touched = g.rels.select(F.explode(F.array("src", "dst")).alias("id"))
    return g.nodes.where(known).select("id").union(touched).distinct()


def all_relationships(g: PropertyGraph) -> DataFrame:
    return g.rels


def relationship(g: PropertyGraph, rel_id: int) -> DataFrame:
    return g.rels.where(F.col("rel_id") == rel_id)


def relationship_by_nodes(g: PropertyGraph, pairs: DataFrame) -> DataFrame:
    """(src, dst, rel_id) of the first relationship of each pair that has one."""
    return g.rels.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min("rel_id").alias("rel_id"))


def relationships_with_type(g: PropertyGraph, rel_type: str) -> DataFrame:
    return g.typed(rel_type)


def node_json(g: PropertyGraph, sources: DataFrame | None = None) -> DataFrame:
    """(id, json): id, labels and the properties that are set."""
    nodes = g.nodes if sources is None else g.nodes.join(sources, "id", "left_semi")
    props = F.struct(*g.property_keys()) if g.property_keys() else F.struct(F.lit(None).alias("_"))
    return nodes.select("id", F.to_json(F.struct("id", "labels", props.alias("properties"))).alias("json"))


def relationship_json(g: PropertyGraph) -> DataFrame:
    props = F.struct(*g.rel_property_keys()) if g.rel_property_keys() else F.struct(F.lit(None).alias("_"))
    return g.rels.select("rel_id", F.to_json(F.struct("rel_id", F.col("src").alias("start_node"), F.col("dst").alias("end_node"), "rel_type", props.alias("properties"))).alias("json"))


def node_hash(g: PropertyGraph) -> DataFrame:
    return g.nodes.select("id", splitmix64(F.col("id")).alias("hash"))
