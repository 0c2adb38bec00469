"""Parquet: node and relationship files, and saved graphs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import NODE_COLUMNS, REL_COLUMNS, PropertyGraph
from .tables import GraphLoader


def configure_s3(spark: SparkSession, *, endpoint: str | None = None, region: str | None = None, access_key: str | None = None, secret_key: str | None = None, path_style: bool = False, bucket: str | None = None) -> dict[str, str]:
    """Settings of the s3a file system for the session's reads (of one bucket, if given), which are returned; what isn't given stays as
    the cluster has it. Without keys the cluster's own credentials count."""
    prefix = f"fs.s3a.bucket.{bucket}." if bucket else "fs.s3a."
    given = {"endpoint": endpoint, "endpoint.region": region, "access.key": access_key, "secret.key": secret_key, "path.style.access": "true" if path_style else None}
    settings = {prefix + k: v for k, v in given.items() if v is not None}
    for k, v in settings.items():
        spark.sparkContext._jsc.hadoopConfiguration().set(k, v)
    return settings


def s3a(path: str) -> str:
    """An s3:// or s3n:// address under the scheme that Spark reads; any other path as it is."""
    scheme, mark, rest = path.partition("://")
    return f"s3a://{rest}" if mark and scheme in ("s3", "s3n") else path


def load_nodes_from_parquet(loader: GraphLoader, path: str, **kwargs) -> DataFrame:
    """Defaults: every column but id and labels is a property; a duplicate's properties go to the surviving node.

    ``path`` may name any file system that Spark reads (s3://, hdfs://, ...; see ``configure_s3``).
    """
    kwargs.setdefault("on_duplicate", "merge")
    return loader.load_nodes(loader.spark.read.parquet(s3a(path)), **kwargs)


def load_relationships_from_parquet(loader: GraphLoader, path: str, start_ref, end_ref, **kwargs) -> DataFrame:
    """Defaults: no property columns; rows without key values are never duplicates of one another."""
    kwargs.setdefault("null_keys", "skip")
    return loader.load_relationships(loader.spark.read.parquet(s3a(path)), start_ref, end_ref, **kwargs)


def read_from_parquet(
    spark: SparkSession, nodes_path: str | None, rels_path: str | None, *, node_id_column: str | None = None, label_columns=(), node_property_columns=None,
    start_ref="from", end_ref="to", rel_type_column: str | None = "type", rel_property_columns=(), fixed_rel_type: str | None = None, default_label: str | None = None, version: str | None = None,
) -> PropertyGraph:
    """A graph from one node file and one relationship file."""
    loader = GraphLoader(spark)
    if nodes_path:
        load_nodes_from_parquet(loader, nodes_path, node_id_column=node_id_column, label_columns=label_columns, property_columns=node_property_columns, default_label=default_label)
    if rels_path:
        load_relationships_from_parquet(loader, rels_path, start_ref, end_ref, rel_type_column=None if fixed_rel_type else rel_type_column, fixed_rel_type=fixed_rel_type, property_columns=rel_property_columns)
    return loader.graph(version)


def save_graph(g: PropertyGraph, path: str) -> None:
    """nodes/, rels/ (partitioned by type, so that a type filter reads its files only) and meta/ with the version."""
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.rels.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/rels")
    meta = json.dumps({"version": g.version, "rel_columns": g.rels.columns})
    g.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_graph(spark: SparkSession, path: str, *, topology_only: bool = False) -> PropertyGraph:
    """A saved graph. ``topology_only`` reads ids, labels, ends and types, no property columns."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    nodes = spark.read.parquet(f"{path}/nodes")
    rels = spark.read.parquet(f"{path}/rels").withColumn("rel_type", F.col("rel_type").cast("string")).select(meta["rel_columns"])
    if topology_only:
        nodes, rels = nodes.select(*NODE_COLUMNS), rels.select(*REL_COLUMNS)
    return PropertyGraph(nodes, rels, meta["version"])


def save_records(records: DataFrame, path: str) -> None:
    """Records (id, payload) ordered by id within files, so that a range of ids touches few of them."""
    records.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def load_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", "payload")
