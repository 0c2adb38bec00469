"""Node and relationship loading from any DataFrame: what the Parquet and CSV loaders share.

Nothing runs before the columns are checked. Every load is written once into the shared folder, with its row numbers and ids: a source
that is read again (and may come in other partitions then) can't give a row another number. The nodes that references meet are put
together once for each state of the loader.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BulkLoadError, SchemaError
from ..graph import NODE_COLUMNS, REL_COLUMNS, PropertyGraph
from ..storage import cut, stored
from .refs import IdRef, NodeRef, RelDedup, as_ref, check_ids, columns_of, dedup_rels, resolve

_KINDS = ((T.BooleanType, "boolean"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "long"), ((T.FloatType, T.DoubleType), "double"), (T.StringType, "string"))


def coerced(df: DataFrame, name: str, out: str):
    """The column as one of the four property types; other types are an error."""
    kind = df.schema[name].dataType
    for types, to in _KINDS:
        if isinstance(kind, types):
            return F.col(name).cast(to).alias(out)
    raise SchemaError(f"column {name!r} has the unsupported type {kind.simpleString()}")


def need(df: DataFrame, columns: Sequence[str | None], error=SchemaError) -> None:
    missing = [c for c in columns if c is not None and c not in df.columns]
    if missing:
        raise error(f"columns {missing} are missing; there are {df.columns}")


@dataclass
class GraphLoader:
    """Collects node and relationship loads; ``graph()`` is their union. ``on_duplicate``: "merge" or "keep_first"."""

    spark: object
    node_parts: list[DataFrame] = field(default_factory=list)
    rel_parts: list[DataFrame] = field(default_factory=list)
    unique: tuple[str, ...] = ()
    on_duplicate: str = "merge"
    skipped: list[DataFrame] = field(default_factory=list)
    _merged: tuple | None = None

    # ---- nodes --------------------------------------------------------------------------------------------------------

    def load_nodes(
        self, df: DataFrame, *, node_id_column: str | None = None, label_columns: Sequence[str] = (), property_columns: Sequence[str] | None = None,
        unique_properties: Sequence[str] = (), default_label: str | None = None, on_duplicate: str | None = None, validate: bool = True,
    ) -> DataFrame:
        """Adds nodes and returns the distinct ids that stand for the loaded rows."""
        need(df, [node_id_column, *label_columns, *(property_columns or ()), *unique_properties])
        if node_id_column is not None and not isinstance(df.schema[node_id_column].dataType, (T.IntegerType, T.LongType)):
            raise SchemaError(f"node ids in {node_id_column!r} are {df.schema[node_id_column].dataType.simpleString()}")
        props = [c for c in df.columns if c not in {node_id_column, *label_columns}] if property_columns is None else list(property_columns)
        extra = [c for c in unique_properties if c not in props]
        labels = F.array_distinct(F.array_compact(F.array(*[F.lit(default_label)] if default_label else [], *[F.when(F.col(c) != "", F.col(c).cast("string")) for c in label_columns]).cast("array<string>")))
        part = len(self.node_parts)
        seq = F.struct(F.lit(part).alias("part"), F.monotonically_increasing_id().alias("row"))
        rows, _ = stored(df.select(
            (F.col(node_id_column).cast("long") if node_id_column else F.lit(None).cast("long")).alias("id"), labels.alias("labels"),
            *[coerced(df, c, c) for c in [*props, *extra]], seq.alias("_seq"),
        ), "loaded-nodes")
        if node_id_column and validate:
            check_ids(rows, "id")
        rows = self._with_ids(rows)
        self.node_parts.append(rows)
        if unique_properties:
            self.unique = tuple(unique_properties)
        if on_duplicate:
            self.on_duplicate = on_duplicate
        return self._mapping().where(F.col("part") == part).select("id").distinct() if self.unique else rows.select("id").distinct()

    def _with_ids(self, rows: DataFrame) -> DataFrame:
        """Numbers rows without an id above all ids given so far."""
        if rows.where("id IS NULL").limit(1).isEmpty():
            return rows
        top = max([x for x in [rows.agg(F.max("id")).first()[0], *[p.agg(F.max("id")).first()[0] for p in self.node_parts]] if x is not None], default=-1)
        free = rows.where("id IS NULL")
        # Row numbers in file order: partitions are counted, then rows within each.
        numbered = free.withColumn("_p", F.shiftright(F.col("_seq.row"), 33))
        counts = numbered.groupBy("_p").agg(F.count("*").alias("_n"))
        starts = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
        given = numbered.withColumn("_rn", F.row_number().over(Window.partitionBy("_p").orderBy("_seq"))).join(F.broadcast(starts), "_p")
        given = given.withColumn("id", F.lit(top) + F.col("_start") + F.col("_rn")).drop("_p", "_rn", "_start", "_n")
        return cut(rows.where("id IS NOT NULL").unionByName(given.select(rows.columns)))

    def _all_rows(self) -> DataFrame | None:
        out = None
        for p in self.node_parts:
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
        return out

    def _mapping(self) -> DataFrame:
        """(row_id, id, part): the node every loaded row stands for. Rows with all unique properties meet by them; the first wins."""
        rows = self._all_rows()
        known = F.lit(True)
        for u in self.unique:
            known = known & F.col(u).isNotNull()
        first = rows.where(known).groupBy(*[F.col(u).alias(f"_u{i}") for i, u in enumerate(self.unique)]).agg(F.min_by("id", F.col("_seq")).alias("_id"))
        cond = F.lit(True)
        for i, u in enumerate(self.unique):
            cond = cond & (F.col(u) == F.col(f"_u{i}"))
        joined = rows.join(first, cond, "left") if self.unique else rows.withColumn("_id", F.lit(None).cast("long"))
        return joined.select(F.col("id").alias("row_id"), F.coalesce("_id", "id").alias("id"), F.col("_seq.part").alias("part"), "_seq")

    def nodes(self) -> DataFrame:
        """All nodes, merged; put together once until the next load."""
        state = (len(self.node_parts), self.unique, self.on_duplicate)
        if self._merged is None or self._merged[0] != state:
            self._merged = (state, stored(self._put_together(), "nodes")[0])
        return self._merged[1]

    def _put_together(self) -> DataFrame:
        rows = self._all_rows()
        if rows is None:
            return self.spark.createDataFrame([], "id long, labels array<string>")
        if self.unique:
            known = F.lit(True)
            for u in self.unique:
                known = known & F.col(u).isNotNull()
            first = rows.where(known).groupBy(*[F.col(u).alias(f"_u{i}") for i, u in enumerate(self.unique)]).agg(F.min_by("id", F.col("_seq")).alias("_id"))
            cond = F.lit(True)
            for i, u in enumerate(self.unique):
                cond = cond & (F.col(u) == F.col(f"_u{i}"))
            rows = rows.join(first, cond, "left").withColumn("id", F.coalesce("_id", "id")).drop("_id", *[f"_u{i}" for i in range(len(self.unique))])
        props = [c for c in rows.columns if c not in ("id", "labels", "_seq")]
        # Last set value wins when rows merge; the first row's when they don't. Labels merge either way.
        pick = F.max_by if self.on_duplicate == "merge" else F.min_by
        value = (lambda p: pick(F.col(p), F.when(F.col(p).isNotNull(), F.col("_seq")))) if self.on_duplicate == "merge" else (lambda p: pick(F.col(p), F.col("_seq")))
        return rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"), *[value(p).alias(p) for p in props])

    # ---- relationships ------------------------------------------------------------------------------------------------

    def load_relationships(
        self, df: DataFrame, start_ref, end_ref, *, rel_type_column: str | None = None, fixed_rel_type: str | None = None, property_columns: Sequence[str] = (),
        deduplication: RelDedup | str = RelDedup.CREATE_ALL, key_property_columns: Sequence[str] = (), null_keys: str = "skip", renames: dict[str, str] | None = None,
    ) -> DataFrame:
        """Adds relationships and returns the (start, end) pairs made. Rows with an unknown end or no type are left out and counted."""
        if rel_type_column is None and fixed_rel_type is None:
            raise BulkLoadError("a relationship type, or a column of types, is needed")
        start, end = as_ref(start_ref), as_ref(end_ref)
        need(df, [*columns_of(start), *columns_of(end), rel_type_column], BulkLoadError)
        need(df, [*property_columns, *key_property_columns])
        names = {c: (renames or {}).get(c, c) for c in dict.fromkeys([*property_columns, *key_property_columns])}
        ends = [c for r in (start, end) for c in columns_of(r)]
        kind = F.col(rel_type_column).cast("string") if rel_type_column else F.lit(fixed_rel_type)
        row = df.select(*[F.col(c).alias(f"_end{i}") for i, c in enumerate(ends)], kind.alias("rel_type"), *[coerced(df, c, n) for c, n in names.items()], F.monotonically_increasing_id().alias("_row"))
        row, _ = stored(row, "loaded-relationships")
        place = {c: f"_end{i}" for i, c in enumerate(ends)}
        nodes = self.nodes()
        for ref, out, at in ((start, "src", 0), (end, "dst", len(columns_of(start)))):
            cols = [f"_end{at + i}" for i in range(len(columns_of(ref)))]
            row = resolve(row, nodes, _moved(ref, cols), out)
        del place
        known = nodes.select("id")
        good = row.where(F.col("rel_type").isNotNull() & (F.col("rel_type") != ""))
        good = good.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
        part = len(self.rel_parts)
        rels, _ = stored(good.select((F.lit(part * 2**52) + F.col("_row")).cast("long").alias("rel_id"), "src", "dst", "rel_type", *names.values()), "relationships")
        # Two counts of one row each.
        self.skipped.append(row.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(rels.agg(F.count("*").alias("made")))).select((F.col("rows") - F.col("made")).alias("skipped")))
        rels = dedup_rels(rels, RelDedup(deduplication), [names[c] for c in key_property_columns], null_keys=null_keys)
        self.rel_parts.append(rels)
        return rels.select(F.col("src").alias("start"), F.col("dst").alias("end"))

    def skipped_rows(self) -> list[int]:
        """Of each relationship load, the rows that made no relationship for want of an end or a type."""
        return [s.first()[0] for s in self.skipped]

    def rels(self) -> DataFrame:
        out = None
        for p in self.rel_parts:
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
        return out if out is not None else self.spark.createDataFrame([], "rel_id long, src long, dst long, rel_type string")

    def graph(self, version: str | None = None) -> PropertyGraph:
        nodes, rels = self.nodes(), self.rels()
        return PropertyGraph(nodes.select(*NODE_COLUMNS, *[c for c in nodes.columns if c not in NODE_COLUMNS]), rels.select(*REL_COLUMNS, *[c for c in rels.columns if c not in REL_COLUMNS]), version)


def _moved(ref: NodeRef, cols: list[str]) -> NodeRef:
    """The same reference over renamed columns."""
    from dataclasses import replace

    return replace(ref, columns=tuple(cols)) if hasattr(ref, "columns") else replace(ref, column=cols[0])


__all__ = ["GraphLoader", "IdRef", "coerced", "need"]
