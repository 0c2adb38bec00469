"""CSV (also gzipped): node and relationship files with a header and typed columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BulkLoadError
from .refs import IdRef, RelDedup, as_ref
from .tables import GraphLoader, need

_TYPES = {"int64": "long", "float64": "double", "bool": "boolean", "string": "string"}


def read_csv(loader: GraphLoader, path: str, delimiter: str = ",", *, multi_line: bool = True) -> DataFrame:
    """All columns as strings; an empty cell is absent. ``multi_line`` False reads a large file in many tasks, where no cell has a line's end in it."""
    if len(delimiter.encode()) != 1:
        raise BulkLoadError("a delimiter is one byte")
    return loader.spark.read.csv(path, header=True, sep=delimiter, multiLine=multi_line, escape='"', nullValue="", emptyValue="")


def typed(df: DataFrame, column_types: dict[str, str] | None = None, skip: Sequence[str] = ()) -> DataFrame:
    """Columns by their hints; without one the narrowest of long, double, boolean, string that fits every cell.

    A column has one type: a hinted cell that doesn't fit makes its whole column a string (one pass over the file finds them).
    """
    hints = {k: v.lower() for k, v in (column_types or {}).items()}
    unknown = set(hints.values()) - {*_TYPES, "auto"}
    if unknown:
        raise BulkLoadError(f"unknown column types {sorted(unknown)}")
    cells = [c for c in df.columns if c not in skip]
    tests = []
    for i, c in enumerate(cells):
        there = F.col(c).isNotNull()
        ok = {k: ~F.bool_or(there & F.col(c).try_cast(t).isNull()) for k, t in _TYPES.items() if k != "string"}
        ok["bool"] = ~F.bool_or(there & ~F.lower(c).isin("true", "false"))
        tests += [F.coalesce(v, F.lit(True)).alias(f"{k}_{i}") for k, v in ok.items()]
    fits = df.agg(*tests).first() if tests else None
    out = []
    for c in df.columns:
        if c in skip:
            out.append(F.col(c))
            continue
        i, hint = cells.index(c), hints.get(c, "auto")
        order = ("int64", "float64", "bool") if hint == "auto" else () if hint == "string" else (hint,)
        kind = next((k for k in order if fits[f"{k}_{i}"]), "string")
        out.append(F.col(c).cast(_TYPES[kind]).alias(c))
    return df.select(*out)


def load_nodes_from_csv(loader: GraphLoader, path: str, *, node_id_column: str | None = None, label_columns=(), column_types=None, delimiter: str = ",", multi_line: bool = True, **kwargs) -> DataFrame:
    """A repeated node keeps its first row's properties; labels merge."""
    df = read_csv(loader, path, delimiter, multi_line=multi_line)
    need(df, [node_id_column, *label_columns])
    df = typed(df, column_types, skip=[c for c in (node_id_column, *label_columns) if c])
    if node_id_column:
        df = _ids(df, node_id_column)
    kwargs.setdefault("on_duplicate", "keep_first")
    return loader.load_nodes(df, node_id_column=node_id_column, label_columns=label_columns, **kwargs)


def _ids(df: DataFrame, column: str) -> DataFrame:
    bad = df.where(F.col(column).isNotNull() & F.col(column).try_cast("long").isNull()).select(column).first()
    if bad is not None:
        raise BulkLoadError(f"{bad[0]!r} in {column!r} is not a node id")
    return df.withColumn(column, F.col(column).cast("long"))


def load_relationships_from_csv(
    loader: GraphLoader, path: str, start_ref, end_ref, *, rel_type_column: str | None = None, fixed_rel_type: str | None = None, property_columns: Sequence[str] | None = None,
    deduplication: RelDedup | str = RelDedup.CREATE_ALL, column_types=None, delimiter: str = ",", key_property_columns: Sequence[str] | None = None, multi_line: bool = True, _frame: DataFrame | None = None, renames=None,
) -> DataFrame:
    """Defaults: every other column is a property; duplicates are told by all properties that are present."""
    df = read_csv(loader, path, delimiter, multi_line=multi_line) if _frame is None else _frame
    start, end = as_ref(start_ref), as_ref(end_ref)
    reserved = [c for r in (start, end) for c in (r.columns if hasattr(r, "columns") else (r.column,))] + ([rel_type_column] if rel_type_column else [])
    need(df, reserved, BulkLoadError)
    props = [c for c in df.columns if c not in reserved] if property_columns is None else list(property_columns)
    need(df, props)
    for ref in (start, end):
        if isinstance(ref, IdRef):
            df = _ids(df, ref.column)
    df = typed(df.select(*dict.fromkeys([*reserved, *props])), column_types, skip=[rel_type_column] if rel_type_column else [])
    keys = props if key_property_columns is None else key_property_columns
    dedup = RelDedup(deduplication)
    return loader.load_relationships(
        df, start, end, rel_type_column=rel_type_column, fixed_rel_type=fixed_rel_type, property_columns=props, deduplication=dedup,
        key_property_columns=keys if dedup is RelDedup.UNIQUE_BY_TYPE_AND_KEYS else (), null_keys="present", renames=renames,
    )


@dataclass(frozen=True)
class RelPropSpec:
    column: str
    name: str | None = None
    kind: str = "auto"


@dataclass(frozen=True)
class RelLoadSpec:
    start_ref: object
    end_ref: object
    rel_type: str
    props: tuple[RelPropSpec, ...] = ()


def load_relationships_from_csv_multi(loader: GraphLoader, path: str, specs: Sequence[RelLoadSpec], delimiter: str = ",") -> list[DataFrame]:
    """Several relationship types from one file, read once and cached; pairs made for each spec."""
    df = read_csv(loader, path, delimiter).persist()
    return [
        load_relationships_from_csv(
            loader, path, s.start_ref, s.end_ref, fixed_rel_type=s.rel_type, property_columns=[p.column for p in s.props],
            column_types={p.column: p.kind for p in s.props}, renames={p.column: p.name or p.column for p in s.props}, _frame=df,
        )
        for s in specs
    ]
