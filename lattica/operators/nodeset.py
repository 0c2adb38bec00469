"""Node sets: single-column tables of distinct ids, and their algebra."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import ids

T = TypeVar("T")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "id", "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "id", "left_anti")


def insert(s: DataFrame, values: Iterable[int]) -> DataFrame:
    return union(s, ids(s.sparkSession, values))


def remove(s: DataFrame, values: Iterable[int]) -> DataFrame:
    return s.where(~F.col("id").isin([int(v) for v in values]))


def contains(s: DataFrame, value: int) -> bool:
    return not s.where(F.col("id") == int(value)).limit(1).isEmpty()


def size(s: DataFrame) -> int:
    return s.count()


def is_empty(s: DataFrame) -> bool:
    return s.isEmpty()


def ascending(s: DataFrame) -> DataFrame:
    return s.orderBy("id")


def summary(s: DataFrame) -> DataFrame:
    """One row: n, min_id, max_id, and range_start/range_end (half open) where the ids have no gap."""
    agg = s.agg(F.count("*").alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))
    whole = F.col("max_id") - F.col("min_id") + 1 == F.col("n")
    return agg.select("n", "min_id", "max_id", F.when(whole, F.col("min_id")).alias("range_start"), F.when(whole, F.col("max_id") + 1).alias("range_end"))


def as_range(s: DataFrame) -> tuple[int, int] | None:
    """(first, last + 1) of a set without gaps, else None."""
    row = summary(s).first()
    return None if row.range_start is None else (row.range_start, row.range_end)


def par_fold(s: DataFrame, identity: Callable[[], T], fold: Callable[[T, int], T], combine: Callable[[T, T], T]) -> T:
    """Fold the ids with Python functions, partition by partition; the partial results are combined in a tree."""

    def one(part):
        return [reduce(lambda acc, row: fold(acc, row[0]), part, identity())]

    return s.select("id").rdd.mapPartitions(one).treeReduce(combine)
