"""Geographic search over two node properties, label scoped. Positions out of range or not finite are no positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EARTH_KM, haversine_km, valid_position
from ..graph import PropertyGraph


def positions(g: PropertyGraph, label: str, lat_key: str, lon_key: str) -> DataFrame:
    """(id, lat, lon) of the label's nodes that have a valid position."""
    if lat_key not in g.property_keys() or lon_key not in g.property_keys():
        return g.spark.createDataFrame([], "id long, lat double, lon double")
    lat, lon = F.col(lat_key).cast("double"), F.col(lon_key).cast("double")
    return g.with_label(label).where(valid_position(lat, lon)).select("id", lat.alias("lat"), lon.alias("lon"))


def _distance(lat: float, lon: float) -> Column:
    return haversine_km(F.col("lat"), F.col("lon"), F.lit(float(lat)), F.lit(float(lon)))


def within_radius(g: PropertyGraph, label: str, lat_key: str, lon_key: str, lat: float, lon: float, km: float) -> DataFrame:
    """(id, km) within the great-circle distance; a negative one finds nothing. A band of latitudes goes before the trigonometry."""
    df = positions(g, label, lat_key, lon_key)
    if km < 0:
        return df.where(F.lit(False)).select("id", F.lit(0.0).alias("km"))
    band = math.degrees(km / EARTH_KM) + 1e-9
    if band < 180:
        df = df.where(F.col("lat").between(lat - band, lat + band))
    return df.select("id", _distance(lat, lon).alias("km")).where(F.col("km") <= km)


def within_bbox(g: PropertyGraph, label: str, lat_key: str, lon_key: str, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> DataFrame:
    """(id) within the box, borders included; ``min_lon`` above ``max_lon`` crosses the antimeridian."""
    df = positions(g, label, lat_key, lon_key).where(F.col("lat").between(min_lat, max_lat))
    inside = F.col("lon").between(min_lon, max_lon) if min_lon <= max_lon else (F.col("lon") >= min_lon) | (F.col("lon") <= max_lon)
    return df.where(inside).select("id")


def knn(g: PropertyGraph, label: str, lat_key: str, lon_key: str, lat: float, lon: float, k: int) -> DataFrame:
    """(id, km): the ``k`` nearest nodes, ties by id."""
    return positions(g, label, lat_key, lon_key).select("id", _distance(lat, lon).alias("km")).orderBy("km", "id").limit(k)


def near_pairs(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """(left_id, right_id, km) of positions within a distance, by a grid of cells as wide as the distance (an equi-join).

    Positions near a pole or the antimeridian meet through wrapped cells; the exact distance decides.
    """
    step = max(1e-6, math.degrees(km / EARTH_KM))
    rows = max(1, math.floor(180 / step))
    row = lambda lat: F.least(F.floor((lat + 90) / (180 / rows)), F.lit(rows - 1)).cast("long")

    def columns(r: Column) -> Column:
        """Cells in a row: as many as fit at its edge farthest from the equator, at least one."""
        edge = F.greatest(F.abs(r * (180 / rows) - 90), F.abs((r + 1) * (180 / rows) - 90))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / step)).cast("long")

    col = lambda lon, n: F.least(F.floor((lon + 180) / 360 * n), n - 1).cast("long")
    a = left.select(F.col("id").alias("left_id"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), row(F.col("lat")).alias("r"))
    a = a.withColumn("c", col(F.col("lon1"), columns(F.col("r"))))
    # The right side goes to each cell its distance can reach: three rows, and in each the cells of its span of longitudes.
    b = right.select(F.col("id").alias("right_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(F.array(*[row(F.col("lat")) + d for d in (-1, 0, 1)])).alias("r"))
    b = b.where((F.col("r") >= 0) & (F.col("r") < rows)).withColumn("n", columns(F.col("r")))
    ratio = F.sin(F.lit(min(km / EARTH_KM, math.pi / 2))) / F.greatest(F.cos(F.radians("lat2")), F.lit(1e-12))
    span = F.when(ratio < 1, F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9).otherwise(F.lit(180.0))
    cell = lambda lon: F.floor((lon + 180) / 360 * F.col("n"))
    cells = F.when(span >= 180, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.sequence(cell(F.col("lon2") - span).cast("long"), cell(F.col("lon2") + span).cast("long")))
    b = b.select("right_id", "lat2", "lon2", "r", F.explode(F.array_distinct(F.transform(cells, lambda c: F.pmod(c, F.col("n"))))).alias("c"))
    km_of = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.join(b, ["r", "c"]).select("left_id", "right_id", km_of.alias("km")).where(F.col("km") <= km)
