"""Scalar expressions of the engine, all on the JVM side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth in km (fixed value).
EARTH_KM = 6371.0088


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits (Unicode), in order, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bin_index(value: Column, bounds: Sequence[int]) -> Column:
    """How many of the bounds are at or below the value: 0 to len(bounds)."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.when(value >= F.lit(b), 1).otherwise(0)
    return out.cast("int")


def compare(col: Column, op: str, value) -> Column:
    """``col op value`` for one of < <= > >= == !=."""
    ops = {"<": col < value, "<=": col <= value, ">": col > value, ">=": col >= value, "==": col == value, "!=": col != value}
    if op not in ops:
        raise ValueError(f"unknown comparison {op!r}")
    return ops[op]


def read_or(col: Column, kind: str, default) -> Column:
    """A property read as ``kind`` (long, double, boolean, string), with a default where it is absent or of another type."""
    return F.coalesce(col.try_cast(kind), F.lit(default).cast(kind))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def valid_position(lat: Column, lon: Column) -> Column:
    """Finite and within the ranges of latitude and longitude."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def wrap_add(a: Column, b: Column) -> Column:
    """The low 64 bits of a sum, as a long: halves of 32 bits can't overflow where ANSI arithmetic would raise."""
    mask = F.lit(0xFFFFFFFF)

    def of(x: Column, y: Column) -> Column:
        lower = x.bitwiseAND(mask) + y.bitwiseAND(mask)
        return let(lower, lambda low: F.shiftleft(F.shiftrightunsigned(x, 32) + F.shiftrightunsigned(y, 32) + F.shiftrightunsigned(low, 32), 32).bitwiseOR(low.bitwiseAND(mask)))

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def wrap_multiply(a: Column, constant: int) -> Column:
    """The low 64 bits of a product, as a long: the constant goes in by 16 bits, the value by 32, so no product overflows."""
    mask = F.lit(0xFFFFFFFF)

    def of(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(4):
            part = F.lit(constant >> (16 * k) & 0xFFFF).cast("long")
            low = F.shiftleft(x.bitwiseAND(mask) * part, 16 * k)
            high = F.shiftleft(F.shiftrightunsigned(x, 32) * part, 16 * k + 32) if 16 * k + 32 < 64 else F.lit(0).cast("long")
            out = wrap_add(out, wrap_add(low, high))
        return out

    return let(a, of)


def splitmix64(x: Column) -> Column:
    """The splitmix64 finaliser of a long (fixed constants), as a signed long."""
    z = wrap_add(x, F.lit(0x9E3779B97F4A7C15 - 2**64))
    z = let(z, lambda v: wrap_multiply(v.bitwiseXOR(F.shiftrightunsigned(v, 30)), 0xBF58476D1CE4E5B9))
    z = let(z, lambda v: wrap_multiply(v.bitwiseXOR(F.shiftrightunsigned(v, 27)), 0x94D049BB133111EB))
    return let(z, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-cased text; empty where it is shorter than ``n``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.length(low) < n, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n))))
    )
