"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors are rotated and cut into blocks of coordinates. Two vectors of cosine c differ by 2(1 - c) in squared distance, so at
least one block has no more than its proportional share of that: each block is joined by range under this budget, the union of
the blocks' candidates is checked exactly in double precision on the given vectors.

The rotation turns to the principal axes of a bounded sample, dealt out over the blocks. The range join of a block goes by slabs
of its first coordinate, the one of the widest spread, cut at quantiles of the sample; whatever the axes and cuts, the join is
exact. A vector is sent to every pair of slabs that can hold partners within the block's radius, at first only its name and the
block's coordinates; block distances of all in a pair come from matrix products. Whole vectors follow only for those that have a
candidate there. A pair found by several blocks counts in the first of them only, so a task returns counts and a spanning forest
of its links, never the links themselves.

Slabs grow in number and in size with the square root of the table, so that what is sent grows as its power of 1.5 where the
vectors have no structure (and the work, as in any exact join, as its square), up to ``SLAB_MOST`` rows a slab; where they have,
slabs far apart never meet.

Equal vectors are one class and are joined once. Null vectors, zero vectors and those with null or non-finite components link
with nothing; vectors of different lengths don't link. Components are taken as given, in single or double precision. Null ids
take part but don't name a component. Repeated rows are copies. Extra columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .graph_cc import components

THRESHOLD = 0.95
BLOCKS = 4
#: A table of n vectors has about sqrt(n / SPREAD) slabs, and more where they would exceed SLAB_MOST rows.
SPREAD, SLAB_MOST = 4096, 200_000
SAMPLE, SAMPLE_NUMBERS = 20_000, 4_000_000
_SLACK = 1e-4  # float32 block distances may err by far less than this share of the budget


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 41) -> np.ndarray:
    """A random rotation, for lengths that the sample doesn't hold."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def principal_rotation(units: np.ndarray, blocks: int) -> np.ndarray:
    """The principal axes of unit vectors as rows, dealt out so that every block begins with one of the widest."""
    _, axes = np.linalg.eigh(np.cov(units.T) if len(units) > 1 else np.eye(units.shape[1]))
    widest = axes.T[::-1]
    out, taken = np.empty_like(widest), 0
    bounds = block_bounds(units.shape[1], blocks)
    for k in range(max(e - s for s, e in bounds)):
        for s, e in bounds:
            if s + k < e:
                out[s + k] = widest[taken]
                taken += 1
    return out


def exact(raw: np.ndarray) -> np.ndarray:
    """The vectors in double precision, each scaled by a power of two, which changes no digit of a cosine but keeps squares in range."""
    raw = raw.astype(np.float64)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, initial=0))[1][:, None])


def block_bounds(dim: int, blocks: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int)
    return [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def rotated(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rotated unit vectors, each computed alike whatever rows stand beside it."""
    out = np.empty_like(x)
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        part = part / np.sqrt(np.add.reduce(part * part, axis=1))[:, None]
        out[lo : lo + 256] = np.add.reduce(part[:, None, :] * turn[None, :, :], axis=2)
    return out


def _budgets(dim: int, threshold: float, blocks: int) -> list[float]:
    whole = 2 * (1 - threshold) * (1 + _SLACK)
    return [whole * (b - a) / dim for a, b in block_bounds(dim, blocks)]


def _near(mine: np.ndarray, left: np.ndarray, right: np.ndarray, budget: float):
    """(p, q) of rows within the budget of one another, a bounded number of products at a time."""
    square = (mine * mine).sum(1)
    width = max(64, 4_000_000 // max(1, len(right)))
    for at in range(0, len(left), width):
        rows = left[at : at + width]
        p, q = np.nonzero(square[rows][:, None] + square[right][None, :] - 2 * (mine[rows] @ mine[right].T) <= budget + 1e-5)
        yield rows[p], right[q]


def _sides(side: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    left = np.arange(len(side)) if same else np.flatnonzero(side == 0)
    return left, left if same else np.flatnonzero(side == 1)


_PLACE = ("dim", "block", "i", "j")


def _candidate_task(threshold: float, blocks: int):
    """Of a pair of slabs, the vectors with a partner within the block's budget."""

    def run(table):
        import pyarrow as pa

        dim, block, i, j = (table.column(c)[0].as_py() for c in _PLACE)
        lo, hi = block_bounds(dim, blocks)[block]
        mine = np.frombuffer(b"".join(table.column("part").to_pylist()), np.float32).reshape(-1, hi - lo)
        left, right = _sides(table.column("side").to_numpy(), i == j)
        found = np.zeros(len(mine), bool)
        for p, q in _near(mine, left, right, _budgets(dim, threshold, blocks)[block]):
            p, q = p[p != q], q[p != q]
            found[p] = found[q] = True
        return table.filter(pa.array(found)).select([*_PLACE, "side", "cls"])

    return run


def _pair_task(threshold: float, blocks: int, turns, kind: str):
    """Of a pair of slabs, the exact links among the candidates: how many a vector has, and a spanning forest."""

    def run(table):
        import pyarrow as pa

        dim, block, i, j = (table.column(c)[0].as_py() for c in _PLACE)
        cls = table.column("cls").to_numpy()
        order = np.argsort(cls, kind="stable")  # the order rows come in is not fixed
        cls = cls[order]
        raw = exact(np.frombuffer(b"".join(table.column("raw").to_pylist()), kind).reshape(-1, dim)[order])
        copies = table.column("copies").to_numpy()[order]
        left, right = _sides(table.column("side").to_numpy()[order], i == j)
        turned, norm = rotated(raw, turns.value.get(dim, rotation(dim))), np.sqrt(np.add.reduce(raw * raw, axis=1))
        bounds, budgets = block_bounds(dim, blocks), _budgets(dim, threshold, blocks)
        lo, hi = bounds[block]
        counts, parent = np.zeros(len(cls), np.int64), np.arange(len(cls))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for p, q in _near(turned[:, lo:hi].astype(np.float32), left, right, budgets[block]):
            if i == j:
                p, q = p[p < q], q[p < q]
            for k in range(0, len(p), 50_000):
                a, b = p[k : k + 50_000], q[k : k + 50_000]
                cos = np.add.reduce(raw[a] * raw[b], axis=1) / (norm[a] * norm[b])
                ok = cos >= threshold
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                gap = (turned[a] - turned[b]) ** 2
                first = np.full(len(a), block)
                for other in range(block):
                    s, e = bounds[other]
                    first = np.where((first == block) & (np.add.reduce(gap[:, s:e], axis=1) <= budgets[other]), other, first)
                # The block itself is decided by the same exact distances, so that each pair has one first block.
                ok = (first == block) & (np.add.reduce(gap[:, lo:hi], axis=1) <= budgets[block])
                a, b = a[ok], b[ok]
                np.add.at(counts, a, copies[b])
                np.add.at(counts, b, copies[a])
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    x, y = find(x), find(y)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
        linked = np.flatnonzero(counts)
        roots = np.array([find(x) for x in linked.tolist()], np.int64)
        return pa.table({"a": pa.array(cls[linked]), "b": pa.array(cls[roots] if len(roots) else np.zeros(0, np.int64)), "k": pa.array(counts[linked])})

    return run


def embedding_links(vectors: DataFrame, *, threshold: float = THRESHOLD, blocks: int = BLOCKS, slab_rows: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. ``slab_rows`` sets the rows of a slab (None: by the table's size)."""
    spark = vectors.sparkSession
    common.ship(spark)
    kind = "float" if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else "double"
    v = F.col(vec_col).cast(f"array<{kind}>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), v).alias("vec"))
    # A class is named by a 64-bit hash of its vector's components.
    grouped = rows.where("vec IS NOT NULL").groupBy("vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = common.written(grouped.withColumn("cls", F.xxhash64("vec", F.lit(29))), "vector-classes")
    total, longest = classes.agg(F.count("*"), F.max(F.size("vec"))).first()
    sample = common.bounded_sample(classes, F.col("cls"), min(SAMPLE, SAMPLE_NUMBERS // (longest or 1)), total).select("cls", "vec").collect()
    by_dim: dict[int, list] = {}
    for r in sorted(sample, key=lambda r: r.cls):
        by_dim.setdefault(len(r.vec), []).append(r.vec)
    slabs = -(-total // slab_rows) if slab_rows else max(math.ceil(math.sqrt(total / SPREAD)), -(-total // SLAB_MOST))
    turns, cuts = {}, {}
    for dim, some in by_dim.items():
        x = exact(np.array(some, np.float64))
        turns[dim] = principal_rotation(x / np.sqrt((x * x).sum(1, keepdims=True)), blocks)
        turned = rotated(x, turns[dim])
        cuts[dim] = [np.quantile(turned[:, a], np.arange(1, slabs) / max(1, slabs)) for a, _ in block_bounds(dim, blocks)]
    held_turns, held_cuts = spark.sparkContext.broadcast(turns), spark.sparkContext.broadcast(cuts)
    dtype = "<f4" if kind == "float" else "<f8"

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            lists, cls = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            dims = np.array([len(x) for x in lists], np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                turned = rotated(exact(np.array([lists[k] for k in at], dtype)), held_turns.value.get(dim, rotation(dim)))
                for block, ((a, e), budget) in enumerate(zip(block_bounds(dim, blocks), _budgets(dim, threshold, blocks), strict=True)):
                    edges = held_cuts.value.get(dim, [np.zeros(0)] * (block + 1))[block]
                    t, r = turned[:, a], float(np.sqrt(budget)) + 1e-6
                    home = np.searchsorted(edges, t, side="right")
                    low, high = np.searchsorted(edges, t - r, side="right"), np.searchsorted(edges, t + r, side="right")
                    who = np.repeat(np.arange(len(at)), high - low + 1)
                    other = np.concatenate([np.arange(x, y + 1) for x, y in zip(low.tolist(), high.tolist(), strict=True)])
                    mine, n = home[who], len(who)
                    packed = [row.tobytes() for row in turned[:, a:e].astype("<f4")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(np.minimum(mine, other).astype(np.int32)), pa.array(np.maximum(mine, other).astype(np.int32)),
                         pa.array((mine > other).astype(np.int32)), pa.array(cls[at][who]), pa.array([packed[k] for k in who.tolist()], pa.binary())],
                        [*_PLACE, "side", "cls", "part"],
                    )

    place = "dim int, block int, i int, j int, side int, cls long"
    dealt = classes.select("cls", "vec").mapInArrow(deal, f"{place}, part binary")
    candidates = common.written(dealt.groupBy(*_PLACE).applyInArrow(_candidate_task(threshold, blocks), place), "vector-candidates")

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.array(x, dtype).tobytes() for x in batch.column(2).to_pylist()], pa.binary())], ["cls", "copies", "raw"])

    wanted = classes.join(candidates.select("cls").distinct(), "cls", "left_semi").select("cls", "copies", "vec").mapInArrow(pack, "cls long, copies long, raw binary")
    found = common.written(candidates.join(wanted, "cls").groupBy(*_PLACE).applyInArrow(_pair_task(threshold, blocks, held_turns, dtype), "a long, b long, k long"), "vector-links")
    common.free(candidates)
    links = found.groupBy(F.col("a").alias("cls")).agg(F.sum("k").alias("k"))
    root = components(found.select("a", "b"))
    rooted = classes.join(root.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    final = rooted.join(component, "root").join(links, "cls", "left").select("vec", (F.coalesce("k", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    named = rows.withColumn("key", F.xxhash64("vec", F.lit(29)))
    final = final.withColumn("key", F.xxhash64("vec", F.lit(29))).withColumnRenamed("vec", "_vec")
    out = named.join(final, (named["key"] == final["key"]) & (F.col("vec") == F.col("_vec")), "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(common.table(spark, sf_dir, "embeddings"))
