"""Shared plumbing: shipping the package to executors, shared scratch tables, text batches, bounded labelled samples."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

_SHIPPED: set[str] = set()
_SCRATCH: list[tuple[SparkSession, str]] = []

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Rows and bytes of one Arrow batch: whole texts are long rows, and a batch is held several times over in a Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that Python workers import it wherever they run.

    Arrow batches are made small where the session doesn't set them itself.
    """
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="lattica-ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    if not _SCRATCH:
        atexit.register(release)
    _SCRATCH.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free(df: DataFrame | None) -> None:
    """Delete the table behind a frame that ``written`` gave, when no later plan reads it."""
    path = getattr(df, "scratch_path", None)
    if path is not None:
        _SCRATCH[:] = [x for x in _SCRATCH if x[1] != path]
        _delete(df.sparkSession, path)


def release() -> None:
    """Delete the scratch tables written so far (also done when the driver ends)."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may already be gone; the folder belongs to the cluster
            return


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it needs to clash with no column (in any letter case)."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name = "_" + name
        there.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0: rows that no model learns from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def lower_ascii(col: Column) -> Column:
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def bounded_sample(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About ``rows`` of the ``total`` rows, chosen by a hash of ``key`` (the same rows on every run); all of them when they fit."""
    if total <= rows:
        return df
    return df.where(F.xxhash64(key, F.lit(20240229)).bitwiseAND(F.lit(2**63 - 1)) < F.lit(rows * 2**63 // total))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: tuple[int, int]) -> tuple[DataFrame, tuple[int, int]]:
    """((doc_id, label, text) of about ``rows[k]`` labelled rows of each label k, how many rows have label 0 and 1).

    Held-out rows, null ids, null texts and labels other than 0 and 1 are left out. An id that comes several times counts once:
    with label 1 if any of its labels is, and with its least text. The sample is a table of its own, whole texts and all.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    found = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    totals = (found.n - found.ones, found.ones)
    picked = None
    for k in (0, 1):
        part = bounded_sample(marks.where(F.col("label") == k), F.col("doc_id"), rows[k], totals[k])
        picked = part if picked is None else picked.unionByName(part)
    # About sum(rows) pairs of numbers, whatever the table's size: broadcast, so that no text but the sample's is shuffled.
    own = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return written(own.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled"), totals


def row_slices(lengths: np.ndarray, budget: int):
    """Consecutive row ranges of at most ``budget`` summed length (a single longer row stands alone)."""
    start, used = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if used and used + n > budget:
            yield start, i
            start, used = i, 0
        used += n
    if start < len(lengths):
        yield start, len(lengths)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if big else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def sum_before(df: DataFrame, order: str, value: str, out: str, *, by: tuple[str, ...] = (), chunk: int = 4096) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of lower ``order`` (a long >= 0, unique within ``by``).

    In two steps, so that no task gathers all rows: sums of chunks of ``order``, then sums within a chunk.
    """
    from pyspark.sql import Window

    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    sums = cut.groupBy(*by, "_chunk").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_chunk").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    match = F.col("_chunk") == F.col("_of")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    within = Window.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return own.join(starts, match).withColumn(out, F.col("_start") + F.col("_within")).drop("_chunk", "_of", "_start", "_within", "_sum", *[f"_by_{c}" for c in by])
