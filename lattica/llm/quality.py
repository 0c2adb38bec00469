"""Quality classifier by compression: zstandard dictionaries of good and of bad text, their size difference calibrated.

Two dictionaries are made from labelled texts. A document is cut into blocks of about ``BLOCK`` bytes, so that a dictionary helps
a long text as much as a short one; every block is compressed with either dictionary. The bytes that the good one saves over the
bad one, over the text's length, is the normalised size difference: the only thing a score depends on. A logistic calibration of
that one number, fitted on labelled rows that made no dictionary, turns it into the probability of label 1.

Learning uses about ``max_train`` labelled rows, as many of either label, and about ``dict_bytes`` of text a class (documented
bounds; whole texts of any length take part); a row weighs by the inverse of its label's sampling rate, so that scores mean the
same at any table size. Scoring compresses every whole text. A null or empty text has the difference 0. One label alone (or none)
gives the share of label 1 (or 0.5) as everyone's score. Labels or documents that repeat an id count once in learning; repeated
rows keep their own result rows, extra columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_TRAIN = 4000
DICT_BYTES = 2_000_000
DICT_SIZE = 110 * 1024
BLOCK = 1024
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    constant: float
    prior: float | None  # set where only one label was seen


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too little text, the text itself (newest last) serves as the dictionary's content."""
    import zstandard

    if len(samples) >= 64 and sum(map(len, samples)) >= 3 * DICT_SIZE:
        try:
            return zstandard.train_dictionary(DICT_SIZE, samples, k=256, d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(samples)[-DICT_SIZE:]


def _compressor(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, write_content_size=False)


def blocks(text: bytes) -> list[bytes]:
    """The whole text in pieces of nearly equal length, about ``BLOCK`` bytes each."""
    k = max(1, round(len(text) / BLOCK))
    cuts = [len(text) * i // k for i in range(k + 1)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def difference(text: bytes, good, bad) -> float:
    """Bytes saved by the good dictionary over the bad one, for each byte of the text."""
    if not text:
        return 0.0
    saved = 0
    for block in blocks(text):
        saved += len(bad.compress(block)) - len(good.compress(block))
    return saved / len(text)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> tuple[float, float]:
    """Slope and constant of a weighted logistic regression on one number (Newton's method)."""
    scale = float(np.sqrt(np.average(x * x, weights=weight))) or 1.0
    z, w = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    weight = weight * (len(x) / weight.sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = z.T @ (weight * (p - y)) + ridge * w
        move = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), grad)
        w -= move * min(1.0, 4.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, dict_bytes: int = DICT_BYTES) -> QualityModel:
    """Learn from rows outside the held-out fifth: about ``max_train`` of them, chosen by hash."""
    spark = docs.sparkSession
    common.ship(spark)
    table, (zeros, ones) = common.labelled_sample(docs, labels, "quality", (max_train // 2, max_train // 2))
    sample = table.withColumn("for_dict", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)) < 6)
    seen = {(r.label, r.for_dict): r for r in sample.groupBy("label", "for_dict").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    counts = [sum(r.n for (k, _), r in seen.items() if k == label) for label in (0, 1)]
    if not all(counts):
        common.free(table)
        return QualityModel(b"", b"", 0.0, 0.0, ones / (ones + zeros) if ones + zeros else 0.5)
    # A class without rows of one kind takes what it has (tables of a few labels).
    lacking = [k for k in (0, 1) if (k, True) not in seen or (k, False) not in seen]
    if lacking:
        sample = sample.withColumn("for_dict", F.col("for_dict") | F.col("label").isin(lacking))
    size = {k: sum(r.bytes for (label, d), r in seen.items() if label == k and (d or lacking)) for k in (0, 1)}

    def pieces(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for doc_id, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, piece in enumerate(blocks(text.encode())):
                    h = zlib.crc32(f"{doc_id}/{i}".encode())
                    if piece and h * size[label] < dict_bytes * 2**32:  # about dict_bytes of a class, from all over its texts
                        out.append((label, h, piece))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["label", "h", "piece"])

    got = sample.where("for_dict").select("doc_id", "label", "text").mapInArrow(pieces, "label int, h long, piece binary").collect()  # about 2 * dict_bytes
    parts = {k: [p for _, p in sorted((r.h, bytes(r.piece)) for r in got if r.label == k)] for k in (0, 1)}
    good, bad = _dictionary(parts[1]), _dictionary(parts[0])
    measured = sample if lacking else sample.where("NOT for_dict")
    rows = sorted((r.doc_id, r.label, r.x) for r in _measured(measured, good, bad, ("doc_id", "label")).collect())  # three numbers a sampled row
    y = np.array([r[1] for r in rows], float)
    weight = np.where(y == 1, ones / counts[1], zeros / counts[0])
    slope, constant = calibrate(np.array([r[2] for r in rows]), y, weight)
    common.free(table)
    return QualityModel(good, bad, slope, constant, None)


def _measured(rows: DataFrame, good: bytes, bad: bytes, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns and x, the normalised size difference."""
    shared = rows.sparkSession.sparkContext.broadcast((good, bad))
    picked = rows.select(*keep, F.col("text").alias("_text"))

    def run(batches):
        import pyarrow as pa

        g, b = map(_compressor, shared.value)
        for batch in batches:
            x = [difference((t or "").encode(), g, b) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.float64())], [*batch.schema.names[:-1], "x"])

    return picked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]) + ", x double")


def score_texts(docs: DataFrame, model: QualityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out(F.col("doc_id")).alias("held_out"), "text")
    if model.prior is not None:
        scored = rows.select("doc_id", "held_out", F.lit(float(model.prior)).alias("score"))
    else:
        z = F.lit(model.slope) * F.col("x") + F.lit(model.constant)
        scored = _measured(rows, model.good, model.bad, ("doc_id", "held_out")).select("doc_id", "held_out", (1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score_texts(docs, fit(docs, common.table(spark, sf_dir, "labels")))
