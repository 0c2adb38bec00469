"""Language identification by hyperdimensional profiles.

Every letter, of any script, has a random vector of +1 and -1; a trigram's vector binds (multiplies) its letters' vectors, each
permuted (rolled) by its place; a document bundles (adds) the vectors of its trigrams, and a language bundles its documents. A
document goes to the language whose prototype has the highest cosine, after both are freed of the mean prototype.

Prototypes come from about ``per_language`` documents of each language outside the held-out fifth (documented bound; languages
are sampled one by one, so that a rare one keeps its rows on a table of any size); every whole text is then scored. Null texts
and texts without a letter are ``und`` with score 0, and so is everything when nothing could be learned. Equal cosines go to the
first language by code point. Rows with clashing or extra columns, repeated rows and empty tables are fine: only doc_id, text and
lang are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PER_LANGUAGE = 5_000
DIM = 1024
UNKNOWN = "und"
#: Trigram vectors that a task remembers, and trigrams looked up together.
_HELD, _TOGETHER = 32_768, 200_000


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    prototypes: np.ndarray  # a unit row for each language, freed of the centre
    centre: np.ndarray
    seed: int = 11


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            table[cp] = True
    return table


def letter_vectors(points: np.ndarray, seed: int, dim: int = DIM) -> np.ndarray:
    """A random vector of +1 and -1 for every code point (0: what stands between words), as int8 rows. The same on every machine."""
    x = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(dim // 64, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0xD1342543DE82EF95)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    bits = (x ^ (x >> np.uint64(31))).astype("<u8").view(np.uint8).reshape(len(points), dim // 8)
    return np.unpackbits(bits, axis=1).astype(np.int8) * 2 - 1


def trigram_vectors(codes: np.ndarray, seed: int, dim: int = DIM) -> np.ndarray:
    """The bound vectors of trigram codes (three code points of 21 bits), as int8 rows."""
    out = np.empty((len(codes), dim), np.int8)
    for lo in range(0, len(codes), 4096):
        part = codes[lo : lo + 4096]
        points = np.stack([part >> 42, (part >> 21) & 0x1FFFFF, part & 0x1FFFFF])
        letters, at = np.unique(points, return_inverse=True)
        at = at.reshape(3, -1)
        vectors = letter_vectors(letters, seed, dim)
        out[lo : lo + 4096] = np.roll(vectors, 2, axis=1)[at[0]] * np.roll(vectors, 1, axis=1)[at[1]] * vectors[at[2]]
    return out


class Vectors:
    """Bound vectors of the trigrams met lately; a task's memory is bounded, as it starts anew when they are too many."""

    def __init__(self, seed: int, dim: int = DIM, most: int = _HELD):
        self.seed, self.dim, self.most = seed, dim, most
        self.codes, self.at, self.table = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim), np.int8)
        self.used = 0

    def learn(self, codes: np.ndarray) -> bool:
        """Have all of ``codes`` (distinct, ascending) at hand; False if they are too many for that."""
        if len(codes) > self.most:
            return False
        place = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        new = codes if not len(self.codes) else codes[self.codes[place] != codes]
        if self.used + len(new) > self.most:
            self.codes, self.at, self.used, new = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, codes
        if len(new):
            if self.used + len(new) > len(self.table):
                grown = np.empty((min(self.most, max(2 * len(self.table), self.used + len(new))), self.dim), np.int8)
                grown[: self.used] = self.table[: self.used]
                self.table = grown
            self.table[self.used : self.used + len(new)] = trigram_vectors(new, self.seed, self.dim)
            where = np.searchsorted(self.codes, new)
            self.codes, self.at = np.insert(self.codes, where, new), np.insert(self.at, where, np.arange(self.used, self.used + len(new)))
            self.used += len(new)
        return True

    def bundle(self, codes: np.ndarray, weights: np.ndarray, known: bool) -> np.ndarray:
        """Sum of the weighted vectors of ``codes``; piece by piece where they aren't at hand."""
        if known:
            return weights @ self.table[self.at[np.searchsorted(self.codes, codes)]].astype(np.float32)
        out = np.zeros(self.dim, np.float32)
        for lo in range(0, len(codes), 4096):
            out += weights[lo : lo + 4096] @ trigram_vectors(codes[lo : lo + 4096], self.seed, self.dim).astype(np.float32)
        return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigram codes and counts of a text; None without any letter. Whatever stands between words counts as one blank."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letters = _is_letter()[points]
    if not letters.any():
        return None
    sym = np.where(letters, points, 0).astype(np.int64)
    sym = sym[letters | np.append(True, letters[:-1])]
    return np.unique((sym[:-2] << 42) | (sym[1:-1] << 21) | sym[2:], return_counts=True)


def profiles(texts: list[str | None], vectors: Vectors) -> list[np.ndarray | None]:
    """The unit vector of each text, or None without any letter. Counts are damped, so that no trigram of a long text rules alone."""
    out: list[np.ndarray | None] = [None] * len(texts)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def finish() -> None:
        known = vectors.learn(np.unique(np.concatenate([codes for _, codes, _ in held])))
        for i, codes, counts in held:
            mine = known or vectors.learn(codes)
            v = vectors.bundle(codes, np.log1p(counts).astype(np.float32), mine)
            n = float(np.sqrt(v @ v))
            out[i] = v / n if n else v
        held.clear()

    waiting = 0
    for i, text in enumerate(texts):
        found = trigrams(text) if text else None
        if found is not None:
            held.append((i, *found))
            waiting += len(found[0])
            if waiting > _TOGETHER:
                finish()
                waiting = 0
    if held:
        finish()
    return out


def fit(docs: DataFrame, *, per_language: int = PER_LANGUAGE, seed: int = 11) -> LanguageModel:
    common.ship(docs.sparkSession)
    train = docs.where(F.col("lang").isNotNull() & ~common.held_out(F.col("doc_id")))
    # The counts are taken without the texts: a row a language, of which the model will hold a prototype anyway.
    counts = train.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n"))
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("_n"))
    place = F.xxhash64("doc_id", F.lit(20240229)).bitwiseAND(F.lit(2**63 - 1)) / F.lit(2.0**63)
    picked = train.where(F.col("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(counts.withColumn("_share", share)), F.col("lang") == F.col("_lang")).where(place < F.col("_share"))

    def sums(batches):
        import pyarrow as pa

        vectors = Vectors(seed)
        acc: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, v in zip(batch.column(0).to_pylist(), profiles(batch.column(1).to_pylist(), vectors), strict=True):
                if v is not None:
                    acc[lang] = acc.get(lang, 0) + v.astype(np.float64)
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(list(acc)), pa.array([x.tobytes() for x in acc.values()], pa.binary())], ["lang", "bundle"])

    total_by: dict[str, np.ndarray] = {}
    # No more rows than sampled documents come back, whatever the size of the table.
    for r in sorted(picked.select("lang", "text").mapInArrow(sums, "lang string, bundle binary").collect(), key=lambda r: (r.lang, bytes(r.bundle))):
        total_by[r.lang] = total_by.get(r.lang, 0) + np.frombuffer(r.bundle, np.float64)
    langs = tuple(sorted(total_by))
    if not langs:
        return LanguageModel((), np.zeros((0, DIM), np.float32), np.zeros(DIM, np.float32), seed)
    unit = np.stack([total_by[k] / (np.linalg.norm(total_by[k]) or 1) for k in langs])
    centre = unit.mean(0) if len(langs) > 1 else np.zeros(DIM)
    free = unit - centre
    free /= np.maximum(np.linalg.norm(free, axis=1, keepdims=True), 1e-12)
    return LanguageModel(langs, free.astype(np.float32), centre.astype(np.float32), seed)


def predict_texts(texts: list[str | None], m: LanguageModel, vectors: Vectors) -> list[tuple[str, float]]:
    """(language, cosine; 0 where negative) of each text; ``und`` and 0 for a text without a letter, or of a model without languages."""
    if not m.langs:
        return [(UNKNOWN, 0.0)] * len(texts)
    out = []
    for v in profiles(texts, vectors):
        if v is None:
            out.append((UNKNOWN, 0.0))
            continue
        v = v - m.centre
        cos = m.prototypes @ (v / (np.sqrt(v @ v) or 1))
        best = int(cos.argmax())
        out.append((m.langs[best], min(1.0, max(0.0, float(cos[best])))))
    return out


def drop_unknown(docs: DataFrame, model: LanguageModel, *, languages: frozenset[str] | None = None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` in a known language (one of ``languages``, if given), with all their columns.

    A text goes if it is null, empty or without a letter, or if its cosine with the nearest language isn't above ``least`` (0: it is
    like none of them more than like their mean). Where the model has no languages nothing but the letters decides. Each of
    repeated rows stays or goes as the others do; columns of any names stay as they are; an empty table gives no rows.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        m = shared.value
        vectors = Vectors(m.seed)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if m.langs:
                keep = [x != UNKNOWN and score > least and (languages is None or x in languages) for x, score in predict_texts(texts, m, vectors)]
            else:
                keep = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: LanguageModel, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, then lang_pred and score (the cosine, 0 where negative)."""
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches):
        import pyarrow as pa

        m = shared.value
        vectors = Vectors(m.seed)
        for batch in batches:
            found = predict_texts(batch.column(batch.num_columns - 1).to_pylist(), m, vectors)
            langs, scores = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(marked, fit(docs), keep=("doc_id", "held_out"))
