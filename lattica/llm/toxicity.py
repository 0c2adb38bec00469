"""Toxicity by a classifier chain of linear models over word features.

The categories stand in a fixed order; the model of each sees the text's features and the probabilities of the categories before
it. While training, those are out-of-fold predictions: the features, the earlier models' inputs and the model that predict a row
come from the other folds alone. A category's labels are a column of the labels table, or, where the table tells only toxic from
clean, the kinds that its toxic rows fall into (spherical k-means over their marking words): "is it toxic, and of this kind".

Features are the presence of whole words and of word beginnings of 3 to 6 letters; those that tell toxic from clean rows best
are kept. Learning uses about ``max_train`` labelled rows, two thirds of them clean (a documented bound; whole texts of any
length), each weighing by the inverse of its label's sampling rate; every whole text is scored. Null or empty texts get the score
of a text without features. With one label only, the score is that label's share. Labels or documents that repeat an id count
once in learning. Extra columns aren't read; repeated rows keep their own rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_TRAIN = 4500
MAX_FEATURES = 300
FOLDS = 3
THRESHOLD = 0.5
_WORDS = re.compile(r"[^\W\d_]+")

#: Category, and the labels column it is learned from (None: a kind of toxic row, found by clustering). The last one decides.
CHAIN = (("kind_1", None), ("kind_2", None), ("kind_3", None), ("toxic", "toxic"))


@dataclass(frozen=True)
class ToxicityModel:
    vocabulary: dict[str, int]
    weights: tuple[np.ndarray, ...]  # a category's: features, then the earlier probabilities, then the constant
    categories: tuple[str, ...]


def word_features(word: str) -> tuple[str, ...]:
    return (word, *("^" + word[:n] for n in (3, 4, 5, 6) if len(word) >= n))


def _present(text: str, vocabulary: dict[str, int], memo: dict[str, tuple[int, ...]]) -> set[int]:
    found: set[int] = set()
    for w in set(_WORDS.findall(text.lower())):
        ids = memo.get(w)
        if ids is None:
            if len(memo) > 400_000:
                memo.clear()
            ids = memo[w] = tuple(vocabulary[f] for f in word_features(w) if f in vocabulary)
        if ids:
            found.update(ids)
    return found


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _fit_linear(x: np.ndarray, y: np.ndarray, sample: np.ndarray, ridge: float = 0.5, steps: int = 12) -> np.ndarray:
    """Newton steps for a ridge logistic regression; the last column is the constant, hardly penalised."""
    if y.min(initial=1) == y.max(initial=0):
        w = np.zeros(x.shape[1])
        w[-1] = _logit(np.array([y.mean() if len(y) else 0.5]))[0]
        return w
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-4
    for _ in range(steps):
        p = _sigmoid(x @ w)
        grad = x.T @ (sample * (p - y)) + penalty * w
        if np.abs(grad).max() < 1e-4:
            break
        hess = (x * (sample * p * (1 - p))[:, None]).T @ x
        hess[np.diag_indices_from(hess)] += penalty + 1e-9
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 5.0 / np.abs(move).max())
    return w


class _Numbered:
    """Features of training texts as numbers: each distinct word is looked at once, and a text is an array."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.words: dict[str, list[int]] = {}

    def text(self, words: list[str]) -> np.ndarray:
        found: list[int] = []
        for w in words:
            ids = self.words.get(w)
            if ids is None:
                ids = self.words[w] = [self.ids.setdefault(f, len(self.ids)) for f in word_features(w)]
            found += ids
        return np.unique(np.array(found, np.int32))


def select(rows: list[np.ndarray], y: np.ndarray, n_features: int, most: int) -> np.ndarray:
    """Features by how far their share among toxic rows exceeds chance (G of the 2x2 table), the strongest first."""
    a, b = np.zeros(n_features), np.zeros(n_features)
    for r, t in zip(rows, y, strict=True):
        (a if t else b)[r] += 1
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    share = np.maximum(a + b, 1) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(a > 0, a * np.log(a / (n1 * share)), 0) + np.where(b > 0, b * np.log(b / (n0 * share)), 0))
    g[(a + b < 3) | (a / n1 <= b / n0)] = 0
    best = np.argsort(-g, kind="stable")[:most]
    return best[g[best] > 6]


def kinds(x: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Spherical k-means of presence rows: the kind of each row.

    A centre starts from the rows of one feature: that with most rows which no earlier centre's feature has. Ties go to the
    first; a row without features is of kind 0.
    """
    if not len(x):
        return np.zeros(0, np.int64)
    z = x * np.log1p(len(x) / np.maximum(x.sum(0), 1))
    z /= np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-12)
    held, free = np.zeros((k, x.shape[1])), np.ones(len(x), bool)
    for j in range(k):
        if x.shape[1] and x[free].any():
            own = free & (x[:, x[free].sum(0).argmax()] > 0)
            held[j] = z[own].sum(0)
            free &= ~own
    at = np.full(len(z), -1)
    for _ in range(rounds):
        held /= np.maximum(np.sqrt((held * held).sum(1, keepdims=True)), 1e-12)
        new = np.argmax(z @ held.T, axis=1)
        if (new == at).all():
            break
        at = new
        for j in range(k):
            if (at == j).any():
                held[j] = z[at == j].sum(0)
    return at


def fit_rows(texts: list[list[str]], columns: dict[str, np.ndarray], sample: np.ndarray, chain=CHAIN, *, folds: int = FOLDS, most: int = MAX_FEATURES) -> ToxicityModel:
    """The chain from the words of labelled texts. ``sample``: weight of each row. Row i belongs to fold i mod ``folds``."""
    numbered = _Numbered()
    rows = [numbered.text(words) for words in texts]
    n, total = len(rows), len(numbered.ids)
    y = columns[chain[-1][1]].astype(float)
    sample = sample * (n / sample.sum()) if n else sample
    fold = np.arange(n) % folds
    views = [np.flatnonzero(fold != f) for f in range(folds)]
    chosen = [select([rows[i] for i in at], y[at] > 0, total, most) for at in (np.arange(n), *views)]
    union = np.unique(np.concatenate(chosen)) if n else np.zeros(0, np.int64)
    column = np.full(total, -1, np.int64)
    column[union] = np.arange(len(union))
    x = np.zeros((n, len(union)))
    for i, r in enumerate(rows):
        at = column[r]
        x[i, at[at >= 0]] = 1
    everything, *by_fold = [column[c] for c in chosen]
    toxic = np.flatnonzero(y > 0)
    found = [name for name, col in chain if col is None]
    kind = np.full(n, -1)
    kind[toxic] = kinds(x[toxic][:, everything], max(1, len(found)))
    targets = [columns[col].astype(float) if col is not None else (kind == found.index(name)).astype(float) for name, col in chain]
    one, earlier, weights = np.ones((n, 1)), np.zeros((n, 0)), []
    for target in targets:
        weights.append(_fit_linear(np.concatenate([x[:, everything], earlier, one], axis=1), target, sample))
        out = np.full(n, target.mean() if n else 0.0)
        for f in range(folds):
            there, others = fold == f, views[f]
            if there.any() and len(others):
                seen = np.concatenate([x[:, by_fold[f]], earlier, one], axis=1)
                out[there] = _sigmoid(seen[there] @ _fit_linear(seen[others], target[others], sample[others]))
        earlier = np.concatenate([earlier, out[:, None]], axis=1)
    names = {i: f for f, i in numbered.ids.items()}
    return ToxicityModel({names[int(i)]: k for k, i in enumerate(chosen[0])}, tuple(weights), tuple(name for name, _ in chain))


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, chain=CHAIN) -> ToxicityModel:
    """Learn the chain from rows outside the held-out fifth: about ``max_train`` of them, chosen by hash."""
    common.ship(docs.sparkSession)
    rows, (zeros, ones) = common.labelled_sample(docs, labels, chain[-1][1], (max_train * 2 // 3, max_train // 3))

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sorted(set(_WORDS.findall(t.lower()))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["doc_id", "label", "words"])

    extra = [col for _, col in chain[:-1] if col is not None]
    sampled = rows.select("doc_id", "label", "text").mapInArrow(words, "doc_id long, label int, words array<string>")
    if extra:  # further label columns of the sampled ids
        marks = labels.groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_{c}") for c in extra])
        sampled = sampled.join(marks, "doc_id")
    # About max_train rows, each with the distinct words of its text.
    got = sorted(((r.doc_id, r.label, r.words, *[r[f"_{c}"] for c in extra]) for r in sampled.toLocalIterator()), key=lambda r: r[0])
    common.free(rows)
    order = np.random.default_rng(3).permutation(len(got))
    got = [got[i] for i in order]
    y = np.array([r[1] for r in got], float)
    rate = [max(1, int((y == k).sum())) for k in (0, 1)]
    weight = np.where(y == 1, ones / rate[1], zeros / rate[0])
    columns = {chain[-1][1]: y} | {c: np.array([r[3 + i] for r in got], float) for i, c in enumerate(extra)}
    return fit_rows([r[2] for r in got], columns, weight, chain)


def probabilities(present: set[int], model: ToxicityModel) -> list[float]:
    ids, n, out = list(present), len(model.vocabulary), []
    for w in model.weights:
        z = w[ids].sum() + sum(a * b for a, b in zip(out, w[n:-1], strict=True)) + w[-1]
        out.append(1 / (1 + math.exp(-min(35.0, max(-35.0, float(z))))))
    return out


def score_texts(docs: DataFrame, model: ToxicityModel, *, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, a probability of each category, score (the last category's) and is_toxic."""
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches):
        import pyarrow as pa

        m, memo = shared.value, {}
        for batch in batches:
            out = [probabilities(_present(t or "", m.vocabulary, memo), m) for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [pa.array([p[k] for p in out], pa.float64()) for k in range(len(m.categories))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols, cols[-1], pa.array([p[-1] >= threshold for p in out], pa.bool_())], [*batch.schema.names[:-1], *(f"p_{c}" for c in m.categories), "score", "is_toxic"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, {', '.join(f'p_{c} double' for c in model.categories)}, score double, is_toxic boolean")


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns (of any names; only text is read).

    Null and empty texts are scored as texts without features, and so stay wherever most rows are clean. Every one of repeated
    rows stays or goes as the others do. A score at the threshold goes. An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        m, memo = shared.value, {}
        for batch in batches:
            keep = [probabilities(_present(t or "", m.vocabulary, memo), m)[-1] < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "text")
    return score_texts(marked, fit(docs, common.table(spark, sf_dir, "labels")), keep=("doc_id", "held_out"))
