"""Full-text search over a node property: postings, boolean AND, and BM25 ranking."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalar import tokenize
from ..graph import PropertyGraph
from ..storage import stored

#: BM25 parameters (fixed values).
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class FullTextIndex:
    """postings (token, id, tf) and doc lengths (id, len). Nodes without a token are no documents."""

    postings: DataFrame
    lengths: DataFrame

    def persist(self) -> FullTextIndex:
        return FullTextIndex(self.postings.persist(), self.lengths.persist())

    def term_count(self) -> int:
        return self.postings.agg(F.countDistinct("token")).first()[0]

    def doc_count(self) -> int:
        return self.lengths.count()

    def stats(self) -> DataFrame:
        """One row: doc_count, term_count, total_len."""
        return self.lengths.agg(F.count("*").alias("doc_count"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len")).crossJoin(F.broadcast(self.postings.agg(F.countDistinct("token").alias("term_count"))))


def query_tokens(spark, text: str) -> list[str]:
    """The query's tokens, cut by the same expression as the documents."""
    return spark.range(1).select(tokenize(F.lit(text))).first()[0]


def index(g: PropertyGraph, label: str, key: str) -> FullTextIndex:
    if key not in g.property_keys():
        empty = g.spark.createDataFrame([], "token string, id long, tf long")
        return FullTextIndex(empty, g.spark.createDataFrame([], "id long, len int"))
    docs = g.with_label(label).select("id", tokenize(F.col(key)).alias("tokens")).where(F.size("tokens") > 0)
    postings = docs.select("id", F.explode("tokens").alias("token")).groupBy("token", "id").agg(F.count("*").alias("tf"))
    return FullTextIndex(postings, docs.select("id", F.size("tokens").alias("len")))


def search(g: PropertyGraph, label: str, key: str, query: str, ix: FullTextIndex | None = None) -> DataFrame:
    """(id) of nodes that hold every token of the query; nothing for an empty query.

    Without a prepared index the texts themselves are filtered, which needs no shuffle at all.
    """
    asked = sorted(set(query_tokens(g.spark, query)))
    if not asked or key not in g.property_keys():
        return g.spark.createDataFrame([], "id long")
    if ix is None:
        # The letters first: only texts that hold them all meet a regular expression.
        df = g.with_label(label).select("id", F.lower(F.col(key)).alias("_low"))
        for t in asked:
            df = df.where(F.contains("_low", F.lit(t)))
        for t in asked:
            df = df.where(F.col("_low").rlike(rf"(?<![\p{{L}}\p{{N}}]){t}(?![\p{{L}}\p{{N}}])"))
        return df.select("id")
    hits = ix.postings.where(F.col("token").isin(asked)).groupBy("id").agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == len(asked)).select("id")


def search_ranked(g: PropertyGraph, label: str, key: str, query: str, k: int | None, ix: FullTextIndex | None = None) -> DataFrame:
    """(id, score): the best ``k`` nodes that hold any token by BM25 (all of them, in no order, where ``k`` is None); a token asked
    twice counts twice, ties go by id."""
    asked = query_tokens(g.spark, query)
    if not asked or key not in g.property_keys() or (k is not None and k <= 0):
        return g.spark.createDataFrame([], "id long, score double")
    if ix is None:
        return _ranked_by_scan(g, label, key, asked, k)
    n, total = ix.lengths.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    if not n:
        return g.spark.createDataFrame([], "id long, score double")
    hits = ix.postings.where(F.col("token").isin(sorted(set(asked))))
    dfs = {r.token: r.df for r in hits.groupBy("token").agg(F.count("*").alias("df")).collect()}  # a row for each query token
    weight = {t: asked.count(t) * math.log(1 + (n - df + 0.5) / (df + 0.5)) for t, df in dfs.items()}
    if not weight:
        return g.spark.createDataFrame([], "id long, score double")
    idf = F.create_map(*[F.lit(x) for t in sorted(weight) for x in (t, weight[t])])[F.col("token")]
    tf = F.col("tf").cast("double")
    norm = tf + K1 * (1 - B + B * F.col("len") / F.lit(total / n))
    scored = hits.join(ix.lengths, "id").select("id", (idf * tf * (K1 + 1) / norm).alias("s"))
    return _best(scored.groupBy("id").agg(F.sum("s").alias("score")), k)


def _best(scored: DataFrame, k: int | None) -> DataFrame:
    return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)


def _ranked_by_scan(g: PropertyGraph, label: str, key: str, asked: list[str], k: int | None) -> DataFrame:
    """The same ranking without an index, in one pass over the texts: lengths and frequencies are counted by regular expressions, only
    for texts that hold a token's letters at all; rows that match are written, the sums over all documents are observed on the way."""
    terms = sorted(set(asked))
    low = g.with_label(label).select("id", F.lower(F.coalesce(F.col(key), F.lit(""))).alias("_low"))
    low = low.withColumn("len", F.regexp_count("_low", F.lit(r"[\p{L}\p{N}]++")))
    whole = lambda t: F.lit(rf"(?<![\p{{L}}\p{{N}}]){t}(?![\p{{L}}\p{{N}}])")  # noqa: E731  a token is letters and digits only
    tf = [F.when(F.contains("_low", F.lit(t)), F.regexp_count("_low", whole(t))).otherwise(0).alias(f"tf{i}") for i, t in enumerate(terms)]
    sums = Observation()
    counted = low.where("len > 0").observe(sums, F.count(F.lit(1)).alias("n"), F.sum(F.col("len").cast("long")).alias("total"))
    hits, _ = stored(counted.where(F.greatest(*[F.contains("_low", F.lit(t)) for t in terms], F.lit(False))).select("id", "len", *tf), "hits")
    n, total = sums.get["n"], sums.get["total"]
    if not n:
        return g.spark.createDataFrame([], "id long, score double")
    found = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    row = hits.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)) for c in found]).first()
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        f, df = F.col(f"tf{i}").cast("double"), row[i]
        norm = f + K1 * (1 - B + B * F.col("len") / F.lit(total / n))
        score = score + F.lit(asked.count(t) * math.log(1 + (n - df + 0.5) / (df + 0.5))) * f * (K1 + 1) / norm
    return _best(hits.where(F.greatest(*found, F.lit(False))).select("id", score.alias("score")), k)
