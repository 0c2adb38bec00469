"""Ranked corpora: one id space for search, links and records; record files and their byte ranges; trigram search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ngrams
from ..graph import PropertyGraph
from ..storage import stored


def ranked_ids(docs: DataFrame, *, rank: str = "rank", order: str = "seq") -> DataFrame:
    """Adds ``id``: 0 for the highest rank, ties in their given order.

    Rows are dealt by ranges of the sort key and written once, so that the count of a range and the numbers in it are of the same
    rows; a range's first number is the count of all ranges before it, and no single task numbers everything.
    """
    n = max(1, docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = (F.col(rank).desc_nulls_last(), F.col(order).asc())
    dealt, _ = stored(docs.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()), "ranked")
    within = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*by)))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return within.join(F.broadcast(starts), "_part").withColumn("id", F.col("_start") + F.col("_rn") - 1).drop("_part", "_rn", "_start")


@dataclass(frozen=True)
class SharedCorpus:
    """One id space: documents, their links as a graph, trigram postings, and records."""

    docs: DataFrame
    graph: PropertyGraph
    postings: DataFrame
    records: DataFrame


def build_shared_corpus(docs: DataFrame, *, key: str = "key", text: str = "text", links: str | None = "links", payload: str | None = None, rank: str = "rank", order: str = "seq", label: str = "Doc", rel_type: str = "links", n: int = 3) -> SharedCorpus:
    """Ids by rank; links to unknown keys are dropped; postings of distinct n-grams; a record for each id."""
    numbered, _ = stored(ranked_ids(docs, rank=rank, order=order), "corpus")
    nodes = numbered.select("id", F.array(F.lit(label)).alias("labels"), F.col(key).cast("string").alias("key"))
    if links is not None:
        known = numbered.select(F.col(key).alias("_to"), F.col("id").alias("dst"))
        pairs = numbered.select(F.col("id").alias("src"), F.posexplode(links).alias("_pos", "_to")).join(known, "_to")
        rels = pairs.select((F.col("src") * 1_000_000 + F.col("_pos")).alias("rel_id"), "src", "dst", F.lit(rel_type).alias("rel_type"))
    else:
        rels = docs.sparkSession.createDataFrame([], "rel_id long, src long, dst long, rel_type string")
    body = F.col(payload) if payload else F.col(text).cast("binary")
    return SharedCorpus(numbered, PropertyGraph(nodes, rels), ngram_postings(numbered.select("id", F.col(text).alias("text")), n=n), numbered.select("id", body.alias("payload")))


def ngram_postings(docs: DataFrame, *, n: int = 3) -> DataFrame:
    """(gram, id), distinct."""
    return docs.select("id", F.explode(ngrams(F.col("text"), n)).alias("gram")).select("gram", "id")


def trigram_search(postings: DataFrame, query: str, limit: int, *, n: int = 3) -> DataFrame:
    """(id): documents that hold every n-gram of the query, best rank (lowest id) first; a shorter query finds nothing."""
    low = query.lower()
    grams = sorted({low[i : i + n] for i in range(len(low) - n + 1)})
    if not grams:
        return postings.select("id").limit(0)
    hits = postings.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("_n"))
    return hits.where(F.col("_n") == len(grams)).orderBy("id").select("id").limit(limit)


def record_ranges(records: DataFrame, *, payload: str = "payload", chunk: int = 100_000) -> DataFrame:
    """(id, start, end): the bytes of each record when payloads are laid end to end by id.

    Running sums go by chunks of ids, then within a chunk; no task gathers the whole table.
    """
    sized = records.select("id", F.octet_length(payload).cast("long").alias("n"), F.floor(F.col("id") / chunk).alias("_chunk"))
    starts = sized.groupBy("_chunk").agg(F.sum("n").alias("_sum")).select("_chunk", F.coalesce(F.sum("_sum").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    end = F.col("_start") + F.sum("n").over(Window.partitionBy("_chunk").orderBy("id"))
    return sized.join(F.broadcast(starts), "_chunk").select("id", (end - F.col("n")).alias("start"), end.alias("end"))


def plan_ranges(ranges: DataFrame, asked: DataFrame, max_gap: int, *, chunk: int = 100_000) -> DataFrame:
    """(start, end, n): byte ranges that cover the asked records, joined where the gap is at most ``max_gap``; empty records need none.

    Records lie in the order of their ids, so gaps are looked at chunk of ids by chunk; only a row a chunk (its first start, last
    end and number of gaps) is put in order as a whole.
    """
    mine = ranges.join(asked.select("id").distinct(), "id", "left_semi").where("end > start").withColumn("_chunk", F.floor(F.col("id") / chunk))
    inside = Window.partitionBy("_chunk").orderBy("start")
    far = lambda start, end: F.coalesce((start - end > max_gap).cast("long"), F.lit(0))
    marked = mine.withColumn("_far", far(F.col("start"), F.lag("end").over(inside)))
    whole = marked.groupBy("_chunk").agg(F.min("start").alias("_first"), F.max("end").alias("_last"), F.sum("_far").alias("_gaps"))
    chunks = Window.orderBy("_chunk")
    opened = whole.withColumn("_own", far(F.col("_first"), F.lag("_last").over(chunks)))
    before = F.sum(F.col("_own") + F.col("_gaps")).over(chunks.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_gaps")
    numbered = marked.join(opened.select("_chunk", before.alias("_before")), "_chunk").withColumn("_island", F.col("_before") + F.sum("_far").over(inside))
    return numbered.groupBy("_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")
