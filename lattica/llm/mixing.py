"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule has the golden-ratio point frac(i * phi); laid on the cumulative weights it names a source. Slots are
ranked within their source, and rank r stands for block r mod m of the source's m blocks (the next pass begins after the last):
blocks are the equal-token pieces of the source's documents, shuffled by a hash and laid end to end. What a document gives to
the mix is the words of its pieces in the blocks that slots took; a source's last slot is cut so that its words meet its target.

Targets: each source's weight shares ``share`` of all words; a target stops at ``most`` times its source's words and the excess is
shared again by weight until none is above.

Sources are the distinct values (null is one, the last); their totals, one row each, are read by the driver, at most
``MAX_SOURCES``. Null or empty texts have size 0 and give nothing. Repeated rows are documents of their own; of equal rows any
may come first. An empty table gives no rows. Only doc_id, text and source are read. Sums over a source go by hash ranges of
documents and by chunks of slots, so that a source with most rows isn't gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 512
ROWS_PER_BUCKET = 2000
MAX_SOURCES = 1_000_000
#: The golden ratio's fraction over 2**32, and its period of slots in whole numbers.
_PHI32, _PERIOD = 2654435769, 2**31
#: ``[^\\x20\\x09-\\x0D]+``, the likeliest characters first and without giving back.
WORDS = r"[\x21-\x{10FFFF}\x00-\x08\x0E-\x1F]++"


def fill_targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Weighted targets under caps: the level at which weights times level, capped, add up to the share."""
    caps = [most * s for s in sizes]
    goal = min(share * sum(sizes), sum(caps))
    level, left, weight = 0.0, goal, sum(w for w, c in zip(weights, caps, strict=True) if c > 0)
    for k in sorted(range(len(sizes)), key=lambda k: caps[k] / weights[k]):
        if caps[k] <= 0:
            continue
        level = left / weight
        if caps[k] > weights[k] * level:
            break
        left -= caps[k]
        weight -= weights[k]
        level = max(level, caps[k] / weights[k])
    return [min(c, w * level) for c, w in zip(caps, weights, strict=True)]


def mix_documents(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs`` (and the columns ``carry``)."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    base = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "source", "text").alias("ord"), *carry)
    base = common.written(base, "mix-sizes")
    per_source = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    found = per_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [r["size"] for r in found]
    ws = [weights[i % len(weights)] for i in range(len(found))]
    targets = fill_targets(sizes, ws, share, most)
    rows, cumulative, slots = [], [], 0
    for k, (r, target) in enumerate(zip(found, targets, strict=True)):
        m, need = -(-r["size"] // block), int(target)
        passes, rest = divmod(need, r["size"]) if r["size"] else (0, 0)
        n = passes * m + -(-rest // block)
        slots += n
        cumulative.append(slots)
        rows.append((k, r.source, r["size"], float(target), m, n, passes, rest, max(1, -(-r.rows // ROWS_PER_BUCKET))))
    plan = spark.createDataFrame(rows, "sid int, source string, source_size long, target double, m long, slots long, passes long, rest long, buckets long")
    named = base.withColumnRenamed("source", "_source").join(F.broadcast(plan.select("sid", "source", "source_size", "target", "buckets")), F.col("_source").eqNullSafe(F.col("source")))

    # Documents of a source in the order of their hash: ranges of the hash first, then within a range.
    place = F.col("ord") / F.lit(2.0**64) + 0.5
    bucketed = named.withColumn("bucket", F.least(F.floor(place * F.col("buckets")), F.col("buckets") - 1))
    order = Window.partitionBy("sid", "bucket").orderBy("ord", "doc_id", "size")
    inside = bucketed.withColumn("rn", F.row_number().over(order)).withColumn("within", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    inside = common.written(inside.select("doc_id", "size", "source_size", "target", "sid", "bucket", "rn", "within", *carry), "mix-order")
    starts = common.sum_before(inside.groupBy("sid", "bucket").agg(F.sum("size").alias("tokens")), "bucket", "tokens", "start", by=("sid",)).select("sid", "bucket", "start")
    laid = inside.where("size > 0").join(starts, ["sid", "bucket"]).withColumn("c0", F.col("start") + F.col("within"))
    c0, c1 = F.col("c0"), F.col("c0") + F.col("size")
    whole = lambda c: F.floor(c / block).cast("long")
    pieces = laid.select("sid", "bucket", "rn", c0.alias("c0"), c1.alias("c1"), F.explode(F.sequence(whole(c0), whole(c1 - 1))).alias("block"))
    lo = F.greatest(F.col("c0") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("c1") - F.col("block") * block, F.lit(block))
    pieces = pieces.select("sid", "bucket", "rn", "block", lo.alias("lo"), hi.alias("hi"))

    taken = pieces.join(slot_blocks(spark, plan, cumulative, slots, block), ["sid", "block"])
    words = F.greatest(F.least(F.col("hi"), F.col("limit")) - F.col("lo"), F.lit(0))
    per_row = taken.groupBy("sid", "bucket", "rn").agg(F.sum(words).alias("taken"))
    return inside.join(per_row, ["sid", "bucket", "rn"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *carry)


def slot_blocks(spark: SparkSession, plan: DataFrame, cumulative: list[int], slots: int, block: int) -> DataFrame:
    """(slot, sid, block, limit): the schedule. ``plan`` has one row for each source, ``cumulative`` the slots up to each.

    A source gets its slots where points fall into its interval; the few that the points leave out follow at the end.
    """
    n = F.lit(max(1, slots))
    point = F.pmod((F.col("slot") % _PERIOD) * F.lit(_PHI32), F.lit(2**32)) / F.lit(2.0**32) * n
    held = F.lit(cumulative or [0]).cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(cumulative).bit_length()))] or [1]
    reach = lambda at, s: (at + s <= max(1, len(cumulative)) - 1) & (F.element_at(held, F.least(at + s, F.lit(max(1, len(cumulative))))) <= F.col("_point"))
    sid = F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(reach(at, s), at + s).otherwise(at))
    drawn = spark.range(slots, numPartitions=max(1, min(common.n_parts(spark), -(-slots // 100_000)))).select(F.col("id").alias("slot")).withColumn("_point", point).select("slot", sid.alias("sid"), F.lit(1).alias("one"))
    ranked = common.sum_before(drawn, "slot", "one", "rank", by=("sid",)).select("slot", "sid", "rank")
    small = F.broadcast(plan.select("sid", "m", "slots", "passes", "rest"))
    drawn_n = ranked.groupBy("sid").agg(F.count("*").alias("drawn"))
    missing = small.join(drawn_n, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < slots")
    late = missing.select(F.explode(F.sequence(F.col("drawn"), F.col("slots") - 1)).alias("rank"), "sid").select((F.lit(slots) + F.col("rank")).alias("slot"), "sid", "rank")
    every = ranked.unionByName(late).join(small, "sid").where("rank < slots")
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    number = F.col("rank") % F.col("m")
    return every.select("slot", "sid", number.alias("block"), F.when(last, F.col("rest") - number * block).otherwise(block).alias("limit"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (rounded to whole documents), with all their columns of any names.

    Null and empty texts, and texts without a word, have nothing to give and go. Rows that repeat an id (or have none) share what the
    mix takes of them all, each coming equally often. An empty table gives no rows.
    """
    of, copies, one = common.unused(docs, "_of", "_copies", "_copy")
    taken = mix_documents(docs).where("size > 0").groupBy(F.col("doc_id").alias(of)).agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias(copies))
    wordy = docs.where(F.coalesce(F.col("text").rlike(WORDS), F.lit(False)))
    joined = wordy.join(taken.where(F.col(copies) > 0), F.col("doc_id").eqNullSafe(F.col(of)))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies))).alias(one)).drop(one)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(common.table(spark, sf_dir, "documents"))
