"""Whole-graph analytics as checkpointed loops over DataFrames. Node ids may be sparse."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import BOTH, IN, OUT, PropertyGraph
from ..storage import cut

Types = str | Iterable[str] | None


def pagerank(g: PropertyGraph, *, directed: bool = True, damping: float = 0.85, iterations: int = 30, types: Types = None, workers: int | None = None) -> DataFrame:
    """(id, rank) after a fixed number of rounds; the rank of nodes without an outgoing relationship is shared by all.

    Ranks are sums of the walks' masses: u0 is 1 everywhere, and a round sends u along the links. What a round adds evenly, the
    damping's share and what the sinks lose, is one number a round, worked out from the totals of the u afterwards; so no round
    waits for the driver. Links are dealt by source once and cached, every other u is cached where its sums are made, the others are
    written to the shared folder. ``workers``: tasks a round (None: the session's).
    """
    n_tasks = workers or int(g.spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = g.nodes.select("id").distinct()
    # Parallel relationships fold into one share.
    counted = g.adj(OUT if directed else BOTH, types).groupBy("node", "nbr").agg(F.count("*").alias("m")).repartition(n_tasks, "node")
    links = counted.select("node", "nbr", (F.col("m") / F.sum("m").over(Window.partitionBy("node"))).alias("share")).persist()
    mass, rounds = links.select("nbr", "share"), []
    for k in range(iterations):
        if k:
            mass = links.join(rounds[-1].select(F.col("id").alias("node"), "u"), "node").select("nbr", (F.col("share") * F.col("u")).alias("share"))
        u = mass.groupBy(F.col("nbr").alias("id")).agg(F.sum("share").alias("u"))
        rounds.append(cut(u) if k % 2 else u.persist())  # plans of cached tables within cached tables would double at every round
    sums = None
    for k, u in enumerate(rounds):
        one = u.agg(F.lit(k).alias("k"), F.coalesce(F.sum("u"), F.lit(0.0)).alias("t"))
        sums = one if sums is None else sums.unionAll(one)
    n = nodes.count()
    if n == 0:
        links.unpersist()
        return g.spark.createDataFrame([], "id long, rank double")
    totals = [float(n), *[r.t for r in sorted(sums.collect(), key=lambda r: r.k)]] if rounds else [float(n)]  # a row a round
    weights = [1.0 / n]  # of u0, u1, ... in the ranks
    for _ in range(iterations):
        lost = sum(w * (totals[j] - totals[j + 1]) for j, w in enumerate(weights))
        weights = [(1 - damping) / n + damping * lost / n, *[damping * w for w in weights]]
    parts = None
    for k, u in enumerate(rounds):
        one = u.select("id", (F.col("u") * weights[k + 1]).alias("r"))
        parts = one if parts is None else parts.unionAll(one)
    got = parts.groupBy("id").agg(F.sum("r").alias("r")) if parts is not None else nodes.select("id", F.lit(0.0).alias("r"))
    out = cut(nodes.join(got, "id", "left").select("id", (F.lit(weights[0]) + F.coalesce("r", F.lit(0.0))).alias("rank")))
    for df in (links, *rounds):
        df.unpersist()
    return out


def wcc(g: PropertyGraph, *, types: Types = None, max_rounds: int = 60) -> DataFrame:
    """(id, component): the least node id of each weakly connected component, for every node.

    Each round sends a node to the neighbour (or itself) of the least random rank and contracts the relationships.
    """
    left = cut(g.typed(types).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    maps = None
    for k in range(max_rounds):
        if left.isEmpty():
            break
        ranked = lambda c, k=k: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("id"))
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        step = cut(both.groupBy("node").agg(F.min(ranked("other")).alias("m")).select("node", F.least(ranked("node"), F.col("m"))["id"].alias("root")))
        maps = step if maps is None else maps.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        ends = left.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        left = cut(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    else:
        if not left.isEmpty():
            raise RuntimeError(f"components are not finished after {max_rounds} rounds")
    nodes = g.nodes.select("id").distinct()
    if maps is None:
        return nodes.select("id", F.col("id").alias("component"))
    rooted = cut(nodes.join(maps, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root")))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    return rooted.join(least, "root").select("id", "component")


def cdlp(g: PropertyGraph, *, directed: bool = True, iterations: int = 10, seeds: DataFrame | None = None, types: Types = None) -> DataFrame:
    """(id, label): synchronous label propagation, most frequent label of the neighbours, the least of equals.

    Directed: incoming and outgoing relationships both count (a reciprocal pair twice). Undirected: every entry of both
    directions counts as well, so the two differ only in name. Isolated nodes keep their label. ``seeds``: (id, label).
    """
    del directed  # the tallies are the same multiset either way
    adj = cut(g.adj(BOTH, types).groupBy("node", "nbr").agg(F.count("*").alias("m")))
    nodes = g.nodes.select("id").distinct()
    labels = cut(nodes.withColumn("label", F.col("id")) if seeds is None else nodes.join(seeds, "id", "left").select("id", F.coalesce("label", "id").alias("label")))
    for _ in range(iterations):
        counts = adj.join(labels.select(F.col("id").alias("nbr"), "label"), "nbr").groupBy("node", "label").agg(F.sum("m").alias("c"))
        best = counts.groupBy("node").agg(F.max_by("label", F.struct("c", (-F.col("label")).alias("low"))).alias("new"))
        labels = cut(labels.join(best, F.col("id") == F.col("node"), "left").select("id", F.coalesce("new", "label").alias("label")))
    return labels


def lcc(g: PropertyGraph, *, directed: bool = True, types: Types = None) -> DataFrame:
    """(id, lcc): relationships among a node's neighbours over k(k-1); 0 where k <= 1.

    Neighbours are distinct, of both directions, without the node. Triangles are found once each, from the end of the least
    degree, so that a hub's neighbours are never paired with one another.
    """
    one_way = g.typed(types).where("src <> dst").select("src", "dst").distinct()
    pairs = one_way.groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.count("*").alias("m"))
    if not directed:
        pairs = pairs.withColumn("m", F.lit(2))
    pairs = cut(pairs.select("x", "y", F.col("m").cast("long").alias("m")))
    deg = cut(pairs.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("k")))
    d = lambda c: deg.select(F.col("id").alias(c), F.col("k").alias(f"k{c}"))
    by_degree = pairs.join(d("x"), "x").join(d("y"), "y")
    first = F.struct("kx", "x") < F.struct("ky", "y")
    e = cut(by_degree.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"), "m"))
    other = e.select("a", F.col("b").alias("c"), F.col("m").alias("mc"))
    wedge = e.join(other, "a").where("b < c")
    close = pairs.select(F.col("x").alias("b"), F.col("y").alias("c"), F.col("m").alias("mbc"))
    triangles = wedge.join(close, ["b", "c"])
    credit = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("mbc").alias("n")), F.struct(F.col("b").alias("id"), F.col("mc").alias("n")), F.struct(F.col("c").alias("id"), F.col("m").alias("n"))))
    sums = triangles.select(credit.alias("t")).groupBy(F.col("t.id").alias("id")).agg(F.sum("t.n").alias("n"))
    full = g.nodes.select("id").distinct().join(deg, "id", "left").join(sums, "id", "left")
    value = F.when(F.col("k") > 1, F.coalesce("n", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return full.select("id", value.alias("lcc"))


__all__ = ["IN", "cdlp", "lcc", "pagerank", "wcc"]
