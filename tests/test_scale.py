"""What only shows on larger tables, in hubs, in parallel relationships, and at limits."""

import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lattica.graph import BOTH, IN, OUT, PropertyGraph, ids
from lattica.operators import analytics, corpus, expand, fold, fulltext, paths, scan, traverse
from lattica.plans import testgraph
from lattica.sources import csv as C
from lattica.sources import parquet as P
from lattica.sources.tables import GraphLoader

DIR = "/root/testdata/sf0.01"


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def test_ranked_ids_of_a_wide_table(spark):
    """Every number once, in order, whatever columns are asked for."""
    n = 300_000
    docs = spark.range(n).select(
        F.col("id").alias("key"), F.col("id").alias("seq"), (F.xxhash64("id") % 5000).alias("rank"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("text"), F.array(F.col("id") - 1).alias("links")
    )
    numbered = corpus.ranked_ids(docs)
    seen = numbered.select("id", "rank", "seq").cache()
    row = seen.agg(F.count_distinct("id").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    assert (row.n, row.lo, row.hi) == (n, 0, n - 1)
    nxt = seen.select((F.col("id") - 1).alias("id"), F.col("rank").alias("r2"), F.col("seq").alias("s2"))
    assert seen.join(nxt, "id").where("r2 > rank OR (r2 = rank AND s2 < seq)").isEmpty()
    c = corpus.build_shared_corpus(docs.limit(20_000))
    assert c.graph.nodes.select("id").distinct().count() == c.records.select("id").distinct().count() == 20_000
    key = {r.key: r.id for r in c.docs.select("key", "id").collect()}
    assert got(c.graph.rels, "src", "dst") == sorted((key[k], key[k - 1]) for k in key if k - 1 in key)


def test_relationships_of_the_test_graph_have_ordinals_of_their_own(spark):
    kinds = list(testgraph.TYPE_CODES)
    g = testgraph.graph(spark, DIR, [], kinds)
    row = g.rels.agg(F.count("*").alias("n"), F.count_distinct("rel_id").alias("d")).first()
    assert row.n == row.d > 60_000
    some = g.rels.where("rel_type = 'hasPart'").agg(F.max("rel_id")).first()[0]
    assert scan.relationship(g, some).count() == 1
    plan = expand.neighbor_counts(g, ids(spark, [5]), OUT, "hasPart")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # the numbering isn't planned where it isn't used


def test_parallel_relationships_are_all_met(spark, make):
    g = make([(0, 1, "a"), (0, 1, "a"), (0, 1, "b"), (1, 2, "a"), (1, 1, "a")])
    assert traverse.bfs(g, ids(spark, [0]))[1].count() == 5
    nodes, rels = traverse.bidirectional_bfs(g, ids(spark, [0]), ids(spark, [2]))
    assert got(nodes) == [(0,), (1,), (2,)] and got(rels, "rel_id") == [(i,) for i in range(5)]
    assert got(traverse.bfs(g, ids(spark, [0]), include_starts=False)[0]) == [(1, 1), (2, 2)]


def test_deep_searches(spark, make):
    """Longer than the rounds after which what is known is put together."""
    n = 10
    g = make([(i, i + 1, "e", {"w": 1.0 + i % 3}) for i in range(n)] + [(0, n, "e", {"w": 500.0})])
    assert {r.id: r.depth for r in traverse.bfs_distances(g, ids(spark, [0]), rel_filter=F.col("w") < 400).collect()} == {i: i for i in range(n + 1)}
    found = paths.dijkstra(g, 0, weight=F.col("w"))
    assert found.distance(n) == sum(1.0 + i % 3 for i in range(n)) and found.path_to(n) == list(range(n + 1))
    assert found.paths(ids(spark, [n])).count() == n + 1
    assert paths.weighted_shortest_path(g, 0, n, weight=F.col("w")) == found.distance(n) and paths.weighted_shortest_path(g, n, 0) is None
    assert {r.component for r in analytics.wcc(g).collect()} == {0}


def test_unfinished_loops_raise(spark, make):
    g = make([(i, i + 1, "e") for i in range(12)])
    with pytest.raises(RuntimeError):
        analytics.wcc(g, max_rounds=1)
    with pytest.raises(RuntimeError):
        paths.relax(g.rels.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), F.lit(1.0).alias("w")), 0, max_rounds=3)
    with pytest.raises(RuntimeError):
        paths.dijkstra(g, 0).paths(ids(spark, [12]), max_steps=4)


def test_random_weights_against_a_model(spark, make):
    rng = random.Random(3)
    rels = [(rng.randrange(25), rng.randrange(25), "e", {"w": float(rng.randrange(1, 9))}) for _ in range(110)]
    g = make(rels, nodes=range(25))
    for direction in (OUT, BOTH):
        edges = [(a, b, p["w"]) for a, b, _, p in rels] + ([(b, a, p["w"]) for a, b, _, p in rels] if direction is BOTH else [])
        want = {0: 0.0}
        for _ in range(25):
            for a, b, w in edges:
                if a in want and want[a] + w < want.get(b, 1e9):
                    want[b] = want[a] + w
        found = paths.dijkstra(g, 0, direction, weight=F.col("w"))
        assert {r.id: r.dist for r in found.distances().collect()} == want
        for target in list(want)[:6]:
            assert paths.weighted_shortest_path(g, 0, target, direction, weight=F.col("w")) == want[target]
            steps = found.path_to(target)
            assert sum(min(w for a, b, w in edges if (a, b) == pair) for pair in zip(steps, steps[1:], strict=False)) == want[target]


def test_pagerank_against_a_model(make):
    rng = random.Random(6)
    rels = [(rng.randrange(18), rng.randrange(14), "e") for _ in range(40)]
    g = make(rels, nodes=range(18))
    for directed, rounds in ((True, 19), (False, 3), (True, 0)):
        edges = [(a, b) for a, b, _ in rels] + ([] if directed else [(b, a) for a, b, _ in rels])
        rank = {i: 1 / 18 for i in range(18)}
        for _ in range(rounds):
            out = {i: sum(a == i for a, _ in edges) for i in rank}
            lost = sum(r for i, r in rank.items() if not out[i])
            rank = {i: 0.15 / 18 + 0.85 * (lost / 18 + sum(rank[a] / out[a] for a, b in edges if b == i)) for i in rank}
        assert {r.id: r["rank"] for r in analytics.pagerank(g, directed=directed, iterations=rounds, workers=2).collect()} == pytest.approx(rank)
    assert analytics.pagerank(make()).isEmpty()


def test_hubs_are_paired_in_blocks(make):
    rng = random.Random(2)
    rels = [(0, 100 + rng.randrange(40), "t") for _ in range(60)] + [(i, 100 + rng.randrange(40), "t") for i in range(1, 12) for _ in range(3)]
    g = make(rels)
    want = sorted((a, b, n) for (a, b), n in _pairs(rels).items())
    assert got(fold.pair_counts(g, "t", block=7)) == got(fold.pair_counts(g, "t")) == want
    members = g.nodes.where("id >= 100").select("id")
    assert got(fold.shared_neighbors(g, "t", members, IN, block=3)) == got(fold.shared_neighbors(g, "t", members, IN))


def _pairs(rels):
    out = {}
    for s in {s for s, _, _ in rels}:
        mine = sorted(d for a, d, _ in rels if a == s)
        for i, a in enumerate(mine):
            for b in mine[i + 1 :]:
                out[a, b] = out.get((a, b), 0) + 1
    return out


def test_python_filters(spark, make):
    g = make([(0, 1, "a"), (1, 2, "a"), (0, 3, "b"), (3, 2, "a"), (2, 4, "a")])
    start = ids(spark, [0])
    assert got(traverse.bfs_distances(g, start, rel_filter=lambda a, b, t, r: t == "a")) == [(0, 0), (1, 1), (2, 2), (4, 3)]
    assert got(traverse.bfs(g, start, rel_filter=lambda a, b, t, r: r != 1)[1], "rel_id") == [(0,), (2,), (3,), (4,)]
    nodes, rels = traverse.bidirectional_bfs(g, start, ids(spark, [2]), rel_filter=lambda a, b, t, r: (a, b) != (3, 2), node_filter=lambda i: i != 4, path_only=True)
    assert got(nodes) == [(0,), (1,), (2,)] and got(rels, "rel_id") == [(0,), (1,)]

    def broken(a, b, t, r):
        raise ValueError("no such way")

    with pytest.raises(PythonException, match="no such way"):
        traverse.bfs_distances(g, start, rel_filter=broken)


def test_plan_ranges_across_chunks(spark):
    """The same islands whatever chunks the ids are cut into."""
    rng = random.Random(5)
    sizes = [rng.choice([0, 3, 10, 50]) for _ in range(60)]
    records = spark.createDataFrame([(i, bytes(n)) for i, n in enumerate(sizes)], "id long, payload binary")
    ranges = corpus.record_ranges(records, chunk=7)
    asked = sorted(rng.sample(range(60), 25))
    start = [sum(sizes[:i]) for i in range(60)]
    for gap in (0, 9, 60):
        want = []
        for i in (i for i in asked if sizes[i]):
            if want and start[i] - want[-1][1] <= gap:
                want[-1] = (want[-1][0], start[i] + sizes[i], want[-1][2] + 1)
            else:
                want.append((start[i], start[i] + sizes[i], 1))
        for chunk in (1, 4, 1000):
            assert got(corpus.plan_ranges(ranges, ids(spark, asked), gap, chunk=chunk)) == want


def test_ranking_by_scan_equals_the_index(spark, make):
    texts = ["License; the LICENSE licensed", "re-license version2 version 2", "", "licenseé license", "Élan vital", "version", None, "the_license version, version"]
    g = make(labels={i: ["Doc"] for i in range(len(texts))}, props={i: {"text": t} for i, t in enumerate(texts) if t is not None})
    ix = fulltext.index(g, "Doc", "text")
    for query in ("license version", "version version élan", "2", "none of these", "the"):
        a, b = ({r.id: r.score for r in fulltext.search_ranked(g, "Doc", "text", query, 5, i).collect()} for i in (None, ix))
        assert a == pytest.approx(b), query
        assert got(fulltext.search(g, "Doc", "text", query)) == got(fulltext.search(g, "Doc", "text", query, ix)), query


def test_automatic_ids_are_the_same_for_every_use(spark):
    """A source whose rows come in other partitions each time can't give a node two ids."""
    df = spark.range(5000).select(F.concat(F.lit("n"), F.col("id")).alias("name")).repartition(4, F.rand())
    loader = GraphLoader(spark)
    loader.load_nodes(df)
    pairs = spark.range(4999).select(F.concat(F.lit("n"), F.col("id")).alias("a"), F.concat(F.lit("n"), F.col("id") + 1).alias("b"))
    made = loader.load_relationships(pairs, {"column": "a", "property": "name"}, {"column": "b", "property": "name"}, fixed_rel_type="next")
    name = {r.id: r["name"] for r in loader.nodes().collect()}
    assert len(name) == len(set(name.values())) == 5000 and sorted(name) == list(range(5000))
    assert all(int(name[r.start][1:]) + 1 == int(name[r.end][1:]) for r in made.collect())
    g = loader.graph()
    assert g.rels.select("rel_id").distinct().count() == 4999 and loader.skipped_rows() == [0]


def test_prepared_look_ups(make):
    g = make(labels={0: ["A"], 1: ["A"], 2: ["B"]}, props={0: {"x": 1, "y": "s"}, 1: {"x": 2}, 2: {"x": 1}})
    fast = g.with_indexes([("A", "x"), ("A", "none")])
    assert list(fast.indexes) == [("A", "x")]
    for value in (1, 2, 3, 1.0, "1"):
        assert got(scan.nodes_with_property(fast, "A", "x", value)) == got(scan.nodes_with_property(g, "A", "x", value))


def test_records_round_trip(spark, tmp_path):
    rows = [(i, None if i % 9 == 4 else bytes([i % 256]) * (i % 40)) for i in range(500)]
    random.Random(1).shuffle(rows)
    P.save_records(spark.createDataFrame(rows, "id long, payload binary"), str(tmp_path / "r"))
    back = P.load_records(spark, str(tmp_path / "r"))
    assert sorted((r.id, None if r.payload is None else bytes(r.payload)) for r in back.collect()) == sorted(rows)


def test_s3_settings_and_addresses(spark):
    assert P.s3a("s3://bucket/a b.parquet") == "s3a://bucket/a b.parquet" and P.s3a("/local") == "/local" and P.s3a("hdfs://x/y") == "hdfs://x/y"
    given = P.configure_s3(spark, endpoint="http://localhost:9000", path_style=True, bucket="lake")
    assert given == {"fs.s3a.bucket.lake.endpoint": "http://localhost:9000", "fs.s3a.bucket.lake.path.style.access": "true"}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert conf.get("fs.s3a.bucket.lake.endpoint") == "http://localhost:9000"


def test_large_csv_files_are_read_in_several_tasks(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id,name\n" + "".join(f"{i},name {i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        loader = GraphLoader(spark)
        assert C.read_csv(loader, str(tmp_path / "n.csv"), multi_line=False).rdd.getNumPartitions() > C.read_csv(loader, str(tmp_path / "n.csv")).rdd.getNumPartitions() == 1
        C.load_nodes_from_csv(loader, str(tmp_path / "n.csv"), node_id_column="id", multi_line=False)
        assert loader.nodes().count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_graph_is_checked_and_described(spark, make):
    g = make([(0, 1, "e")], nodes=[5]).with_version("v2")
    assert tuple(scan.info(g).first()) == (3, 1, "v2") and isinstance(g, PropertyGraph)
