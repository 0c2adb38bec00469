"""Operators on small graphs with exact answers."""

import random

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from lattica.errors import CapacityError, NotFoundError, RelationshipNotFound, SchemaError
from lattica.graph import BOTH, IN, OUT, PropertyGraph, bag, ids
from lattica.operators import aggregate as A
from lattica.operators import analytics, corpus, expand, fold, fulltext, geo, nodeset, paths, scan, traverse


def typed(kind, *pairs):
    return [(a, b, kind) for a, b in pairs]


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def test_basics(spark, make):
    g = make([(0, 1, "KNOWS"), (1, 2, "WORKS_FOR")], {0: ["Person"], 1: ["Person"], 2: ["Company"]}, {0: {"name": "Alice", "age": 30}})
    assert got(scan.nodes_with_label(g, "Person")) == [(0,), (1,)]
    assert scan.node_count(g) == 3 and scan.relationship_count(g) == 2
    assert got(expand.neighbors(g, ids(spark, [1]), BOTH)) == [(1, 0), (1, 2)]
    assert got(expand.neighbors(g, ids(spark, [0]), OUT, "none")) == []
    assert got(scan.nodes_with_property(g, "Person", "age", 30)) == [(0,)]
    assert got(scan.nodes_with_property(g, "Person", "age", 30.0)) == []  # types are told apart
    assert as_dict(scan.prop(g, "age", default=0)) == {0: 30, 1: 0, 2: 0}
    assert scan.prop(g, "none").where("value IS NOT NULL").isEmpty()
    with pytest.raises(NotFoundError):
        g.require_label("None")


def test_self_loop_counts_twice_for_both(spark, make):
    g = make([(0, 0, "e"), (0, 1, "e"), (0, 1, "e")])
    assert got(expand.degree(g, ids(spark, [0, 1]), BOTH)) == [(0, 4), (1, 2)]
    assert got(expand.neighbors(g, bag(spark, [1, 1]), IN)) == [(1, 0)] * 4


def test_first_neighbor_and_follow(spark, make):
    g = make([(5, 9, "a"), (5, 2, "a"), (9, 7, "b"), (3, 5, "a")])
    assert got(expand.first_neighbor(g, ids(spark, [5]), BOTH, "a")) == [(5, 9)]
    assert as_dict(expand.follow(g, ids(spark, [5, 2]), [(OUT, "a"), (OUT, "b")]), value="target") == {5: 7, 2: None}


KNOWS = typed("KNOWS", (0, 1), (1, 2), (2, 3), (0, 4), (4, 3))


def test_bfs(spark, make):
    g = make([*KNOWS, (0, 5, "WORKS_FOR")])
    start = ids(spark, [0])
    assert as_dict(traverse.bfs_distances(g, start, OUT, "KNOWS")) == {0: 0, 1: 1, 4: 1, 2: 2, 3: 2}
    assert as_dict(traverse.bfs(g, start, OUT, max_depth=1)[0]) == {0: 0, 1: 1, 4: 1, 5: 1}
    nodes, rels = traverse.bfs(g, start, OUT, "KNOWS")
    assert nodes.count() == 5 and rels.count() == 5
    assert traverse.bfs_distances(g, start, OUT, "none").count() == 1
    assert traverse.bfs_distances(g, start, OUT, "none", legacy_unknown_types=True).count() == 6
    assert got(traverse.bfs(g, start, OUT, node_filter=F.col("id") != 4)[0], "id") == [(0,), (1,), (2,), (3,), (5,)]
    assert got(traverse.bfs(g, start, OUT, node_filter=lambda i: i != 4)[0], "id") == [(0,), (1,), (2,), (3,), (5,)]
    assert got(traverse.neighborhood(g, start, OUT, "KNOWS", 2, 2), "id") == [(2,), (3,)]
    assert traverse.can_reach(g, 0, 3) and not traverse.can_reach(g, 3, 0) and traverse.can_reach(g, 3, 0, IN)
    assert not traverse.can_reach(g, 0, 3, max_depth=1) and traverse.can_reach(g, 2, 2)


def test_bidirectional(spark, make):
    g = make(KNOWS)
    nodes, rels = traverse.bidirectional_bfs(g, ids(spark, [0]), ids(spark, [3]), path_only=True)
    assert got(nodes) == [(i,) for i in range(5)] and rels.count() == 5
    same, none = traverse.bidirectional_bfs(g, ids(spark, [0, 1]), ids(spark, [1]))
    assert got(same) == [(1,)] and none.isEmpty()


def test_roots(make):
    g = make(typed("replyOf", (1, 0), (2, 1), (3, 1), (4, 2)), nodes=[5])
    assert as_dict(traverse.roots_via(g, "replyOf")) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5}
    loop = make(typed("r", (1, 2), (2, 3), (3, 1), (7, 3)))
    assert as_dict(traverse.roots_via(loop, "r")) == {1: 1, 2: 1, 3: 1, 7: 1}
    assert as_dict(traverse.neighbor_via(g, "replyOf"))[4] == 2 and as_dict(traverse.neighbor_via(g, "replyOf"))[5] is None


def test_weighted_paths(spark, make):
    g = make([(0, 1, "e", {"w": 2.0}), (1, 2, "e", {"w": 3.0}), (0, 2, "e", {"w": 10.0})], nodes=[3])
    assert as_dict(paths.sssp(g, 0, weight_key="w")) == {0: 0, 1: 2, 2: 5, 3: float("inf")}
    assert as_dict(paths.sssp(g, 0))[2] == 1
    found = paths.dijkstra(g, 0, weight=F.col("w"))
    assert found.path_to(2) == [0, 1, 2] and found.path_to(3) == [] and found.distance(3) is None
    assert got(found.paths(ids(spark, [2])), "step", "id") == [(0, 2), (1, 1), (2, 0)]
    assert paths.shortest_path(g, 0, 2, OUT, weight_property="w") == 5 and paths.shortest_path(g, 0, 3) is None
    assert paths.weighted_shortest_path(g, 1, 1) == 0


def test_pair_weights(make):
    creator = {3: 0, 4: 1, 5: 0, 6: 2}
    reply = typed("replyOf", (4, 3), (5, 3), (6, 4), (6, 3), (5, 4))
    knows = typed("knows", *[p for a, b in ((0, 1), (1, 2), (0, 2), (0, 7)) for p in ((a, b), (b, a))])
    g = make([*[(c, m, "hasCreator") for m, c in creator.items()], *reply, *knows])
    pairs = fold.fold_via(g, "replyOf", traverse.neighbor_via(g, "hasCreator", IN))
    assert got(pairs) == [(0, 1, 2), (0, 2, 1), (1, 2, 1)]
    assert as_dict(paths.dijkstra_pair_weights(g, 0, pairs, OUT, "knows").distances()) == {0: 0, 1: 0.5, 2: 1}
    open_ = as_dict(paths.dijkstra_pair_weights(g, 0, pairs, OUT, "knows", base=1, prune_missing=False).distances())
    assert open_ == pytest.approx({0: 0, 1: 1 / 3, 2: 0.5, 7: 1})


def test_co_occurrence_and_groups(spark, make):
    g = make(typed("about", (3, 0), (3, 1), (4, 0), (4, 1), (5, 0), (5, 2)), props={3: {"day": 10}, 4: {"day": 10}, 5: {"day": 20}})
    assert as_dict(fold.co_occurring(g, 0, "about", IN)) == {1: 2, 2: 1}
    assert as_dict(fold.co_occurring(g, 0, "about", IN, distinct_key="day")) == {1: 1, 2: 1}
    rels = [*typed("isPartOf", (2, 0), (3, 1)), *typed("isLocatedIn", (4, 2), (5, 2), (6, 3)), *typed("hasMember", (7, 4), (7, 5), (7, 6), (8, 6), (9, 4))]
    g = make(rels, props={7: {"fid": 100}, 8: {"fid": 20}, 9: {"fid": 10}})
    groups = fold.neighbor_groups(g, ids(spark, [7, 8, 9]), "hasMember").project("isLocatedIn", "isPartOf")
    assert as_dict(groups.sizes()) == {7: 2, 8: 1, 9: 1}
    assert [tuple(r) for r in groups.top_by_size(3, tie="fid").collect()] == [(7, 2), (9, 1), (8, 1)]
    assert as_dict(fold.neighbor_groups(g, ids(spark, [7]), "none").sizes()) == {7: 0}


def test_pair_counts_with_parallel_relationships(make):
    g = make(typed("hasTag", (0, 10), (0, 10), (0, 11), (1, 10), (1, 11)))
    assert got(fold.pair_counts(g, "hasTag")) == [(10, 10, 1), (10, 11, 3)]


def test_aggregate(make):
    rows = [(5, 1, 10), (5, 1, 50), (5, 0, 20), (9, 1, 100)]
    g = make(labels={0: ["Post"], 1: ["Post"], 2: ["Comment"], 3: ["Comment"]}, props={i: dict(zip(("day", "content", "len"), r, strict=True)) for i, r in enumerate(rows)})
    res = A.aggregate(g, "Post", "Comment").where("day", "<", 8).having("content", "!=", 0).by_label().bin("len", [40, 80, 160]).sum("len").run()
    assert res.total == 3 and got(res.rows) == [("Post", 0, 1, 10), ("Post", 1, 1, 50)] and res.fields == ("label", "len_bin", "count", "sum")
    with pytest.raises(SchemaError):
        A.aggregate(g, "Post").by("none").plan()
    with pytest.raises(NotFoundError):
        A.aggregate(g, "None").plan()


def test_aggregate_through(spark, make):
    g = make(typed("hasTag", (0, 2), (0, 3), (1, 2)), {0: ["Post"], 1: ["Post"], 2: ["Tag"], 3: ["Tag"]})
    res = A.aggregate(g, "Post").through("hasTag").run()
    assert res.total == 2 and got(res.rows) == [(2, 2), (3, 1)]
    assert got(A.aggregate(g, "Post").through("hasTag").only_neighbors(ids(spark, [3])).plan()[0]) == [(3, 1)]


def test_a_node_with_two_labels_counts_twice(make):
    assert A.aggregate(make(labels={0: ["A", "B"], 1: ["A"]}), "A", "B").run().total == 3


def test_analytics(spark, make):
    ring = make(typed("e", (0, 1), (1, 2), (2, 0)))
    assert as_dict(analytics.pagerank(ring)) == pytest.approx({0: 1 / 3, 1: 1 / 3, 2: 1 / 3})
    assert as_dict(analytics.pagerank(make(typed("e", (0, 1))), iterations=1)) == pytest.approx({0: 0.2875, 1: 0.7125})
    assert as_dict(analytics.wcc(make(typed("e", (0, 1), (1, 2), (3, 4))))) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert as_dict(analytics.cdlp(ring, iterations=2)) == {0: 0, 1: 0, 2: 0}
    seeds = spark.createDataFrame([(0, 10), (1, 20), (2, 30)], "id long, label long")
    assert as_dict(analytics.cdlp(ring, iterations=2, seeds=seeds)) == {0: 10, 1: 10, 2: 10}
    assert as_dict(analytics.lcc(make(typed("e", (0, 1), (1, 2), (2, 0), (0, 3))), directed=False)) == pytest.approx({0: 1 / 3, 1: 1, 2: 1, 3: 0})
    assert as_dict(analytics.lcc(make(typed("e", (0, 1), (0, 2), (1, 2), (1, 3), (1, 4)))))[0] == 0.5


def test_wcc_of_a_long_path(make):
    order = list(range(60))
    random.Random(1).shuffle(order)
    g = make(typed("e", *zip(order, order[1:], strict=False)))
    assert set(as_dict(analytics.wcc(g)).values()) == {0}


def test_random_graphs_against_a_model(spark, make):
    rng = random.Random(7)
    for _ in range(3):
        n = rng.randrange(5, 25)
        rels = [(rng.randrange(n), rng.randrange(n), rng.choice("ab")) for _ in range(rng.randrange(0, 50))]
        g = make(rels, nodes=range(n))
        for kind in ("a", None):
            out = sorted((s, d) for s, d, k in rels if kind in (k, None))
            assert got(expand.neighbors(g, g.nodes.select("id"), OUT, kind)) == out
            assert got(expand.neighbors(g, g.nodes.select("id"), IN, kind)) == sorted((d, s) for s, d in out)
        depth, frontier, level = {0: 0}, {0}, 0
        while frontier:
            level += 1
            frontier = {d for s, d, _ in rels if s in frontier} - depth.keys()
            depth |= dict.fromkeys(frontier, level)
        assert as_dict(traverse.bfs_distances(g, ids(spark, [0]))) == depth
        comp = {i: i for i in range(n)}
        for _ in range(n):
            for s, d, _k in rels:
                comp[s] = comp[d] = min(comp[s], comp[d])
        assert as_dict(analytics.wcc(g)) == comp


def test_node_sets(spark):
    a, b = ids(spark, [1, 2, 3, 3]), ids(spark, [3, 4])
    assert got(nodeset.intersect(a, b)) == [(3,)] and got(nodeset.union(a, b)) == [(1,), (2,), (3,), (4,)] and got(nodeset.difference(a, b)) == [(1,), (2,)]
    assert nodeset.as_range(a) == (1, 4) and nodeset.as_range(ids(spark, [1, 3])) is None
    assert nodeset.contains(a, 2) and not nodeset.contains(a, 9) and nodeset.size(nodeset.insert(a, [9])) == 4 and nodeset.size(nodeset.remove(a, [1])) == 2
    assert nodeset.par_fold(a, lambda: 0, lambda acc, x: acc + x, lambda x, y: x + y) == 6


def test_full_text(spark, make):
    texts = {0: "The quick brown fox", 1: "Lazy brown dog", 2: "Quick red fox", 3: "quick brown irrelevant"}
    g = make(labels={0: ["Doc"], 1: ["Doc"], 2: ["Doc"], 3: ["Other"]}, props={i: {"text": t} for i, t in texts.items()})
    assert fulltext.query_tokens(spark, "Hello, WORLD! it's foo_bar") == ["hello", "world", "it", "s", "foo", "bar"]
    ix = fulltext.index(g, "Doc", "text")
    for index in (None, ix):
        assert got(fulltext.search(g, "Doc", "text", "brown", index)) == [(0,), (1,)]
        assert got(fulltext.search(g, "Doc", "text", "FOX quick", index)) == [(0,), (2,)]
        assert got(fulltext.search(g, "Doc", "text", "nothing", index)) == [] and got(fulltext.search(g, "Doc", "text", " ", index)) == []
    ranked = [r.id for r in fulltext.search_ranked(g, "Doc", "text", "fox red", 5).collect()]
    assert ranked == [2, 0] and ix.doc_count() == 3


def test_full_text_union_has_no_limit(spark, make):
    from lattica.plans import catalogue

    g = make(labels={i: ["Doc"] for i in range(30)}, props={i: {"text": "fox" if i % 3 else "dog"} for i in range(30)})
    for index in (None, fulltext.index(g, "Doc", "text")):
        every, best = (fulltext.search_ranked(g, "Doc", "text", "fox", k, index) for k in (None, 1_000_000))
        assert got(every) == got(best) and every.count() == 20 and fulltext.search_ranked(g, "Doc", "text", "fox", 0, index).isEmpty()
    plan = catalogue.QUERIES["fts_union"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan


CITIES = {0: (51.5074, -0.1278), 1: (48.8566, 2.3522), 2: (40.7128, -74.0060)}


def test_geo(spark, make):
    g = make(labels={0: ["City"], 1: ["City"], 2: ["City"], 4: ["Other"]}, props={**{i: {"lat": a, "lon": o} for i, (a, o) in CITIES.items()}, 4: {"lat": 51.5, "lon": -0.1}})
    near = lambda km: [i for i, _ in got(geo.within_radius(g, "City", "lat", "lon", 51.5, -0.1, km))]
    assert near(50) == [0] and near(500) == [0, 1] and near(-1) == []
    assert [r.id for r in geo.knn(g, "City", "lat", "lon", 51.5, -0.1, 2).collect()] == [0, 1]
    assert got(geo.within_bbox(g, "City", "lat", "lon", 40, -10, 52, 10)) == [(0,), (1,)]
    assert got(geo.within_bbox(g, "City", "lat", "lon", 40, 100, 52, -70)) == [(2,)]


def test_near_pairs_meet_across_cells(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [(900, 89.9, 10.0), (901, 89.9, -170.0), (902, 0.0, 179.99), (903, 0.0, -179.99)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    from math import asin, cos, radians, sin, sqrt

    def km(p, q):
        a = sin(radians(q[1] - p[1]) / 2) ** 2 + cos(radians(p[1])) * cos(radians(q[1])) * sin(radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0088 * asin(min(1, sqrt(a)))

    for limit in (50, 900):
        want = sorted((p[0], q[0]) for p in points for q in points if km(p, q) <= limit)
        assert got(geo.near_pairs(df, df, limit), "left_id", "right_id") == want


def test_corpus(spark):
    docs = spark.createDataFrame([(10, 0, 5, "alpha beta", [11, 99]), (11, 1, 9, "beta gamma", [10]), (12, 2, 5, "al", [])], "key long, seq long, rank long, text string, links array<bigint>")
    c = corpus.build_shared_corpus(docs)
    assert as_dict(c.docs.select("key", "id"), "key") == {11: 0, 10: 1, 12: 2}
    assert got(c.graph.rels, "src", "dst") == [(0, 1), (1, 0)]
    assert [r.id for r in corpus.trigram_search(c.postings, "BETA", 10).collect()] == [0, 1] and corpus.trigram_search(c.postings, "be", 10).isEmpty()
    ranges = corpus.record_ranges(c.records)
    assert got(ranges) == [(0, 0, 10), (1, 10, 20), (2, 20, 22)]
    assert got(corpus.plan_ranges(ranges, ids(spark, [0, 2]), 5)) == [(0, 10, 1), (20, 22, 1)]
    assert got(corpus.plan_ranges(ranges, ids(spark, [0, 2]), 10)) == [(0, 22, 2)]


def test_builder_contract(spark):
    from lattica.builder import GraphBuilder
    from lattica.catalog import GraphCatalog

    b = GraphBuilder(spark, version="v1")
    a = b.add_node(["A"])
    b.add_node(["B"], node_id=a)
    b.add_relationship(a, 5, "r")
    b.add_relationship(a, 5, "r")
    b.set_relationship_prop(a, 5, "r", "x", 1)
    assert b.set_relationship_props([(a, 5, "r", {"y": 2}), (9, 9, "r", {})]) == 1
    with pytest.raises(RelationshipNotFound):
        b.set_relationship_prop(5, a, "r", "x", 1)
    with pytest.raises(NotFoundError):
        b.update_prop(a, "none", 1)
    with pytest.raises(CapacityError):
        b.add_node(node_id=-1)
    with pytest.raises(OverflowError):
        b.set_prop(a, "big", 2**70)
    b.set_prop(a, "flag", True)
    assert b.node_labels(a) == ["A", "B"] and b.neighbor_ids(5, "in") == [a, a] and b.nodes_with_property("flag", True) == [a]
    catalog = GraphCatalog(spark)
    g = b.finalize_into(catalog)
    assert got(g.rels, "rel_id", "x", "y") == [(0, 1, None), (1, None, 2)] or {tuple(r) for r in g.rels.select("rel_id", "x", "y").collect()} == {(0, 1, None), (1, None, 2)}
    assert catalog.versions() == ["v1"] and catalog.get("v1").version == "v1"
    b.set_prop(a, "flag", 3)
    b.set_prop(5, "flag", "x")
    with pytest.raises(SchemaError):
        b.finalize()


def test_schema_is_checked(spark):
    with pytest.raises(SchemaError):
        PropertyGraph(spark.range(1), spark.range(1))
