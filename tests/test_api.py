"""Node and relationship objects, and what unknown names do."""

import json

import pytest

from lattica.api import GraphView, Node
from lattica.errors import NotFoundError


def test_objects_and_names(make):
    v = GraphView(make([(0, 1, "KNOWS", {"since": 2}), (0, 1, "KNOWS"), (2, 0, "LIKES")], {0: ["P"], 1: ["P"], 2: ["Q"]}, {0: {"name": "Ann", "age": 3}}))
    n = v.node(0)
    assert n.labels() == ["P"] and n.get_property("name") == "Ann" and n.get_property("none") is None and n.degree() == 3
    assert n.neighbor_ids() == [1, 1] and v.neighbor_ids(0, "both") == [1, 2] and v.first_neighbor(0, "in") == 2
    assert json.loads(n.to_json()) == {"id": 0, "labels": ["P"], "properties": {"age": 3, "name": "Ann"}}
    first, second = n.relationships("out", "KNOWS")
    assert first.get_property("since") == 2 and second.get_property("since") is None and first.end_node() == Node(v, 1)
    assert first.to_dict() == {"id": 0, "start_node": 0, "end_node": 1, "rel_type": "KNOWS", "properties": {"since": 2}} and v.relationship(0) == first
    assert {n, Node(v, 0)} == {n} and hash(n) == hash(Node(v, 0))
    assert [x.id for x in v.nodes_with_label("P")] == [0, 1] and v.node_with_property("name", "Ann").id == 0 and v.node_with_property("name", "Bob") is None
    assert v.can_reach(2, 1) and v.shortest_path(1, 2) == 2 and v.has_rel(2) and not v.has_rel(1)
    assert v.par_neighbor_fold(0, "both", None, lambda: 0, lambda acc, x: acc + x, lambda a, b: a + b) == 4
    for call in (lambda: v.nodes_with_label("X"), lambda: v.nodes_with_property("P", "x", 1), lambda: v.relationships_with_type("X"), lambda: v.relationship(99)):
        with pytest.raises(NotFoundError):
            call()
    assert v.full_text_search("X", "name", "ann") == [] and v.geo_within_radius("P", "lat", "lon", 0, 0, 5) == []


def test_hash_matches_the_column(spark, make):
    from lattica.operators import scan

    g = make(nodes=[0, 1, 77, 2**32 - 1])
    for r in scan.node_hash(g).collect():
        assert r.hash % 2**64 == hash_of(r.id)


def hash_of(x):
    from lattica.api import _splitmix64

    return _splitmix64(x)
