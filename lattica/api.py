"""Node and relationship objects and name checks, for interactive use on top of the set-at-a-time operators.

Each call runs a job; loops over many nodes belong to ``lattica.operators``, which answer for all nodes at once.

Unknown names: labels, relationship types and (label, property) look-ups raise; a property read of an unknown key gives None;
searches find nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import TypeVar

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .errors import NotFoundError
from .graph import BOTH, NODE_COLUMNS, OUT, REL_COLUMNS, Direction, PropertyGraph, ids
from .operators import aggregate, analytics, expand, fulltext, geo, paths, scan, traverse

T = TypeVar("T")
_MASK = 2**64 - 1


def _splitmix64(x: int) -> int:
    """The same finaliser as ``functions.scalar.splitmix64``, for one number (fixed constants)."""
    z = (x + 0x9E3779B97F4A7C15) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return z ^ (z >> 31)


@dataclass(frozen=True, eq=False)
class Relationship:
    view: GraphView
    row: Row

    @property
    def id(self) -> int:
        return self.row.rel_id

    @property
    def rel_type(self) -> str:
        return self.row.rel_type

    def start_node(self) -> Node:
        return Node(self.view, self.row.src)

    def end_node(self) -> Node:
        return Node(self.view, self.row.dst)

    def get_property(self, key: str):
        return self.row[key] if key in self.row.__fields__ and key not in REL_COLUMNS else None

    def to_dict(self) -> dict:
        props = {k: v for k, v in self.row.asDict().items() if k not in REL_COLUMNS and v is not None}
        return {"id": self.id, "start_node": self.row.src, "end_node": self.row.dst, "rel_type": self.rel_type, "properties": props}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False)

    def __eq__(self, other) -> bool:
        return isinstance(other, Relationship) and (self.id, self.row.src, self.row.dst, self.rel_type) == (other.id, other.row.src, other.row.dst, other.rel_type)

    def __hash__(self) -> int:
        return _splitmix64(self.id)


@dataclass(frozen=True, eq=False)
class Node:
    view: GraphView
    id: int

    def _row(self) -> Row | None:
        return self.view.graph.nodes.where(F.col("id") == self.id).first()

    def _set(self) -> DataFrame:
        return ids(self.view.graph.spark, [self.id])

    def labels(self) -> list[str]:
        row = self._row()
        return list(row.labels) if row else []

    def get_property(self, key: str):
        row = self._row()
        return row[key] if row and key in self.view.graph.property_keys() else None

    def degree(self, direction: Direction | str = BOTH, types=None) -> int:
        return expand.degree(self.view.graph, self._set(), direction, types).first().degree

    def neighbor_ids(self, direction: Direction | str = OUT, types=None) -> list[int]:
        """With repeats: parallel relationships list a neighbour again."""
        return [r.nbr for r in expand.neighbors(self.view.graph, self._set(), direction, types).collect()]

    def neighbors(self, direction: Direction | str = OUT, types=None) -> list[Node]:
        return [Node(self.view, i) for i in self.neighbor_ids(direction, types)]

    def relationships(self, direction: Direction | str = OUT, types=None) -> list[Relationship]:
        direction, rels = Direction(direction), self.view.graph.typed(types)
        out = [] if direction is Direction.IN else rels.where(F.col("src") == self.id).orderBy("rel_id").collect()
        back = [] if direction is Direction.OUT else rels.where(F.col("dst") == self.id).orderBy("rel_id").collect()
        return [Relationship(self.view, r) for r in [*out, *back]]

    def to_dict(self) -> dict:
        row = self._row()
        props = {k: v for k, v in row.asDict().items() if k not in NODE_COLUMNS and v is not None} if row else {}
        return {"id": self.id, "labels": list(row.labels) if row else [], "properties": props}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False)

    def __eq__(self, other) -> bool:
        return isinstance(other, Node) and self.id == other.id

    def __hash__(self) -> int:
        return _splitmix64(self.id)


@dataclass(frozen=True)
class GraphView:
    graph: PropertyGraph

    def __len__(self) -> int:
        return scan.node_count(self.graph)

    def node(self, node_id: int) -> Node:
        return Node(self, node_id)

    def relationship(self, rel_id: int) -> Relationship:
        row = scan.relationship(self.graph, rel_id).first()
        if row is None:
            raise NotFoundError(f"no relationship {rel_id}")
        return Relationship(self, row)

    def _nodes(self, df: DataFrame) -> list[Node]:
        return [Node(self, r.id) for r in df.orderBy("id").collect()]

    def nodes_with_label(self, label: str) -> list[Node]:
        self.graph.require_label(label)
        return self._nodes(scan.nodes_with_label(self.graph, label))

    def nodes_with_property(self, label: str, key: str, value) -> list[Node]:
        self.graph.require_label(label)
        if key not in self.graph.property_keys():
            raise NotFoundError(f"no property {key!r}")
        return self._nodes(scan.nodes_with_property(self.graph, label, key, value))

    def node_with_property(self, key: str, value, label: str | None = None) -> Node | None:
        df = scan.node_with_property(self.graph, key, value) if label is None else scan.node_with_label_property(self.graph, label, key, value)
        found = df.first().id
        return None if found is None else Node(self, found)

    def relationships_with_type(self, rel_type: str) -> list[Relationship]:
        self.graph.require_type(rel_type)
        return [Relationship(self, r) for r in scan.relationships_with_type(self.graph, rel_type).orderBy("rel_id").collect()]

    def neighbor_ids(self, node_id: int, direction: Direction | str = OUT, types=None) -> list[int]:
        """Distinct, ascending."""
        return sorted(set(Node(self, node_id).neighbor_ids(direction, types)))

    def first_neighbor(self, node_id: int, direction: Direction | str = OUT, types=None) -> int | None:
        row = expand.first_neighbor(self.graph, ids(self.graph.spark, [node_id]), direction, types).first()
        return row.nbr if row else None

    def follow(self, node_id: int, steps) -> int | None:
        return expand.follow(self.graph, ids(self.graph.spark, [node_id]), steps).first().target

    def has_rel(self, node_id: int, direction: Direction | str = OUT, types=None) -> bool:
        return not expand.with_rel(self.graph, ids(self.graph.spark, [node_id]), direction, types).isEmpty()

    def bfs(self, starts: Iterable[int], direction: Direction | str = OUT, types=None, **kwargs) -> tuple[DataFrame, DataFrame]:
        return traverse.bfs(self.graph, ids(self.graph.spark, starts), direction, types, **kwargs)

    def can_reach(self, start: int, target: int, direction: Direction | str = OUT, types=None, **kwargs) -> bool:
        return traverse.can_reach(self.graph, start, target, direction, types, **kwargs)

    def shortest_path(self, source: int, target: int, direction: Direction | str = BOTH, types=None, **kwargs) -> float | None:
        return paths.shortest_path(self.graph, source, target, direction, types, **kwargs)

    def full_text_search(self, label: str, key: str, query: str) -> list[Node]:
        return self._nodes(fulltext.search(self.graph, label, key, query))

    def geo_within_radius(self, label: str, lat_key: str, lon_key: str, lat: float, lon: float, km: float) -> list[Node]:
        return self._nodes(geo.within_radius(self.graph, label, lat_key, lon_key, lat, lon, km).select("id"))

    def aggregate(self, *labels: str, **kwargs) -> aggregate.Aggregation:
        return aggregate.aggregate(self.graph, *labels, **kwargs)

    def pagerank(self, **kwargs) -> DataFrame:
        return analytics.pagerank(self.graph, **kwargs)

    def par_neighbor_fold(self, node_id: int, direction: Direction | str, types, identity: Callable[[], T], fold: Callable[[T, int], T], combine: Callable[[T, T], T]) -> T:
        """Fold a node's neighbours with Python functions, partition by partition."""
        df = expand.neighbors(self.graph, ids(self.graph.spark, [node_id]), direction, types).select("nbr")
        return df.rdd.mapPartitions(lambda part: [reduce(lambda acc, row: fold(acc, row[0]), part, identity())]).treeReduce(combine)
