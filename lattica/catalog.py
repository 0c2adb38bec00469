"""Versions of a graph: kept by name on the driver, and optionally as Parquet under a root folder."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession

from .builder import GraphBuilder
from .errors import NotFoundError
from .graph import PropertyGraph
from .sources.parquet import load_graph, save_graph

LATEST = "latest"


class GraphCatalog:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root
        self._graphs: dict[str, PropertyGraph] = {}
        self._lock = threading.Lock()

    def create_builder(self, version: str | None = None) -> GraphBuilder:
        return GraphBuilder(self.spark, version=version)

    def add(self, g: PropertyGraph, version: str | None = None) -> str:
        """Under its version, or "latest" without one; a version that is there is replaced."""
        name = version or g.version or LATEST
        with self._lock:
            self._graphs[name] = g.with_version(name if version else g.version)
        if self.root:
            save_graph(g, f"{self.root}/{name}")
        return name

    def get(self, version: str = LATEST) -> PropertyGraph:
        with self._lock:
            found = self._graphs.get(version)
        if found is not None:
            return found
        if self.root:
            return load_graph(self.spark, f"{self.root}/{version}")
        raise NotFoundError(f"no version {version!r}")

    def versions(self) -> list[str]:
        with self._lock:
            return sorted(self._graphs)

    def remove(self, version: str) -> bool:
        with self._lock:
            return self._graphs.pop(version, None) is not None

    def clear(self) -> None:
        with self._lock:
            self._graphs.clear()

    def is_empty(self) -> bool:
        return not self._graphs

    def __len__(self) -> int:
        return len(self._graphs)
