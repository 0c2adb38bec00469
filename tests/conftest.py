import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """A graph from labels {id: [label, ...]}, relationships (src, dst, type, props) and node properties {id: {...}}."""
    from lattica.builder import GraphBuilder

    def build(rels=(), labels=None, props=None, nodes=()):
        b = GraphBuilder(spark)
        for n in nodes:
            b.add_node(node_id=n)
        for n, names in (labels or {}).items():
            b.add_node(names, node_id=n)
        for src, dst, kind, *more in rels:
            at = b.add_relationship(src, dst, kind)
            for k, v in (more[0] if more else {}).items():
                b.set_relationship_prop_by_index(at, k, v)
        for n, values in (props or {}).items():
            b.set_node_props(n, values)
        return b.finalize()

    return build


def as_dict(df, key="id", value=None):
    value = value or next(c for c in df.columns if c != key)
    return {r[key]: r[value] for r in df.collect()}
