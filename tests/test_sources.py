"""Loaders: references, duplicates, types, and saved graphs."""

import gzip

import pytest

from lattica.errors import BulkLoadError, CapacityError, SchemaError
from lattica.sources import csv as C
from lattica.sources import parquet as P
from lattica.sources.refs import CompositeRef, IdRef, PropertyRef
from lattica.sources.tables import GraphLoader


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def test_node_dedup_across_files(spark, tmp_path):
    one = spark.createDataFrame([(1, "P", "alice", 30), (2, "P", "bob", None), (3, "P", "charlie", 5)], "id int, label string, email string, age long")
    two = spark.createDataFrame([(10, "Q", "alice", 31), (11, "P", "dave", 1), (12, "P", None, 7)], one.schema)
    for name, df in (("a", one), ("b", two)):
        df.write.parquet(str(tmp_path / name))
    loader = GraphLoader(spark)
    for name in ("a", "b"):
        P.load_nodes_from_parquet(loader, str(tmp_path / name), node_id_column="id", label_columns=["label"], unique_properties=["email"])
    assert rows(loader.nodes(), "id", "age") == sorted([(1, 31), (2, None), (3, 5), (11, 1), (12, 7)], key=repr)
    assert [sorted(r.labels) for r in loader.nodes().where("id = 1").collect()] == [["P", "Q"]]


def test_relationships_and_missing_ends(spark):
    loader = GraphLoader(spark)
    loader.load_nodes(spark.createDataFrame([(1,), (2,)], "id long"), node_id_column="id", default_label="N")
    df = spark.createDataFrame([(1, 2, "k", 1.0), (1, 2, "k", 2.0), (1, 9, "k", 3.0), (1, 2, None, 4.0), (2, 1, "k", None)], "from long, to long, type string, w double")
    assert loader.load_relationships(df, "from", "to", rel_type_column="type").count() == 3
    assert loader.skipped_rows() == [2]
    assert loader.load_relationships(df, "from", "to", rel_type_column="type", deduplication="unique_by_type").count() == 2
    keyed = loader.load_relationships(df, "from", "to", rel_type_column="type", deduplication="unique_by_type_and_keys", key_property_columns=["w"])
    assert keyed.count() == 3
    assert loader.graph().rels.count() == 8


def test_references(spark):
    loader = GraphLoader(spark)
    loader.load_nodes(spark.createDataFrame([(1, 100, "Comment"), (2, 100, "Person"), (3, 7, "Person")], "id long, ext long, label string"), node_id_column="id", label_columns=["label"])
    df = spark.createDataFrame([(100, 100), (100, 55)], "c long, p long")
    made = loader.load_relationships(df, PropertyRef("c", "ext", "Comment"), {"column": "p", "property": "ext", "label": "Person"}, fixed_rel_type="hasCreator")
    assert rows(made) == [(1, 2)]
    loader.load_nodes(spark.createDataFrame([(8, "a", "x"), (9, "a", "y")], "id long, first string, last string"), node_id_column="id")
    made = loader.load_relationships(spark.createDataFrame([("a", "y", 1)], "f string, l string, to long"), CompositeRef(("f", "l"), ("first", "last")), IdRef("to"), fixed_rel_type="r")
    assert rows(made) == [(9, 1)]


def test_errors(spark):
    loader = GraphLoader(spark)
    with pytest.raises(SchemaError):
        loader.load_nodes(spark.range(1), node_id_column="none")
    with pytest.raises(CapacityError):
        loader.load_nodes(spark.createDataFrame([(-1,)], "id long"), node_id_column="id")
    with pytest.raises(BulkLoadError):
        loader.load_relationships(spark.range(1), "id", "none", fixed_rel_type="r")
    with pytest.raises(SchemaError):
        loader.load_nodes(spark.sql("SELECT 1L AS id, current_timestamp() AS t"), node_id_column="id")


def test_automatic_ids_go_on_above_given_ones(spark):
    loader = GraphLoader(spark)
    loader.load_nodes(spark.createDataFrame([(4, "a")], "id long, n string"), node_id_column="id")
    loader.load_nodes(spark.createDataFrame([("b",), ("c",)], "n string"))
    assert rows(loader.nodes(), "id", "n") == [(4, "a"), (5, "b"), (6, "c")]


HOSTILE = ['plain', 'comma, "quoted"', "line\nbreak", "tab\there", "é世😀"]


def test_csv_round_trip(spark, tmp_path):
    import csv

    path = tmp_path / "n.csv"
    with path.open("w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["id", "label", "name", "count", "score", "active"])
        for i, name in enumerate(HOSTILE):
            w.writerow([i, "P", name, i * 10, "" if i == 2 else i + 0.5, "true"])
    loader = GraphLoader(spark)
    C.load_nodes_from_csv(loader, str(path), node_id_column="id", label_columns=["label"])
    nodes = loader.nodes()
    assert {r.id: r["name"] for r in nodes.collect()} == dict(enumerate(HOSTILE))
    assert dict(nodes.dtypes)["count"] == "bigint" and dict(nodes.dtypes)["score"] == "double" and dict(nodes.dtypes)["active"] == "boolean"
    assert nodes.where("id = 2").first().score is None


def test_csv_gzip_multi_and_keep_first(spark, tmp_path):
    nodes, rels = tmp_path / "n.csv.gz", tmp_path / "r.csv"
    with gzip.open(nodes, "wt") as f:
        f.write("id|label|x\n1|P|5\n2|P|6\n1|Q|7\n")
    rels.write_text("id|creator|w\n1|2|3\n2|1|\n")
    loader = GraphLoader(spark)
    C.load_nodes_from_csv(loader, str(nodes), node_id_column="id", label_columns=["label"], delimiter="|")
    assert rows(loader.nodes(), "id", "x") == [(1, 5), (2, 6)]
    specs = [C.RelLoadSpec("id", "creator", "hasCreator", (C.RelPropSpec("w", "weight", "int64"),)), C.RelLoadSpec("creator", "id", "created")]
    made = C.load_relationships_from_csv_multi(loader, str(rels), specs, "|")
    assert [rows(m) for m in made] == [[(1, 2), (2, 1)], [(1, 2), (2, 1)]]
    assert rows(loader.rels().where("rel_type = 'hasCreator'"), "src", "weight") == [(1, 3), (2, None)]
    (tmp_path / "bad.csv").write_text("from,to\nx,1\n")
    with pytest.raises(BulkLoadError):
        C.load_relationships_from_csv(loader, str(tmp_path / "bad.csv"), "from", "to", fixed_rel_type="r")


def test_saved_graph(spark, make, tmp_path):
    g = make([(0, 1, "a", {"w": 1.5}), (1, 0, "b")], {0: ["A"], 1: ["B"]}, {0: {"x": 3}}).with_version("v7")
    P.save_graph(g, str(tmp_path / "g"))
    back = P.load_graph(spark, str(tmp_path / "g"))
    assert back.version == "v7" and rows(back.rels) == rows(g.rels) and rows(back.nodes) == rows(g.nodes)
    thin = P.load_graph(spark, str(tmp_path / "g"), topology_only=True)
    assert thin.nodes.columns == ["id", "labels"] and thin.rels.columns == ["rel_id", "src", "dst", "rel_type"]


def test_streamed_relationships(spark, tmp_path):
    from lattica.streaming import ingest

    src = tmp_path / "in"
    spark.sql("SELECT 1L AS src, 2L AS dst, 'r' AS rel_type, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 1L, 2L, 'r', timestamp'2024-01-01 00:01:00' UNION ALL SELECT 2L, 3L, 's', timestamp'2024-01-01 00:02:00'").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("src long, dst long, rel_type string, ts timestamp").parquet(str(src))
    query = ingest.append_relationships(stream, str(tmp_path / "g"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "g/rels")), "src", "dst") == [(1, 2), (2, 3)]
