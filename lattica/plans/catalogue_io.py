"""Queries of loaders, saved graphs and records, the builder, versions, node-set updates and Python folds, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import GraphView
from ..builder import GraphBuilder
from ..catalog import GraphCatalog
from ..errors import GraphError
from ..functions import scalar
from ..graph import BOTH, OUT, PropertyGraph
from ..operators import aggregate as agg_ops
from ..operators import analytics, corpus, expand, nodeset, scan
from ..sources import csv as csv_files
from ..sources import parquet as files
from ..sources.refs import check_ids
from ..sources.tables import GraphLoader, coerced, need
from ..storage import shared_dir
from . import testgraph
from .catalogue import _ALL4, _BIN, _CUST, _GEO_E, _HASPART, _NODES4, _ORD, _PART, _SUPP, ORACLES, QUERIES, _nid, _ranks, query


class Source:
    """Tables of a folder, their files, and copies of them in other formats in the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.loader = spark, sf_dir, GraphLoader(spark)
        self.tables = testgraph.Tables(spark, sf_dir)

    def __call__(self, name: str) -> DataFrame:
        return self.tables(name)

    def file(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def place(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"

    def csv(self, df: DataFrame, *, sep: str = ",", compression: str = "none") -> str:
        path = self.place("csv")
        df.write.csv(path, header=True, sep=sep, escape='"', compression=compression)
        return path


def io(sql: str, name: str | None = None):
    """Registers a function of a ``Source`` as a query, with its SQL."""

    def wrap(f: Callable[[Source], DataFrame]):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Source(spark, sf_dir))

        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key], ORACLES[key] = run, sql
        return f

    return wrap


# ---- Parquet files -----------------------------------------------------------------------------------------------------


@io("SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS label FROM customer")
def load_nodes_parquet(s):
    files.load_nodes_from_parquet(s.loader, s.file("customer"), node_id_column="c_custkey", label_columns=["c_mktsegment"])
    return s.loader.nodes().select("id", F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.explode("labels").alias("label"))


@io("SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS rel_type, l_quantity AS qty FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT p_partkey FROM part)")
def load_relationships_parquet(s):
    files.load_nodes_from_parquet(s.loader, s.file("part"), node_id_column="p_partkey", property_columns=[])
    files.load_relationships_from_parquet(s.loader, s.file("lineitem"), "l_partkey", "l_suppkey", rel_type_column="l_returnflag", property_columns=["l_quantity"])
    return s.loader.rels().select("src", "dst", "rel_type", F.col("l_quantity").alias("qty"))


@io("SELECT 'node' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'placed', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_orderkey IN (SELECT c_custkey FROM customer)")
def read_from_parquet(s):
    g = files.read_from_parquet(s.spark, s.file("customer"), s.file("orders"), node_id_column="c_custkey", start_ref="o_custkey", end_ref="o_orderkey", fixed_rel_type="placed")
    return g.nodes.agg(F.lit("node").alias("kind"), F.count("*").alias("n")).union(g.rels.agg(F.lit("placed"), F.count("*")))


@io("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def parquet_scan_by_uri(s):
    """A file named by an address with a scheme of its own (an s3:// one goes to s3a the same way)."""
    path = s.file("supplier") if "://" in s.dir else f"file://{s.file('supplier')}"
    files.load_nodes_from_parquet(s.loader, path, node_id_column="s_suppkey", property_columns=["s_name"])
    return s.loader.nodes().select("id", F.col("s_name").alias("name"))


@io("""WITH a(t, c) AS (VALUES ('customer', 'c_name'), ('customer', 'o_orderkey'), ('orders', 'o_orderkey'), ('orders', 'nothing'), ('part', 'p_size'))
SELECT t AS "table", c AS "column", count(column_name) > 0 AS ok FROM a LEFT JOIN information_schema.columns ON table_name = t AND column_name = c GROUP BY t, c""")
def column_validation(s):
    """Which columns a load may name."""
    rows = []
    for table, column in (("customer", "c_name"), ("customer", "o_orderkey"), ("orders", "o_orderkey"), ("orders", "nothing"), ("part", "p_size")):
        try:
            need(s(table), [column])
            rows.append((table, column, True))
        except GraphError:
            rows.append((table, column, False))
    return s.spark.createDataFrame(rows, "table string, column string, ok boolean")


@io("SELECT p_partkey::BIGINT AS id, p_size::BIGINT AS size, p_retailprice::DOUBLE AS price, p_name AS name, (p_size > 20) AS large FROM part")
def type_coercion(s):
    """Columns of narrower types as the four property types."""
    df = s("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("short").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"), (F.col("p_size") > 20).alias("large"))
    return df.select(*[coerced(df, c, c) for c in df.columns])


@io("""SELECT 'customer' AS "table", CASE WHEN min(c_custkey) - 1 < 0 THEN 'CapacityError' ELSE 'ok' END AS below, CASE WHEN max(c_custkey) + 4294967000 > 4294967295 THEN 'CapacityError' ELSE 'ok' END AS above FROM customer
UNION ALL SELECT 'nation', CASE WHEN min(n_nationkey) - 1 < 0 THEN 'CapacityError' ELSE 'ok' END, CASE WHEN max(n_nationkey) + 4294967000 > 4294967295 THEN 'CapacityError' ELSE 'ok' END FROM nation""")
def id_range_check(s):
    def outcome(df):
        try:
            check_ids(df, "id")
            return "ok"
        except GraphError as e:
            return type(e).__name__

    rows = []
    for table, key in (("customer", "c_custkey"), ("nation", "n_nationkey")):
        k = F.col(key).cast("long")
        rows.append((table, outcome(s(table).select((k - 1).alias("id"))), outcome(s(table).select((k + 4294967000).alias("id")))))
    return s.spark.createDataFrame(rows, "table string, below string, above string")


@io("SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region UNION ALL SELECT (SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY n_nationkey), n_name FROM nation")
def node_id_extraction(s):
    """Regions have ids of their own; nations, which come in the order of their keys, are numbered above them."""
    s.loader.load_nodes(s("region").select("r_regionkey", F.col("r_name").alias("name")), node_id_column="r_regionkey")
    s.loader.load_nodes(s("nation").orderBy("n_nationkey").coalesce(1).select(F.col("n_name").alias("name")))
    return s.loader.nodes().select("id", "name")


# ---- CSV files ---------------------------------------------------------------------------------------------------------


@io("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def csv_scan(s):
    return csv_files.read_csv(s.loader, s.csv(s("customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), sep="|"), "|")


@io("SELECT p_partkey::BIGINT AS key, p_retailprice::DOUBLE AS price, p_name AS name, (p_size > 20) AS large, nullif(p_size, 15)::BIGINT AS size, 'bigint,double,string,boolean,bigint' AS types FROM part")
def csv_typing(s):
    """The narrowest type of every column; empty cells are absent."""
    size = F.when(F.col("p_size") != 15, F.col("p_size"))
    path = s.csv(s("part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"), (F.col("p_size") > 20).alias("large"), size.alias("size")), compression="gzip")
    df = csv_files.typed(csv_files.read_csv(s.loader, path))
    return df.withColumn("types", F.lit(",".join(df.schema[c].dataType.simpleString() for c in ("key", "price", "name", "large", "size"))))


@io("SELECT c_custkey AS id, c_mktsegment AS label, c_name AS name, c_acctbal AS acctbal FROM customer")
def nodes_csv(s):
    path = s.csv(s("customer").select("c_custkey", "c_mktsegment", "c_name", "c_acctbal"))
    csv_files.load_nodes_from_csv(s.loader, path, node_id_column="c_custkey", label_columns=["c_mktsegment"], multi_line=False)
    return s.loader.nodes().select("id", F.explode("labels").alias("label"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))


@io("SELECT o_custkey AS src, 1000000000 + o_orderkey AS dst, o_orderpriority AS priority, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey")
def relationships_csv(s):
    """Ends as ids, with every other column a property."""
    s.loader.load_nodes(s("customer").select("c_custkey"), node_id_column="c_custkey")
    s.loader.load_nodes(s("orders").select((F.col("o_orderkey") + 1000000000).alias("id")), node_id_column="id")
    path = s.csv(s("orders").select("o_custkey", (F.col("o_orderkey") + 1000000000).alias("o"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price")))
    csv_files.load_relationships_from_csv(s.loader, path, "o_custkey", "o", fixed_rel_type="placed", multi_line=False)
    return s.loader.rels().select("src", "dst", "priority", "price")


@io("""SELECT 'isLocatedIn' AS rel_type, c_custkey AS src, 1000000 + c_nationkey::BIGINT AS dst, c_acctbal AS balance FROM customer UNION ALL SELECT 'home', 1000000 + c_nationkey::BIGINT, c_custkey, NULL FROM customer""")
def relationships_csv_multi(s):
    """Two types from one file, with references by property (as a dict) and a renamed, typed property."""
    s.loader.load_nodes(s("customer").select("c_custkey"), node_id_column="c_custkey")
    s.loader.load_nodes(s("nation").select((F.col("n_nationkey").cast("long") + 1000000).alias("id"), F.col("n_nationkey").cast("long").alias("code")), node_id_column="id", default_label="Nation")
    nation = {"column": "c_nationkey", "property": "code", "label": "Nation"}
    specs = [csv_files.RelLoadSpec("c_custkey", nation, "isLocatedIn", (csv_files.RelPropSpec("c_acctbal", "balance", "float64"),)), csv_files.RelLoadSpec(nation, "c_custkey", "home")]
    csv_files.load_relationships_from_csv_multi(s.loader, s.csv(s("customer").select("c_custkey", "c_nationkey", "c_acctbal")), specs)
    return s.loader.rels().select("rel_type", "src", "dst", "balance")


@io("SELECT c_custkey AS start, 100000000 + min(n_nationkey)::BIGINT AS \"end\" FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_custkey")
def dict_references(s):
    """A composite reference given as a dict."""
    s.loader.load_nodes(s("customer").select("c_custkey"), node_id_column="c_custkey")
    keyed = s("nation").select((F.col("n_nationkey").cast("long") + 100000000).alias("id"), F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("region"))
    s.loader.load_nodes(keyed, node_id_column="id", default_label="Nation")
    rows = s("customer").join(s("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("c_region")), "c_nationkey")
    return s.loader.load_relationships(rows, {"column": "c_custkey"}, {"columns": ["c_nationkey", "c_region"], "properties": ["code", "region"], "label": "Nation"}, fixed_rel_type="in")


# ---- builder -----------------------------------------------------------------------------------------------------------


def _built(s: Source) -> GraphBuilder:
    """Nations and regions, row by row: two small tables of a fixed size."""
    b = GraphBuilder(s.spark, 32, 32, version="geo")
    for r in s("region").orderBy("r_regionkey").collect():
        b.add_node(["Region"], node_id=r.r_regionkey, props={"name": r.r_name})
    for r in s("nation").orderBy("n_nationkey").collect():
        b.add_relationship(100 + r.n_nationkey, r.n_regionkey, "isPartOf")
        b.add_node(["Nation"], node_id=100 + r.n_nationkey)
        b.set_node_props(100 + r.n_nationkey, {"name": r.n_name, "size": 0})
    return b


@io("SELECT 100 + n_nationkey::BIGINT AS id, 'Nation' AS label, n_name AS name, 'geo' AS version FROM nation UNION ALL SELECT r_regionkey::BIGINT, 'Region', r_name, 'geo' FROM region")
def builder_nodes(s):
    g = _built(s).finalize()
    return g.nodes.select("id", F.explode("labels").alias("label"), "name", F.lit(g.version).alias("version"))


@io("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS rel_id, 100 + n_nationkey::BIGINT AS src, n_regionkey::BIGINT AS dst FROM nation")
def builder_relationships(s):
    return _built(s).finalize().rels.select("rel_id", "src", "dst")


@io("SELECT 100 + n_nationkey::BIGINT AS id, length(n_name)::BIGINT AS size FROM nation UNION ALL SELECT r_regionkey::BIGINT, NULL FROM region")
def builder_properties(s):
    """Properties set and then updated; one that was never set can't be."""
    b = _built(s)
    for r in s("nation").collect():
        b.update_prop(100 + r.n_nationkey, "size", len(r.n_name))
    return b.finalize().nodes.select("id", "size")


@io("SELECT 100 + n_nationkey::BIGINT AS src, n_regionkey::BIGINT AS dst, n_nationkey * 1.5::DOUBLE AS weight, n_name AS note FROM nation")
def builder_relationship_props(s):
    """By ends, by number and many at once."""
    b = _built(s)
    nations = s("nation").orderBy("n_nationkey").collect()
    for i, r in enumerate(nations):
        if i % 2:
            b.set_relationship_prop(100 + r.n_nationkey, r.n_regionkey, "isPartOf", "weight", r.n_nationkey * 1.5)
        else:
            b.set_relationship_prop_by_index(i, "weight", r.n_nationkey * 1.5)
    b.set_relationship_props([(100 + r.n_nationkey, r.n_regionkey, "isPartOf", {"note": r.n_name}) for r in nations])
    return b.finalize().rels.select("src", "dst", "weight", "note")


@io("SELECT count(DISTINCT n_regionkey) + 2 * count(*) AS nodes FROM nation")
def builder_dedup(s):
    """With node de-duplication by region one node a region, then without it one a row, twice."""
    b = GraphBuilder(s.spark)
    rows = s("nation").collect()
    b.enable_node_dedup("region")
    for r in rows:
        b.add_node(["R"], props={"region": r.n_regionkey})
    b.disable_node_dedup()
    for r in [*rows, *rows]:
        b.add_node(["N"], props={"region": r.n_regionkey})
    return s.spark.createDataFrame([(b.node_count(),)], "nodes long")


@io("SELECT r_regionkey::BIGINT AS id, r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations, 1::BIGINT AS named, 'Region' AS label FROM region")
def builder_reads(s):
    """What a builder answers before it is frozen."""
    b = _built(s)
    rows = [(i, b.prop(i, "name"), len(b.neighbor_ids(i, "in")), len(b.nodes_with_property("name", b.prop(i, "name"))), b.node_labels(i)[0]) for i in range(b.node_count()) if "Region" in b.node_labels(i)]
    return s.spark.createDataFrame(rows, "id long, name string, nations long, named long, label string")


@io("SELECT 100 + n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_nationkey % 4 = 0")
def builder_index(s):
    """Look-ups that finalize prepares."""
    g = _built(s).finalize(index_properties=[("Nation", "name")])
    out = None
    for r in s("nation").where("n_nationkey % 4 = 0").collect():
        one = scan.nodes_with_property(g, "Nation", "name", r.n_name).withColumn("name", F.lit(r.n_name))
        out = one if out is None else out.union(one)
    return out


@io("SELECT 'geo' AS version, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS nodes, count(*) AS relationships FROM nation UNION ALL SELECT 'later', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 1, count(*) FROM nation")
def version_manager(s):
    """Two versions side by side; a third is removed."""
    catalog = GraphCatalog(s.spark)
    b = _built(s)
    b.finalize_into(catalog)
    b.add_node(["Extra"])
    b.finalize_into(catalog, "later")
    catalog.add(b.finalize("gone"))
    catalog.remove("gone")
    return _union(scan.info(catalog.get(v)).select("version", "nodes", "relationships") for v in catalog.versions())


def _union(frames) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


# ---- saved graphs and records ------------------------------------------------------------------------------------------


def _saved(s: Source, **kwargs) -> PropertyGraph:
    path = s.place("graph")
    files.save_graph(testgraph.graph(s.spark, s.dir, ["Customer", "Order"], ["placed"]).with_version("v1"), path)
    return files.load_graph(s.spark, path, **kwargs)


@io(f"SELECT {_CUST('c_custkey')} AS id, c_name AS name, c_acctbal AS value FROM customer UNION ALL SELECT {_ORD('o_orderkey')}, NULL, o_totalprice FROM orders")
def saved_graph_nodes(s):
    return _saved(s).nodes.select("id", "name", F.coalesce("acctbal", "totalprice").alias("value"))


@io(f"SELECT o_orderkey * 16 + 2 AS rel_id, {_CUST('o_custkey')} AS src, {_ORD('o_orderkey')} AS dst, 'placed' AS rel_type, datediff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS day FROM orders")
def saved_graph_relationships(s):
    return _saved(s).rels.select("rel_id", "src", "dst", "rel_type", "day")


@io("SELECT 'nodes' AS \"table\", 'id,labels' AS columns, (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'rels', 'rel_id,src,dst,rel_type', count(*) FROM orders")
def topology_only(s):
    g = _saved(s, topology_only=True)
    return _union(df.agg(F.lit(name).alias("table"), F.lit(",".join(df.columns)).alias("columns"), F.count("*").alias("n")) for name, df in (("nodes", g.nodes), ("rels", g.rels)))


@io(f"SELECT {_CUST('o_custkey')} AS node, count(*) AS n FROM orders GROUP BY o_custkey")
def topology_only_degrees(s):
    """A read operator over a graph that was read without its properties."""
    g = _saved(s, topology_only=True)
    return expand.neighbors(g, g.nodes.select("id"), OUT, "placed").groupBy("node").agg(F.count("*").alias("n"))


@io("SELECT p_partkey::BIGINT AS id, p_name AS payload FROM part")
def saved_records(s):
    path = s.place("records")
    files.save_records(s("part").select(F.col("p_partkey").alias("id"), F.col("p_name").cast("binary").alias("payload")), path)
    return files.load_records(s.spark, path).select("id", F.col("payload").cast("string").alias("payload"))


@io("""WITH x AS (SELECT p_partkey::BIGINT AS id, (sum(strlen(p_name)) OVER (ORDER BY p_partkey))::BIGINT AS "end", strlen(p_name)::BIGINT AS n FROM part)
SELECT id, "end" - n AS start, "end" FROM x WHERE id % 11 = 3""")
def saved_record_range(s):
    """Where records of a saved file lie among its bytes."""
    path = s.place("records")
    files.save_records(s("part").select(F.col("p_partkey").alias("id"), F.col("p_name").cast("binary").alias("payload")), path)
    return corpus.record_ranges(files.load_records(s.spark, path)).where("id % 11 = 3")


# ---- counts, columns, objects ------------------------------------------------------------------------------------------


@query("Customer Supplier", "isLocatedIn", sql="SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS relationships, 'v3' AS version")
def graph_info(g):
    g = g.with_version("v3")
    counted = scan.info(g).first()
    return g.spark.createDataFrame([(scan.node_count(g), counted.relationships, counted.version)], "nodes long, relationships long, version string")


@query("Part", sql=f"SELECT {_PART('p_partkey')} AS id, p_retailprice AS retailprice, 'double' AS dtype FROM part")
def bulk_column(g):
    return scan.column(g, "retailprice").withColumn("dtype", F.lit(scan.dtype(g, "retailprice")))


@query(types="hasPart", sql="SELECT count(*) AS n, sum(l_quantity) AS total FROM lineitem")
def bulk_relationship_column(g):
    return scan.column(g, "qty", rels=True).agg(F.count("*").alias("n"), F.sum("qty").alias("total"))


@query("Nation Region", "isPartOf", sql=f"SELECT n_nationkey::BIGINT * 16 AS rel_id, 'isPartOf' AS rel_type, {_nid('n_nationkey', 'Nation')} AS start_node, r_name AS end_name, (SELECT count(*) FROM nation m WHERE m.n_regionkey = nation.n_regionkey) AS end_degree FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 3")
def relationship_objects(g):
    """Relationship and node objects, one by one (three nations: objects are for interactive use)."""
    v = GraphView(g.persist())
    rows = [(r.id, r.rel_type, r.start_node().id, r.end_node().get_property("name"), r.end_node().degree("in")) for r in (v.relationship(k * 16) for k in range(3))]
    g.unpersist()
    return g.spark.createDataFrame(rows, "rel_id long, rel_type string, start_node long, end_name string, end_degree long")


@query("Customer", sql=f"SELECT {_CUST('c_custkey')} AS id, c_mktsegment AS value FROM customer")
def string_values(g):
    """Texts come as they are: nothing is stored as a number that would have to be resolved."""
    return scan.prop(g, "mktsegment")


@query("Part", sql=f"SELECT {_PART('p_partkey')} AS id, p_size::VARCHAR AS size, TRY_CAST(split_part(p_brand, '#', 2) AS BIGINT) AS brand_number FROM part")
def value_and_text(g):
    """Values as text, and text read as numbers (null where it isn't one)."""
    brand = F.element_at(F.split(F.concat("brand", F.lit("#")), "#"), 2)
    return g.nodes.select("id", F.col("size").cast("string").alias("size"), scalar.read_or(F.nullif(brand, F.lit("")), "long", None).alias("brand_number"))


# ---- node sets and folds -----------------------------------------------------------------------------------------------


@query("Customer", sql=f"SELECT {_CUST('c_custkey')} AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (1, 2, 3) UNION SELECT unnest([2, 5, 7])::BIGINT")
def nodeset_update(g):
    """Ids taken out of a set, others put in."""
    found = scan.nodes_with_property(g, "Customer", "mktsegment", "BUILDING")
    return nodeset.insert(nodeset.remove(found, [1 * 16 + 2, 2 * 16 + 2, 3 * 16 + 2]), [2, 5, 7])


@query("Customer", sql=f"SELECT sum(({_CUST('c_custkey')}) % 1000)::BIGINT AS total, max({_CUST('c_custkey')}) AS largest FROM customer")
def nodeset_par_fold(g):
    found = nodeset.par_fold(g.nodes.select("id"), lambda: (0, -1), lambda acc, x: (acc[0] + x % 1000, max(acc[1], x)), lambda a, b: (a[0] + b[0], max(a[1], b[1])))
    return g.spark.createDataFrame([found], "total long, largest long")


@query("Nation", "isLocatedIn", sql=f"SELECT sum({_CUST('c_custkey')})::BIGINT + (SELECT coalesce(sum({_SUPP('s_suppkey')}), 0) FROM supplier WHERE s_nationkey = 1)::BIGINT AS total FROM customer WHERE c_nationkey = 1")
def par_neighbor_fold(g):
    total = GraphView(g).par_neighbor_fold(17, "in", "isLocatedIn", lambda: 0, lambda acc, x: acc + x, lambda a, b: a + b)
    return g.spark.createDataFrame([(total,)], "total long")


# ---- aggregation results, workers --------------------------------------------------------------------------------------


@query("Document Message", sql=f"""WITH d AS (SELECT n_chars FROM documents WHERE n_chars < 9000), r AS (SELECT {_BIN.format('n_chars')} AS n_chars_bin, count(*) AS count FROM d WHERE n_chars <> 0 GROUP BY 1)
SELECT 'Document' AS label, n_chars_bin, count, (SELECT count(*) FROM d) AS total, 'label,n_chars_bin,count' AS fields FROM r""")
def agg_run(g):
    """A whole result: the population's size, the rows, the names of their fields."""
    found = agg_ops.aggregate(g, "Document").where("n_chars", "<", 9000).having("n_chars", "!=", 0).by_label().bin("n_chars", [2000, 5000]).run()
    return found.rows.withColumns({"total": F.lit(found.total).cast("long"), "fields": F.lit(",".join(found.fields))})


@query(_ALL4, "isLocatedIn isPartOf", sql=f"WITH {_ranks(_GEO_E, 4)} SELECT id, round(r, 9) AS rank FROM p4")
def pagerank_workers(g):
    """With a number of tasks of its own."""
    return analytics.pagerank(g, iterations=4, workers=3).select("id", F.round("rank", 9).alias("rank"))


@query("", "hasPart", sql=f"WITH h AS ({_HASPART}) SELECT x.p AS a, y.p AS b, count(*) AS n FROM (SELECT DISTINCT o, p FROM h) x JOIN (SELECT DISTINCT o, p FROM h) y ON x.o = y.o AND x.p < y.p GROUP BY ALL HAVING count(*) >= 2")
def pairs_in_blocks(g):
    """Pairs of parts in two orders or more, with every order of over two parts cut into blocks as a hub is."""
    from ..operators.fold import _paired

    distinct = g.adj(OUT, "hasPart").select("node", "nbr").distinct()
    return _paired(distinct, "node", "nbr", block=2).groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 2")


__all__ = ["BOTH", "_NODES4", "io"]
