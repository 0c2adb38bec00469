"""All registered queries of the graph engine and their SQL twins, over the derived graph of ``testgraph``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..graph import BOTH, IN, OUT, PropertyGraph, bag, ids
from ..operators import aggregate as agg_ops
from ..operators import analytics, corpus, expand, fold, fulltext, geo, nodeset, paths, scan, traverse
from ..sources.refs import CompositeRef, IdRef, PropertyRef, RelDedup, dedup_rels
from ..sources.tables import GraphLoader
from . import testgraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "bi3_popular"

#: Code of each label in an id, as SQL.
_C = testgraph.CODES


def query(labels: str = "", types: str = "", sql: str | None = None, name: str | None = None):
    """Registers a function of the graph (of the named labels and types) as a query, with its SQL."""

    def wrap(f: Callable[[PropertyGraph], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(testgraph.graph(spark, sf_dir, labels.split(), types.split()))

        key = name or f.__name__
        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return f

    return wrap


def _nid(key: str, label: str) -> str:
    return f"({key})::BIGINT * 16 + {_C[label]}"


_CUST, _SUPP, _PART, _ORD = (lambda k: _nid(k, "Customer")), (lambda k: _nid(k, "Supplier")), (lambda k: _nid(k, "Part")), (lambda k: _nid(k, "Order"))
_MSG = "(conv_id * 1048576 + turn)::BIGINT * 16 + 9"
_HASPART = f"SELECT {_ORD('l_orderkey')} AS o, {_PART('l_partkey')} AS p FROM lineitem"
_SUPPLIES = f"SELECT DISTINCT {_SUPP('l_suppkey')} AS s, {_PART('l_partkey')} AS p FROM lineitem"
_BUYS = f"SELECT {_CUST('o_custkey')} AS c, {_SUPP('l_suppkey')} AS s, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"
_LOCATED = f"SELECT {_CUST('c_custkey')} AS a, {_nid('c_nationkey', 'Nation')} AS n FROM customer UNION ALL SELECT {_SUPP('s_suppkey')}, {_nid('s_nationkey', 'Nation')} FROM supplier"
_EPOCH = "datediff('day', DATE '1970-01-01', {}::DATE)::BIGINT"

# ---- scans and predicates ----------------------------------------------------------------------------------------------


@query("Part", sql=f"SELECT {_PART('p_partkey')} AS id FROM part")
def label_scan(g):
    return scan.nodes_with_label(g, "Part")


@query("Region Nation Customer Supplier Part Order User Event Document Message", sql="""
SELECT * FROM (SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders
UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents
UNION ALL SELECT 'Message', count(*) FROM conversations)""")
def label_counts(g):
    return scan.label_counts(g)


@query(types="isPartOf isLocatedIn placed hasPart suppliedBy supplies triggered replyOf", sql="""
SELECT 'isPartOf' AS rel_type, count(*) AS n FROM nation UNION ALL SELECT 'isLocatedIn', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
UNION ALL SELECT 'placed', count(*) FROM orders UNION ALL SELECT 'hasPart', count(*) FROM lineitem UNION ALL SELECT 'suppliedBy', count(*) FROM lineitem
UNION ALL SELECT 'supplies', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'triggered', count(*) FROM events
UNION ALL SELECT 'replyOf', count(*) FROM conversations WHERE turn > 0""")
def rel_type_counts(g):
    return scan.type_counts(g)


@query("Nation Region", sql=f"SELECT {_nid('n_nationkey', 'Nation')} AS id, 'Nation' AS label FROM nation UNION ALL SELECT {_nid('r_regionkey', 'Region')}, 'Region' FROM region")
def node_labels(g):
    return scan.node_labels(g)


@query("Region Nation Supplier", "isPartOf", sql=f"SELECT {_nid('r_regionkey', 'Region')} AS id FROM region UNION SELECT {_nid('n_nationkey', 'Nation')} FROM nation UNION SELECT {_SUPP('s_suppkey')} FROM supplier")
def all_nodes(g):
    return scan.all_nodes(g)


@query("Region Nation", "", sql="SELECT 'Nation' AS label UNION ALL SELECT 'Region'")
def labels_distinct(g):
    return scan.labels(g)


@query("", "isPartOf placed", sql="SELECT 'isPartOf' AS rel_type UNION ALL SELECT 'placed'")
def relationship_types(g):
    return scan.relationship_types(g)


@query("Customer", sql=f"SELECT {_CUST('c_custkey')} AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def nodes_with_property(g):
    return scan.nodes_with_property(g, "Customer", "mktsegment", "BUILDING")


@query("Part", sql=f"SELECT {_PART('min(p_partkey)')} AS id FROM part WHERE p_size = 15")
def node_by_label_property_min(g):
    return scan.node_with_label_property(g, "Part", "size", 15)


@query("Customer Supplier Part", sql=f"""WITH n AS (SELECT {_CUST('c_custkey')} AS id, c_name AS name FROM customer UNION ALL SELECT {_SUPP('s_suppkey')}, s_name FROM supplier UNION ALL SELECT {_PART('p_partkey')}, p_name FROM part)
SELECT min(id) AS id FROM n WHERE name = (SELECT max(name) FROM n)""")
def node_by_property_any_label(g):
    """The least node, of any label, that has the last name of all."""
    return scan.node_with_property(g, "name", g.nodes.agg(F.max("name")).first()[0])


@query("Customer Supplier", sql=f"SELECT {_CUST('c_custkey')} AS id, true AS has_label FROM customer UNION ALL SELECT {_SUPP('s_suppkey')}, false FROM supplier")
def has_label_flag(g):
    return scan.label_flags(g, g.nodes.select("id"), "Customer")


@query("Part Supplier", sql=f"SELECT {_PART('p_partkey')} AS id, coalesce(p_size, 0)::BIGINT AS value FROM part UNION ALL SELECT {_SUPP('s_suppkey')}, 0 FROM supplier")
def prop_default(g):
    return scan.prop(g, "size", default=0)


@query(types="hasPart", sql=f"SELECT {_ORD('l_orderkey')} AS src, {_PART('l_partkey')} AS dst, l_quantity AS value FROM lineitem")
def rel_prop_scan(g):
    return scan.rel_prop(g, "qty", "hasPart").drop("rel_id")


#: Lines with their relationships' ordinals.
_LINE = f"""SELECT {_ORD('l_orderkey')} AS src, {_PART('l_partkey')} AS dst, l_quantity AS qty, (l_orderkey * 65536 + row_number() OVER (PARTITION BY l_orderkey
ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax))::BIGINT * 16 + 3 AS rel_id FROM lineitem"""


@query(types="hasPart", sql=f"SELECT src, dst, min(rel_id) AS rel_id FROM ({_LINE}) GROUP BY src, dst")
def relationship_by_nodes(g):
    return scan.relationship_by_nodes(g, g.rels)


@query(types="hasPart", sql=f"SELECT rel_id, src, dst, qty FROM ({_LINE})")
def all_relationships(g):
    return scan.all_relationships(g).select("rel_id", "src", "dst", "qty")


@query(types="hasPart", sql=f"SELECT rel_id, src, dst FROM ({_LINE}) WHERE rel_id = (SELECT max(rel_id) FROM ({_LINE}))")
def relationship_at(g):
    return scan.relationship(g, g.rels.agg(F.max("rel_id")).first()[0]).select("rel_id", "src", "dst")


@query(types="isPartOf", sql=f"""SELECT n_nationkey::BIGINT * 16 AS rel_id, '{{"rel_id":' || n_nationkey * 16 || ',"start_node":' || n_nationkey * 16 + 1 || ',"end_node":' || n_regionkey * 16 || ',"rel_type":"isPartOf","properties":{{}}}}' AS json FROM nation""")
def relationship_json(g):
    return scan.relationship_json(g)


@query("", "placed isPartOf", sql=f"SELECT {_nid('n_nationkey', 'Nation')} AS src, {_nid('n_regionkey', 'Region')} AS dst FROM nation")
def relationships_with_type(g):
    return scan.relationships_with_type(g, "isPartOf").select("src", "dst")


@query("Region", sql="""SELECT r_regionkey::BIGINT * 16 AS id, '{"id":' || r_regionkey * 16 || ',"labels":["Region"],"properties":{"name":"' || r_name || '"}}' AS json FROM region""")
def node_json(g):
    return scan.node_json(g)


@query("Nation", sql="""
WITH a AS (SELECT (n_nationkey::HUGEINT * 16 + 1) AS id FROM nation),
m AS (SELECT id, (id + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM (SELECT id::UHUGEINT AS id FROM a)),
s1 AS (SELECT id, xor(z, z >> 30) AS z FROM m),
h1 AS (SELECT id, z, 13787848793156543929::UHUGEINT AS k FROM s1),
p1 AS (SELECT id, ((z % 4294967296::UHUGEINT) * k + (((z >> 32) * k) % 4294967296::UHUGEINT) * 4294967296::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM h1),
s2 AS (SELECT id, xor(z, z >> 27) AS z FROM p1),
h2 AS (SELECT id, z, 10723151780598845931::UHUGEINT AS k FROM s2),
p2 AS (SELECT id, ((z % 4294967296::UHUGEINT) * k + (((z >> 32) * k) % 4294967296::UHUGEINT) * 4294967296::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM h2),
s3 AS (SELECT id, xor(z, z >> 31) AS z FROM p2)
SELECT id::BIGINT AS id, (CASE WHEN z >= 9223372036854775808::UHUGEINT THEN z::HUGEINT - 18446744073709551616::HUGEINT ELSE z::HUGEINT END)::BIGINT AS hash FROM s3""")
def node_hash(g):
    return scan.node_hash(g)


# ---- node sets ---------------------------------------------------------------------------------------------------------


def _sets(g):
    return scan.nodes_with_property(g, "Customer", "mktsegment", "BUILDING"), g.with_label("Customer").where("acctbal > 5000").select("id")


_A, _B = f"SELECT {_CUST('c_custkey')} AS id FROM customer WHERE c_mktsegment = 'BUILDING'", f"SELECT {_CUST('c_custkey')} AS id FROM customer WHERE c_acctbal > 5000"


@query("Customer", sql=f"({_A}) INTERSECT ({_B})")
def nodeset_intersect(g):
    return nodeset.intersect(*_sets(g))


@query("Customer", sql=f"({_A}) UNION ({_B})")
def nodeset_union(g):
    return nodeset.union(*_sets(g))


@query("Customer", sql=f"({_A}) EXCEPT ({_B})")
def nodeset_difference(g):
    return nodeset.difference(*_sets(g))


@query("Customer", sql="SELECT count(*) AS n, min(c_custkey)::BIGINT AS min_id, max(c_custkey)::BIGINT AS max_id, min(c_custkey)::BIGINT AS range_start, max(c_custkey)::BIGINT + 1 AS range_end FROM customer")
def nodeset_range(g):
    return nodeset.summary(g.nodes.select(F.floor(F.col("id") / 16).alias("id")))


# ---- expansion ---------------------------------------------------------------------------------------------------------


@query("Customer", "placed", sql=f"SELECT {_CUST('o_custkey')} AS node, {_ORD('o_orderkey')} AS nbr FROM orders")
def neighbors_out(g):
    return expand.neighbors(g, g.nodes.select("id"), OUT, "placed")


@query("Part", "hasPart", sql=f"SELECT {_PART('l_partkey')} AS node, {_ORD('l_orderkey')} AS nbr FROM lineitem")
def neighbors_in(g):
    return expand.neighbors(g, g.nodes.select("id"), IN, "hasPart")


@query("Order", "placed hasPart", sql=f"SELECT {_ORD('l_orderkey')} AS node, {_PART('l_partkey')} AS nbr FROM lineitem UNION ALL SELECT {_ORD('o_orderkey')}, {_CUST('o_custkey')} FROM orders")
def neighbors_both(g):
    return expand.neighbors(g, g.nodes.select("id"), BOTH)


@query("Order", "hasPart suppliedBy placed", sql=f"SELECT {_ORD('l_orderkey')} AS node, {_PART('l_partkey')} AS nbr FROM lineitem UNION ALL SELECT {_ORD('l_orderkey')}, {_SUPP('l_suppkey')} FROM lineitem")
def neighbors_typed(g):
    return expand.neighbors(g, g.nodes.select("id"), OUT, ["hasPart", "suppliedBy"])


@query("Order", "hasPart", sql=f"SELECT DISTINCT o AS node, p AS nbr FROM ({_HASPART})")
def neighbors_distinct(g):
    return expand.neighbor_set(g, g.nodes.select("id"), OUT, "hasPart")


@query("Nation Region", "isPartOf", sql=f"SELECT {_nid('n_nationkey', 'Nation')} AS node, {_nid('n_regionkey', 'Region')} AS nbr, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def neighbor_nodes(g):
    return expand.neighbor_nodes(g, g.with_label("Nation").select("id"), OUT, "isPartOf").select("node", "nbr", "name")


@query("Order", "hasPart", sql=f"SELECT {_ORD('l_orderkey')} AS node, {_PART('l_partkey')} AS nbr, l_quantity AS qty, l_extendedprice AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def relationships_with_props(g):
    return expand.rels_with_props(g, g.nodes.where("status = 'F'").select("id"), ["qty", "price"], OUT, "hasPart").drop("rel_id")


@query("Order", "placed hasPart", sql=f"SELECT {_ORD('l_orderkey')} AS node, {_PART('l_partkey')} AS nbr, 'hasPart' AS rel_type, 0 AS dir_ord FROM lineitem UNION ALL SELECT {_ORD('o_orderkey')}, {_CUST('o_custkey')}, 'placed', 1 FROM orders")
def relationships_both(g):
    return expand.relationships(g, g.nodes.select("id"), BOTH).drop("rel_id")


@query("Order", "hasPart", sql=f"SELECT {_ORD('o_orderkey')} AS id, count(l_orderkey) AS degree FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def degree_out(g):
    return expand.degree(g, g.nodes.select("id"), OUT, "hasPart")


@query("Part", "hasPart", sql=f"SELECT {_PART('p_partkey')} AS id, count(l_orderkey) AS degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def degree_in(g):
    return expand.degree(g, g.nodes.select("id"), IN, "hasPart")


@query("Order", "placed hasPart", sql=f"SELECT {_ORD('o_orderkey')} AS id, 1 + count(l_orderkey) AS degree FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def degree_both_zero_filled(g):
    return expand.degree(g, g.nodes.select("id"), BOTH)


@query("Order", "hasPart", sql=f"SELECT {_ORD('l_orderkey')} AS node, {_PART('min(l_partkey)')} AS nbr FROM lineitem GROUP BY l_orderkey")
def first_neighbor(g):
    return expand.first_neighbor(g, g.nodes.select("id"), OUT, "hasPart")


@query("Customer", "isLocatedIn isPartOf", sql=f"SELECT {_CUST('c_custkey')} AS id, {_nid('n_regionkey', 'Region')} AS target FROM customer JOIN nation ON c_nationkey = n_nationkey")
def follow_customer_region(g):
    return expand.follow(g, g.nodes.select("id"), [(OUT, "isLocatedIn"), (OUT, "isPartOf")])


@query("Order", "hasPart", sql=f"SELECT {_ORD('o_orderkey')} AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def has_rel_semi(g):
    return expand.with_rel(g, g.nodes.select("id"), OUT, "hasPart")


@query("Order", "hasPart", sql=f"SELECT {_ORD('o_orderkey')} AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def has_rel_anti(g):
    return expand.with_rel(g, g.nodes.select("id"), OUT, "hasPart", negate=True)


@query("Order Part", "hasPart", sql=f"SELECT {_ORD('o_orderkey')} AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size = 15)")
def has_neighbor_with_property(g):
    return expand.with_neighbor_property(g, g.with_label("Order").select("id"), OUT, "hasPart", "Part", "size", 15)


@query("Order Part", "hasPart", sql=f"SELECT {_ORD('l_orderkey')} AS node, {_PART('l_partkey')} AS nbr FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 5")
def neighbors_in_set(g):
    return expand.neighbors_in_set(g, g.with_label("Order").select("id"), OUT, "hasPart", g.nodes.where("size < 5").select("id"))


@query("Order", "hasPart", sql=f"SELECT {_PART('l_partkey')} AS nbr, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY l_partkey")
def neighbor_counts(g):
    return expand.neighbor_counts(g, g.nodes.where("status = 'O'").select("id"), OUT, "hasPart")


@query("", "isPartOf", sql="SELECT 1 * 16 + 1 AS node, (SELECT n_regionkey FROM nation WHERE n_nationkey = 1)::BIGINT * 16 AS nbr FROM range(2)".replace("1 * 16 + 1 AS", "17::BIGINT AS"))
def neighbors_of_repeated_source(g):
    return expand.neighbors(g, bag(g.spark, [17, 17]), OUT, "isPartOf")


# ---- traversal ---------------------------------------------------------------------------------------------------------

_UNDIRECTED = f"""und AS (SELECT {_nid('n_nationkey', 'Nation')} AS a, {_nid('n_regionkey', 'Region')} AS b FROM nation UNION ALL {_LOCATED}),
e AS (SELECT a, b FROM und UNION SELECT b, a FROM und)"""
_START = 0 * 16 + _C["Customer"]


def _levels(edges: str, start: str, depth: int, cols: str = "") -> str:
    """Reach by levels as unrolled common tables: l0, l1, ... and ``seen``."""
    out = [f"l0 AS (SELECT id, 0 AS depth FROM ({start}))"]
    for k in range(1, depth + 1):
        before = " UNION ".join(f"SELECT id FROM l{i}" for i in range(k))
        out.append(f"l{k} AS (SELECT DISTINCT b AS id, {k} AS depth FROM ({edges}) JOIN l{k - 1} ON a = id WHERE b NOT IN ({before}))")
    return ", ".join(out) + ", seen AS (" + " UNION ALL ".join(f"SELECT id, depth FROM l{i}" for i in range(depth + 1)) + ")"


_E_OUT = f"SELECT c AS a, s AS b FROM ({_BUYS}) UNION ALL SELECT s, p FROM ({_SUPPLIES})"
_S0 = f"SELECT {_START}::BIGINT AS id"


@query("Customer Supplier Part", "buysFrom supplies", sql=f"WITH {_levels(_E_OUT, _S0, 2)} SELECT id, depth FROM seen")
def bfs_nodes(g):
    return traverse.bfs(g, ids(g.spark, [_START]), OUT)[0]


@query("Nation Region", "isPartOf isLocatedIn", sql=f"WITH {_UNDIRECTED}, {_levels('SELECT a, b FROM e', _S0, 3)} SELECT id, depth FROM seen")
def bfs_distances(g):
    return traverse.bfs_distances(g, ids(g.spark, [_START]), BOTH, max_depth=3)


@query("Customer Supplier Part", "buysFrom supplies", sql=f"WITH {_levels(_E_OUT, _S0, 1)} SELECT a AS node, b AS nbr FROM ({_E_OUT}) WHERE a IN (SELECT id FROM seen)")
def bfs_rels(g):
    return traverse.bfs(g, ids(g.spark, [_START]), OUT, max_depth=2)[1].select("node", "nbr")


@query("Customer Supplier Part", "buysFrom supplies", sql=f"WITH ok AS (SELECT {_SUPP('s_suppkey')} AS id FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT {_PART('p_partkey')} FROM part WHERE p_size < 10 UNION ALL {_S0}), {_levels(f'SELECT a, b FROM ({_E_OUT}) WHERE b IN (SELECT id FROM ok)', _S0, 2)} SELECT id, depth FROM seen")
def bfs_node_filter(g):
    cond = F.array_contains("labels", "Customer") | (F.array_contains("labels", "Supplier") & (F.col("acctbal") > 0)) | (F.array_contains("labels", "Part") & (F.col("size") < 10))
    return traverse.bfs(g, ids(g.spark, [_START]), OUT, node_filter=cond)[0]


@query("Order Part", "hasPart", sql=f"WITH {_levels(f'SELECT o AS a, p AS b FROM (SELECT {_ORD('l_orderkey')} AS o, {_PART('l_partkey')} AS p FROM lineitem WHERE l_quantity > 40)', f'SELECT {_ORD('o_orderkey')} AS id FROM orders WHERE o_orderstatus = {chr(39)}P{chr(39)}', 1)} SELECT id, depth FROM seen")
def bfs_rel_filter(g):
    return traverse.bfs_distances(g, g.nodes.where("status = 'P'").select("id"), OUT, "hasPart", rel_filter=F.col("qty") > 40)


@query("Customer Supplier Part", "buysFrom supplies", sql=f"WITH {_levels(_E_OUT, _S0, 2)} SELECT id, depth FROM seen WHERE depth BETWEEN 1 AND 2")
def neighborhood_1_2(g):
    return traverse.neighborhood(g, ids(g.spark, [_START]), OUT, None, 1, 2)


@query("Customer Supplier Part", "buysFrom supplies", sql=f"WITH {_levels(_E_OUT, _S0, 2)} SELECT id, depth FROM seen WHERE depth = 2")
def neighborhood_exact_2(g):
    return traverse.neighborhood(g, ids(g.spark, [_START]), OUT, None, 2, 2)


_DOWN = f"(SELECT {_nid('n_regionkey', 'Region')} FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 0)"


def _walk(edges: str, start: str, target: str) -> str:
    return f"(WITH RECURSIVE e AS ({edges}), w AS (SELECT {start} AS id UNION SELECT b FROM e JOIN w ON a = id) SELECT count(*) > 0 FROM w WHERE id = {target})"


_FORWARD = f"SELECT {_nid('n_nationkey', 'Nation')} AS a, {_nid('n_regionkey', 'Region')} AS b FROM nation UNION SELECT {_CUST('c_custkey')}, {_nid('c_nationkey', 'Nation')} FROM customer UNION SELECT {_SUPP('s_suppkey')}, {_nid('s_nationkey', 'Nation')} FROM supplier"
_BOTHWAYS = f"SELECT a, b FROM ({_FORWARD}) UNION SELECT b, a FROM ({_FORWARD})"


@query("Nation Region Customer", "isPartOf isLocatedIn", sql=f"""SELECT {_walk(_FORWARD, f'{_START}::BIGINT', _DOWN)} AS down, {_walk(_FORWARD, _DOWN, f'{_START}::BIGINT')} AS wrong_way, {_walk(_BOTHWAYS, _DOWN, f'{_START}::BIGINT')} AS both_ways,
{_walk(f'SELECT a, b FROM ({_FORWARD}) WHERE false', f'{_START}::BIGINT', f'{_START}::BIGINT')} AS itself, {_walk(f'SELECT a, b FROM ({_FORWARD}) WHERE false', f'{_START}::BIGINT', _DOWN)} AS unknown_type, {_walk(_FORWARD, f'{_START}::BIGINT', _DOWN)} AS legacy_unknown""")
def can_reach(g):
    """From a customer to its region, and what must not be found."""
    region = expand.follow(g, ids(g.spark, [_START]), [(OUT, "isLocatedIn"), (OUT, "isPartOf")]).first().target
    r = lambda *a, **k: traverse.can_reach(g, *a, **k)
    row = (r(_START, region), r(region, _START), r(region, _START, BOTH), r(_START, _START, OUT, "none"), r(_START, region, OUT, "none"), r(_START, region, OUT, "none", legacy_unknown_types=True))
    return g.spark.createDataFrame([row], "down boolean, wrong_way boolean, both_ways boolean, itself boolean, unknown_type boolean, legacy_unknown boolean")


_S1 = f"SELECT {_SUPP('s_suppkey')} AS id FROM supplier WHERE s_acctbal > 5000"


@query("Customer Nation Region Supplier", "isPartOf isLocatedIn", sql=f"""
WITH {_UNDIRECTED}, x AS (WITH {_levels('SELECT a, b FROM e', _S0, 2)} SELECT id FROM seen), y AS (WITH {_levels('SELECT a, b FROM e', _S1, 2)} SELECT id FROM seen) SELECT id FROM x WHERE id IN (SELECT id FROM y)""")
def bidirectional_bfs_nodes(g):
    """Two hops from a customer and from all suppliers of some wealth."""
    rich = g.with_label("Supplier").where("acctbal > 5000").select("id")
    return traverse.bidirectional_bfs(g, ids(g.spark, [_START]), rich, BOTH, max_depth=2)[0]


def _two_sided(edges: str) -> str:
    """Reach of the start (f) and backward reach of the target (r), of any depth."""
    return f"""e AS ({edges}), f AS (SELECT {_START}::BIGINT AS id UNION SELECT b FROM e JOIN f ON a = f.id), r AS (SELECT {_nid('1', 'Region')} AS id UNION SELECT a FROM e JOIN r ON b = r.id)"""


_DOWN_E = f"SELECT c AS a, s AS b, 'buysFrom' AS t FROM ({_BUYS}) UNION ALL SELECT {_SUPP('s_suppkey')}, {_nid('s_nationkey', 'Nation')}, 'isLocatedIn' FROM supplier UNION ALL SELECT {_CUST('c_custkey')}, {_nid('c_nationkey', 'Nation')}, 'isLocatedIn' FROM customer UNION ALL SELECT {_nid('n_nationkey', 'Nation')}, {_nid('n_regionkey', 'Region')}, 'isPartOf' FROM nation"


@query("Customer Supplier Nation Region", "buysFrom isLocatedIn isPartOf", sql=f"WITH RECURSIVE {_two_sided(_DOWN_E)} SELECT a AS node, b AS nbr, t AS rel_type FROM e WHERE a IN (SELECT id FROM f) AND b IN (SELECT id FROM f) AND a IN (SELECT id FROM r) AND b IN (SELECT id FROM r)")
def bidirectional_bfs_rels(g):
    """All relationships on ways from a customer to a region."""
    return traverse.bidirectional_bfs(g, ids(g.spark, [_START]), ids(g.spark, [16]), OUT, path_only=True)[1].select("node", "nbr", "rel_type")


@query("Customer Supplier Part", "buysFrom supplies", sql=f"WITH {_levels(_E_OUT, _S0, 2)} SELECT id, depth FROM seen WHERE depth > 0")
def bfs_without_starts(g):
    return traverse.bfs(g, ids(g.spark, [_START]), OUT, include_starts=False)[0]


@query("Customer Order Part", "placed hasPart", sql=f"SELECT {_CUST('o_custkey')} AS node, {_ORD('o_orderkey')} AS nbr, o_orderkey::BIGINT * 16 + 2 AS rel_id FROM orders WHERE o_custkey = 0 UNION ALL SELECT src, dst, rel_id FROM ({_LINE}) WHERE src IN (SELECT {_ORD('o_orderkey')} FROM orders WHERE o_custkey = 0)")
def bfs_rels_parallel(g):
    """Every line of a customer's orders is met, also those of one part."""
    return traverse.bfs(g, ids(g.spark, [_START]), OUT, max_depth=2)[1].select("node", "nbr", "rel_id")


@query("Customer Supplier Part", "buysFrom supplies", sql=f"WITH {_levels(f'SELECT a, b FROM ({_E_OUT}) WHERE b % 3 <> 0', _S0, 2)} SELECT id, depth FROM seen")
def bfs_python_node_filter(g):
    return traverse.bfs_distances(g, ids(g.spark, [_START]), OUT, node_filter=lambda i: i % 3 != 0 or i == _START)


@query("Customer Supplier Part", "buysFrom supplies", sql=f"WITH {_levels(f'SELECT a, b FROM ({_E_OUT}) WHERE (a + b) % 5 <> 0', _S0, 2)} SELECT id, depth FROM seen")
def bfs_python_rel_filter(g):
    return traverse.bfs_distances(g, ids(g.spark, [_START]), OUT, rel_filter=lambda node, nbr, kind, rel_id: (node + nbr) % 5 != 0 and kind in ("buysFrom", "supplies") and rel_id >= 0)


@query("Message", "replyOf", sql=f"SELECT {_MSG} AS id, (conv_id * 1048576)::BIGINT * 16 + 9 AS target FROM conversations")
def roots_via_reply(g):
    return traverse.roots_via(g, "replyOf")


@query("Message", "replyOf", sql=f"SELECT {_MSG} AS id, CASE WHEN turn > 0 THEN {_MSG} - 16 END AS target FROM conversations")
def neighbor_via(g):
    return traverse.neighbor_via(g, "replyOf")


# ---- paths -------------------------------------------------------------------------------------------------------------


def _relaxed(edges: str, source: int, rounds: int) -> str:
    """Shortest distances by unrolled relaxation: r0, r1, ..., each keeping the least."""
    out = [f"ed AS (SELECT a, b, min(w) AS w FROM ({edges}) GROUP BY a, b)", f"r0 AS (SELECT {source}::BIGINT AS id, 0.0::DOUBLE AS dist)"]
    for k in range(1, rounds + 1):
        out.append(f"r{k} AS (SELECT id, min(dist) AS dist FROM (SELECT id, dist FROM r{k - 1} UNION ALL SELECT b, dist + w FROM ed JOIN r{k - 1} ON a = id) GROUP BY id)")
    return ", ".join(out)


_E_BOTH = f"SELECT a, b, 1.0 AS w FROM (SELECT a, n AS b FROM ({_LOCATED}) UNION ALL SELECT n, a FROM ({_LOCATED}) UNION ALL SELECT {_nid('n_nationkey', 'Nation')}, {_nid('n_regionkey', 'Region')} FROM nation UNION ALL SELECT {_nid('n_regionkey', 'Region')}, {_nid('n_nationkey', 'Nation')} FROM nation)"
_NODES4 = f"SELECT {_CUST('c_custkey')} AS id FROM customer UNION ALL SELECT {_SUPP('s_suppkey')} FROM supplier UNION ALL SELECT {_nid('n_nationkey', 'Nation')} FROM nation UNION ALL SELECT {_nid('r_regionkey', 'Region')} FROM region"


@query("Customer Supplier Nation Region", "isLocatedIn isPartOf", sql=f"WITH {_relaxed(_E_BOTH, _START, 5)} SELECT n.id, dist FROM ({_NODES4}) n LEFT JOIN r5 USING (id)")
def sssp_hops(g):
    return paths.sssp(g, _START, directed=False).select("id", F.when(F.col("dist") < float("inf"), F.col("dist")).alias("dist"))


_E_BUYS = f"SELECT c AS a, s AS b, w FROM ({_BUYS}) UNION ALL SELECT s, c, w FROM ({_BUYS})"


@query("Customer Supplier", "buysFrom", sql=f"WITH {_relaxed(_E_BUYS, _START, 7)} SELECT id, dist FROM r7")
def sssp_weighted(g):
    return paths.sssp(g, _START, directed=False, weight_key="weight").where(F.col("dist") < float("inf"))


@query("Customer Supplier", "buysFrom", sql=f"WITH {_relaxed(_E_BUYS, _START, 7)} SELECT dist AS cost FROM r7 WHERE id = {16 + 2}")
def shortest_path_cost(g):
    return g.spark.createDataFrame([(paths.shortest_path(g, _START, 16 + 2, BOTH, weight_property="weight"),)], "cost double")


@query("Customer Supplier", "buysFrom", sql=f"WITH p AS ({_BUYS}), {_relaxed('SELECT c AS a, s AS b, 1.0 / (w + 0.5) AS w FROM p UNION ALL SELECT s, c, 1.0 / (w + 0.5) FROM p', _START, 9)} SELECT id, round(dist, 6) AS dist FROM r9")
def dijkstra_pair_weights(g):
    pairs = g.rels.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")
    return paths.dijkstra_pair_weights(g, _START, pairs, BOTH, base=0.5).distances().select("id", F.round("dist", 6).alias("dist"))


@query("Customer Supplier", "buysFrom", sql=f"WITH {_relaxed(_E_BUYS, _START, 7)} SELECT id, dist AS cost FROM r7")
def path_nodes(g):
    """The paths to all nodes, step by step: the least weights of their steps add up to the distance."""
    found = paths.dijkstra(g, _START, BOTH, weight=F.col("weight"))
    steps = found.paths(found.reached())
    nxt = steps.select("target", (F.col("step") - 1).alias("step"), F.col("id").alias("node"))
    least = g.adj(BOTH, props=["weight"]).groupBy("node", "nbr").agg(F.min("weight").alias("w"))
    walked = steps.join(nxt, ["target", "step"], "left").join(least, (F.col("nbr") == F.col("id")) & (least["node"] == nxt["node"]), "left")
    return walked.groupBy(F.col("target").alias("id")).agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("cost"))


@query("Customer Supplier", "buysFrom", sql=f"WITH {_relaxed(_E_BUYS, _START, 7)} SELECT id, dist AS cost FROM r7 WHERE id IN ({16 * 3 + 2}, {16 * 5 + 3}, {16 * 9 + 2}) AND id IN (SELECT a FROM ({_E_BUYS}))")
def weighted_shortest_path(g):
    """Costs between a customer and some others, each search of its own."""
    rows = [(t, paths.weighted_shortest_path(g, _START, t, BOTH, weight=F.col("weight"))) for t in (16 * 3 + 2, 16 * 5 + 3, 16 * 9 + 2)]
    return g.spark.createDataFrame([r for r in rows if r[1] is not None], "id long, cost double")


# ---- folding -----------------------------------------------------------------------------------------------------------


@query("Customer Order Supplier", "suppliedBy placed isLocatedIn", sql=f"""
WITH f AS (SELECT {_nid('c_nationkey', 'Nation')} AS pa, {_nid('s_nationkey', 'Nation')} AS pb FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT least(pa, pb) AS a, greatest(pa, pb) AS b, count(*) AS weight FROM f WHERE pa <> pb GROUP BY ALL""")
def fold_via_pairs(g):
    """Trade between nations: an order is projected to its customer's nation, a supplier to its own."""
    of_order = expand.follow(g, g.with_label("Order").select("id"), [(IN, "placed"), (OUT, "isLocatedIn")])
    of_supplier = expand.follow(g, g.with_label("Supplier").select("id"), [(OUT, "isLocatedIn")])
    return fold.fold_via(g, "suppliedBy", of_order.unionByName(of_supplier))


@query("Nation Customer Order Supplier", "suppliedBy placed isLocatedIn", sql=f"""
WITH f AS (SELECT {_nid('c_nationkey', 'Nation')} AS pa, {_nid('s_nationkey', 'Nation')} AS pb FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
w AS (SELECT least(pa, pb) AS a, greatest(pa, pb) AS b, count(*) AS weight FROM f WHERE pa <> pb GROUP BY ALL),
k AS (SELECT {_nid('p.n_nationkey', 'Nation')} AS x, {_nid('q.n_nationkey', 'Nation')} AS y FROM nation p, nation q)
SELECT x, y, weight FROM k LEFT JOIN w ON a = least(x, y) AND b = greatest(x, y)""")
def pair_weight_lookup(g):
    """The trade of every two nations, asked in either order."""
    nations = [r.id for r in g.with_label("Nation").select("id").collect()]  # a fixed number of them
    asked = g.spark.createDataFrame([(x, y) for x in nations for y in nations], "x long, y long")
    of_order = expand.follow(g, g.with_label("Order").select("id"), [(IN, "placed"), (OUT, "isLocatedIn")])
    of_supplier = expand.follow(g, g.with_label("Supplier").select("id"), [(OUT, "isLocatedIn")])
    return fold.pair_weight(fold.fold_via(g, "suppliedBy", of_order.unionByName(of_supplier)), asked)


@query("", "hasPart", sql=f"WITH h AS ({_HASPART}) SELECT y.p AS id, count(*) AS n FROM h x JOIN h y ON x.o = y.o WHERE x.p = 4 AND y.p <> 4 GROUP BY y.p")
def co_occurring_count(g):
    return fold.co_occurring(g, 4, "hasPart", IN)


@query("Order", "hasPart", sql=f"WITH h AS ({_HASPART}), d AS (SELECT {_ORD('o_orderkey')} AS o, {_EPOCH.format('o_orderdate')} AS day FROM orders) SELECT y.p AS id, count(DISTINCT day) AS n FROM h x JOIN h y ON x.o = y.o JOIN d ON d.o = x.o WHERE x.p = 4 AND y.p <> 4 GROUP BY y.p")
def co_occurring_distinct_day(g):
    return fold.co_occurring(g, 4, "hasPart", IN, distinct_key="day")


_SIZES = f"""WITH g AS (SELECT {_PART('l_partkey')} AS id, c_nationkey AS grp, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
z AS (SELECT {_PART('p_partkey')} AS id, coalesce(max(n), 0) AS size FROM part LEFT JOIN g ON g.id = {_PART('p_partkey')} GROUP BY p_partkey)"""


def _groups(g):
    return fold.neighbor_groups(g, g.with_label("Part").select("id"), "hasPart", IN).project(("placed", IN), "isLocatedIn")


@query("Part", "hasPart placed isLocatedIn", sql=f"{_SIZES} SELECT id, size FROM z")
def neighbor_group_sizes(g):
    return _groups(g).sizes()


@query("Part", "hasPart placed isLocatedIn", sql=f"{_SIZES} SELECT z.id, z.size FROM z JOIN part ON z.id = {_PART('p_partkey')} ORDER BY z.size DESC, p_size, z.id LIMIT 10")
def neighbor_group_top(g):
    return _groups(g).top_by_size(10, tie="size")


_PAIRS = f"""WITH m AS (SELECT o, p, count(*) AS m FROM ({_HASPART}) GROUP BY o, p),
k AS (SELECT x.p AS a, y.p AS b, x.m * y.m AS k FROM m x JOIN m y ON x.o = y.o AND x.p < y.p UNION ALL SELECT p, p, m * (m - 1) // 2 FROM m WHERE m > 1),
t AS (SELECT a, b, sum(k)::BIGINT AS n FROM k GROUP BY a, b)"""


@query("", "hasPart", sql=f"{_PAIRS} SELECT * FROM t")
def bi1_pairs(g):
    """Parts ordered together, over all orders."""
    return fold.pair_counts(g, "hasPart")


@query("Customer", "buysFrom", sql=f"""WITH m AS (SELECT DISTINCT c, s FROM ({_BUYS}) WHERE c < 100 * 16)
SELECT x.c AS a, y.c AS b, count(*) AS n FROM m x JOIN m y ON x.s = y.s AND x.c < y.c GROUP BY ALL HAVING count(*) >= 5""")
def bi2_shared_interest(g):
    """Pairs of the first hundred customers by the suppliers they share."""
    return fold.shared_neighbors(g, "buysFrom", g.nodes.where("id < 1600").select("id"), least=5)


@query("", "hasPart", sql=f"SELECT {_PART('l_partkey')} AS nbr, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, nbr LIMIT 10")
def bi3_popular(g):
    """The ten parts on most order lines."""
    return expand.popular(g, OUT, "hasPart", 10)


@query("Order", "placed", sql=f"SELECT {_CUST('o_custkey')} AS nbr, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey ORDER BY n DESC, nbr LIMIT 10")
def bi4_top_commenters(g):
    """Customers with most finished orders."""
    return expand.popular(g, IN, "placed", 10, members=g.nodes.where("status = 'F'").select("id"))


@query("User", "triggered", sql="SELECT user_id::BIGINT * 16 + 6 AS nbr, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, nbr LIMIT 10")
def bi5_active_users(g):
    return expand.popular(g, IN, "triggered", 10)


@query("Order", "hasPart", sql=f"""WITH m AS (SELECT {_ORD('l_orderkey')} AS o, {_PART('l_partkey')} AS p, count(*) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY ALL),
k AS (SELECT x.p AS a, y.p AS b, x.m * y.m AS k FROM m x JOIN m y ON x.o = y.o AND x.p < y.p UNION ALL SELECT p, p, m * (m - 1) // 2 FROM m WHERE m > 1)
SELECT a, b, sum(k)::BIGINT AS n FROM k GROUP BY a, b ORDER BY n DESC, a, b LIMIT 10""")
def bi6_pair_top10(g):
    """The ten pairs of parts most often in one open order."""
    return fold.top(fold.pair_counts(g, "hasPart", sources=g.nodes.where("status = 'O'").select("id")), 10, keys=("a", "b"))


# ---- aggregation -------------------------------------------------------------------------------------------------------


@query("Order Part", sql=f"SELECT count(*) AS total FROM orders WHERE {_EPOCH.format('o_orderdate')} < 9500")
def agg_total(g):
    return agg_ops.aggregate(g, "Order").where("day", "<", 9500).total()


_BIN = "CASE WHEN {0} >= 2000 THEN 1 ELSE 0 END + CASE WHEN {0} >= 5000 THEN 1 ELSE 0 END"


@query("Document Message", sql=f"""SELECT 'Document' AS label, {_BIN.format('n_chars')} AS n_chars_bin, count(*) AS count, sum(n_chars)::BIGINT AS sum
FROM documents WHERE n_chars < 9000 AND n_chars <> 0 GROUP BY 1, 2""")
def agg_by_label_bin_sum(g):
    return agg_ops.aggregate(g, "Document").where("n_chars", "<", 9000).having("n_chars", "!=", 0).by_label().bin("n_chars", [2000, 5000]).sum("n_chars").plan()[0]


@query("Part", sql="SELECT p_size::BIGINT AS size, count(*) AS count FROM part WHERE p_size >= 10 GROUP BY p_size")
def agg_by_column(g):
    return agg_ops.aggregate(g, "Part").where("size", ">=", 10).by("size").plan()[0]


@query("Message", "replyOf", sql="SELECT count(*) AS total FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND r.turn = 0 AND r.role = 'user')")
def agg_filter_via_root(g):
    return agg_ops.aggregate(g, "Message").where_via(traverse.roots_via(g, "replyOf"), "role", ["user"]).total()


@query("Order", "hasPart", sql=f"SELECT {_PART('l_partkey')} AS neighbor, count(*) AS count, sum({_EPOCH.format('o_orderdate')})::BIGINT AS sum FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {_EPOCH.format('o_orderdate')} >= 9000 GROUP BY l_partkey")
def agg_through(g):
    return agg_ops.aggregate(g, "Order").where("day", ">=", 9000).through("hasPart").sum("day").plan()[0]


@query("Order Part", "hasPart", sql=f"SELECT {_PART('l_partkey')} AS neighbor, count(*) AS count FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size = 15 GROUP BY l_partkey")
def agg_through_only(g):
    return agg_ops.aggregate(g, "Order").through("hasPart").only_neighbors(g.nodes.where("size = 15").select("id")).plan()[0]


@query("Order", sql="SELECT o_orderstatus AS status, count(*) AS count, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS sum FROM orders GROUP BY o_orderstatus")
def agg_group_reduce(g):
    return agg_ops.group_reduce(g.nodes.withColumn("p", F.col("totalprice").cast("decimal(18,2)")), ["status"], "p").withColumn("sum", F.col("sum").cast("double"))


# ---- analytics ---------------------------------------------------------------------------------------------------------

_ALL4 = "Customer Supplier Nation Region"
_GEO_E = f"SELECT a, n AS b FROM ({_LOCATED}) UNION ALL SELECT {_nid('n_nationkey', 'Nation')}, {_nid('n_regionkey', 'Region')} FROM nation"


def _ranks(edges: str, rounds: int) -> str:
    out = [f"v AS ({_NODES4})", f"e AS ({edges})", "n AS (SELECT count(*)::DOUBLE AS n FROM v)", "deg AS (SELECT a AS id, count(*) AS k FROM e GROUP BY a)", "p0 AS (SELECT id, 1.0 / n AS r FROM v, n)"]
    for k in range(1, rounds + 1):
        q = f"p{k - 1}"
        out.append(f"s{k} AS (SELECT coalesce(sum(r), 0.0) AS lost FROM {q} WHERE id NOT IN (SELECT id FROM deg))")
        out.append(f"g{k} AS (SELECT b AS id, sum(r / k) AS got FROM e JOIN deg ON a = deg.id JOIN {q} ON a = {q}.id GROUP BY b)")
        out.append(f"p{k} AS (SELECT v.id, 0.15 / n + 0.85 * coalesce(got, 0.0) + 0.85 * lost / n AS r FROM v CROSS JOIN n CROSS JOIN s{k} LEFT JOIN g{k} ON v.id = g{k}.id)")
    return ", ".join(out)


@query(_ALL4, "isLocatedIn isPartOf", sql=f"WITH {_ranks(_GEO_E, 10)} SELECT id, round(r, 9) AS rank FROM p10")
def pagerank_10(g):
    return analytics.pagerank(g, iterations=10).select("id", F.round("rank", 9).alias("rank"))


@query(_ALL4, "isLocatedIn isPartOf", sql=f"WITH {_ranks(f'SELECT a, b FROM ({_GEO_E}) UNION ALL SELECT b, a FROM ({_GEO_E})', 5)} SELECT id, round(r, 9) AS rank FROM p5")
def pagerank_undirected(g):
    return analytics.pagerank(g, directed=False, iterations=5).select("id", F.round("rank", 9).alias("rank"))


@query("Message", "replyOf", sql=f"SELECT {_MSG} AS id, (conv_id * 1048576)::BIGINT * 16 + 9 AS component FROM conversations")
def wcc(g):
    return analytics.wcc(g)


def _propagated(start: str, rounds: int) -> str:
    out = [f"v AS ({_NODES4})", f"d AS ({_GEO_E})", "e AS (SELECT a, b FROM d UNION ALL SELECT b, a FROM d)", f"c0 AS ({start})"]
    for k in range(1, rounds + 1):
        q = f"c{k - 1}"
        out.append(f"t{k} AS (SELECT a AS id, label, count(*) AS c FROM e JOIN {q} ON b = {q}.id GROUP BY a, label)")
        out.append(f"b{k} AS (SELECT id, label FROM t{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, label) = 1)")
        out.append(f"c{k} AS (SELECT {q}.id, coalesce(b{k}.label, {q}.label) AS label FROM {q} LEFT JOIN b{k} ON {q}.id = b{k}.id)")
    return ", ".join(out)


@query(_ALL4, "isLocatedIn isPartOf", sql=f"WITH {_propagated('SELECT id, id AS label FROM v', 3)} SELECT id, label FROM c3")
def cdlp_3(g):
    return analytics.cdlp(g, iterations=3)


@query(_ALL4, "isLocatedIn isPartOf", sql=f"WITH {_propagated('SELECT id, id % 7 AS label FROM v', 2)} SELECT id, label FROM c2")
def cdlp_seeded(g):
    return analytics.cdlp(g, iterations=2, seeds=g.nodes.select("id", (F.col("id") % 7).alias("label")))


_N_CUST = "(SELECT count(*) FROM customer)"
_TRI_E = f"SELECT {_CUST('c_custkey')} AS a, {_nid('c_nationkey', 'Nation')} AS b FROM customer UNION SELECT {_CUST('c_custkey')}, {_CUST(f'(c_custkey + 1) % {_N_CUST}')} FROM customer UNION SELECT {_CUST('c_custkey')}, {_CUST(f'(c_custkey * 7) % {_N_CUST}')} FROM customer UNION SELECT {_CUST(f'(c_custkey * 3) % {_N_CUST}')}, {_CUST('c_custkey')} FROM customer"


def _ring(g: PropertyGraph) -> PropertyGraph:
    """All customers with their nation, and chords between customers: a graph with triangles and hubs."""
    n = g.with_label("Customer").count()
    k = F.floor(F.col("id") / 16)
    c = g.with_label("Customer").select(F.col("id").alias("own"), k.alias("k"))
    to = lambda e: (F.pmod(e, F.lit(n)) * 16 + 2).cast("long")
    pairs = F.array(*[F.struct(a.alias("src"), b.alias("dst")) for a, b in ((F.col("own"), to(F.col("k") + 1)), (F.col("own"), to(F.col("k") * 7)), (to(F.col("k") * 3), F.col("own")))])
    chords = c.select(F.explode(pairs).alias("p")).select("p.src", "p.dst")
    rels = g.rels.where(F.col("src") % 16 == 2).select("src", "dst").union(chords).select(F.monotonically_increasing_id().alias("rel_id"), "src", "dst", F.lit("t").alias("rel_type"))
    return PropertyGraph(g.nodes, rels)


def _lcc_sql(both: bool) -> str:
    fwd = "SELECT a, b FROM d UNION SELECT b, a FROM d" if both else "SELECT a, b FROM d"
    return f"""WITH d AS (SELECT DISTINCT a, b FROM ({_TRI_E}) WHERE a <> b), nb AS (SELECT a, b FROM d UNION SELECT b, a FROM d), f AS ({fwd}),
k AS (SELECT a, count(*) AS k FROM nb GROUP BY a), t AS (SELECT x.a AS id, count(*) AS n FROM nb x JOIN f ON x.b = f.a JOIN nb y ON y.a = x.a AND y.b = f.b GROUP BY x.a),
v AS (SELECT {_CUST('c_custkey')} AS id FROM customer UNION ALL SELECT {_nid('n_nationkey', 'Nation')} FROM nation)
SELECT v.id, round(CASE WHEN k.k > 1 THEN coalesce(n, 0) / (k.k * (k.k - 1)) ELSE 0.0 END, 9) AS lcc FROM v LEFT JOIN k ON k.a = v.id LEFT JOIN t ON t.id = v.id"""


@query("Customer Nation", "isLocatedIn", sql=_lcc_sql(False))
def lcc(g):
    return analytics.lcc(_ring(g)).select("id", F.round("lcc", 9).alias("lcc"))


@query("Customer Nation", "isLocatedIn", sql=_lcc_sql(True))
def lcc_undirected(g):
    return analytics.lcc(_ring(g), directed=False).select("id", F.round("lcc", 9).alias("lcc"))


# ---- full text ---------------------------------------------------------------------------------------------------------

_TOK = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_POST = f"""WITH d AS (SELECT doc_id::BIGINT * 16 + 8 AS id, {_TOK} AS tokens FROM documents), p AS (SELECT id, unnest(tokens) AS token FROM d),
tf AS (SELECT token, id, count(*) AS tf FROM p GROUP BY ALL), len AS (SELECT id, len(tokens) AS len FROM d WHERE len(tokens) > 0)"""


@query("Document", sql=f"{_POST} SELECT id FROM tf WHERE token IN ('the', 'license') GROUP BY id HAVING count(*) = 2")
def fts_and(g):
    return fulltext.search(g, "Document", "text", "License, THE the")


@query("Document", sql=f"{_POST} SELECT id FROM tf WHERE token IN ('the', 'under') GROUP BY id HAVING count(*) = 2")
def fts_and_index(g):
    return fulltext.search(g, "Document", "text", "the under", fulltext.index(g, "Document", "text"))


_BM25 = f"""{_POST}, q(token, times) AS (VALUES ('license', 2), ('apache', 1), ('version', 1)), n AS (SELECT count(*)::DOUBLE AS n, sum(len)::DOUBLE / count(*) AS avg FROM len),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
s AS (SELECT tf.id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS score
FROM tf JOIN q USING (token) JOIN df USING (token) JOIN len ON len.id = tf.id, n GROUP BY tf.id)"""


@query("Document", sql=f"{_BM25} SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10")
def fts_bm25_top10(g):
    return fulltext.search_ranked(g, "Document", "text", "Apache License license version", 10).select("id", F.round("score", 6).alias("score"))


@query("Document", sql=f"{_BM25} SELECT id FROM s")
def fts_union(g):
    return fulltext.search_ranked(g, "Document", "text", "apache license license version", None).select("id")


@query("Document", sql=f"{_POST} SELECT (SELECT count(*) FROM len) AS doc_count, (SELECT sum(len)::BIGINT FROM len) AS total_len, (SELECT count(DISTINCT token) FROM tf) AS term_count")
def fts_term_stats(g):
    return fulltext.index(g, "Document", "text").stats()


# ---- geo ---------------------------------------------------------------------------------------------------------------

_POS = f"p AS (SELECT {_CUST('c_custkey')} AS id, (c_custkey * 37 % 18001) / 100.0 - 90 AS lat, (c_custkey * 101 % 36001) / 100.0 - 180 AS lon FROM customer)"
_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians({1}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2))))"


@query("Customer", sql=f"WITH {_POS}, k AS (SELECT id, {_KM.format('lat', '51.5', 'lon', '-0.12')} AS km FROM p) SELECT id, round(km, 6) AS km FROM k WHERE km <= 2500")
def geo_radius(g):
    return geo.within_radius(g, "Customer", "lat", "lon", 51.5, -0.12, 2500).select("id", F.round("km", 6).alias("km"))


@query("Customer", sql=f"WITH {_POS} SELECT id FROM p WHERE lat BETWEEN 10 AND 40 AND lon BETWEEN -20 AND 60")
def geo_bbox(g):
    return geo.within_bbox(g, "Customer", "lat", "lon", 10, -20, 40, 60)


@query("Customer", sql=f"WITH {_POS} SELECT id FROM p WHERE lat BETWEEN -30 AND 30 AND (lon >= 170 OR lon <= -170)")
def geo_bbox_antimeridian(g):
    return geo.within_bbox(g, "Customer", "lat", "lon", -30, 170, 30, -170)


@query("Customer", sql=f"WITH {_POS}, k AS (SELECT id, {_KM.format('lat', '40.7', 'lon', '-74.0')} AS km FROM p) SELECT id, round(km, 6) AS km FROM k ORDER BY k.km, id LIMIT 10")
def geo_knn(g):
    return geo.knn(g, "Customer", "lat", "lon", 40.7, -74.0, 10).select("id", F.round("km", 6).alias("km"))


@query("Customer", sql=f"WITH {_POS} SELECT id, round({_KM.format('lat', '48.8566', 'lon', '2.3522')}, 6) AS km FROM p")
def haversine(g):
    return g.nodes.select("id", F.round(scalar.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.8566), F.lit(2.3522)), 6).alias("km"))


@query("Customer", sql=f"WITH {_POS} SELECT a.id AS left_id, b.id AS right_id FROM p a JOIN p b ON a.id < b.id WHERE {_KM.format('a.lat', 'b.lat', 'a.lon', 'b.lon')} <= 150")
def geo_near_pairs(g):
    p = geo.positions(g, "Customer", "lat", "lon")
    return geo.near_pairs(p, p, 150).where("left_id < right_id").select("left_id", "right_id")


# ---- loading -----------------------------------------------------------------------------------------------------------


def loaded(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = lambda spark, sf_dir: f(GraphLoader(spark), testgraph.Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


@loaded("node_dedup_merge", "SELECT c_nationkey::BIGINT AS nation, c_mktsegment AS segment, count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY ALL")
def _dedup_merge(loader, t):
    loader.load_nodes(t("customer"), node_id_column="c_custkey", label_columns=["c_mktsegment"], property_columns=["c_nationkey"], unique_properties=["c_nationkey"])
    return loader.nodes().select(F.col("c_nationkey").alias("nation"), F.explode("labels").alias("segment")).groupBy("nation", "segment").agg(F.count("*").alias("n"))


@loaded("node_dedup_keep_first", "SELECT n_regionkey::BIGINT AS region, count(*) AS n FROM (SELECT DISTINCT n_regionkey FROM nation) GROUP BY ALL")
def _dedup_first(loader, t):
    df = t("nation").select(F.col("n_regionkey").cast("long").alias("region"), "n_name")
    loader.load_nodes(df, default_label="Nation", unique_properties=["region"], on_duplicate="keep_first")
    return loader.nodes().groupBy("region").agg(F.count("*").alias("n"))


def _lines(t) -> DataFrame:
    return t("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rel_id"), F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("suppliedBy").alias("rel_type"), F.col("l_returnflag").alias("flag"))


@loaded("rel_dedup_type", "SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem")
def _rel_type(loader, t):
    return dedup_rels(_lines(t), RelDedup.UNIQUE_BY_TYPE, (), null_keys="skip").select("src", "dst")


@loaded("rel_dedup_keys", "SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst, l_returnflag AS flag FROM lineitem")
def _rel_keys(loader, t):
    return dedup_rels(_lines(t), RelDedup.UNIQUE_BY_TYPE_AND_KEYS, ["flag"], null_keys="skip").select("src", "dst", "flag")


@loaded("ref_property_join", "SELECT c_custkey AS start, 100000 + c_nationkey::BIGINT AS \"end\" FROM customer")
def _ref_property(loader, t):
    loader.load_nodes(t("customer").select("c_custkey"), node_id_column="c_custkey", default_label="Customer")
    loader.load_nodes(t("nation").select((F.col("n_nationkey").cast("long") + 100000).alias("id"), F.col("n_nationkey").alias("code")), node_id_column="id", default_label="Nation")
    return loader.load_relationships(t("customer"), IdRef("c_custkey"), PropertyRef("c_nationkey", "code", "Nation"), fixed_rel_type="isLocatedIn")


@loaded("ref_composite_join", "SELECT c.c_custkey AS start, 100000 + min(p.c_custkey) AS \"end\" FROM customer c JOIN customer p ON c.c_nationkey = p.c_nationkey AND c.c_mktsegment = p.c_mktsegment GROUP BY c.c_custkey")
def _ref_composite(loader, t):
    loader.load_nodes(t("customer").select("c_custkey"), node_id_column="c_custkey", default_label="Customer")
    keyed = t("customer").select((F.col("c_custkey") + 100000).alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    loader.load_nodes(keyed, node_id_column="id", default_label="Key")
    return loader.load_relationships(t("customer"), IdRef("c_custkey"), CompositeRef(("c_nationkey", "c_mktsegment"), ("nation", "segment"), "Key"), fixed_rel_type="like")


@loaded("missing_endpoint_filter", "SELECT count(*) AS made, (SELECT count(*) FROM orders) - count(*) AS skipped FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _missing(loader, t):
    """Orders of customers in credit: the others have no customer node to start from."""
    loader.load_nodes(t("customer").where("c_acctbal > 0").select("c_custkey"), node_id_column="c_custkey")
    top = t("customer").agg(F.max("c_custkey")).first()[0] + 1
    loader.load_nodes(t("orders").select((F.col("o_orderkey") + top).alias("id")), node_id_column="id")
    made = loader.load_relationships(t("orders").withColumn("o", F.col("o_orderkey") + top), "o_custkey", "o", fixed_rel_type="placed")
    return made.agg(F.count("*").alias("made")).crossJoin(F.broadcast(loader.skipped[0]))


# ---- records and corpora -----------------------------------------------------------------------------------------------


@query("Part", sql="WITH r AS (SELECT p_partkey::BIGINT AS id, strlen(p_name)::BIGINT AS n FROM part) SELECT id, (sum(n) OVER (ORDER BY id) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY id))::BIGINT AS \"end\" FROM r")
def record_ranges(g):
    return corpus.record_ranges(g.nodes.select(F.floor(F.col("id") / 16).alias("id"), F.col("name").cast("binary").alias("payload")))


@query("Part", sql="""WITH r AS (SELECT p_partkey::BIGINT AS id, strlen(p_name)::BIGINT AS n FROM part), x AS (SELECT id, sum(n) OVER (ORDER BY id) - n AS s, sum(n) OVER (ORDER BY id) AS e FROM r),
m AS (SELECT *, CASE WHEN s - lag(e) OVER (ORDER BY s) > 64 THEN 1 ELSE 0 END AS far FROM x WHERE id % 5 = 0 OR id % 7 = 0), i AS (SELECT *, sum(far) OVER (ORDER BY s) AS island FROM m)
SELECT min(s)::BIGINT AS start, max(e)::BIGINT AS "end", count(*) AS n FROM i GROUP BY island""")
def plan_ranges(g):
    ranges = corpus.record_ranges(g.nodes.select(F.floor(F.col("id") / 16).alias("id"), F.col("name").cast("binary").alias("payload")))
    return corpus.plan_ranges(ranges, ranges.where("id % 5 = 0 OR id % 7 = 0"), 64)


@query("Part", sql="SELECT p_partkey::BIGINT AS id FROM part WHERE contains(lower(p_name), 'par') AND contains(lower(p_name), 'art') ORDER BY id LIMIT 20")
def trigram_search(g):
    docs = g.nodes.select(F.floor(F.col("id") / 16).alias("id"), F.col("name").alias("text"))
    return corpus.trigram_search(corpus.ngram_postings(docs), "part", 20)


@query("Document", sql="SELECT doc_id AS key, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS id FROM documents")
def ranked_ids(g):
    docs = g.nodes.select(F.floor(F.col("id") / 16).alias("key"), F.floor(F.col("id") / 16).alias("seq"), F.col("n_chars").alias("rank"))
    return corpus.ranked_ids(docs).select("key", "id")


@query("Message", sql="""WITH d AS (SELECT conv_id * 1048576 + turn AS key, row_number() OVER (ORDER BY length(text) DESC, conv_id, turn) - 1 AS id, turn FROM conversations)
SELECT a.id AS src, b.id AS dst FROM d a JOIN d b ON b.key = a.key - 1 WHERE a.turn > 0""")
def corpus_links(g):
    key = F.floor(F.col("id") / 16)
    docs = g.nodes.select(key.alias("key"), key.alias("seq"), F.length("text").alias("rank"), "text", F.array(key - 1, F.lit(-5).cast("long")).alias("links"))
    return corpus.build_shared_corpus(docs).graph.rels.select("src", "dst")


from . import catalogue_io  # noqa: E402, F401  registers loaders, saved graphs, builders and the rest
