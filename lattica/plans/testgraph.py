"""The property graph that queries run on, derived from the relational tables.

A node's id is key * 16 + a code of its label, so ids are sparse and the same arithmetic holds in any SQL. Only the tables of the
requested labels and types are read. A relationship's ordinal is a number of its own for every row, parallel ones included: a key of
its type times 16 plus the type's code. Where it isn't used the numbering of parallel lines isn't planned at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph

CODES = {"Region": 0, "Nation": 1, "Customer": 2, "Supplier": 3, "Part": 4, "Order": 5, "User": 6, "Event": 7, "Document": 8, "Message": 9}
TYPE_CODES = {"isPartOf": 0, "isLocatedIn": 1, "placed": 2, "hasPart": 3, "suppliedBy": 4, "supplies": 5, "buysFrom": 6, "triggered": 7, "follows": 8, "replyOf": 9}
#: A conversation's turns are numbered below this.
_TURNS = 1 << 20
#: Lines of an order, and keys of the second end of a pair, are numbered below these.
_LINES, _KEYS = 1 << 16, 1 << 31


def node_id(key: Column | str, label: str) -> Column:
    return F.col(key).cast("long") * 16 + CODES[label] if isinstance(key, str) else key.cast("long") * 16 + CODES[label]


def _day(col: str) -> Column:
    return F.unix_date(F.to_date(col)).cast("long")


def _message_key() -> Column:
    return F.col("conv_id") * _TURNS + F.col("turn")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def _node_tables(t: Tables) -> dict[str, Callable[[], DataFrame]]:
    c = F.col

    def made(df: DataFrame, key, label: str, **props: Column) -> DataFrame:
        return df.select(node_id(key, label).alias("id"), F.array(F.lit(label)).alias("labels"), *[v.alias(k) for k, v in props.items()])

    return {
        "Region": lambda: made(t("region"), "r_regionkey", "Region", name=c("r_name")),
        "Nation": lambda: made(t("nation"), "n_nationkey", "Nation", name=c("n_name")),
        "Customer": lambda: made(
            t("customer"), "c_custkey", "Customer", name=c("c_name"), acctbal=c("c_acctbal"), mktsegment=c("c_mktsegment"),
            lat=(c("c_custkey") * 37 % 18001) / 100.0 - 90, lon=(c("c_custkey") * 101 % 36001) / 100.0 - 180),
        "Supplier": lambda: made(t("supplier"), "s_suppkey", "Supplier", name=c("s_name"), acctbal=c("s_acctbal")),
        "Part": lambda: made(t("part"), "p_partkey", "Part", name=c("p_name"), brand=c("p_brand"), type=c("p_type"), size=c("p_size").cast("long"), retailprice=c("p_retailprice")),
        "Order": lambda: made(t("orders"), "o_orderkey", "Order", status=c("o_orderstatus"), totalprice=c("o_totalprice"), day=_day("o_orderdate"), priority=c("o_orderpriority")),
        "User": lambda: made(t("events").select("user_id").distinct(), "user_id", "User"),
        "Event": lambda: made(t("events"), "event_id", "Event", event_type=c("event_type"), value=c("value"), day=_day("ts")),
        "Document": lambda: made(t("documents"), "doc_id", "Document", text=c("text"), lang=c("lang"), source=c("source"), n_chars=c("n_chars")),
        "Message": lambda: made(t("conversations"), _message_key(), "Message", role=c("role"), text=c("text")),
    }


def _rel_tables(t: Tables) -> dict[str, Callable[[], DataFrame]]:
    c = F.col

    def made(df: DataFrame, src: Column, dst: Column, kind: str, ordinal: Column | str, **props: Column) -> DataFrame:
        key = c(ordinal) if isinstance(ordinal, str) else ordinal
        return df.select((key.cast("long") * 16 + TYPE_CODES[kind]).alias("rel_id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("rel_type"), *[v.alias(k) for k, v in props.items()])

    def lines() -> DataFrame:
        return t("lineitem")

    def numbered() -> tuple[DataFrame, Column]:
        """Lines, and an ordinal: an order's lines are numbered by part, then by all that tells them apart."""
        by = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
        return lines().withColumn("_line", F.row_number().over(by)), c("l_orderkey") * _LINES + c("_line")

    def pair(a: str, b: str) -> Column:
        return c(a).cast("long") * _KEYS + c(b)

    def has_part() -> DataFrame:
        df, ordinal = numbered()
        return made(df, node_id("l_orderkey", "Order"), node_id("l_partkey", "Part"), "hasPart", ordinal, qty=c("l_quantity"), price=c("l_extendedprice"), day=_day("l_shipdate"))

    def supplied_by() -> DataFrame:
        df, ordinal = numbered()
        return made(df, node_id("l_orderkey", "Order"), node_id("l_suppkey", "Supplier"), "suppliedBy", ordinal, qty=c("l_quantity"))

    def buys() -> DataFrame:
        pairs = lines().join(t("orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))
        return made(pairs, node_id("o_custkey", "Customer"), node_id("l_suppkey", "Supplier"), "buysFrom", pair("o_custkey", "l_suppkey"), weight=c("n").cast("double"))

    def located() -> DataFrame:
        customers = made(t("customer"), node_id("c_custkey", "Customer"), node_id("c_nationkey", "Nation"), "isLocatedIn", c("c_custkey") * 2)
        return customers.unionAll(made(t("supplier"), node_id("s_suppkey", "Supplier"), node_id("s_nationkey", "Nation"), "isLocatedIn", c("s_suppkey") * 2 + 1))

    def follows() -> DataFrame:
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return made(t("events").withColumn("prev", F.lag("event_id").over(order)).where("prev IS NOT NULL"), node_id("event_id", "Event"), node_id("prev", "Event"), "follows", "event_id")

    return {
        "isPartOf": lambda: made(t("nation"), node_id("n_nationkey", "Nation"), node_id("n_regionkey", "Region"), "isPartOf", "n_nationkey"),
        "isLocatedIn": located,
        "placed": lambda: made(t("orders"), node_id("o_custkey", "Customer"), node_id("o_orderkey", "Order"), "placed", "o_orderkey", day=_day("o_orderdate")),
        "hasPart": has_part,
        "suppliedBy": supplied_by,
        "supplies": lambda: made(lines().select("l_suppkey", "l_partkey").distinct(), node_id("l_suppkey", "Supplier"), node_id("l_partkey", "Part"), "supplies", pair("l_suppkey", "l_partkey")),
        "buysFrom": buys,
        "triggered": lambda: made(t("events"), node_id("user_id", "User"), node_id("event_id", "Event"), "triggered", "event_id"),
        "follows": follows,
        "replyOf": lambda: made(t("conversations").where("turn > 0"), node_id(_message_key(), "Message"), node_id(_message_key() - 1, "Message"), "replyOf", _message_key()),
    }


def graph(spark: SparkSession, sf_dir: str, labels: Sequence[str] = (), types: Sequence[str] = ()) -> PropertyGraph:
    """The graph of the given labels and relationship types."""
    t = Tables(spark, sf_dir)
    node_parts, rel_parts = _node_tables(t), _rel_tables(t)
    nodes = None
    for label in labels:
        part = node_parts[label]()
        nodes = part if nodes is None else nodes.unionByName(part, allowMissingColumns=True)
    rels = None
    for kind in types:
        part = rel_parts[kind]()
        rels = part if rels is None else rels.unionByName(part, allowMissingColumns=True)
    nodes = nodes if nodes is not None else spark.createDataFrame([], "id long, labels array<string>")
    rels = rels if rels is not None else spark.createDataFrame([], "rel_id long, src long, dst long, rel_type string")
    return PropertyGraph(nodes, rels)
