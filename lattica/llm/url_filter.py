"""URL filters: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, then full digests and precedence.

Every URL yields the expressions ``suffix + path[:n]`` for each host suffix of as many labels as a rule's host has, and each path
length ``n`` that a rule has: a host of very many labels costs no more than its length. Expressions meet the rules on the first 4
bytes of their SHA-256 digest; the whole digest confirms a match, and of the confirmed rules the longest wins (host and path
together; then by the longer host, then blocking first). The winner is found row by row, before and after one shuffle by row
number, so that a frequent host isn't gathered anywhere.

Nulls, urls without ``://``: host and path are empty, no rule fits, the verdict is the default. Repeated rows keep their own
result rows. Only ``id`` and ``url`` are read, so further columns of any name are harmless. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to this count are broadcast (under 10 MB of digests); more go through a shuffle join.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query, as given by its contract.
BASE_RULES = (
    UrlRule("com", "/en/", "block"),
    UrlRule("example.com", "/en/7", "allow"),
    UrlRule("net", "/de/", "allow"),
    UrlRule("example.net", "/de/8", "block"),
    UrlRule("org", "/es/", "block"),
)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, depths: Sequence[int], lengths: Sequence[int]) -> Column:
    """All expressions of a url: host suffixes of the given numbers of labels (none where the host has fewer) times the path's
    prefixes of the given lengths (none where the path is shorter)."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    suffixes = F.array_compact(F.array(*[F.when((host != "") & (dots >= k - 1), F.substring_index(host, ".", -k)) for k in depths]))
    wanted = F.filter(F.array(*[F.lit(int(n)) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(wanted, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))


def rule_table(spark: SparkSession, rules: Sequence[UrlRule]) -> DataFrame:
    """(rule, verdict, ord, digest, short); a higher ``ord`` wins. Of rules with the same text and verdict one is kept."""
    ranked = sorted(set(rules), key=lambda r: (len(r.text), len(r.host), r.verdict == "block", r.text))
    df = spark.createDataFrame([(r.text, r.verdict, i) for i, r in enumerate(ranked)], "rule string, verdict string, ord int")
    digest = F.unhex(F.sha2(F.col("rule"), 256))
    return df.select("*", digest.alias("digest"), F.substring(digest, 1, 4).alias("short"))


def filter_urls(pages: DataFrame, rules: Sequence[UrlRule] = BASE_RULES, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: id, host, path, winning rule (or null), verdict."""
    base = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not rules:
        return base.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths, depths = sorted({len(r.path) for r in rules}), sorted({r.host.count(".") + 1 for r in rules})
    table = rule_table(pages.sparkSession, rules)
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    numbered = base.withColumn("row", F.monotonically_increasing_id())
    each = numbered.select("*", F.explode_outer(expressions(F.col("host"), F.col("path"), depths, lengths)).alias("expr")).withColumn("full", F.unhex(F.sha2(F.col("expr"), 256)))
    met = each.withColumn("short", F.substring("full", 1, 4)).join(table, "short", "left")
    won = F.max(F.when(F.col("full") == F.col("digest"), F.struct("ord", "rule", "verdict"))).alias("won")
    return met.groupBy("row", F.col(id_col), "host", "path").agg(won).select(
        id_col, "host", "path", F.col("won.rule").alias("rule"), F.coalesce(F.col("won.verdict"), F.lit(default)).alias("verdict")
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP9_SQL = """
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule_host, rule_path, verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m USING (page_id)
"""
