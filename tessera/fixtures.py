"""The driver's tables as graphs: DataFrames for Spark, and the same definitions as common table expressions for DuckDB."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Tables:
    spark: SparkSession
    path: str

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key))


def nodes(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    nation = t.nation.select("n_nationkey", F.concat(F.lit("region:"), "n_regionkey").alias("domain"))
    customer = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [
        t.region.select(_id("region", "r_regionkey").alias("id"), F.lit("domain").alias("kind"), F.col("r_name").alias("name"), none.alias("file"), _id("region", "r_regionkey").alias("domain")),
        t.nation.select(_id("nation", "n_nationkey"), F.lit("module"), "n_name", none, F.concat(F.lit("region:"), "n_regionkey")),
        customer.select(_id("customer", "c_custkey"), F.lit("external_actor"), "c_name", F.concat("c_nationkey", F.lit("/customer")), "domain"),
        t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(_id("supplier", "s_suppkey"), F.lit("service"), "s_name", F.concat("s_nationkey", F.lit("/supplier")), "domain"),
        t.orders.join(customer.select("c_custkey", "domain"), F.col("o_custkey") == F.col("c_custkey"), "left").select(_id("order", "o_orderkey"), F.lit("endpoint"), F.concat(F.lit("order "), "o_orderkey"), F.concat(F.lit("orders/"), "o_orderstatus"), "domain"),
        t.part.select(_id("part", "p_partkey"), F.lit("database_model"), "p_name", F.concat("p_brand", F.lit("/"), "p_type"), none),
    ]
    return reduce(DataFrame.union, parts)


def edges(t: Tables) -> DataFrame:
    def edge(df: DataFrame, kind: str, source: Column, target: Column, confidence: Column, source_type: Column, suffix: Column) -> DataFrame:
        cols = df.select(F.lit(kind).alias("type"), source.alias("source"), target.alias("target"), confidence.alias("confidence"), source_type.alias("source_type"), suffix.alias("suffix"))
        return cols.select(F.concat_ws("|", "type", "source", "target", "suffix").alias("id"), "source", "target", "type", "confidence", "source_type")

    one, ast, none = F.lit(1.0), F.lit("ast"), F.lit("")
    item = t.lineitem
    how = F.when(F.col("l_returnflag") == "R", "heuristic").when(F.col("l_returnflag") == "A", "compiler").otherwise("ast")
    suffix = F.concat_ws(":", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    parts = [
        edge(t.nation, "BELONGS_TO_DOMAIN", _id("nation", "n_nationkey"), _id("region", "n_regionkey"), one, F.lit("heuristic"), none),
        edge(t.customer, "CONTAINS", _id("nation", "c_nationkey"), _id("customer", "c_custkey"), one, ast, none),
        edge(t.supplier, "CONTAINS", _id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), one, ast, none),
        edge(t.orders, "CALLS", _id("customer", "o_custkey"), _id("order", "o_orderkey"), one, ast, none),
        edge(item, "READS_FROM", _id("order", "l_orderkey"), _id("part", "l_partkey"), F.round(1 - F.col("l_discount"), 2), how, suffix),
        edge(item.select("l_partkey", "l_suppkey").distinct(), "DEPENDS_ON", _id("part", "l_partkey"), _id("supplier", "l_suppkey"), one, F.lit("schema"), none),
    ]
    return reduce(DataFrame.union, parts)


NODES_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'domain' AS kind, r_name AS name, CAST(NULL AS VARCHAR) AS file, 'region:' || r_regionkey AS domain FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'module', n_name, NULL, 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'external_actor', c_name, c_nationkey || '/customer', 'region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'service', s_name, s_nationkey || '/supplier', 'region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'order:' || o_orderkey, 'endpoint', 'order ' || o_orderkey, 'orders/' || o_orderstatus, 'region:' || n_regionkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, 'database_model', p_name, p_brand || '/' || p_type, NULL FROM part)"""

EDGES_SQL = """edges AS (
  SELECT type || '|' || source || '|' || target || '|' || suffix AS id, source, target, type, confidence, source_type FROM (
    SELECT 'BELONGS_TO_DOMAIN' AS type, 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 1.0::DOUBLE AS confidence, 'heuristic' AS source_type, '' AS suffix FROM nation
    UNION ALL SELECT 'CONTAINS', 'nation:' || c_nationkey, 'customer:' || c_custkey, 1.0, 'ast', '' FROM customer
    UNION ALL SELECT 'CONTAINS', 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 1.0, 'ast', '' FROM supplier
    UNION ALL SELECT 'CALLS', 'customer:' || o_custkey, 'order:' || o_orderkey, 1.0, 'ast', '' FROM orders
    UNION ALL SELECT 'READS_FROM', 'order:' || l_orderkey, 'part:' || l_partkey, round(1 - l_discount, 2), CASE l_returnflag WHEN 'R' THEN 'heuristic' WHEN 'A' THEN 'compiler' ELSE 'ast' END,
      l_linenumber || ':' || l_suppkey || ':' || CAST(l_quantity AS BIGINT) || ':' || CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem
    UNION ALL SELECT DISTINCT 'DEPENDS_ON', 'part:' || l_partkey, 'supplier:' || l_suppkey, 1.0, 'schema', '' FROM lineitem) x)"""

DEFINITE_SQL = "confidence >= 0.95 AND source_type NOT IN ('heuristic', 'embedding', 'llm') AND type NOT IN ('CONTAINS', 'EXPORTS', 'BELONGS_TO_FEATURE', 'BELONGS_TO_DOMAIN', 'RENAMED_FROM', 'ROUTE_PREFIX')"
IMPACT_SQL = "type NOT IN ('CONTAINS', 'EXPORTS', 'BELONGS_TO_FEATURE', 'BELONGS_TO_DOMAIN', 'RENAMED_FROM', 'ROUTE_PREFIX')"


def handoffs(t: Tables) -> DataFrame:
    """User to next user, when another user's event follows within five seconds. Hours are ordered apart, each with the
    first seconds of the next, so no window holds all events."""
    e = t.events.select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    hour = F.floor(F.col("us") / 3_600_000_000)
    own = e.withColumn("h", hour).withColumn("own", F.lit(True))
    ahead = own.where(F.col("us") - F.col("h") * 3_600_000_000 < 5_000_000).withColumn("h", F.col("h") - 1).withColumn("own", F.lit(False))
    w = Window.partitionBy("h").orderBy("us", "event_id")
    nxt = own.unionByName(ahead).select("own", "event_id", "user_id", "us", F.lead("user_id").over(w).alias("next_user"), F.lead("us").over(w).alias("next_us"))
    kept = nxt.where("own AND next_user <> user_id AND next_us - us < 5000000")
    return kept.select(F.concat(F.lit("h"), "event_id").alias("id"), _id("user", "user_id").alias("source"), _id("user", "next_user").alias("target"), F.lit("CALLS").alias("type"), F.lit(1.0).alias("confidence"), F.lit("ast").alias("source_type"))


HANDOFFS_SQL = """handoffs AS (
  SELECT 'h' || event_id AS id, 'user:' || user_id AS source, 'user:' || next_user AS target, 'CALLS' AS type, 1.0::DOUBLE AS confidence, 'ast' AS source_type
  FROM (SELECT event_id, user_id, ts, lead(user_id) OVER w AS next_user, lead(ts) OVER w AS next_ts FROM events WINDOW w AS (ORDER BY ts, event_id)) x
  WHERE next_user <> user_id AND epoch_us(next_ts) - epoch_us(ts) < 5000000)"""


def file_links(t: Tables) -> DataFrame:
    """Links between component files: consecutive large items of an order."""
    item = t.lineitem.where("l_quantity >= 48").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    file = F.concat("p_brand", F.lit("/"), "p_type")
    pair = item.select("l_orderkey", "l_linenumber", file.alias("source_file"), F.lead(file).over(w).alias("target_file"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"))
    return pair.where("target_file IS NOT NULL AND target_file <> source_file").select("id", "source_file", "target_file", F.lit("IMPORTS").alias("type"), "confidence", F.col("l_linenumber").alias("line"))


FILE_LINKS_SQL = """file_links AS (
  SELECT id, source_file, target_file, 'IMPORTS' AS type, confidence, line FROM (
    SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, p_brand || '/' || p_type AS source_file,
           lead(p_brand || '/' || p_type) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target_file,
           round(1 - l_discount, 2) AS confidence, l_linenumber AS line
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 48) x
  WHERE target_file IS NOT NULL AND target_file <> source_file)"""


def file_graph(t: Tables) -> DataFrame:
    """The best link of each pair of files: highest confidence, then smallest id."""
    w = Window.partitionBy("source_file", "target_file").orderBy(F.desc("confidence"), "id")
    return file_links(t).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


FILE_GRAPH_SQL = (
    FILE_LINKS_SQL
    + """, file_graph AS (SELECT id, source_file, target_file, type, confidence, line FROM
  (SELECT *, row_number() OVER (PARTITION BY source_file, target_file ORDER BY confidence DESC, id) AS n FROM file_links) x WHERE n = 1)"""
)

GRAPH_SQL = NODES_SQL + ",\n" + EDGES_SQL
