"""Queries over stored tables: upserts, deletes, snapshots, generations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.fixtures import GRAPH_SQL, Tables
from tessera.operators import storage
from tessera.operators.lineage import shared_folder
from tessera.plans.base import query


def _old(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit("first").alias("created_at"))


def _new(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lower("o_orderstatus").alias("status"), (F.col("o_totalprice") + 1).alias("price"), F.lit("second").alias("created_at"))


_UP = "o AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, 'first' AS created_at FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS id, lower(o_orderstatus) AS status, o_totalprice + 1 AS price, 'second' AS created_at FROM orders WHERE o_orderkey % 2 = 0)"


@query("upsert", "A9 I9", f"WITH {_UP} SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.status ELSE n.status END AS status, CASE WHEN n.id IS NULL THEN o.price ELSE n.price END AS price, coalesce(o.created_at, n.created_at) AS created_at FROM o FULL JOIN n ON o.id = n.id")
def upsert(t: Tables) -> DataFrame:
    return storage.upsert(_old(t), _new(t), ["id"])


@query("insert_if_absent", "A10", f"WITH {_UP} SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def insert_if_absent(t: Tables) -> DataFrame:
    return storage.insert_if_absent(_old(t), _new(t), ["id"])


@query("delete_cascade", "A11", f"WITH {GRAPH_SQL}, g AS (SELECT 'part:' || p_partkey AS id FROM part WHERE p_size % 5 = 0) SELECT type, CAST(count(*) AS BIGINT) AS n FROM edges WHERE source NOT IN (SELECT id FROM g) AND target NOT IN (SELECT id FROM g) GROUP BY type UNION ALL SELECT kind, CAST(count(*) AS BIGINT) FROM nodes WHERE id NOT IN (SELECT id FROM g) GROUP BY kind")
def delete_cascade(t: Tables) -> DataFrame:
    gone = t.part.where("p_size % 5 = 0").select(F.concat(F.lit("part:"), "p_partkey").alias("id"))
    n, e = storage.delete_nodes(fx.nodes(t), fx.edges(t), gone)
    return e.groupBy("type").agg(F.count("*").alias("n")).union(n.groupBy("kind").agg(F.count("*").alias("n")))


@query("location_refresh", "A13", "SELECT sha256('READS_FROM:order:' || l_orderkey || ':part:' || l_partkey || ':' || l_returnflag || ':' || (l_linenumber + CASE l_returnflag WHEN 'R' THEN 5 WHEN 'A' THEN -1 ELSE 0 END)) AS id, CAST(l_linenumber + CASE l_returnflag WHEN 'R' THEN 5 WHEN 'A' THEN -1 ELSE 0 END AS INTEGER) AS line FROM lineitem")
def location_refresh(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.concat(F.lit("order:"), "l_orderkey").alias("source"), F.concat(F.lit("part:"), "l_partkey").alias("target"), F.lit("READS_FROM").alias("type"), F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("line"))
    shifts = t.spark.createDataFrame([("R", 5), ("A", -1)], "file string, shift int")
    return storage.moved_lines(e, shifts).select("id", "line")


@query("replace_all", "A12 A17", "SELECT r_regionkey, r_name FROM region")
def replace_all(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/replaced-{uuid.uuid4().hex}"
    storage.replace_all(t.region.limit(1), path)
    storage.replace_all(t.region, path)
    return storage.read_current(t.spark, path).select("r_regionkey", "r_name")


@query("snapshot_prune", "A16 W10", "SELECT CAST(event_id AS VARCHAR) AS id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS n FROM events WHERE event_type = 'purchase') x WHERE n <= 10 OR event_id = 1")
def snapshot_prune(t: Tables) -> DataFrame:
    s = t.events.where("event_type = 'purchase'").select(F.col("event_id").cast("string").alias("id"), F.col("ts").alias("created_at"))
    return storage.prune(s, 10, ("1",)).select("id")


@query("manifest_rescan", "A3", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'rescanned' ELSE 'stored' END AS origin FROM orders")
def manifest_rescan(t: Tables) -> DataFrame:
    """Stored rows stay, except for changed files, which are read again."""
    stored = t.orders.select(F.col("o_orderkey").alias("id"))
    changed = stored.where("id % 4 = 0")
    return stored.join(changed, "id", "left_anti").select("id", F.lit("stored").alias("origin")).unionByName(changed.select("id", F.lit("rescanned").alias("origin")))


@query("owning_package", "Q37", "WITH f AS (SELECT p_partkey, 'a/' || lower(replace(p_type, ' ', '/')) || '/x.ts' AS path FROM part), pk AS (SELECT DISTINCT 'a/' || lower(split_part(p_type, ' ', 1)) AS dir FROM part WHERE p_size > 25 UNION SELECT 'a'), c AS (SELECT p_partkey, dir, row_number() OVER (PARTITION BY p_partkey ORDER BY length(dir) DESC) AS n FROM f JOIN pk ON starts_with(path, dir || '/')) SELECT p_partkey, dir FROM c WHERE n = 1")
def owning_package(t: Tables) -> DataFrame:
    """The nearest package above each file: its directories meet the packages, the longest wins."""
    from tessera.functions.paths import directories

    f = t.part.select("p_partkey", F.concat(F.lit("a/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))), F.lit("/x.ts")).alias("path"))
    packages = t.part.where("p_size > 25").select(F.concat(F.lit("a/"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("dir")).union(t.spark.createDataFrame([("a",)], "dir string")).distinct()
    j = f.select("p_partkey", F.explode(directories(F.col("path"))).alias("dir")).join(packages, "dir")
    return j.groupBy("p_partkey").agg(F.max_by("dir", F.length("dir")).alias("dir"))


@query("rename_aliases", "Q39", "SELECT user_id, arg_max(event_type, event_id) AS alias FROM events GROUP BY user_id")
def rename_aliases(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("alias"))


@query("storage_sizes", "Q23 G23", "SELECT lang, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY lang ORDER BY bytes DESC, lang LIMIT 8")
def storage_sizes(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("bytes"), "lang").limit(8)
