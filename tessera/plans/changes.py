"""Snapshot differences, change classes, renames and invalidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.fixtures import FILE_LINKS_SQL, Tables
from tessera.operators import diff
from tessera.plans.base import query


def _snapshots(t: Tables) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    o, p = t.orders, t.part
    row = lambda df, k, h: df.select(F.concat(F.lit(""), F.col(k)).alias("id"), F.col(h).cast("string").alias("hash"))
    old = {"entrypoints": row(o.where("o_orderkey % 5 <> 0"), "o_orderkey", "o_orderstatus"), "symbols": row(p.where("p_size < 45"), "p_partkey", "p_size")}
    new = {"entrypoints": row(o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))), "o_orderkey", "o_orderstatus"), "symbols": row(p.where("p_size > 5"), "p_partkey", "p_size")}
    return old, new


_OLD_NEW = "oe AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS h FROM orders WHERE o_orderkey % 5 <> 0), ne AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 7 <> 0), os AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS VARCHAR) AS h FROM part WHERE p_size < 45), ns AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS VARCHAR) AS h FROM part WHERE p_size > 5)"


@query("snapshot_diff", "U5 U2 Q14 Q27", f"WITH {_OLD_NEW} SELECT * FROM (SELECT 'entrypoints' AS section, coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' END AS status FROM oe o FULL JOIN ne n ON o.id = n.id UNION ALL SELECT 'symbols', coalesce(n.id, o.id), CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' END FROM os o FULL JOIN ns n ON o.id = n.id) x WHERE status IS NOT NULL")
def snapshot_diff(t: Tables) -> DataFrame:
    return diff.sections(*_snapshots(t))


@query("moved_symbols", "J12 U3", "WITH o AS (SELECT 'a' || p_partkey AS id, p_name AS name, p_size AS kind, p_brand AS file FROM part WHERE p_partkey % 2 = 0), n AS (SELECT 'b' || p_partkey AS id, p_name AS name, p_size AS kind, p_type AS file FROM part WHERE p_partkey % 3 = 0), a AS (SELECT *, row_number() OVER (PARTITION BY name, kind ORDER BY id) AS r FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY name, kind ORDER BY id) AS r FROM n) SELECT a.id AS old_id, b.id AS new_id FROM a JOIN b ON a.name = b.name AND a.kind = b.kind AND a.r = b.r WHERE a.file <> b.file")
def moved_symbols(t: Tables) -> DataFrame:
    pick = lambda df, p, f: df.select(F.concat(F.lit(p), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("kind"), F.col(f).alias("file"))
    return diff.moved(pick(t.part.where("p_partkey % 2 = 0"), "a", "p_brand"), pick(t.part.where("p_partkey % 3 = 0"), "b", "p_type"), ["name", "kind"]).select("old_id", "new_id")


_MANIFESTS = "o AS (SELECT 'f' || doc_id AS path, md5(text) AS hash FROM documents WHERE doc_id % 4 <> 0), n AS (SELECT CASE WHEN doc_id % 10 = 1 THEN 'g' ELSE 'f' END || doc_id AS path, md5(CASE WHEN doc_id % 9 = 0 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 6 <> 0)"


@query("file_changes", "U6 I4", f"""WITH {_MANIFESTS}, j AS (SELECT o.path AS op, n.path AS np, o.hash AS oh, n.hash AS nh, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'modified' END AS kind FROM o FULL JOIN n ON o.path = n.path),
 g AS (SELECT oh AS h, min(op) AS previous FROM j WHERE kind = 'deleted' GROUP BY oh HAVING count(*) = 1), c AS (SELECT nh AS h, min(np) AS path FROM j WHERE kind = 'added' GROUP BY nh HAVING count(*) = 1), r AS (SELECT path, previous FROM g JOIN c USING (h))
 SELECT coalesce(np, op) AS path, CAST(NULL AS VARCHAR) AS previous, kind FROM j WHERE kind IS NOT NULL AND coalesce(np, op) NOT IN (SELECT path FROM r) AND coalesce(np, op) NOT IN (SELECT previous FROM r) UNION ALL SELECT path, previous, 'renamed' FROM r""")
def file_changes(t: Tables) -> DataFrame:
    d = t.documents
    old = d.where("doc_id % 4 <> 0").select(F.concat(F.lit("f"), "doc_id").alias("path"), F.md5("text").alias("hash"))
    new = d.where("doc_id % 6 <> 0").select(F.concat(F.when(F.col("doc_id") % 10 == 1, "g").otherwise("f"), "doc_id").alias("path"), F.md5(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("hash"))
    return diff.file_changes(old, new)


@query("best_changes", "U7", "SELECT event_type AS kind, CAST(user_id % 50 AS BIGINT) AS previous, CAST(event_id % 20 AS BIGINT) AS path, max(value) AS similarity FROM events GROUP BY ALL")
def best_changes(t: Tables) -> DataFrame:
    return diff.best_change(t.events.select(F.col("event_type").alias("kind"), (F.col("user_id") % 50).alias("previous"), (F.col("event_id") % 20).alias("path"), F.col("value").alias("similarity")))


@query("renamed_ids", "J15", "WITH o AS (SELECT p_name AS name, p_brand AS kind, min('old' || p_partkey) AS id FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL) SELECT coalesce(o.id, 'new' || n.p_partkey) AS id FROM part n LEFT JOIN o ON o.name = n.p_name AND o.kind = n.p_brand WHERE n.p_partkey % 3 = 0")
def renamed_ids(t: Tables) -> DataFrame:
    old = t.part.where("p_partkey % 2 = 0").groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("kind")).agg(F.min(F.concat(F.lit("old"), "p_partkey")).alias("id"))
    new = t.part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.concat(F.lit("new"), "p_partkey").alias("id"))
    return diff.renamed_ids(old, new, ["name", "kind"]).select("id")


@query("rename_chains", "J16", """WITH RECURSIVE e AS (SELECT event_id AS previous, event_id + 7 AS path FROM events WHERE value >= 50 AND event_id % 3 <> 0), r AS (SELECT previous, path FROM e UNION ALL SELECT r.previous, e.path FROM r JOIN e ON r.path = e.previous)
 SELECT CAST(previous AS VARCHAR) AS previous, CAST(max(path) AS VARCHAR) AS path FROM r WHERE path - previous <= 77 GROUP BY previous""")
def rename_chains(t: Tables) -> DataFrame:
    e = t.events.where("value >= 50 AND event_id % 3 <> 0").select(F.col("event_id").cast("string").alias("previous"), (F.col("event_id") + 7).cast("string").alias("path"), F.lit(0.9).alias("similarity"))
    return diff.rename_chains(e)


@query("semantic_delta", "I5", "WITH o AS (SELECT p_partkey, md5(p_name) AS e, md5(p_brand) AS i, md5(CAST(p_size AS VARCHAR)) AS b FROM part), n AS (SELECT p_partkey, md5(CASE WHEN p_partkey % 17 = 0 THEN 'x' ELSE p_name END) AS e, md5(CASE WHEN p_partkey % 5 = 0 THEN 'y' ELSE p_brand END) AS i, md5(CAST(p_size + p_partkey % 2 AS VARCHAR)) AS b FROM part) SELECT CASE WHEN o.e <> n.e THEN 'exports' WHEN o.i <> n.i THEN 'imports' WHEN o.b <> n.b THEN 'body' ELSE 'unchanged' END AS delta, CAST(count(*) AS BIGINT) AS n FROM o JOIN n USING (p_partkey) GROUP BY ALL")
def semantic_delta(t: Tables) -> DataFrame:
    p = t.part
    o = p.select("p_partkey", F.md5("p_name").alias("oe"), F.md5("p_brand").alias("oi"), F.md5(F.col("p_size").cast("string")).alias("ob"))
    n = p.select("p_partkey", F.md5(F.when(F.col("p_partkey") % 17 == 0, "x").otherwise(F.col("p_name"))).alias("ne"), F.md5(F.when(F.col("p_partkey") % 5 == 0, "y").otherwise(F.col("p_brand"))).alias("ni"), F.md5((F.col("p_size") + F.col("p_partkey") % 2).cast("string")).alias("nb"))
    kind = diff.delta_class({k: (F.col(f"o{c}"), F.col(f"n{c}")) for k, c in (("exports", "e"), ("imports", "i"), ("body", "b"))})
    return o.join(n, "p_partkey").groupBy(kind.alias("delta")).agg(F.count("*").alias("n"))


@query("invalidation_set", "I6 I7 J2 J3 Q36", f"WITH {FILE_LINKS_SQL}, c AS (SELECT DISTINCT p_brand || '/' || p_type AS file, p_name AS name FROM part WHERE p_partkey % 97 = 0), u AS (SELECT p_brand || '/' || p_type AS file, p_name AS name FROM part WHERE p_partkey % 5 = 0) SELECT file FROM c UNION SELECT source_file FROM file_links WHERE target_file IN (SELECT file FROM c) UNION SELECT file FROM u WHERE name IN (SELECT name FROM c)")
def invalidation_set(t: Tables) -> DataFrame:
    file = F.concat("p_brand", F.lit("/"), "p_type").alias("file")
    changed = t.part.where("p_partkey % 97 = 0").select(file, F.col("p_name").alias("name")).distinct()
    unresolved = t.part.where("p_partkey % 5 = 0").select(file, F.col("p_name").alias("name"))
    everything = t.part.select(file).distinct()
    return diff.invalidated(changed, fx.file_links(t), unresolved, everything, False)[0]


@query("unresolved_importers", "I7 R2", "WITH s AS (SELECT DISTINCT sha256(lower(p_name)) AS h, p_brand AS file FROM part WHERE p_size < 5), i AS (SELECT event_id, sha256(lower(p_name)) AS h FROM events JOIN part ON p_partkey = event_id % 3000) SELECT file, CAST(count(*) AS BIGINT) AS n FROM i JOIN s USING (h) GROUP BY file")
def unresolved_importers(t: Tables) -> DataFrame:
    """Imports that failed, found again by the hash of what they asked for."""
    h = F.sha2(F.lower("p_name"), 256).alias("h")
    s = t.part.where("p_size < 5").select(h, F.col("p_brand").alias("file")).distinct()
    i = t.events.select((F.col("event_id") % 3000).alias("k")).join(t.part, F.col("k") == F.col("p_partkey")).select(h)
    return i.join(s, "h").groupBy("file").agg(F.count("*").alias("n"))


@query("changed_symbols", "V5 P10", "SELECT l_partkey, CAST(count(*) AS BIGINT) AS touched FROM lineitem JOIN (SELECT o_orderkey, CAST(o_orderkey % 40 AS BIGINT) AS a, CAST(o_orderkey % 40 + 5 AS BIGINT) AS b FROM orders WHERE o_orderstatus = 'P') h ON l_orderkey = o_orderkey AND CAST(l_quantity AS BIGINT) <= b AND CAST(l_quantity AS BIGINT) + l_linenumber >= a GROUP BY l_partkey")
def changed_symbols(t: Tables) -> DataFrame:
    h = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_orderkey") % 40).alias("a"), (F.col("o_orderkey") % 40 + 5).alias("b"))
    s = t.lineitem.select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("s"), (F.col("l_quantity").cast("long") + F.col("l_linenumber")).alias("e"))
    return s.join(h, F.col("l_orderkey") == F.col("o_orderkey")).where("s <= b AND e >= a").groupBy("l_partkey").agg(F.count("*").alias("touched"))

