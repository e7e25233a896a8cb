"""Scans, projections, filters, joins, aggregates, windows, pages and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.fixtures import DEFINITE_SQL, EDGES_SQL, FILE_LINKS_SQL, GRAPH_SQL, IMPACT_SQL, NODES_SQL, Tables
from tessera.functions import paths, text
from tessera.model import SEARCHABLE, definite, impact_edge, potential, provenance
from tessera.operators import pages
from tessera.plans.base import query

E, N = f"WITH {EDGES_SQL}", f"WITH {NODES_SQL}"


@query("table_scan_ordered", "A4", "SELECT p_partkey, p_name, p_brand FROM part ORDER BY p_partkey LIMIT 100")
def table_scan_ordered(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", "p_brand").orderBy("p_partkey").limit(100)


@query("section_page", "A7 Q13", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def section_page(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").offset(100).limit(50)


@query("point_lookup", "A8 J11", f"{N}, w AS (SELECT unnest(['supplier:3', 'part:9', 'nowhere', 'order:1', 'supplier:1']) AS id, unnest([0, 1, 2, 3, 4]) AS pos) SELECT pos, w.id, kind, name FROM w JOIN nodes USING (id)")
def point_lookup(t: Tables) -> DataFrame:
    ids = ["supplier:3", "part:9", "nowhere", "order:1", "supplier:1"]
    return pages.lookup(fx.nodes(t), ids).select("pos", "id", "kind", "name").orderBy("pos")


@query("edge_projection", "P1 P3 P4", f"{E} SELECT id, source, target FROM edges WHERE type IN ('CALLS', 'DEPENDS_ON') AND confidence >= 0.5 ORDER BY id LIMIT 200")
def edge_projection(t: Tables) -> DataFrame:
    return fx.edges(t).where("type IN ('CALLS', 'DEPENDS_ON') AND confidence >= 0.5").select("id", "source", "target").orderBy("id").limit(200)


@query("certainty_classes", "P5 P12", f"{E} SELECT type, CASE WHEN {DEFINITE_SQL} THEN 'definite' WHEN {IMPACT_SQL} THEN 'potential' ELSE 'none' END AS certainty, CASE source_type WHEN 'heuristic' THEN 'inferred' WHEN 'documentation' THEN 'documentation' WHEN 'git' THEN 'git' ELSE 'verified' END AS provenance, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY ALL")
def certainty_classes(t: Tables) -> DataFrame:
    c = F.when(definite(), "definite").when(potential(), "potential").otherwise("none")
    return fx.edges(t).groupBy("type", c.alias("certainty"), provenance().alias("provenance")).agg(F.count("*").alias("n"))


@query("kind_filter_and_rename", "P4 P13", f"{N} SELECT CASE kind WHEN 'endpoint' THEN 'api_route' ELSE kind END AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count(file) AS BIGINT) AS n_files FROM nodes WHERE kind IN {SEARCHABLE} GROUP BY ALL")
def kind_filter_and_rename(t: Tables) -> DataFrame:
    kind = F.when(F.col("kind") == "endpoint", "api_route").otherwise(F.col("kind"))
    return fx.nodes(t).where(F.col("kind").isin(*SEARCHABLE)).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count("file").alias("n_files"))


_URLS = "p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+/?', '') AS path FROM pages)"
_PATHS_SQL = "f AS (SELECT 'src/' || lower(replace(p_type, ' ', '/')) || '/' || lower(replace(p_brand, '#', '_')) || CASE p_size % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.test.ts' WHEN 2 THEN '.py' WHEN 3 THEN '.md' WHEN 4 THEN '.yaml' ELSE '.go' END AS path, p_partkey, p_size FROM part), g AS (SELECT CASE p_size % 7 WHEN 0 THEN 'docs/' WHEN 1 THEN 'tests/fixtures/' WHEN 2 THEN 'examples/' WHEN 3 THEN 'scripts/' WHEN 4 THEN 'vendor/' ELSE '' END || path AS path, p_partkey FROM f)"


def _paths(t: Tables) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".ts", ".test.ts", ".py", ".md", ".yaml", ".go")]), (F.col("p_size") % 6 + 1).cast("int"))
    top = F.element_at(F.array(*[F.lit(x) for x in ("docs/", "tests/fixtures/", "examples/", "scripts/", "vendor/", "", "")]), (F.col("p_size") % 7 + 1).cast("int"))
    path = F.concat(top, F.lit("src/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), ext)
    return t.part.select("p_partkey", path.alias("path"))


@query("scope_classes", "P6 P7", f"""WITH {_PATHS_SQL}, c AS (SELECT path, CASE WHEN regexp_matches(path, '(^|/)(tests?|__tests__)/fixtures?(/|$)') OR regexp_matches(path, '(^|/)(fixtures?|__fixtures__)(/|$)') THEN 'fixture'
 WHEN regexp_matches(path, '(^|/)(examples?|samples?|demos?)(/|$)') THEN 'example' WHEN regexp_matches(path, '(^|/)(tests?|__tests__|specs?)(/|$)') OR regexp_matches(path, '\\.(spec|test|spec-d|test-d)\\.[^/]+$') THEN 'test'
 WHEN regexp_matches(path, '(^|/)(dist|build|coverage|generated|__generated__|vendor|node_modules)(/|$)') THEN 'generated' WHEN regexp_matches(path, '(^|/)(docs?|documentation)(/|$)') OR regexp_matches(path, '\\.(md|mdx|rst|adoc)$') THEN 'documentation'
 WHEN regexp_matches(path, '(^|/)(scripts?|tools?)(/|$)') THEN 'tooling' WHEN regexp_matches(path, '\\.(json|jsonc|yaml|yml|toml)$') THEN 'configuration' ELSE 'production' END AS scope FROM g)
 SELECT scope, scope IN ('production', 'configuration') AS is_primary, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ALL""")
def scope_classes(t: Tables) -> DataFrame:
    s = paths.scope(F.col("path"))
    return _paths(t).groupBy(s.alias("scope"), paths.is_primary(s).alias("is_primary")).agg(F.count("*").alias("n"))


@query("languages", "P17 Q24", f"WITH {_PATHS_SQL} SELECT CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.yaml' THEN 'yaml' WHEN path LIKE '%.go' THEN 'go' END AS language, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY ALL")
def languages(t: Tables) -> DataFrame:
    return _paths(t).groupBy(paths.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query("ignored_paths", "A1 A2", f"WITH {_PATHS_SQL} SELECT regexp_matches(path, '(^|/)(vendor|dist|build|node_modules)/') AS ignored, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY ALL")
def ignored_paths(t: Tables) -> DataFrame:
    return _paths(t).groupBy(paths.ignored(F.col("path")).alias("ignored")).agg(F.count("*").alias("n"))


@query("glob_match", "P9 J14", f"WITH {_PATHS_SQL} SELECT CAST(count(*) AS BIGINT) AS n FROM g WHERE regexp_matches(path, '^(.*/)?src/[^/]+/.*\\.ts$') AND NOT regexp_matches(path, '^docs/.*$')")
def glob_match(t: Tables) -> DataFrame:
    return _paths(t).where(paths.glob_filter(F.col("path"), include=["**/src/*/**.ts"], exclude=["docs/**"])).agg(F.count("*").alias("n"))


@query("line_range_overlap", "P10 V5 J14", "WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + l_linenumber AS e FROM lineitem), h AS (SELECT l_orderkey, min(CAST(l_quantity AS BIGINT)) AS hs, min(CAST(l_quantity AS BIGINT)) + 5 AS he FROM lineitem GROUP BY l_orderkey) SELECT a.l_orderkey, CAST(count(*) AS BIGINT) AS touched FROM a JOIN h ON a.l_orderkey = h.l_orderkey AND s <= he AND e >= hs GROUP BY ALL")
def line_range_overlap(t: Tables) -> DataFrame:
    """Symbols (line ranges in a file) that a change (a range of the same file) touches."""
    a = t.lineitem.select("l_orderkey", F.col("l_quantity").cast("long").alias("s"), (F.col("l_quantity").cast("long") + F.col("l_linenumber")).alias("e"))
    h = t.lineitem.groupBy("l_orderkey").agg(F.min(F.col("l_quantity").cast("long")).alias("hs")).withColumn("he", F.col("hs") + 5)
    return a.join(h, "l_orderkey").where("s <= he AND e >= hs").groupBy("l_orderkey").agg(F.count("*").alias("touched"))


@query("evidence_reasons", "P11 V2", "SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN l_linenumber < 1 THEN 'range' WHEN o_orderkey IS NULL THEN 'file' WHEN l_linestatus <> o_orderstatus THEN 'hash' ELSE 'valid' END AS reason FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) o ON l_orderkey = o_orderkey) x GROUP BY ALL")
def evidence_reasons(t: Tables) -> DataFrame:
    """The first check that a piece of evidence fails: its range, a known file, the file's hash."""
    known = t.orders.where("o_orderkey % 7 <> 0")
    j = t.lineitem.join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    reason = F.when(F.col("l_linenumber") < 1, "range").when(F.col("o_orderkey").isNull(), "file").when(F.col("l_linestatus") != F.col("o_orderstatus"), "hash").otherwise("valid")
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("stable_ids", "P14 I3", "SELECT p_partkey, sha256('repo:database_model:' || p_brand || ':' || p_name) AS node_id FROM part")
def stable_ids(t: Tables) -> DataFrame:
    from tessera.model import node_id

    return t.part.select("p_partkey", node_id(F.lit("repo"), F.lit("database_model"), F.col("p_brand"), F.col("p_name")).alias("node_id"))


@query("repository_fingerprint", "P14 I3", "SELECT p_brand, sha256(string_agg(p_name || ':' || p_partkey, chr(10) ORDER BY p_name || ':' || p_partkey)) AS fingerprint FROM part GROUP BY p_brand")
def repository_fingerprint(t: Tables) -> DataFrame:
    from tessera.model import sorted_hash

    return t.part.groupBy("p_brand").agg(sorted_hash(F.concat_ws(":", "p_name", "p_partkey")).alias("fingerprint"))


_TASK = "lower(text)"


@query("intent_routing", "P15 P16", """SELECT route, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN regexp_matches(text, '(?i)\\b(document|documentation|readme|guide|adr)\\b') THEN 'documentation' WHEN regexp_matches(text, '(?i)\\b(refactor|rename|extract|move|split|simplif)\\b') THEN 'refactoring' WHEN regexp_matches(text, '(?i)\\b(bug|broken|crash|error|fail|fix|incorrect|regression)\\b') THEN 'bug_fix'
 WHEN regexp_matches(text, '(?i)\\b(architecture|flow|explain|overview|onboard)\\b') THEN 'architecture' WHEN regexp_matches(text, '(?i)\\b(add|change|create|implement|introduce|support|update)\\b') THEN 'feature' WHEN regexp_matches(text, '(?i)\\b(tests?|specs?|fixtures?|coverage)\\b') THEN 'test_change' ELSE 'unknown' END AS route FROM conversations) x GROUP BY ALL""")
def intent_routing(t: Tables) -> DataFrame:
    return t.conversations.groupBy(text.task_class(F.col("text")).alias("route")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------------------------------------- joins


@query("cross_file_edges", "J1", f"WITH {GRAPH_SQL} SELECT s.file AS source_file, g.file AS target_file, e.type, CAST(count(*) AS BIGINT) AS n FROM edges e JOIN nodes s ON e.source = s.id JOIN nodes g ON e.target = g.id WHERE s.file <> g.file AND e.type NOT IN ('CONTAINS', 'BELONGS_TO_DOMAIN') GROUP BY ALL")
def cross_file_edges(t: Tables) -> DataFrame:
    n = fx.nodes(t).select("id", "file")
    j = fx.edges(t).where(impact_edge()).join(n.select(F.col("id").alias("source"), F.col("file").alias("source_file")), "source").join(n.select(F.col("id").alias("target"), F.col("file").alias("target_file")), "target")
    return j.where("source_file <> target_file").groupBy("source_file", "target_file", "type").agg(F.count("*").alias("n"))


@query("importers_of_files", "J2 J3 Q35", f"WITH {FILE_LINKS_SQL} SELECT DISTINCT source_file FROM file_links WHERE target_file IN (SELECT DISTINCT p_brand || '/' || p_type FROM part WHERE p_size > 48)")
def importers_of_files(t: Tables) -> DataFrame:
    changed = t.part.where("p_size > 48").select(F.concat("p_brand", F.lit("/"), "p_type").alias("target_file"))
    return fx.file_links(t).join(changed, "target_file", "left_semi").select("source_file").distinct()


@query("consumers_of_symbols", "J3 J7 Q36", f"{E} SELECT source, CAST(count(DISTINCT target) AS BIGINT) AS n FROM edges WHERE type = 'READS_FROM' AND target IN (SELECT 'part:' || p_partkey FROM part WHERE p_size = 3) GROUP BY source")
def consumers_of_symbols(t: Tables) -> DataFrame:
    symbols = t.part.where("p_size = 3").select(F.concat(F.lit("part:"), "p_partkey").alias("target"))
    return fx.edges(t).where("type = 'READS_FROM'").join(symbols, "target", "left_semi").groupBy("source").agg(F.count_distinct("target").alias("n"))


@query("entrypoints_with_metrics", "J5", "SELECT o_orderkey, coalesce(n, 0) AS n_items FROM orders LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey) m ON o_orderkey = l_orderkey")
def entrypoints_with_metrics(t: Tables) -> DataFrame:
    m = t.lineitem.where("l_quantity > 45").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return t.orders.join(m, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_items"))


@query("registration_chain", "J6", f"WITH {GRAPH_SQL} SELECT a.source AS plugin, n.name AS via, CAST(count(*) AS BIGINT) AS mounts FROM edges a JOIN nodes n ON a.target = n.id JOIN edges b ON b.source = n.id WHERE a.type = 'READS_FROM' AND b.type = 'DEPENDS_ON' AND a.confidence = 1 GROUP BY ALL")
def registration_chain(t: Tables) -> DataFrame:
    e = fx.edges(t)
    a = e.where("type = 'READS_FROM' AND confidence = 1").select(F.col("source").alias("plugin"), F.col("target").alias("id"))
    b = e.where("type = 'DEPENDS_ON'").select(F.col("source").alias("id"))
    return a.join(fx.nodes(t).select("id", F.col("name").alias("via")), "id").join(b, "id").groupBy("plugin", "via").agg(F.count("*").alias("mounts"))


@query("contract_drift", "J8 J9 X5", "WITH c AS (SELECT DISTINCT o_orderstatus AS method, CAST(o_orderkey % 1000 AS BIGINT) AS path FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT DISTINCT l_linestatus AS method, CAST(l_orderkey % 1000 AS BIGINT) AS path FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT 'implemented' AS state, method, CAST(count(*) AS BIGINT) AS n FROM c JOIN r USING (method, path) GROUP BY ALL UNION ALL SELECT 'missing route', method, CAST(count(*) AS BIGINT) FROM c ANTI JOIN r USING (method, path) GROUP BY ALL UNION ALL SELECT 'undocumented route', method, CAST(count(*) AS BIGINT) FROM r ANTI JOIN c USING (method, path) GROUP BY ALL")
def contract_drift(t: Tables) -> DataFrame:
    """Contracts against routes by method and path: what matches, and what either side lacks."""
    c = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderstatus").alias("method"), (F.col("o_orderkey") % 1000).alias("path")).distinct()
    r = t.lineitem.where("l_orderkey % 5 <> 0").select(F.col("l_linestatus").alias("method"), (F.col("l_orderkey") % 1000).alias("path")).distinct()
    parts = (("implemented", c.join(r, ["method", "path"])), ("missing route", c.join(r, ["method", "path"], "left_anti")), ("undocumented route", r.join(c, ["method", "path"], "left_anti")))
    out = None
    for state, df in parts:
        got = df.groupBy("method").agg(F.count("*").alias("n")).select(F.lit(state).alias("state"), "method", "n")
        out = got if out is None else out.unionByName(got)
    return out


@query("unique_name_resolution", "J10 T14 R3", "WITH s AS (SELECT p_name AS name, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY p_name), q AS (SELECT event_id, CAST(event_id % 4000 AS BIGINT) AS k FROM events), r AS (SELECT q.event_id, p.p_name AS wanted FROM q LEFT JOIN part p ON p.p_partkey = q.k) SELECT CASE WHEN wanted IS NULL THEN 'missing' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CAST(count(*) AS BIGINT) AS n_refs, CAST(coalesce(sum(CASE WHEN n = 1 THEN id END), 0) AS BIGINT) AS id_sum FROM r LEFT JOIN s ON s.name = r.wanted GROUP BY ALL")
def unique_name_resolution(t: Tables) -> DataFrame:
    """A lookup that resolves only where the name is unique; the rest stays as data."""
    s = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.count("*").alias("n"))
    r = t.events.select("event_id", (F.col("event_id") % 4000).alias("k")).join(t.part, F.col("k") == F.col("p_partkey"), "left").select("event_id", F.col("p_name").alias("wanted"))
    status = F.when(F.col("wanted").isNull(), "missing").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return r.join(s, F.col("wanted") == F.col("name"), "left").groupBy(status.alias("status")).agg(F.count("*").alias("n_refs"), F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("id"))), F.lit(0)).cast("long").alias("id_sum"))


@query("paths_touching_set", "J13", f"{E}, p AS (SELECT a.source, a.target AS mid, b.target FROM edges a JOIN edges b ON a.target = b.source WHERE a.type = 'READS_FROM' AND b.type = 'DEPENDS_ON') SELECT source, CAST(count(*) AS BIGINT) AS n FROM p WHERE mid IN (SELECT 'part:' || p_partkey FROM part WHERE p_size = 10) OR target IN ('supplier:1', 'supplier:2') GROUP BY source")
def paths_touching_set(t: Tables) -> DataFrame:
    e = fx.edges(t)
    p = e.where("type = 'READS_FROM'").select("source", F.col("target").alias("mid")).join(e.where("type = 'DEPENDS_ON'").select(F.col("source").alias("mid"), F.col("target").alias("last")), "mid")
    p = p.withColumn("path", F.array("mid", "last"))
    wanted = t.part.where("p_size = 10").select(F.concat(F.lit("part:"), "p_partkey").alias("w"), F.lit(True).alias("hit"))
    hit = p.join(wanted, F.col("mid") == F.col("w"), "left").where(F.coalesce("hit", F.lit(False)) | F.arrays_overlap("path", F.array(F.lit("supplier:1"), F.lit("supplier:2"))))
    return hit.groupBy("source").agg(F.count("*").alias("n"))


# -------------------------------------------------------------------------------------------------------- aggregates


@query("counts_by_group", "G1 G3 Q21 Q25", f"WITH {GRAPH_SQL} SELECT kind, domain, CAST(count(*) AS BIGINT) AS n, min(name) AS first_name, max(name) AS last_name FROM nodes GROUP BY ALL")
def counts_by_group(t: Tables) -> DataFrame:
    return fx.nodes(t).groupBy("kind", "domain").agg(F.count("*").alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query("status_counts", "G2 G17 Q19", f"WITH {GRAPH_SQL} SELECT (SELECT CAST(count(*) AS BIGINT) FROM nodes) AS n_nodes, (SELECT CAST(count(DISTINCT file) AS BIGINT) FROM nodes) AS n_files, CAST(count(*) AS BIGINT) AS n_edges, CAST(count(DISTINCT type) AS BIGINT) AS n_types, CAST(count(*) FILTER ({DEFINITE_SQL}) AS BIGINT) AS n_definite, CAST(count(*) FILTER (source_type = 'heuristic') AS BIGINT) AS n_inferred FROM edges")
def status_counts(t: Tables) -> DataFrame:
    n = fx.nodes(t).agg(F.count("*").alias("n_nodes"), F.count_distinct("file").alias("n_files"))
    e = fx.edges(t).agg(F.count("*").alias("n_edges"), F.count_distinct("type").alias("n_types"), F.count_if(definite()).alias("n_definite"), F.count_if(F.col("source_type") == "heuristic").alias("n_inferred"))
    return n.join(e)  # one row each


@query("distinct_json_values", "G4 F2", "SELECT DISTINCT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def distinct_json_values(t: Tables) -> DataFrame:
    return t.events.select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).distinct()


@query("json_build_and_read", "F2", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_build_and_read(t: Tables) -> DataFrame:
    packed = t.events.select(F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))).alias("j"))
    return packed.select(F.from_json("j", "event_type string, k long").alias("r")).groupBy("r.event_type").agg(F.sum("r.k").alias("total"))


# ----------------------------------------------------------------------------------------------------------- windows


@query("top_edges_per_source", "W1 W3", f"{E}, r AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY CASE type WHEN 'HANDLES' THEN 0 WHEN 'CALLS' THEN 1 WHEN 'DEPENDS_ON' THEN 2 WHEN 'IMPORTS' THEN 3 WHEN 'READS_FROM' THEN 4 ELSE 100 END, confidence DESC, target, id) AS n FROM edges) SELECT source, id, CAST(n AS INTEGER) AS n FROM r WHERE n <= 3")
def top_edges_per_source(t: Tables) -> DataFrame:
    order = F.when(F.col("type") == "HANDLES", 0).when(F.col("type") == "CALLS", 1).when(F.col("type") == "DEPENDS_ON", 2).when(F.col("type") == "IMPORTS", 3).when(F.col("type") == "READS_FROM", 4).otherwise(100)
    w = Window.partitionBy("source").orderBy(order, F.desc("confidence"), "target", "id")
    return fx.edges(t).select("source", "id", F.row_number().over(w).alias("n")).where("n <= 3")


@query("quota_per_kind", "W2 U1", f"{N}, r AS (SELECT kind, id, name, row_number() OVER (PARTITION BY kind ORDER BY name, id) AS n FROM nodes) SELECT kind, id, CAST(n AS INTEGER) AS n FROM r WHERE n <= CASE kind WHEN 'service' THEN 20 WHEN 'endpoint' THEN 10 ELSE 5 END")
def quota_per_kind(t: Tables) -> DataFrame:
    w = Window.partitionBy("kind").orderBy("name", "id")
    quota = F.when(F.col("kind") == "service", 20).when(F.col("kind") == "endpoint", 10).otherwise(5)
    return fx.nodes(t).withColumn("n", F.row_number().over(w)).where(F.col("n") <= quota).select("kind", "id", "n").orderBy("n", "kind")


@query("top_k_tie_break", "W4", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k_tie_break(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("diversified_top_k", "W5 W6", "WITH c AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS in_file FROM part), r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN in_file = 1 THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) AS n FROM c) SELECT p_partkey, p_brand, CAST(n AS INTEGER) AS n FROM r WHERE n <= 40")
def diversified_top_k(t: Tables) -> DataFrame:
    return pages.diversified(t.part.select("p_partkey", "p_brand", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 40).select("p_partkey", "p_brand", "n")


@query("page_by_bytes", "W8", "WITH r AS (SELECT doc_id, octet_length(encode(text)) AS bytes, row_number() OVER (ORDER BY doc_id) AS n, sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents WHERE doc_id < 5000) SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, CAST(running AS BIGINT) AS running FROM r WHERE n <= 200 AND running <= 100000")
def page_by_bytes(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return pages.byte_page(docs, [F.asc("doc_id")], "bytes", rows=200, limit=100_000).select("doc_id", "bytes", "running")


@query("retention", "W10 A16", "WITH s AS (SELECT event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n, event_type FROM events) SELECT event_type, event_id, n <= 5 AS newest FROM s WHERE n <= 5 OR event_id % 1000 = 0")
def retention(t: Tables) -> DataFrame:
    """The newest five of each group stay, and whatever is pinned."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id")
    return t.events.withColumn("n", F.row_number().over(w)).where("n <= 5 OR event_id % 1000 = 0").select("event_type", "event_id", (F.col("n") <= 5).alias("newest"))


# -------------------------------------------------------------------------------------------------------------- sets


@query("set_differences", "U1 U2 U3 U8", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 40) SELECT 'added' AS what, CAST(count(*) AS BIGINT) AS n FROM (SELECT k FROM b EXCEPT SELECT k FROM a) x UNION ALL SELECT 'removed', CAST(count(*) AS BIGINT) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) x UNION ALL SELECT 'both', CAST(count(*) AS BIGINT) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) x")
def set_differences(t: Tables) -> DataFrame:
    a = t.lineitem.where("l_returnflag = 'R'").select("l_partkey").distinct()
    b = t.lineitem.where("l_quantity > 40").select("l_partkey").distinct()
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(b.join(a, "l_partkey", "left_anti"), "added").union(count(a.join(b, "l_partkey", "left_anti"), "removed")).union(count(a.join(b, "l_partkey", "left_semi"), "both"))


@query("scalar_functions", "F1 F3 F6 F9 F10", "SELECT p_partkey, lower(p_name) AS l, CAST(length(p_type) - length(replace(p_type, ' ', '')) AS INTEGER) AS depth, CAST(instr(p_name, 'e') AS INTEGER) AS at, round(log2(p_size + 1), 6) AS lg, CAST(ceil(sqrt(p_size)) AS BIGINT) AS root, least(p_size, 25) AS low, array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), ',') AS words, regexp_replace('/' || replace(p_brand, '#', '//') || '/', '/+', '/', 'g') AS route FROM part")
def scalar_functions(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.lower("p_name").alias("l"), (F.length("p_type") - F.length(F.replace("p_type", F.lit(" "), F.lit("")))).alias("depth"), F.instr("p_name", "e").alias("at"), F.round(F.log2(F.col("p_size") + 1), 6).alias("lg"), F.ceil(F.sqrt("p_size")).alias("root"),
        F.least("p_size", F.lit(25)).alias("low"), F.array_join(F.sort_array(F.array_distinct(F.split("p_type", " "))), ",").alias("words"), paths.joined_route(F.lit(""), F.replace("p_brand", F.lit("#"), F.lit("//"))).alias("route"),
    )


@query("dates", "F4", "SELECT CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS INTEGER) > 365 AS stale, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def dates(t: Tables) -> DataFrame:
    return t.orders.groupBy((F.datediff(F.lit("1998-12-31").cast("date"), F.col("o_orderdate").cast("date")) > 365).alias("stale")).agg(F.count("*").alias("n"))


@query("truncated_excerpts", "F5 Q18")
def truncated_excerpts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.byte_cut(F.col("text"), 400).alias("excerpt"), F.when(F.octet_length("text") > 400, "truncated").otherwise("complete").alias("status"))


_LITERALS = "|".join(rf"{q}[^{q}\\]*(?:\\.[^{q}\\]*)*(?:{q}|\\?\z)" for q in ("''", '"', "`"))


@query("redacted_literals", "F7", rf"SELECT conv_id, turn, regexp_replace(trim(regexp_replace(regexp_replace('f(a = ' || chr(39) || turn || ' ' || chr(92) || chr(39) || ' it' || chr(39) || ', ' || chr(34) || 'x' || conv_id || chr(34) || ',   `y`) ' || text, '(?s){_LITERALS}', '<literal>', 'g'), '\s+', ' ', 'g')), '[0-9]+', '0', 'g') AS safe FROM conversations")
def redacted_literals(t: Tables) -> DataFrame:
    """Each text behind a signature with strings in three quotes; apostrophes of the text open literals too."""
    signature = F.concat(F.lit("f(a = '"), "turn", F.lit(" \\' it', \"x"), "conv_id", F.lit('",   `y`) '), "text")
    return t.conversations.select("conv_id", "turn", text.redacted(signature).alias("safe"))
