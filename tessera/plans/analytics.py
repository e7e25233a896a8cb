"""File-graph analytics: metrics, hotspots, findings, hubs, projections, domains, cycles and impact scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.fixtures import DEFINITE_SQL, EDGES_SQL, FILE_GRAPH_SQL, FILE_LINKS_SQL, GRAPH_SQL, HANDOFFS_SQL, IMPACT_SQL, Tables
from tessera.model import definite, impact_edge
from tessera.operators import analytics, graph
from tessera.plans.base import query

G = f"WITH {FILE_GRAPH_SQL}"
_FILES = "f AS (SELECT source_file AS file FROM file_graph UNION SELECT target_file FROM file_graph)"
_METRICS = f"""{_FILES}, o AS (SELECT source_file AS file, count(DISTINCT target_file) AS fan_out, count(DISTINCT CASE WHEN split_part(source_file, '/', 1) <> split_part(target_file, '/', 1) THEN target_file END) AS cross_out FROM file_graph GROUP BY 1),
 i AS (SELECT target_file AS file, count(DISTINCT source_file) AS fan_in FROM file_graph GROUP BY 1), c AS (SELECT p_brand || '/' || p_type AS file, CAST(sum(p_size) AS BIGINT) AS churn, CAST(max(p_size) AS INTEGER) AS line_count FROM part GROUP BY 1),
 m AS (SELECT file, CAST(coalesce(fan_in, 0) AS BIGINT) AS fan_in, CAST(coalesce(fan_out, 0) AS BIGINT) AS fan_out, CAST(coalesce(cross_out, 0) AS BIGINT) AS cross_out, CAST(coalesce(fan_in, 0) + coalesce(fan_out, 0) AS BIGINT) AS connectivity, coalesce(churn, 0) AS churn, coalesce(line_count, 1) AS line_count FROM f LEFT JOIN o USING (file) LEFT JOIN i USING (file) LEFT JOIN c USING (file))"""


def _churn(t: Tables) -> DataFrame:
    file = F.concat("p_brand", F.lit("/"), "p_type")
    return t.part.groupBy(file.alias("file")).agg(F.sum("p_size").cast("long").alias("churn"), F.max("p_size").alias("line_count"))


def _metrics(t: Tables) -> DataFrame:
    return analytics.file_metrics(fx.file_graph(t), _churn(t))


@query("file_graph", "N1 G6 J1 C", G + " SELECT source_file, target_file, id, confidence FROM file_graph")
def file_graph(t: Tables) -> DataFrame:
    return fx.file_graph(t).select("source_file", "target_file", "id", "confidence")


@query("file_metrics", "G7 G8", f"{G}, {_METRICS} SELECT file, fan_in, fan_out, cross_out, connectivity, line_count FROM m")
def file_metrics(t: Tables) -> DataFrame:
    return _metrics(t).select("file", "fan_in", "fan_out", "cross_out", "connectivity", "line_count")


_THRESHOLDS = """th AS (SELECT greatest(2, (SELECT connectivity FROM (SELECT connectivity, row_number() OVER (ORDER BY connectivity) - 1 AS k FROM m) x WHERE k = (SELECT CAST(floor((count(*) - 1) * 0.75) AS BIGINT) FROM m))) AS conn_t,
 greatest(1, coalesce((SELECT churn FROM (SELECT churn, row_number() OVER (ORDER BY churn) - 1 AS k FROM m WHERE churn > 0) x WHERE k = (SELECT CAST(floor((count(*) - 1) * 0.75) AS BIGINT) FROM m WHERE churn > 0)), 0)) AS churn_t)"""


@query("hotspots", "G9 G18", f"{G}, {_METRICS}, {_THRESHOLDS} SELECT file, round(connectivity * log2(churn + 2), 2) AS hotspot, connectivity >= conn_t AND churn >= churn_t AS is_hotspot FROM m, th")
def hotspots(t: Tables) -> DataFrame:
    return analytics.hotspots(_metrics(t)).select("file", "hotspot", "is_hotspot")


@query("findings", "G10 Q4 W3", f"""{G}, {_METRICS}, {_THRESHOLDS}, x AS (SELECT 'high_fan_in' AS finding, file, CASE WHEN fan_in >= 10 THEN 'high' ELSE 'medium' END AS severity FROM m WHERE fan_in >= 5 UNION ALL SELECT 'high_fan_out', file, CASE WHEN fan_out >= 10 THEN 'high' ELSE 'medium' END FROM m WHERE fan_out >= 5
 UNION ALL SELECT 'large_file', file, CASE WHEN line_count >= 80 THEN 'high' ELSE 'medium' END FROM m WHERE line_count >= 40 UNION ALL SELECT 'change_hotspot', file, CASE WHEN round(connectivity * log2(churn + 2), 2) >= 8 * conn_t THEN 'high' ELSE 'medium' END FROM m, th WHERE connectivity >= conn_t AND churn >= churn_t
 UNION ALL SELECT 'large_symbol', 'part:' || p_partkey, CASE WHEN p_size >= 98 THEN 'high' ELSE 'medium' END FROM part WHERE p_size >= 49) SELECT * FROM x""")
def findings(t: Tables) -> DataFrame:
    symbols = t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_size").alias("lines"))
    return analytics.findings(analytics.hotspots(_metrics(t)), symbols, fan=5, file_lines=40, symbol_lines=49)


@query("history_rollup", "G5", "SELECT event_type AS file, CAST(count(DISTINCT event_id) AS BIGINT) AS commits, CAST(count(DISTINCT user_id) AS BIGINT) AS contributors, round(sum(value), 4) AS churn, last(event_id ORDER BY ts, event_id) AS latest FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 90 DAY FROM events) GROUP BY event_type")
def history_rollup(t: Tables) -> DataFrame:
    """The last ninety days of a change log by file: commits, contributors, churn and the latest commit."""
    return analytics.history(t.events.select(F.col("event_type").alias("file"), F.col("event_id").alias("commit"), F.col("user_id").alias("author"), F.col("value").alias("churn"), "ts"), days=90)


@query("hubs", "G12", f"{G}, b AS (SELECT source_file AS file, 'out' AS d FROM file_graph UNION ALL SELECT target_file, 'in' FROM file_graph), n AS (SELECT file, CAST(count(*) FILTER (d = 'in') AS BIGINT) AS in_degree, CAST(count(*) FILTER (d = 'out') AS BIGINT) AS out_degree, CAST(count(*) AS BIGINT) AS degree FROM b GROUP BY file) SELECT * FROM n WHERE degree >= greatest(8, (SELECT ceil(sqrt(count(*))) FROM n)) ORDER BY degree DESC, file LIMIT 20")
def hubs(t: Tables) -> DataFrame:
    return analytics.hubs(fx.file_graph(t), "source_file", "target_file", 20)


@query("aggregated_edges", "G11 N23", f"""WITH {FILE_LINKS_SQL}, r AS (SELECT split_part(source_file, '/', 1) AS source_group, split_part(target_file, '/', 1) AS target_group, id, confidence, row_number() OVER (PARTITION BY split_part(source_file, '/', 1), split_part(target_file, '/', 1) ORDER BY confidence DESC, id) AS n FROM file_links)
 SELECT source_group, target_group, CAST(count(*) AS BIGINT) AS n_edges, string_agg(id, ',' ORDER BY id) AS ids, string_agg(CASE WHEN n <= 3 THEN id END, ',' ORDER BY n) AS representatives FROM r WHERE source_group <> target_group GROUP BY ALL""")
def aggregated_edges(t: Tables) -> DataFrame:
    group = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(1))
    return analytics.aggregate_edges(fx.file_links(t), group("source_file"), group("target_file"), 3)


@query("domain_rollup", "G13", f"""WITH {GRAPH_SQL}, j AS (SELECT s.domain AS sd, g.domain AS gd, e.confidence FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes g ON g.id = e.target WHERE s.domain IS NOT NULL AND {IMPACT_SQL.replace('type', 'e.type')}),
 k AS (SELECT domain, CAST(count(*) AS BIGINT) AS members, CAST(count(DISTINCT file) AS BIGINT) AS files, CAST(count(*) FILTER (kind = 'endpoint') AS BIGINT) AS entrypoints FROM nodes WHERE domain IS NOT NULL GROUP BY domain)
 SELECT k.*, CAST(count(*) FILTER (sd = gd) AS BIGINT) AS internal, CAST(count(*) FILTER (gd IS NULL OR sd <> gd) AS BIGINT) AS outgoing, round(avg(confidence), 6) AS confidence FROM k LEFT JOIN j ON sd = k.domain GROUP BY ALL""")
def domain_rollup(t: Tables) -> DataFrame:
    return analytics.domains(fx.nodes(t), fx.edges(t).where(impact_edge()))


@query("cycle_rollup", "G14 N12", f"""WITH RECURSIVE {HANDOFFS_SQL}, pairs AS (SELECT DISTINCT source, target FROM handoffs), r AS (SELECT source, target FROM pairs UNION SELECT r.source, p.target FROM r JOIN pairs p ON r.target = p.source),
 m AS (SELECT a.source AS id, min(a.target) AS component FROM r a JOIN r b ON a.target = b.source AND a.source = b.target GROUP BY a.source HAVING count(DISTINCT a.target) > 1)
 SELECT a.component, CAST(count(DISTINCT a.id) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS n_edges, least(0.95, min(h.confidence)) AS confidence, CASE WHEN count(DISTINCT a.id) >= 4 THEN 'high' ELSE 'medium' END AS severity FROM handoffs h JOIN m a ON h.source = a.id JOIN m b ON h.target = b.id AND a.component = b.component GROUP BY a.component""")
def cycle_rollup(t: Tables) -> DataFrame:
    h = fx.handoffs(t)
    return analytics.cycles(h, graph.strong_components(h, "source", "target"))


def _contribution(c: Column, weight: float, cap: float) -> Column:
    return analytics.contribution(c, weight, cap)


@query("impact_scores", "G15", f"""WITH {GRAPH_SQL}, d AS (SELECT * FROM edges WHERE {DEFINITE_SQL}), s AS (SELECT id FROM nodes WHERE kind = 'database_model'),
 one AS (SELECT target AS id, count(*) AS direct, count(DISTINCT source) AS neighbours FROM d WHERE type = 'READS_FROM' GROUP BY target), two AS (SELECT a.target AS id, count(*) AS transitive, count(DISTINCT a.source) AS entry, count(DISTINCT n.domain) AS dom FROM d a JOIN d b ON b.target = a.source JOIN nodes n ON n.id = a.source WHERE a.type = 'READS_FROM' AND b.type = 'CALLS' GROUP BY a.target),
 c AS (SELECT s.id, least(20, round(log2(coalesce(direct, 0) + 1) * 5, 2)) + least(20, round(log2(coalesce(transitive, 0) + 1) * 2.2, 2)) + least(20, round(log2(coalesce(entry, 0) + 1) * 10, 2)) + least(10, round(log2(coalesce(dom, 0) + 1) * 4, 2)) + least(8, round(log2(coalesce(neighbours, 0) + 1) * 1.5, 2)) + 8 AS raw FROM s LEFT JOIN one USING (id) LEFT JOIN two USING (id))
 SELECT id, round(least(100, greatest(0, raw)), 1) AS score, CASE WHEN round(raw, 1) >= 60 THEN 'high' WHEN round(raw, 1) >= 25 THEN 'medium' ELSE 'low' END AS risk FROM c""")
def impact_scores(t: Tables) -> DataFrame:
    """The logarithmic impact score of every part: direct callers, paths, entrypoints, domains, neighbours, and 8 for touching a database."""
    n, d = fx.nodes(t), fx.edges(t).where(definite())
    reads = d.where("type = 'READS_FROM'").select(F.col("target").alias("id"), F.col("source").alias("order_id"))
    calls = d.where("type = 'CALLS'").select(F.col("target").alias("order_id"))
    one = reads.groupBy("id").agg(F.count("*").alias("direct"), F.count_distinct("order_id").alias("neighbours"))
    two = reads.join(calls, "order_id").join(n.select(F.col("id").alias("order_id"), "domain"), "order_id").groupBy("id").agg(F.count("*").alias("transitive"), F.count_distinct("order_id").alias("entry"), F.count_distinct("domain").alias("dom"))
    parts = n.where("kind = 'database_model'").select("id").join(one, "id", "left").join(two, "id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    raw = _contribution(z("direct"), 5, 20) + _contribution(z("transitive"), 2.2, 20) + _contribution(z("entry"), 10, 20) + _contribution(z("dom"), 4, 10) + _contribution(z("neighbours"), 1.5, 8) + 8
    score = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 1)
    return parts.select("id", score.alias("score"), F.when(score >= 60, "high").when(score >= 25, "medium").otherwise("low").alias("risk"))


@query("default_projection", "N23", f"{G}, g AS (SELECT split_part(source_file, '/', 1) AS s, split_part(target_file, '/', 1) AS t FROM file_graph), m AS (SELECT p_brand AS grp, count(*) AS members FROM part GROUP BY p_brand), k AS (SELECT grp, members, row_number() OVER (ORDER BY members DESC, grp) AS n FROM m) SELECT grp, CAST(members AS BIGINT) AS members, CAST((SELECT count(*) FROM g WHERE s = grp AND t <> grp) AS BIGINT) AS out_edges, CAST((SELECT greatest(count(*) - 15, 0) FROM m) AS BIGINT) AS hidden FROM k WHERE n <= 15")
def default_projection(t: Tables) -> DataFrame:
    """Groups as super-nodes, the largest fifteen, and how many are hidden."""
    members = t.part.groupBy(F.col("p_brand").alias("grp")).agg(F.count("*").alias("members"))
    hidden = members.agg(F.greatest(F.count("*") - 15, F.lit(0)).cast("long").alias("hidden"))
    top = members.orderBy(F.desc("members"), "grp").limit(15)
    part = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(1))
    out = fx.file_graph(t).where(part("source_file") != part("target_file")).groupBy(part("source_file").alias("grp")).agg(F.count("*").alias("out_edges"))
    return top.join(out, "grp", "left").join(hidden).select("grp", "members", F.coalesce("out_edges", F.lit(0).cast("long")).alias("out_edges"), "hidden")


@query("feature_groups", "N24 F10", """WITH g AS (SELECT lower(p_brand) AS key, count(DISTINCT p_type) AS files, max(CASE WHEN p_size > 49 THEN 1 ELSE 0 END) AS routed, max(CASE WHEN p_retailprice > 1500 THEN 1 ELSE 0 END) AS modelled FROM part GROUP BY 1)
 SELECT key, CAST(files AS BIGINT) AS files, round(least(0.95, 0.35 + CASE WHEN files > 1 THEN 0.1 ELSE 0 END + 0.15 * routed + 0.15 * modelled), 2)::DOUBLE AS confidence FROM g""")
def feature_groups(t: Tables) -> DataFrame:
    """Features by directory: each signal adds its weight to the confidence, up to 0.95."""
    g = t.part.groupBy(F.lower("p_brand").alias("key")).agg(F.count_distinct("p_type").alias("files"), F.max(F.when(F.col("p_size") > 49, 1).otherwise(0)).alias("routed"), F.max(F.when(F.col("p_retailprice") > 1500, 1).otherwise(0)).alias("modelled"))
    confidence = analytics.grouping_confidence(directory=F.lit(True), cluster=F.col("files") > 1, route=F.col("routed") == 1, model=F.col("modelled") == 1)
    return g.select("key", "files", confidence.alias("confidence"))


@query("cross_layer_concepts", "N24", """WITH f AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS layer, split_part(p_name, ' ', 2) AS concept, p_brand || '/' || p_type AS file FROM part WHERE p_size > 40)
 SELECT concept, CAST(count(DISTINCT layer) AS BIGINT) AS layers, CAST(count(DISTINCT file) AS BIGINT) AS files, round(least(0.9, 0.65 + 0.05 * count(DISTINCT layer) + 0.02 * count(DISTINCT file)), 2)::DOUBLE AS confidence FROM f GROUP BY concept HAVING count(DISTINCT layer) >= 2 AND count(DISTINCT file) >= 2""")
def cross_layer_concepts(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    f = t.part.where("p_size > 40").select(words[0].alias("layer"), F.get(words, F.lit(1)).alias("concept"), F.concat("p_brand", F.lit("/"), "p_type").alias("file")).distinct()
    c = f.groupBy("concept").agg(F.count_distinct("layer").alias("layers"), F.count_distinct("file").alias("files")).where("layers >= 2 AND files >= 2")
    return c.select("concept", "layers", "files", F.round(F.least(F.lit(0.9), 0.65 + 0.05 * F.col("layers") + 0.02 * F.col("files")), 2).alias("confidence"))


@query("domain_override", "N25", f"WITH {GRAPH_SQL}, o AS (SELECT id, CASE WHEN file LIKE '7/%' THEN 'region:9' WHEN file LIKE 'orders/P%' THEN 'region:8' ELSE domain END AS domain FROM nodes) SELECT domain, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY domain")
def domain_override(t: Tables) -> DataFrame:
    return analytics.override_domains(fx.nodes(t), [("orders/P*", "region:8"), ("7/*", "region:9")]).groupBy("domain").agg(F.count("*").alias("n"))


@query("review_summary", "G16 Q27", "SELECT o_orderpriority AS severity, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS affected, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS o, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS p FROM orders GROUP BY ALL")
def review_summary(t: Tables) -> DataFrame:
    by = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().select("o_orderpriority", *[F.coalesce(F.col(s), F.lit(0).cast("long")).alias(s.lower()) for s in "FOP"])
    total = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("affected"))
    return total.join(by, "o_orderpriority").select(F.col("o_orderpriority").alias("severity"), "n", "affected", "f", "o", "p")


@query("uncertainty_envelope", "G24 Q33", f"{'WITH ' + EDGES_SQL} SELECT type, CAST(count(DISTINCT CASE WHEN source_type = 'heuristic' THEN id END) AS BIGINT) AS inferred, CAST(count(DISTINCT CASE WHEN confidence < 0.95 THEN id END) AS BIGINT) AS weak, CAST(count(DISTINCT id) AS BIGINT) AS total FROM edges GROUP BY type")
def uncertainty_envelope(t: Tables) -> DataFrame:
    return fx.edges(t).groupBy("type").agg(F.count_distinct(F.when(F.col("source_type") == "heuristic", F.col("id"))).alias("inferred"), F.count_distinct(F.when(F.col("confidence") < 0.95, F.col("id"))).alias("weak"), F.count_distinct("id").alias("total"))


@query("repository_overview", "Q3 Q17 U1", f"WITH {GRAPH_SQL} SELECT 'domain' AS section, domain AS name, CAST(count(*) AS BIGINT) AS n FROM nodes WHERE domain IS NOT NULL GROUP BY domain UNION ALL SELECT 'entrypoint', file, CAST(count(*) AS BIGINT) FROM nodes WHERE kind = 'endpoint' GROUP BY file UNION ALL SELECT 'relationship', type, CAST(count(*) AS BIGINT) FROM edges GROUP BY type")
def repository_overview(t: Tables) -> DataFrame:
    n, e = fx.nodes(t), fx.edges(t)
    part = lambda df, section, key: df.groupBy(F.col(key).alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")
    return part(n.where("domain IS NOT NULL"), "domain", "domain").unionByName(part(n.where("kind = 'endpoint'"), "entrypoint", "file")).unionByName(part(e, "relationship", "type"))


@query("domain_members", "Q12 P1", f"WITH {GRAPH_SQL} SELECT domain, kind, CAST(count(*) AS BIGINT) AS n, min(id) AS first_id FROM nodes WHERE domain IN (SELECT 'region:' || r_regionkey FROM region WHERE r_name LIKE 'A%') GROUP BY ALL")
def domain_members(t: Tables) -> DataFrame:
    wanted = t.region.where("r_name LIKE 'A%'").select(F.concat(F.lit("region:"), "r_regionkey").alias("domain"))
    return fx.nodes(t).join(wanted, "domain", "left_semi").groupBy("domain", "kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("relationship_quality", "Q20 Q22 Q25", f"WITH {EDGES_SQL} SELECT round(count(*) FILTER (source_type <> 'heuristic') / count(*), 6) AS verified, round(count(*) FILTER (source_type = 'heuristic') / count(*), 6) AS inferred, count(*) FILTER (source_type <> 'heuristic') / count(*) >= 0.5 AS ok FROM edges")
def relationship_quality(t: Tables) -> DataFrame:
    share = lambda c: F.count_if(c) / F.count("*")
    v = share(F.col("source_type") != "heuristic")
    return fx.edges(t).agg(F.round(v, 6).alias("verified"), F.round(share(F.col("source_type") == "heuristic"), 6).alias("inferred"), (v >= 0.5).alias("ok"))


@query("analytics_pipeline", "N26 Q4")
def analytics_pipeline(t: Tables) -> DataFrame:
    """All file analytics in one result: depth, community, component and metrics of each file."""
    g = fx.file_graph(t)
    depth = graph.longest_depth(g, "source_file", "target_file")
    community = graph.louvain(g, "source_file", "target_file").select(F.col("id").alias("file"), "community")
    return analytics.hotspots(_metrics(t)).join(depth, "file", "left").join(community, "file", "left").select("file", "fan_in", "fan_out", "hotspot", "depth", "community")

