"""Queries about questions, tasks, symbols, and what of an index is fresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.fixtures import DEFINITE_SQL, EDGES_SQL, GRAPH_SQL, Tables
from tessera.operators import context, generations
from tessera.plans.base import query

_PHRASES = ("Where is", "Trace the call chain of", "show code of", "Refactor", "please explain", "from login to", "", "fixing", "blast radius of", "Overview:")
_ASKED = f"asked AS (SELECT conv_id, turn, list_extract({list(_PHRASES)}, CAST((conv_id * 3 + turn) % {len(_PHRASES)} AS INTEGER) + 1) || ' ' || coalesce(text, '') AS text FROM conversations)"


def _asked(t: Tables) -> DataFrame:
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(len(_PHRASES))) + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


_ROUTED = "CASE " + " ".join(f"WHEN regexp_matches(trim(text), '(?i)\\b(?:{words})\\b') THEN '{name}'" for name, words in context.ROUTES) + " ELSE 'native_fallback' END"


@query("intent_routing_operations", "P15", f"WITH {_ASKED} SELECT conv_id, turn, {_ROUTED} AS operation FROM asked")
def intent_routing_operations(t: Tables) -> DataFrame:
    return _asked(t).select("conv_id", "turn", context.route(F.col("text")).alias("operation"))


@query("task_targets", "P16", """SELECT p_partkey, 'Brand,part_' || p_partkey AS symbols, 'src/' || lower(split_part(p_type, ' ', 1)) || '/p' || p_partkey || '.ts' AS file, '/parts/' || p_partkey AS endpoint,
 CASE WHEN p_size % 2 = 0 THEN 'feature' ELSE 'bug_fix' END AS kind, p_size % 3 = 0 AS speaks_of_auth FROM part""")
def task_targets(t: Tables) -> DataFrame:
    """A task made of each part: its explicit file, endpoint and symbols are told apart, and what it speaks of adds terms."""
    verb = F.when(F.col("p_size") % 2 == 0, "add").otherwise("fix")
    file = F.concat(F.lit("src/"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit("/p"), F.col("p_partkey"), F.lit(".ts"))
    task = F.concat(verb, F.lit(" the Brand check of part_"), F.col("p_partkey"), F.lit(" behind GET /parts/"), F.col("p_partkey"), F.lit(" in ./"), file, F.when(F.col("p_size") % 3 == 0, " for login").otherwise(" for all"))
    i = t.part.select("p_partkey", context.intent(task).alias("i"))
    first = F.filter("i.files", lambda f: F.contains(f, F.lit("/")))[0]
    return i.select("p_partkey", F.array_join(F.array_sort("i.symbols"), ",").alias("symbols"), first.alias("file"), F.col("i.endpoints")[0].alias("endpoint"), F.col("i.kind").alias("kind"), F.array_contains("i.terms", "authenticate").alias("speaks_of_auth"))


@query("symbol_context", "Q2 Q5", f"""WITH {EDGES_SQL}, w AS (SELECT 'part:' || p_partkey AS id FROM part),
 s AS (SELECT source AS id, 'relationships' AS section, edges.id AS item FROM edges UNION ALL SELECT target, 'relationships', edges.id FROM edges WHERE source <> target
  UNION ALL SELECT 'part:' || l_partkey, 'evidence', l_orderkey || ':' || l_linenumber || ':' || l_suppkey || ':' || CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem
  UNION ALL SELECT 'part:' || l_partkey, 'issues', 'returned in ' || l_orderkey || ':' || l_linenumber || ':' || l_suppkey || ':' || CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem WHERE l_returnflag = 'R'),
 r AS (SELECT id, section, item, row_number() OVER (PARTITION BY id, section ORDER BY item) AS position, count(*) OVER (PARTITION BY id, section) AS n FROM s JOIN w USING (id))
 SELECT id, section, CAST(position AS INTEGER) AS position, item, n > 15 AS more FROM r WHERE position <= 15""")
def symbol_context(t: Tables) -> DataFrame:
    """Neighbours, evidence and issues of every part."""
    line = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    of = F.concat(F.lit("part:"), "l_partkey").alias("id")
    evidence = t.lineitem.select(of, line.alias("item"))
    issues = t.lineitem.where("l_returnflag = 'R'").select(of, F.concat(F.lit("returned in "), line).alias("item"))
    wanted = t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("id"))
    return context.symbol_context(wanted, fx.edges(t), evidence, issues, 15)


_CHANGES = """ch AS (SELECT user_id % 40 AS repo, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS batch, event_id % 97 = 0 AS full_, CASE event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'modified' WHEN 'purchase' THEN 'added' ELSE 'deleted' END AS change,
 value > 95 AS g, value > 90 AS l, value < 3 AS s, value < 5 AS x, event_id % 53 = 0 AS a, event_id % 41 = 0 AS i FROM events WHERE event_type IN ('click', 'view') OR event_id % 10 = 0),
 b AS (SELECT repo, batch, bool_or(full_ OR g OR l OR change IN ('added', 'deleted')) AS structural, bool_or(full_ OR s OR i) AS semantic, bool_or(full_ OR x OR change IN ('added', 'deleted')) AS search, bool_or(full_ OR a OR i OR change IN ('added', 'deleted')) AS architecture FROM ch GROUP BY repo, batch)"""
_COUNTS = ", ".join(f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) OVER (PARTITION BY repo ORDER BY batch) AS BIGINT) AS {c}" for c in generations.COUNTERS)


def _counters(t: Tables) -> DataFrame:
    change = F.when(F.col("event_type").isin("click", "view"), "modified").when(F.col("event_type") == "purchase", "added").otherwise("deleted")
    day = F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp")))
    flag = lambda c, n: F.col(c).cast("boolean") if n is None else F.col(c) % n == 0
    changes = t.events.where("event_type IN ('click', 'view') OR event_id % 10 = 0").select(
        (F.col("user_id") % 40).alias("repo"), day.alias("batch"), flag("event_id", 97).alias("full"), change.alias("change"), (F.col("value") > 95).alias("graph"), (F.col("value") > 90).alias("location"),
        (F.col("value") < 3).alias("semantic"), (F.col("value") < 5).alias("search_text"), flag("event_id", 53).alias("architecture"), flag("event_id", 41).alias("invalidated"),
    )
    return generations.counters(generations.bumps(changes))


@query("generations", "I8", f"WITH {_CHANGES} SELECT repo, batch, {_COUNTS} FROM b")
def generation_counters(t: Tables) -> DataFrame:
    """Events as changes of files, days as batches, groups of users as repositories."""
    return _counters(t)


@query("freshness_gate", "Q38 I8 Q19", f"""WITH {_CHANGES}, c AS (SELECT repo, batch, {_COUNTS} FROM b), now AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repo ORDER BY batch DESC) = 1),
 was AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repo ORDER BY batch DESC) = 1 + repo % 4), q AS (SELECT repo, unnest(['structural', 'semantic', 'search', 'architecture', 'all']) AS requirement FROM now)
 SELECT q.repo, requirement, coalesce(was.structural = now.structural, FALSE) AND (requirement NOT IN ('semantic', 'all') OR coalesce(was.semantic = now.semantic, FALSE)) AND (requirement NOT IN ('search', 'all') OR coalesce(was.search = now.search, FALSE))
   AND (requirement NOT IN ('architecture', 'all') OR coalesce(was.architecture = now.architecture, FALSE)) AS fresh FROM q JOIN now USING (repo) LEFT JOIN was USING (repo)""")
def freshness_gate(t: Tables) -> DataFrame:
    """Every requirement for every repository, whose index is up to three batches behind."""
    from pyspark.sql import Window

    c = _counters(t).withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("batch"))))
    now, was = c.where("n = 1"), c.where("n = 1 + repo % 4")
    asked = now.select("repo", F.explode(F.array(*[F.lit(x) for x in (*generations.COUNTERS, "all")])).alias("requirement")).withColumn("request", F.lit(0))
    return generations.gate(asked, was, now).select("repo", "requirement", "fresh")


@query("answer_paths", "N21")
def answer_paths(t: Tables) -> DataFrame:
    """Paths through the commerce graph that answer a question about each market segment."""
    n = fx.nodes(t).select("id", F.concat_ws(" ", "kind", "name", "file").alias("search_text"), (F.col("kind") == "external_actor").alias("is_entry"))
    starts = t.customer.select(F.col("c_mktsegment").alias("query"), F.concat(F.lit("customer:"), "c_custkey").alias("id"))
    terms = t.customer.select(F.col("c_mktsegment").alias("query")).distinct().withColumn("terms", F.array(F.lit("order"), F.lit("widget"), F.lit("brand#1"), F.lit("supplier")))
    return context.answer_paths(n, fx.edges(t), starts, terms, (("endpoint", "order"), ("database_model", "brand"), ("service", "supplier")))


@query("change_brief", "V6 Q15 T11", f"""WITH {GRAPH_SQL}, task AS (SELECT p_partkey AS task, p_name AS name, p_brand || '/' || p_type AS file FROM part WHERE p_size = 7),
 tg AS (SELECT task.task, 'part:' || p.p_partkey AS id FROM task JOIN part p ON p.p_partkey = task.task),
 af AS (SELECT DISTINCT tg.task, edges.source AS id FROM tg JOIN edges ON edges.target = tg.id WHERE {DEFINITE_SQL})
 SELECT task, CAST(sum(CASE WHEN id LIKE 'part:%' THEN 1 ELSE 0 END) AS BIGINT) AS n_targets, CAST(sum(CASE WHEN id LIKE 'part:%' THEN 0 ELSE 1 END) AS BIGINT) AS n_affected FROM (SELECT * FROM tg UNION ALL SELECT * FROM (SELECT task, id FROM af QUALIFY row_number() OVER (PARTITION BY task ORDER BY id) <= 20)) x GROUP BY task""")
def change_brief(t: Tables) -> DataFrame:
    """A brief for a change of each part of one size, which the task spells by its id: how many targets and affected nodes it holds."""
    n = fx.nodes(t).withColumn("qualified_name", F.col("id")).withColumn("name", F.lit(""))
    n = n.withColumn("file", F.lit(None).cast("string"))
    tasks = t.part.where("p_size = 7").select(F.col("p_partkey").alias("task"), F.concat(F.lit("rename 'part:"), "p_partkey", F.lit("'")).alias("text"))
    brief = context.change_brief(tasks, n, fx.edges(t))
    return brief.groupBy("task").agg(F.count_if(F.col("section") == "targets").alias("n_targets"), F.count_if(F.col("section") == "affected").alias("n_affected"))
