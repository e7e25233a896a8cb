"""Retrieval queries over documents and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.fixtures import GRAPH_SQL, NODES_SQL, Tables
from tessera.functions import text
from tessera.operators import search
from tessera.plans.base import query

_SPLIT = r"'[^\p{L}\p{N}_$-]+'"
_POSTINGS = f"""w AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(lower(text), {_SPLIT}), lambda x: length(x) > 1) AS w FROM documents), e AS (SELECT doc, len(w) AS length, unnest(w) AS term FROM w),
 idx AS (SELECT doc, term, CAST(any_value(length) AS DOUBLE) AS length, CAST(count(*) AS DOUBLE) AS tf FROM e GROUP BY doc, term), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS avg FROM (SELECT doc, any_value(length) AS length FROM idx GROUP BY doc) x)"""
_QUESTIONS = f"""b AS (SELECT item_id AS query, list_slice(list_distinct_ordered, 1, 20) AS ts FROM (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), {_SPLIT}), lambda x: length(x) > 1) AS l FROM benchmark) y) z),
 m AS (SELECT query, ts, list_filter(ts, lambda x: NOT list_contains({list(search.STOP_WORDS)}, x)) AS meant FROM b), q AS (SELECT query, unnest(CASE WHEN len(meant) > 0 THEN meant ELSE ts END) AS term FROM m)"""
_SCORED = """df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM idx WHERE term IN (SELECT term FROM q) GROUP BY term),
 sc AS (SELECT query, doc, -sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))) AS score FROM idx JOIN q USING (term) JOIN df USING (term), st GROUP BY query, doc)"""


def _questions(t: Tables) -> DataFrame:
    return search.question_terms(t.benchmark.select(F.col("item_id").alias("query"), "text"))


@query("tokenizer", "T2 T8", f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), {_SPLIT}), lambda x: length(x) > 1) AS w FROM documents) x")
def tokenizer(t: Tables) -> DataFrame:
    w = text.words(F.col("text"))
    return t.documents.select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"))


@query("identifier_tokens", "T8", "SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(regexp_split_to_array(lower(regexp_replace(replace(initcap, ' ', ''), '([\\p{Ll}\\p{N}])(\\p{Lu})', '\\1 \\2', 'g')), '[^\\p{L}\\p{N}]+')), lambda x: length(x) > 1)), ' ') AS terms FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS initcap FROM part) x")
def identifier_tokens(t: Tables) -> DataFrame:
    """Parts of camelCase names made from part names."""
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    whole = F.lower(camel)
    parts = F.filter(text.identifier_terms(camel), lambda x: (x != whole) | ~camel.rlike(r"[\p{Ll}\p{N}]\p{Lu}"))
    return t.part.select("p_partkey", F.array_join(F.sort_array(parts), " ").alias("terms"))


@query("postings", "T1", f"WITH {_POSTINGS} SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM idx GROUP BY term")
def postings(t: Tables) -> DataFrame:
    return search.postings(t.documents, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("bm25_search", "T1 T2 J4 Q16", f"WITH {_POSTINGS}, {_QUESTIONS}, {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6), doc) AS n FROM sc) SELECT query, doc, round(score, 4) AS score, CAST(n AS INTEGER) AS n FROM r WHERE n <= 10")
def bm25_search(t: Tables) -> DataFrame:
    """The ten best documents for every question of the benchmark."""
    found = search.bm25(t.documents, "doc_id", "text", _questions(t))
    w = Window.partitionBy("query").orderBy(F.round("score", 6), "doc")
    return found.withColumn("n", F.row_number().over(w)).where("n <= 10").select("query", "doc", F.round("score", 4).alias("score"), "n")


@query("prefix_search", "T5", f"""WITH {NODES_SQL}, h AS (SELECT id, kind, name, lower(name) AS l, lower(coalesce(file, '')) AS f, len(list_filter(regexp_split_to_array(lower(concat_ws(' ', name, file)), {_SPLIT}), lambda x: starts_with(x, 'red') OR starts_with(x, 'widget'))) AS n FROM nodes)
 SELECT id, CAST(CASE WHEN l = 'the red widget' THEN 0 WHEN starts_with(l, 'the red widget') THEN 2 WHEN contains(f, 'the red widget') THEN 3 ELSE 4 END AS INTEGER) AS tier FROM h WHERE n > 0 AND kind <> 'module' ORDER BY tier, kind, name, id LIMIT 200""")
def prefix_search(t: Tables) -> DataFrame:
    """Searchable nodes with words that begin as the words of a query do, in tiers."""
    rows = fx.nodes(t).withColumn("qualified_name", F.lit(None).cast("string")).withColumn("confidence", F.lit(1.0))
    return search.tiered(rows, "the Red widget", limit=200).select("id", "tier")


@query("route_literals", "T7 Q16", f"""WITH k AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+', '') AS path FROM pages), q AS (SELECT page_id AS query, 'who serves ' || regexp_replace(url, '^https?://[^/]+', '') || ' ?' AS text FROM pages),
 a AS (SELECT query, regexp_extract(text, '(/[A-Za-z0-9_~!$&''()*+,;=:@%./{{}}-]*)', 1) AS route FROM q) SELECT query, CAST(count(*) AS BIGINT) AS n, min(page_id) AS first FROM a JOIN k ON k.path = a.route WHERE route <> '' GROUP BY query""")
def route_literals(t: Tables) -> DataFrame:
    """Every page's path asked for in a sentence, found by its hash."""
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    asked = t.pages.select(F.col("page_id").alias("query"), F.concat(F.lit("who serves "), path, F.lit(" ?")).alias("text"))
    return search.by_route(asked, t.pages.select(F.col("page_id").alias("id"), path.alias("path"))).groupBy("query").agg(F.count("*").alias("n"), F.min("id").alias("first"))


_RANKED = "CASE kind WHEN 'endpoint' THEN 80 WHEN 'database_model' THEN 56 WHEN 'module' THEN 48 WHEN 'domain' THEN 42 ELSE 24 END"


@query("exact_match", "T3 T7", f"WITH {NODES_SQL} SELECT id, name, -1000.0::DOUBLE AS rank, CASE WHEN lower(name) = 'red widget' THEN 0 ELSE 2 END AS tier FROM nodes WHERE lower(name) = 'red widget' OR lower(file) = 'red widget' ORDER BY tier, id LIMIT 50")
def exact_match(t: Tables) -> DataFrame:
    rows = fx.nodes(t).withColumn("qualified_name", F.lit(None).cast("string"))
    return search.exact(rows, "RED widget").select("id", "name", "rank", "tier")


@query("substring_search", "T6", f"WITH {NODES_SQL} SELECT id, kind FROM nodes WHERE contains(lower(name), 'supplier#00000000') OR contains(lower(coalesce(file, '')), 'supplier#00000000')")
def substring_search(t: Tables) -> DataFrame:
    rows = fx.nodes(t).withColumn("qualified_name", F.lit(None).cast("string"))
    return search.substring(rows, "Supplier#00000000").select("id", "kind")


@query("hybrid_search", "T4 U4 T13 Q1", f"""WITH {NODES_SQL}, u AS (SELECT id, -1000.0::DOUBLE AS rank, 'exact' AS match FROM nodes WHERE lower(name) = 'order 12' UNION ALL SELECT id, -1.0, 'term' FROM nodes WHERE list_contains(string_split(lower(name), ' '), 'order') AND list_contains(string_split(lower(name), ' '), '12') UNION ALL SELECT id, 0.0, 'substring' FROM nodes WHERE contains(lower(name), 'order 12'))
 SELECT id, rank, match FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, match) AS n FROM u) x WHERE n = 1""")
def hybrid_search(t: Tables) -> DataFrame:
    """Exact, term and substring matches of one query, each node at its best rank."""
    n = fx.nodes(t).withColumn("qualified_name", F.lit(None).cast("string"))
    has = lambda w: F.array_contains(F.split(F.lower("name"), " "), w)
    found = search.exact(n, "order 12").select("id", "rank", F.lit("exact").alias("match"))
    terms = n.where(has("order") & has("12")).select("id", F.lit(-1.0).alias("rank"), F.lit("term").alias("match"))
    sub = search.substring(n, "order 12").select("id", F.lit(0.0).alias("rank"), F.lit("substring").alias("match"))
    return search.best_rank(found, terms, sub)


@query("search_text", "T9", f"WITH {GRAPH_SQL} SELECT n.id, lower(concat_ws(' ', n.name, n.file, n.kind, r.r_name)) AS search_text FROM nodes n LEFT JOIN region r ON n.domain = 'region:' || r.r_regionkey")
def search_text(t: Tables) -> DataFrame:
    names = t.region.select(F.concat(F.lit("region:"), "r_regionkey").alias("domain"), "r_name")
    return fx.nodes(t).join(names, "domain", "left").select("id", F.lower(F.concat_ws(" ", "name", "file", "kind", "r_name")).alias("search_text"))


@query("lexical_ranking", "T10 W4 Q1", f"""WITH {NODES_SQL}, x AS (SELECT id, kind, lower(name) AS name, lower(coalesce(file, '')) AS file, lower(concat_ws(' ', name, file, kind)) AS txt FROM nodes),
 s AS (SELECT id, {_RANKED} + CASE WHEN name = 'widget' THEN 1000 WHEN starts_with(name, 'widget') THEN 500 WHEN contains(name, 'widget') THEN 300 WHEN contains(file, 'widget') THEN 100 ELSE 0 END + CASE WHEN name = 'widget' THEN 90 WHEN contains(name, 'widget') THEN 45 WHEN contains(file, 'widget') THEN 16 WHEN contains(txt, 'widget') THEN 6 ELSE 0 END + 60 AS score FROM x WHERE contains(txt, 'widget'))
 SELECT id, CAST(score AS INTEGER) AS score FROM s ORDER BY score DESC, id LIMIT 100""")
def lexical_ranking(t: Tables) -> DataFrame:
    n = fx.nodes(t).withColumn("qualified_name", F.lit(None).cast("string")).withColumn("search_text", F.concat_ws(" ", "name", "file", "kind"))
    return n.select("id", search.lexical_score("Widget").alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(100)


@query("change_ranking", "T11 V6", f"""WITH {NODES_SQL}, x AS (SELECT id, kind, lower(name) AS name, file, CAST(p_size AS DOUBLE) AS size FROM nodes JOIN part ON id = 'part:' || p_partkey),
 s AS (SELECT id, 56 + 60 + CASE WHEN contains(name, 'widget') THEN 300 + 45 ELSE 0 END + CASE WHEN file LIKE 'Brand#1%' THEN 1000 ELSE 0 END + CASE WHEN size > 45 THEN 1200 ELSE 0 END + 40 AS score FROM x WHERE contains(name, 'widget') OR size > 45 OR file LIKE 'Brand#1%') SELECT id, CAST(score AS INTEGER) AS score FROM s ORDER BY score DESC, id LIMIT 50""")
def change_ranking(t: Tables) -> DataFrame:
    """Candidates of a change: lexical score, an explicit file, and what has already changed."""
    n = fx.nodes(t).join(t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), "p_size"), "id")
    n = n.withColumn("qualified_name", F.lit(None).cast("string")).withColumn("search_text", F.lower("name"))
    hit = F.contains(F.lower("name"), F.lit("widget"))
    explicit, changed = F.col("file").like("Brand#1%"), F.col("p_size") > 45
    lexical = F.when(hit, search.lexical_score("widget")).otherwise(116)
    score = lexical + F.when(explicit, 1000).otherwise(0) + F.when(changed, 1200).otherwise(0) + 40
    return n.where(hit | explicit | changed).select("id", score.cast("int").alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query("relevance_ranking", "T12 Q7", f"WITH {NODES_SQL} SELECT id, round(CASE WHEN lower(name) = 'order 7' THEN 40 WHEN starts_with(lower(name), 'order 7') THEN 32 ELSE least(28, 8 * (CASE WHEN list_contains(regexp_split_to_array(lower(concat_ws(' ', name, file)), '[^a-z0-9_$-]+'), 'order') THEN 1 ELSE 0 END + CASE WHEN list_contains(regexp_split_to_array(lower(concat_ws(' ', name, file)), '[^a-z0-9_$-]+'), '7') THEN 1 ELSE 0 END)) END + 18 + 20.0, 4)::DOUBLE AS score FROM nodes WHERE kind = 'endpoint'")
def relevance_ranking(t: Tables) -> DataFrame:
    n = fx.nodes(t).where("kind = 'endpoint'").withColumn("confidence", F.lit(1.0))
    return n.select("id", F.round(search.relevance("order 7"), 4).alias("score"))


@query("target_resolution", "T14 J10", f"""WITH {NODES_SQL}, x AS (SELECT id, name, kind || '.' || name AS qualified FROM nodes), w AS (SELECT DISTINCT unnest([id, upper(qualified), name, name || '?']) AS wanted FROM x),
 c AS (SELECT wanted, 0 AS tier, id FROM w JOIN x ON id = wanted UNION ALL SELECT wanted, 1, id FROM w JOIN x ON lower(qualified) = lower(wanted) UNION ALL SELECT wanted, 2, id FROM w JOIN x ON lower(name) = lower(wanted)),
 g AS (SELECT wanted, tier, count(*) AS n, min(id) AS id FROM c GROUP BY wanted, tier QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY tier) = 1)
 SELECT w.wanted, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN n = 1 THEN id END AS id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM w LEFT JOIN g USING (wanted)""")
def target_resolution(t: Tables) -> DataFrame:
    """Ids, qualified names in other letters, names, and names that nothing has."""
    n = fx.nodes(t).withColumn("qualified_name", F.concat_ws(".", "kind", "name"))
    asked = n.select(F.explode(F.array("id", F.upper("qualified_name"), "name", F.concat("name", F.lit("?")))).alias("wanted"))
    return search.resolve_target(n, asked)


@query("answer_with_claims", "T15 Q26")
def answer_with_claims(t: Tables) -> DataFrame:
    """Claims about the best matches of a question, each with the document that carries it; a question without matches abstains."""
    found = search.bm25(t.documents, "doc_id", "text", _questions(t))
    w = Window.partitionBy("query").orderBy("score", "doc")
    top = found.withColumn("n", F.row_number().over(w)).where("n <= 3").join(t.documents.select(F.col("doc_id").alias("doc"), "source", "lang"), "doc")
    claim = F.format_string("document %d of %s answers with score %.3f", "doc", "source", -F.col("score"))
    asked = t.benchmark.select(F.col("item_id").alias("query"))
    return asked.join(top.select("query", "n", claim.alias("claim"), F.col("doc").alias("evidence")), "query", "left").select("query", "n", F.coalesce("claim", F.lit("no evidence")).alias("claim"), "evidence")
