"""Full-text retrieval over postings: BM25, prefixes, exact and substring matches, and their union."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import identifier_terms, query_terms, words
from tessera.model import SEARCHABLE
from tessera.operators.lineage import cut

K1, B = 1.2, 0.75
# Words that a question may hold without meaning anything.
STOP_WORDS = ("a", "an", "and", "are", "does", "find", "for", "from", "how", "in", "is", "of", "on", "show", "the", "to", "what", "where", "which", "with")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, term, tf, length) of every text; terms are aggregated in each text before anything moves."""
    terms = docs.select(F.col(key).alias("doc"), words(F.col(text)).alias("w"))
    return terms.select("doc", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("doc", "term", "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame) -> DataFrame:
    """(query, doc, score) for ``queries`` (query, term): Okapi BM25, scores falling with relevance as ranks do (negated).

    Texts are split twice and never shuffled whole: once for the number and mean length of texts, once for the terms. Only occurrences of asked terms
    are counted and moved; they carry the length of their text. Each asked term's document frequency is an aggregate of those counts."""
    w = words(F.col(text))
    totals = docs.select(F.size(w).alias("l")).agg(F.count_if(F.col("l") > 0).alias("n"), F.sum("l").alias("sum"))
    asked = queries.select("term").distinct()
    terms = docs.select(F.col(key).alias("doc"), w.alias("w")).select("doc", F.size("w").alias("length"), F.explode("w").alias("term"))
    hits = cut(terms.join(asked, "term", "left_semi").groupBy("term", "doc", "length").agg(F.count("*").alias("tf")))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    j = hits.join(df, "term").join(totals)  # one row on the right
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (F.col("sum") / F.col("n"))))
    return j.select("term", "doc", (idf * norm).alias("s")).join(queries, "term").groupBy("query", "doc").agg((-F.sum("s")).alias("score"))


def question_terms(questions: DataFrame, key: str = "query", text: str = "text") -> DataFrame:
    """(query, term): distinct words, without those that mean nothing unless there are no others."""
    found = query_terms(F.col(text))
    meant = F.filter(found, lambda w: ~w.isin(*STOP_WORDS))
    return questions.select(F.col(key).alias("query"), F.explode(F.when(F.size(meant) > 0, meant).otherwise(found)).alias("term"))


def prefix_terms(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Query terms widened to every term of the index that begins with one. Terms meet by their first two letters."""
    own = index.select("term").distinct().withColumn("_k", F.substring("term", 1, 2))
    asked = queries.withColumnRenamed("term", "prefix").withColumn("_k", F.substring("prefix", 1, 2))
    return own.join(asked, "_k").where(F.startswith("term", F.col("prefix"))).select("query", "term").distinct()


def tiered(rows: DataFrame, query: str, scores: DataFrame | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Searchable rows that hold a word beginning with a word of the query (stop words aside), in five tiers: its name, its qualified name, a name that begins with it, a
    path that holds it, others; in a tier by score (``scores``: id, score; lower is better), certainty, kind, name and id. A query without words looks for
    rows that hold it as it stands, by kind, name and id. Adds ``tier``."""
    rows = rows.where(F.col("kind").isin(*SEARCHABLE))
    q = F.lower(F.lit(query))
    col = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    asked = [w for w in re.findall(r"[\w$-]+", query.lower()) if w not in STOP_WORDS]
    if not asked:
        return substring(rows, query).withColumn("tier", F.lit(4)).orderBy("kind", "name", "id").offset(offset).limit(limit)
    own = F.split(F.concat_ws(" ", col("name"), col("qualified_name"), col("file")), r"[^\p{L}\p{N}_$-]+")
    hit = F.exists(own, lambda w: reduce(lambda x, y: x | y, [F.startswith(w, F.lit(a)) for a in asked]))
    tier = F.when(col("name") == q, 0).when(col("qualified_name") == q, 1).when(F.startswith(col("name"), q), 2).when(F.contains(col("file"), q), 3).otherwise(4)
    found = rows.where(hit).withColumn("tier", tier)
    found = found.withColumn("score", F.lit(0.0)) if scores is None else found.join(scores.select("id", "score"), "id", "left")
    return found.orderBy("tier", F.col("score").asc_nulls_last(), F.desc("confidence"), "kind", "name", "id").offset(offset).limit(limit)


ROUTE = r"(/[A-Za-z0-9_~!$&'()*+,;=:@%./{}-]*)"


def route_hash(path: Column) -> Column:
    return F.sha2(F.concat(F.lit("route:"), path), 256)


def by_route(queries: DataFrame, routes: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """(query, id, route): routes that a path in the query's text names. ``queries``: query, text; ``routes``: id, path; ``prefixes``: id, effective_path (what a route is
    called below its mounts). Paths meet by their hashes, so whole routes match and nothing is compared with everything."""
    asked = queries.select("query", F.regexp_extract("text", ROUTE, 1).alias("route")).where("route <> ''").withColumn("_h", route_hash(F.col("route")))
    known = routes.select("id", route_hash(F.col("path")).alias("_h"))
    if prefixes is not None:
        known = known.unionByName(prefixes.select("id", route_hash(F.col("effective_path")).alias("_h")))
    return asked.join(known.distinct(), "_h").select("query", "id", "route")


def resolve_target(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, status, id, n): the id itself, else the only row of that qualified name, else the only one of that name, case aside; several
    rows of the first of these that has any are ambiguous and counted."""
    keys = [("id", F.col("id")), ("qualified_name", F.lower("qualified_name")), ("name", F.lower("name"))]
    known = reduce(DataFrame.unionByName, [rows.select(F.lit(i).alias("_tier"), key.alias("_key"), "id").where("_key IS NOT NULL") for i, (_, key) in enumerate(keys)])
    known = known.groupBy("_tier", "_key").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    asked = wanted.select("wanted").distinct()
    tried = reduce(DataFrame.unionByName, [asked.select("wanted", F.lit(i).alias("_tier"), (F.col("wanted") if i == 0 else F.lower("wanted")).alias("_key")) for i in range(3)])
    best = tried.join(known, ["_tier", "_key"]).groupBy("wanted").agg(F.min_by(F.struct("n", "id"), "_tier").alias("b"))
    out = asked.join(best, "wanted", "left")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("b.n") > 1, "ambiguous").otherwise("resolved")
    return out.select("wanted", status.alias("status"), F.when(status == "resolved", F.col("b.id")).alias("id"), F.coalesce("b.n", F.lit(0)).cast("long").alias("n"))


def exact(rows: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Rows whose name, qualified name or file is the query, case aside; rank -1000."""
    q = F.lower(F.lit(query))
    name, qualified, file = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "qualified_name", "file"))
    order = F.when(name == q, 0).when(qualified == q, 1).otherwise(2)
    return rows.where((name == q) | (qualified == q) | (file == F.replace(q, F.lit("\\"), F.lit("/")))).select("*", F.lit(-1000.0).alias("rank"), order.alias("tier")).orderBy("tier", "id").limit(limit)


def substring(rows: DataFrame, query: str) -> DataFrame:
    q = F.lower(F.lit(query))
    hit = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), q)
    return rows.where(hit("name") | hit("qualified_name") | hit("file"))


def best_rank(*found: DataFrame) -> DataFrame:
    """The union of results (id, rank, match), each id once, at its best rank."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    w = Window.partitionBy("id").orderBy("rank", "match")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# What a kind is worth in a search.
KIND_WEIGHT = {"endpoint": 80, "function": 70, "method": 68, "class": 64, "interface": 56, "database_model": 56, "module": 48, "file": 44, "domain": 42, "feature": 40, "test": 12, "variable": 0}


def lexical_score(needle: str, scope: Column | None = None) -> Column:
    """How well a row (kind, name, qualified_name, file, search_text) answers a query; 0 if it does not."""
    q = needle.strip().lower()
    col = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    name, qualified, file, text = col("name"), col("qualified_name"), col("file"), col("search_text")
    n = F.lit(q)
    terms = identifier_terms(n)
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_WEIGHT.items() for x in kv]), F.col("kind")), F.lit(24))
    whole = F.when(name == n, 1000).when(qualified == n, 900).when(F.startswith(name, n), 500).when(F.startswith(qualified, n), 400).when(F.contains(name, n), 300).when(F.contains(qualified, n), 220).when(F.contains(file, n), 100).otherwise(0)
    each = F.aggregate(terms, F.lit(0), lambda s, t: s + F.when(name == t, 90).when(F.contains(name, t), 45).when(F.contains(qualified, t), 28).when(F.contains(file, t), 16).when(F.contains(text, t), 6).otherwise(0))
    s = F.lit("production") if scope is None else scope
    spared = any(w in q for w in ("test", "fixture", "example"))
    place = F.when(s == "production", 60).when(s == "configuration", 20).otherwise(0 if spared else -120)
    found = F.contains(text, n) | F.exists(terms, lambda t: F.contains(text, t))
    return F.when(F.lit(q != "") & found, kind + whole + each + place).otherwise(0)


# What a kind is worth near an anchor.
RELEVANCE_KIND = {
    "repository": 2, "package": 5, "directory": 3, "module": 8, "file": 7, "class": 14, "interface": 12, "function": 15, "method": 15, "variable": 6, "api_route": 18, "endpoint": 18,
    "database_model": 17, "database_table": 15, "configuration": 8, "documentation": 9, "external_service": 13, "external_actor": 12, "service": 17, "process": 12,
    "http_contract": 18, "contract_schema": 15, "contract_drift": 19, "job": 12, "datastore": 16, "environment_variable": 10, "configuration_key": 10, "test": 10,
    "feature": 18, "domain": 12, "event": 13, "queue": 13, "topic": 13,
}


def relevance(query: str, distance: Column | None = None, strength: Column | None = None, member: Column | None = None, qualified: Column | None = None) -> Column:
    """Similarity to a query, kind, certainty, feature membership, distance to an anchor and strength of the direct link."""
    q = query.strip().lower()
    name, file, qualified = F.lower("name"), F.lower(F.coalesce("file", F.lit(""))), F.lit("") if qualified is None else F.lower(F.coalesce(qualified, F.lit("")))
    own = F.split(F.concat_ws(" ", name, qualified, file), r"[^\p{L}\p{N}_$-]+")
    asked = F.split(F.lit(q), r"[^\p{L}\p{N}_$-]+")
    overlap = F.size(F.filter(asked, lambda w: F.array_contains(own, w) & (w != "")))
    similar = F.when((name == q) | (qualified == q), 40).when(F.startswith(name, F.lit(q)), 32).otherwise(F.least(F.lit(28), overlap * 8 + F.when(F.contains(file, F.lit(q)) | F.contains(qualified, F.lit(q)), 8).otherwise(0)))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RELEVANCE_KIND.items() for x in kv]), F.col("kind")), F.lit(9))
    out = (similar if q else F.lit(0)) + kind + F.coalesce("confidence", F.lit(1.0)) * 20
    if member is not None:
        out = out + F.when(member, 8).otherwise(0)
    if distance is not None:
        out = out + F.when(distance.isNull(), 0.0).otherwise(20 / F.greatest(F.lit(1), distance))
    return out + (F.coalesce(strength, F.lit(0.0)) * 12 if strength is not None else F.lit(0.0))
