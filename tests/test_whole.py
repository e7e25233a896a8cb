"""Queries on hand-made tables: whole texts, all questions, all seeds."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.fixtures import Tables
from tessera.functions import text
from tessera.operators import diff, resolve
from tessera.plans.registry import COVERS, ORACLES, QUERIES


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_markdown_of_whole_texts(spark, tmp_path):
    long = "word " * 100
    rows = [(1, "plain"), (2, f"{long}\n# Late\n{long}\nStatus: done\n## Later\n"), (3, f"{long}\n**Context**: why\n"), (4, None)]
    path = table(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_sections, r.n_fields) for r in QUERIES["markdown_sections"](spark, path).collect()}
    assert got == {1: (2, 1), 2: (5, 1), 3: (4, 2), 4: (1, 0)}


DOCS = [(1, "red apple pie"), (2, "green apple apple tree"), (3, "blue sky over red barn"), (4, "quiet pond")]


def corpus(spark, folder):
    table(spark, folder, "documents", [(i, x, "en", "web") for i, x in DOCS], "doc_id long, text string, lang string, source string")
    return table(spark, folder, "benchmark", [(1, "red apple"), (13, "the sky"), (27, "zebra"), (40, "pond")], "item_id long, text string")


def test_every_question_and_every_term(spark, tmp_path):
    path = corpus(spark, tmp_path)
    words = {i: x.split() for i, x in DOCS}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for q, terms in {1: ["red", "apple"], 13: ["sky"], 27: ["zebra"], 40: ["pond"]}.items():
        for i, w in words.items():
            score = 0.0
            for x in set(terms) & set(w):
                df, tf = sum(x in v for v in words.values()), w.count(x)
                score -= math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if score:
                want[q, i] = round(score, 4)
    got = QUERIES["bm25_search"](spark, path).collect()
    assert {(r.query, r.doc): r.score for r in got} == pytest.approx(want, abs=2e-4)
    terms = Counter(x for w in words.values() for x in w)
    assert {r.term: r.cf for r in QUERIES["postings"](spark, path).collect()} == terms
    claims = {(r.query, r.evidence) for r in QUERIES["answer_with_claims"](spark, path).collect()}
    assert claims == {*want, (27, None)}


def test_page_of_large_ids(spark, tmp_path):
    path = table(spark, tmp_path, "documents", [(9000 + i, "x" * 60_000) for i in range(4)], "doc_id long, text string")
    assert [r.doc_id for r in QUERIES["page_by_bytes"](spark, path).collect()] == [9000]


def test_every_supplier_is_a_seed(spark, sf_dir):
    got = QUERIES["bounded_bfs"](spark, sf_dir).select("seed").distinct().count()
    assert got == spark.read.parquet(f"{sf_dir}/supplier.parquet").count() > 5


def test_import_distance_up_to_twelve(spark):
    chain = [(f"a/f{i:02d}", f"a/f{i + 1:02d}") for i in range(14)]
    links = spark.createDataFrame([*chain, ("a/f00", "b/x")], "source_file string, target_file string")
    cands = ["a/f03", "a/f12", "a/f13", "b/none", "b/x", "a/none"]
    pairs = spark.createDataFrame([("a/f00", c) for c in cands] + [("c/alone", "b/x")], "ref string, cand string")
    got = sorted((r.ref, r["rank"], r.cand, r.distance, r.confidence) for r in resolve.by_import_distance(links, pairs).collect())
    assert [x[2:4] for x in got[:6]] == [("b/x", 1), ("a/f03", 3), ("a/f12", 12), ("a/f13", 20), ("a/none", 20), ("b/none", 20)]
    assert [x[4] for x in got[:6]] == [0.46, 0.38, 0.2, 0.2, 0.2, 0.2] and got[6:] == [("c/alone", 1, "b/x", 20, 0.35)]


def test_task_subgraph_goes_two_hops(spark, sf_dir):
    rows = lambda name: {r.type: r.n_edges for r in QUERIES[name](spark, sf_dir).collect()}
    t = Tables(spark, sf_dir)
    edges = [(r.source, r.target, r.type) for r in fx.edges(t).collect()]
    near = {f"part:{r.p_partkey}" for r in t.part.where("p_size = 7").collect()}
    for _ in range(2):
        near = near | {b for a, b, _ in edges if a in near} | {a for a, b, _ in edges if b in near}
    want = Counter(kind for a, b, kind in edges if a in near and b in near)
    assert rows("task_subgraph") == want


def test_long_rename_chains(spark):
    rows = [(f"p{i:02d}", f"p{i + 1:02d}", 0.9) for i in range(15)] + [("x", "y", 0.9), ("y", "x", 0.9), ("y", "z", 0.9)]
    got = sorted((r.previous, r.path) for r in diff.rename_chains(spark.createDataFrame(rows, "previous string, path string, similarity double")).collect())
    assert got == [(f"p{i:02d}", "p15") for i in range(15)] + [("x", "y"), ("x", "z"), ("y", "x"), ("y", "z")]


def test_routes_see_words_as_their_sql_does(spark, tmp_path):
    """Letters of other scripts, marks, the long s, the Kelvin sign and line separators beside and within words."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["étest", "testé", "テtestス", "test\u0301", "te\u0301st", "٠test", "teſt", "a teſts", "teſtſ", "aſupport", "ſupport", "bro\u212aen", "İmplement", "ımplement", "x_test", "test1", "TESTS", "", None, "how\u2028x reaches", "how\rx reaches", "how\nx reaches"]
    path = table(spark, tmp_path, "conversations", [(i, 0, "user", x) for i, x in enumerate(texts)], "conv_id long, turn int, role string, text string")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{path}/conversations.parquet/*.parquet'")
    for name in ("intent_routing", "intent_routing_operations"):
        assert sorted(map(tuple, QUERIES[name](spark, path).collect())) == sorted(con.execute(ORACLES[name]).fetchall())
    got = {r.text: r.n for r in spark.createDataFrame([(x,) for x in texts], "text string").select("text", F.coalesce(text.task_class(F.col("text")), F.lit("")).alias("n")).collect()}
    want = {x: con.execute(ORACLES["intent_routing"].replace("FROM conversations", "FROM (SELECT CAST(? AS VARCHAR) AS text)"), [x]).fetchone()[0] for x in texts}
    assert got == want


def most_rows(df):
    """Collects a DataFrame; its rows, and the most rows that any step of its plan put out."""
    rows, most = df.collect(), 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
            continue
        if plan.metrics().contains("numOutputRows"):
            most = max(most, plan.metrics().apply("numOutputRows").value())
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return rows, most


def test_a_reference_meets_no_more_candidates_than_it_keeps(spark, tmp_path):
    table(spark, tmp_path, "events", [(i, ("click", "view", "buy")[i % 3]) for i in range(60)], "event_id long, event_type string")
    path = table(spark, tmp_path, "part", [(i, f"Brand#{i % 2 * 3}", 10 if i < 7 else 48 + i % 3) for i in range(400)], "p_partkey long, p_brand string, p_size int")
    refs = Tables(spark, path).events.selectExpr("event_id AS ref", "CASE event_type WHEN 'click' THEN 'call' WHEN 'view' THEN 'reference' ELSE 'import' END AS kind")
    part = Tables(spark, path).part
    t1 = refs.join(part.where("p_size < 20"), F.expr("p_partkey = ref % 2500")).selectExpr("ref", "concat('part:', p_partkey) AS candidate", "0 AS distance")
    t2 = refs.join(part.where("p_size > 47"), F.expr("p_brand = concat('Brand#', ref % 30)")).selectExpr("ref", "concat('brand:', p_partkey) AS candidate", "p_size % 12 AS distance")
    plain = resolve.resolve(refs, [("binding", t1, True), ("named", t2, False)])
    got, most = most_rows(QUERIES["reference_resolution"](spark, path))
    assert {tuple(r) for r in got} == {(r.ref, r.tier, r.candidate, r.confidence) for r in plain.collect()} and len(got) == plain.count()
    assert most <= 400  # all candidates of all references would be 800
    edges, issues = resolve.edges_and_issues(plain)
    count = lambda df, *by: {tuple(r) for r in df.groupBy(*by).count().collect()}
    assert {tuple(r) for r in QUERIES["resolved_edges"](spark, path).collect()} == count(edges, "type")
    assert {tuple(r) for r in QUERIES["resolution_issues"](spark, path).collect()} == count(issues, "reason", "kind")
