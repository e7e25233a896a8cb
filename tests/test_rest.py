"""Pages, codecs, paths, texts, storage, changes, resolution, sources and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import diff, pages, resolve, search, stats, storage, validate
from tessera.sources import adapters, gitlog, sinks
from tessera.streaming.watch import watch, windowed_counts


def column(spark, values, name="v", kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def test_cursor():
    c = pages.encode_cursor(40, "search:x", "f1")
    assert pages.decode_cursor(c, "search:x", "f1") == 40 and pages.decode_cursor(None, "s", "f") == 0
    for bad in ((c, "search:y", "f1"), (c, "search:x", "f2"), ("%%%", "search:x", "f1")):
        with pytest.raises(pages.StaleCursor):
            pages.decode_cursor(*bad)


def test_pages_cover_everything(spark):
    df, seen, cursor = spark.range(23), [], None
    while True:
        rows, cursor = pages.page(df, [F.col("id")], 10, cursor, "all", "f")
        seen += [r.id for r in rows.collect()]
        if cursor is None:
            break
    assert seen == list(range(23))


def test_budget_takes_back_what_does_not_fit():
    items = [{"id": f"i{k}", "priority": k, "text": "x" * (10 if k != 1 else 500), "evidence": {"e0": "shared", f"e{k}": "own"}} for k in range(6)]
    out = pages.fit_to_budget(items, 400)
    assert len(json.dumps(out, separators=(",", ":")).encode()) <= 430 and "i1" not in [i["id"] for i in out["items"]] and out["omitted"] >= 1
    assert set(out["evidence"]) == {e for i in out["items"] for e in i["evidence_ids"]}
    with pytest.raises(ValueError):
        pages.fit_to_budget(items, 5)


def test_compact_round_trip():
    records = [{"a": "x", "b": 1}, {"a": "x", "c": None}, {}, {"b": [1, {"k": "v"}], "a": "y"}]
    packed = pages.compact(records)
    assert pages.expand(json.loads(json.dumps(packed))) == records and packed["strings"] == ["x", "y"]
    with pytest.raises(ValueError):
        pages.expand({**packed, "rows": [[{"s": 99}, None, None]]})


def test_scopes_and_languages(spark):
    want = {"src/a.ts": "production", "tests/fixtures/a.ts": "fixture", "examples/a.ts": "example", "app/src/main/java/com/example/A.java": "production", "src/a.test.ts": "test", "test_a.py": "test", "dist/a.js": "generated", "docs/a.ts": "documentation", "README.md": "documentation", "scripts/a.sh": "tooling", "benchmark.js": "tooling", "package.json": "configuration", ".github/w": "configuration", "": "unknown", None: "unknown"}
    got = {r.v: r.s for r in column(spark, list(want)).select("v", paths.scope(F.col("v")).alias("s")).collect()}
    assert got == want
    assert [r.l for r in column(spark, ["a.TS", "a/b.py", "x", None]).select(paths.language(F.col("v")).alias("l")).collect()] == ["typescript", "python", None, None]


def test_globs_and_ignores(spark):
    df = column(spark, ["a/b.ts", "a/c/d.ts", "x.key", "node_modules/x/y.js", "src/.env.local", "a/keep.key"])
    assert [r.v for r in df.where(paths.glob_filter(F.col("v"), ["a/*.{ts,js}", "**/d.ts"], ["a/c/**"])).collect()] == ["a/b.ts"]
    assert [r.v for r in df.where(paths.ignored(F.col("v"), ("node_modules/", "*.key", ".env.*", "!/a/keep.key"))).collect()] == ["x.key", "node_modules/x/y.js", "src/.env.local"]


def test_texts(spark):
    df = column(spark, ["getUserName user_id", None, ""])
    assert [sorted(r.t or []) for r in df.select(text.identifier_terms(F.col("v")).alias("t")).collect()][0] == ["get", "getusername", "id", "name", "user", "user_id"]
    long = "é" * 50 + "🙂" * 20
    cut = column(spark, [long, "short", None]).select(text.byte_cut(F.col("v"), 101).alias("c")).collect()
    assert len(cut[0].c.encode()) <= 101 and cut[0].c.endswith("…") and long.startswith(cut[0].c[:-1]) and len(cut[0].c) >= 49 and cut[1].c == "short" and cut[2].c is None


def test_search(spark):
    docs = spark.createDataFrame([(1, "payment service pays"), (2, "payment payment order"), (3, "nothing here")], "doc long, text string")
    idx = search.postings(docs, "doc", "text")
    docs = docs.withColumnRenamed("doc", "key")
    q = search.question_terms(spark.createDataFrame([("q", "where is the payment")], "query string, text string"))
    assert [r.term for r in q.collect()] == ["payment"]
    got = {r.doc: r.score for r in search.bm25(docs, "key", "text", q).collect()}
    assert set(got) == {1, 2} and got[2] < got[1] < 0
    assert {r.term for r in search.prefix_terms(idx, spark.createDataFrame([("q", "pay")], "query string, term string")).collect()} == {"payment", "pays"}
    rows = spark.createDataFrame([("f", "file", "payment.ts", None, "src/payment.ts", "src/payment.ts payment"), ("g", "function", "pay", "a.pay", "src/a.ts", "pay")], "id string, kind string, name string, qualified_name string, file string, search_text string")
    assert [(r.id, r.rank) for r in search.exact(rows, "SRC\\payment.ts").collect()] == [("f", -1000.0)]
    score = {r.id: r.s for r in rows.select("id", search.lexical_score("pay").alias("s")).collect()}
    assert score["g"] == 70 + 1000 + 90 + 60 and 0 < score["f"] < score["g"]


def test_storage(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t1")], "id long, v string, created_at string")
    new = spark.createDataFrame([(2, None, "t2"), (3, "c", "t2")], "id long, v string, created_at string")
    assert sorted(tuple(r) for r in storage.upsert(old, new, ["id"]).collect()) == [(1, "a", "t1"), (2, None, "t1"), (3, "c", "t2")]
    path = f"file://{tmp_path}/t"
    storage.replace_all(old, path)
    before = storage.read_current(spark, path)
    storage.replace_all(new, path)
    assert before.count() == 2 and {r.id for r in storage.read_current(spark, path).collect()} == {2, 3}


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "4")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("x", "3"), ("y", "4")], "path string, hash string")
    got = {(r.path, r.previous, r.kind) for r in diff.file_changes(old, new).collect()}
    assert got == {("b", None, "modified"), ("x", "c", "renamed"), ("y", None, "added"), ("d", None, "deleted"), ("e", None, "deleted")}
    chains = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("x", "y", 0.9), ("y", "x", 0.9), ("p", "q", 0.3), ("m", "o", 0.9), ("n", "o", 0.9)], "previous string, path string, similarity double")
    assert {(r.previous, r.path) for r in diff.rename_chains(chains).collect()} == {("a", "c"), ("b", "c"), ("x", "y"), ("y", "x")}


def test_resolution(spark):
    refs = spark.createDataFrame([(1, "call"), (2, "call"), (3, "reference"), (4, "call")], "ref long, kind string")
    t1 = spark.createDataFrame([(1, "f", 0)], "ref long, candidate string, distance int")
    t2 = spark.createDataFrame([(1, "z", 1), (2, "g", 1), (2, "h", 2), (3, "g", 1), (3, "h", 1)], "ref long, candidate string, distance int")
    got = resolve.resolve(refs, [("exact", t1, True), ("named", t2, False)])
    assert {(r.ref, r.candidate, r.confidence) for r in got.collect()} == {(1, "f", 1.0), (2, "g", 0.66), (2, "h", 0.62), (3, "g", 0.66), (3, "h", 0.66), (4, None, None)}
    edges, issues = resolve.edges_and_issues(got)
    assert {(r.ref, r.target) for r in edges.collect()} == {(1, "f"), (2, "g"), (2, "h")}
    assert {(r.ref, r.reason) for r in issues.collect()} == {(2, "multi_candidate"), (3, "multi_candidate"), (4, "unresolved")}
    df = spark.createDataFrame([("./b", "src/a/x.ts"), ("../c", "src/a/x.ts")], "s string, i string")
    assert [r.c[1] for r in df.select(resolve.module_candidates(F.col("s"), F.col("i"), "typescript").alias("c")).collect()] == ["src/a/b.ts", "src/c.ts"]
    py = spark.createDataFrame([("..m.n", "p/q/r.py"), ("a.b", "p/q/r.py")], "s string, i string")
    assert [r.c[0] for r in py.select(resolve.module_candidates(F.col("s"), F.col("i"), "python").alias("c")).collect()] == ["p/m/n.py", "a/b.py"]


def test_statistics(spark):
    w = spark.range(1).select(stats.wilson(F.lit(8.0), F.lit(10.0)).alias("w"), stats.wilson(F.lit(0.0), F.lit(0.0)).alias("z")).first()
    assert w.w.low == pytest.approx(0.4902, abs=1e-4) and w.w.high == pytest.approx(0.9433, abs=1e-4) and w.z is None
    rows = spark.createDataFrame([("g", f"c{i % 10}", float(i % 3)) for i in range(100)], "by string, cluster string, v double")
    b = stats.clustered_bootstrap(rows, "cluster", "v", "by").first()
    assert b.low <= b["mean"] <= b.high


def test_integrity(spark):
    nodes = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("1", "a", "b", 1.0), ("2", "a", "x", 1.5)], "id string, source string, target string, confidence double")
    assert {r.code for r in validate.integrity(nodes, edges, {"edges": 2}).collect()} == {"duplicate_node", "dangling_target", "confidence_range"}


def test_git_texts(spark):
    log = spark.createDataFrame(list(enumerate(["@ab12|Ann|2026-01-02", "", "3\t1\tsrc/a.ts", "-\t-\tpic.png", "@cd34|Bo|2026-01-03", "0\t9\tsrc/a.ts"])), "n long, value string")
    assert [tuple(r) for r in gitlog.numstat_log(log).orderBy("commit", "file").collect()] == [("ab12", "Ann", "2026-01-02", "pic.png", 0, 0), ("ab12", "Ann", "2026-01-02", "src/a.ts", 3, 1), ("cd34", "Bo", "2026-01-03", "src/a.ts", 0, 9)]
    names = column(spark, ["M\0a\0R087\0b\0c\0D\0d\0"]).select(F.explode(gitlog.name_status(F.col("v"))).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in names] == [("M", None, None, "a"), ("R", 87, "b", "c"), ("D", None, None, "d")]
    assert [tuple(r) for r in gitlog.porcelain(column(spark, [" M a.ts", "R  b -> c", "?? d"], "value")).collect()] == [("M", None, "a.ts"), ("R", "b", "c"), ("??", None, "d")]
    hunks = column(spark, ["@@ -1,3 +1,0 @@\n-x\n@@ -9 +7,2 @@ f\n+y"]).select(gitlog.changed_ranges(F.col("v")).alias("r")).first().r
    assert [tuple(h) for h in hunks] == [(1, 3, 1, 1), (9, 9, 7, 8)]


def test_long_name_status_lists(spark):
    """One list of 60,000 entries in seconds; empty cells and an entry that is cut off at the end count for nothing."""
    long = "".join(f"R{i % 100:03d}\0a{i}\0b{i}\0" if i % 3 == 0 else f"M\0Rc{i}\0" for i in range(60_000))
    begun = time.monotonic()
    got = column(spark, [long]).select(F.explode(gitlog.name_status(F.col("v"))).alias("r")).select("r.*").collect()
    assert time.monotonic() - begun < 30
    assert len(got) == 60_000 and tuple(got[3]) == ("R", 3, "a3", "b3") and tuple(got[59_999]) == ("M", None, None, "Rc59999")
    odd = {"\0\0M\0\0a\0R087\0b": [("M", None, None, "a")], "C1x\0é\n": [], "": [], None: None, "A\0x\0D": [("A", None, None, "x")]}
    for r in column(spark, list(odd)).select("v", gitlog.name_status(F.col("v")).alias("r")).collect():
        assert (r.r and [tuple(x) for x in r.r]) == odd[r.v]
    copy = column(spark, ["C1x\0é\n\0ü\0"]).select(F.explode(gitlog.name_status(F.col("v"))).alias("r")).select("r.*").collect()
    assert [tuple(x) for x in copy] == [("C", None, "é\n", "ü")]


def test_adapters_isolate_failures(spark):
    take_away = adapters.register("broken", lambda p: True, lambda p, t: 1 / 0)
    files = spark.createDataFrame([("a.py", "import os\n\ndef f(x):\n    return g(x)\n"), ("b.py", "def ("), ("c.prisma", "model User {\n  id Int\n  posts Post[]\n}\n"), ("d.asyncapi.json", '{"asyncapi": "2.0", "channels": {"t": {"publish": {"operationId": "p"}}}}'), (None, "x")], "path string, text string")
    rows = adapters.merged(adapters.extract(files)).collect()
    take_away()
    assert sum(r.adapter == "broken" and r.row_kind == "error" for r in rows) == 4
    assert {(r.kind, r.name) for r in rows if r.file == "a.py" and r.row_kind == "node"} == {("module", "a"), ("function", "f")}
    assert any(r.file == "b.py" and r.row_kind == "error" and r.kind == "SyntaxError" for r in rows)
    assert {(r.kind, r.target) for r in rows if r.file == "c.prisma"} >= {("database_model", None), ("REFERENCES", "Post")}
    assert {(r.kind, r.name) for r in rows if r.file == "d.asyncapi.json" and r.adapter == "asyncapi"} == {("topic", "t"), ("PUBLISHES", "t")}


def test_comments_do_not_change_a_fingerprint():
    a, b = (list(adapters.fingerprint_tokens("x.py", t)) for t in ("x = 1  # one\n\n", "x  =  1\n"))
    assert a[0][2] == b[0][2]


def test_file_scan(spark, tmp_path):
    for name in ("src/a.py", "node_modules/x.js", ".env"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [(r.path, r.text, r["size"]) for r in adapters.files(spark, f"file://{tmp_path}").collect()] == [("src/a.py", "x", 1)]


def test_exports(spark, tmp_path):
    manifest = sinks.export_bundle({"nodes": spark.range(2500).coalesce(1)}, f"file://{tmp_path}/b").collect()
    assert sorted(r.rows for r in manifest) == [500, 1000, 1000] and all(len(r.sha256) == 64 for r in manifest)
    assert "| a |" in sinks.markdown("T", {"S": [{"a": "x|y"}], "E": []}) and sinks.mermaid([("a", "b", "CALLS")] * 3, 2).endswith("%% 1 more")


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("max_depth: 4\nignore:\n  - a/\n  - 'b'\n")
    c = sinks.load_config(str(tmp_path / "c.yaml"), {"TESSERA_FAN": "3"})
    assert (c.max_depth, c.fan, c.ignore) == (4, 3, ["a/", "b"])
    (tmp_path / "d.json").write_text('{"nonsense": 1}')
    with pytest.raises(ValueError):
        sinks.load_config(str(tmp_path / "d.json"), {})


def test_watch_equals_batch(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = spark.createDataFrame([(i % 5, i) for i in range(40)], "id long, version long")
    for part in range(2):
        rows.where(F.col("version") % 2 == part).write.mode("append").parquet(f"{at}/source")
        watch(spark, "id long, version long", f"{at}/source", f"{at}/target", ["id"], f"{at}/ck", once=True).awaitTermination()
    got = {r.id for r in storage.read_current(spark, f"{at}/target").collect()}
    assert got == set(range(5))
    ts = spark.createDataFrame([("2026-01-01 00:01:00", "a"), ("2026-01-01 00:09:00", "a"), ("2026-01-01 00:11:00", "a")], "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in windowed_counts(ts, "ts", "k").collect()) == [1, 2]
