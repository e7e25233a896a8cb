"""Tasks, symbols, answers, generations, caches, control flow and resolution on small inputs."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import context, generations, resolve, search
from tessera.sources import adapters


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def test_routes(spark):
    asked = {"rename the parser": "prepare_change", "Trace how a request reaches the store": "trace", "how login reaches it": "trace", "prove it": "get_evidence", "where is main": "search", "": "native_fallback", None: "native_fallback", "hello": "native_fallback", "FIX": "prepare_change", "prefix": "native_fallback"}
    got = {r.v: r.o for r in column(spark, list(asked)).select("v", context.route(F.col("v")).alias("o")).collect()}
    assert got == asked


def test_intents(spark):
    task = "Fix the crash in `getUser` behind POST /api/users/{id} in src/auth/login.ts and './lib/x.py', see HttpServer.start for sign-in"
    i = column(spark, [task, None, ""]).select("i", context.intent(F.col("v")).alias("t")).orderBy("i").collect()
    t = i[0].t
    assert t.kind == "bug_fix" and t.endpoints == ["/api/users/{id}"]
    assert {"src/auth/login.ts", "lib/x.py"} <= set(t.files)
    assert "getUser" in t.symbols and not {"src/auth/login.ts", "./lib/x.py", "HttpServer.start"} & set(t.symbols)
    assert "HttpServer.start" in t.files  # a name with a dot may be a file
    assert {"authenticate", "crash", "user"} <= set(t.terms) and not {"the", "in"} & set(t.terms) and len(t.terms) <= 24
    assert i[1].t.kind == "unknown" and i[1].t.terms == [] == i[2].t.files


def edges(spark, pairs):
    rows = [(f"e{i:03d}", a, b, "CALLS", 1.0, "ast") for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id string, source string, target string, type string, confidence double, source_type string")


def test_symbol_context(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("c", "a"), ("a", "a")])
    wanted = spark.createDataFrame([("a",), ("a",), ("z",)], "id string")
    evidence = spark.createDataFrame([("a", f"v{i}") for i in range(5)], "id string, item string")
    got = context.symbol_context(wanted, e, evidence, evidence.limit(0), limit=4).collect()
    assert sorted((r.section, r.position, r.item, r.more) for r in got) == [("evidence", i + 1, f"v{i}", True) for i in range(4)] + [("relationships", i + 1, f"e{i:03d}", False) for i in range(4)]


def test_answer_paths(spark):
    nodes = spark.createDataFrame([("a", "Login route", True), ("b", "token service", False), ("c", "store of users", False), ("d", "nothing", False)], "id string, search_text string, is_entry boolean")
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")])
    starts = spark.createDataFrame([("q", "a")], "query string, id string")
    terms = spark.createDataFrame([("q", ["login", "token", "users"])], "query string, terms array<string>")
    got = sorted(context.answer_paths(nodes, e, starts, terms, (("route", "login"), ("store", "users"))).collect(), key=lambda r: r["rank"])
    assert list(got[0].path) == ["a", "d"] or list(got[0].path)[:2] == ["a", "b"]
    full = next(r for r in got if list(r.path) == ["a", "b", "c"])
    assert full.score == 3 * 180 + 2 * 260 + 4 * 90 + 240 + 2 * 15 and full["rank"] == 1
    assert {tuple(r.path) for r in got} == {("a", "b"), ("a", "b", "c"), ("a", "d")}


def test_change_brief_fits_its_budget(spark):
    nodes = spark.createDataFrame([("n1", "class", "UserStore", "src/user.ts"), ("n2", "function", "save", "src/a.ts"), ("t1", "test", "checks", "tests/u.ts"), ("n3", "class", "Other", "src/o.ts")], "id string, kind string, name string, file string")
    nodes = nodes.withColumn("qualified_name", F.lit(None).cast("string"))
    e = edges(spark, [("n2", "n1"), ("t1", "n1"), ("n3", "n2")])
    tasks = spark.createDataFrame([(1, "change UserStore"), (2, "")], "task int, text string")
    got = sorted(context.change_brief(tasks, nodes, e).collect(), key=lambda r: r.position)
    assert [(r.section, r.item) for r in got] == [("targets", "n1"), ("tests", "t1"), ("affected", "n2")] and {r.task for r in got} == {1} and got[0].kind == "feature"
    small = context.change_brief(tasks, nodes, e, budget=42).collect()
    assert sum(r.bytes for r in small) <= 42 and {r.item for r in small} == {"n1", "n2"}


def test_generations(spark):
    flag = ("graph", "location", "semantic", "search_text", "architecture", "invalidated")
    row = lambda batch, change, full=False, **on: ("r", batch, full, change, *[bool(on.get(f)) for f in flag])
    changes = spark.createDataFrame([row(1, "added", full=True), row(2, "modified"), row(3, "modified", location=True), row(4, "renamed"), row(5, "modified", invalidated=True), row(6, "modified", search_text=True)], "repo string, batch int, full boolean, change string, " + ", ".join(f"{f} boolean" for f in flag))
    got = {r.batch: tuple(r[c] for c in generations.COUNTERS) for r in generations.counters(generations.bumps(changes)).collect()}
    assert got == {1: (1, 1, 1, 1), 2: (1, 1, 1, 1), 3: (2, 1, 1, 1), 4: (3, 1, 2, 2), 5: (3, 2, 2, 3), 6: (3, 2, 3, 3)}
    state = lambda *c: spark.createDataFrame([("r", *c)], "repo string, " + ", ".join(f"{x} int" for x in generations.COUNTERS))
    asked = spark.createDataFrame([(i, "r", q) for i, q in enumerate((*generations.COUNTERS, "all"))] + [(9, "new", "search")], "request int, repo string, requirement string")
    fresh = lambda index: {(r.repo, r.requirement) for r in generations.gate(asked, index, state(3, 2, 3, 3)).collect() if r.fresh}
    assert fresh(state(3, 2, 3, 3)) == {("r", q) for q in (*generations.COUNTERS, "all")}
    assert fresh(state(3, 2, 2, 3)) == {("r", "structural"), ("r", "semantic"), ("r", "architecture")}
    assert fresh(state(2, 2, 3, 3)) == set()


def test_results_are_computed_once(spark):
    name = f"results-{uuid.uuid4().hex}"  # the folder may outlive a session
    cache, calls, out = generations.ResultCache(spark, name), [], []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(1,)], "x int")

    key = cache.key("f", {"search": 1}, {"limit": 2}, "1", "q")
    threads = [threading.Thread(target=lambda: out.append(cache.get(key, compute).collect())) for _ in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(calls) == 1 and len(out) == 4 and all(o == out[0] for o in out)
    assert cache.key("f", {"search": 2}, {"limit": 2}, "1", "q") != key != cache.key("f", {"search": 1}, {"limit": 3}, "1", "q")
    generations.ResultCache(spark, name).get(key, compute)
    assert len(calls) == 1


def test_control_flow_has_branches():
    source = "def f(x):\n    for i in x:\n        if i:\n            break\n        elif g(i):\n            continue\n    while True:\n        try:\n            return 1\n        except E:\n            pass\n    y = 2\n"
    rows = list(adapters.control_flow("a.py", source))
    edges_ = {(r[3], r[1], r[6]) for r in rows if r[0] == "cfg_edge"}
    after = lambda n: {e[2] for e in edges_ if e[0].startswith(n)}
    assert after("branch@3") == {"break@4:12", "branch@5:8"} and after("continue") == {"loop@2:4"} and after("break") == {"loop@7:4"}
    assert after("loop@2") == {"branch@3:8", "loop@7:4"} and after("loop@7") == {"try@8:8"}  # an endless loop is left by return only
    assert after("try") == {"return@9:12", "loop@7:4"} and after("return") == {"exit"}
    cut = [r for r in adapters.control_flow("a.py", "def f(x):\n" + "    if x: g()\n" * 90, max_nodes=10) if r[0] == "cfg_node"]
    assert len(cut) == 12 and cut[-2][1] == "truncated"


def test_redaction(spark):
    cases = {"f(a = 'it\\'s', b = \"x\", c=`y`)": "f(a = <literal>, b = <literal>, c=<literal>)", "f(1.5,  22)": "f(0.0, 0)", "open 'never": "open <literal>", None: None, "": "", "x" * 70000 + "'" + "y" * 70000 + "'": "x" * 70000 + "<literal>"}
    got = {r.v: r.s for r in column(spark, list(cases)).select("v", text.redacted(F.col("v")).alias("s")).collect()}
    assert got == cases


def test_tiers_of_search_and_targets(spark):
    rows = spark.createDataFrame([("1", "function", "pay", "a.pay", "src/a.ts"), ("2", "function", "payment", "pay", "src/b.ts"), ("3", "function", "x", None, "src/pay.ts"), ("4", "repository", "pay", None, None), ("5", "class", "Pay", "b.Pay", "src/c.ts")], "id string, kind string, name string, qualified_name string, file string").withColumn("confidence", F.lit(1.0))
    assert [(r.id, r.tier) for r in search.tiered(rows, "PAY").collect()] == [("5", 0), ("1", 0), ("2", 1), ("3", 3)]
    assert [r.id for r in search.tiered(rows, "the ./").collect()] == []
    wanted = spark.createDataFrame([("1",), ("A.PAY",), ("pay",), ("payment",), ("none",)], "wanted string")
    got = {r.wanted: (r.status, r.id, r.n) for r in search.resolve_target(rows, wanted).collect()}
    assert got == {"1": ("resolved", "1", 1), "A.PAY": ("resolved", "1", 1), "pay": ("resolved", "2", 1), "payment": ("resolved", "2", 1), "none": ("missing", None, 0)}
    routes = spark.createDataFrame([("r1", "/users"), ("r2", "/login")], "id string, path string")
    below = spark.createDataFrame([("r2", "/api/login")], "id string, effective_path string")
    asked = spark.createDataFrame([("q1", "who serves /api/login now"), ("q2", "/users"), ("q3", "no path")], "query string, text string")
    assert {(r.query, r.id) for r in search.by_route(asked, routes, below).collect()} == {("q1", "r2"), ("q2", "r1")}


def test_resolution_tiers(spark):
    symbols = spark.createDataFrame([
        ("s1", "a.ts", "save", "Store.save", "method", False), ("s2", "b.ts", "save", "save", "function", True), ("s3", "b.ts", "load", "Box.load", "method", False), ("s4", "b.ts", "Box", "Box", "class", True),
        ("s5", "a.ts", "help", "help", "function", False), ("s6", "c.ts", "only", "only", "function", True), ("s7", "lib/d.ts", "far", "far", "function", True), ("s8", "lib/e.ts", "far", "far", "function", True), ("s9", "b.ts", "loose", "loose", "function", True),
        ("sa", "a.ts", "Store", "Store", "class", False),
    ], "id string, file string, name string, qualified_name string, kind string, exported boolean")
    fn = ["function", "method"]
    refs = spark.createDataFrame([
        ("own", "a.ts", "this.save", "call", "Store", fn, False), ("bound", "a.ts", "persist", "call", None, fn, False), ("deep", "a.ts", "Box.load", "call", None, fn, False), ("all", "a.ts", "b.save", "call", None, fn, False), ("framework", "z.ts", "app.only", "call", None, fn, True),
        ("qualified", "a.ts", "Store.save", "call", None, fn, False), ("file", "a.ts", "help", "call", None, fn, False), ("imported", "a.ts", "loose", "call", None, fn, False), ("package", "lib/x.ts", "far", "call", None, fn, False), ("name", "y/z.ts", "y.save", "call", None, fn, False),
        ("super", "a.ts", "super.save", "call", "Store", fn, False), ("kind", "a.ts", "help", "extends", None, ["class"], False), ("none", "a.ts", "nothing", "call", None, fn, False),
    ], "ref string, file string, name string, kind string, owner string, kinds array<string>, framework boolean")
    bindings = spark.createDataFrame([("a.ts", "persist", "save", "./b"), ("a.ts", "Box", "Box", "./b"), ("a.ts", "b", "*", "./b")], "file string, local string, imported string, specifier string")
    modules = spark.createDataFrame([("a.ts", "./b", "b.ts")], "importer string, specifier string, file string")
    near = spark.createDataFrame([("lib/x.ts", "lib/e.ts", 1)], "ref_file string, file string, distance int")
    got = {}
    for r in sorted(resolve.references(refs, symbols, bindings, modules, near).collect(), key=lambda r: (r.ref, r["rank"] or 0)):
        got.setdefault(r.ref, []).append((r.tier, r.candidate, r.confidence))
    one = lambda tier, s: [(tier, s, 1.0)]
    assert got == {
        "own": one("own", "s1"), "bound": one("binding", "s2"), "deep": one("binding", "s3"), "all": one("binding", "s2"), "framework": one("framework", "s6"), "qualified": one("qualified", "s1"), "file": one("file", "s5"), "imported": one("imported", "s9"),
        "package": [("package", "s8", pytest.approx(0.66)), ("package", "s7", pytest.approx(0.3))], "name": [("name", "s1", pytest.approx(0.3)), ("name", "s2", pytest.approx(0.3))], "super": [(None, None, None)], "kind": [(None, None, None)], "none": [(None, None, None)],
    }
