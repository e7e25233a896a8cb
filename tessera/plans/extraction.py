"""Extraction from pages, events as logs, and source texts made of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.fixtures import Tables
from tessera.operators.lineage import shared_folder
from tessera.plans.base import query
from tessera.sources import adapters, gitlog


@query("page_links", "X2 R1", "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, href, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY ALL")
def page_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("link_resolution", "R1 Q33", "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages), k AS (SELECT url, min(page_id) AS id, count(*) AS c FROM pages GROUP BY url) SELECT CASE WHEN c IS NULL THEN 'unresolved' WHEN c > 1 THEN 'multi_candidate' ELSE 'resolved' END AS state, CAST(count(*) AS BIGINT) AS n FROM l LEFT JOIN k ON k.url = l.href GROUP BY ALL")
def link_resolution(t: Tables) -> DataFrame:
    links = t.pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    known = t.pages.groupBy("url").agg(F.count("*").alias("c"))
    state = F.when(F.col("c").isNull(), "unresolved").when(F.col("c") > 1, "multi_candidate").otherwise("resolved")
    return links.join(known, F.col("href") == F.col("url"), "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("page_headings", "X3 G25", "SELECT page_id, CAST(len(regexp_extract_all(html, '<h[1-6]')) AS INTEGER) AS n_headings, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS first_heading FROM pages")
def page_headings(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_count("html", F.lit("<h[1-6]")).alias("n_headings"), F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("first_heading"))


@query("generated_sources", "X1e", "SELECT CAST(count(*) AS BIGINT) AS n FROM documents WHERE regexp_matches(left(text, 2000), '(?i)(@generated|auto-?generated|do not edit)') OR regexp_matches('src/' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.pb.go' ELSE '.go' END, '(^|/)(generated|__generated__)/|\\.(g|pb|generated)\\.[a-z]+$')")
def generated_sources(t: Tables) -> DataFrame:
    path = F.concat(F.lit("src/"), "doc_id", F.when(F.col("doc_id") % 9 == 0, ".pb.go").otherwise(".go"))
    return t.documents.where(adapters.generated(path, F.col("text"))).agg(F.count("*").alias("n"))


_LOG = "'@' || lpad(to_hex(event_id), 8, '0') || '|' || user_id || '|' || strftime(ts, '%Y-%m-%d')"


@query("git_log", "A5 G5", "SELECT user_id AS author, CAST(count(*) AS BIGINT) AS commits, CAST(sum(event_id % 50) AS BIGINT) AS added, CAST(sum(event_id % 7) AS BIGINT) AS deleted FROM events GROUP BY user_id")
def git_log(t: Tables) -> DataFrame:
    """A log written from the events and read back: authors with their commits and lines. A log a day, so no window holds them all."""
    e = t.events
    head = F.concat(F.lit("@"), F.lpad(F.lower(F.hex("event_id")), 8, "0"), F.lit("|"), "user_id", F.lit("|"), F.date_format("ts", "yyyy-MM-dd"))
    row = F.concat_ws("\t", (F.col("event_id") % 50).cast("string"), (F.col("event_id") % 7).cast("string"), F.concat(F.lit("src/"), "event_type", F.lit(".ts")))
    log = e.select(F.to_date("ts").alias("log"), F.posexplode(F.array(head, F.lit(""), row)).alias("i", "value"), "event_id").select("log", (F.col("event_id") * 3 + F.col("i")).alias("n"), "value")
    return gitlog.numstat_log(log).groupBy(F.col("author").cast("long").alias("author")).agg(F.count_distinct("commit").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


@query("name_status", "A5 U6", "SELECT CAST(count(*) FILTER (p_size % 3 = 0) AS BIGINT) AS renamed, CAST(count(*) FILTER (p_size % 3 = 1) AS BIGINT) AS modified, CAST(count(*) FILTER (p_size % 3 = 2) AS BIGINT) AS added, CAST(sum(CASE WHEN p_size % 3 = 0 THEN 50 + p_size END) AS BIGINT) AS similarity FROM part")
def name_status(t: Tables) -> DataFrame:
    name = F.concat(F.lit("a"), "p_partkey")
    z = F.lit("\u0000")
    cell = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("R0"), (50 + F.col("p_size")).cast("string"), z, name, z, F.concat(F.lit("b"), name), z)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("M"), z, name, z)).otherwise(F.concat(F.lit("A"), z, name, z))
    output = t.part.groupBy("p_brand").agg(F.concat_ws("", F.collect_list(cell)).alias("out"))
    c = output.select(F.explode(gitlog.name_status(F.col("out"))).alias("c")).select("c.*")
    count = lambda s: F.count_if((F.col("status") == s) & (F.col("previous").isNotNull() if s == "R" else F.col("previous").isNull()))
    return c.agg(count("R").alias("renamed"), count("M").alias("modified"), count("A").alias("added"), F.sum("similarity").cast("long").alias("similarity"))


@query("diff_ranges", "A6 P10", "SELECT p_partkey, p_size AS old_start, CAST(p_size + 2 AS INTEGER) AS old_end, CAST(p_size + 1 AS INTEGER) AS new_start, CAST(p_size + 1 + greatest(p_size % 4 - 1, 0) AS INTEGER) AS new_end FROM part")
def diff_ranges(t: Tables) -> DataFrame:
    s = F.col("p_size")
    hunk = F.concat(F.lit("--- a\n+++ b\n@@ -"), s, F.lit(",3 +"), s + 1, F.lit(","), s % 4, F.lit(" @@ def f():\n-x\n+y\n"))
    return t.part.select("p_partkey", F.explode(gitlog.changed_ranges(hunk)).alias("r")).select("p_partkey", "r.*")


def _sources(t: Tables) -> DataFrame:
    """A Python module for each nation: a mapped class, and one to four functions with a route, a branch, calls and an environment variable; those of odd nations loop."""
    key = F.col("n_nationkey").cast("string")
    loop = F.when(F.col("n_nationkey") % 2 == 1, "    for y in x:\n        if y:\n            break\n").otherwise("")
    one = lambda i: F.concat(F.lit("@app.get('/x"), i.cast("string"), F.lit("')\ndef read_"), i.cast("string"), F.lit("(x):\n    # TODO: check\n    if x:\n        return load(os.environ['KEY_"), key, F.lit("'])\n"), loop, F.lit("    return x\n\n\n"))
    functions = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("n_nationkey") % 4).cast("int")), one), "")
    head = F.concat(F.lit("import os\nfrom .base import Model\n\n\nclass N"), key, F.lit("(Model):\n    __tablename__ = 'n"), key, F.lit("'\n\n\n"))
    return t.nation.select(F.concat(F.lit("pkg/m"), key, F.lit(".py")).alias("path"), F.concat(head, functions).alias("text"))


_F, _ODD = "(1 + n_nationkey % 4)", "(1 + n_nationkey % 4) * (n_nationkey % 2)"
_PYTHON_ROWS = f"""('node', 'module', 1), ('node', 'database_model', 1), ('node', 'function', {_F}), ('node', 'endpoint', {_F}), ('edge', 'CONTAINS', 1 + {_F}), ('reference', 'import', 2), ('reference', 'extends', 1), ('reference', 'call', 2 * {_F}),
 ('reference', 'environment_variable', {_F}), ('node', 'comment', {_F}), ('fingerprint', 'tokens', 1), ('cfg_node', 'entry', {_F}), ('cfg_node', 'exit', {_F}), ('cfg_node', 'branch', {_F} + {_ODD}), ('cfg_node', 'return', 2 * {_F}), ('cfg_node', 'loop', {_ODD}), ('cfg_node', 'break', {_ODD}),
 ('cfg_edge', 'next', {_F}), ('cfg_edge', 'true', {_F} + 2 * {_ODD}), ('cfg_edge', 'false', {_F} + {_ODD}), ('cfg_edge', 'return', 2 * {_F}), ('cfg_edge', 'done', {_ODD}), ('cfg_edge', 'break', {_ODD})"""


@query("python_symbols", "X1a X1c X2c X2d X2i X4 F8 Q10", f"SELECT n_nationkey, row_kind, kind, CAST(n AS BIGINT) AS n FROM nation, LATERAL (SELECT * FROM (VALUES {_PYTHON_ROWS}) v(row_kind, kind, n)) x WHERE n > 0")
def python_symbols(t: Tables) -> DataFrame:
    rows = adapters.extract(_sources(t), ["python", "environment", "comments", "tokens", "control_flow"])
    return rows.groupBy(F.regexp_extract("file", r"(\d+)", 1).cast("int").alias("n_nationkey"), "row_kind", "kind").agg(F.count("*").alias("n"))


def _contracts(t: Tables) -> DataFrame:
    """Contracts and deployments of each nation, of different sizes, and a broken file that only costs a row."""
    key, k = F.col("n_nationkey").cast("string"), F.col("n_nationkey")
    several = lambda n, make, glue: F.array_join(F.transform(F.sequence(F.lit(0), (k % n).cast("int")), make), glue)
    paths = several(3, lambda i: F.concat(F.lit('"/a'), i, F.lit('": {"get": {"operationId": "x"}, "post": {}}')), ", ")
    api = F.concat(F.lit('{"openapi": "3.0.0", "servers": [{"url": "https://h'), key, F.lit('"}], "paths": {'), paths, F.lit('}, "components": {"schemas": {"S": {}}}}'))
    yaml = F.concat(F.lit("openapi: 3.0.0\npaths:\n"), several(4, lambda i: F.concat(F.lit("  /b"), i, F.lit(":\n    delete:\n      x: 1\n")), ""), F.lit("components:\n  /no:\n    get:\n"))
    channels = several(2, lambda i: F.concat(F.lit('"c'), i, F.lit('": {"publish": {}, "subscribe": {}}')), ", ")
    messages = F.concat(F.lit('{"asyncapi": "2.0.0", "channels": {'), channels, F.lit('}, "servers": {"kafka": {"url": "k"}}, "components": {"schemas": {"M": {}}}}'))
    compose = F.concat(F.lit("services:\n  web"), key, F.lit(":\n    image: postgres:16\n    environment:\n"), several(3, lambda i: F.concat(F.lit("      - APP_KEY"), i, F.lit("=1\n")), ""))
    pods = several(3, lambda i: F.concat(F.lit("apiVersion: v1\nkind: "), F.element_at(F.array(*[F.lit(x) for x in ("Deployment", "CronJob", "Service")]), i + 1), F.lit("\nmetadata:\n  name: p"), i, F.lit("\n")), "---\n")
    models = F.concat(F.lit("model A {\n  id Int\n  b B[]\n}\n"), several(2, lambda i: F.concat(F.lit("model B"), i, F.lit(" {\n  a A?\n}\n")), ""))
    made = (("api", ".json", api), ("api", ".yaml", yaml), ("events", ".asyncapi.json", messages), ("compose", ".yaml", compose), ("pods", ".yaml", pods), ("schema", ".prisma", models), ("bad", ".json", F.lit("{")))
    each = F.explode(F.array(*[F.struct(F.concat(F.lit(name), key, F.lit(ending)).alias("path"), text.alias("text")) for name, ending, text in made]))
    return t.nation.select(each.alias("f")).select("f.*")


_P3, _P4, _P2 = "(1 + n_nationkey % 3)", "(1 + n_nationkey % 4)", "(1 + n_nationkey % 2)"


@query("contract_extraction", "X2e X2f X2g X2h X2k", f"""SELECT n_nationkey, kind, CAST(n AS BIGINT) AS n FROM nation, LATERAL (SELECT * FROM (VALUES ('http_contract', 2 * {_P3} + {_P4}), ('contract_schema', 2), ('external_service', 2), ('service', 1 + (n_nationkey % 3) // 2),
 ('datastore', 1), ('environment_variable', {_P3}), ('process', 1), ('job', (n_nationkey % 3 + 1) // 2), ('topic', {_P2}), ('PUBLISHES', {_P2}), ('SUBSCRIBES', {_P2}), ('database_model', 1 + {_P2}), ('REFERENCES', 1 + {_P2}), ('error', 1)) v(kind, n)) x WHERE n > 0""")
def contract_extraction(t: Tables) -> DataFrame:
    """OpenAPI (JSON and YAML), AsyncAPI, compose, Kubernetes and Prisma files, by nation."""
    rows = adapters.merged(adapters.extract(_contracts(t), ["openapi", "asyncapi", "deployment", "prisma"]))
    kind = F.when(F.col("row_kind") == "error", "error").otherwise(F.col("kind"))
    return rows.groupBy(F.regexp_extract("file", r"(\d+)", 1).cast("int").alias("n_nationkey"), kind.alias("kind")).agg(F.count("*").alias("n"))


@query("suppressed_references", "X2k", "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 1 + n_nationkey % 4 END AS BIGINT) AS n_references FROM nation")
def suppressed_references(t: Tables) -> DataFrame:
    """Environment references that another adapter explains are left out: here those of every fifth nation."""
    rows = adapters.extract(_sources(t), ["environment", "tokens"])
    of = F.regexp_extract("file", r"(\d+)", 1).cast("int")
    explained = rows.where((F.col("row_kind") == "reference") & (of % 5 == 0)).select("file", "start_line", "name")
    return adapters.merged(rows, explained).groupBy(of.alias("n_nationkey")).agg(F.count_if(F.col("row_kind") == "reference").alias("n_references"))


@query("markdown_sections", "X3", r"""SELECT doc_id, CAST(1 + doc_id % 4 + len(regexp_extract_all(coalesce(text, ''), '(?m)^#{1,6}\s+\S')) AS BIGINT) AS n_sections, CAST(doc_id % 2 + len(regexp_extract_all(coalesce(text, ''), '(?mi)^(?:\*\*)?(?:Status|Date|Context|Decision|Consequences)(?:\*\*)?:\s*[^\s]')) AS BIGINT) AS n_fields FROM documents""".replace("\\\\", "\\"))
def markdown_sections(t: Tables) -> DataFrame:
    """Each whole text below a head of one to four sections and up to one field; headings and fields of the text itself count too."""
    field = F.when(F.col("doc_id") % 2 == 1, "Status: accepted\n").otherwise("")
    parts = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int")), lambda i: F.concat(F.lit("## Part "), i, F.lit("\nx\n"))), "")
    files = t.documents.select(F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("path"), F.concat(field, parts, F.coalesce("text", F.lit(""))).alias("text"))
    rows = adapters.extract(files, ["markdown"])
    doc = F.regexp_extract("file", r"(\d+)", 1).cast("long")
    return rows.groupBy(doc.alias("doc_id")).agg(F.count_if(F.col("kind") == "documentation").alias("n_sections"), F.count_if(F.col("kind") == "decision_field").alias("n_fields"))


@query("runtime_observations", "X2j J10", "WITH o AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, least(1.0, 0.5 + value / 200) AS c FROM events) SELECT CASE WHEN p_partkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS state, CAST(count(*) AS BIGINT) AS n, round(min(c), 4)::DOUBLE AS least FROM o LEFT JOIN part ON p_partkey = k * 30 GROUP BY ALL")
def runtime_observations(t: Tables) -> DataFrame:
    """Observations of a running system, from JSON, matched with known symbols."""
    k = F.from_json("props", "k long")["k"]
    o = t.events.select(k.alias("k"), F.least(F.lit(1.0), 0.5 + F.col("value") / 200).alias("c"))
    state = F.when(F.col("p_partkey").isNull(), "unresolved").otherwise("resolved")
    return o.join(t.part, F.col("k") * 30 == F.col("p_partkey"), "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.round(F.min("c"), 4).alias("least"))


@query("watched_equals_batch", "I1 I2 I9", "SELECT event_type AS id, max(event_id) AS version FROM events GROUP BY event_type")
def watched_equals_batch(t: Tables) -> DataFrame:
    """A watched folder of event files, upserted batch by batch, comes to the same as one aggregate."""
    from tessera.operators.storage import read_current
    from tessera.streaming.watch import watch

    base = f"{shared_folder(t.spark)}/watched-{uuid.uuid4().hex}"
    rows = t.events.select(F.col("event_type").alias("id"), F.col("event_id").alias("version"))
    for part in range(3):
        rows.where(F.col("version") % 3 == part).groupBy("id").agg(F.max("version").alias("version")).write.mode("append").parquet(f"{base}/source")
    watch(t.spark, "id string, version long", f"{base}/source", f"{base}/target", ["id"], f"{base}/checkpoint", once=True).awaitTermination()
    return read_current(t.spark, f"{base}/target")
