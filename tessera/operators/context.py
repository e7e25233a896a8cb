"""Questions and tasks: routing, intents with explicit targets, the context of symbols, paths that answer, and change briefs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import identifier_terms, says, task_class
from tessera.model import definite_of
from tessera.operators.lineage import cut

# Operations in the order in which they are tried, with the words that ask for them.
ROUTES = (
    ("prepare_change", r"add|change|edit|fix|implement|migrate|refactor|remove|rename|review|affected tests?|blast radius|plan"),
    ("trace", r"trace|flow|journey|path|call chain|request lifecycle|how .* reaches|from .* to"),
    ("get_evidence", r"evidence|source range|source lines?|prove|citation|show code"),
    ("search", r"find|locate|search|where is|symbol|entrypoint|overview|onboard|architecture|domain"),
)
# Words that a task may hold without meaning anything.
TASK_STOP_WORDS = (
    "a", "add", "an", "and", "are", "as", "at", "be", "by", "change", "code", "does", "affected", "around", "become", "becomes", "for", "from", "how", "i", "in", "is", "it",
    "new", "of", "on", "or", "output", "please", "repository", "should", "that", "the", "this", "to", "update", "we", "what", "where", "which", "with",
)
# What a task speaks of, and the terms that are looked for then.
VOCABULARY = (
    (r"\b(?:auth|authentication|login|sign[- ]?in)\b", ("auth", "authenticate", "login")),
    (r"\b(?:rate limit|throttl)", ("rate", "limit", "throttle")),
    (r"\b(?:database|persist|storage|repository)\b", ("database", "storage", "repository")),
    (r"\b(?:test|spec|fixture|coverage)\b", ("test", "spec", "fixture")),
    (r"\b(?:http|api|endpoint|route)\b", ("api", "endpoint", "route")),
    (r"\b(?:config|configuration|setting)\b", ("config", "configuration")),
    (r"\bmcp\b", ("mcp", "server", "query")),
    (r"\b(?:index|indexed|retrieval|retrieve|search)\b", ("index", "search", "query", "store")),
    (r"\b(?:evidence|provenance|grounded)\b", ("evidence", "provenance", "source")),
    (r"\b(?:response|result|serialize|output)\b", ("response", "result", "serialize")),
)
MAX_TERMS = 24


def route(request: Column) -> Column:
    """The operation that a request asks for."""
    text = F.trim(F.coalesce(request, F.lit("")))
    out = None
    for name, words in ROUTES:
        hit = says(text, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("native_fallback")


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def intent(task: Column) -> Column:
    """A struct: kind, terms (with those of the vocabulary, without stop words), files and endpoints that the task names, and identifiers that may be symbols."""
    text = F.coalesce(task, F.lit(""))
    spoken = [F.when(text.rlike(rf"(?i){pattern}"), F.array(*[F.lit(t) for t in terms])).otherwise(F.array().cast("array<string>")) for pattern, terms in VOCABULARY]
    terms = F.array_distinct(F.concat(identifier_terms(text), *spoken))
    terms = F.slice(F.filter(terms, lambda t: (F.length(t) > 1) & ~t.isin(*TASK_STOP_WORDS)), 1, MAX_TERMS)
    quoted = _found(text, r"""[`'"]([^`'"]{1,200})[`'"]""")
    files = F.concat(F.filter(quoted, lambda q: q.rlike(r"[/\\]|\.[A-Za-z0-9]+$")), _found(text, r"(?:^|\s)((?:\.?\.?[/\\])?[\w@.+-]+(?:[/\\][\w@.+-]+)+\.[A-Za-z0-9]+)"), _found(text, r"\b([\w@.+-]+\.(?:[A-Za-z][A-Za-z0-9]*))\b"))
    files = F.array_distinct(F.transform(files, lambda f: F.regexp_replace(F.translate(F.trim(f), "\\", "/"), r"^\./", "")))
    endpoints = F.array_distinct(F.concat(_found(text, r"(?i)\b(?:GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\s+(/[A-Za-z0-9_/:{}.*-]+)"), F.filter(quoted, lambda q: F.startswith(q, F.lit("/")))))
    code = F.filter(_found(text, r"\b([A-Za-z_$][A-Za-z0-9_$:.-]*)\b"), lambda x: x.rlike(r"[a-z0-9][A-Z]|[_$:]|\w\.\w") | x.rlike(r"^[A-Z][a-z]"))
    symbols = F.filter(F.array_except(F.array_distinct(F.concat(quoted, code)), F.concat(files, endpoints)), lambda x: ~x.rlike(r"[/\\]"))
    return F.struct(task_class(text).alias("kind"), terms.alias("terms"), files.alias("files"), endpoints.alias("endpoints"), symbols.alias("symbols"))


def explicit_symbols(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(task, id): the nodes whose name or qualified name a task spells. ``tasks``: task, intent."""
    asked = tasks.select("task", F.explode("intent.symbols").alias("_s")).distinct()
    names = nodes.select("id", F.explode(F.array_distinct(F.array_compact(F.array("name", "qualified_name")))).alias("_s"))
    return asked.join(names, "_s").select("task", "id").distinct()


def symbol_context(wanted: DataFrame, edges: DataFrame, evidence: DataFrame, issues: DataFrame, limit: int = 50) -> DataFrame:
    """(id, section, position, item, more): for each wanted id its relationships either way, its evidence and its issues, the first ``limit`` of each by
    item, and whether there are more. ``evidence`` and ``issues``: id, item. All ids are answered in one pass."""
    ids = wanted.select("id").distinct()
    out = edges.select(F.col("source").alias("id"), F.col("id").alias("item")).unionByName(edges.where("source <> target").select(F.col("target").alias("id"), F.col("id").alias("item")))
    sections = [x.select("id", F.lit(name).alias("section"), "item") for name, x in (("relationships", out), ("evidence", evidence), ("issues", issues))]
    found = reduce(DataFrame.unionByName, sections).join(ids, "id", "left_semi")
    ranked = found.withColumn("position", F.row_number().over(Window.partitionBy("id", "section").orderBy("item")))
    kept = ranked.where(F.col("position") <= limit + 1)  # one more tells whether there are more
    more = F.max("position").over(Window.partitionBy("id", "section")) > limit
    return kept.withColumn("more", more).where(F.col("position") <= limit)


# What the parts of a path's score are worth, and the caps of the search.
TERM, STAGE, STAGE_TERM, ENTRY, STEP = 180, 260, 90, 240, 15
MAX_NODES, FAN_OUT, MAX_PATHS = 5, 14, 4000


def answer_paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame, terms: DataFrame, stages: tuple[tuple[str, ...], ...], keep: int = 5) -> DataFrame:
    """Paths that answer a question: query, path, edge_ids, score, rank.

    ``nodes``: id, search_text, is_entry; ``starts``: query, id; ``terms``: query, terms (array). From each start definite edges are followed for up to
    ``MAX_NODES`` nodes without repeats, of each node the ``FAN_OUT`` edges whose targets hold most of the question's terms. A path scores by the terms and the stages (lists of words)
    that its nodes hold, whether it begins at an entrypoint, and its length. Of a question ``MAX_PATHS`` paths are kept, the best ``keep`` returned:
    at first the best path for each stage that none has covered, then by score."""
    held = lambda text, words: F.filter(words, lambda w: F.contains(text, w))
    n = cut(nodes.select("id", F.lower(F.coalesce("search_text", F.lit(""))).alias("text"), F.coalesce("is_entry", F.lit(False)).alias("entry")))
    step = cut(edges.where(definite_of(edges)).select(F.col("id").alias("_e"), F.col("source").alias("_from"), F.col("target").alias("_to")).join(n.select(F.col("id").alias("_to"), F.col("text").alias("_text")), "_to"))
    asked = terms.select("query", "terms")
    stage_words = [F.array(*[F.lit(w) for w in stage]) for stage in stages]
    level = starts.select("query", "id").distinct().join(n, "id").join(asked, "query").select("query", "terms", F.col("id").alias("node"), F.array("id").alias("path"), F.array().cast("array<string>").alias("edge_ids"), held(F.col("text"), F.col("terms")).alias("hits"), *[held(F.col("text"), w).alias(f"s{i}") for i, w in enumerate(stage_words)], "entry")
    found: DataFrame | None = None
    for d in range(1, MAX_NODES):
        met = level.join(step, level["node"] == step["_from"]).where(~F.array_contains("path", F.col("_to"))).withColumn("_own", held(F.col("_text"), F.col("terms")))
        best = Window.partitionBy("query", F.array_join("edge_ids", "\n"), "node").orderBy(F.desc(F.size("_own")), "_e")
        grown = met.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= FAN_OUT)
        level = grown.select("query", "terms", F.col("_to").alias("node"), F.concat("path", F.array("_to")).alias("path"), F.concat("edge_ids", F.array("_e")).alias("edge_ids"), F.array_union("hits", "_own").alias("hits"), *[F.array_union(f"s{i}", held(F.col("_text"), w)).alias(f"s{i}") for i, w in enumerate(stage_words)], "entry")
        cap = Window.partitionBy("query").orderBy(F.desc(F.size("hits")), F.array_join("path", "\n"), F.array_join("edge_ids", "\n"))
        level = cut(level.withColumn("_n", F.row_number().over(cap)).where(F.col("_n") <= MAX_PATHS).drop("_n"))
        found = level if found is None else found.unionByName(level)
        if level.isEmpty():
            break
    counts = [F.size(f"s{i}") for i in range(len(stages))]
    covered = sum(((c > 0).cast("int") for c in counts), F.lit(0))
    total = sum(counts, F.lit(0))
    score = F.size("hits") * TERM + covered * STAGE + total * STAGE_TERM + F.col("entry").cast("int") * ENTRY + F.size("edge_ids") * STEP
    once = Window.partitionBy("query", F.array_join("path", "\n")).orderBy(F.array_join("edge_ids", "\n"))
    scored = found.withColumn("score", score.cast("long")).withColumn("_n", F.row_number().over(once)).where("_n = 1")
    order = [F.desc("score"), F.desc(F.size("path")), F.array_join("path", "\n")]
    scored = scored.withColumn("_all", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    leads = [F.when(c >= 2, F.row_number().over(Window.partitionBy("query").orderBy(F.desc(c), *order))) for c in counts]
    first = F.least(*[F.when(lead == 1, F.lit(i)) for i, lead in enumerate(leads)], F.lit(len(stages))) if leads else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("_first", "_all"))
    return scored.withColumn("_first", first).withColumn("rank", rank).where(F.col("rank") <= keep).select("query", "path", "edge_ids", "score", "rank")


def change_brief(tasks: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int = 8000, per_section: int = 20) -> DataFrame:
    """A brief for each task (task, text): task, kind, position, section, item, score, bytes.

    Targets are nodes that the task spells (1500), whose file it names (1000) or that hold its terms (90 each); the best ``per_section`` stay. Affected nodes are
    those that definite edges lead from to a target, tests among them a section of their own. Sections follow each other (targets, tests, affected), items by score and id,
    as many as ``budget`` bytes hold: an item that does not fit is left out and smaller ones may follow."""
    told = cut(tasks.select("task", intent(F.col("text")).alias("intent")))
    n = cut(nodes.select("id", "kind", "name", "file", F.lower(F.concat_ws(" ", "name", "file")).alias("text")))
    spelled = explicit_symbols(told, nodes).select("task", "id", F.lit(1500).alias("s"))
    by_file = told.select("task", F.explode("intent.files").alias("f")).join(n.select("id", F.col("file").alias("f")), "f").select("task", "id", F.lit(1000).alias("s"))
    words = n.select("id", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}_$-]+"))).alias("term"))
    by_term = told.select("task", F.explode("intent.terms").alias("term")).join(words, "term").select("task", "id", F.lit(90).alias("s"))
    total = spelled.unionByName(by_file.distinct()).unionByName(by_term).groupBy("task", "id").agg(F.sum("s").alias("score"))
    order = Window.partitionBy("task").orderBy(F.desc("score"), "id")
    targets = cut(total.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_section).drop("_n"))
    near = edges.where(definite_of(edges)).select(F.col("source"), F.col("target").alias("id")).join(targets, "id").groupBy("task", F.col("source").alias("id")).agg(F.max("score").alias("score")).join(targets.select("task", "id"), ["task", "id"], "left_anti")
    near = near.join(n.select("id", "kind"), "id").withColumn("section", F.when(F.col("kind") == "test", "tests").otherwise("affected")).drop("kind")
    rank = F.row_number().over(Window.partitionBy("task", "section").orderBy(F.desc("score"), "id"))
    items = targets.withColumn("section", F.lit("targets")).unionByName(near).withColumn("_n", rank).where(F.col("_n") <= per_section)
    items = items.join(n.select("id", "name", "file"), "id").withColumn("item", F.concat_ws(" ", "id", "name", "file")).withColumn("bytes", F.octet_length("item"))
    place = F.element_at(F.create_map(*[F.lit(x) for kv in (("targets", 0), ("tests", 1), ("affected", 2)) for x in kv]), F.col("section"))
    rows = items.groupBy("task").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "_n", "section", "id", "item", F.col("score").cast("long").alias("score"), "bytes"))).alias("rows"))  # at most 3 * per_section
    empty = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<struct<p:int,_n:int,section:string,id:string,item:string,score:bigint,bytes:int>>)").alias("kept"))
    fit = F.aggregate("rows", empty, lambda a, r: F.when(a["used"] + r["bytes"] <= budget, F.struct((a["used"] + r["bytes"]).alias("used"), F.concat(a["kept"], F.array(r)).alias("kept"))).otherwise(a))
    packed = rows.select("task", F.posexplode(fit["kept"]).alias("position", "r"))
    return packed.join(told.select("task", F.col("intent.kind").alias("kind")), "task").select("task", "kind", "position", F.col("r.section").alias("section"), F.col("r.id").alias("item"), F.col("r.score").alias("score"), F.col("r.bytes").alias("bytes"))
