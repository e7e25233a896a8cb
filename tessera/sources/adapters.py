"""Adapters that turn source files (path, text) into graph rows.

An adapter is a function from (path, text) to rows of ``SCHEMA``; it runs in Arrow batches on the executors. A file that an adapter
fails on yields one row of kind ``error``, and no other adapter or file is affected.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "file string, adapter string, row_kind string, kind string, name string, qualified_name string, start_line int, end_line int, target string, confidence double"
Row = tuple[str, str, str, str | None, int | None, int | None, str | None, float]
Adapter = Callable[[str, str], Iterator[Row]]
_ADAPTERS: dict[str, tuple[Callable[[str], bool], Adapter]] = {}


def register(name: str, takes: Callable[[str], bool], adapter: Adapter) -> Callable[[], None]:
    """Adds an adapter; the result takes it away again."""
    _ADAPTERS[name] = (takes, adapter)
    return lambda: _ADAPTERS.pop(name, None) and None


def extract(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``files``: path, text."""
    chosen = {n: _ADAPTERS[n] for n in (names or sorted(_ADAPTERS))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for name, (takes, adapter) in chosen.items():
                    if path is None or not takes(path):
                        continue
                    try:
                        out += [(path, name, *row) for row in adapter(path, text or "")]
                    except Exception as e:  # noqa: BLE001  an adapter's failure is a row
                        out.append((path, name, "error", type(e).__name__, str(e)[:200], None, None, None, None, 1.0))
            columns = list(zip(*out, strict=True)) or [()] * len(fields)
            kinds = {"start_line": pa.int32(), "end_line": pa.int32(), "confidence": pa.float64()}
            yield pa.RecordBatch.from_pydict({f: pa.array(c, kinds.get(f, pa.string())) for f, c in zip(fields, columns, strict=True)})

    return files.select("path", "text").mapInArrow(run, SCHEMA)


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def python_symbols(path: str, text: str) -> Iterator[Row]:
    """Functions, classes, imports, calls, environment variables; decorated web routes and mapped database classes."""
    tree = ast.parse(text)
    module = path.removesuffix(".py").replace("/", ".")
    yield ("node", "module", module.rsplit(".", 1)[-1], module, 1, text.count("\n") + 1, None, 1.0)

    def walk(body: ast.AST, owner: str, in_class: bool) -> Iterator[Row]:
        for node in ast.iter_child_nodes(body):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{owner}.{node.name}"
                yield ("node", "method" if in_class else "function", node.name, name, node.lineno, node.end_lineno, None, 1.0)
                yield ("edge", "CONTAINS", node.name, owner, node.lineno, node.lineno, name, 1.0)
                for d in node.decorator_list:
                    verb = _dotted(d.func) if isinstance(d, ast.Call) else None
                    if verb and verb.rsplit(".", 1)[-1] in ("get", "post", "put", "patch", "delete") and d.args and isinstance(d.args[0], ast.Constant):
                        yield ("node", "endpoint", f"{verb.rsplit('.', 1)[-1].upper()} {d.args[0].value}", name, node.lineno, node.end_lineno, name, 1.0)
                for call in (n for n in ast.walk(node) if isinstance(n, ast.Call)):
                    if target := _dotted(call.func):
                        yield ("reference", "call", target, name, call.lineno, call.lineno, target, 0.9)
                yield from walk(node, name, False)
            elif isinstance(node, ast.ClassDef):
                name = f"{owner}.{node.name}"
                table = next((s.value.value for s in node.body if isinstance(s, ast.Assign) and any(isinstance(x, ast.Name) and x.id == "__tablename__" for x in s.targets) and isinstance(s.value, ast.Constant)), None)
                yield ("node", "database_model" if table else "class", table or node.name, name, node.lineno, node.end_lineno, None, 1.0)
                yield ("edge", "CONTAINS", node.name, owner, node.lineno, node.lineno, name, 1.0)
                for base in node.bases:
                    if target := _dotted(base):
                        yield ("reference", "extends", target, name, node.lineno, node.lineno, target, 1.0)
                yield from walk(node, name, True)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    yield ("reference", "import", a.name, owner, node.lineno, node.lineno, a.name, 1.0)
            elif isinstance(node, ast.ImportFrom):
                yield ("reference", "import", "." * node.level + (node.module or ""), owner, node.lineno, node.lineno, "." * node.level + (node.module or ""), 1.0)
            else:
                yield from walk(node, owner, in_class)

    yield from walk(tree, module, False)


class _Flow:
    """The control-flow graph of one function: statements that branch, repeat, guard or leave are nodes; an edge leads to every node that may run next."""

    KINDS = {ast.If: "branch", ast.Match: "branch", ast.For: "loop", ast.AsyncFor: "loop", ast.While: "loop", ast.Try: "try", ast.Return: "return", ast.Raise: "throw", ast.With: "block", ast.AsyncWith: "block", ast.Break: "break", ast.Continue: "continue"}

    def __init__(self, function: ast.FunctionDef | ast.AsyncFunctionDef, max_nodes: int) -> None:
        self.name, self.room = function.name, max_nodes
        self.nodes: list[tuple[str, str, int, int]] = [("entry", "entry", function.lineno, function.lineno)]
        self.edges: dict[tuple[str, str, str], int] = {}
        left = self.run(function.body, [("entry", "next")], None)
        self.nodes.append(("exit", "exit", function.end_lineno, function.end_lineno))
        self.link(left, "exit", function.end_lineno)

    def link(self, ends: list[tuple[str, str]], to: str, line: int) -> None:
        for source, how in ends:
            self.edges.setdefault((source, how, to), line)

    def run(self, body: list[ast.stmt], ends: list[tuple[str, str]], loop: tuple[str, list] | None) -> list[tuple[str, str]]:
        """Adds statements that run after ``ends`` (node, kind of edge) and returns the ends that go on behind them."""
        for s in body:
            kind = self.KINDS.get(type(s))
            if kind is None or not ends:
                continue
            if len(self.nodes) >= self.room:
                if self.nodes[-1][0] != "truncated":
                    self.nodes.append(("truncated", "truncated", s.lineno, s.lineno))
                self.link(ends, "truncated", s.lineno)
                return []
            here = f"{kind}@{s.lineno}:{s.col_offset}"
            self.nodes.append((kind, here, s.lineno, s.end_lineno))
            self.link(ends, here, s.lineno)
            if isinstance(s, ast.If):
                ends = self.run(s.body, [(here, "true")], loop) + self.run(s.orelse, [(here, "false")], loop)
            elif isinstance(s, ast.Match):
                ends = [e for case in s.cases for e in self.run(case.body, [(here, "case")], loop)]
                if not any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.guard is None for c in s.cases):
                    ends.append((here, "false"))
            elif kind == "loop":
                broken: list[tuple[str, str]] = []
                self.link(self.run(s.body, [(here, "true")], (here, broken)), here, s.end_lineno)
                endless = isinstance(s, ast.While) and isinstance(s.test, ast.Constant) and bool(s.test.value)
                ends = broken + ([] if endless else self.run(s.orelse, [(here, "done")], loop))
            elif isinstance(s, ast.Try):
                ends = self.run(s.orelse, self.run(s.body, [(here, "next")], loop), loop)
                ends += [e for h in s.handlers for e in self.run(h.body, [(here, "error")], loop)]
                ends = self.run(s.finalbody, ends, loop)
            elif kind == "block":
                ends = self.run(s.body, [(here, "next")], loop)
            elif kind in ("return", "throw"):
                self.link([(here, kind)], "exit", s.lineno)
                ends = []
            else:
                if loop and kind == "break":
                    loop[1].append((here, "break"))
                elif loop:
                    self.link([(here, "continue")], loop[0], s.lineno)
                ends = []
        return ends


def control_flow(path: str, text: str, max_nodes: int = 60) -> Iterator[Row]:
    """A structured control-flow graph of each function, of at most ``max_nodes`` nodes before it is cut."""
    for f in (n for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))):
        flow = _Flow(f, max_nodes)
        for kind, name, start, end in flow.nodes:
            yield ("cfg_node", kind, f.name, name, start, end, None, 1.0)
        for (source, how, to), line in flow.edges.items():
            yield ("cfg_edge", how, f.name, source, line, line, to, 1.0)


def fingerprint_tokens(path: str, text: str) -> Iterator[Row]:
    """One row: a hash of the file's tokens without comments and white space."""
    import hashlib
    import io
    import tokenize

    skip = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING}
    stream = "\x1f".join(t.string for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type not in skip)
    yield ("fingerprint", "tokens", hashlib.sha256(stream.encode()).hexdigest(), None, 1, text.count("\n") + 1, None, 1.0)


def _lines_of(text: str, pattern: re.Pattern[str]) -> Iterator[tuple[int, re.Match[str]]]:
    for n, line in enumerate(text.split("\n"), 1):
        if m := pattern.search(line):
            yield n, m


_HEADING, _TAGGED, _ADR = re.compile(r"^(#{1,6})\s+(.+?)\s*#*$"), re.compile(r"(?:#|//|\*)\s*(TODO|FIXME|HACK|NOTE|DECISION|INVARIANT):?\s*(.*)"), re.compile(r"^(?:\*\*)?(Status|Date|Context|Decision|Consequences)(?:\*\*)?:\s*(.+)$", re.I)


def markdown_intent(path: str, text: str) -> Iterator[Row]:
    """Headings with their sections, and the fields of decision records."""
    lines = text.split("\n")
    heads = list(_lines_of(text, _HEADING))
    for i, (n, m) in enumerate(heads):
        level = len(m[1])
        end = next((k - 1 for k, o in heads[i + 1 :] if len(o[1]) <= level), len(lines))
        yield ("node", "documentation", m[2], f"{path}#{n}", n, end, None, 1.0)
    for n, m in _lines_of(text, _ADR):
        yield ("node", "decision_field", m[1].lower(), f"{path}#{n}", n, n, m[2], 1.0)


def tagged_comments(path: str, text: str) -> Iterator[Row]:
    for n, m in _lines_of(text, _TAGGED):
        yield ("node", "comment", m[1], f"{path}#{n}", n, n, m[2], 0.9)


_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")


def openapi(path: str, text: str) -> Iterator[Row]:
    """Operations, schemas, servers and security of an OpenAPI document; JSON in full, YAML by paths and methods."""
    if path.endswith(".json"):
        doc = json.loads(text)
        if not ("openapi" in doc or "swagger" in doc):
            return
        for route, item in doc.get("paths", {}).items():
            for verb in _VERBS:
                if verb in item:
                    yield ("node", "http_contract", f"{verb.upper()} {route}", item[verb].get("operationId"), 1, 1, None, 1.0)
        for name in doc.get("components", {}).get("schemas", doc.get("definitions", {})):
            yield ("node", "contract_schema", name, None, 1, 1, None, 1.0)
        for server in doc.get("servers", []):
            yield ("node", "external_service", server.get("url", ""), None, 1, 1, None, 1.0)
        for name in doc.get("components", {}).get("securitySchemes", {}):
            yield ("node", "security_scheme", name, None, 1, 1, None, 1.0)
        return
    if not re.search(r"^(openapi|swagger):", text, re.M):
        return
    route, inside = None, False
    for n, line in enumerate(text.split("\n"), 1):
        if re.match(r"^[^\s#]", line):
            route, inside = None, line.startswith("paths:")
        elif inside and (m := re.match(r"^  (/\S*):\s*$", line)):
            route = m[1]
        elif route and (m := re.match(r"^    (\w+):\s*$", line)) and m[1] in _VERBS:
            yield ("node", "http_contract", f"{m[1].upper()} {route}", None, n, n, None, 0.95)


def asyncapi(path: str, text: str) -> Iterator[Row]:
    """Channels with what they publish and subscribe to, servers and schemas."""
    doc = json.loads(text)
    if "asyncapi" not in doc:
        return
    for name, item in doc.get("channels", {}).items():
        yield ("node", "topic", name, None, 1, 1, None, 1.0)
        for way in ("publish", "subscribe"):
            if way in item:
                yield ("edge", "PUBLISHES" if way == "publish" else "SUBSCRIBES", name, path, 1, 1, item[way].get("operationId"), 1.0)
    for name, server in doc.get("servers", {}).items():
        yield ("node", "external_service", name, server.get("url"), 1, 1, None, 1.0)
    for name in doc.get("components", {}).get("schemas", {}):
        yield ("node", "contract_schema", name, None, 1, 1, None, 1.0)


_STORES = re.compile(r"image:\s*['\"]?[\w./-]*?(postgres|mysql|mariadb|redis|mongo|kafka|rabbitmq|elasticsearch)", re.I)


def deployment(path: str, text: str) -> Iterator[Row]:
    """Compose services, datastores and variables; Kubernetes workloads and jobs. Patterns only, no YAML parser."""
    if re.search(r"^services:", text, re.M):
        inside, service = False, None
        for n, line in enumerate(text.split("\n"), 1):
            if re.match(r"^\S", line):
                inside = line.startswith("services:")
            elif inside and (m := re.match(r"^  ([\w.-]+):\s*$", line)):
                service = m[1]
                yield ("node", "service", service, None, n, n, None, 0.95)
            elif inside and service and (m := _STORES.search(line)):
                yield ("node", "datastore", m[1].lower(), service, n, n, None, 0.95)
            elif inside and service and (m := re.match(r"^\s+-?\s*([A-Z][A-Z0-9_]+)\s*[=:]", line)):
                yield ("node", "environment_variable", m[1], service, n, n, None, 0.9)
    at = 1
    for part in re.split(r"^---\s*$", text, flags=re.M):
        kind, name = re.search(r"^kind:\s*(\w+)", part, re.M), re.search(r"^metadata:\s*\n(?:\s+.*\n)*?\s+name:\s*([\w.-]+)", part, re.M)
        if kind and name and kind[1] in ("Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob", "Service"):
            yield ("node", "job" if kind[1].endswith("ob") else "service" if kind[1] == "Service" else "process", name[1], kind[1], at, at + part.count("\n"), None, 0.95)
        at += part.count("\n")


_ENV = re.compile(r"(?:process\.env\.|process\.env\[['\"]|os\.environ\[['\"]|os\.environ\.get\(['\"]|os\.getenv\(['\"]|os\.Getenv\(\"|System\.getenv\(\"|env::var\(\")([A-Z][A-Z0-9_]*)")


def environment(path: str, text: str) -> Iterator[Row]:
    for n, line in enumerate(text.split("\n"), 1):
        for m in _ENV.finditer(line):
            yield ("reference", "environment_variable", m[1], path, n, n, m[1], 0.95)


def prisma(path: str, text: str) -> Iterator[Row]:
    """Models of a Prisma schema with their fields' relations."""
    model = None
    for n, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"^\s*model\s+(\w+)\s*\{", line):
            model = m[1]
            yield ("node", "database_model", model, None, n, n, None, 1.0)
        elif model and line.strip() == "}":
            model = None
        elif model and (m := re.match(r"^\s*(\w+)\s+([A-Z]\w*)(\[\])?\??", line)) and m[2] not in ("String", "Int", "Boolean", "DateTime", "Float", "Json", "Decimal", "BigInt", "Bytes"):
            yield ("edge", "REFERENCES", m[1], model, n, n, m[2], 0.95)


register("python", lambda p: p.endswith(".py"), python_symbols)
register("control_flow", lambda p: p.endswith(".py"), control_flow)
register("tokens", lambda p: p.endswith(".py"), fingerprint_tokens)
register("markdown", lambda p: p.endswith((".md", ".mdx")), markdown_intent)
register("comments", lambda p: p.endswith((".py", ".ts", ".js", ".go", ".java", ".rs")), tagged_comments)
register("openapi", lambda p: p.endswith((".json", ".yaml", ".yml")), openapi)
register("asyncapi", lambda p: p.endswith(".asyncapi.json"), asyncapi)
register("deployment", lambda p: p.endswith((".yaml", ".yml")), deployment)
register("environment", lambda p: p.endswith((".py", ".ts", ".js", ".go", ".java", ".rs")), environment)
register("prisma", lambda p: p.endswith(".prisma"), prisma)


def merged(rows: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """Rows of all adapters, each once; references that another adapter explains (file, start_line, name) are left out."""
    once = rows.dropDuplicates(["file", "row_kind", "kind", "name", "qualified_name", "start_line", "target"])
    if suppressed is None:
        return once
    refs = once.where("row_kind = 'reference'").join(suppressed, ["file", "start_line", "name"], "left_anti")
    return once.where("row_kind <> 'reference'").unionByName(refs.select(*once.columns))


def generated(path, text):  # noqa: ANN001, ANN201
    """Whether a file is generated, by its path or by a banner near its top."""
    return path.rlike(r"(^|/)(generated|__generated__)/|\.(g|pb|generated)\.[a-z]+$") | F.substring(text, 1, 2000).rlike(r"(?i)(@generated|auto-?generated|do not edit)")


def files(spark, root: str, rules: tuple[str, ...] | None = None) -> DataFrame:  # noqa: ANN001
    """(path, text, size) of all files below a folder that no rule ignores, paths relative to it."""
    from tessera.functions.paths import IGNORED, SECRETS, ignored

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.col("path"), f"^[a-z]+:/*{re.escape(base)}/", "")
    return raw.select(path.alias("path"), F.col("content").cast("string").alias("text"), F.col("length").alias("size")).where(~ignored(F.col("path"), rules or (*IGNORED, *SECRETS)))
