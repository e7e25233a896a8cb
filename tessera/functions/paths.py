"""Path classifiers and globs as column expressions; patterns are compiled once, when the plan is built."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_S = r"(^|/)"
# The scopes in the order in which they are tried, each with the patterns that make it (lower-case paths).
SCOPES = (
    ("fixture", (rf"{_S}(tests?|__tests__)/fixtures?(/|$)", rf"{_S}(fixtures?|__fixtures__)(/|$)")),
    ("example", (rf"{_S}(examples?|samples?|demos?)(/|$)",)),
    ("test", (rf"{_S}(tests?|__tests__|specs?)(/|$)", r"\.(spec|test|spec-d|test-d)\.[^/]+$", r"(^|/)(tests?|spec)([-_.][^/]*)?\.[^/.]+$")),
    ("generated", (rf"{_S}(dist|build|coverage|generated|__generated__|vendor|node_modules)(/|$)",)),
    ("documentation", (rf"{_S}(docs?|documentation)(/|$)", r"\.(md|mdx|rst|adoc)$", r"(^|/)(license|copying|notice)(\.[^/]*)?$")),
    ("tooling", (rf"{_S}(scripts?|tools?)(/|$)", r"(^|/)(bench|benchmark|performance)([-_.][^/]*)?\.[^/]+$")),
    ("configuration", (r"\.(json|jsonc|yaml|yml|toml)$", rf"{_S}(\.github|config)(/|$)", r"(^|/)\.(gitignore|gitattributes|npmignore|editorconfig)$")),
)
# Languages by extension.
LANGUAGES = {
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "jsx",
    ".py": "python", ".pyi": "python", ".go": "go", ".java": "java", ".rs": "rust", ".json": "json", ".jsonc": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
}
# What a scan leaves out unless told otherwise, and files that may hold secrets.
IGNORED = (".git/", "node_modules/", "dist/", "build/", "coverage/", ".next/", "venv/", ".venv/", "__pycache__/", "vendor/", "target/")
SECRETS = (".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa", "id_ed25519", "credentials.*")


def normal(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def scope(path: Column) -> Column:
    """The architectural scope of a file, by the first pattern that matches; a JVM package that happens to be named
    example is no example."""
    p = normal(path)
    out = F.when(path.isNull() | (F.trim(path) == ""), "unknown")
    for name, patterns in SCOPES:
        hit = reduce(lambda a, b: a | b, [p.rlike(x) for x in patterns])
        if name == "example":
            outside = F.regexp_replace(p, rf"{_S}src/[^/]+/(java|kotlin)/.*$", "/")
            hit = outside.rlike(patterns[0])
        out = out.when(hit, name)
    return out.otherwise("production")


def is_primary(scope_: Column) -> Column:
    return scope_.isin("production", "configuration")


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ** crosses directories, * and ? do not, {a,b} are alternatives."""
    out, i, braces = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            braces += 1
            out += "(?:"
        elif c == "}" and braces:
            braces -= 1
            out += ")"
        elif c == "," and braces:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def glob_filter(path: Column, include: list[str], exclude: list[str] | None = None) -> Column:
    any_of = lambda globs: reduce(lambda a, b: a | b, [path.rlike(glob_pattern(g)) for g in globs], F.lit(False))
    return any_of(include) & ~any_of(exclude or [])


def ignored(path: Column, rules: tuple[str, ...] = (*IGNORED, *SECRETS)) -> Column:
    """Ignore rules as of a file at the root: a trailing slash means a directory, a leading one anchors, ! takes back."""
    out = F.lit(False)
    for rule in rules:
        keep = rule.startswith("!")
        body = rule.lstrip("!")
        anchored = body.startswith("/") or "/" in body.rstrip("/")
        core = glob_pattern(body.strip("/"))[1:-1]
        pattern = ("^" if anchored else "(^|/)") + core + ("/" if body.endswith("/") else "(/|$)")
        out = F.when(path.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


def joined_route(prefix: Column, path: Column) -> Column:
    """A route below a prefix, with single slashes."""
    return F.regexp_replace(F.concat(F.lit("/"), F.coalesce(prefix, F.lit("")), path, F.lit("/")), "/+", "/")


def directories(path: Column) -> Column:
    """All directories above a file, the nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
