"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{N}_$-]+"
# Task classes in the order in which they are tried, with their words.
TASKS = (
    ("documentation", "document|documentation|readme|guide|adr"),
    ("refactoring", "refactor|rename|extract|move|split|simplif"),
    ("bug_fix", "bug|broken|crash|error|fail|fix|incorrect|regression"),
    ("architecture", "architecture|flow|explain|overview|onboard"),
    ("feature", "add|change|create|implement|introduce|support|update"),
    ("test_change", "tests?|specs?|fixtures?|coverage"),
)


_WORD = "[0-9A-Za-z_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def says(text: Column, words: str) -> Column:
    """Whether a text holds one of the words (alternatives of plain words, ``?`` and ``.*``) between edges of ASCII words, in any case. Java's own ``\\b`` counts letters of
    all scripts, its ``.`` stops at more than line feeds, and its case rules leave out the long s and the Kelvin sign."""
    plain = words.replace(".", r"[^\n]").replace("s", "[s\u017f]").replace("k", "[k\u212a]")
    return text.rlike(rf"(?i){_EDGE}(?:{plain}){_EDGE}")


def task_class(task: Column) -> Column:
    out = None
    for name, words in TASKS:
        hit = says(task, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def words(text: Column) -> Column:
    """All words of two letters or more, lower case, with repeats."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: F.length(w) > 1)


def query_terms(text: Column, limit: int = 20) -> Column:
    """The first distinct words of a question."""
    return F.slice(F.array_distinct(words(text)), 1, limit)


def identifier_terms(text: Column) -> Column:
    """Words, and the parts of camelCase and snake_case names."""
    spaced = F.regexp_replace(text, r"([\p{Ll}\p{N}])([\p{Lu}])", "$1 $2")
    parts = F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    return F.array_distinct(F.concat(words(text), parts))


#: A string literal in any of three quotes, with escapes; one that is not closed reaches to the end.
_LITERAL = "|".join(rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+(?:{q}|\\?\z)" for q in "'\"`")


def redacted(text: Column) -> Column:
    """A signature without what its literals hold, its white space folded: strings as <literal>, numbers as 0."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, f"(?s){_LITERAL}", "<literal>"), r"\s+", " "))
    return F.regexp_replace(plain, "[0-9]+", "0")


def byte_cut(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of UTF-8, cut between characters, with an ellipsis if cut. A character has four bytes at most, so the
    longest prefix that fits is found among the prefixes of limit/4..limit characters by halving."""
    room = limit - 3
    low, high = F.lit(room // 4), F.lit(room)
    fits = lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= room
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, room - room // 4).bit_length() - 1, -1, -1)])
    longest = F.aggregate(steps, low, lambda n, s: F.when((n + s <= high) & fits(n + s), n + s).otherwise(n))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.substring(text, F.lit(1), longest), F.lit("…")))
