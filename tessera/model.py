"""The property-graph model: kinds, edge types, the predicates that every operator shares, and stable identities.

Nodes have id, kind, name, qualified_name, file, domain, confidence; edges have id, source, target, type, confidence,
source_type. Both are plain DataFrames; more columns may follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Edge types that are no dependency, and that carry no impact.
NON_DEPENDENCY = ("CONTAINS", "EXPORTS", "BELONGS_TO_FEATURE", "BELONGS_TO_DOMAIN", "RENAMED_FROM")
NON_IMPACT = (*NON_DEPENDENCY, "ROUTE_PREFIX")
# Edge types that callers, flows and traces follow; traces prefer the earlier ones.
CALLER_TYPES = ("CALLS", "HANDLES", "TRIGGERS", "MAY_CONTINUE_TO")
FLOW_TYPES = ("HANDLES", "CALLS", "MAY_CONTINUE_TO", "TRIGGERS", "IMPLEMENTED_BY", "QUERIES", "UPDATES", "READS_FROM", "WRITES_TO")
# What an edge type is worth to a trace; types that are not listed are not followed.
TRACE_PRIORITY = {
    "HANDLES": 100, "PROTECTED_BY": 98, "IMPLEMENTED_BY": 96, "MAY_CONTINUE_TO": 94, "CALLS": 92, "QUERIES": 90, "UPDATES": 90, "IMPLEMENTS_CONTRACT": 99,
    "ACCEPTS": 87, "RETURNS": 87, "PUBLISHES": 88, "SUBSCRIBES": 88, "TRIGGERS": 86, "USES_EXTERNAL_SERVICE": 84, "READS_FROM": 82, "WRITES_TO": 82,
    "APPLIES_HOOK": 80, "MOUNTS": 78, "DECORATES": 76, "DEPENDS_ON": 70, "REFERENCES": 50, "IMPORTS": 40, "ROUTE_PREFIX": 30,
}
# Edges that a shortest path ignores.
NON_PATH = ("CONTAINS", "BELONGS_TO_FEATURE", "BELONGS_TO_DOMAIN")
# The kinds that a search returns, and the edge types that count as dependencies.
SEARCHABLE = (
    "file", "documentation", "class", "interface", "function", "method", "variable", "api_route", "endpoint", "database_model", "database_table", "external_service",
    "external_actor", "service", "process", "http_contract", "contract_schema", "contract_drift", "job", "datastore", "environment_variable",
    "configuration_key", "test", "feature", "domain", "event", "queue", "topic",
)
DEPENDENCY_TYPES = (
    "IMPORTS", "CALLS", "REFERENCES", "EXTENDS", "IMPLEMENTS", "DEPENDS_ON", "READS_FROM", "WRITES_TO", "HANDLES", "TRIGGERS", "PUBLISHES", "SUBSCRIBES",
    "TESTS", "CONFIGURES", "USES_EXTERNAL_SERVICE", "MOUNTS", "APPLIES_HOOK", "DECORATES", "IMPLEMENTED_BY", "PROTECTED_BY", "MAY_CONTINUE_TO",
    "ROUTE_PREFIX", "QUERIES", "UPDATES", "ACCEPTS", "RETURNS", "IMPLEMENTS_CONTRACT",
)

DEFINITE = 0.95


def impact_edge(kind: str = "type") -> Column:
    return ~F.col(kind).isin(*NON_IMPACT)


def definite(confidence: str = "confidence", source_type: str = "source_type", kind: str = "type", fact_class: str | None = None) -> Column:
    """Certain enough to speak of impact: confidence, no guess, and a type that carries impact; where edges have a fact class, none
    that is inferred."""
    sure = (F.col(confidence) >= DEFINITE) & ~F.col(source_type).isin("heuristic", "embedding", "llm") & impact_edge(kind)
    return sure if fact_class is None else sure & (F.coalesce(F.col(fact_class), F.lit("")) != "INFERRED")


def definite_of(edges: DataFrame) -> Column:
    """``definite`` by the columns that a table of edges has."""
    return definite(fact_class="fact_class" if "fact_class" in edges.columns else None)


def potential(confidence: str = "confidence", source_type: str = "source_type", kind: str = "type", fact_class: str | None = None) -> Column:
    return impact_edge(kind) & ~definite(confidence, source_type, kind, fact_class)


def provenance(source_type: str = "source_type") -> Column:
    s = F.col(source_type)
    return F.when(s == "heuristic", "inferred").when(s == "documentation", "documentation").when(s == "git", "git").otherwise("verified")


def node_id(repo: Column, kind: Column, file: Column, qualified_name: Column) -> Column:
    return F.sha2(F.concat_ws(":", repo, kind, F.coalesce(file, F.lit("")), F.coalesce(qualified_name, F.lit(""))), 256)


def edge_id(kind: Column, source: Column, target: Column, file: Column, line: Column) -> Column:
    return F.sha2(F.concat_ws(":", kind, source, target, F.coalesce(file, F.lit("")), F.coalesce(line.cast("string"), F.lit(""))), 256)


def sorted_hash(values: Column) -> Column:
    """A hash of a set of strings that does not depend on their order."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(values)), "\n"), 256)
