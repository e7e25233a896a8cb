"""Architecture rules: selectors compiled to columns, forbidden edges, forbidden bounded paths, crossed domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import definite_of
from tessera.operators.lineage import cut

# Layer names in the order in which they are looked for.
LAYERS = ("controller", "service", "repository", "model", "api", "worker", "test")


def layer(qualified_name: Column, file: Column, name: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(qualified_name, F.lit("")), F.coalesce(file, F.lit("")), name))
    return F.coalesce(*[F.when(F.contains(text, F.lit(x)), F.lit(x)) for x in LAYERS])


def selector(wanted: dict[str, str], prefix: str = "") -> Column:
    """All conditions of a selector, as one predicate on a node's columns; other keys are looked up in ``metadata``."""
    col = lambda c: F.col(prefix + c)

    def one(key: str, value: str) -> Column:
        value = value.lower()
        if key in ("kind", "domain"):
            return F.lower(col(key)) == value
        if key == "layer":
            return layer(col("qualified_name"), col("file"), col("name")) == value
        if key == "matches_path":
            return F.contains(F.lower(F.coalesce(col("file"), F.lit(""))), F.lit(value))
        return F.lower(F.coalesce(col("metadata")[key], F.lit(""))) == value

    return reduce(lambda a, b: a & b, (one(k, v) for k, v in wanted.items()), F.lit(True))


def named(nodes: DataFrame) -> DataFrame:
    """Nodes with a qualified name, null where the table has none."""
    return nodes if "qualified_name" in nodes.columns else nodes.withColumn("qualified_name", F.lit(None).cast("string"))


def _ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    s = nodes.select(*[F.col(c).alias(f"s_{c}") for c in nodes.columns])
    g = nodes.select(*[F.col(c).alias(f"t_{c}") for c in nodes.columns])
    return edges.join(s, F.col("source") == F.col("s_id")).join(g, F.col("target") == F.col("t_id"))


def direct_violations(nodes: DataFrame, edges: DataFrame, source: dict[str, str], target: dict[str, str], types: tuple[str, ...] | None = None) -> DataFrame:
    """Definite edges from what one selector takes to what the other takes."""
    e = edges.where(definite_of(edges))
    if types:
        e = e.where(F.col("type").isin(*types))
    return _ends(named(nodes), e).where(selector(source, "s_") & selector(target, "t_"))


def crosses_domain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends both have a domain, and not the same."""
    return _ends(nodes.select("id", "domain"), edges).where("s_domain <> t_domain").select(*edges.columns, F.col("s_domain").alias("source_domain"), F.col("t_domain").alias("target_domain"))


def path_violations(nodes: DataFrame, edges: DataFrame, sources: DataFrame, target: Column, unless: Column | None = None, depth: int = 12) -> DataFrame:
    """Definite simple paths of up to ``depth`` edges from the sources to a node that ``target`` takes, not by way of one that
    ``unless`` takes: source, target, path. A path ends where it meets a target, and what its last node is left by is looked through in the order
    of edge ids up to the first target only."""
    flags = named(nodes).select(F.col("id").alias("_n"), F.coalesce(target, F.lit(False)).alias("_hit"), F.coalesce(F.lit(False) if unless is None else unless, F.lit(False)).alias("_cut"))
    step = cut(edges.where(definite_of(edges)).select(F.col("id").alias("_e"), F.col("source").alias("_from"), F.col("target").alias("_to")).join(flags, F.col("_to") == F.col("_n")).drop("_n"))
    level = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.array("id").alias("path"), F.lit("").alias("_way"))
    out: DataFrame | None = None
    for d in range(depth):
        grown = level.join(step, F.col("node") == F.col("_from")).where(~F.array_contains("path", F.col("_to")))
        first = F.min(F.when(F.col("_hit"), F.col("_e"))).over(Window.partitionBy("source", "_way", "path"))
        grown = grown.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("_e") <= F.col("_first")))
        grown = grown.select("source", F.col("_to").alias("node"), F.concat("path", F.array("_to")).alias("path"), F.concat_ws("\n", "_way", "_e").alias("_way"), "_hit", "_cut")
        if d < depth - 1:
            grown = cut(grown)
        hit = grown.where("_hit").select("source", F.col("node").alias("target"), "path")
        out = hit if out is None else out.unionByName(hit)
        level = grown.where("NOT _hit AND NOT _cut").select("source", "node", "path", "_way")
        if d < depth - 1 and level.isEmpty():
            break
    return out
