"""Integrity of a bundle of tables, and what adapters may return."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integrity(nodes: DataFrame, edges: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """(code, subject): repeated ids, edges without an end, confidences out of range, and counts that are not what was recorded."""
    twice = lambda df, code: df.groupBy("id").count().where("count > 1").select(F.lit(code).alias("code"), F.col("id").alias("subject"))
    ids = nodes.select("id").distinct()
    dangling = lambda end: edges.join(ids, F.col(end) == ids["id"], "left_anti").select(F.lit(f"dangling_{end}").alias("code"), F.col("id").alias("subject"))
    found = [twice(nodes, "duplicate_node"), twice(edges, "duplicate_edge"), dangling("source"), dangling("target"), edges.where("confidence < 0 OR confidence > 1 OR confidence IS NULL").select(F.lit("confidence_range").alias("code"), F.col("id").alias("subject"))]
    for name, df in (("nodes", nodes), ("edges", edges)):
        if counts and name in counts:
            found.append(df.agg(F.count("*").alias("n")).where(F.col("n") != counts[name]).select(F.lit("statistics_drift").alias("code"), F.lit(name).alias("subject")))
    return reduce(DataFrame.unionByName, found)


def extraction_contract(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """What an adapter returned that it may not: (id, reason), the first reason of each row."""
    reason = F.when(F.col("id").isNull() | (F.col("id") == ""), "no id").when(~F.col("kind").isin(*kinds), "unknown kind").when(F.coalesce("name", F.lit("")) == "", "no name").when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "line range").when(~F.col("confidence").between(0, 1), "confidence")
    return rows.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def review(violations: DataFrame, impacted: DataFrame, tested: DataFrame, limit: int = 250) -> DataFrame:
    """Findings of a review, the gravest first: violated rules, wide impact, changes without a test; only with evidence."""
    rules = violations.where("size(evidence_ids) > 0").select(F.lit("rule").alias("finding"), F.col("id").alias("subject"), "severity")
    wide = impacted.where("n_affected >= 10").select(F.lit("impact").alias("finding"), F.col("id").alias("subject"), F.when(F.col("n_affected") >= 50, "high").otherwise("medium").alias("severity"))
    bare = impacted.join(tested, "id", "left_anti").select(F.lit("missing test").alias("finding"), F.col("id").alias("subject"), F.lit("low").alias("severity"))
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return rules.unionByName(wide).unionByName(bare).orderBy(rank, "finding", "subject").limit(limit)
