"""Metrics and findings over a file graph, and roll-ups of the symbol graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import glob_pattern


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast("long"))


def file_metrics(links: DataFrame, churn: DataFrame) -> DataFrame:
    """Fan-in, fan-out, what leaves the top directory, connectivity, churn and lines of every file with a link."""
    top = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(1))
    out = links.groupBy(F.col("source_file").alias("file")).agg(F.count_distinct("target_file").alias("fan_out"), F.count_distinct(F.when(top("source_file") != top("target_file"), F.col("target_file"))).alias("cross_out"))
    into = links.groupBy(F.col("target_file").alias("file")).agg(F.count_distinct("source_file").alias("fan_in"))
    both = out.join(into, "file", "full")
    joined = both.join(churn, "file", "left")
    return joined.select("file", _zero("fan_in").alias("fan_in"), _zero("fan_out").alias("fan_out"), _zero("cross_out").alias("cross_out"), (_zero("fan_in") + _zero("fan_out")).alias("connectivity"), _zero("churn").alias("churn"), F.coalesce("line_count", F.lit(1)).alias("line_count"))


def picked_percentile(rows: DataFrame, column: str, share: float) -> DataFrame:
    """One row with sorted[floor((n - 1) * share)]. A histogram of distinct values is ranked, not the rows."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    one = Window.partitionBy(F.lit(0))
    upto = F.sum("_n").over(one.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    at = F.floor((F.sum("_n").over(one) - 1) * F.lit(share))
    return counts.withColumn("_upto", upto).withColumn("_at", at).where(F.col("_upto") > F.col("_at")).agg(F.min("_v").alias("value"))


def hotspots(metrics: DataFrame) -> DataFrame:
    """connectivity * log2(churn + 2), and whether both reach their thresholds (third quartiles, at least 2 and 1)."""
    conn = picked_percentile(metrics, "connectivity", 0.75).select(F.greatest(F.lit(2), F.coalesce("value", F.lit(0))).alias("conn_t"))
    churn = picked_percentile(metrics.where("churn > 0"), "churn", 0.75).select(F.greatest(F.lit(1), F.coalesce("value", F.lit(0))).alias("churn_t"))
    m = metrics.join(conn).join(churn)  # one row each
    return m.withColumn("hotspot", F.round(F.col("connectivity") * F.log2(F.col("churn") + 2), 2)).withColumn("is_hotspot", (F.col("connectivity") >= F.col("conn_t")) & (F.col("churn") >= F.col("churn_t")))


def findings(metrics: DataFrame, symbols: DataFrame, fan: int = 10, file_lines: int = 500, symbol_lines: int = 80) -> DataFrame:
    """A row for each threshold that a file or symbol reaches; twice the threshold is severe."""

    def over(df: DataFrame, name: str, key: str, value: str, limit: int) -> DataFrame:
        return df.where(F.col(value) >= limit).select(F.lit(name).alias("finding"), F.col(key).alias("file"), F.when(F.col(value) >= 2 * limit, "high").otherwise("medium").alias("severity"))

    hot = metrics.where("is_hotspot").select(F.lit("change_hotspot").alias("finding"), "file", F.when(F.col("hotspot") >= 8 * F.col("conn_t"), "high").otherwise("medium").alias("severity"))
    parts = [over(metrics, "high_fan_in", "file", "fan_in", fan), over(metrics, "high_fan_out", "file", "fan_out", fan), over(metrics, "large_file", "file", "line_count", file_lines), hot, over(symbols, "large_symbol", "id", "lines", symbol_lines)]
    return reduce(DataFrame.unionByName, parts)


def history(log: DataFrame, days: int) -> DataFrame:
    """``log``: file, commit, author, churn, ts."""
    last = log.agg(F.max("ts").alias("_last"))
    recent = log.join(last).where(F.col("ts") >= F.col("_last") - F.expr(f"INTERVAL {days} DAYS"))  # one row on the right
    return recent.groupBy("file").agg(F.count_distinct("commit").alias("commits"), F.count_distinct("author").alias("contributors"), F.round(F.sum("churn"), 4).alias("churn"), F.max_by("commit", F.struct("ts", "commit")).alias("latest"))


def hubs(links: DataFrame, a: str, b: str, limit: int) -> DataFrame:
    """Files whose degree is at least max(8, ceil(sqrt(files))), the highest first."""
    ends = links.select(F.col(a).alias("file"), F.lit(0).alias("i")).union(links.select(F.col(b), F.lit(1)))
    degree = ends.groupBy("file").agg(F.sum("i").cast("long").alias("in_degree"), F.sum(1 - F.col("i")).cast("long").alias("out_degree"), F.count("*").alias("degree"))
    least = degree.agg(F.greatest(F.lit(8), F.ceil(F.sqrt(F.count("*")))).alias("_least"))
    return degree.join(least).where("degree >= _least").drop("_least").orderBy(F.desc("degree"), "file").limit(limit)


def aggregate_edges(links: DataFrame, source: Column, target: Column, k: int) -> DataFrame:
    """Links between groups: their number, sorted ids, and the ids of the k most certain."""
    g = links.select(source.alias("source_group"), target.alias("target_group"), "id", "confidence").where("source_group <> target_group")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "id")))
    return g.groupBy("source_group", "target_group").agg(F.count("*").alias("n_edges"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"), F.array_join(F.transform(F.slice(ranked, 1, k), lambda x: x["id"]), ",").alias("representatives"))


def domains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    members = nodes.where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("members"), F.count_distinct("file").alias("files"), F.count_if(F.col("kind") == "endpoint").alias("entrypoints"))
    s, g = (nodes.select(F.col("id").alias(f"_{x}"), F.col("domain").alias(f"_{x}d")) for x in "st")
    j = edges.join(s, F.col("source") == F.col("_s")).join(g, F.col("target") == F.col("_t")).where("_sd IS NOT NULL")
    links = j.groupBy(F.col("_sd").alias("domain")).agg(F.count_if(F.col("_sd") == F.col("_td")).alias("internal"), F.count_if(F.col("_td").isNull() | (F.col("_sd") != F.col("_td"))).alias("outgoing"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return members.join(links, "domain", "left").select("domain", "members", "files", "entrypoints", _zero("internal").alias("internal"), _zero("outgoing").alias("outgoing"), "confidence")


def cycles(links: DataFrame, components: DataFrame) -> DataFrame:
    """Strong components with their inner links; four members make a cycle severe."""
    a, b = (components.select(F.col("id").alias(f"_{x}"), F.col("component").alias(f"_{x}c")) for x in "ab")
    inner = links.join(a, F.col("source") == F.col("_a")).join(b, F.col("target") == F.col("_b")).where("_ac = _bc")
    out = inner.groupBy(F.col("_ac").alias("component")).agg(F.count("*").alias("n_edges"), F.least(F.lit(0.95), F.min("confidence")).alias("confidence"))
    size = components.select("component", "size").distinct()
    return out.join(size, "component").select("component", "size", "n_edges", "confidence", F.when(F.col("size") >= 4, "high").otherwise("medium").alias("severity"))


def contribution(value: Column, weight: float, cap: float) -> Column:
    """What a count adds to an impact score: logarithmic, rounded, capped."""
    return F.least(F.lit(float(cap)), F.round(F.log2(value + 1) * weight, 2))


# The weight of each sign that files belong together.
SIGNALS = {"directory": 0.35, "cluster": 0.1, "name": 0.1, "route": 0.15, "model": 0.15, "test": 0.1, "link": 0.1, "community": 0.1}


def grouping_confidence(**signals: Column) -> Column:
    return F.round(F.least(F.lit(0.95), sum((F.when(c, F.lit(SIGNALS[s])).otherwise(0.0) for s, c in signals.items()), F.lit(0.0))), 2)


def override_domains(nodes: DataFrame, overrides: list[tuple[str, str]]) -> DataFrame:
    """Reassigns the domain of nodes whose file a glob matches; the last override wins."""
    domain = F.col("domain")
    for glob, to in overrides:
        domain = F.when(F.col("file").rlike(glob_pattern(glob)), F.lit(to)).otherwise(domain)
    return nodes.withColumn("domain", domain)
