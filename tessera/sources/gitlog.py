"""Git's text outputs as tables: logs with numbers of lines, name and status lists, porcelain status, unified diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numstat_log(lines: DataFrame) -> DataFrame:
    """``lines``: n (line number), value; of ``git log --numstat --format=@%H|%an|%aI``. A row for each file of each commit."""
    head = F.regexp_extract("value", r"^@([0-9a-f]+)\|([^|]*)\|(.+)$", 1)
    marked = lines.withColumn("_h", F.when(F.col("value").startswith("@"), F.struct(head.alias("commit"), F.regexp_extract("value", r"^@([0-9a-f]+)\|([^|]*)\|(.+)$", 2).alias("author"), F.regexp_extract("value", r"^@([0-9a-f]+)\|([^|]*)\|(.+)$", 3).alias("date"))))
    # one log is one sequence of lines: its own partition
    w = Window.partitionBy("log").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    filled = (marked if "log" in lines.columns else marked.withColumn("log", F.lit(0))).withColumn("_h", F.last("_h", ignorenulls=True).over(w))
    parts = F.split("value", "\t")
    rows = filled.where(F.col("value").rlike(r"^(\d+|-)\t(\d+|-)\t"))
    number = lambda i: F.when(parts[i] == "-", F.lit(0)).otherwise(parts[i].cast("int"))
    return rows.select("_h.commit", "_h.author", "_h.date", parts[2].alias("file"), number(0).alias("added"), number(1).alias("deleted"))


def name_status(output: Column) -> Column:
    """``git diff --name-status -z``: an array of (status, similarity, previous, path)."""
    # an entry is a state and its paths; the next begins where it ends, so one pass finds them all and nothing is copied along
    entries = F.regexp_extract_all(output, F.lit(r"\G\x00*+((?:[RC][^\x00]*+\x00++[^\x00]++|[^RC\x00][^\x00]*+)\x00++[^\x00]++)"), F.lit(1))

    def row(entry: Column) -> Column:
        cells = F.filter(F.split(entry, "\u0000"), lambda c: c != "")
        similarity = F.when(cells[0].rlike(r"^[RC]\d+$"), F.substring(cells[0], F.lit(2), F.lit(9)).cast("int"))
        return F.struct(F.substring(cells[0], F.lit(1), F.lit(1)).alias("status"), similarity.alias("similarity"), F.when(F.size(cells) > 2, cells[1]).alias("previous"), F.element_at(cells, -1).alias("path"))

    return F.transform(entries, row)


def porcelain(lines: DataFrame) -> DataFrame:
    """``git status --porcelain``: status and path; a rename's previous path."""
    v = F.col("value")
    rest = F.substring(v, F.lit(4), F.length(v))
    renamed = F.contains(rest, F.lit(" -> "))
    return lines.where(F.length("value") > 3).select(F.trim(F.substring(v, 1, 2)).alias("status"), F.when(renamed, F.split(rest, " -> ")[0]).alias("previous"), F.when(renamed, F.split(rest, " -> ")[1]).otherwise(rest).alias("path"))


def changed_ranges(diff: Column) -> Column:
    """Old and new line ranges of the hunks of a unified diff; a range without lines stands at its position."""
    heads = F.regexp_extract_all(diff, F.lit(r"(?m)^(@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"), F.lit(1))

    def side(h: Column, mark: str) -> tuple[Column, Column]:
        start = F.regexp_extract(h, rf"\{mark}(\d+)", 1).cast("int")
        n = F.regexp_extract(h, rf"\{mark}\d+,(\d+)", 1)
        return start, start + F.greatest(F.when(n == "", F.lit(1)).otherwise(F.nullif(n, F.lit("")).cast("int")) - 1, F.lit(0))

    def one(h: Column) -> Column:
        (a, b), (c, d) = side(h, "-"), side(h, "+")
        return F.struct(a.alias("old_start"), b.alias("old_end"), c.alias("new_start"), d.alias("new_end"))

    return F.transform(heads, one)
