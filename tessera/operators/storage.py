"""Storing tables of nodes, edges and files: upserts, deletes with their cascade, staged replacement, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; columns in ``keep`` stay as they first were."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    is_new = F.col(f"n.{key[0]}").isNotNull()

    def value(c: str) -> Column:
        if c in keep:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return o.join(n, on, "full").select(*[value(c).alias(c) for c in old.columns])


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti").select(*old.columns))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those in ``gone`` (id), and edges without those that lose an end."""
    left = nodes.join(gone, "id", "left_anti")
    ends = edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti")
    return left, ends.select(*edges.columns)


def _folder(spark: SparkSession, path: str):
    """(file system, Hadoop path) by the driver's JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table, the oldest first."""
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[2:]) for n in names if n.startswith("v-") and n[2:].isdigit())


def replace_all(df: DataFrame, path: str) -> None:
    """Replaces a table as a whole. The rows are staged in a folder of their own, which one rename makes the next version; readers take the newest
    version, so at any moment they see all of the old rows or all of the new ones, and a failed write leaves the old version the newest.
    Of two writers at once the rename of the later one fails. Older versions stay for readers that have begun; ``drop_old`` removes them."""
    spark = df.sparkSession
    number = (_versions(spark, path) or [0])[-1] + 1
    fs, staged = _folder(spark, f"{path}/stage-{uuid.uuid4().hex}")
    df.write.parquet(staged.toString())
    _, final = _folder(spark, f"{path}/v-{number}")
    if fs.exists(final) or not fs.rename(staged, final):
        raise RuntimeError(f"version {number} of {path} was written by someone else")


def has_table(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v-{_versions(spark, path)[-1]}")


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes all versions but the newest ``keep``."""
    for number in _versions(spark, path)[:-keep]:
        fs, old = _folder(spark, f"{path}/v-{number}")
        fs.delete(old, True)


def prune(snapshots: DataFrame, keep: int, pinned: tuple[str, ...] = ()) -> DataFrame:
    """Of (id, created_at) the newest ``keep``, and whatever is pinned. Only ids and times are ranked."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("created_at"), "id")
    return snapshots.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= keep) | F.col("id").isin(*pinned) if pinned else F.col("_n") <= keep).drop("_n")


def moved_lines(edges: DataFrame, shifts: DataFrame) -> DataFrame:
    """Edges with new lines, and ids that follow from them, after their files' lines have moved (file, shift)."""
    from tessera.model import edge_id

    line = F.col("line") + F.coalesce("shift", F.lit(0))
    return edges.join(shifts, "file", "left").select("source", "target", "type", "file", line.alias("line")).withColumn("id", edge_id(F.col("type"), F.col("source"), F.col("target"), F.col("file"), F.col("line")))
