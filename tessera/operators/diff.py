"""Differences of snapshots, classes of change, moves and renames, and what a change invalidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import cut


def sections(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """For each section of two snapshots (tables with an id and a hash): section, id, status added, removed or changed."""
    out = []
    for name in sorted(old.keys() & new.keys()):
        o, n = old[name].select(F.col("id").alias("oid"), F.col("hash").alias("oh")), new[name].select(F.col("id").alias("nid"), F.col("hash").alias("nh"))
        status = F.when(F.col("oid").isNull(), "added").when(F.col("nid").isNull(), "removed").when(~F.col("oh").eqNullSafe(F.col("nh")), "changed")
        out.append(o.join(n, F.col("oid") == F.col("nid"), "full").select(F.lit(name).alias("section"), F.coalesce("nid", "oid").alias("id"), status.alias("status")).where("status IS NOT NULL"))
    return reduce(DataFrame.unionByName, out)


def moved(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of a removed and an added symbol with the same key in different files, one to one in the order of their ids."""
    w = Window.partitionBy(*key).orderBy("id")
    gone = old.join(new.select("id"), "id", "left_anti").withColumn("_n", F.row_number().over(w))
    come = new.join(old.select("id"), "id", "left_anti").withColumn("_n", F.row_number().over(w))
    a = gone.select(*key, "_n", F.col("id").alias("old_id"), F.col("file").alias("old_file"))
    b = come.select(*key, "_n", F.col("id").alias("new_id"), F.col("file").alias("new_file"))
    return a.join(b, [*key, "_n"]).where("old_file <> new_file").drop("_n")


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, previous, kind) of two manifests (path, hash): added, modified, deleted, or renamed where one gone and one new file, and no
    others, have the same content."""
    o, n = old.select(F.col("path").alias("op"), F.col("hash").alias("oh")), new.select(F.col("path").alias("np"), F.col("hash").alias("nh"))
    j = o.join(n, F.col("op") == F.col("np"), "full")
    kind = F.when(F.col("op").isNull(), "added").when(F.col("np").isNull(), "deleted").when(F.col("oh") != F.col("nh"), "modified")
    rows = cut(j.select("op", "np", "oh", "nh", kind.alias("kind")).where("kind IS NOT NULL"))
    alone = lambda df, h: df.groupBy(h).agg(F.count("*").alias("_n"), F.first("p").alias("p")).where("_n = 1").drop("_n")
    gone = alone(rows.where("kind = 'deleted'").select(F.col("op").alias("p"), F.col("oh").alias("h")), "h").withColumnRenamed("p", "previous")
    come = alone(rows.where("kind = 'added'").select(F.col("np").alias("p"), F.col("nh").alias("h")), "h").withColumnRenamed("p", "path")
    renamed = gone.join(come, "h").select("path", "previous")
    plain = rows.select(F.coalesce("np", "op").alias("path"), "kind")
    rest = plain.join(renamed.select("path"), "path", "left_anti").join(renamed.select(F.col("previous").alias("path")), "path", "left_anti")
    return rest.select("path", F.lit(None).cast("string").alias("previous"), "kind").unionByName(renamed.select("path", "previous", F.lit("renamed").alias("kind")))


def best_change(changes: DataFrame) -> DataFrame:
    """Of changes with the same kind and paths, the one with the highest similarity."""
    w = Window.partitionBy("kind", "previous", "path").orderBy(F.desc("similarity"))
    return changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def renamed_ids(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New nodes with the id of the old node of the same identity, where there is one."""
    o = old.select(*key, F.col("id").alias("_old"))
    return new.join(o, key, "left").withColumn("id", F.coalesce("_old", "id")).drop("_old")


def rename_chains(renames: DataFrame, least: float = 0.5) -> DataFrame:
    """(previous, path): where each file ends up after chains of accepted renames. A rename counts if similar enough and if its target has
    no other source; cycles end where they close. Chains of any length are followed, a round for each link of the longest."""
    one = renames.where(F.col("similarity") >= least)
    unique = one.groupBy("path").agg(F.count("*").alias("_n"), F.first("previous").alias("previous")).where("_n = 1").select("previous", "path")
    step = cut(unique.select(F.col("previous").alias("_from"), F.col("path").alias("_to")))
    # a target has one source, so a chain can only close at its own start
    now = step.select(F.col("_from").alias("previous"), F.col("_to").alias("path"))
    ended = []
    while not now.isEmpty():
        grown = cut(now.join(step, now["path"] == step["_from"], "left").select("previous", "path", F.when(F.col("_to") != F.col("previous"), F.col("_to")).alias("next")))
        ended.append(grown.where("next IS NULL").select("previous", "path"))
        now = grown.where("next IS NOT NULL").select("previous", F.col("next").alias("path"))
        if len(ended) > 20:  # a short plan, however many rounds there are
            ended = [cut(reduce(DataFrame.unionByName, ended))]
    return reduce(DataFrame.unionByName, ended, now)


def delta_class(prints: dict[str, tuple[Column, Column]]) -> Column:
    """The class of a file's change from pairs of old and new fingerprints, the farthest-reaching first."""
    out = None
    for name, (old, new) in prints.items():
        differs = ~old.eqNullSafe(new)
        out = F.when(differs, name) if out is None else out.when(differs, name)
    return out.otherwise("unchanged")


def invalidated(changed: DataFrame, links: DataFrame, unresolved: DataFrame, all_files: DataFrame, config_changed: bool, limit: int = 2000) -> tuple[DataFrame, bool]:
    """Files to analyse again: the changed ones, those that import them, and those with an unresolved name that a changed file now
    defines; everything if the module configuration has changed. Second: whether a full rebuild is due."""
    if config_changed:
        return all_files, True
    importers = links.join(changed.select(F.col("file").alias("target_file")), "target_file", "left_semi").select(F.col("source_file").alias("file"))
    out = changed.select("file").union(importers).union(unresolved.join(changed.select("name").distinct(), "name", "left_semi").select("file")).distinct()
    out = cut(out)
    return out, out.limit(limit + 1).count() > limit
