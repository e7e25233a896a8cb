"""Generation counters, the freshness gate on them, and results cached by them."""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import storage
from tessera.operators.lineage import shared_folder

COUNTERS = ("structural", "semantic", "search", "architecture")


def bumps(changes: DataFrame) -> DataFrame:
    """Which counters a batch of changes raises: repo, batch and a boolean for each counter.

    ``changes``: repo, batch, full, change (added, deleted, renamed, modified), and the booleans graph, location, semantic, search_text, architecture and invalidated
    of a file. Whole rebuilds raise all. Files that come, go or move raise structure, search and architecture; an invalidated file raises meaning and architecture."""
    moved = F.col("change").isin("added", "deleted", "renamed")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    raised = {
        "structural": F.col("full") | F.col("graph") | F.col("location") | moved,
        "semantic": F.col("full") | F.col("semantic") | F.col("invalidated"),
        "search": F.col("full") | F.col("search_text") | moved,
        "architecture": F.col("full") | F.col("architecture") | F.col("invalidated") | moved,
    }
    return changes.groupBy("repo", "batch").agg(*[some(c).alias(name) for name, c in raised.items()])


def counters(raised: DataFrame) -> DataFrame:
    """The counters after each batch of a repo: sums of what was raised so far."""
    w = Window.partitionBy("repo").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return raised.select("repo", "batch", *[F.sum(F.col(c).cast("long")).over(w).alias(c) for c in COUNTERS])


def satisfied(requirement: Column, current: dict[str, Column]) -> Column:
    """Whether an index is fresh enough; ``current`` tells for each counter whether it is that of the sources. Everything needs the structure."""
    base = current["structural"]
    out = F.when(requirement == "structural", base)
    for name in COUNTERS[1:]:
        out = out.when(requirement == name, base & current[name])
    return out.when(requirement == "all", base & current["semantic"] & current["search"] & current["architecture"])


def gate(requests: DataFrame, indexed: DataFrame, sources: DataFrame) -> DataFrame:
    """(request, repo, requirement, fresh): ``requests`` meet the counters of the index and of the sources (repo, counters); a repo without an index is not fresh."""
    i, s = (x.select("repo", *[F.col(c).alias(f"{p}_{c}") for c in COUNTERS]) for x, p in ((indexed, "i"), (sources, "s")))
    j = requests.join(i, "repo", "left").join(s, "repo", "left")
    same = {c: F.coalesce(F.col(f"i_{c}") == F.col(f"s_{c}"), F.lit(False)) for c in COUNTERS}
    return j.select("request", "repo", "requirement", satisfied(F.col("requirement"), same).alias("fresh"))


class ResultCache:
    """Results in the shared folder, under a key of fingerprint, counters, settings and version. One thread computes a key while others wait; processes that compute the same
    one at once write the same rows, and readers see a complete result or none."""

    def __init__(self, spark: SparkSession, name: str = "results") -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}"
        self._own, self._locks = threading.Lock(), {}

    @staticmethod
    def key(fingerprint: str, generations: dict[str, int], settings: dict, version: str, query: str) -> str:
        told = json.dumps([fingerprint, sorted(generations.items()), settings, version, query], sort_keys=True)
        return hashlib.sha256(told.encode()).hexdigest()

    def get(self, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{key}"
        with self._own:
            lock = self._locks.setdefault(key, threading.Lock())
        with lock:
            if not storage.has_table(self.spark, path):
                storage.replace_all(compute(), path)
            return storage.read_current(self.spark, path)
