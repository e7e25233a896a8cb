"""Connected components of a graph whose edges stay on the executors.

Alternating large-star and small-star steps (Kiveris et al.), each an aggregate of minima and a join that adaptive
execution can split where one vertex has very many neighbours. Before each round a union-find over every partition
replaces its edges by stars, so dense groups shrink to a tree at once and rounds stay few. Each round is a written table.

Edges that are left and are counted to be at most ``FEW`` go through one more union-find in a single task, whose memory that
number bounds, instead of further rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import forget, keep


#: Edges that one task may finish by itself: at most about 100 MB of its memory.
FEW = 500_000


class Forest:
    """Union-find over 64-bit numbers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        ids = list(self.up)
        return np.asarray(ids, np.int64), np.asarray([self.root(x) for x in ids], np.int64)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.join(a, b)
    a, b = forest.stars()
    for i in range(0, len(a), 50_000):
        yield pa.RecordBatch.from_pydict({"a": a[i : i + 50_000], "b": b[i : i + 50_000]})


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). Returns (id, root) for every vertex with an edge to another; root is the smallest id."""
    local = edges.select("a", "b").where("a <> b").mapInArrow(_stars, "a long, b long")
    now = keep(local)
    if now.limit(FEW + 1).count() <= FEW:
        now = keep(now.coalesce(1).mapInArrow(_stars, "a long, b long"))
        return _with_roots(now)
    return _rounds(now)


def _with_roots(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _rounds(now: DataFrame) -> DataFrame:
    spark = now.sparkSession
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = keep(small.select("e.a", "e.b").where("a <> b").distinct())
        # done when every vertex points to one root and no root points on
        open_ = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a").unionByName(after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a"))
        done = open_.isEmpty()
        forget(spark, now.tessera_path)
        now = after
        if done:
            return _with_roots(now)
