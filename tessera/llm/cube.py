"""Mixing sources to target weights by the cube method (Deville and Tille's balanced sampling).

Each source gets a target number of words; a document of the source is expected target / source size times. The
whole part of that ratio is taken for certain, the fractional part is a balanced sample: the flight phase moves
the vector of inclusion probabilities through the null space of the balancing constraints (number of documents and
number of words), so both totals stay exact. When ``LANDING`` documents of a source are left that may still be fractional, the landing
phase draws from a design over the subsets of those: the linear programme that keeps every inclusion probability and makes the expected
distance from the total of words (and, far behind, of documents) as small as can be. So each document is taken as often as its source's ratio says on average,
and the totals are off by what the landing of at most ``LANDING`` documents leaves.

The flight runs in chunks of about ``chunk`` documents of one source, the largest first. What a chunk leaves
fractional, two documents at most, meets in the next round, so a source of any size needs log(n) rounds and no task sees
more than a chunk. Chunks are dealt by a hash of the row and random numbers are seeded by source, round and chunk: reruns agree.

Edge cases. Null or empty text: size 0, never sampled (0 words whatever is taken), taken 0. Null id: a document like any other. Null source: a source of its own,
ordered last. Ties in size are ordered by id, then by row. Repeated rows and ids: each row is a document of its own. A source whose size is 0 has target 0. No
rows: no rows. Other columns of the input are not touched; their names cannot clash, as the operator reads
expressions and returns a table with columns of its own.
"""

from __future__ import annotations

import random
import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import keep

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one chunk of the flight phase.
CHUNK = 1024
#: Documents of a source that the landing phase decides on at once.
LANDING = 12
SEED = 20


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_levels(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of all words by weight, none above cap x its source's size.

    With sources in the order of cap x size / weight, the level is the largest of (all - caps of those before) /
    (weights of those not before): the closed form of handing the excess on until no source is above its cap. One
    row per source, so the two windows without partitions see the list of sources only.
    """
    ranked = totals.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(cap))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    levels = ranked.withColumn("_level", level)
    return levels.withColumn("target", F.least(F.col("_cap"), F.max("_level").over(everything) * F.col("_w"))).drop("_n", "_w", "_cap", "_level")


def flight(p: list[float], size: list[float], draw: random.Random, land: bool) -> list[float]:
    """Moves probabilities until at most two are fractional, with sums of p and of p * size kept; with ``land``, until ``LANDING``
    are, which then land."""
    eps = 1e-9

    def move(ids: list[int], u: list[float]) -> None:
        up = min(((1 - p[i]) / v if v > 0 else p[i] / -v) for i, v in zip(ids, u, strict=True) if v)
        down = min((p[i] / v if v > 0 else (1 - p[i]) / -v) for i, v in zip(ids, u, strict=True) if v)
        step = up if draw.random() * (up + down) < down else -down
        for i, v in zip(ids, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * v))
            p[i] = 0.0 if p[i] < eps else 1.0 if p[i] > 1 - eps else p[i]

    open_ids: list[int] = []
    movable = [i for i in range(len(p)) if eps <= p[i] <= 1 - eps]
    rest = deque(movable)
    for i in range(len(p)):
        if not eps <= p[i] <= 1 - eps:
            p[i] = round(p[i])
    while rest and not (land and len(open_ids) + len(rest) <= LANDING):
        i = rest.popleft()
        open_ids.append(i)
        while len(open_ids) == 3:
            a, b, c = open_ids
            u = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
            move(open_ids, u if any(u) else [1.0, -1.0, 0.0])
            open_ids = [j for j in open_ids if 0 < p[j] < 1]
    if land and (last := [*open_ids, *rest]):
        for j, x in zip(last, landing([p[j] for j in last], [size[j] for j in last], draw), strict=True):
            p[j] = float(x)
    return p


def landing(p: list[float], size: list[float], draw: random.Random) -> np.ndarray:
    """A subset (0 or 1 for each document), drawn with inclusion probabilities exactly ``p``, from the design with the least expected
    distance from the totals: a simplex over all subsets, from the design of nested subsets onwards."""
    n = len(p)
    share, words = np.asarray(p, float), np.asarray(size, float)
    subsets = ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(float)
    cost = np.abs(subsets @ words - share @ words) / max(1.0, words.max()) + 1e-3 * np.abs(subsets.sum(axis=1) - share.sum())
    table = np.vstack([subsets.T, np.ones(1 << n)])  # what subsets hold, and that their probabilities come to one
    falling = np.argsort(-share, kind="stable")
    basis = np.asarray([0, *np.cumsum(1 << falling)])  # the empty subset, then one more document at a time
    weight = -np.diff(np.asarray([1.0, *share[falling], 0.0]))
    for turn in range(50 * (n + 1)):
        inverse = np.linalg.inv(table[:, basis])
        gain = cost - (cost[basis] @ inverse) @ table
        # the best column; the first one after many turns, which cannot run in circles
        enters = int(np.argmin(gain)) if turn < 20 * (n + 1) else int(np.argmax(gain < -1e-9))
        if gain[enters] >= -1e-9:
            break
        falls = inverse @ table[:, enters]
        ratio = np.where(falls > 1e-9, np.maximum(weight, 0) / np.where(falls > 1e-9, falls, 1), np.inf)
        least = ratio.min()
        leaves = min(np.flatnonzero(ratio <= least + 1e-12).tolist(), key=lambda i: basis[i])
        weight = weight - least * falls
        basis[leaves], weight[leaves] = enters, least
    weight = np.maximum(weight, 0)
    at = int(np.searchsorted(np.cumsum(weight), draw.random() * weight.sum(), "right"))
    return subsets[basis[min(at, n)]]


def _fly(seed: int, turn: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "row"], ascending=[False, True, True], kind="stable")
        last = int(group["chunks"].iloc[0]) == 1
        draw = random.Random(zlib.crc32(f"{seed}|{turn}|{group['source'].iloc[0]}|{group['chunk'].iloc[0]}".encode()))
        group["p"] = flight(group["p"].tolist(), group["size"].astype(float).tolist(), draw, last)
        return group[["row", "doc_id", "source", "size", "p"]]

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """``docs`` has doc_id, source, size and row (any number that tells rows apart). Returns them with
    source_size, target and copies: how often the mix takes the document, never more than ``cap``."""
    spark: SparkSession = docs.sparkSession
    docs = keep(docs.select("row", "doc_id", "source", "size"))
    totals = docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = keep(water_levels(totals, weights, cap))
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sized = docs.alias("d").join(targets.alias("t"), same, "left").select("d.*", "source_size", "target", ratio.alias("ratio"))
    left = sized.where("size > 0 AND ratio > floor(ratio)").select("row", "doc_id", "source", "size", (F.col("ratio") - F.floor("ratio")).alias("p"))
    decided: DataFrame | None = None
    turn = 0
    while True:
        counts = left.groupBy("source").agg(F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))
        of_chunk = F.pmod(F.xxhash64("row", "doc_id", "size", F.lit(seed + turn)), F.col("chunks"))
        dealt = left.alias("d").join(counts.alias("t"), same).select("d.*", "chunks", of_chunk.alias("chunk"))
        done = keep(dealt.groupBy("source", "chunk").applyInPandas(_fly(seed, turn), "row long, doc_id long, source string, size long, p double"))
        fixed = done.where("p = 0 OR p = 1")
        decided = fixed if decided is None else decided.unionByName(fixed)
        left = done.where("p > 0 AND p < 1")
        if left.isEmpty():
            break
        turn += 1
    picked = decided.where("p = 1").select("row", F.lit(1).alias("extra"))
    out = sized.join(picked, "row", "left")
    return keep(out.select("row", "doc_id", "size", "source_size", "target", (F.floor("ratio") + F.coalesce("extra", F.lit(0))).cast("long").alias("copies")))


def op10_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count("text").alias("size"))
    out = mix(sized)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


QUERIES = {"op10_cube_mix": op10_cube_mix}
ORACLES: dict[str, str] = {}
