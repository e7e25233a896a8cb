"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Each of ``tables`` tables rotates unit vectors by ``functions`` fast pseudo-rotations (three rounds of random signs and a
Hadamard transform) and assigns them to the nearest signed axis; a query also visits the buckets of its next best axes,
``probes`` in all, by falling inner product with the axes. Query and vectors of a bucket meet in one task, where a matrix product ranks
them exactly; the best of all buckets are merged by query. A bucket of more than ``PART`` vectors is split into parts that its visitors all see, and
visitors stream through a part, so what a task holds does not grow with the input, whatever the number of functions or the skew.

Equal vectors are one class, so copies never fill a bucket: a class keeps its k + 1 smallest ids (a query wants k others),
gathered task by task before the shuffle. Buckets have no cap.

The measure is the largest inner product. Where norms differ, vectors get one more dimension that makes all norms equal
and leaves inner products as they are (queries have 0 there), which turns the search into one by angle.

Recall at 20, measured against brute force: see tests and README. ``tables`` and ``probes`` are the knobs; more functions make
buckets smaller, at the price of more tables or probes.

Edge cases. Vectors that are null, zero, or hold null or non-finite components take no part, nor do those with another
number of dimensions than most. Ties go to the smaller id. Repeated ids: candidates each, and a query excludes all rows with its own id. Fewer
candidates than k: all of them; a query that the tables leave with fewer rows than that is ranked against all vectors, block by block. No rows: no rows. Extra columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import keep, mix64
from tessera.llm.nra import usable

TABLES, PROBES, FUNCTIONS = 16, 8, 1
#: Classes of a block, where queries are ranked against all of them, and of a part of a bucket.
BLOCK, PART = 4096, 16384
SEED = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of each row; the width is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(len(x), -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, function: int, seed: int = SEED) -> np.ndarray:
    """A pseudo-rotation of the rows, padded to a power of two; the same on every machine."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, table, function]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        y = hadamard(y * s)
    return y


def buckets(x: np.ndarray, table: int, functions: int, probes: int) -> np.ndarray:
    """The ``probes`` best buckets of each row, the best first: signed axes, combined over the functions."""
    best, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for f in range(functions):
        y = rotated(x, table, f)
        axes = 2 * y.shape[1]
        signed = np.concatenate([y, -y], axis=1)
        n = min(probes, axes)
        near = np.argsort(-signed, axis=1, kind="stable")[:, :n]
        short = 1 - np.take_along_axis(signed, near, 1)
        best = (best[:, :, None] * axes + near[:, None, :]).reshape(len(x), -1)
        loss = (loss[:, :, None] + short[:, None, :]).reshape(len(x), -1)
        order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        best, loss = np.take_along_axis(best, order, 1), np.take_along_axis(loss, order, 1)
    return best


def _classes(k: int):
    """Task by task, the k + 1 smallest ids of each distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids = held.setdefault(v, [])
                ids.append(i)
                if len(ids) > 8 * (k + 1):
                    ids[:] = sorted(ids)[: k + 1]
        out = [(v, sorted(ids)[: k + 1]) for v, ids in held.items()]
        for a in range(0, len(out), 10_000):
            part = out[a : a + 10_000]
            yield pa.RecordBatch.from_pydict({"v": pa.array([v for v, _ in part], pa.binary()), "ids": pa.array([i for _, i in part], pa.list_(pa.int64()))})

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles, with one zero only; all-zero vectors go."""
    for batch in batches:
        ids, vectors = [], []
        for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            x = np.asarray(v, np.float64) + 0.0
            if x.any():
                ids.append(i)
                vectors.append(x.tobytes())
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "v": pa.array(vectors, pa.binary())})


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _stored(x: np.ndarray, norm: float, level: bool) -> np.ndarray:
    """Vectors as unit vectors: by their own norm if all have about one norm, else by the largest and one more dimension."""
    if level:
        return x / np.linalg.norm(x, axis=1)[:, None]
    x = x / norm
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x**2).sum(axis=1)))[:, None]])


def _sizes(dims: int, norm: float, level: bool, tables: int, functions: int):
    """How many vectors of a batch stand in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _stored(_matrix(batch.column("v"), dims), norm, level)
                for table in range(tables):
                    bucket, n = np.unique(buckets(x, table, functions, 1)[:, 0], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"tab": np.full(len(bucket), table, np.int32), "bucket": bucket, "n": n})

    return run


def _dealt(dims: int, norm: float, level: bool, tables: int, probes: int, functions: int, parts: dict[tuple[int, int], int]):
    """A row for each bucket that a class stands in, or that it visits as a query; ``parts`` tells into how many parts large buckets are split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                chunk = batch.slice(a, 2048)
                x = _matrix(chunk.column("v"), dims)
                query = chunk.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
                stored, asked = _stored(x, norm, level), x[query] / np.linalg.norm(x[query], axis=1)[:, None]
                if not level:
                    asked = np.hstack([asked, np.zeros((len(asked), 1))])
                rows, spread = np.arange(chunk.num_rows), mix64(chunk.column("class").to_numpy().view(np.uint64))
                for table in range(tables):
                    own = buckets(stored, table, functions, 1)[:, 0]
                    visits = buckets(asked, table, functions, probes)
                    split = np.asarray([parts.get((table, b), 1) for b in own.tolist()], np.uint64)
                    part = (spread % split).astype(np.int64)
                    met, which = visits.ravel(), np.repeat(rows[query], visits.shape[1])
                    times = np.asarray([parts.get((table, b), 1) for b in met.tolist()], np.int64)
                    of = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    at = np.concatenate([own, np.repeat(met, times)])
                    which = np.concatenate([rows, np.repeat(which, times)])
                    yield pa.RecordBatch.from_pydict({
                        "tab": pa.array(np.full(len(at), table, np.int32)),
                        "bucket": pa.array(at),
                        "part": pa.array(np.concatenate([part, of])),
                        "visit": pa.array(np.arange(len(at)) >= len(own)),
                        "class": chunk.column("class").take(pa.array(which)),
                        "v": chunk.column("v").take(pa.array(which)),
                    })

    return run


_FOUND = "query_class long, class long, score double"


def _rank(asked: np.ndarray, asked_ids: np.ndarray, stored: np.ndarray, stored_ids: np.ndarray, n: int) -> pa.RecordBatch:
    """The ``n`` nearest of the stored (their ids rising) for each that asks; ties at the edge go to the smaller id."""
    product = asked @ stored.T
    took = min(n, len(stored))
    near = np.argpartition(-product, took - 1, axis=1)[:, :took]
    if took < len(stored):
        edge = np.take_along_axis(product, near, 1).min(axis=1)
        for r in np.flatnonzero((product >= edge[:, None]).sum(axis=1) > took):
            near[r] = np.lexsort((stored_ids, -product[r]))[:took]
    score = (asked[:, None, :] * stored[near]).sum(axis=2)
    return pa.RecordBatch.from_pydict({"query_class": np.repeat(asked_ids, took), "class": stored_ids[near].ravel(), "score": score.ravel()})


def _ranked(dims: int, n: int):
    """Over rows sorted by bucket and part, stored before visits: a part's vectors are held, its visits stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, stored, stored_ids = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tab", "bucket", "part")], axis=1)
            visit = batch.column("visit").to_numpy(zero_copy_only=False).astype(bool)
            ids = batch.column("class").to_numpy()
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1) | (visit[1:] != visit[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if key != (now := tuple(place[a].tolist())):
                    key, held, stored = now, [], None
                x = _matrix(batch.column("v").slice(a, b - a), dims)
                if not visit[a]:
                    held.append((x, ids[a:b]))
                    continue
                if not held:
                    continue
                if stored is None:
                    stored_ids = np.concatenate([i for _, i in held])
                    order = np.argsort(stored_ids, kind="stable")
                    stored, stored_ids = np.concatenate([v for v, _ in held])[order], stored_ids[order]
                for i in range(0, b - a, 256):
                    yield _rank(x[i : i + 256], ids[a:b][i : i + 256], stored, stored_ids, n)

    return run


def _meet(dealt: DataFrame, dims: int, n: int) -> DataFrame:
    at = ("tab", "bucket", "part")
    return dealt.repartition(*at).sortWithinPartitions(*at, "visit").mapInArrow(_ranked(dims, n), _FOUND)


def nearest(vectors: DataFrame, queries: str, k: int, tables: int = TABLES, probes: int = PROBES, functions: int = FUNCTIONS) -> DataFrame:
    """``vectors``: id long, v array of numbers; ``queries``: the SQL predicate on id that makes a row a query."""
    packed = vectors.mapInArrow(_packed, "id long, v binary")
    widths = packed.groupBy(F.octet_length("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    if widths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = widths["w"] // 8
    packed = packed.where(F.octet_length("v") == widths["w"])
    smallest = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1)
    classes = packed.mapInArrow(_classes(k), "v binary, ids array<long>").groupBy("v").agg(smallest.alias("ids"))
    asked = packed.where(queries)
    of_queries = asked.select("v").distinct().withColumn("is_query", F.lit(True))
    classes = keep(classes.join(of_queries, "v", "left").select("v", "ids", F.col("ids")[0].alias("class"), F.coalesce("is_query", F.lit(False)).alias("is_query")))

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size = np.linalg.norm(_matrix(batch.column("v"), dims), axis=1)
                yield pa.RecordBatch.from_pydict({"least": [float(size.min())], "most": [float(size.max())]})

    ends = classes.select("v").mapInArrow(norms, "least double, most double").agg(F.min("least"), F.max("most")).first()
    level = ends[0] > 0.999 * ends[1]
    if not level and dims & (dims - 1) == 0:
        probes *= 2  # one more dimension doubles the width, and with it the number of buckets
    n_classes = classes.count()
    parts: dict[tuple[int, int], int] = {}
    if n_classes > PART:  # else no bucket can be large; at most tables * min(buckets, n_classes / PART) of them are
        sizes = classes.select("v").mapInArrow(_sizes(dims, ends[1], level, tables, functions), "tab int, bucket long, n long")
        large = sizes.groupBy("tab", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > PART).collect()
        parts = {(r["tab"], r["bucket"]): -(-r["n"] // PART) for r in large}
    dealt = classes.select("class", "v", "is_query").mapInArrow(_dealt(dims, ends[1], level, tables, probes, functions, parts), "tab int, bucket long, part long, visit boolean, class long, v binary")
    found = _meet(dealt, dims, k + 1)
    out = _merged(found, classes, asked, k)
    # exact ranks for the queries that the tables leave with too few rows
    out = keep(out)
    total, own = packed.count(), packed.join(asked.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("own"))
    rows = out.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("rows"))
    short = own.join(rows, "id", "left").where(F.coalesce("rows", F.lit(0)) < F.least(F.lit(k), F.lit(total) - F.col("own"))).select("id")
    short = keep(short)
    if short.isEmpty():
        return out
    lacking = asked.join(short, "id", "left_semi")
    of_short = lacking.select("v").distinct().join(classes, "v").select("class", "v")
    blocks = max(1, -(-n_classes // BLOCK))
    stored = classes.select("class", "v", F.pmod(F.xxhash64("class"), F.lit(blocks)).alias("bucket"), F.lit(False).alias("visit"))
    visits = of_short.select("class", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("bucket"), F.lit(True).alias("visit"))
    found = _meet(stored.unionByName(visits).select(F.lit(0).alias("tab"), "bucket", F.lit(0).cast("long").alias("part"), "visit", "class", "v"), dims, k + 1)
    return out.join(short, out["query_id"] == short["id"], "left_anti").unionByName(_merged(found, classes, lacking, k))


def _merged(found: DataFrame, classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best rows of each query from what was found in buckets."""
    place = F.dense_rank().over(Window.partitionBy("query_class").orderBy(F.desc("score"), "class"))
    best = found.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("query_class", "class").agg(F.max("score").alias("score"))
    members = best.join(classes.select("class", F.explode("ids").alias("vec_id")), "class")
    order = Window.partitionBy("query_class").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place", "class")
    asked = asked.dropDuplicates(["id"]).join(classes.select("v", F.col("class").alias("query_class")), "v").select(F.col("id").alias("query_id"), "query_class")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = asked.join(members, "query_class").where(F.col("vec_id") != F.col("query_id"))
    return pairs.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable("embedding") & F.col("vec_id").isNotNull())
    return nearest(table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id % 20 = 0", 20)


QUERIES = {"op3_cross_polytope": op3_cross_polytope}
ORACLES: dict[str, str] = {}
