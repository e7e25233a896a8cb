"""Exact top-k search by the no-random-access algorithm (Fagin, Lotem and Naor) over sorted lists.

Vectors are dealt to blocks once; a task holds the lists of one block: for each dimension its entries (value, vector), sorted by value.
A query reads the lists sequentially, all to the same depth, each from the end that serves the sign of its
weight, in batches (``DEPTHS``); lists of weight zero are never opened. For each vector seen it keeps

* a lower bound: what was read of it, with unread dimensions at the last value of their lists,
* an upper bound: what was read of it, with unread dimensions at the value that their lists have come to.

A vector not seen at all has the sum of the latter as its upper bound. After each batch the k-th best lower bound is the bar; once the unseen are
below it, so are dropped all vectors whose upper bound is. Reading stops once at most ``FINAL`` vectors are left: no outsider can qualify.
Their scores are then resolved from the dimensions still unread. Either bound is a product of the query with the vectors as far as they are
read, which is the same for all queries of a batch. Ties with the bar are never dropped, so the smaller id wins as it should.
Each block yields its k best of a query; the k best of those are the answer, since a vector beaten k times in its block is beaten k times overall.

Scale. Each vector is shuffled once and each query once a block (a stated query set against all rows); a task's block is bounded by ``VECTORS``,
and queries stream through it, so memory does not grow with the input.

Edge cases. Vectors that are null or hold null or non-finite components take no part, nor do those with another
number of dimensions than most vectors have (the smaller of equally frequent numbers). Ties go to the smaller id. Repeated vectors are candidates each;
repeated ids are too, and a query excludes every row with its own id. Of queries that repeat an id, ``op4`` asks one. A query of
zeros reads nothing: all scores are 0, the smallest ids win. Fewer candidates than k: all of them. No rows: no
rows. Extra columns are ignored, so their names cannot clash. Scores are exact while their sums stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import partitions

#: Vectors of a block: about ``SMALL`` where the session's partitions allow as many blocks, never more than ``VECTORS`` on average.
SMALL, VECTORS = 2048, 16384
#: Vectors that may be left when reading stops.
FINAL = 16
#: How far lists are read before bounds are looked at, as shares of a block.
DEPTHS = (1 / 64, 1 / 32, 1 / 16, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16, 31 / 32)
#: Bounds (queries times vectors of a block) that are held at once.
BOUNDS = 1 << 20


class Lists:
    """The sorted lists of a block, the largest values first. ``read`` counts the entries that queries have read, ``resolved`` the vectors
    whose unread dimensions were looked up at the end."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = np.asarray(vectors, np.float64)
        order = np.argsort(-self.vectors, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(self.vectors, order, axis=0).T)  # a row for each dimension
        self.place = np.empty(order.shape, np.int32)  # where a vector stands in each list
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(len(order))[:, None], order.shape), axis=0)
        self.read = self.resolved = 0

    def _depths(self) -> list[int]:
        n = len(self.vectors)
        return sorted({max(1, int(n * x)) for x in DEPTHS} | {n})

    def _bounded(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """With all lists read to a depth, from either end: what is known of each vector, unread dimensions at the least of their lists and at what
        these have come to; and the latter alone. Columns are the dimensions read from the largest, then those read from the smallest."""
        n = len(self.vectors)
        come_to = np.concatenate([self.values[:, depth - 1], self.values[:, n - depth]])
        least = np.concatenate([self.values[:, -1], self.values[:, 0]])
        read = np.concatenate([self.place < depth, self.place >= n - depth], axis=1)
        both = np.concatenate([self.vectors, self.vectors], axis=1)
        return np.where(read, both, least), np.where(read, both, come_to), come_to

    def top_of_each(self, queries: np.ndarray, k: int, banned: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows that can be among its k best (ties included), with exact scores; ``banned`` rows are no candidates. Queries
        read side by side, so that the bounds of all are one product; each stops for itself."""
        n, queries = len(self.vectors), np.asarray(queries, np.float64)
        signed = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
        opened = (queries != 0).sum(axis=1)
        alive = np.ones((len(queries), n), bool)
        for i, rows in enumerate(banned or []):
            alive[i, rows] = False
        going = np.flatnonzero((alive.sum(axis=1) > max(k, FINAL)) & (opened > 0))
        depth = 0
        for past in self._depths():
            if not len(going):
                break
            self.read += int(opened[going].sum()) * (past - depth)
            depth = past
            least, most, come_to = self._bounded(depth)
            low = signed[going] @ least.T
            low[~alive[going]] = -np.inf
            bar = np.partition(low, n - k, axis=1)[:, n - k]
            bar -= 1e-6 * (1 + np.abs(bar))  # sums of floats; scores are whole numbers
            seen = np.flatnonzero(signed[going] @ come_to < bar)  # else a vector not seen at all may qualify
            if len(seen):
                which = going[seen]
                alive[which] &= signed[which] @ most.T >= bar[seen, None]
                going = going[alive[going].sum(axis=1) > max(k, FINAL)]
        out = []
        for i, query in enumerate(queries):
            left = np.flatnonzero(alive[i])
            self.resolved += len(left)
            out.append((left, self.vectors[left] @ query))
        return out

    def top(self, query: np.ndarray, k: int, banned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        return self.top_of_each(query[None, :], k, None if banned is None else [banned])[0]


def _search(k: int, dims: int):
    """Over partitions that hold a block's vectors first and then its queries, by batches."""

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("v").flatten().to_numpy().reshape(-1, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, lists = [], [], None
        own = np.zeros(0, np.int64)
        for batch in batches:
            is_query = batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            split = int((~is_query).sum())  # vectors stand first
            if split:
                ids.append(batch.column("id").slice(0, split).to_numpy())
                vectors.append(matrix(batch.slice(0, split)))
            if split == batch.num_rows or not ids:
                continue
            if lists is None:
                own = np.concatenate(ids)
                by_id = np.argsort(own, kind="stable")
                own = own[by_id]
                lists = Lists(np.concatenate(vectors)[by_id])
            found_q, found_v, found_s = [], [], []
            asked = batch.slice(split)
            many = max(1, BOUNDS // len(own))
            for a in range(0, asked.num_rows, many):
                part = asked.slice(a, many)
                of = part.column("id").to_numpy()
                banned = [np.arange(x, y) for x, y in zip(np.searchsorted(own, of), np.searchsorted(own, of, "right"), strict=True)]
                for i, (rows, score) in zip(of, lists.top_of_each(matrix(part), k, banned), strict=True):
                    best = rows[order := np.lexsort((own[rows], -score))[:k]]
                    found_q.append(np.full(len(best), i, np.int64))
                    found_v.append(own[best])
                    found_s.append(score[order].astype(np.int64))
            yield pa.RecordBatch.from_pydict({"query_id": np.concatenate(found_q), "vec_id": np.concatenate(found_v), "score": np.concatenate(found_s)})

    return run


def usable(vector: str):
    """Neither null nor with a null or non-finite component."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``vectors`` and ``queries``: id long, v array of long. Returns query_id, rank, vec_id, score."""
    spark: SparkSession = vectors.sparkSession
    widths = vectors.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").collect()  # a row for each number of dimensions
    widths = [r for r in widths if r["w"] > 0]
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, n = widths[0]["w"], widths[0]["n"]
    blocks = max(-(-n // VECTORS), min(partitions(spark), -(-n // SMALL)))
    fits = F.size("v") == dims
    left = vectors.where(fits).select("id", "v", F.lit(False).alias("is_query"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"))
    right = queries.where(fits).select("id", "v", F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = left.unionByName(right).repartitionById(blocks, "block").sortWithinPartitions("is_query", "id")
    found = dealt.select("id", "v", "is_query").mapInArrow(_search(k, dims), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable("embedding") & F.col("vec_id").isNotNull())
    vectors = table.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    return top_k(vectors, vectors.where("id % 50 = 0").dropDuplicates(["id"]), 5)


QUERIES = {"op4_nra_top_k": op4_nra_top_k}
ORACLES = {
    "op4_nra_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
