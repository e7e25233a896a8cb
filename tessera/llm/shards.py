"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass 1 scatters records: the highest of seeded hashes of (key, shard), one for each shard, decides the shard
(rendezvous hashing), so one more shard takes records only into itself; a second seeded hash spreads the records of
a shard uniformly over buckets of about ``bucket_bytes``, whose number follows the data. Pass 2 sorts each bucket
by a seeded hash (so that what it holds does not depend on the order of arrival), shuffles it with Spark's seeded
Fisher-Yates ``shuffle`` and writes it. A bucket is a partition of its own, so the shuffle's seed is fixed per
bucket and a rerun or a lost executor yields the same order.

Law ``key``: the key and the number of shards alone decide the shard. So rows with one key share a shard; within it
their texts and row numbers spread them over buckets, and no task holds more than a bucket.

Edge cases. Null key: a key like any other. Null text: no bytes, size 16, CRC of no bytes. Equal texts under
different keys: dealt independently. Repeated rows: kept, each with a slot of its own. A text longer than a bucket:
its bucket is that much larger. No rows: no rows. Extra columns travel in a struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import keep

N_SHARDS = 40
SEED = 7
BUCKET_BYTES = 8 << 20
ROW_BYTES = 16


def size_of(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def shard_by_key(key: str, n_shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard whose hash with the key is highest."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.col(key), F.lit(j)).alias("h"), F.lit(j).alias("shard")) for j in range(n_shards)]
    return F.array_max(F.array(*scores))["shard"]


def external_shuffle(df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = N_SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes the records in shuffled order, a file for each bucket, and returns the written table:
    shard, grown_shard, bucket, pos (place in the bucket), slot (place in the shard) and ``record`` (all columns)."""
    total = df.agg(F.sum(size_of(text))).first()[0] or 0
    buckets = max(1, -(-total // (n_shards * bucket_bytes)))
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    grown = shard_by_key(key, n_shards + 1, seed)
    spread = F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text))
    scattered = df.select(record.alias("record"), shard_by_key(key, n_shards, seed).alias("shard"), grown.alias("grown_shard"), spread.alias("order"), F.monotonically_increasing_id().alias("row"))
    # repeated rows share a hash; the row number alone tells them apart
    bucket = F.pmod(F.xxhash64(F.lit(seed + 2), "order", "row"), F.lit(buckets)).cast("int")
    scattered = scattered.withColumn("at", F.col("shard") * buckets + bucket)
    dealt = scattered.repartitionById(n_shards * buckets, "at")
    rows = dealt.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("order", "row", "shard", "grown_shard", "record"))).alias("rows"))
    shuffled = rows.select("at", F.posexplode(F.shuffle("rows", seed)).alias("pos", "r"))
    written = keep(shuffled.select("r.shard", "r.grown_shard", (F.col("at") % buckets).alias("bucket"), "pos", "r.record"))
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return written.join(bases, ["shard", "bucket"]).withColumn("slot", F.col("base") + F.col("pos")).drop("base")


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = external_shuffle(docs)
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return out.select(F.col("record.doc_id").alias("doc_id"), size_of("record.text").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op7_external_shuffle": op7_external_shuffle}
ORACLES: dict[str, str] = {}
