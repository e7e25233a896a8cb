"""A corpus pipeline of four stages. Each takes (spark, docs, sf_dir), works on all documents that its predecessor kept
and returns a DataFrame, which is written as Parquet and reread as the next one's documents.

* ``toxicity`` learns from the labels and drops the documents that it rejects.
* ``jaccard`` joins by five-word shingles at a similarity of 0.8 and keeps one row of each group, that with the smallest id.
* ``mixing`` repeats and leaves out documents so that sources come to their target shares of words.
* ``packing`` packs the mix into sequences of 2048 tokens: a row for each piece with its place.

Null columns: a null text is an empty document that no stage rejects for being empty (mixing never takes a document
without words, as it adds nothing to a share); a null source is a source of its own; a null id is a document like any other. Rows that
repeat an id are documents of their own: ``jaccard`` goes by their texts, so copies go and others stay. Ties: of rows
with one id and alike texts the one read first stays. Very long texts: whole. Empty table: empty result. Extra columns are dropped.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import cube, ngram_join, packing, toxicity
from tessera.llm.blocks import keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs.select(*COLUMNS), model).where("toxicity < 0.5").select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with numbers that stay the same in every read, whatever is lost in between: the number of the part file and the place in it, as far as
    ``docs`` are the plain part files of one write. Other rows are numbered in the order of reading, once, and written."""
    parts = [re.search(r"/part-(\d+)-[^/]*-c000[^/]*$", f) for f in docs.inputFiles()]
    if parts and all(parts) and len({int(p[1]) for p in parts}) == len(parts):
        file = F.regexp_extract("_metadata.file_name", r"^part-(\d+)-", 1).cast("long")
        try:
            return docs.select((file * (1 << 33) + F.col("_metadata.row_index")).alias("row"), *COLUMNS)
        except AnalysisException:  # not a plain read of those files
            pass
    return keep(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows the one with the smallest id stays (rows without an id come last, the earlier of equal ids first)."""
    rows = _numbered(docs)
    groups = keep(ngram_join.join(rows.select(F.col("row").alias("doc_id"), "text"), n=5, num=80).select(F.col("doc_id").alias("row"), "component_id"))
    ids = keep(rows.select("row", "doc_id").join(groups, "row"))
    lead = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("lead"))
    # a table whose size is known, so that texts are shuffled only where it is too large to be sent to them
    gone = keep(ids.select("row").join(lead.select(F.col("lead.row").alias("row")), "row", "left_anti"))
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = _numbered(docs)
    taken = cube.mix(rows.select("row", "doc_id", "source", cube.word_count("text").alias("size")))
    copies = keep(taken.where("copies > 0").select("row", "copies"))  # likewise
    return rows.join(copies, "row").select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", reject_toxic), ("jaccard", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Compression, hashing with samples and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
