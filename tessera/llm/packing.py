"""Best-fit decreasing packing of tokenised documents into sequences of a fixed number of tokens.

Three steps, each bounded per task:

* ``token_pieces`` tokenises every whole text in Arrow batches and cuts what is longer than a sequence.
* ``best_fit`` packs. Best-fit decreasing sees nothing of a piece but its length, so it runs over the histogram of
  lengths: at most ``capacity`` classes, whatever the number of documents, which is the proven bound of what the
  driver holds. A segment tree over remaining capacities yields the tightest open bin in logarithmic time; bins with
  the same remaining capacity are kept as ranges of numbers, so one lookup serves all equal pieces that do the same.
  The bins are those that placing document after document would make.
* ``place`` gives each piece its rank among those of its length (salted: a length that a third of all pieces have
  is ranked in many tasks) and looks its bin up in the plan, a table of runs that is bounded by the square of the
  capacity and sent to the executors.

Edge cases. Null or empty text: one piece that holds the end id only. Repeated rows and ids: packed each for itself.
Very long texts: cut into full pieces, the first one shorter. Text that spells a special token: the id that the
tokenizer itself gives. No rows: no rows. Extra columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import give_back, keep, partitions, slices

CAPACITY = 2048
END = 0
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 300_000
#: Bytes of text that are tokenised between two batches of pieces (one longer text stays whole).
BATCH_BYTES = 4 << 20

_PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
_loaded: dict[tuple[str, str], Callable[[str], bytes]] = {}


def tokenizer_paths() -> tuple[str, str]:
    """The tokenizer's own file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str, ranks_path: str) -> Callable[[str], bytes]:
    """Text to the tokenizer's ids as little-endian unsigned 32-bit numbers.

    The tokenizer splits before every space that something other than white space follows, and never merges across
    such a split. So words are encoded once and remembered, by the faster of two libraries with one vocabulary;
    texts that spell a special token go to the tokenizer itself.
    """
    if (path, ranks_path) in _loaded:
        return _loaded[path, ranks_path]
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, bytes] = {}
    odd, split = re.compile(r" \s"), re.compile(r" (?=\S)")

    def ids(text: str) -> bytes:
        return np.asarray(bpe.encode_ordinary(text), "<u4").tobytes()

    def learn(word: str) -> bytes:
        got = ids(" " + word)
        if len(word) <= 48:
            if len(known) >= CACHE_WORDS:
                known.clear()
            known[word] = got
        return got

    def encode(text: str) -> bytes:
        if any(t in text for t in special):
            return np.asarray(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = split.split(text) if odd.search(text) else text.split(" ")
        get = known.get
        return b"".join([ids(words[0]) if words[0] else b"", *[get(w) or learn(w) for w in words[1:]]])

    _loaded[path, ranks_path] = encode
    return encode


def token_pieces(docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(row, doc_id, text) to a row per piece; ``with_ids`` adds the ids themselves, as 32-bit numbers in a binary."""
    paths = paths or tokenizer_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop = encoder(*paths), np.asarray([end], "<u4").tobytes()
        for batch in slices(batches, "text", BATCH_BYTES):
            out: dict[str, list] = {k: [] for k in ("row", "doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = memoryview(encode(text.as_py() or "") + stop)
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for name, value in zip(out, (row, doc, k, a, b - a, zlib.crc32(data[4 * a : 4 * b]), bytes(data[4 * a : 4 * b]) if with_ids else None), strict=True):
                        out[name].append(value)
            if not with_ids:
                del out["ids"]
            kinds = {"piece": pa.int32(), "ids": pa.binary()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})
        give_back()

    return docs.select("row", "doc_id", "text").mapInArrow(run, _PIECES + (", ids binary" if with_ids else ""))


class Capacities:
    """A segment tree over capacities 0..n: which of them have an open bin, and which is the least from some size on."""

    def __init__(self, n: int) -> None:
        self.width = 1 << n.bit_length()
        self.some = [0] * (2 * self.width)

    def set(self, capacity: int, open_bins: bool) -> None:
        i = capacity + self.width
        self.some[i] = int(open_bins)
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]

    def least(self, size: int) -> int | None:
        """The smallest capacity of at least ``size`` with an open bin."""
        i = size + self.width
        if self.some[i]:
            return size
        while i > 1 and (i & 1 or not self.some[i + 1]):
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.width:
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        return i - self.width


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, first bin, offset, pieces a bin): piece r of a length goes to bin
    first bin + (r - first rank) // pieces a bin."""
    tree, open_bins = Capacities(capacity), {}
    runs, bins = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.least(length)
            if room is None:
                room, each = capacity, capacity // length
                first, count = bins, -(-left // each)
                bins += count
            else:
                each = room // length
                first, count = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
                if count * each > left and count > (need := -(-left // each)):
                    open_bins[room].append((first + need, count - need))
                    tree.set(room, True)
                    count = need
            runs.append((length, rank, first, capacity - room, each))
            took = min(left, count * each)
            full, rest = divmod(took, each)
            for start, n, used in ((first, full, each), (first + full, int(rest > 0), rest)):
                if n and (free := room - used * length):
                    open_bins.setdefault(free, []).append((start, n))
                    tree.set(free, True)
            rank, left = rank + took, left - took
    return np.asarray(runs, np.int64).reshape(-1, 5)


def place(pieces: DataFrame, runs: np.ndarray) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    spark = pieces.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(partitions(spark))).cast("int")
    salted = pieces.withColumn("salt", salt)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "row", "piece")) - 1
    ranked = salted.withColumn("rank", rank).join(bases, ["length", "salt"]).select("row", "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    plan = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        keys = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            _, first_rank, first, offset, each = table[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1].T
            bin_, slot = np.divmod(rank - first_rank, each)
            named = {c: batch.column(c) for c in ("row", "doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(named | {"sequence_id": pa.array(first + bin_), "offset": pa.array(offset + slot * length)})

    return ranked.mapInArrow(run, _PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, text) to a row per piece with its sequence and place."""
    pieces = keep(token_pieces(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), paths, capacity, end))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(pieces, best_fit(histogram, capacity))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict[str, str] = {}
