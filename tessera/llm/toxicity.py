"""Toxicity by compression distance: separate zstandard dictionaries of toxic and of ordinary text, window by window.

A window is three words in a row; every word of a text begins one. Its distance is its compressed length under the
dictionary of ordinary text less that under the dictionary of toxic text. The latter is the former followed by what was
trained on toxic windows, so that ordinary words cost the same under both and only toxic wording tells them apart. A window that shares no
run of ``COUNTED`` bytes with the toxic wording has nothing to gain from it: its distance is 0, and it need not be compressed.

``fit`` learns on the driver from a bounded sample of labelled rows (``MAX_TRAIN`` rows a class, chosen by a hash of
the id: the operator's documented parameter). A third of the sample is set aside for calibration.

1. The ordinary dictionary is trained on windows of one half of the ordinary texts; the other half says what distances
   ordinary windows have by chance.
2. Labels name texts, not windows, and most windows of a toxic text are ordinary. So toxic texts are cut in two halves and in
   each round the dictionary trained on windows of one half picks windows of the other: those whose distance is so large
   that toxic texts have it ``ENRICHED`` times as often as ordinary ones. What only one text says is of no use to the other
   half, so rounds come to what toxic texts have in common. The toxic dictionary is trained on the windows that are left.
3. Ordinary windows that the toxic dictionary serves well all the same are trained into the ordinary one.
4. On the third set aside, each distance gets its log-likelihood ratio between the classes as weight (never falling with
   distance), and a threshold on a text's sum of weights: a lost ordinary text weighs as much as four kept toxic ones.
   Evidence saturates: a distance adds nothing after ``SATURATED`` windows of a text.

Edge cases. Null or empty text: no window, score from the bias alone (below 0.5 unless every labelled text is
toxic). Texts of fewer than three words: one window. No labelled rows, or one class only: every score is the share of toxic
rows among those read (0.0 without rows). Too few toxic texts to train on, or nothing in common among them: 0.0. Repeated rows:
scored each for itself; rows that repeat an id are learned from once, by the least of their texts. Null id: scored, never learned from, not held
out. Very long texts: all windows. Labels without a document, null labels: not learned from; of several labels for one id the
largest counts. Ties in the hash that chooses the sample go to the smaller id. No rows: no rows. Extra columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.blocks import give_back

#: Labelled rows of each class that ``fit`` may read.
MAX_TRAIN = 2000
#: Words of a window.
WIDTH = 3
#: Bytes of the ordinary dictionary, of what counters false alarms, of the toxic part, and of the toxic part while it is sought.
ORDINARY_BYTES, COUNTER_BYTES, TOXIC_BYTES, SEARCH_BYTES = 32768, 16384, 2048, 4096
#: Segment lengths of the trainer for those parts, and the length of what it counts.
ORDINARY_SEGMENT, TOXIC_SEGMENT, SEARCH_SEGMENT, COUNTED = 32, 12, 24, 6
#: Rounds of the search, by how many times as frequent a distance must be in toxic texts.
ENRICHED = (3, 3, 5)
#: Distance of ordinary windows that step 3 trains on, and the largest distance that is told apart.
ALARM, MOST = 3, 8
SATURATED = 9
#: The lowest level whose match finder indexes every position of a dictionary; faster ones skip some, and with them words.
LEVEL = 6
#: Behind each window and dictionary: long enough for zstandard never to store a window uncompressed.
TAIL = b" " + bytes(range(128, 152))
#: Bytes of windows that are compressed in one call, letters of texts that are looked at together (one longer text stays whole) and bytes hashed at once:
#: bounds of a worker's memory.
CALL_BYTES, GROUP_LETTERS, HASH_BYTES = 1 << 20, 1 << 18, 1 << 18

_WORD = re.compile(r"[^\W\d_]+")


def windows(text: str | None) -> list[bytes]:
    words = _WORD.findall((text or "").lower())
    return [f" {' '.join(words[i : i + WIDTH])} ".encode() for i in range(max(1, len(words) - WIDTH + 1))] if words else []


class Runs:
    """Which of all windows of some texts share a run of ``COUNTED`` bytes with a wording (by a table of hashes: a few more may be told)."""

    def __init__(self, wording: bytes) -> None:
        self.table = np.zeros(1 << 20, bool)
        self.table[self._hashes(np.frombuffer(wording, np.uint8))] = True

    def _hits(self, data: np.ndarray) -> np.ndarray:
        """How many runs before each byte are in the wording."""
        n = max(0, len(data) - COUNTED + 1)
        out = np.zeros(n + 1, np.int32)
        for a in range(0, n, HASH_BYTES):
            out[a + 1 : min(n, a + HASH_BYTES) + 1] = self.table[self._hashes(data[a : a + HASH_BYTES + COUNTED - 1])]
        return np.cumsum(out, out=out)

    @staticmethod
    def _hashes(data: np.ndarray) -> np.ndarray:
        n = len(data) - COUNTED + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        code = np.zeros(n, np.uint64)
        for j in range(COUNTED):
            code |= data[j : j + n].astype(np.uint64) << np.uint64(8 * j)
        with np.errstate(over="ignore"):
            return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def windows(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """The number of windows of each text, those windows that share a run, and the text that each is of."""
        words = [_WORD.findall((t or "").lower()) for t in texts]
        n = np.asarray([len(w) for w in words], np.int64)
        count = np.where(n > 0, np.maximum(1, n - WIDTH + 1), 0)
        data = "".join(f" {' '.join(w)} " for w in words if w).encode()
        raw = np.frombuffer(data, np.uint8)
        spaces = np.flatnonzero(raw == 32)  # a text of n words has n + 1
        owner = np.repeat(np.arange(len(n)), count)
        base = np.repeat(np.cumsum(np.where(n > 0, n + 1, 0)) - np.where(n > 0, n + 1, 0), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start, end = spaces[base + at], spaces[base + np.minimum(at + WIDTH, n[owner])] + 1
        hits = self._hits(raw)
        last = np.minimum(np.maximum(end - COUNTED + 1, start), len(hits) - 1)
        found = np.flatnonzero(hits[last] > hits[np.minimum(start, len(hits) - 1)])
        return count, [data[a:b] for a, b in zip(start[found].tolist(), end[found].tolist(), strict=True)], owner[found]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a trained dictionary; the samples themselves where they are too few to train one."""
    try:
        whole = zstd.train_dictionary(size, samples, k=segment, d=COUNTED, level=LEVEL).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]
    tables_end = whole.find(struct.pack("<3I", 1, 4, 8))  # the last of the entropy tables: three repeat offsets
    return whole[tables_end + 12 :] if tables_end > 0 else whole


def _lengths(content: bytes) -> Callable[[list[bytes]], np.ndarray]:
    """A function from windows to their compressed lengths under a dictionary, which serves as raw content: lengths differ by matches only."""
    d = zstd.ZstdCompressionDict(content + TAIL, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    compress = zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).multi_compress_to_buffer

    def lengths(found: list[bytes]) -> np.ndarray:
        out = np.zeros(len(found), np.int64)
        size = np.asarray([len(w) for w in found], np.int64) + len(TAIL)
        ends = np.cumsum(size)
        a = 0
        while a < len(found):
            base = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + CALL_BYTES, "right")))
            places = np.stack([ends[a:b] - size[a:b] - base, size[a:b]], axis=1).astype("<u8")
            made = compress(zstd.BufferWithSegments(TAIL.join(found[a:b]) + TAIL, places.tobytes()), threads=0)
            out[a:b] = [len(made[i]) for i in range(b - a)]
            a = b
        return out

    return lengths


def _flat(parts: list[list[bytes]]) -> list[bytes]:
    return [w for part in parts for w in part]


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = (0.0,) * (MOST + 1)  # log-likelihood ratio of a window, by its distance
    bias: float = 0.0
    constant: float | None = None

    def histograms(self) -> Callable[[list[str | None]], np.ndarray]:
        """A function from texts to their numbers of windows by distance, a row for each text."""
        of_ordinary, of_toxic, runs = _lengths(self.ordinary), _lengths(self.toxic), Runs(self.toxic[len(self.ordinary) :])

        def count(texts: list[str | None]) -> np.ndarray:
            total, found, owner = runs.windows(texts)
            distance = np.clip(of_ordinary(found) - of_toxic(found), 0, MOST)
            out = np.bincount(owner * (MOST + 1) + distance, minlength=len(texts) * (MOST + 1)).reshape(len(texts), MOST + 1)
            out[:, 0] += total - out.sum(axis=1)
            return out

        return count

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        return 1 / (1 + np.exp(-np.clip(_saturated(counts) @ np.asarray(self.weights) + self.bias, -50.0, 50.0)))


def _saturated(counts: np.ndarray) -> np.ndarray:
    """Windows as evidence: any number without distance, at most ``SATURATED`` of each distance."""
    return np.minimum(counts, [np.inf, *[SATURATED] * MOST])


def _common(toxic: list[list[bytes]], chance: list[bytes], ordinary: bytes) -> list[bytes]:
    """Windows whose wording toxic texts have in common and ordinary ones lack (step 2)."""
    of_ordinary = _lengths(ordinary)
    base = of_ordinary(chance)
    halves = [_flat(toxic[side::2]) for side in (0, 1)]
    plain = [of_ordinary(half) for half in halves]
    # at first: the half of the windows that ordinary text explains worst
    chosen = []
    for half, cost in zip(halves, plain, strict=True):
        left = cost - np.asarray([len(w) for w in half], np.int64)
        chosen.append([half[i] for i in np.flatnonzero(left >= np.median(left))] if half else [])
    for times in ENRICHED:
        picked = []
        for side, half in enumerate(halves):
            serve = _lengths(ordinary + _trained(chosen[1 - side], SEARCH_BYTES, SEARCH_SEGMENT))
            gain, by_chance = plain[side] - serve(half), base - serve(chance)
            least = next((g for g in range(1, MOST) if len(half) and (gain >= g).mean() > times * ((by_chance >= g).sum() + 1) / (len(chance) + 1)), MOST)
            picked.append([half[i] for i in np.flatnonzero(gain >= least)])
        chosen = picked
    return chosen[0] + chosen[1] if all(chosen) else []


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """rows: text and label (1: toxic) of the bounded sample."""
    texts = [[t for t, y in rows if y == label and windows(t)] for label in (1, 0)]
    if not texts[0] or not texts[1]:
        return Model(constant=float(bool(texts[0])))
    toxic, ordinary = ([windows(t) for t in part[len(part) // 3 :]] for part in texts)
    aside = [part[: len(part) // 3] for part in texts]
    learned, chance = ordinary[0::2], _flat(ordinary[1::2])
    own = _trained([w for text in learned for w in text[::WIDTH]], ORDINARY_BYTES, ORDINARY_SEGMENT)
    common = _common(toxic, chance, own)
    if not common or not all(aside):
        return Model(constant=0.0)
    wording = _trained(common, TOXIC_BYTES, TOXIC_SEGMENT)
    false = np.flatnonzero(_lengths(own)(chance) - _lengths(own + wording)(chance) >= ALARM)
    own += _trained([chance[i] for i in false], COUNTER_BYTES, ORDINARY_SEGMENT)
    model = Model(own, own + wording)
    # calibration
    count = model.histograms()
    counts = [_saturated(count(part)) for part in aside]
    rates = [(c.sum(axis=0) + [1.0, *[0.1] * MOST]) / (c.sum() + 1 + 0.1 * MOST) for c in counts]
    ratio = np.log(rates[0] / rates[1])
    ratio[1:] = np.maximum.accumulate(ratio[1:])  # a distance that the sample lacks tells no less than a smaller one
    model.weights = tuple(ratio.tolist())
    value = [c @ ratio for c in counts]
    edges = np.unique(np.concatenate(value))
    cuts = (edges[1:] + edges[:-1]) / 2 if len(edges) > 1 else edges + 1
    loss = [(value[0] < c).mean() + 4 * (value[1] >= c).mean() for c in cuts]
    model.bias = -float(cuts[int(np.argmin(loss))])
    return model


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fits on labelled rows that are not held out; at most ``max_train`` of each class, by a hash of the id."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    order = F.xxhash64("doc_id", F.lit(8))
    sample = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(max_train)
        sample = part if sample is None else sample.unionByName(part)
    # at most max_train ids a class are broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = [(r["doc_id"], r["text"], r["toxic"]) for r in texts.collect()]
    return fit([(t, y) for _, t, y in sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode(), 8), r[0]))])


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``toxicity`` (0 to 1) to any table with a text column."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shipped.value
        count = m.histograms() if m.constant is None else lambda texts: np.zeros((len(texts), MOST + 1))
        for texts in batches:
            parts, a = [], 0
            ends = np.cumsum(texts.str.len().fillna(0).to_numpy(np.int64))
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + GROUP_LETTERS, "right")))
                parts.append(m.scores(count(texts.iloc[a:b].tolist())))
                a = b
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")
        give_back()

    return docs.withColumn("toxicity", score(F.col(text)))


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op8_compression_toxicity": op8_compression_toxicity}
ORACLES: dict[str, str] = {}
