"""Katz backoff language model: learned and evaluated in one distributed pass for each order.

Model. Counts r of up to ``K`` are discounted by Good and Turing's rule as Katz renormalised it; larger ones are kept. The unigram
mass that discounting frees belongs to the unknown word. After a word v,

    P(w | v) = d_r r / c(v)                  if (v, w) was seen r > 0 times
             = alpha(v) P(w)                 else, if v was seen
             = P(w)                          else,

    alpha(v) = what discounting frees after v / (1 - sum of P(w) over the w seen after v),

so each distribution sums to one exactly. A context whose counts are all above ``K`` frees nothing; one is added to its
denominator instead (likewise for unigrams), so nothing that can occur has probability zero.

Scale. Texts become blocks of word hashes, a written table. For each order a block asks hash buckets, in packed arrays, for what it
holds, each n-gram once, and says how often it trains on it; buckets sum the counts, write their part of the model (``model``
rows, one packed row a bucket and order) and answer. Frequent n-grams so cost one entry a block, not one an occurrence. Bigrams meet by
context; a context that alone would fill a bucket is spread over several by its next word, and its sums (at most twice as many such
contexts as there are buckets) are gathered by the driver and sent to the blocks. Words have 64-bit hashes, then dense ids. Counts have 64
bits; ids and what one block holds have 32, and more than fits raises ``OverflowError``.

Edge cases. Null or empty text: one token, the end. Null id: not held out, hence learned from. Repeated rows and ids: each row is a text of its own. Very
long texts: whole. No rows, or none to learn from: every word is unknown, base and score follow from N = 0. Extra columns are ignored, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.blocks import forget, hash_words, keep, mix64, partitions, slices

K = 5
BLOCK_BYTES = 8 << 20
END = np.uint64(0x51ED270B9F2C4A35)  # the hash that stands for the end
START, UNKNOWN = 0xFFFFFFFF, 0xFFFFFFFE  # ids that no word gets

_U8, _U4, _I4, _U2 = (np.dtype(x) for x in ("<u8", "<u4", "<i4", "<u2"))


def fits(a: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The array in a narrower type; an error where a number does not fit, never a wrong number."""
    if len(a) and int(a.max()) > np.iinfo(kind).max:
        raise OverflowError(f"{int(a.max())} does not fit {kind}")
    return a.astype(kind)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays, byte plane by byte plane, compressed."""
    head = np.asarray([len(arrays), *[x for a in arrays for x in (len(a), a.itemsize)]], "<i8").tobytes()
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstd.ZstdCompressor(level=1).compress(head + planes)


def unpacked(data: bytes, *kinds: np.dtype | str) -> list[np.ndarray]:
    raw = zstd.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for (length, width), kind in zip(sizes.tolist(), kinds, strict=True):
        plane = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length)
        out.append(np.ascontiguousarray(plane.T).view(kind).reshape(length))
        at += length * width
    return out


def discounts(n: np.ndarray, k: int = K) -> np.ndarray:
    """d_0..d_k from the numbers n_1..n_(k+1) of n-grams seen that often; 1 (no discount) where the rule gives none."""
    d = np.ones(k + 1)
    n = np.asarray(n, float)
    if n[0] > 0:
        common = (k + 1) * n[k] / n[0]
        for r in range(1, k + 1):
            if n[r - 1] > 0 and common < 1:
                value = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
                if 0 < value < 1:
                    d[r] = value
    return d


class Unigrams:
    """Probabilities of words by their count."""

    def __init__(self, n_r: np.ndarray, tokens: int, words: int, k: int = K) -> None:
        self.k, self.tokens, self.words, self.d = k, tokens, words, discounts(n_r, k)
        freed = float(((1 - self.d[1:]) * np.arange(1, k + 1) * n_r[:k]).sum())
        self.total = float(tokens) if freed > 0 else tokens + 1.0
        self.unknown = freed / self.total if freed > 0 else 1 / self.total

    def p(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.float64)
        small = np.minimum(counts, self.k).astype(np.int64)
        return np.where(counts == 0, self.unknown, np.where(counts <= self.k, self.d[small], 1.0) * c / self.total)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 1, F.lit(False))


_BLOCK_ROWS = "block long, doc_ids array<long>, held array<boolean>, lengths binary, words binary, tokens binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, k = TaskContext.get().partitionId(), 0
    for batch in slices(batches, "text", BLOCK_BYTES):
        ids, ends = hash_words(batch.column("text"))
        sequence = np.insert(ids, ends[1:], END)  # an end behind each text
        words, tokens, counts = np.unique(sequence, return_inverse=True, return_counts=True)
        # frequent words get small numbers, whose upper bytes are zero and cost nothing when packed
        order = np.argsort(-counts, kind="stable")
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        words, tokens = words[order], number[tokens]
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([(task << 32) + k], pa.int64()),
            "doc_ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            "held": pa.array([batch.column("held").to_pylist()], pa.list_(pa.bool_())),
            "lengths": pa.array([packed((np.diff(ends) + 1).astype(_I4))]),
            "words": pa.array([packed(words)]),
            "tokens": pa.array([packed(tokens.astype(_I4))]),
        })
        k += 1


class Block:
    """A block's texts as arrays: ``token`` indexes ``words``; ``train`` tells the tokens to learn from."""

    def __init__(self, row: dict) -> None:
        self.doc_ids, self.held = row["doc_ids"], np.asarray(row["held"], bool)
        (self.lengths,), (words,), (token,) = unpacked(row["lengths"], _I4), unpacked(row["words"], _U8), unpacked(row["tokens"], _I4)
        order = np.argsort(words)
        place = np.empty(len(order), _I4)
        place[order] = np.arange(len(order))
        self.words, self.token = words[order], place[token]
        self.train = ~np.repeat(self.held, self.lengths)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]

    def word_order(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        of = mix64(self.words) % np.uint64(buckets)
        order = np.argsort(of, kind="stable")
        return order, np.searchsorted(of[order], np.arange(buckets + 1))

    def learn_words(self, buckets: int, answers: dict[int, bytes]) -> None:
        """Counts and ids of the block's words, from the answers of the buckets."""
        order, ends = self.word_order(buckets)
        self.count, self.id = np.zeros(len(self.words), np.int64), np.full(len(self.words), UNKNOWN, np.int64)
        for b, data in answers.items():
            count, place = unpacked(data, _U8, _U4)
            at = order[ends[b] : ends[b + 1]]
            self.count[at] = count
            self.id[at] = np.where(count > 0, place.astype(np.int64) * buckets + b, UNKNOWN)
        if len(known := self.id[self.count > 0]) and known.max() >= UNKNOWN:
            raise OverflowError("more distinct words than 32-bit ids")

    def pairs(self, buckets: int, tokens: int) -> dict[str, np.ndarray]:
        """Distinct (context, word) pairs whose context was learned, by bucket, and where each token's pair is (-1: none)."""
        end = int(np.searchsorted(self.words, END))
        ids, counts = self.id[self.token], self.count[self.token]
        context, seen = np.empty_like(ids), np.empty_like(counts)
        context[1:], seen[1:] = ids[:-1], counts[:-1]
        context[self.first], seen[self.first] = START, self.count[end]
        has = np.flatnonzero(seen > 0)
        key = (context[has].astype(np.uint64) << np.uint64(32)) | ids[has].astype(np.uint64)
        key, one, inverse = np.unique(key, return_index=True, return_inverse=True)
        trained = np.bincount(inverse, self.train[has], minlength=len(key)).astype(np.int64)
        one = has[one]
        context, word = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
        # a context with more than half a bucket's share of tokens is spread by its next word
        spread = 1 + (2 * seen[one] * buckets // max(1, tokens)).astype(np.uint64)
        bucket = mix64(context * np.uint64(0x9E3779B97F4A7C15) + word % spread) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of_token = np.full(len(self.token), -1, np.int64)
        of_token[has] = place[inverse]
        return {"context": context[order], "word": word[order], "trained": trained[order], "count": counts[one][order], "seen": seen[one][order], "spread": spread[order] > 1, "of_token": of_token, "ends": np.searchsorted(bucket[order], np.arange(buckets + 1))}


def _rows(out: list[tuple]) -> pa.RecordBatch:
    """(bucket, block, kind, data); block is null for what concerns no block."""
    bucket, block, kind, data = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "block": pa.array(block, pa.int64()), "kind": pa.array(kind, pa.string()), "data": pa.array(data, pa.binary())})


_ROWS = "bucket int, block long, kind string, data binary"


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                order, ends = block.word_order(buckets)
                trained = np.bincount(block.token, block.train, minlength=len(block.words)).astype(np.int64)
                yield _rows([(b, row["block"], "ask", packed(block.words[at], fits(trained[at], _U4))) for b in range(buckets) if len(at := order[ends[b] : ends[b + 1]])])

    return run


def _collected(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, bytes]]]:
    asked: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for bucket, block, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "data")), strict=True):
            asked.setdefault(bucket, []).append((block, data))
    return asked


def _answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, parts in _collected(batches).items():
        asked = [unpacked(d, _U8, _U4) for _, d in parts]
        words, inverse = np.unique(np.concatenate([w for w, _ in asked]), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([c for _, c in asked]), minlength=len(words)).astype(np.int64)
        place, cuts = np.cumsum(count > 0) - 1, np.cumsum([0, *[len(w) for w, _ in asked]])
        n_r = np.bincount(count[count <= K + 1], minlength=K + 2)[1:]
        yield _rows([(bucket, None, "stats", packed(np.asarray([count.sum(), (count > 0).sum(), *n_r], "<i8"))), (bucket, None, "model", packed(words[count > 0], count[count > 0]))])
        for i, (block, _) in enumerate(parts):
            mine = inverse[cuts[i] : cuts[i + 1]]
            yield _rows([(bucket, block, "words", packed(count[mine].astype(_U8), fits(np.maximum(place[mine], 0), _U4)))])


def _answers_of(table: pa.Table, kind: str) -> dict[int, bytes]:
    return {r["bucket"]: r["data"] for r in table.select(["bucket", "kind", "data"]).to_pylist() if r["kind"] == kind}


def _ask_pairs(buckets: int, tokens: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = Block(row)
            block.learn_words(buckets, _answers_of(right, "words"))
            p = block.pairs(buckets, tokens)
            for b in np.flatnonzero(np.diff(p["ends"])).tolist():
                at = slice(p["ends"][b], p["ends"][b + 1])
                step = np.diff(p["context"][at], prepend=np.uint64(0)).astype(_U4)  # contexts rise within a bucket
                out.append((b, row["block"], "ask", packed(step, p["word"][at].astype(_U4), fits(p["trained"][at], _U4), p["count"][at].astype(_U8), p["spread"][at].astype(np.uint8))))
        return pa.Table.from_batches([_rows(out)])

    return run


def _answer_pairs(unigrams: Unigrams):
    """Each pair's count, and for each context: how many of its words were seen 1..K times, and the unigram mass of all seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in _collected(batches).items():
            keys, trained, counts, spread = [], [], [], []
            for _, data in parts:
                step, word, n, c, s = unpacked(data, _U4, _U4, _U4, _U8, np.uint8)
                keys.append((np.cumsum(step.astype(np.uint64)) << np.uint64(32)) | word.astype(np.uint64))
                trained.append(n)
                counts.append(c)
                spread.append(s)
            cuts = np.cumsum([0, *[len(k) for k in keys]])
            key, one, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            r = np.bincount(inverse, np.concatenate(trained), minlength=len(key)).astype(np.int64)
            context, of = np.unique(key >> np.uint64(32), return_inverse=True)
            seen = r > 0
            p = np.where(seen, unigrams.p(np.concatenate(counts)[one]), 0.0)
            mass = np.bincount(of, p, minlength=len(context))
            few = np.stack([np.bincount(of, r == j, minlength=len(context)) for j in range(1, K + 1)], axis=1).astype(np.int64)
            is_spread = np.zeros(len(context), bool)
            is_spread[of] = np.concatenate(spread)[one] > 0
            n_r = np.bincount(r[r <= K + 1], minlength=K + 2)[1:]
            yield _rows([
                (bucket, None, "stats", packed(np.asarray(n_r, "<i8"))),
                (bucket, None, "spread", packed(context[is_spread], mass[is_spread], few[is_spread].ravel())),
                (bucket, None, "model", packed(np.diff(key[seen] >> np.uint64(32), prepend=np.uint64(0)).astype(_U4), (key[seen] & np.uint64(0xFFFFFFFF)).astype(_U4), r[seen])),
            ])
            for i, (block, _) in enumerate(parts):
                mine = inverse[cuts[i] : cuts[i + 1]]
                its = np.unique(of[mine])
                yield _rows([(bucket, block, "pairs", packed(r[mine].astype(_U8), mass[its], fits(few[its].ravel(), _U4)))])

    return run


def _score(buckets: int, unigrams: Unigrams, d: np.ndarray, spread: dict[int, tuple[float, np.ndarray]]):
    weight = (1 - d[1:]) * np.arange(1, K + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, held, n_tokens, n_known, base, score = [], [], [], [], [], []
        for row in left.to_pylist():
            block = Block(row)
            block.learn_words(buckets, _answers_of(right, "words"))
            pairs = block.pairs(buckets, unigrams.tokens)
            n = len(pairs["context"])
            r, mass, freed = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for b, data in _answers_of(right, "pairs").items():
                at = slice(pairs["ends"][b], pairs["ends"][b + 1])
                count, its_mass, few = unpacked(data, _U8, "<f8", _U4)
                run_of = np.cumsum(np.diff(pairs["context"][at], prepend=pairs["context"][at][:1]) != 0)
                r[at], mass[at] = count, its_mass[run_of]
                freed[at] = (few.reshape(-1, K) @ weight)[run_of]
            for i in np.flatnonzero(pairs["spread"]).tolist():
                its_mass, few = spread[int(pairs["context"][i])]
                mass[i], freed[i] = its_mass, float(few @ weight)
            # a context that frees nothing gets one more in its denominator
            none = freed <= 0
            total = pairs["seen"] + none
            freed = np.where(none, 1.0, freed) / total
            small = np.minimum(r, K)
            kept = np.where((r <= K) & ~none, d[small], 1.0) * r / total
            back = freed / (1 - mass) * unigrams.p(pairs["count"])
            p_pair = np.where(r > 0, kept, back)
            counts = block.count[block.token]
            p = unigrams.p(counts)
            has = pairs["of_token"] >= 0
            p[has] = p_pair[pairs["of_token"][has]]
            ids += block.doc_ids
            held.append(block.held)
            n_tokens.append(block.lengths.astype(np.int64))
            n_known.append(np.add.reduceat((counts > 0).astype(np.int64), block.first))
            base.append(np.add.reduceat(unigrams.base(counts), block.first))
            score.append(np.add.reduceat(np.log10(p), block.first))
        join = lambda x, kind: pa.array(np.concatenate([*x, np.zeros(0)]), kind) if x else pa.array([], kind)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([bool(v) for h in held for v in h], pa.bool_()), "n_tokens": join([x.astype(float) for x in n_tokens], pa.float64()).cast(pa.int64()), "n_known": join([x.astype(float) for x in n_known], pa.float64()).cast(pa.int64()), "train_tokens": pa.array([unigrams.tokens] * len(ids), pa.int64()), "base_score": join(base, pa.float64()), "score": join(score, pa.float64())})

    return run


def train_and_score(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, text, held (not learned from). A row for each of them; the result's ``tessera_model`` has the tables
    of counts: bucket, kind = 'model', data (packed words or contexts, and counts)."""
    spark: SparkSession = docs.sparkSession
    buckets = partitions(spark)
    blocks = keep(docs.select("doc_id", "text", "held").mapInArrow(_blocks, _BLOCK_ROWS))
    words = keep(blocks.mapInArrow(_ask_words(buckets), _ROWS).repartitionById(buckets, "bucket").mapInArrow(_answer_words, _ROWS))
    stats = [unpacked(x["data"], "<i8")[0] for x in words.where("kind = 'stats'").select("data").collect()]  # one small row a bucket
    total = np.sum(stats, axis=0) if stats else np.zeros(K + 3, np.int64)
    unigrams = Unigrams(total[2:], int(total[0]), int(total[1]))
    own = words.where("block IS NOT NULL")
    asked = blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_ask_pairs(buckets, unigrams.tokens), _ROWS)
    pairs = keep(asked.repartitionById(buckets, "bucket").mapInArrow(_answer_pairs(unigrams), _ROWS))
    known = pairs.where("kind IN ('stats', 'spread')").select("kind", "data").collect()  # one row of each a bucket
    n_r = np.sum([unpacked(x["data"], "<i8")[0] for x in known if x["kind"] == "stats"], axis=0) if known else np.zeros(K + 1)
    spread: dict[int, tuple[float, np.ndarray]] = {}
    for x in known:
        if x["kind"] == "spread":
            context, mass, few = unpacked(x["data"], _U8, "<f8", "<i8")
            for c, m, f in zip(context.tolist(), mass.tolist(), few.reshape(-1, K), strict=True):
                before = spread.get(c, (0.0, np.zeros(K, np.int64)))
                spread[c] = (before[0] + m, before[1] + f)
    answers = own.unionByName(pairs.where("block IS NOT NULL"))
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(buckets, unigrams, discounts(n_r), spread), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = keep(scored)
    out.tessera_model = words.where("kind = 'model'").select("bucket", F.lit(1).alias("order"), "data").unionByName(pairs.where("kind = 'model'").select("bucket", F.lit(2).alias("order"), "data"))
    forget(spark, blocks.tessera_path)
    return out


def count_table(model: DataFrame) -> DataFrame:
    """The packed rows of a model as a table of n-gram counts: bucket, order, context, word, n.

    Order 1: ``word`` is the word's hash, ``id`` its number in the bigrams. Order 2: ``context`` and ``word`` are such numbers (the start of a
    text and unknown words have the numbers ``START`` and ``UNKNOWN``)."""
    buckets = partitions(model.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["order"] == 1:
                    word, n = unpacked(r["data"], _U8, "<i8")
                    context, number = None, np.arange(len(word)) * buckets + r["bucket"]
                else:
                    step, word, n = unpacked(r["data"], _U4, _U4, "<i8")
                    context, number = np.cumsum(step.astype(np.int64)), None
                for a in range(0, len(word), 100_000):
                    at = slice(a, a + 100_000)
                    size = len(word[at])
                    column = lambda x: pa.nulls(size, pa.int64()) if x is None else pa.array(x[at].astype(np.int64))  # noqa: B023, E731
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([r["bucket"]] * size, pa.int32()), "order": pa.array([r["order"]] * size, pa.int32()), "context": column(context), "word": column(word), "id": column(number), "n": column(n)})

    return model.mapInArrow(run, "bucket int, `order` int, context long, word long, id long, n long")


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return train_and_score(docs.select("doc_id", "text", held_out().alias("held")))


QUERIES = {"op1_katz_backoff": op1_katz_backoff}
ORACLES: dict[str, str] = {}
