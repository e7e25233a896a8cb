"""Exact n-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Two texts link when ``den`` x shared n-grams >= ``num`` x n-grams of either. All links count; what comes out is each
document's set size and the smallest id that links reach.

1. Texts with one set of n-grams are one class, however many copies there are; the rest works on classes, each in one block where copies are many.
2. Order. N-grams that more than ``RARE`` blocks and classes hold among the first of a class (by hash) are hot and come last, all others
   by their hash. A class keeps its first |x| - ceil(num/den |x|) + 1 n-grams in that order, as any partner shares one of those.
   Blocks of texts ask hash buckets of n-grams for what they hold, in packed arrays, each n-gram once a block.
3. Sparse product over those first n-grams: pairs that meet at one, of compatible sizes, accumulate overlap counts. A
   rare n-gram has few holders, so pairs grow with the input. A pair whose count is below the bound that its sizes set
   (needed overlap less what the unseen rest can give) is discarded.
4. Classes with too few rare n-grams (a text that many texts nearly copy, or made of passages that many texts share) post their
   whole set. Among each other they are only chained, neighbours by size at each n-gram: that keeps groups connected with as many
   edges as postings, never all pairs.
5. Candidate components are cut into blocks of ``BLOCK`` classes, and the product of a block with itself is exact, over whole
   sets. Blocks of a large component also hold its ``PIVOTS`` first classes, which joins the blocks; afterwards only classes
   outside the component's largest linked group meet all classes of like size, in products of parts of ``CELL_BYTES``, so no link between different groups is
   lost while members of one group are never compared all with all.

Edge cases. Null or empty text, or no words: no n-grams, linked with nothing, component is its own id. Fewer than n words: the
whole sequence is one n-gram. Null id: takes part, never a component's id unless all ids of it are null. Repeated rows and ids: a
result each. Very long texts: whole. No rows: no rows. Extra columns are ignored, so their names cannot clash. N-grams
and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.blocks import forget, give_back, hash_words, keep, mix64, partitions, slices
from tessera.llm.components import components

RARE = 16
BLOCK = 512
PIVOTS = 8
#: Bytes of sets of either side of a product within a large component.
CELL_BYTES = 12 << 20
#: Blocks that hold a class, on average, from which on copies are taken out of all blocks but one.
REPEATED = 1.25
#: Bytes of text of one block.
BLOCK_BYTES = 4 << 20

_U8, _I4, _U1 = np.dtype("<u8"), np.dtype("<i4"), np.dtype("u1")


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    ids, ends = hash_words(texts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(ids), np.uint64)
        for j in range(n):
            rolled[: len(ids) - j] = rolled[: len(ids) - j] * np.uint64(0x9E3779B97F4A7C15) + ids[j:]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(ends, ends[1:], strict=False):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            out.append(np.asarray([xxhash.xxh3_64_intdigest(ids[a:b].tobytes(), int(b - a))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(grams: np.ndarray) -> int:
    """The class of a set, as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), len(grams))).astype(np.int64))


def first_n(size, num: int, den: int):
    """How many first n-grams of a set any partner shares one of."""
    return size - -(-num * size // den) + 1


def _looked_at(size: int, num: int, den: int) -> int:
    p = first_n(size, num, den)
    return min(size, p + max(16, p // 2))


_BLOCK_ROWS = "block long, doc_ids array<long>, doc_class array<int>, classes binary, sizes binary, grams binary"


def _blocks(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", BLOCK_BYTES):
            known: dict[int, int] = {}
            sizes, grams, of_doc = [], [], []
            for s in ngram_sets(batch.column("text"), n):
                if not len(s):
                    of_doc.append(-1)
                    continue
                c = set_id(s)
                if c not in known:
                    known[c] = len(known)
                    sizes.append(len(s))
                    grams.append(s[: _looked_at(len(s), num, den)])
                of_doc.append(known[c])
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([(task << 32) + k], pa.int64()),
                "doc_ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "doc_class": pa.array([of_doc], pa.list_(pa.int32())),
                "classes": pa.array([np.asarray(list(known), np.int64).tobytes()]),
                "sizes": pa.array([np.asarray(sizes, _I4).tobytes()]),
                "grams": pa.array([(np.concatenate(grams) if grams else np.zeros(0, np.uint64)).tobytes()]),
            })
            k += 1
        give_back()

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            classes, sizes = np.frombuffer(row["classes"], np.int64), np.frombuffer(row["sizes"], _I4)
            at = np.asarray(row["doc_class"])
            has = at >= 0
            cls = pa.array(classes[np.where(has, at, 0)] if len(classes) else np.zeros(len(at), np.int64), mask=~has)
            size = np.where(has, sizes[np.where(has, at, 0)], 0) if len(sizes) else np.zeros(len(at), np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "class": cls, "size": pa.array(size.astype(np.int64)), "block": pa.array(np.full(len(at), row["block"]), pa.int64())})


def _owned(num: int, den: int):
    """A block with those of its classes only that it owns."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        own = np.concatenate([np.asarray(x, np.int64) for x in right.column("own").to_pylist()] or [np.zeros(0, np.int64)])
        for row in left.to_pylist():
            classes, sizes, grams = np.frombuffer(row["classes"], np.int64), np.frombuffer(row["sizes"], _I4), np.frombuffer(row["grams"], _U8)
            mine = np.isin(classes, own)
            looked = np.asarray([_looked_at(int(s), num, den) for s in sizes], np.int64)
            out.append((row["block"], classes[mine].tobytes(), sizes[mine].tobytes(), grams[np.repeat(mine, looked)].tobytes()))
        kinds = {"block": pa.int64(), "classes": pa.binary(), "sizes": pa.binary(), "grams": pa.binary()}
        return pa.table({k: pa.array([x[i] for x in out], kind) for i, (k, kind) in enumerate(kinds.items())})

    return run


def _by_bucket(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams in the order of their buckets, how often each occurs, where each input one is, and the buckets' ends."""
    distinct, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    of = mix64(distinct) % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], counts[order], place[inverse], np.searchsorted(of[order], np.arange(buckets + 1))


def _asks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                distinct, counts, _, ends = _by_bucket(np.frombuffer(raw, _U8), buckets)
                counts = np.minimum(counts, 255).astype(_U1)
                used = np.flatnonzero(np.diff(ends))
                data = [distinct[ends[i] : ends[i + 1]].tobytes() + counts[ends[i] : ends[i + 1]].tobytes() for i in used]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(used.astype(np.int32)), "block": pa.array([block] * len(used), pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def _answers(rare: int):
    """0: held once; 1: rare; 2: hot. One byte an n-gram, in the order of the question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for bucket, block, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "data")), strict=True):
                asked.setdefault(bucket, []).append((block, data))
        for bucket, parts in asked.items():
            sizes = [len(d) // 9 for _, d in parts]
            grams = np.concatenate([np.frombuffer(d, _U8, n) for (_, d), n in zip(parts, sizes, strict=True)])
            counts = np.concatenate([np.frombuffer(d, _U1, n, 8 * n) for (_, d), n in zip(parts, sizes, strict=True)])
            _, inverse = np.unique(grams, return_inverse=True)
            total = np.bincount(inverse, counts)
            kind = np.where(total <= 1, 0, np.where(total <= rare, 1, 2)).astype(_U1)[inverse]
            cuts = np.cumsum([0, *sizes])
            yield pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in parts], pa.int64()), "bucket": pa.array([bucket] * len(parts), pa.int32()), "kinds": pa.array([kind[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})
        give_back()

    return run


def _posts(buckets: int, num: int, den: int):
    """(gram, class, size) of the first shared n-grams; gram null: the class must post its whole set. Rows with a bucket hold,
    packed, those first n-grams that no other class was asked about: only a whole set can still hold one."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        grams, whose, whole, lone = [], [], [], [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, _I4))]
        for block in left.to_pylist():
            raw, sizes = np.frombuffer(block["grams"], _U8), np.frombuffer(block["sizes"], _I4).astype(np.int64)
            classes = np.frombuffer(block["classes"], np.int64)
            _, _, place, _ = _by_bucket(raw, buckets)
            answers = dict(zip(right.column("bucket").to_pylist(), right.column("kinds").to_pylist(), strict=True))
            kinds = np.frombuffer(b"".join(answers[b] for b in sorted(answers)), _U1)[place] if len(raw) else np.zeros(0, _U1)
            looked = np.asarray([_looked_at(int(s), num, den) for s in sizes])
            start = np.cumsum([0, *looked])
            for i, size in enumerate(sizes):
                kind = kinds[start[i] : start[i + 1]]
                calm = np.flatnonzero(kind < 2)[: first_n(size, num, den)]
                if len(calm) < first_n(size, num, den):
                    whole.append(i)
                    continue
                shared = raw[start[i] : start[i + 1]][calm[kind[calm] == 1]]
                grams.append(shared)
                whose.append(np.full(len(shared), i))
                single = raw[start[i] : start[i + 1]][calm[kind[calm] == 0]]
                lone.append((single, np.full(len(single), classes[i]), np.full(len(single), size, _I4)))
        if not left.num_rows:
            return pa.table({"gram": pa.array([], pa.int64()), "class": pa.array([], pa.int64()), "size": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        who = np.concatenate([*whose, np.asarray(whole, np.int64)]).astype(np.int64)
        gram = np.concatenate([*grams, np.zeros(len(whole), np.uint64)]).astype(np.uint64).view(np.int64)
        none = np.arange(len(who)) >= len(who) - len(whole)
        single, of, its = (np.concatenate(x) for x in zip(*lone, strict=True))
        bucket = (mix64(single) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        data = [b"".join(x[order[cuts[i] : cuts[i + 1]]].tobytes() for x in (single, of, its)) for i in used]
        rows = pa.table({"gram": pa.array(gram, mask=none), "class": pa.array(classes[who]), "size": pa.array(sizes[who]), "bucket": pa.nulls(len(who), pa.int32()), "data": pa.nulls(len(who), pa.binary())})
        packed = pa.table({"gram": pa.nulls(len(used), pa.int64()), "class": pa.nulls(len(used), pa.int64()), "size": pa.nulls(len(used), pa.int64()), "bucket": pa.array(used.astype(np.int32)), "data": pa.array(data, pa.binary())})
        return pa.concat_tables([rows, packed])

    return run


def _whole_by_bucket(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = np.unique(np.frombuffer(b"".join(batch.column("grams").to_pylist()), _U8))
            bucket = (mix64(grams) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(used.astype(np.int32)), "data": pa.array([grams[order[cuts[i] : cuts[i + 1]]].tobytes() for i in used], pa.binary()), "whole": pa.array([True] * len(used), pa.bool_())})

    return run


def _held_by_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the lone n-grams, those that a whole set holds."""
    whole: dict[int, list[np.ndarray]] = {}
    lone: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, data, is_whole in zip(*(batch.column(c).to_pylist() for c in ("bucket", "data", "whole")), strict=True):
            if is_whole:
                whole.setdefault(bucket, []).append(np.frombuffer(data, _U8))
            else:
                lone.setdefault(bucket, []).append(data)
    for bucket, sets in whole.items():
        known = np.unique(np.concatenate(sets))
        for data in lone.get(bucket, []):
            n = len(data) // 20
            grams, of, its = np.frombuffer(data, _U8, n), np.frombuffer(data, np.int64, n, 8 * n), np.frombuffer(data, _I4, n, 16 * n)
            found = np.isin(grams, known)
            yield pa.RecordBatch.from_pydict({"gram": grams[found].astype(np.uint64).view(np.int64), "class": of[found], "size": its[found].astype(np.int64)})


def _meet(num: int, den: int):
    """Over rows sorted by gram, whole, size: chains (count 0) between whole classes, and counted pairs with or among others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, few, last = None, [], None
        for batch in batches:
            seen: dict[tuple[int, int, int, int, bool, bool], int] = {}
            for g, c, size, whole in zip(*(batch.column(k).to_pylist() for k in ("gram", "class", "size", "whole")), strict=True):
                if g != gram:
                    gram, few, last = g, [], None
                for other, its in few:
                    if other != c and den * min(size, its) >= num * max(size, its):
                        key = (other, c, its, size, False, whole) if other < c else (c, other, size, its, whole, False)
                        seen[key] = seen.get(key, 0) + 1
                if not whole:
                    if (c, size) not in few:
                        few.append((c, size))
                else:
                    if last and last[0] != c and den * last[1] >= num * size:
                        key = (min(c, last[0]), max(c, last[0]), 0, 0, True, True)
                        seen[key] = 0
                    last = (c, size)
            columns = list(zip(*seen, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            names = ("a", "b", "size_a", "size_b", "whole_a", "whole_b")
            yield pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, v, k in zip(names, columns, kinds, strict=True)} | {"shared": pa.array(list(seen.values()), pa.int64())})

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK_BYTES):
            sets = ngram_sets(batch.column("text"), n)
            yield pa.RecordBatch.from_pydict({"wanted": batch.column("wanted"), "class": pa.array([set_id(s) for s in sets], pa.int64()), "grams": pa.array([s.tobytes() for s in sets], pa.binary())})
        give_back()

    return run


def _links(num: int, den: int):
    """The exact product of a block: a tree of links, as (a, b). ``role`` 0: member, 1: pivot or one that meets all others."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, first = np.unique(table.column("class").to_numpy(), return_index=True)
        role = np.zeros(len(ids), bool)
        role[np.searchsorted(ids, table.column("class").to_numpy())] |= table.column("apart").to_numpy(zero_copy_only=False).astype(bool)
        raw = table.column("grams").take(pa.array(first)).to_pylist()
        group = table.column("grouped").take(pa.array(first)).to_numpy()
        sizes = np.asarray([len(r) // 8 for r in raw])
        order = np.argsort(sizes, kind="stable")
        ids, role, group, sizes = ids[order], role[order], group[order], sizes[order]
        grams = np.frombuffer(b"".join(raw[i] for i in order), _U8)
        owner = np.repeat(np.arange(len(ids)), sizes)
        _, column, held = np.unique(grams, return_inverse=True, return_counts=True)
        keep_ = held[column] > 1
        column, owner = column[keep_], owner[keep_]
        by_column = np.argsort(column, kind="stable")
        posts, cuts = owner[by_column], np.concatenate([[0], np.cumsum(np.bincount(column, minlength=len(held)))])
        rows = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(ids)))])
        label = np.unique(group, return_inverse=True)[1]
        only = role.any() and bool(table.column("only_apart")[0].as_py())
        tree: list[tuple[int, int]] = []
        for i in range(len(ids)):
            if only and not role[i]:
                continue
            compatible = (den * np.minimum(sizes, sizes[i]) >= num * np.maximum(sizes, sizes[i])) & (label != label[i])
            if not only:
                compatible[: i + 1] = False
            if not compatible.any():
                continue
            mine = column[rows[i] : rows[i + 1]]
            lists = [posts[cuts[c] : cuts[c + 1]] for c in mine]
            if not lists:
                continue
            shared = np.bincount(np.concatenate(lists), minlength=len(ids))
            for j in np.flatnonzero(compatible & (den * shared >= num * (sizes + sizes[i] - shared))):
                if label[j] != label[i]:
                    tree.append((int(ids[i]), int(ids[j])))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([a for a, _ in tree], pa.int64()), "b": pa.array([b for _, b in tree], pa.int64())})

    return run


def _cells(grouped: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of the products of all classes of a component with those outside its largest group (``grouped``: comp, class, grams, grouped, top).

    Sets that link differ in size by den / num at most, so a class meets those of its own band of sizes and of the two beside it. In a band both sides are cut into parts
    of about ``CELL_BYTES`` of sets, and a cell is one part with another: a class is sent to as many cells as the other side has parts, and no task holds more than two parts."""
    band = F.floor(F.log(F.octet_length("grams") / 8) / (math.log(max(den / num, 1.01)) * 1.0001))  # a little wider than needed, so rounding loses nothing
    left = grouped.select("comp", band.alias("band"), "class", "grams", "grouped")
    right = grouped.where("grouped <> top").select("comp", F.explode(F.array(band - 1, band, band + 1)).alias("band"), "class", "grams", "grouped")
    parts = lambda side, name: side.groupBy("comp", "band").agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.sum(F.octet_length("grams")) / CELL_BYTES)).alias(name))
    cut = keep(parts(left, "n_left").join(parts(right, "n_right"), ["comp", "band"]))  # a table whose size is known, so that sets need no shuffle for it
    of = lambda n: F.pmod(F.xxhash64("class"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("_x")
    base = ("comp", "band", "n_right", "class", "grams", "grouped")
    left = left.join(cut, ["comp", "band"]).select(*base, F.lit(False).alias("apart"), of("n_left").alias("_l"), every("n_right")).withColumnRenamed("_x", "_r")
    right = right.join(cut, ["comp", "band"]).select(*base, F.lit(True).alias("apart"), of("n_right").alias("_r"), every("n_left")).withColumnRenamed("_x", "_l")
    cell = F.col("band") * (1 << 32) + F.col("_l") * F.col("n_right") + F.col("_r")
    return left.unionByName(right).select("comp", cell.alias("part"), "class", "grams", "apart", "grouped", F.lit(True).alias("only_apart"))


def join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, rare: int = RARE) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, component_id: one row a document."""
    spark: SparkSession = docs.sparkSession
    buckets = partitions(spark)
    docs = docs.select("doc_id", "text")
    blocks = keep(docs.mapInArrow(_blocks(n, num, den), _BLOCK_ROWS))
    documents = keep(blocks.select("block", "doc_ids", "doc_class", "classes", "sizes").mapInArrow(_documents, "doc_id long, class long, size long, block long"))
    # of a class that several blocks hold only the first asks and posts: its copies would make its n-grams look frequent
    held_in = documents.where("class IS NOT NULL").groupBy("class").agg(F.count_distinct("block").alias("n"), F.min("block").alias("block"))
    times = held_in.agg(F.sum("n").alias("all"), F.count("*").alias("classes")).first()
    if (times["all"] or 0) > REPEATED * times["classes"]:
        own = held_in.groupBy("block").agg(F.collect_list("class").alias("own"))
        every = blocks
        blocks = keep(every.select("block", "classes", "sizes", "grams").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_owned(num, den), "block long, classes binary, sizes binary, grams binary"))
        forget(spark, every.tessera_path)
    answers = keep(blocks.select("block", "grams").mapInArrow(_asks(buckets), "bucket int, block long, data binary").repartitionById(buckets, "bucket").mapInArrow(_answers(rare), "block long, bucket int, kinds binary"))
    posts = keep(blocks.select("block", "classes", "sizes", "grams").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_posts(buckets, num, den), "gram long, class long, size long, bucket int, data binary"))
    forget(spark, blocks.tessera_path, answers.tessera_path)
    one_of = documents.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"))

    def sets_of(classes: DataFrame) -> DataFrame:
        """Whole sets of classes, from the text of one document of each."""
        wanted = classes.select("class").distinct().join(one_of, "class").select(F.col("class").alias("wanted"), F.col("doc_id").alias("its_id"))
        texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["its_id"])).select("wanted", "text")
        return texts.mapInArrow(_sets(n), "wanted long, class long, grams binary").where("wanted = class").select("class", "grams").dropDuplicates(["class"])

    whole = keep(sets_of(posts.where("gram IS NULL AND bucket IS NULL")))
    by_bucket = whole.select("grams").mapInArrow(_whole_by_bucket(buckets), "bucket int, data binary, whole boolean")
    lone = posts.where("bucket IS NOT NULL").select("bucket", "data", F.lit(False).alias("whole"))
    held = lone.unionByName(by_bucket).repartitionById(buckets, "bucket").mapInArrow(_held_by_whole, "gram long, class long, size long")
    posted = whole.mapInArrow(_post_whole, "class long, gram long, size long, whole boolean")
    all_posts = posts.where("gram IS NOT NULL").select("gram", "class", "size").unionByName(held).distinct().select("class", "gram", "size", F.lit(False).alias("whole")).unionByName(posted)
    met = all_posts.repartition(buckets, "gram").sortWithinPartitions("gram", "whole", "size", "class").mapInArrow(_meet(num, den), "a long, b long, size_a long, size_b long, whole_a boolean, whole_b boolean, shared long")
    summed = met.groupBy("a", "b", "size_a", "size_b", "whole_a", "whole_b").agg(F.sum("shared").alias("shared"))
    needed = F.ceil(num * (F.col("size_a") + F.col("size_b")) / (num + den))
    unseen = lambda s: F.when(F.col(f"whole_{s}"), 0).otherwise(F.ceil(num * F.col(f"size_{s}") / den) - 1)
    candidates = keep(summed.where((F.col("whole_a") & F.col("whole_b")) | (F.col("shared") >= needed - F.greatest(unseen("a"), unseen("b")))).select("a", "b"))
    forget(spark, posts.tessera_path)
    roots = keep(components(candidates))
    sets = keep(sets_of(roots.select(F.col("id").alias("class"))).join(roots.withColumnRenamed("id", "class"), "class"))
    counts = roots.groupBy("root").agg(F.count("*").alias("n"))
    sized = sets.join(counts, "root")
    small, large = sized.where(F.col("n") <= BLOCK), sized.where(F.col("n") > BLOCK)
    bins = max(1, -(-roots.count() // BLOCK))
    plain = (F.lit(False).alias("apart"), F.col("class").alias("grouped"), F.lit(False).alias("only_apart"))
    of_small = small.select(F.lit(0).cast("long").alias("comp"), F.pmod(F.xxhash64("root"), F.lit(bins)).alias("part"), "class", "grams", *plain)
    n_parts = F.ceil(F.col("n") / BLOCK)
    members = large.select(F.col("root").alias("comp"), F.pmod(F.xxhash64("class"), n_parts).alias("part"), "class", "grams", *plain)
    # a component's pivots: those of its classes whose hash falls below a bound that leaves about PIVOTS of them, in every block
    pivot = F.pmod(F.xxhash64("class", F.lit(5)), F.col("n")) < PIVOTS
    pivots = large.where(pivot).select(F.col("root").alias("comp"), F.explode(F.sequence(F.lit(0).cast("long"), n_parts - 1)).alias("part"), "class", "grams", *plain)
    tree = keep(of_small.unionByName(members).unionByName(pivots).groupBy("comp", "part").applyInArrow(_links(num, den), "a long, b long"))
    linked = keep(components(tree))
    if not large.isEmpty():
        # classes outside the largest linked group of a large component meet every block of it
        group = F.coalesce(linked["root"], large["class"])
        grouped = large.join(linked, large["class"] == linked["id"], "left").select(large["root"].alias("comp"), "class", "grams", "n", group.alias("grouped"))
        weight = grouped.groupBy("comp", "grouped").agg(F.count("*").alias("w"))
        top = weight.groupBy("comp").agg(F.max_by("grouped", F.struct("w", "grouped")).alias("top"))
        grouped = keep(grouped.join(top, "comp"))
        # written first: ``components`` begins with Python, and a second worker a task would stay beside the first
        more = keep(_cells(grouped, num, den).groupBy("comp", "part").applyInArrow(_links(num, den), "a long, b long"))
        linked = keep(components(tree.unionByName(more)))
    ids = one_of.join(linked, one_of["class"] == linked["id"], "left").select("class", F.coalesce("root", "class").alias("root"), "doc_id")
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = ids.join(least, "root").select("class", "component_id")
    out = documents.join(of_class, "class", "left")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))


def _post_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c, raw in zip(batch.column("class").to_pylist(), batch.column("grams").to_pylist(), strict=True):
            grams = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_pydict({"class": np.full(len(grams), c), "gram": grams, "size": np.full(len(grams), len(grams)), "whole": np.ones(len(grams), bool)})


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op2_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
     t AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
     s AS (SELECT doc_id, unnest(g) AS g, len(g) AS n FROM t),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
           GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
     e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
     r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT t.doc_id, CAST(coalesce(len(g), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM t JOIN r ON r.x = t.doc_id GROUP BY ALL
""",
}
