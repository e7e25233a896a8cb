"""The distributed model against a plain one, and its distributions against one."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import katz
from tessera.llm.katz import count_table, held_out, train_and_score

K = 5

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*WORD.findall(lower), None]


def discounts(n):
    """Katz's d_r = (r* / r - A) / (1 - A) with r* = (r + 1) n_(r+1) / n_r and A = (K + 1) n_(K+1) / n_1; 1 where that is no discount."""
    if not n[0] or (K + 1) * n[K] >= n[0]:
        return [1.0] * (K + 1)
    a = (K + 1) * n[K] / n[0]
    return [1.0] + [d if n[r - 1] and 0 < (d := ((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a)) < 1 else 1.0 for r in range(1, K + 1)]


class Plain:
    def __init__(self, texts):
        self.uni, self.bi, self.ctx = Counter(), defaultdict(Counter), Counter()
        for t in texts:
            last = "<start>"
            for w in tokens(t):
                self.uni[w] += 1
                self.bi[last][w] += 1
                self.ctx[last] += 1
                last = ("w", w)
        n = lambda counts: [sum(c == r for c in counts) for r in range(1, K + 2)]
        self.N = sum(self.uni.values())
        self.d1, self.d2 = discounts(n(self.uni.values())), discounts(n([c for x in self.bi.values() for c in x.values()]))
        freed = sum((1 - self.d1[c]) * c for c in self.uni.values() if c <= K)
        self.total = self.N if freed > 0 else self.N + 1
        self.unknown = (freed if freed > 0 else 1) / self.total

    def p1(self, w):
        c = self.uni.get(w, 0)
        return (self.d1[c] if c <= K else 1) * c / self.total if c else self.unknown

    def p(self, w, last):
        if last not in self.ctx:
            return self.p1(w)
        seen, total = self.bi[last], self.ctx[last]
        freed = sum((1 - self.d2[c]) * c for c in seen.values() if c <= K)
        none = freed <= 0
        total += none
        if w in seen and self.uni.get(w):
            c = seen[w]
            return (self.d2[c] if c <= K and not none else 1) * c / total
        return (1 if none else freed) / total / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)

    def score(self, text):
        out, last = 0.0, "<start>"
        for w in tokens(text):
            out += math.log10(self.p(w, last))
            last = ("w", w)
        return out


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows] + [(900001, None), (900002, ""), (900003, " \n "), (900004, "The the THE"), (900004, "The the THE"), (None, "of the unheard")]


def test_scores_equal_a_plain_model(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = train_and_score(docs.select("doc_id", "text", held_out().alias("held"))).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    model = Plain([t for i, t in texts if not held(i)])
    want = sorted(((-1 if i is None else i), held(i), len(tokens(t)), sum(model.uni.get(w, 0) > 0 for w in tokens(t)), round(sum(math.log10((model.uni.get(w, 0) + 0.5) / (model.N + 0.5 * (len(model.uni) + 1))) for w in tokens(t)), 6), round(model.score(t), 6)) for i, t in texts)
    found = sorted(((-1 if r.doc_id is None else r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], abs=1e-5)
        assert a[5] == pytest.approx(b[5], abs=1e-5)
    assert {r.train_tokens for r in got} == {model.N}


def test_distributions_sum_to_one(texts):
    model = Plain([t for _, t in texts[:60]])
    for last in ["<start>", *list(model.ctx)[:40], ("w", "never heard")]:
        total = sum(model.p(w, last) for w in model.uni) + model.p("never heard", last)
        assert total == pytest.approx(1, abs=1e-9)


def test_empty_table(spark):
    assert train_and_score(spark.createDataFrame([], "doc_id long, text string, held boolean")).collect() == []


def test_nothing_to_learn_from(spark):
    got = train_and_score(spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held boolean")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)]
    assert got[0].base_score == pytest.approx(0.0)


def test_counts_are_tables_and_never_wrap(spark, texts):
    import numpy as np

    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = count_table(train_and_score(docs.select("doc_id", "text", held_out().alias("held"))).tessera_model).collect()
    model = Plain([t for i, t in texts if not (i is not None and zlib.crc32(str(i).encode()) % 5 == 1)])
    assert sorted(r.n for r in rows if r.order == 1) == sorted(model.uni.values())
    assert sorted(r.n for r in rows if r.order == 2) == sorted(c for x in model.bi.values() for c in x.values())
    number = {r.id: r.n for r in rows if r.order == 1}
    sums = Counter()
    for r in rows:
        if r.order == 2 and r.context != katz.START:
            sums[r.context] += r.n
    ends = max(n for n in number.values() if n == model.uni[None])
    assert all(number[c] == n for c, n in sums.items() if number[c] != ends)  # each word but the end has a successor
    with pytest.raises(OverflowError):
        katz.fits(np.asarray([1 << 32], np.int64), katz._U4)
