"""Language-model scores against a plain implementation."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgersift.llm import interpolated_lm as lm

from .helpers import words

END = object()


def tokens(text):
    return [*words("".join(c.lower() if c.isascii() else c for c in text or "")), END]


def ngrams(text, n):
    ts = [END] * (n - 1) + tokens(text)
    return [tuple(ts[i : i + n]) for i in range(len(ts) - n + 1)]


class Counts:
    """n-gram counts of texts, with the counts of contexts."""

    def __init__(self, texts, order):
        self.order, self.n_texts = order, len(texts)
        self.grams = [Counter(g for t in texts for g in ngrams(t, n)) for n in range(1, order + 1)]
        self.total, self.known = sum(self.grams[0].values()), len(self.grams[0])

    def count(self, gram):
        return self.n_texts if all(w is END for w in gram) else self.grams[len(gram) - 1][gram]

    def token(self, gram):
        """Bucket and estimates of the last word of a full n-gram."""
        contexts = [self.count(gram[-n:-1]) for n in range(2, self.order + 1)]
        bucket = 0
        for n, c in enumerate(contexts):
            if c:
                bucket = 64 * n + c.bit_length()
        ps = [1 / (self.known + 1), self.grams[0][gram[-1:]] / self.total if self.total else 0.0]
        ps += [self.grams[n - 1][gram[-n:]] / c if c else 0.0 for n, c in zip(range(2, self.order + 1), contexts)]
        return bucket, ps


def plain_weights(rows, order):
    buckets = 1 + max(1, order - 1) * 64
    usable = np.array([[k <= (1 if b == 0 else 2 + (b - 1) // 64) for k in range(order + 1)] for b in range(buckets)])
    w, last = usable / usable.sum(axis=1, keepdims=True), None
    for _ in range(lm.ROUNDS):
        if not rows:
            return w
        got, gain = np.zeros(w.shape), 0.0
        for b, ps in rows:
            share = w[b] * ps
            gain += math.log(share.sum())
            got[b] += share / share.sum()
        overall = (got.sum(axis=0) + 1) * usable
        w = got + lm.PRIOR * overall / overall.sum(axis=1, keepdims=True)
        w /= w.sum(axis=1, keepdims=True)
        if last is not None and gain / len(rows) - last < lm.GAIN:
            break
        last = gain / len(rows)
    return w


def plain_scores(docs, order):
    def fold(d):
        return None if d is None else zlib.crc32(str(d).encode()) % 10

    train = Counts([t for d, t in docs if fold(d)], order)
    counted = Counts([t for d, t in docs if fold(d) and fold(d) > 1], order)
    rows = [counted.token(g) for d, t in docs if fold(d) == 1 for g in ngrams(t, order)]
    weights = plain_weights(rows, order)
    out = []
    for d, t in docs:
        single = [train.grams[0][(w,)] for w in tokens(t)]
        base = sum(math.log10((c + 0.1) / (train.total + 0.1 * (train.known + 1))) for c in single)
        found = [train.token(g) for g in ngrams(t, order)]
        score = sum(math.log10(sum(w * p for w, p in zip(weights[b], ps))) for b, ps in found)
        out.append((d, None if d is None else fold(d) == 0, len(single), sum(c > 0 for c in single), train.total, base, score))
    return out


def same(got, wanted):
    def order(r):
        return (str(r[0]), r[2], r[5])

    got, wanted = sorted(got, key=order), sorted(wanted, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    for column in (5, 6):
        assert np.allclose([r[column] for r in got], [r[column] for r in wanted], rtol=1e-9)


def odd_docs():
    rng = random.Random(1)
    vocabulary = ["w%d" % i for i in range(40)] + ["the"] * 30
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    docs += [(None, "the w1"), (None, None), (7, None), (8, ""), (9, " \n\t"), (10, "THE the İ É\x0bx"), (11, "x" * 100_000)]
    return docs + [(12, "the " * 20_000), (13, "same same"), (13, "same same"), (14, "a b a b")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_plain_ones(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "SLICE_BYTES", 2_000)  # several slices of a kind
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 5_000)  # and several buckets of keys
    docs = odd_docs()
    table = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, kind int, codes string")
    got = lm.interpolated_scores(table.repartition(3), order)
    same([tuple(r) for r in got.collect()], plain_scores(docs, order))


def test_no_rows_and_no_training_rows(spark):
    schema = "doc_id long, text string"
    assert lm.interpolated_scores(spark.createDataFrame([], schema)).count() == 0
    out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    docs = [(i, "a b") for i in out]
    got = [tuple(r) for r in lm.interpolated_scores(spark.createDataFrame(docs, schema)).collect()]
    same(got, plain_scores(docs, 2))
    assert all(r[4] == 0 and r[5] == 0.0 for r in got)


def test_query_matches_plain_scores_and_beats_single_words(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in lm.lm_scores(spark, sf).collect()]
    same(got, plain_scores(docs, lm.ORDER))
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


@pytest.mark.parametrize("order", [2, 3])
def test_chances_of_all_words_sum_to_one(order):
    texts = [t for _, t in odd_docs()[:50]]
    counts = Counts(texts, order)
    weights = plain_weights([counts.token(g) for t in texts for g in ngrams(t, order)], order)
    every = [w for (w,) in counts.grams[0]] + ["never seen"]
    for context in ([END] * (order - 1), [every[0]] * (order - 1), ["nowhere"] * (order - 1)):
        total = 0.0
        for w in every:
            b, ps = counts.token((*context, w))
            total += sum(x * p for x, p in zip(weights[b], ps))
        assert abs(total - 1) < 1e-9


def test_packing_is_reversible():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (lm.unpacked_keys(lm.packed_keys(keys)) == keys).all()
    for kind in (np.int32, np.int64, np.uint32):
        values = np.arange(-5 if kind != np.uint32 else 0, 1000).astype(kind)
        assert (lm.unpacked(lm.packed(values), kind) == values).all()
    assert len(lm.unpacked_keys(lm.packed_keys(keys[:0]))) == 0
