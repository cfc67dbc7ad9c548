"""Similar texts against brute force."""

import random

import pytest

import corpus_pipeline
from ledgersift.llm import similar_texts

from .helpers import components, words

DOCS = "doc_id long, text string, fp int, root string"


def plain_shingles(text):
    ws = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def plain_groups(texts):
    """texts: {doc_id: text}."""
    sets = {d: plain_shingles(t) for d, t in texts.items()}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return components(sets, near)


def changed(rng, text, n):
    ws = text.split()
    for i in rng.sample(range(len(ws)), n):
        ws[i] = f"changed{rng.randrange(10**9)}"
    return " ".join(ws)


def prose(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


@pytest.mark.parametrize("limit", [2, 16])
def test_groups_match_brute_force(spark, limit):
    """Near copies of several lengths, texts just below the bound, chains, and a group around one text."""
    rng = random.Random(limit)
    texts = [None, "", " \n", "A", "a b", "A B", "a b c d e", "A b c d  e", "a b c d e f", "İ É x y z v"]
    for n in (30, 100, 200, 400):
        for _ in range(6):
            base = prose(rng, n)
            texts += [base, changed(rng, base, 1), changed(rng, base, max(1, n // 60)), changed(rng, base, n // 20)]
    chain = prose(rng, 100)
    for _ in range(12):
        texts.append(chain)
        chain = changed(rng, chain, 1)
    base = prose(rng, 60)
    texts += [changed(rng, base, 1) for _ in range(60)] + [base]
    rng.shuffle(texts)
    rows = [(i, t, 1, "z") for i, t in enumerate(texts)] + [(None, "only here no id", 1, "z"), (None, "a b", 1, "z")]
    docs = spark.createDataFrame(rows, DOCS)
    wanted = plain_groups(dict(enumerate(texts)))
    got = similar_texts.similar_texts(docs, limit=limit).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == wanted
    kept = similar_texts.drop_similar_texts(docs, limit=limit)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({*wanted.values(), None}, key=str)
    assert similar_texts.similar_texts(docs.limit(0)).count() == 0


def test_stage_drops_copies_with_one_replaced_word(spark):
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (100, 200, 400) for _ in range(10)]
    rows = [(i, t, 1, "z") for i, t in enumerate(texts + [changed(rng, t, 1) for t in texts])]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(len(texts)))


def test_simhash_links_are_candidates(spark):
    """Fingerprints that are equal or differ in two bits share a key, those that differ in three do not."""
    marks = [(1, 0), (2, 0), (3, 1 << 40), (4, -(1 << 63)), (5, 0b111 << 20), (6, (0b111 << 20) | 1)]
    got = {}
    for r in similar_texts.simhash_keys(spark.createDataFrame(marks, "fp long, mark long")).collect():
        got.setdefault(r["key"], []).append(r["fp"])
    met = {(a, b) for fps in got.values() for a in fps for b in fps if a < b}
    assert met == {(a, b) for a, x in marks for b, y in marks if a < b and ((x ^ y) & (2**64 - 1)).bit_count() <= 2}


def test_stage_takes_its_simhash_step(spark, monkeypatch):
    asked = []
    links = similar_texts.fingerprint_links
    monkeypatch.setattr(similar_texts, "fingerprint_links", lambda found: asked.append(found.count()) or links(found))
    rows = [(i, prose(random.Random(i), 40), 1, "z") for i in range(6)]
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").count() == 6
    assert asked == [6]
