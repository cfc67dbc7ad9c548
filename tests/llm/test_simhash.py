"""SimHash groups against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgersift.llm import graph, simhash_dedup

from .helpers import components, words


def plain_fingerprint(text):
    ws = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_groups(fps):
    """fps: {doc_id: fingerprint}."""
    by = {}
    for d, f in fps.items():
        by.setdefault(f, []).append(d)
    keys = sorted(by)
    links = [(min(by[a]), min(by[b])) for i, a in enumerate(keys) for b in keys[:i] if (a ^ b).bit_count() <= 2]
    links += [(ds[0], d) for ds in by.values() for d in ds]
    return components(fps, links)


TEXTS = [None, "", " \n", "A", "a b", "A B", "a b c", "İ É x y z", "x" * 100_000, "w " * 20_000, "a\x0bb c d"]


def test_fingerprints_and_odd_rows(spark):
    rows = [(i, t, 1, 2, "z") for i, t in enumerate(TEXTS + TEXTS[:4])] + [(None, "only here no id", 1, 2, "z"), (None, "a b", 1, 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id int, root string")
    got = simhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {i: plain_fingerprint(t) for i, (_, t, *_) in enumerate(rows[:-2])}
    wanted = plain_groups(fps)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fp"] % 2**64 == fps[r["doc_id"]] and r["component_id"] == wanted[r["doc_id"]]
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None, wanted[4]}
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({*wanted.values(), None}, key=str)


@pytest.mark.parametrize("limit", [2, 3, 64])
def test_links_of_dense_and_sparse_groups(spark, limit):
    """Clouds around a few centres: overfull keys, chains, and far fingerprints; any limit gives the same groups."""
    rng = random.Random(limit)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, 2**63, 2**64 - 1, 2**64 - 2, 3 << 31}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash_dedup.fingerprint_groups(rows, limit).collect()}
    wanted = plain_groups({i: f for i, f in enumerate(fps)})
    assert got == {signed[i]: wanted[i] for i in wanted}


def test_query_matches_brute_force(spark):
    got = {r["doc_id"]: r for r in simhash_dedup.simhash_dedup(spark, "/root/testdata/sf0.01").collect()}
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    fps = {d: int(got[d]["fingerprint"], 16) for d in got}
    for d in list(text)[:60]:
        assert fps[d] == plain_fingerprint(text[d])
    wanted = plain_groups(fps)
    assert set(got) == set(text) and all(got[d]["component_id"] == wanted[d] for d in got)


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(1, 2), (2, 3), (3, 1), (5, 5)]
    random.Random(0).shuffle(links)
    table = spark.createDataFrame(links + links[:20], "p long, q long")
    got = {r["a"]: r["b"] for r in graph.components(table).collect()}
    wanted = components({n for x in links for n in x}, links)
    assert got == {n: r for n, r in wanted.items() if n != r}
    assert graph.components(table.limit(0)).count() == 0
