"""Prefix trie and hard negatives against brute force, and their SQL on the smallest tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, tables
from ledgersift.llm import conversation_trie, hard_negatives

SF = "/root/testdata/sf0.01"


def plain_trie(convs):
    """convs: {conv_id: tuple of (role, text)}."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out = set()
    for path, members in nodes.items():
        inside = [p for p in nodes if p[: len(path)] == path]
        ends = ",".join(str(c) for c in sorted(members) if convs[c] == path)
        out.add((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids.get(path, [])),
            sum(p not in kids for p in inside), sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in inside if p),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, name, role, text))
    own = {c: tuple(x[3:] for x in sorted(t)) for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(np.fmod(c, 100)), ())
        out[c] = base[:h] + turns[h:]
    return out


def conversation_rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 60), *range(195, 230), 400, -1, -100, -150, 10**12]:
        for t in range(rng.choice([1, 1, 2, 3, 7])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "", "ü" * 5])))
    long = [(t, "user", rng.choice("xy")) for t in range(70)]
    rows += [(1000 + c, t, r, x) for c in range(0, 4) for t, r, x in long[: 70 - 5 * (c % 2)]]
    rows += [(2000 + c, t, "user", "same") for c in range(40) for t in range(8)]  # a hot group of copies
    rows += [(7, None, None, None), (7, None, "user", None), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (None, 0, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns", [4, 50, 400_000])
def test_trie_matches_brute_force(spark, turns):
    rows = conversation_rows()
    schema = "conv_id long, turn long, role string, text string, shard int, ids string"
    table = spark.createDataFrame([(*r, 1, "clash") for r in rows], schema)
    built = conversation_trie.rebuilt(conversation_trie.turn_arrays(table))
    got = {tuple(r) for r in conversation_trie.prefix_trie(built, turns).collect()}
    assert got == plain_trie(plain_rebuilt(rows))


def test_trie_of_few_and_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string"

    def trie(rows):
        built = conversation_trie.rebuilt(conversation_trie.turn_arrays(spark.createDataFrame(rows, schema)))
        return {tuple(r) for r in conversation_trie.prefix_trie(built).collect()}

    assert trie([]) == set()
    only = [(5, 0, "user", "x" * 200_000)]  # its head comes from an absent conversation
    assert trie(only) == plain_trie(plain_rebuilt(only))
    turnless = spark.createDataFrame([(3, []), (1, [])], "conv_id long, turns array<struct<id:binary,n:bigint>>")
    [row] = conversation_trie.prefix_trie(turnless).collect()
    assert tuple(row) == (1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,3").hexdigest())


def plain_negatives(rows, anchor):
    q = {}
    for i, label, v in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1], r[2])):
        if all(x is not None and np.isfinite(x) for x in v):
            q.setdefault(i, (label, [int(np.floor(256 * x)) for x in v]))
    out = set()
    for a in filter(anchor, q):
        score = {i: sum(x * y for x, y in zip(q[a][1], v)) for i, (_, v) in q.items() if i != a and len(v) == len(q[a][1])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if q[i][0] == q[a][0]][:5]:
            hard = [i for i in order if q[i][0] != q[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out |= {(a, p, n, i, score[p], score[i]) for n, i in enumerate(hard[:3], 1)}
    return out


def vector_rows(scale=1.0):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    rows = [(i, int(rng.integers(4)), [float(x) for x in scale * (centres[rng.integers(4)] + 0.4 * rng.normal(size=6))]) for i in range(300)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(150)]  # a hot group of copies, all ties
    rows += [(2000, 0, [0.0] * 6), (2050, 1, [0.0] * 6), (-50, 2, rows[3][2]), (2100, 3, [0.25, 0.5]), (2101, 3, [0.25, 0.5]), (2102, 1, [0.2, 0.3])]
    odd = [(None, 1, rows[1][2]), (3000, None, rows[1][2]), (3050, 1, None), (3100, 1, [None] * 6), (3150, 1, [float("nan")] * 6)]
    odd += [(3200, 1, [float("inf")] * 6), (3250, 1, []), (50, 3, rows[9][2]), rows[0]]
    return rows + odd


@pytest.mark.parametrize("blocks", [(1_024, 4 << 20), (3, 200)])
@pytest.mark.parametrize("scale", [1.0, 100_000.0])
def test_negatives_match_brute_force(spark, blocks, scale):
    rows = vector_rows(scale)
    schema = "vec_id long, label int, embedding array<double>, slot int, dim string, i int"
    table = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], schema)
    found = hard_negatives.hard_negatives(table, F.col("vec_id") % 50 == 0, anchor_rows=blocks[0], values=blocks[1])
    assert dict(found.dtypes)["rank"] == "int"
    got = {tuple(r) for r in found.collect()}
    assert got == plain_negatives(rows, lambda i: i % 50 == 0)


def test_negatives_of_no_rows_and_of_too_large_numbers(spark):
    schema = "vec_id long, label int, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], schema)
    assert hard_negatives.hard_negatives(alone, F.col("vec_id") % 50 == 0).count() == 0
    huge = spark.createDataFrame([(0, 1, [1e30])], schema)
    with pytest.raises(ArithmeticError):
        hard_negatives.hard_negatives(huge, F.col("vec_id") % 50 == 0)


@pytest.mark.parametrize("name", ["trie", "negatives"])
def test_sql_agrees(spark, name):
    query, sql = {
        "trie": (conversation_trie.conversation_trie, conversation_trie.TRIE_SQL),
        "negatives": (hard_negatives.mined_negatives, hard_negatives.NEGATIVE_SQL),
    }[name]
    status, note = compare(spark, tables(SF), SF, query, sql)
    assert status == "ok", note
