"""Line dedup, source mixing, tokens, toxicity, embeddings and the pipeline against brute force."""

import collections
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from ledgersift.llm import embedding_graph, line_dedup, piece_tokens, quality_rules, source_mixing, toxicity

from .helpers import components, words
from .test_similar_texts import plain_groups

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sid int, template long, block long, n int"


def table(spark, rows):
    """Rows (doc_id, text, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", s, None, 1, 2, 3, 4) for d, t, s in rows], DOCS)


# --- line dedup -------------------------------------------------------------------------------------------


def plain_lines(rows, min_docs):
    """Kept text per row for tables where templates are masked lines (no other variable fields)."""
    def key(line):
        masked = [re.sub("[0-9]+", "<*>", w) for w in words(line)]
        return tuple(masked) if len(masked) >= line_dedup.MIN_TOKENS else None

    held = collections.defaultdict(set)
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add((d, t))
    seen, out = {}, {}
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for i, line in enumerate((t or "").split("\n")):
            k = key(line)
            if k is None or len(held[k]) < min_docs or seen.setdefault(k, (d, t, i)) == (d, t, i):
                kept.append(line)
        out[d, t] = None if t is None else "\n".join(kept)
    return out


def test_recurring_lines_go_but_for_the_first(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(400)]
    common = ["all rights are reserved here 2024", "page 12 of 90 in this book", "short one", "   ", ""]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.4 else " ".join(rng.choices(vocabulary, k=9)) for _ in range(rng.randint(1, 12))), "s") for i in range(1, 60)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "page 7 of 8 in this book\n" * 2000, "s"), rows[3], rows[3]]
    got = line_dedup.dedup_lines(table(spark, rows)).collect()
    assert len(got) == len(rows)
    wanted = plain_lines(rows, line_dedup.MIN_DOCS)
    by_id = {d: t for d, t, _ in rows}
    for r in got:
        assert r["text"] == wanted[r["doc_id"], by_id[r["doc_id"]]], r["doc_id"]
    assert line_dedup.dedup_lines(table(spark, rows).limit(0)).count() == 0


def test_variable_words_are_generalised(spark):
    names = "anna bert carla dora emil franz gerda hugo".split()
    line = "this text was kindly sent to us by {} from the old town on the hill by mail"
    rows = [(i, f"{line.format(n)}\nunique {n} {n}x {n}y {n}z words stand in this line", "s") for i, n in enumerate(names)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == rows[i][1].split("\n")[1] for i in range(1, 8))


# --- source mixing ----------------------------------------------------------------------------------------


def plain_targets(sizes):
    """Water filling step by step."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while True:
        rest = total - sum(done.values())
        open_ = [s for s in order if s not in done]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**done, **share}
        done.update({s: 3.0 * sizes[s] for s in over})


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, None: 30}, {"a": 1, "b": 1000, "c": 2, "é": 5, "": 0}, {"x": 7}, {"a": 0, "b": 9}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_mixing.targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_is_near_its_targets_and_repeatable(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(0, 400))), rng.choice(["a", "a", "a", "b", None, "é"])) for i in range(600)]
    rows += [(700, "x " * 30_000, "b"), (701, None, "a"), (702, "", None), rows[5], rows[5], (None, "no id at all", "a")]
    docs = table(spark, rows)
    got = source_mixing.mixed_words(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = collections.Counter(), collections.Counter()
    text = {d: t for d, t, _ in rows}
    for r in got:
        assert r["size"] == len(words(text[r["doc_id"]])) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    goal = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
    assert all(abs(taken[s] - goal[s]) <= max(512, 0.02 * goal[s]) for s in goal)
    again = source_mixing.mixed_words(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    pieces = source_mixing.mix_documents(docs).collect()
    assert sum(len(words(p["text"])) for p in pieces) == sum(r["taken"] for r in got)
    assert all(p["text"] in (text[p["doc_id"]] or "") and p["n_chars"] == len(p["text"]) for p in pieces)
    assert source_mixing.mixed_words(docs.limit(0)).count() == 0 and source_mixing.mix_documents(docs.limit(0)).count() == 0


def test_permutations_and_slots(spark):
    import pandas as pd

    for n in (1, 2, 3, 4, 5, 17, 1000, 4097):
        k = pd.Series(range(n))
        p = source_mixing.permuted(k, pd.Series([n] * n), pd.Series([n * 7 + 1] * n))
        assert sorted(p) == list(range(n))
    quotas = {1: 5000, 2: 0, 3: 1700, 4: 1}
    sources = spark.createDataFrame(list(quotas.items()), "sid int, quota long")
    slots = source_mixing.draw_slots(sources, sum(quotas.values())).toPandas()
    assert sorted(slots["slot"]) == list(range(6701))
    for sid, q in quotas.items():
        assert sorted(slots[slots["sid"] == sid]["k"]) == list(range(q))


# --- tokens -----------------------------------------------------------------------------------------------


def test_tokens_equal_the_library(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "   a", "a\n\nb\tc", "é😀漢字 ▁x", "<s></s><0x41>", "x" * 20_000, " " * 100 + "q", "\0a\0", "word " * 20_000]
    texts += ["".join(rng.choice("ab  \n▁éthein漢🙂the ing") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    library = sentencepiece.SentencePieceProcessor(model_file=piece_tokens.MODEL)
    encoded = piece_tokens.encode_documents(docs, piece_tokens.MODEL, "doc_id")
    for r in encoded.collect():
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]] or "")
    back = {r["doc_id"]: r["text"] for r in piece_tokens.decode_documents(encoded, piece_tokens.MODEL, "doc_id").collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    digest = piece_tokens.token_digest(docs, piece_tokens.MODEL, "doc_id")
    assert digest.where("round_trip").count() == len(texts) and piece_tokens.token_digest(docs.limit(0)).count() == 0


def test_relaxed_path_is_used(spark):
    """Units come from compatible edges, not from merging each unit."""
    encoder = piece_tokens.Encoder(piece_tokens.load_model())
    merged, calls = encoder.merged, []
    encoder.merged = lambda s: calls.append(s) or merged(s)
    units = ["▁house", "▁houses", "▁outhouse", "▁ththere"]
    assert encoder.encode_units(units) == [encoder.numbers(merged(u)) for u in units]
    calls.clear()  # with the pairs known, nothing is merged any more
    assert encoder.encode_units(units[::-1]) == [encoder.numbers(merged(u)) for u in units[::-1]] and not calls


# --- toxicity ---------------------------------------------------------------------------------------------


def test_severity_on_held_out_documents(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    bad = ["vile", "scum", "trash"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        ws = rng.choices(vocabulary, k=rng.randint(30, 90))
        for _ in range(rng.randint(2, 8) if toxic else 0):
            ws[rng.randrange(len(ws))] = rng.choice(bad)
        rows.append((i, " ".join(ws), "s"))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (0, 1, 1)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "scum trash " * 9000, "s"), (None, "vile", "s"), rows[0]]
    docs = table(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights, theta = toxicity.train(docs, marks.where("doc_id < 400 OR doc_id IS NULL"))
    assert len(theta) == toxicity.GRADES - 1 and theta == sorted(theta)
    got = toxicity.severity(docs, weights, theta).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] is not None and 400 <= r["doc_id"] < 600]
    assert sum(r["toxic"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert by[902]["severity"] > 2 and not by[900]["toxic"] and by[900]["severity"] == by[901]["severity"]
    assert toxicity.severity(docs.limit(0), weights, theta).count() == 0
    none = toxicity.train(docs, marks.limit(0))
    assert toxicity.severity(docs, *none).where("toxic").count() == 0


def test_ordinal_gradient_reaches_the_optimum():
    """Likelihood of the fit is not below that of nearby parameters."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    eta = x @ [1.5, -1, 0.5]
    grades = np.digitize(eta + rng.logistic(size=400), [-1, 1])
    r, c = np.nonzero(np.ones_like(x))
    w, theta = toxicity.fit_ordinal(r, c, x[r, c], grades, 3)

    def loss(w, theta):
        edge = np.concatenate([[-40.0], theta, [40.0]])
        p = 1 / (1 + np.exp(-(edge[grades + 1] - x @ w))) - 1 / (1 + np.exp(-(edge[grades] - x @ w)))
        return -np.log(np.maximum(p, 1e-300)).sum() + toxicity.PENALTY / 2 * w @ w

    best = loss(w, theta)
    for _ in range(60):
        assert loss(w + rng.normal(size=3) * 0.1, theta + rng.normal(size=2) * 0.05) > best - 1e-2


# --- embeddings -------------------------------------------------------------------------------------------


def plain_near(vectors, bound=0.9):
    good = {}
    for i, v in vectors:
        a = np.array([np.nan if x is None else x for x in v], float) if v is not None else np.empty(0)
        if i is not None and a.size and np.isfinite(a).all() and (a != 0).any():
            good.setdefault(i, []).append(a / np.linalg.norm(a))
    flat = [(i, a) for i, vs in good.items() for a in vs]
    links = [(i, j) for k, (i, a) in enumerate(flat) for j, b in flat[:k] if len(a) == len(b) and a @ b >= bound]
    n = collections.Counter(i for x in links for i in x)
    return n, components({i for i, _ in vectors if i is not None}, links)


def cloud(rng, n, d=24, blobs=((40, 0.05), (5, 0.1))):
    out = [rng.normal(size=d) for _ in range(n)]
    for size, noise in blobs:
        c = rng.normal(size=d)
        out += [c + rng.normal(size=d) * noise for _ in range(size)]
    return [v.astype(np.float32).tolist() for v in out]


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    vs = cloud(rng, 400)
    rows = list(enumerate(vs)) + [(1000, vs[0]), (1001, [2 * x for x in vs[1]]), (1002, None), (1003, []), (1004, [0.0] * 24),
            (1005, [None] + vs[2][1:]), (1006, [float("nan")] + vs[2][1:]), (1007, [float("inf")] + vs[2][1:]), (1008, vs[3][:5]), (None, vs[4])]
    table_ = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, node int, cell int")
    got = {r["vec_id"]: r for r in embedding_graph.near_vectors(table_).collect()}
    n, top = plain_near(rows)
    assert len(got) == len(rows)
    found = sum(got[i]["n_links"] for i in top)
    assert found >= 0.98 * sum(n.values()) and all(got[i]["n_links"] <= n[i] for i in top)
    assert sum(got[i]["component_id"] == top[i] for i in top) >= 0.98 * len(top)
    assert all(got[i]["kept"] == (i == got[i]["component_id"]) for i in top)
    assert got[None]["component_id"] is None and not got[None]["kept"] and got[1005]["n_links"] == 0
    assert embedding_graph.near_vectors(table_.limit(0)).count() == 0


def test_embedding_shards_split(spark, monkeypatch):
    """Small limits: several levels of pivots, a dense group that only a hash can split, cut query chunks."""
    for name, value in (("TARGET", 40), ("MAX_SHARD", 80), ("MAX_PIVOTS", 6), ("QUERIES", 50), ("LEVELS", 3)):
        monkeypatch.setattr(embedding_graph, name, value)
    rng = np.random.default_rng(2)
    vs = cloud(rng, 500, 16, ((300, 0.02), (30, 0.1)))
    rows = list(enumerate(vs))
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding_graph.near_vectors(table_).collect()}
    n, top = plain_near(rows)
    assert sum(got[i]["n_links"] for i in top) >= 0.95 * sum(n.values()) and all(got[i]["n_links"] <= n[i] for i in top)
    assert sum(got[i]["component_id"] == top[i] for i in top) >= 0.97 * len(top)


# --- pipeline ---------------------------------------------------------------------------------------------


def test_stages_work_on_what_is_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.quality(spark, docs, SF).cache()
    kept = {r["doc_id"] for r in quality_rules.quality_verdicts(docs).where("kept").collect()}
    assert {r["doc_id"] for r in first.collect()} == kept and first.columns == docs.columns
    second = corpus_pipeline.lines(spark, first, SF).cache()
    assert second.columns == docs.columns and second.count() == first.count()
    wanted = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(first).collect()}
    assert {r["doc_id"]: r["text"] for r in second.collect()} == wanted
    assert second.where(F.length("text") != F.col("n_chars")).count() == 0
    third = corpus_pipeline.near_duplicates(spark, second, SF).cache()
    groups = plain_groups(wanted)
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(set(groups.values()))
    fourth = corpus_pipeline.mixture(spark, third, SF).cache()
    sizes = source_mixing.mixed_words(third).agg(F.sum("taken")).first()[0]
    assert fourth.columns == docs.columns and sum(len(words(r["text"])) for r in fourth.collect()) == sizes
    last = corpus_pipeline.tokens(spark, fourth, SF)
    assert last.count() == fourth.count() and last.where("NOT round_trip").count() == 0
