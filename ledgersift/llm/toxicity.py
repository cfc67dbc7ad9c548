"""Toxicity severity by cumulative-link ordinal regression (proportional odds, McCullagh 1980).

P(grade <= k) = sigmoid(theta_k - w.x): the weights w are shared by all thresholds theta_0 < theta_1 < ...
Features are sparse: log(1 + count) of the words and word beginnings whose presence is associated with the
label, and the log of the text's length, so that what a long text holds by chance weighs less. The model is
fitted on a bounded sample of labelled documents (about ``SAMPLE``); every document is
scored, whole. The labels know only toxic or not; severity grades of toxic sample documents are derived from
how large a part of their words is associated with the label (thirds of the toxic sample).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # about so many labelled documents, by hash, fit the model
MAX_FEATURES = 2_000  # most strongly associated words
MIN_DOCS = 4  # documents of the sample a feature must occur in
MIN_Z = 4.0  # standard errors its log odds must be away from zero
GRADES = 4
PENALTY = 0.1
STEPS = 600
CUT = 0.5  # probability of any grade above zero at which a document counts as toxic

BEGINNINGS = (3, 4, 5)  # letters of word beginnings, which inflected and compound forms share
LENGTH = ""  # name of the length feature
SHORT = 200  # terms up to which length says nothing

WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> list[str]:
    """Words, and beginnings of longer words, in lower case."""
    ws = WORD.findall((text or "").lower())
    return ws + ["^" + w[:n] for n in BEGINNINGS for w in ws if len(w) > n]


def values_of(found: list[str], known) -> dict[str, float]:
    n = Counter(x for x in found if x in known)
    return {**{x: float(np.log1p(c)) for x, c in sorted(n.items())}, LENGTH: float(np.log(max(len(found), SHORT) / SHORT))}


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of about ``size`` labelled documents (hash of doc_id below a bound). Repeated labels count once, as toxic if any says so."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = size / max(labels.count(), size, 1)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    # About ``size`` rows of two numbers: bounded, so they may be broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(known.where(draw < share)), "doc_id")


def associated_words(sample: DataFrame) -> dict[str, float]:
    """Log odds per word that is associated with the label, for at most ``MAX_FEATURES`` words."""

    def presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = {0: Counter(), 1: Counter()}
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                n[int(toxic > 0)].update(set(terms(text)))
            both = sorted({*n[0], *n[1]})
            yield pd.DataFrame({"word": both, "clean": [n[0][w] for w in both], "toxic": [n[1][w] for w in both]})

    total = sample.agg(F.count(F.when(F.col("toxic") > 0, 1)), F.count(F.when(F.col("toxic") <= 0, 1))).first()
    n1, n0 = total[0], total[1]
    counts = sample.select("text", "toxic").mapInPandas(presence, "word string, clean long, toxic long")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where(F.col("a") + F.col("b") >= MIN_DOCS)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (F.lit(n1 + 1.0) - a)) - F.log(b / (F.lit(n0 + 1.0) - b))
    error = F.sqrt(1 / a + 1 / (F.lit(n1 + 1.0) - a) + 1 / b + 1 / (F.lit(n0 + 1.0) - b))
    best = counts.withColumn("odds", odds).withColumn("z", F.abs(odds / error)).where(F.col("z") >= MIN_Z)
    return {r["word"]: r["odds"] for r in best.orderBy(F.desc("z"), "word").limit(MAX_FEATURES).collect()}


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from sparse features (row, column, value) and grades 0.. by penalised likelihood."""
    n, k = len(grades), int(grades.max()) + 1 if len(grades) else 1
    if k < 2:
        return np.zeros(n_features), np.array([20.0])  # one grade only: nothing is above it
    share = np.array([np.mean(grades <= g) for g in range(k - 1)]).clip(1e-4, 1 - 1e-4)
    theta = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(n_features), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    for step in range(1, STEPS + 1):
        w, gaps = params[:n_features], np.exp(params[n_features + 1 :])
        theta = params[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(rows, weights=values * w[columns], minlength=n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        high, low = sigmoid(edge[grades + 1] - eta), sigmoid(edge[grades] - eta)
        high[grades == k - 1], low[grades == 0] = 1.0, 0.0
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p  # derivatives by the upper and lower edge
        g_eta = dh - dl
        g_theta = np.array([-dh[grades == j].sum() + dl[grades == j + 1].sum() for j in range(k - 1)])
        g_w = np.bincount(columns, weights=values * g_eta[rows], minlength=n_features) + PENALTY * w
        tail = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([g_w, tail[:1], tail[1:] * gaps]) / max(n, 1)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    theta = params[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_features + 1 :]))])
    return params[:n_features], theta


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[dict[str, float], list[float]]:
    """(weight per word, thresholds)."""
    sample = labelled_sample(docs, labels, size)
    odds = associated_words(sample)
    names = {w: i for i, w in enumerate(sorted({*odds, LENGTH}))}

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, toxic in zip(pdf["doc_id"], pdf["text"], pdf["toxic"]):
                found = terms(text)
                x = values_of(found, odds)
                marked = sum(odds.get(w, 0) > 0 for w in found) / max(1, len(found))
                out.append((doc, int(toxic > 0), marked, [names[w] for w in x], list(x.values())))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "marked", "columns", "values"])

    kept = sample.mapInPandas(features, "doc_id long, toxic int, marked double, columns array<int>, values array<double>").toPandas()
    kept = kept.sort_values(["doc_id", "marked"]).reset_index(drop=True)  # about ``size`` rows of up to ``MAX_FEATURES``
    grades = kept["toxic"].to_numpy(dtype=np.int64).copy()
    marked = kept["marked"].to_numpy()
    if grades.any():
        inner = np.quantile(marked[grades == 1], np.linspace(0, 1, GRADES)[1:-1])
        grades[grades == 1] = 1 + np.searchsorted(inner, marked[grades == 1], "right")
        grades = np.searchsorted(np.unique(grades), grades)  # no empty grade
    lengths = kept["columns"].map(len).to_numpy() if len(kept) else np.empty(0, int)
    rows = np.repeat(np.arange(len(kept)), lengths)
    columns = np.concatenate([np.asarray(c, np.int64) for c in kept["columns"]]) if len(rows) else np.empty(0, np.int64)
    values = np.concatenate([np.asarray(c, float) for c in kept["values"]]) if len(rows) else np.empty(0)
    weights, theta = fit_ordinal(rows, columns, values, grades, len(names))
    return {w: float(weights[i]) for w, i in names.items()}, [float(t) for t in theta]


def severity(docs: DataFrame, weights: dict[str, float], thresholds: list[float]) -> DataFrame:
    """Every row of ``docs``: doc_id, severity (expected grade), p_toxic (any grade above zero), toxic.

    A null or empty text has no features and the severity of a text without associated words. Repeated rows
    are scored each; other columns are ignored; an empty table gives an empty result. Nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast((weights, thresholds))  # at most MAX_FEATURES words

    @F.pandas_udf("severity double, p_toxic double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, theta = held.value
        theta = np.array(theta)
        for texts in batches:
            eta = np.zeros(len(texts))
            for i, text in enumerate(texts):
                eta[i] = sum(w[x] * v for x, v in values_of(terms(text), w).items())
            above = 1 / (1 + np.exp(np.clip(theta[None, :] - eta[:, None], -35, 35)))  # P(grade > k)
            yield pd.DataFrame({"severity": above.sum(axis=1), "p_toxic": above[:, 0]})

    scored = docs.select("doc_id", score("text").alias("s"))
    return scored.select("doc_id", "s.severity", "s.p_toxic", (F.col("s.p_toxic") >= CUT).alias("toxic"))


def toxicity(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document, with a model fitted on the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = severity(docs, *train(docs, labels))
    return scored.select("doc_id", F.round("severity", 6).alias("severity"), F.round("p_toxic", 6).alias("p_toxic"), "toxic")
