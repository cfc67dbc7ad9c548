"""Hard negatives by slot-decomposed selection.

For every anchor, its positives are the highest-scoring rows of its label, and each positive asks for the best
rows of other labels inside a window of scores that hangs on the positive's own score. The windows of an anchor
overlap, so their upper limits cut the scores into disjoint slots: a row falls into one slot, and one pass serves
all windows. Blocks of anchors meet blocks of rows; each meeting keeps the best few of every slot, those are
ranked again across blocks, and a window's answer is read off the slots from its own limit downwards: their lists
joined in descending order, cut to the wanted number, then to the window's lower limit.

Scores are whole numbers, computed as exact products of doubles (or of 64-bit integers for large components).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.cluster import stored

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
SCALE = 256
ANCHORS = 1_024  # anchors of a block
VALUES = 4 << 20  # vector components of a block of rows
CELLS = 2 << 20  # scores held at once
EXACT = float(1 << 53)  # up to here a product of doubles is exact
LARGEST = float(1 << 56)  # beyond, window limits leave a long


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, dim) of the rows that can take part, one per vec_id."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    there = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~odd)
    one = there.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))
    return one.select("vec_id", "r.label", "r.embedding", F.size("r.embedding").alias("dim"))


def _whole(column: pa.ChunkedArray, dim: int, exact: bool) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * values).reshape(len(column), dim).astype(np.float64 if exact else np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id, in this order."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _table(anchors, ids, scores, slots=None) -> pa.Table:
    """Hits of one meeting of blocks."""
    empty = np.zeros(0, np.int64)
    columns = {"anchor_id": anchors, "vec_id": ids, "score": scores} | ({} if slots is None else {"slot": slots})
    return pa.table({n: pa.array(np.concatenate(x) if x else empty) for n, x in columns.items()})


def _positives(exact: bool, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        anchors, ids, scores = [], [], []
        if len(asked) and len(rows):
            dim = rows["dim"][0].as_py()
            a, x = _whole(asked["embedding"], dim, exact), _whole(rows["embedding"], dim, exact)
            own, row = asked["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
            own_label, label = asked["label"].to_numpy(), rows["label"].to_numpy()
            for name in np.unique(own_label):
                at = np.flatnonzero(label == name)
                left = np.flatnonzero(own_label == name)
                step = max(1, CELLS // max(1, len(at)))
                for part in (left[i : i + step] for i in range(0, len(left), step)):
                    found = a[part] @ x[at].T
                    for i, s in zip(part, found):
                        other = row[at] != own[i]
                        best = _best(s[other], row[at][other], k)
                        anchors.append(np.full(len(best), own[i]))
                        ids.append(row[at][other][best])
                        scores.append(s[other][best].astype(np.int64))
        return _table(anchors, ids, scores)

    return meet


def _slots(exact: bool, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        anchors, ids, scores, slots = [], [], [], []
        if len(asked) and len(rows):
            dim = rows["dim"][0].as_py()
            a, x = _whole(asked["embedding"], dim, exact), _whole(rows["embedding"], dim, exact)
            own, row = asked["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
            own_label, label = asked["label"].to_numpy(), rows["label"].to_numpy()
            uppers, lowest = asked["uppers"].to_pylist(), asked["lowest"].to_numpy()
            step = max(1, CELLS // len(row))
            for start in range(0, len(own), step):
                for i, s in enumerate(a[start : start + step] @ x.T, start):
                    limits = np.array(uppers[i])  # descending
                    at = np.flatnonzero((s <= limits[0]) & (s >= lowest[i]) & (label != own_label[i]))
                    # The slot of a score is that of the smallest limit it does not exceed.
                    slot = len(limits) - 1 - np.searchsorted(limits[::-1], s[at], side="left")
                    for number in np.unique(slot):
                        within = at[slot == number]
                        best = within[_best(s[within], row[within], k)]
                        anchors.append(np.full(len(best), own[i]))
                        ids.append(row[best])
                        scores.append(s[best].astype(np.int64))
                        slots.append(np.full(len(best), number))
        return _table(anchors, ids, scores, slots)

    return meet


def _meetings(anchors: DataFrame, rows: DataFrame, across: int, down: int, meet, schema: str) -> DataFrame:
    """``meet`` for every block of anchors and every block of rows with vectors of the same length."""
    keys = ["dim", "i", "j"]
    parts = min(4 * across * down, 20_000)

    def block(n):
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    left = anchors.withColumn("i", block(across)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = rows.withColumn("j", block(down)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    left, right = (x.repartition(parts, *keys).groupBy(*keys) for x in (left, right))
    return left.cogroup(right).applyInArrow(meet, schema)


def _ranked(hits: DataFrame, k: int, *by: str) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    anchor_rows: int = ANCHORS, values: int = VALUES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, label, embedding).

    A row with a null vec_id, label or vector, or a null or non-finite component, takes no part. Of rows that
    repeat a vec_id the one with the smallest label, then vector, counts. Vectors are compared with those of
    their own length only. Ties go to the smaller vec_id; an anchor without positives and a window without rows
    give nothing; other columns are ignored; an empty table gives an empty result. Scores beyond 2^56 are refused.
    """
    spark = rows.sparkSession
    rows = stored(usable(rows), "vectors")
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(float(SCALE)) * x.cast("double")), F.lit(2.0)))
    n, cells, asked, reach = rows.agg(F.count("*"), F.sum("dim"), F.count_if(is_anchor), F.max(length)).first()
    reach = reach or 0.0
    if not reach <= LARGEST:
        raise ArithmeticError("inner products leave the range of whole numbers")
    exact = reach < EXACT
    across = max(1, -(-asked // anchor_rows))
    down = max(1, -(-(cells or 0) // values), -(-2 * spark.sparkContext.defaultParallelism // across))
    anchors = rows.where(is_anchor)
    hits = _meetings(anchors, rows, across, down, _positives(exact, positives), "anchor_id long, vec_id long, score long")
    found = stored(_ranked(hits, positives, "anchor_id").drop("place"), "positives")
    # 50 p <= 100 s <= 95 p, in whole numbers; a negative p leaves no s.
    lower = F.expr(f"(score DIV 100) * {LOW} + (score % 100 * {LOW} + 99) DIV 100")
    upper = F.expr(f"(score DIV 100) * {HIGH} + (score % 100 * {HIGH}) DIV 100")
    windows = found.where("score >= 0").select("anchor_id", "vec_id", "score", lower.alias("lower"), upper.alias("upper"))
    limits = windows.groupBy("anchor_id").agg(F.collect_set("upper").alias("uppers"), F.min("lower").alias("lowest"))
    limits = limits.withColumn("uppers", F.sort_array("uppers", False))
    asking = stored(anchors.join(limits.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "anchors")
    hits = _meetings(asking, rows, across, down, _slots(exact, negatives), "anchor_id long, vec_id long, score long, slot long")
    kept = _ranked(hits, negatives, "anchor_id", "slot").groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", "place", "vec_id", "score"))).alias("kept")
    )
    wanted = windows.join(limits, "anchor_id").join(kept, "anchor_id")
    slot = F.array_position("uppers", F.col("upper")) - 1
    suffix = F.slice(F.filter("kept", lambda x: x["slot"] >= F.col("at")), 1, negatives)
    inside = F.filter(suffix, lambda x: x["score"] >= F.col("lower"))
    return (
        wanted.withColumn("at", slot)
        .select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(inside).alias("at", "n"))
        .select(
            "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"),
            "positive_score", F.col("n.score").alias("negative_score"),
        )
    )


def contract_rows(vectors: DataFrame) -> DataFrame:
    """Rows whose vec_id is divisible by 7 carry a wrong label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", label.alias("label"), "embedding")


def mined_negatives(spark, sf_dir: str) -> DataFrame:
    """Registered query: anchors are the vectors whose vec_id is divisible by 50, against all vectors."""
    vectors = contract_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


NEGATIVE_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM vectors a JOIN vectors r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER best)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score,
  s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER best <= 3
"""
