"""Connected components of a link table, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.cluster import stored

ROUNDS = 100


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b): every linked node with the smallest node it reaches, for nodes other than that smallest one.

    ``links`` has two columns of whole numbers, in any order and with repetitions. Minima are taken by an
    aggregate and joined back, so a node of any degree is combined on the map side and split as a skewed join.
    Each round is written to the shared folder: nothing is held by an executor alone.
    """
    x, y = links.columns
    edges = stored(
        links.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "links"
    )
    before = _state(edges)
    for _ in range(ROUNDS):
        if not before[0]:
            return edges
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = _state(edges)
        if now == before:
            return edges
        before = now
    raise RuntimeError("components did not settle")
