"""Near-duplicates by shingle similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A one-word change in a text of ordinary length moves more bits of a 64-bit SimHash than any selective key
allows, so candidates meet under MinHash keys (Broder 1997): ``BANDS`` keys of ``BAND`` minima each, under
which a pair of similarity s meets with probability 1 - (1 - s^BAND)^BANDS: 0.99999 at 0.8. Every link is
verified on the shingles themselves. The links of ``simhash_dedup`` (fingerprints that differ in two bits or fewer,
found by deletion-variant signatures) are candidates too: each is a key of its own, and so is each fingerprint.

Texts of equal shingle sets collapse first. A key held by up to ``LIMIT`` sets gives all its pairs. A fuller
key is worked off in rounds: its members are compared with 1, 8, 64, ... of them, those first that most full
keys share, and only where both sides are not yet connected, until all members are connected or all pairs
are compared. A group around one text costs in proportion to its members; members of a full key that are
not similar to each other cost the square of their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.cluster import stored

from .graph import components
from .simhash_dedup import fingerprint_links, fingerprints, first_rows, grouped_by

SHINGLE = 5
SIMILAR = 0.8
SEED = 42
BANDS, BAND = 30, 5
LIMIT = 16  # pairs are listed up to this many sets under a key
GROWTH = 8  # compared members of a fuller key, from round to round

_RNG = np.random.default_rng(SEED)
FACTORS = _RNG.integers(0, 2**64, BANDS * BAND, dtype=np.uint64) | np.uint64(1)
ADDED = _RNG.integers(0, 2**64, BANDS * BAND, dtype=np.uint64)
BLOCK = 4_096  # shingles hashed at once


def shingles(text: str | None, length: int = SHINGLE) -> set[bytes]:
    """Distinct shingles; a text of fewer words is one shingle, a text without words has none. Words as in op1."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(ws) < length:
        return {b" ".join(ws)} if ws else set()
    return set(map(b" ".join, zip(*(ws[i:] for i in range(length)))))


def sketch(text: str | None) -> tuple[int, list[int]]:
    """Signed 64-bit digest of the shingle set, and its keys."""
    found = shingles(text)
    if not found:
        return 0, []
    hashes = np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), dtype="<u8", count=len(found)))
    least = np.full(BANDS * BAND, 2**64 - 1, dtype="<u8")
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, (np.multiply.outer(FACTORS, hashes[i : i + BLOCK]) + ADDED[:, None]).min(axis=1), out=least)
    digests = [xxhash.xxh64_intdigest(hashes.tobytes(), SEED)]
    digests += [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, BAND))]
    signed = np.array(digests, dtype="<u8").view("<i8").tolist()
    return signed[0], signed[1:]


def sketches(text: Column) -> Column:
    @F.pandas_udf("fp long, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch(t) for t in texts], columns=["fp", "keys"])

    return of(text)


def similarity(a: str | None, b: str | None) -> float:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def _verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs (x, y) whose texts are similar enough."""
    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(s, t) >= similar for s, t in zip(a, b)], dtype=bool)

    one = texts.select(F.col("fp").alias("x"), F.col("text").alias("text_x"))
    two = texts.select(F.col("fp").alias("y"), F.col("text").alias("text_y"))
    return pairs.join(one, "x").join(two, "y").where(close("text_x", "text_y")).select("x", "y")


def similar_links(keys: DataFrame, texts: DataFrame, similar: float = SIMILAR, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) that connect all similar sets that share a key, from keys (fp, key) held by two sets or more."""
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"))
    few = keys.join(sizes.where(F.col("n") <= limit), "key").groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    listed = few.select(F.explode("fps").alias("x"), "fps").select("x", F.explode("fps").alias("y")).where("x < y").distinct()
    links = components(stored(_verified(listed, texts, similar), "similar"))
    full = keys.join(sizes.where(F.col("n") > limit), "key")
    spread = full.groupBy("fp").agg(F.count("*").alias("spread"))
    full = stored(full.join(spread, "fp"), "full-keys")
    compared, more = 0, 1
    while True:
        rooted = full.join(links.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
        rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
        apart = rooted.where(F.col("n") > compared).groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        open_ = stored(rooted.join(apart.where("low < high").select("key"), "key"), "open-keys")
        if open_.isEmpty():
            return links
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("spread"), F.xxhash64("fp"), "fp"))
        centres = open_.withColumn("place", place).where(F.col("place") <= more).where(F.col("place") > compared)
        centres = centres.select("key", F.col("fp").alias("centre"), F.col("root").alias("centre_root"))
        pairs = open_.join(centres, "key").where("root != centre_root")
        pairs = pairs.select(F.least("fp", "centre").alias("x"), F.greatest("fp", "centre").alias("y")).distinct()
        found = stored(_verified(pairs, texts, similar), "similar")
        links = components(links.unionAll(found.toDF("a", "b")))
        compared, more = more, more * GROWTH


def simhash_keys(marks: DataFrame) -> DataFrame:
    """(fp, key) from (fp, mark): sets share a key whose SimHash fingerprints are equal or linked."""
    distinct = stored(marks.select(F.col("mark").alias("fp")).distinct(), "marks")
    links = fingerprint_links(distinct).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    linked = links.select(F.xxhash64("x", "y").alias("key"), F.explode(F.array("x", "y")).alias("mark"))
    alone = distinct.select(F.xxhash64(F.lit("mark"), "fp").alias("key"), F.col("fp").alias("mark"))
    return marks.join(linked.unionAll(alone), "mark").select("fp", "key").distinct()


def _grouped(docs: DataFrame, similar: float, limit: int) -> tuple[DataFrame, DataFrame]:
    said = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sketches(F.col("text")).alias("s"), fingerprints(F.col("text")).alias("mark"))
    rows = stored(said, "sketches").select("doc_id", "text_hash", "s.fp", "s.keys", "mark")
    one = F.min(F.struct("text_hash", "mark"))  # of the texts of a set
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), one.alias("one"), F.first("keys").alias("keys"))
    distinct = stored(distinct.select("fp", "first", "one.*", "keys"), "sets")
    keys = distinct.select("fp", F.explode("keys").alias("key")).unionAll(simhash_keys(distinct.select("fp", "mark")))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keys = stored(keys.join(shared, "key"), "shared-keys")
    # Only texts that can be part of a pair move.
    asked = distinct.select("fp", "text_hash").join(keys.select("fp").distinct(), "fp", "left_semi")
    said = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    texts = stored(asked.join(said, "text_hash").groupBy("fp").agg(F.min("text").alias("text")), "candidate-texts")
    return rows.select("doc_id", "fp"), grouped_by(similar_links(keys, texts, similar, limit), distinct.select("fp", "first"))


def similar_texts(docs: DataFrame, similar: float = SIMILAR, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (digest of its shingle set), component_id, as ``near_duplicates``."""
    rows, groups = _grouped(docs, similar, limit)
    return rows.join(groups, "fp").select("doc_id", "fp", "component_id")


def drop_similar_texts(docs: DataFrame, similar: float = SIMILAR, limit: int = LIMIT) -> DataFrame:
    """Of every group of similar texts the row with the smallest doc_id, rows without id as in ``drop_near_duplicates``."""
    rows, groups = _grouped(docs, similar, limit)
    return first_rows(docs, rows, groups, sketches(F.col("text"))["fp"])
