"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most two bits have a
segment in which they differ in at most one, so they meet under one of these keys: a segment as it is, or a
segment with one bit wildcarded (32 variants each, 66 keys in all). Keys meet by equality, pairs are verified
on all 64 bits.

Copies collapse first: the search runs over distinct fingerprints. A key held by up to ``LIMIT`` of them gives
its verified pairs. A fuller key gives no pairs: its members are filed again under the same key plus the
other segment with one bit (a wildcarded key) or two bits (a whole segment) removed. Whatever meets there
differs in two bits at most, at most four fingerprints can, and no pair is lost, so groups of any size cost
in proportion to their members.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.cluster import stored

from .graph import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
LIMIT = 64  # pairs are listed up to this many fingerprints under a key; fuller keys are filed finer
SENT_KEYS = 1_000_000  # keys (16 bytes each) up to which a broadcast replaces a shuffle of all keys
HALF = 32
LOW = 0xFFFFFFFF


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is in over half of the shingle hashes."""
    # bytes.lower and bytes.split know ASCII letters and the six ASCII space characters only.
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    if len(ws) < SHINGLE:
        shingles = [b" ".join(ws)]
    else:
        shingles = map(b" ".join, zip(*(ws[i:] for i in range(SHINGLE))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<i8")[0])


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return of(text)


def _keys(distinct: DataFrame) -> DataFrame:
    """(fp, key): number of the key in the upper half of a long, kept bits of the segment in the lower."""
    numbered = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * HALF + 1))).alias("i"))
    second = F.expr("i >= 64 AND i = 65 OR i < 64 AND i >= 32")
    segment = F.when(second, F.shiftrightunsigned("fp", HALF)).otherwise(F.col("fp").bitwiseAND(LOW))
    wild = F.when(F.col("i") < 2 * HALF, F.expr("shiftleft(1L, i % 32)")).otherwise(F.lit(0).cast("long"))
    kept = segment.bitwiseAND(F.bitwise_not(wild))
    return numbered.select("fp", F.shiftleft(F.col("i").cast("long"), HALF).bitwiseOR(kept).alias("key"))


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def _finer(members: DataFrame) -> DataFrame:
    """Links among members of overfull keys."""
    number = F.shiftright("key", HALF)
    first = (number == 2 * HALF) | (number < HALF)
    other = F.when(first, F.shiftrightunsigned("fp", HALF)).otherwise(F.col("fp").bitwiseAND(LOW))
    one = F.array(*[F.lit(1 << p) for p in range(HALF)])
    two = F.array(*[F.lit((1 << p) | (1 << q)) for p in range(HALF) for q in range(p)])
    spread = members.select("fp", "key", other.alias("other"), F.explode(F.when(number < 2 * HALF, one).otherwise(two)).alias("gone"))
    met = spread.groupBy("key", "gone", F.col("other").bitwiseAND(F.bitwise_not("gone")).alias("rest")).agg(
        F.collect_set("fp").alias("fps")  # four at most
    )
    return met.where(F.size("fps") > 1).select(F.array_min("fps").alias("x"), F.explode("fps").alias("y")).where("x != y")


def fingerprint_links(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (x, y) that connect all of ``distinct`` (column fp, no repetitions) that differ in two bits or fewer.

    Every link holds; of an overfull key only those are listed that connect its members.
    """
    keys = _keys(distinct)
    shared = stored(
        keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y")).where("n > 1"),
        "shared-keys",
    )
    two = shared.where("n = 2").select("x", "y")
    fuller = shared.where("n > 2").select("key", "n")
    # A counted number of keys is sent to the fingerprints; more keys meet them in a shuffle.
    fuller = F.broadcast(fuller) if fuller.count() <= SENT_KEYS else fuller
    members = keys.join(fuller, "key")
    lists = members.where(F.col("n") <= limit).groupBy("key").agg(F.collect_list("fp").alias("fps"))  # limit at most
    # Under a wildcarded key only pairs that differ in the removed bit are new.
    number = F.shiftright("key", HALF)
    pairs = lists.select("fps", number.cast("int").alias("i")).select(
        F.explode(
            F.flatten(
                F.transform(
                    "fps",
                    lambda a: F.transform(
                        F.filter("fps", lambda b: (a < b) & _close(a, b) & ((F.col("i") >= 2 * HALF) | (F.call_function("getbit", a.bitwiseXOR(b), F.least("i", F.lit(63))) == 1))),
                        lambda b: F.struct(a.alias("x"), b.alias("y")),
                    ),
                )
            )
        ).alias("p")
    ).select("p.x", "p.y")
    full = members.where(F.col("n") > limit).select("fp", "key")
    return two.unionAll(pairs).where(_close(F.col("x"), F.col("y"))).unionAll(_finer(full))


def fingerprint_groups(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(fp, root, component_id) for every distinct fp of ``rows`` (doc_id, fp): a fingerprint that stands for the
    group, and the smallest doc_id reachable by links."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    return grouped_by(components(fingerprint_links(distinct.select("fp"), limit)), distinct)


def grouped_by(found: DataFrame, distinct: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every row of ``distinct`` (fp, first), from components (a, b)."""
    roots = found.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def _grouped(docs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    rows = stored(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), "doc-fingerprints")
    return rows, fingerprint_groups(rows, limit)


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id.

    Words and shingles follow the module's rules over whole texts; null, empty and blank texts have fingerprint
    zero and link like any other. Rows with a null doc_id are answered but never name a component (null if all
    its rows are such). Repeated rows are answered each; other columns are ignored; an empty table gives an
    empty result.
    """
    rows, groups = _grouped(docs, limit)
    return rows.join(groups, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Of every group of near-duplicates the row with the smallest doc_id, all columns as they are.

    Of rows that repeat that id one stays. A group without any id keeps one of its rows.
    """
    rows, groups = _grouped(docs, limit)
    return first_rows(docs, rows, groups, fingerprints(F.col("text")))


def first_rows(docs: DataFrame, rows: DataFrame, groups: DataFrame, own: Column) -> DataFrame:
    """One row of ``docs`` per group; ``own`` is the fp of a row."""
    groups = stored(groups, "groups")
    chosen = rows.join(groups, "fp").where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    named = docs.join(chosen, docs["doc_id"] == chosen["__id"]).drop("__id").dropDuplicates(["doc_id"])
    unnamed = groups.where("component_id IS NULL").select(F.col("fp").alias("__fp"), F.col("root").alias("__root"))
    rest = docs.where("doc_id IS NULL").withColumn("__own", own)
    rest = rest.join(unnamed, F.col("__own") == F.col("__fp")).dropDuplicates(["__root"]).drop("__own", "__fp", "__root")
    return named.unionByName(rest)


def simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
