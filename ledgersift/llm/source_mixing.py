"""Mixing sources to target weights by blocks.

1. Targets: sources share all words by weight; none gets more than ``MAX_TIMES`` its own words, and what it
   cannot take is shared again among the others (closed form on the table of sources).
2. Packing: documents are dealt to chunks by hash, and the words of a source's chunk are cut into blocks of
   ``BLOCK`` words; only a chunk's last block is shorter.
3. Drawing: the output is shards of ``SHARD`` slots. Every shard draws a multinomial count per source: each
   slot's hashed uniform falls into one source's interval. A source's slots beyond its quota of blocks pass
   to the sources that drew too few, so totals equal the quotas.
4. Blocks: the k-th slot of a source takes block ``p(k mod blocks)``, where p is a pseudorandom permutation of
   the source's block numbers (a Feistel network with cycle walking), another one in each pass.
5. Slots join blocks on (source, block).

Every draw is a function of seed and position, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.cluster import stored

BLOCK = 256
SHARD = 1024
MAX_TIMES = 3
WEIGHTS = (1, 2, 3)  # by rank of the source, repeating
CHUNK_ROWS = 10_000
GRID = 4096  # bins through which a slot finds its interval by an equality join
SEED = 42


def uniform(seed: int, *key: Column) -> Column:
    """In [0, 1), 53 bits, from the hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / F.lit(float(1 << 53))


def permuted(k: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    """Place of k under the key's permutation of 0..n-1: four Feistel rounds on the next even number of bits, repeated until inside."""
    x, n, key = (a.to_numpy(dtype=np.uint64) for a in (k, n, key))
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2)).astype(np.uint64)
    half += (np.uint64(1) << (half * np.uint64(2))) < n  # against rounding of the logarithm
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        v, h, m, s = out[todo], half[todo], mask[todo], key[todo]
        left, right = v >> h, v & m
        for r in range(4):
            z = right + s + np.uint64((0x9E3779B97F4A7C15 * (r + 1)) % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return pd.Series(out.astype(np.int64))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, sid, target) from rows (source, size); the table has one row per source.

    Sources are ranked by code point, null last. With caps c = MAX_TIMES * size, the targets are min(c, w * t)
    for the t at which they add up to all words: sources are sorted by c / w, and those before the first one
    that t does not fill are at their cap.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int"))
    t = by.withColumn("sid", sid).withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(MAX_TIMES)))
    before = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    t = t.select(
        "*", F.sum("source_size").over(everyone).alias("all"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
    )
    # t as it would be with all earlier sources capped; the first source whose cap exceeds w * t fixes it.
    t = t.withColumn("rate", (F.col("all") - F.col("capped")) / F.col("w_left"))
    t = t.withColumn("level", F.min(F.when(F.col("cap") >= F.col("w") * F.col("rate"), F.struct(F.col("cap") / F.col("w"), F.col("sid"), F.col("rate").alias("rate")))).over(everyone)["rate"])
    target = F.least(F.col("cap"), F.col("w") * F.coalesce("level", F.lit(float("inf"))))
    return t.select("source", "source_size", "sid", target.alias("target"))


def _intervals(sources: DataFrame) -> DataFrame:
    """(bin, sid, low, high): where a uniform number falls, one row per bin that an interval touches."""
    order = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("quota") / F.sum("quota").over(Window.partitionBy())
    t = sources.where("quota > 0").select("sid", share.alias("share"))
    t = t.select("sid", F.sum("share").over(order).alias("high"), "share", F.row_number().over(Window.orderBy(F.desc("sid"))).alias("from_end"))
    low, high = F.greatest(F.col("high") - F.col("share"), F.lit(0.0)), F.when(F.col("from_end") == 1, F.lit(2.0)).otherwise(F.col("high"))
    t = t.select("sid", low.alias("low"), high.alias("high"))
    # Neighbouring intervals share an edge up to rounding: an interval starts where the one before ends.
    t = t.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0.0)))
    last = F.least(F.floor(F.col("high") * GRID), F.lit(GRID - 1))
    return t.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") * GRID), F.greatest(last, F.floor(F.col("low") * GRID)))))


def draw_slots(sources: DataFrame, n_slots: int, seed: int = SEED) -> DataFrame:
    """(slot, shard, sid, k): the source of every output slot and its running number within that source.

    ``sources`` holds sid and quota; quotas add up to ``n_slots``.
    """
    spark = sources.sparkSession
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), uniform(seed, F.col("id")).alias("u"))
    slots = slots.withColumn("bin", F.floor(F.col("u") * GRID))
    drawn = slots.join(_intervals(sources), "bin").where("low <= u AND u < high")
    drawn = stored(drawn.select("slot", F.call_function("div", F.col("slot"), F.lit(SHARD)).alias("shard"), "sid"), "drawn")
    shards = drawn.groupBy("sid", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("sid", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("sid", "shard").orderBy("slot")) - 1
    numbered = drawn.withColumn("place", place).join(offsets, ["sid", "shard"]).select("slot", "shard", "sid", (F.col("place") + F.col("offset")).alias("k"))
    # Slots beyond a quota are numbered through and handed to the sources that drew too few, in order of sid.
    counts = sources.join(shards.groupBy("sid").agg(F.sum("n").alias("drawn")), "sid", "left").select("sid", "quota", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    order = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    over, under = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))
    counts = stored(counts.withColumn("over", over).withColumn("under", under).select(
        "*", F.coalesce(F.sum("over").over(order), F.lit(0)).alias("over_from"), F.coalesce(F.sum("under").over(order), F.lit(0)).alias("under_from")
    ), "counts")
    held = numbered.join(counts, "sid").withColumn("j", F.when(F.col("k") >= F.col("quota"), F.col("over_from") + F.col("k") - F.col("quota")))
    takers = counts.where("under > 0").select("sid", "drawn", "under_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)).alias("i"))
    takers = takers.select(F.col("sid").alias("to_sid"), (F.col("drawn") + F.col("i")).alias("to_k"), (F.col("under_from") + F.col("i")).alias("j"))
    stay = held.where("j IS NULL").select("slot", "shard", "sid", "k")
    moved = held.where("j IS NOT NULL").join(takers, "j").select("slot", "shard", F.col("to_sid").alias("sid"), F.col("to_k").alias("k"))
    return stay.unionByName(moved)


def pack(rows: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, blocks per source) of rows (doc_id, source, size, row_key).

    A segment is the part [word_from, word_to) of one document that lies in one block of its source.
    """
    known = rows.join(sources.select(F.col("source").alias("__s"), "sid"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    n_chunks = max(1, -(-rows.count() // CHUNK_ROWS))
    dealt = known.where("size > 0").withColumn("chunk", F.pmod(F.xxhash64(F.lit(SEED), "row_key"), F.lit(n_chunks)))
    upto = Window.partitionBy("sid", "chunk").orderBy("doc_id", "row_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum("size").over(upto)).withColumn("start", F.col("end") - F.col("size"))
    chunks = dealt.groupBy("sid", "chunk").agg(F.ceil(F.sum("size") / F.lit(BLOCK)).alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = stored(chunks.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "chunks")
    low = F.call_function("div", F.col("start"), F.lit(BLOCK))
    high = F.call_function("div", F.col("end") - 1, F.lit(BLOCK))
    cut = placed.select("*", F.explode(F.sequence(low, high)).alias("b"))
    segments = cut.join(chunks.select("sid", "chunk", "first"), ["sid", "chunk"]).select(
        "doc_id", "row_key", "sid", "chunk", "start", (F.col("first") + F.col("b")).alias("block"),
        (F.greatest(F.col("b") * BLOCK, F.col("start")) - F.col("start")).alias("word_from"),
        (F.least((F.col("b") + 1) * BLOCK, F.col("end")) - F.col("start")).alias("word_to"),
    )
    return segments, chunks.groupBy("sid").agg(F.sum("n").alias("blocks"))


def mix(rows: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, slots, segments) of rows (doc_id, source, size, row_key).

    sources: source, source_size, sid, target, blocks, quota. slots: slot, shard, sid, block. segments: as
    ``pack`` gives them. A source without words has target zero and no slot.
    """
    goals = stored(targets(rows), "targets")
    segments, blocks = pack(rows, goals)
    quota = F.least(F.round(F.col("blocks") * F.col("target") / F.col("source_size")), F.col("blocks") * MAX_TIMES)
    goals = goals.join(blocks, "sid", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    goals = stored(goals.withColumn("quota", F.when(F.col("blocks") > 0, quota).otherwise(0).cast("long")), "quotas")
    n_slots = goals.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    permutation = F.pandas_udf(permuted, "long")
    drawn = draw_slots(goals.select("sid", "quota"), n_slots, seed).join(goals.select("sid", "blocks"), "sid")
    passes = F.call_function("div", F.col("k"), F.col("blocks"))
    key = F.abs(F.shiftright(F.xxhash64(F.lit(seed), "sid", passes), 1))
    slots = drawn.select("slot", "shard", "sid", permutation(F.col("k") % F.col("blocks"), F.col("blocks"), key).alias("block"))
    return goals, slots, segments


def sized(docs: DataFrame, *carried: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("row_key"), *carried)


def mixed_words(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    A null text has size zero; a null source is a source of its own, ranked last. Rows of one doc_id and text
    are told apart by their place in their source only, and share out what falls to them. A null doc_id is
    ordered first. Other columns are ignored; an empty table gives an empty result.
    """
    rows = stored(sized(docs), "sizes")
    goals, slots, segments = mix(rows, seed)
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    parts = segments.join(times, ["sid", "block"])
    place = ["sid", "doc_id", "row_key"]
    # Equal rows lie next to each other; what is taken of them is shared out evenly, the rest from the first on.
    taken = parts.groupBy(*place).agg(F.sum((F.col("word_to") - F.col("word_from")) * F.col("times")).alias("sum_taken"))
    known = rows.join(goals.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    counts = known.groupBy(*place).agg(F.count("*").alias("copies"))
    met = counts.join(taken, (counts["sid"] == taken["sid"]) & counts["doc_id"].eqNullSafe(taken["doc_id"]) & (counts["row_key"] == taken["row_key"]), "left").select(
        *[counts[c].alias(f"__{c}") for c in place], "copies", F.coalesce("sum_taken", F.lit(0)).alias("sum_taken"))
    copy = F.row_number().over(Window.partitionBy(*place).orderBy("size")) - 1
    joined = known.withColumn("__copy", copy).join(met, (F.col("sid") == F.col("__sid")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("row_key") == F.col("__row_key")))
    share = F.call_function("div", F.col("sum_taken"), F.col("copies")) + F.when(F.col("__copy") < F.col("sum_taken") % F.col("copies"), 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", share.cast("long").alias("taken"))


def _cut(texts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
    """Pieces of each text from word to word, spacing kept inside a piece."""
    import re

    word = re.compile("[^\x20\x09-\x0d]+")
    out = []
    for text, low, high in zip(texts, lows, highs):
        spans = [m.span() for m in word.finditer(text)]
        out.append([text[spans[a][0] : spans[b - 1][1]] for a, b in zip(low, high)])
    return pd.Series(out)


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as rows of documents: a row per segment of a block and per slot that takes it, text cut to it.

    All columns of ``docs`` stay; n_chars, where present, becomes the length of the piece. Documents without
    words, or that no slot takes, have no row.
    """
    names = docs.columns
    rows = stored(sized(docs), "sizes")
    _, slots, segments = mix(rows, seed)
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    # Equal rows differ in their place, so they are one list of segments each; the list goes to one of them.
    lists = segments.join(times, ["sid", "block"]).groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_list(F.struct("word_from", "word_to", F.col("times").cast("int").alias("times")))).alias("__parts"))
    lists = lists.withColumnsRenamed({"doc_id": "__id", "row_key": "__key"})
    base = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64("text").alias("__row_key")).dropDuplicates(["doc_id", "__row_key"])
    met = base.join(lists, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row_key") == F.col("__key")))
    cut = F.pandas_udf(_cut, "array<string>")
    pieces = cut("text", F.transform("__parts", lambda p: p["word_from"]), F.transform("__parts", lambda p: p["word_to"]))
    repeated = F.flatten(F.zip_with(pieces, "__parts", lambda t, p: F.array_repeat(t, p["times"])))
    out = met.withColumn("__piece", F.explode(repeated))
    chosen = {"text": F.col("__piece"), "n_chars": F.length("__piece").cast("long")}
    return out.select(*[(chosen[c].cast(docs.schema[c].dataType) if c in chosen else F.col(f"`{c}`")).alias(c) for c in names])


def source_mixing(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed_words(docs).select("doc_id", "size", "source_size", "target", "taken")
