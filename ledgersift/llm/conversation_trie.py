"""Prefix trie of conversations from padded matrices of turn ids.

A turn is known by 128 bits of its role and text, a conversation by the array of its turns' ids, so texts never
move. The arrays are dealt to range shards of their lexicographic order (ties by conversation id). A shard sorts
its rows with ``numpy.lexsort`` over padded id matrices of ``WIDTH`` columns; only rows that are still tied go on
to the next columns, so one long conversation pads nothing else. The OR-accumulated change masks of neighbouring
rows say how many leading turns they share, hence where nodes start at every depth.

With that number known for every row, all figures of a node are sums over its run of rows, one ``reduceat`` a
depth: a child starts where the shared length equals the depth, a leaf ends where the next row shares less than
the row's length, and saved tokens add up the shared parts. A node is cut only by a shard's edge. How much the
edges share is worked out first (one row a shard), which names the shard a cut node starts in; its pieces meet
under (depth, that shard) and are added. Lists of ended conversations meet as sorted streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.cluster import bounded, stored

TURNS = 400_000  # turns of a shard, about
WIDTH = 16  # columns of one padded matrix
EVERY, HEADS = 100, 6  # conversations begin with up to HEADS - 1 turns of the last one divisible by EVERY
NONE = hashlib.sha256(b"").hexdigest()
NODE = (
    "conv_id long, depth long, parent_conv_id long, origin long, parent_origin long, shard long, n_convs long, "
    "n_children long, n_leaves long, shared long, above long, ends string"
)


def turn_arrays(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the ids and code points of a conversation's turns, by turn (null first), ties by id."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text))))
    turn = F.struct("turn", name.alias("id"), F.length(text).cast("long").alias("n"))
    own = rows.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return own.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["n"].alias("n"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, turns) with the first turns taken from the conversation that shares the hundred."""
    heads = own.where(F.col("conv_id") % EVERY == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    keyed = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return keyed.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _shared(a: Column, b: Column) -> Column:
    """Number of leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(n).cast("long")


def _edges(shards: DataFrame) -> tuple[dict, np.ndarray, np.ndarray]:
    """Number of every shard that has rows; what its first row shares with the row before it (-1: none is), and
    what the nodes that reach from there through the whole shard share."""
    row = F.struct("ids", "conv_id")
    ends = shards.groupBy("shard").agg(F.min(row)["ids"].alias("first"), F.max(row)["ids"].alias("last"))
    # One row a shard.
    before = ends.withColumn("before", F.lag("last").over(Window.orderBy("shard")))
    none = F.col("before").isNull()
    over = F.when(none, F.lit(-1).cast("long")).otherwise(_shared(F.col("before"), F.col("first")))
    found = before.select("shard", over.alias("n"), F.least(over, _shared(F.col("first"), F.col("last"))).alias("through"))
    found = sorted(tuple(r) for r in found.collect())
    numbers = {s: i for i, (s, _, _) in enumerate(found)}
    return numbers, *(np.array([r[k] for r in found], dtype=np.int64) for k in (1, 2))


def _codes(ids: pa.Array) -> np.ndarray:
    """Ranks of 16-byte ids among those of the shard."""
    if not len(ids):
        return np.zeros(0, np.int64)
    ids = ids.cast(pa.binary(16))
    pairs = np.frombuffer(ids.buffers()[1], ">u8", 2 * len(ids), 16 * ids.offset).reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (pairs[order[1:]] != pairs[order[:-1]]).any(axis=1)
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(new) - 1
    return codes


def _padded(codes, starts, lens, at) -> np.ndarray:
    """Columns at .. at + WIDTH of some rows, -1 where a row has ended."""
    column = at + np.arange(WIDTH)
    there = column < lens[:, None]
    cells = np.full(there.shape, -1, np.int64)
    cells[there] = codes[(starts[:, None] + column)[there]]
    return cells


def sorted_rows(codes, starts, lens, conv) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order of the rows, ties by conv, and how much each shares with the one before (0 for the first)."""
    order = np.argsort(conv, kind="stable")
    run = np.zeros(len(order), np.int64)  # where the run of tied rows begins
    shared = np.zeros(len(order), np.int64)
    tied, at = np.arange(len(order)), 0
    while len(tied):
        rows = order[tied]
        cells = _padded(codes, starts[rows], lens[rows], at)
        by = np.lexsort((*cells.T[::-1], run[tied]))
        order[tied], cells = rows[by], cells[by]
        together = run[tied][1:] == run[tied][:-1]
        changed = np.logical_or.accumulate(cells[1:] != cells[:-1], axis=1)
        shared[tied[1:][together]] = at + (~changed[together]).sum(axis=1)
        first = np.flatnonzero(np.concatenate([[True], ~together | changed[:, -1]]))
        sizes = np.diff(np.append(first, len(tied)))
        run[tied] = np.repeat(tied[first], sizes)
        tied = tied[np.repeat((sizes > 1) & (cells[first, -1] >= 0), sizes)]
        at += WIDTH
    length = lens[order]
    shared[1:] = np.minimum(shared[1:], np.minimum(length[1:], length[:-1]))
    return order, shared


def shard_nodes(table: pa.Table, own: int, before: np.ndarray, through: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes a shard holds, by depth; ``own``, ``before`` and ``through`` as of ``_edges``."""
    lists = table["ids"].combine_chunks()
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    conv = table["conv_id"].to_numpy()
    starts = np.cumsum(lens) - lens
    order, shared = sorted_rows(_codes(lists.flatten()), starts, lens, conv)
    texts = np.concatenate([[0], np.cumsum(table["ns"].combine_chunks().flatten().to_numpy(zero_copy_only=False))]).astype(np.int64)
    starts, lens, conv = starts[order], lens[order], conv[order]
    after = before[own + 1] if own + 1 < len(before) else -1
    shared[0] = before[own]
    leaf = (np.append(shared[1:], after) < lens).astype(np.int64)
    saved = texts[starts + np.maximum(shared, 0)] - texts[starts]
    lowest = -np.minimum.accumulate(through[:own][::-1])
    names = conv.astype(str)
    last_row = len(conv) - 1
    rows, depth, above = np.arange(len(conv)), 0, None
    while len(rows):
        same, length = shared[rows], lens[rows]
        new = same < depth
        new[0] = True
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(rows)))
        first = rows[at]
        least = np.minimum.reduceat(conv[rows], at)
        carried = (first == 0) & (shared[0] >= depth)
        cut = carried | ((rows[at + n - 1] == last_row) & (after >= depth))
        start = own - 1 - np.searchsorted(lowest, -depth, side="right")
        origin = np.where(carried, start, own)
        ended = np.add.reduceat((length == depth).astype(np.int64), at)
        ends = [",".join(names[f : f + e]) if e else None for f, e in zip(first.tolist(), ended.tolist())]
        whole = [e if c else hashlib.sha256((e or "").encode()).hexdigest() for e, c in zip(ends, cut)]
        if above is None:
            parent = parent_origin = pa.nulls(len(at), pa.int64())
        else:
            held = np.searchsorted(above[0], first, side="right") - 1
            parent = pa.array(above[1][held])
            parent_origin = pa.array(above[2][held], mask=~above[3][held])
        top = texts[starts[first] + max(depth - 1, 0)] - texts[starts[first]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(least), pa.array(np.full(len(at), depth)), parent, pa.array(origin, mask=~cut), parent_origin,
                pa.array(np.full(len(at), own)), pa.array(n),
                pa.array(np.add.reduceat(((length > depth) & (same <= depth)).astype(np.int64), at)),
                pa.array(np.add.reduceat(leaf[rows], at)),
                pa.array(np.add.reduceat(np.where(same >= depth, saved[rows], 0), at)),
                pa.array(top), pa.array(whole, pa.string()),
            ],
            names=[f.split()[0] for f in NODE.split(", ")],
        )
        above = (first, least, origin, cut)
        depth += 1
        rows = rows[length >= depth]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of lists that arrive in pieces, node by node."""
    key, digest, done = None, None, []

    def out():
        depths, origins, found = zip(*done)
        return pa.RecordBatch.from_arrays(
            [pa.array(depths, pa.int64()), pa.array(origins, pa.int64()), pa.array(found)], names=["depth", "origin", "ends_sha256"]
        )

    for batch in batches:
        for depth, origin, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "origin", "ends"))):
            if key != (depth, origin):
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (depth, origin), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
        if len(done) > 10_000:
            yield out()
            done = []
    if key is not None:
        done.append((*key, digest.hexdigest()))
        yield out()


def prefix_trie(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """One row per distinct prefix of ``conversations`` (conv_id, turns: array<struct<id binary(16), n long>>).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. conv_id must be unique and not null; a conversation without turns is a member of
    the root alone; equal conversations end at one node; an empty table gives no node, not even a root.

    A conversation is one row of 24 bytes a turn, and a shard holds about ``turns`` turns. The list of equal
    conversations of a node is digested as a stream.
    """
    spark = conversations.sparkSession
    arrays = conversations.select(
        "conv_id", F.col("turns.id").alias("ids"), F.col("turns.n").alias("ns"),
    )
    arrays = stored(arrays, "turn-arrays")
    n = arrays.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    parts = max(-(-n // turns), spark.sparkContext.defaultParallelism)
    dealt = arrays.repartitionByRange(parts, "ids", "conv_id").withColumn("shard", F.spark_partition_id())
    shards = stored(dealt, "trie-shards")
    held = spark.sparkContext.broadcast(_edges(shards))  # three numbers a shard

    def nodes_of(table: pa.Table) -> pa.Table:
        numbers, before, through = held.value
        return pa.Table.from_batches(list(shard_nodes(table, numbers[table["shard"][0].as_py()], before, through)))

    # A given number of partitions is not coalesced: the rows are few bytes, but sorting them is work.
    nodes = stored(shards.repartition(parts, "shard").groupBy("shard").applyInArrow(nodes_of, NODE), "trie-nodes")
    cut = nodes.where("origin IS NOT NULL")
    pieces = cut.where("ends IS NOT NULL").select("depth", "origin", "shard", "ends")
    pieces = pieces.repartition("depth", "origin").sortWithinPartitions("depth", "origin", "shard")
    digests = pieces.mapInArrow(_ends, "depth long, origin long, ends_sha256 string")
    merged = cut.groupBy("depth", "origin").agg(
        F.min("conv_id").alias("conv_id"), F.min("parent_origin").alias("parent_origin"), F.min("above").alias("above"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "shared")],
    ).join(digests, ["depth", "origin"], "left")
    merged = stored(merged.withColumn("ends", F.coalesce("ends_sha256", F.lit(NONE))), "cut-nodes")
    # Few beside the nodes (those on the shards' edges), and sent only after their number was checked.
    parents = bounded(merged.select((F.col("depth") + 1).alias("depth"), F.col("origin").alias("parent_origin"), F.col("conv_id").alias("parent")))[0]
    columns = ["conv_id", "depth", "parent_conv_id", "parent_origin", "n_convs", "n_children", "n_leaves", "shared", "above", "ends"]
    every = nodes.where("origin IS NULL").select(*columns).unionByName(
        merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns)
    )
    return every.join(parents, ["depth", "parent_origin"], "left").select(
        "conv_id", "depth", F.coalesce("parent", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("shared") - (F.col("n_convs") - 1) * F.col("above")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def conversation_trie(spark, sf_dir: str) -> DataFrame:
    """Registered query: all conversations, rebuilt on shared beginnings.

    Null roles and texts are empty, null turns come first, equal turns of a conversation go by their id. Rows
    without a conv_id belong to no conversation; repeated rows are repeated turns; other columns are ignored.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(stored(turn_arrays(rows), "own-turns")))


TRIE_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
), own AS (
  SELECT conv_id, list(struct_pack(role := r, text := x) ORDER BY turn ASC NULLS FIRST, md5(concat(length(r), ':', r, x))) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id
), keyed AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM own, crc_table
), built AS (
  SELECT k.conv_id, list_concat(coalesce(b.turns, [])[1:k.h], k.turns[k.h + 1:]) AS turns
  FROM keyed k LEFT JOIN own b ON b.conv_id = k.base
), prefixes AS (
  SELECT conv_id, len(turns) AS n, d, turns[1:d] AS path FROM built, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)
), nodes AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends
  FROM prefixes GROUP BY d, path
), linked AS (
  SELECT c.*, p.conv_id AS parent_conv_id, CASE WHEN c.d > 0 THEN (c.n_convs - 1) * length(c.path[c.d].text) ELSE 0 END AS own_saved,
    (SELECT count(*) FROM nodes k WHERE k.d = c.d + 1 AND k.path[1:c.d] = c.path) AS n_children
  FROM nodes c LEFT JOIN nodes p ON p.d = c.d - 1 AND p.path = c.path[1:c.d - 1]
), climbed AS (
  SELECT a AS d, path[1:a] AS path, sum(own_saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM linked, LATERAL (SELECT unnest(range(0, d + 1)) AS a) GROUP BY 1, 2
)
SELECT l.conv_id, l.d::BIGINT AS depth, l.parent_conv_id, l.n_convs::BIGINT AS n_convs, l.n_children::BIGINT AS n_children,
  c.leaves::BIGINT AS n_leaves, c.saved::BIGINT AS saved_tokens, sha256(l.ends) AS ends_sha256
FROM linked l JOIN climbed c ON c.d = l.d AND c.path = l.path
"""
