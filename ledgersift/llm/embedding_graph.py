"""Embedding near-duplicates over a robust-pruned flat graph (after DiskANN, Subramanya et al. 2019).

1. Equal vectors collapse to one node. Nodes are dealt to cluster shards by nearest pivot, each to its two
   nearest (overlap); shards that are still large are split by pivots of their own, and what no pivot can
   split (a dense group) by hash.
2. Every shard builds a graph: nearest candidates, robust pruning, reverse links, and links that make all of
   it reachable from its medoid. A node's adjacency lists from its shards are united.
3. Every node searches its shards: best-first from the medoid with a beam, then the range is expanded: the
   neighbours of every hit are looked at until no further hit appears. Hits that also live in other shards
   send the search there. Every hit is a cosine at or above the bound, in double precision.
4. The audit compares a bounded number of queries with all vectors; below ``RECALL`` the search is repeated
   with a wider beam.

A search task returns counts and a spanning forest of the links it found, never the pairs: a dense group of n
vectors gives n rows. A link is counted in the shard where its other end is at home, so overlap counts nothing
twice. Queries of a shard are cut into chunks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.cluster import stored

from .graph import components

COSINE = 0.9
TARGET = 600  # nodes per shard aimed at
MAX_SHARD = 2_000  # nodes in one build or search task
MAX_PIVOTS = 1_000  # per split; bounds what travels to a task
CHUNK = 20_000  # rows assigned to pivots in one task
QUERIES = 4_000  # queries in one search task
PAIRS = 1 << 19  # (query, node) pairs that a task follows at once; bounds its hits
LOOKED = 1 << 21  # vector components compared at once
LEVELS = 6
CANDIDATES, DEGREE, ALPHA = 40, 16, 1.2
BEAMS = (16, 64, 256)
RECALL = 0.95
AUDITED = 256


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): double vectors of length one, null where a vector links with nothing."""
    e = F.col("embedding").cast("array<double>")
    top = F.array_max(F.transform(e, F.abs))
    # array_max skips nulls and ranks NaN highest, so bad components show in the checks.
    valid = ~F.exists(e, lambda x: x.isNull()) & (top > 0) & (top < float("inf")) & F.col("vec_id").isNotNull()
    scaled = F.transform(e, lambda x: x / top)
    rows = vectors.select("vec_id", F.when(F.coalesce(valid, F.lit(False)), scaled).alias("s"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)))
    return rows.select("vec_id", F.transform("s", lambda x: x / F.col("norm")).alias("vec"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.empty((0, 0))


def _split(rows: DataFrame, sizes: DataFrame, copies: int, level: int) -> DataFrame:
    """rows (cell, node, vec, home) of cells in ``sizes`` (cell, n), dealt to their cell's ``copies`` nearest pivots."""
    sized = rows.join(sizes, "cell")
    wanted = F.least(F.lit(float(MAX_PIVOTS)), F.ceil(F.col("n") / F.lit(TARGET)).cast("double"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(level), "node"), 11) / F.lit(float(1 << 53))
    salts = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
    pivots = sized.where(draw * F.col("n") < wanted + 3 * F.sqrt(wanted) + 3).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), salts - 1))
    ).select(*[F.col(c).alias(c) for c in ("cell", "salt", "node", "vec")])
    dealt = sized.select("cell", F.pmod(F.xxhash64(F.lit("salt"), "node"), salts).cast("int").alias("salt"), "node", "vec", "home")

    def assign(points: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if not len(points):
            return pd.DataFrame({"cell": [], "node": [], "vec": [], "home": []})
        at = at.sort_values("node")
        x, p, names = _matrix(points["vec"]), _matrix(at["vec"]), at["node"].to_numpy()
        k = min(copies, len(names))
        nearest = [np.argsort(-(x[i : i + 4096] @ p.T), axis=1, kind="stable")[:, :k] for i in range(0, len(x), 4096)]
        nearest = np.concatenate(nearest)
        parts = []
        for c in range(k):
            cells = points["cell"] + "/" + pd.Series(names[nearest[:, c]], index=points.index).astype(str)
            parts.append(pd.DataFrame({"cell": cells, "node": points["node"], "vec": points["vec"], "home": points["home"] & (c == 0)}))
        return pd.concat(parts)

    schema = "cell string, node long, vec array<double>, home boolean"
    return dealt.groupBy("cell", "salt").cogroup(pivots.groupBy("cell", "salt")).applyInPandas(assign, schema)


def shards(nodes: DataFrame) -> DataFrame:
    """(cell, part, node, vec, home): every node in its shards, one of which is its home."""
    rows = nodes.select(F.lit("").alias("cell"), "node", "vec", F.lit(True).alias("home"))
    done = None
    for level in range(LEVELS):
        sizes = stored(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > MAX_SHARD), "cells")
        if sizes.isEmpty():
            break
        small = rows.join(sizes, "cell", "left_anti")
        rows = stored(_split(rows, sizes, 2 if level == 0 else 1, level).unionByName(small), "shards")
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(MAX_SHARD)).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts")).cast("int")
    return rows.join(sizes, "cell").select("cell", part.alias("part"), "parts", "node", "vec", "home")


def build_graph(x: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Adjacency lists and medoid of one shard."""
    n = len(x)
    sims = x @ x.T
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    np.fill_diagonal(sims, -np.inf)
    c = min(CANDIDATES, n - 1)
    if c < 1:
        return [np.empty(0, np.int64)], medoid
    near = np.argpartition(-sims, c - 1, axis=1)[:, :c]
    rows = np.arange(n)[:, None]
    near = np.take_along_axis(near, np.argsort(-sims[rows, near], axis=1, kind="stable"), 1)
    dist = 1 - sims[rows, near]
    alive = np.ones_like(near, bool)
    picked = [[] for _ in range(n)]
    for _ in range(DEGREE):
        live = np.flatnonzero(alive.any(axis=1))
        if not len(live):
            break
        first = alive[live].argmax(axis=1)
        chosen = near[live, first]
        for i, j in zip(live.tolist(), chosen.tolist()):
            picked[i].append(j)
        alive[live, first] = False
        between = 1 - sims[chosen[:, None], near[live]]  # a candidate's own entry is infinite and stays dead
        alive[live] &= ALPHA * between > dist[live]
    links = {(i, j) for i, js in enumerate(picked) for j in js}
    links |= {(j, i) for i, j in links}
    lists = [[] for _ in range(n)]
    for i, j in sorted(links):
        lists[i].append(j)
    # Whatever the medoid does not reach is linked from its nearest reached node.
    reached = np.zeros(n, bool)
    stack = [medoid]
    reached[medoid] = True
    while True:
        while stack:
            i = stack.pop()
            for j in lists[i]:
                if not reached[j]:
                    reached[j] = True
                    stack.append(j)
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return [np.array(v, np.int64) for v in lists], medoid
        known = np.flatnonzero(reached)
        s = sims[np.ix_(lost, known)]
        at = int(np.argmax(s.max(axis=1)))
        i, j = int(known[s[at].argmax()]), int(lost[at])
        lists[i].append(j)
        lists[j].append(i)
        reached[j] = True
        stack = [j]


def range_search(x: np.ndarray, lists: np.ndarray, medoid: int, q: np.ndarray, beam: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) index pairs at or above ``bound``; ``lists`` is padded with -1."""
    m, n = len(q), len(x)
    seen = np.zeros(m * n, bool)
    hits_q, hits_x = [], []

    step = max(1, LOOKED // max(1, x.shape[1]))

    def look(at_q, at_x):
        parts = [slice(i, i + step) for i in range(0, len(at_q), step)]
        s = np.concatenate([np.einsum("ij,ij->i", q[at_q[p]], x[at_x[p]]) for p in parts] or [np.zeros(0)])
        good = s >= bound
        hits_q.append(at_q[good])
        hits_x.append(at_x[good])
        return s

    every = np.arange(m)
    ids, sim = np.full((m, beam), -1), np.full((m, beam), -np.inf)
    done = np.ones((m, beam), bool)
    start = np.full(m, medoid)
    seen[every * n + start] = True
    ids[:, 0], sim[:, 0], done[:, 0] = medoid, look(every, start), False
    while True:
        best = np.where(done, -np.inf, sim)
        j = best.argmax(axis=1)
        live = np.flatnonzero(best[every, j] > -np.inf)
        if not len(live):
            break
        nodes = ids[live, j[live]]
        done[live, j[live]] = True
        nb = lists[nodes]
        fresh = nb >= 0
        fresh &= ~seen[live[:, None] * n + np.maximum(nb, 0)]
        r, c = np.nonzero(fresh)
        found = nb[r, c]
        seen[live[r] * n + found] = True
        new = np.full(nb.shape, -np.inf)
        new[r, c] = look(live[r], found)
        all_sim = np.concatenate([sim[live], new], axis=1)
        all_ids = np.concatenate([ids[live], nb], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        ids[live], sim[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sim, top, 1)
        done[live] = np.take_along_axis(all_done, top, 1) | (sim[live] == -np.inf)
    expanded = 0
    while expanded < len(hits_q):
        at_q, at_x = hits_q[expanded], hits_x[expanded]
        expanded += 1
        for i in range(0, len(at_q), 50_000):
            nb = lists[at_x[i : i + 50_000]]
            flat = (at_q[i : i + 50_000, None] * n + nb)[nb >= 0]
            flat = np.unique(flat[~seen[flat]])
            if len(flat):
                seen[flat] = True
                look(flat // n, flat % n)
    return np.concatenate(hits_q), np.concatenate(hits_x)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and representative for every node of the links that is not its own: connects what the links connect."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(names))
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            break
        root = low
    other = root != np.arange(len(names))
    return names[other], names[root[other]]


def _adjacency(members: DataFrame) -> DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        names = pdf["node"].to_numpy()
        lists, _ = build_graph(_matrix(pdf["vec"]))
        return pd.DataFrame({"node": names, "near": [names[v] for v in lists]})

    built = members.select("cell", "part", "node", "vec").groupBy("cell", "part").applyInPandas(build, "node long, near array<bigint>")
    return built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # two lists at most


def _searched(members: DataFrame, visits: DataFrame, beam: int, bound: float) -> DataFrame:
    """Per visit (cell, part, node, vec, cells) counts; the forest of found links; further cells to visit."""

    def search(table: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"kind": [], "a": [], "b": [], "cell": []})
        if not len(table) or not len(asked):
            return empty
        table = table.sort_values("node").reset_index(drop=True)
        names, x = table["node"].to_numpy(), _matrix(table["vec"])
        where = {v: i for i, v in enumerate(names.tolist())}
        inside = [[where[v] for v in near if v in where] for near in table["near"]]
        lists = np.full((len(names), max(1, max(map(len, inside)))), -1)
        for i, v in enumerate(inside):
            lists[i, : len(v)] = v
        medoid = int(np.argmax(x @ x.mean(axis=0)))
        asked_names = asked["node"].to_numpy()
        queries = _matrix(asked["vec"])
        weight = np.where(table["home"].to_numpy(), table["copies"].to_numpy(), 0)
        counts, forests = np.zeros(len(asked), np.int64), []
        # Cells of hits that the query is not dealt to; hits are grouped by their cells, of which there are few sets.
        own = asked["cells"].map(frozenset).to_list()
        kinds, kind_of = np.unique([" ".join(sorted(v)) for v in table["cells"]], return_inverse=True)
        more = set()
        # Some queries at a time: of a dense shard's hits only counts and a forest stay.
        step = max(1, PAIRS // len(names))
        for at in range(0, len(asked), step):
            hq, hx = range_search(x, lists, medoid, queries[at : at + step], beam, bound)
            hq = hq + at
            other = asked_names[hq] != names[hx]
            hq, hx = hq[other], hx[other]
            counts += np.bincount(hq, weights=weight[hx], minlength=len(asked)).astype(np.int64)
            forests.append(_forest(asked_names[hq], names[hx]))
            for q, k in np.unique(np.stack([hq, kind_of[hx]], 1), axis=0).tolist() if len(hq) else []:
                more |= {(int(asked_names[q]), c) for c in kinds[k].split(" ") if c not in own[q]}
        child, root = _forest(*(np.concatenate(part) for part in zip(*forests)))
        out = [
            pd.DataFrame({"kind": 0, "a": asked_names, "b": counts, "cell": ""}),
            pd.DataFrame({"kind": 1, "a": child, "b": root, "cell": ""}),
            pd.DataFrame({"kind": 2, "a": [a for a, _ in more], "b": 0, "cell": [c for _, c in more]}),
        ]
        return pd.concat([o for o in out if len(o)])

    chunks = visits.groupBy("cell", "part").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("chunks"))
    asked = visits.join(chunks, ["cell", "part"]).withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("chunks")).cast("int"))
    held = members.join(chunks, ["cell", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["cell", "part", "chunk"]
    left = held.select(*keys, "node", "vec", "home", "copies", "near", "cells").groupBy(*keys)
    # New names: both sides come from the same table.
    right = asked.select(*[F.col(c).alias(f"q_{c}") for c in keys], *[F.col(c).alias(c) for c in ("node", "vec", "cells")])
    right = right.groupBy(*[f"q_{c}" for c in keys])
    return left.cogroup(right).applyInPandas(search, "kind int, a long, b long, cell string")


def linked_nodes(nodes: DataFrame, beam: int, bound: float, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n) rows linked with each node, and links (a, b) that connect the same nodes as all found ones."""
    parts = members.select("cell", "parts").distinct()
    visits = members.select("cell", "node", "vec", "cells").join(parts, "cell")
    found, asked = None, members.select("node", "cell")
    while True:
        step = visits.withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
        got = stored(_searched(members, step, beam, bound), "search")
        found = got if found is None else found.unionByName(got)
        more = got.where("kind = 2").select(F.col("a").alias("node"), "cell").distinct().join(asked, ["node", "cell"], "left_anti")
        more = stored(more, "visits")
        if more.isEmpty():
            break
        asked = asked.unionByName(more)
        who = members.where("home").select("node", "vec", "cells")
        visits = more.join(who, "node").join(parts, "cell")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))
    return counts, found.where("kind = 1").select("a", "b")


def audit(nodes: DataFrame, counts: DataFrame, bound: float, queries: int = AUDITED) -> float:
    """Share of true links found for a bounded sample of nodes (smallest hashes), each compared with all nodes."""
    sample = nodes.orderBy(F.xxhash64(F.lit("audit"), "node")).limit(queries).join(counts, "node").collect()
    if not sample:
        return 1.0
    q = np.array([r["vec"] for r in sample])
    found = sum(r["n"] for r in sample)
    own = sum(r["copies"] for r in sample)

    def count(batches):
        for pdf in batches:
            if len(pdf):
                s = _matrix(pdf["vec"]) @ q.T >= bound
                yield pd.DataFrame({"n": [int((s.sum(axis=1) * pdf["copies"].to_numpy()).sum())]})

    true = nodes.select("vec", "copies").mapInPandas(count, "n long").agg(F.sum("n")).first()[0] - own
    return 1.0 if true <= 0 else found / true


def near_vectors(vectors: DataFrame, bound: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do rows
    without vec_id (component_id null, kept false). Vectors of different lengths never link. Equal rows count
    as links of each other. Other columns are ignored; an empty table gives an empty result.
    """
    rows = stored(unit_vectors(vectors).withColumn("node", F.xxhash64("vec")), "unit-vectors")
    counts = roots = None
    results = []
    lengths = [r[0] for r in rows.where("vec IS NOT NULL").select(F.size("vec")).distinct().collect()]  # usually one
    for length in sorted(lengths):
        ours = rows.where(F.col("vec").isNotNull() & (F.size("vec") == length))
        nodes = stored(ours.groupBy("node").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("first"), F.count("*").alias("copies")), "nodes")
        dealt = stored(shards(nodes), "dealt")
        cells = dealt.groupBy("node").agg(F.collect_set("cell").alias("cells"))  # two at most
        near = _adjacency(dealt)
        members = stored(dealt.join(near, "node").join(cells, "node").join(nodes.select("node", "copies"), "node"), "members")
        for beam in BEAMS:
            counts, links = linked_nodes(nodes, beam, bound, members)
            counts = stored(counts, "counts")
            if audit(nodes, counts, bound) >= RECALL:
                break
        roots = components(links).select(F.col("a").alias("node"), F.col("b").alias("root"))
        placed = nodes.join(counts, "node", "left").join(roots, "node", "left").select(
            "node", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
        least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
        results.append(placed.join(least, "root").select("node", "n_links", "component_id"))
    blank = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not results:
        out = blank
    else:
        table = results[0]
        for r in results[1:]:
            table = table.unionByName(r)
        out = rows.where("vec IS NOT NULL").select("vec_id", "node").join(table, "node").select("vec_id", "n_links", "component_id")
        out = out.unionByName(rows.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Registered query: every vector."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
