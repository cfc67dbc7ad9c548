"""k-nearest-neighbour joins over distinct points: exact, and approximate with audited recall.

Equal vectors are collapsed to one weighted point first. The exact join of few distinct points compares them block
by block with a broadcast copy. Many are cut into blocks: cells of sampled pivots, cells into rings of distance to
their pivot, rings into hashed parts, so no block outgrows a task however dense a region is. Points meet their own
block first, which bounds their k-th distance, and then, in rounds, only those blocks that the triangle inequality
and the plane between two pivots cannot exclude, nearest first: 4 blocks, then up to 16, 64 and so on. Every round
tightens the bound, so most points stop early. What is kept of a visit is ids; a vector travels to a block when it
is compared there. Blocks that many points visit are split again by point. Where distances are so alike that a point
would still visit a large part of the blocks, it leaves the rounds and is swept: it meets all points in a few tiles,
the product of all points and those swept in distance blocks of matrix products.

The approximate join files points in several tables of random projections. A table cuts a few projections at their
quantiles; a cell that is still too full is cut again along one more projection. A point asks its own cell and, as
further probes, the cells across the boundaries nearest to it; candidates are compared exactly. Sampled points are
answered exactly beside it, and tables are added until they find the wanted share of their neighbours; where that
fails, the exact join answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import bounded, require_columns, spread, stored
from ..errors import SamplingError
from .vectors import matrix, pair_distances, slices, squared_distances

BROADCAST_POINTS = 20_000
BLOCK_ROWS = 2_048
MAX_PIVOTS = 1_024
MAX_BLOCKS = 200_000
FIRST_VISITS = 4
# A point is swept if it would visit more blocks than this, or more than this share of them, ...
FEW_VISITS, FEW_SHARE = 64, 0.25
VISIT_PAIRS = 2_000  # ... and they cost more than all points; the visit itself counts as so many compared points.
TILE_VALUES = 4_000_000  # numbers in a tile of the sweep
CHUNK = 4_096  # points whose distances to some rows are estimated at once
# Approximate join.
CELL_ROWS = 2_048
TABLES, MAX_TABLES = 4, 32
PROBES = 2
GRID = 4  # parts of a projection
FITTED = 20_000  # points whose projections give the cuts
PARTS = 256  # further parts of a cell that is too full
AUDITED = 256
RECALL = 0.9
# Slack for rounding in distances compared with a bound.
SLACK = 1 + 1e-9


def distinct_points(df: DataFrame, vector: str, key: str) -> DataFrame:
    """``pid`` (smallest key of the equal rows), ``v``, ``w`` (their number)."""
    require_columns(df, vector, key)
    return df.groupBy(F.col(vector).alias("v")).agg(F.min(key).alias("pid"), F.count(F.lit(1)).alias("w"))


def near_candidates(x, own, points, weights, order, k, bound=None, codes=0):
    """(row, point, distance) of every point that can be among a row's k weighted neighbours.

    ``own`` is the row's index among the points or -1; ``order`` ranks points by pid.
    """
    if len(x) and len(points) and not codes:
        origin = points.mean(axis=0)
        y, offered = x - origin, points - origin
        lengths, reach = (y * y).sum(axis=1), (offered * offered).sum(axis=1)
        if np.isfinite(lengths).all() and np.isfinite(reach).all():
            return _estimated_candidates(x, own, points, weights, order, k, bound, y, offered, lengths, reach)
    rows_out, points_out, distances = [], [], []
    for part in slices(len(x), len(points)):
        block = np.sqrt(squared_distances(x[part], points, codes))
        for r, d in enumerate(block):
            at = part.start + r
            if own[at] >= 0:
                d[own[at]] = np.inf
            near = min(k, len(d)) - 1
            edge = np.partition(d, near)[near]
            if bound is not None:
                edge = min(edge, bound[at])
            found = np.flatnonzero((d <= edge) & np.isfinite(d))
            found = found[np.lexsort((order[found], d[found]))]
            before = np.cumsum(weights[found]) - weights[found]
            found = found[before < k]
            rows_out.append(np.full(len(found), at))
            points_out.append(found)
            distances.append(d[found])
    if not rows_out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(rows_out), np.concatenate(points_out), np.concatenate(distances)


def _estimated_candidates(x, own, points, weights, order, k, bound, y, offered, lengths, reach):
    """The same by matrix products: only pairs that an estimate cannot exclude are measured.

    ``y`` and ``offered`` are the rows and points about a common origin, ``lengths`` and ``reach`` their squared lengths.
    """
    out = []
    error = 1e-15 * (x.shape[1] + 8) * (lengths + reach.max())  # of an estimate
    most = np.full(len(x), np.inf) if bound is None else bound * bound * SLACK + error
    for part in slices(len(x), CHUNK, 1 << 20):
        limit, slack, mine = most[part], 2 * error[part], own[part]
        r, c, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for at in range(0, len(points), CHUNK):
            to = min(len(points), at + CHUNK)
            block = y[part] @ offered[at:to].T
            block *= -2
            block += lengths[part, None]
            block += reach[at:to]
            here = np.flatnonzero((mine >= at) & (mine < to))
            block[here, mine[here] - at] = np.inf
            if not at:
                near = min(k, to) - 1
                limit = np.minimum(limit, np.partition(block, near, axis=1)[:, near] + slack)
            more_r, more_c = np.nonzero(block <= limit[:, None])
            more_d = block[more_r, more_c]
            fine = np.isfinite(more_d)
            r, c, d = np.concatenate([r, more_r[fine]]), np.concatenate([c, more_c[fine] + at]), np.concatenate([d, more_d[fine]])
            by = np.lexsort((d, r))
            r, c, d = r[by], c[by], d[by]
            kth = np.arange(len(r)) - np.searchsorted(r, r) == k - 1
            limit[r[kth]] = np.minimum(limit[r[kth]], d[kth] + slack[r[kth]])
            still = d <= limit[r]
            r, c, d = r[still], c[still], d[still]
        d = np.sqrt(pair_distances(x[part], points, r, c))
        by = np.lexsort((order[c], d, r))
        r, c, d = r[by], c[by], d[by]
        total = np.cumsum(weights[c]) - weights[c]
        before = total - total[np.searchsorted(r, r)]
        taken = before < k
        if bound is not None:
            taken &= d <= bound[part][r]
        out.append((r[taken] + part.start, c[taken], d[taken]))
    return tuple(np.concatenate(column) for column in zip(*out))


def _pair_schema(points: DataFrame) -> str:
    kind = points.schema["pid"].dataType.simpleString()
    return f"a {kind}, b {kind}, dist double, w bigint"


def _broadcast_pairs(points: DataFrame, k: int, codes: int) -> DataFrame:
    table = points.orderBy("pid").toArrow()  # at most BROADCAST_POINTS rows
    held = points.sparkSession.sparkContext.broadcast(table)
    parts = points.sparkSession.sparkContext.defaultParallelism
    numbered = points.sparkSession.range(0, table.num_rows, 1, parts)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_points = matrix(held.value["v"])
        weights = held.value["w"].to_numpy()
        pids = held.value["pid"].combine_chunks()
        order = np.arange(len(weights))
        for batch in batches:
            own = batch.column(0).to_numpy()
            r, c, d = near_candidates(all_points[own], own, all_points, weights, order, k, codes=codes)
            yield pa.RecordBatch.from_arrays(
                [pids.take(pa.array(own[r])), pids.take(pa.array(c)), pa.array(d), pa.array(weights[c])],
                names=["a", "b", "dist", "w"],
            )

    return numbered.mapInArrow(near, _pair_schema(points))


@dataclass(frozen=True)
class Blocks:
    """Placed points (pid, v, w, cell, block), the pivots, and the directory of blocks, at most ``MAX_BLOCKS`` of them."""

    points: DataFrame
    centres: np.ndarray
    names: np.ndarray
    cell: np.ndarray
    near: np.ndarray
    far: np.ndarray
    codes: int


def _placed(points: DataFrame, k: int, count: int, block_rows: int, codes: int) -> Blocks:
    pivots = min(MAX_PIVOTS, max(k + 2, count // block_rows))
    # Thinned by hash before the top-k, so no task or merge sees more than a few times the pivots.
    share = min(1.0, (4 * pivots + 100) / count)
    drawn = points.where(F.pmod(F.xxhash64("pid"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    drawn = drawn.orderBy(F.xxhash64("pid"), "pid").limit(pivots).select("v").toArrow()
    centres = matrix(drawn["v"])
    held = points.sparkSession.sparkContext.broadcast(centres)

    @F.arrow_udf("struct<cell:int,pd:double>")
    def place(column: pa.Array) -> pa.Array:
        x = matrix(column)
        cell, distance = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
        for part in slices(len(x), len(held.value)):
            d = squared_distances(x[part], held.value, codes)
            cell[part] = d.argmin(axis=1)
            distance[part] = np.sqrt(d.min(axis=1))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(distance)], names=["cell", "pd"])

    placed = stored(spread(points, count).withColumn("__p", place("v")).select("pid", "v", "w", "__p.*"), "knn-placed")
    cells = placed.groupBy("cell").agg(F.max("pd").alias("reach"), F.count(F.lit(1)).alias("n"))
    cells = F.broadcast(cells.withColumn("rings", F.ceil(F.col("n") / block_rows)))  # at most MAX_PIVOTS rows
    share = F.coalesce(F.try_divide("pd", "reach"), F.lit(0.0))
    ring = F.least(F.floor(share * F.col("rings")), F.col("rings") - 1)
    ringed = placed.join(cells.drop("n"), "cell").withColumn("ring", ring).drop("reach", "rings")
    rings = ringed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"))
    rings = bounded(rings.select("cell", "ring", F.ceil(F.col("n") / block_rows).alias("parts")))[0]
    block = F.concat_ws("-", "cell", "ring", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("string"))
    placed = stored(ringed.join(rings, ["cell", "ring"]).withColumn("block", block).drop("ring", "parts"), "knn-blocks")
    directory = placed.groupBy("block", "cell").agg(F.min("pd").alias("near"), F.max("pd").alias("far")).orderBy("cell", "block")
    table = directory.limit(MAX_BLOCKS + 1).toPandas()
    if len(table) > MAX_BLOCKS:  # rings and parts are rounded up, so cells give a few more blocks than count / block_rows
        raise SamplingError(f"more than {MAX_BLOCKS} blocks; raise block_rows")
    return Blocks(placed.drop("pd"), centres, *(table[c].to_numpy() for c in ("block", "cell", "near", "far")), codes)


def open_blocks(x, own_cell, bound, centres, cell, near, far, codes=0, between=None):
    """(row, block, least possible distance) of the blocks within the rows' bounds; blocks stand in the order of their cells."""
    start = np.searchsorted(cell, np.arange(len(centres)))
    held = np.searchsorted(cell, np.arange(len(centres)), side="right") - start
    between = np.sqrt(squared_distances(centres, centres, codes)) if between is None else between
    d = np.sqrt(squared_distances(x, centres, codes))
    own = d[np.arange(len(x)), own_cell][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d * d - own * own) / (2 * between[own_cell])
    plane[~np.isfinite(plane)] = 0
    plane -= np.abs(plane) * (SLACK - 1) + own * 1e-9  # rounding must not exclude a block
    r, c = np.nonzero(plane <= bound[:, None])
    number = held[c]
    rows, cells = np.repeat(r, number), np.repeat(c, number)
    b = np.arange(len(rows)) - np.repeat(np.cumsum(number) - number, number) + start[cells]
    gap = d[rows, cells]
    least = np.maximum.reduce([gap - far[b] * SLACK, near[b] - gap * SLACK, plane[rows, cells], np.zeros(len(b))])
    open_ = least <= bound[rows]
    return rows[open_], b[open_], least[open_]


def blocks_to_visit(x, own_cell, bound, centres, cell, near, far, lo, hi, codes=0, between=None):
    """(row, block) of the blocks that hold places lo .. hi of each row's order by least possible distance.

    Blocks farther than the bound have no place, so a tighter bound only cuts the order's end off.
    """
    rows, b, least = open_blocks(x, own_cell, bound, centres, cell, near, far, codes, between)
    if hi < len(cell) and len(rows) > hi * len(x):  # only the first hi of a row are put in order
        table = np.full((len(x), len(cell)), np.inf)
        table[rows, b] = least
        first = least <= np.partition(table, hi - 1, axis=1)[rows, hi - 1]
        rows, b, least = rows[first], b[first], least[first]
    order = np.lexsort((b, least, rows))
    rows, b = rows[order], b[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    wanted = (place >= lo) & (place < hi)
    return rows[wanted], b[wanted]


def _heavy(blocks: Blocks, bounds: DataFrame, kind: str, lo: int, visits: float) -> DataFrame:
    """(pid, bound) of the points that would visit more than so many blocks after their first ``lo``."""
    held = bounds.sparkSession.sparkContext.broadcast((blocks.centres, blocks.cell, blocks.near, blocks.far))
    codes = blocks.codes

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, cell, near, far = held.value
        between = np.sqrt(squared_distances(centres, centres, codes))
        for batch in batches:
            x, bound, own = matrix(batch.column("v")), batch.column("bound").to_numpy(), batch.column("cell").to_numpy()
            for part in slices(len(x), max(len(cell), len(centres))):
                r, _, _ = open_blocks(x[part], own[part], bound[part], centres, cell, near, far, codes, between)
                found = pa.array(np.flatnonzero(np.bincount(r, minlength=len(x[part])) - lo > visits) + part.start)
                yield batch.select(["pid", "bound"]).take(found)

    return bounds.select("pid", "v", "cell", "bound").mapInArrow(heavy, f"pid {kind}, bound double")


def _swept(points: DataFrame, asked: DataFrame, k: int, count: int, rows: int, dims: int, codes: int) -> DataFrame:
    """Candidates of the asked points (pid, bound; so many ``rows``) among all points, in tiles that meet pairwise."""
    tasks = 8 * points.sparkSession.sparkContext.defaultParallelism
    offers = max(-(-count * dims // TILE_VALUES), int(np.ceil(np.sqrt(tasks))))
    asks = max(-(-rows * dims // TILE_VALUES), -(-tasks // offers))

    def dealt(df: DataFrame, own: str, number: int, other: str, others: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        return df.withColumn(own, F.pmod(F.xxhash64("pid"), F.lit(number).cast("long"))).withColumn(other, every)

    asking = dealt(_with_vectors(asked, points), "ask", asks, "offer", offers)
    asking = asking.select(*[F.col(c).alias(c) for c in asking.columns])
    offered = dealt(points.select("pid", "v", "w"), "offer", offers, "ask", asks)
    met = asking.groupBy("ask", "offer").cogroup(offered.groupBy("ask", "offer"))
    return _nearest(met.applyInArrow(_compare(k, codes), _pair_schema(points)), k).drop("before")


def _with_vectors(asked: DataFrame, points: DataFrame) -> DataFrame:
    """Ids with their vectors. Ids repeat and are stored in a few bytes each, so their files tell too little to broadcast them by."""
    return asked.join(points.select("pid", "v").hint("merge"), "pid")


def _visits(blocks: Blocks, bounds: DataFrame, kind: str, lo: int, hi: int) -> DataFrame:
    """(block, pid, bound): ids of the points that ask a block in this round."""
    held = bounds.sparkSession.sparkContext.broadcast((blocks.centres, blocks.names, blocks.cell, blocks.near, blocks.far))
    codes = blocks.codes

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, names, cell, near, far = held.value
        number = {name: i for i, name in enumerate(names)}
        names = pa.array(names)
        between = np.sqrt(squared_distances(centres, centres, codes))
        for batch in batches:
            home = np.array([number[x] for x in batch.column("block").to_pylist()], dtype=int)
            x, bound, own = matrix(batch.column("v")), batch.column("bound").to_numpy(), batch.column("cell").to_numpy()
            for part in slices(len(x), max(len(cell), len(centres))):
                r, b = blocks_to_visit(x[part], own[part], bound[part], centres, cell, near, far, lo, hi, codes, between)
                away = b != home[part][r]  # the own block has been seen
                r, b = pa.array(r[away] + part.start), b[away]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(b)), batch.column("pid").take(r), batch.column("bound").take(r)],
                    names=["block", "pid", "bound"],
                )

    return bounds.select("pid", "v", "cell", "block", "bound").mapInArrow(visit, f"block string, pid {kind}, bound double")


def _compare(k: int, codes: int = 0) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def compare(asked: pa.Table, offer: pa.Table) -> pa.Table:
        if not len(asked) or not len(offer):
            return pa.table({"a": asked["pid"].slice(0, 0), "b": asked["pid"].slice(0, 0), "dist": pa.array([], pa.float64()), "w": pa.array([], pa.int64())})
        points, weights, pids = matrix(offer["v"]), offer["w"].to_numpy(), offer["pid"].combine_chunks()
        place = {p: i for i, p in enumerate(pids.to_pylist())}
        own = np.array([place.get(p, -1) for p in asked["pid"].to_pylist()], dtype=int)
        order = np.argsort(pids.to_numpy(zero_copy_only=False), kind="stable").argsort()
        r, c, d = near_candidates(matrix(asked["v"]), own, points, weights, order, k, asked["bound"].to_numpy(), codes)
        return pa.table({
            "a": asked["pid"].combine_chunks().take(pa.array(r)), "b": pids.take(pa.array(c)),
            "dist": pa.array(d), "w": pa.array(weights[c]),
        })

    return compare


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of every a among its candidates: ``a, b, dist, w, before`` (rows that come earlier)."""
    nearest = Window.partitionBy("a").orderBy("dist", "b").rowsBetween(Window.unboundedPreceding, -1)
    return pairs.withColumn("before", F.coalesce(F.sum("w").over(nearest), F.lit(0).cast("long"))).where(F.col("before") < k)


def _block_pairs(points: DataFrame, k: int, count: int, block_rows: int, codes: int) -> tuple[DataFrame, int, int]:
    """Candidate pairs, blocks, and visits over all rounds."""
    kind = points.schema["pid"].dataType.simpleString()
    # Larger blocks for more points keep the directory within a broadcast.
    block_rows = max(block_rows, 4 * count // MAX_BLOCKS)
    blocks = _placed(points, k, count, block_rows, codes)
    members = blocks.points.select("block", "pid", "v", "w")

    def met(asking: DataFrame, loads: DataFrame) -> DataFrame:
        loads = bounded(loads.select("block", F.ceil(F.col("n") / (4 * block_rows)).alias("parts")))[0]
        asking = asking.join(loads, "block").withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts"))).drop("parts")
        offered = (
            members.join(loads, "block")
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        )
        asking = asking.select(*[F.col(c).alias(c) for c in asking.columns])  # columns of its own beside the same table's
        both = asking.groupBy("block", "part").cogroup(offered.groupBy("block", "part"))
        return both.applyInArrow(_compare(k, codes), _pair_schema(points))

    first = members.select("block", "pid", "v", F.lit(float("inf")).alias("bound"))
    found = stored(_nearest(met(first, members.groupBy("block").agg(F.count(F.lit(1)).alias("n"))), k).drop("before"), "knn-found")
    visits, lo, hi = count, 0, FIRST_VISITS
    own_rows = points.select("pid", (F.col("w") - 1).alias("own"))
    active, dims = blocks.points, blocks.centres.shape[1]
    few = max(min(FEW_VISITS, FEW_SHARE * len(blocks.names)), count / (VISIT_PAIRS + count / max(1, len(blocks.names))))
    while lo < len(blocks.names):
        # A point's own equal rows are neighbours at distance 0 and count towards the k.
        reached = found.groupBy("a").agg(F.sum("w").alias("n"), F.max("dist").alias("far"))
        bounds = active.join(reached.withColumnRenamed("a", "pid"), "pid", "left").join(own_rows, "pid")
        full = F.coalesce(F.col("n"), F.lit(0).cast("long")) >= k
        limit = F.when(F.col("own") >= k, F.lit(0.0)).when(full, F.col("far") * SLACK).otherwise(F.lit(float("inf")))
        bounds = bounds.withColumn("bound", limit)
        if lo:
            heavy = stored(_heavy(blocks, spread(bounds, count), kind, lo, few), "knn-heavy")
            rows = heavy.count()
            if rows:
                visits += rows * len(blocks.names)
                done = heavy.select("pid").hint("merge")
                swept = _swept(points, heavy, k, count, rows, dims, codes)
                rest = found.join(done.withColumnRenamed("pid", "a"), "a", "left_anti")
                found = stored(rest.unionByName(swept), "knn-found")
                active = stored(active.join(done, "pid", "left_anti"), "knn-active")
                bounds = bounds.join(done, "pid", "left_anti")
        asked = stored(_visits(blocks, spread(bounds, count), kind, lo, hi), "knn-visits")
        loads = stored(asked.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "knn-loads")
        number = loads.agg(F.sum("n")).first()[0]
        if not number:
            break
        visits += number
        asking = _with_vectors(asked, points)
        more = met(asking.select("block", "pid", "v", "bound"), loads)
        found = stored(_nearest(found.unionByName(more), k).drop("before"), "knn-found")
        lo, hi = hi, hi * 4
    return found, len(blocks.names), visits


@dataclass(frozen=True)
class NeighbourSearch:
    """``pairs`` (a, b, dist, take) and how they were found.

    ``recall`` is the mean share of their k nearest rows that sampled points got (1 for an exact join). ``visits``
    counts the meetings of a point with a block (all points with themselves: one block).
    """

    pairs: DataFrame
    points: int
    blocks: int
    visits: int
    recall: float
    tables: int = 0


def _with_own(points: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """A point with w equal rows has its own w - 1 other rows at distance 0."""
    itself = points.where("w > 1").select(
        F.col("pid").alias("a"), F.col("pid").alias("b"), F.lit(0.0).alias("dist"), (F.col("w") - 1).alias("w")
    )
    ranked = _nearest(pairs.unionByName(itself), k)
    return ranked.select("a", "b", "dist", F.least(F.col("w"), F.lit(k) - F.col("before")).alias("take"))


def knn_search(
    points: DataFrame, k: int, broadcast_points: int = BROADCAST_POINTS, block_rows: int = BLOCK_ROWS, codes: int = 0
) -> NeighbourSearch:
    """The exact join with its figures; the last ``codes`` components are numbers of levels."""
    count = points.count()
    if count <= broadcast_points:
        pairs, blocks, visits = _broadcast_pairs(points, k, codes), 1, count
    else:
        pairs, blocks, visits = _block_pairs(points, k, count, block_rows, codes)
    return NeighbourSearch(_with_own(points, pairs, k), count, blocks, visits, 1.0)


def knn_join(
    points: DataFrame, k: int, broadcast_points: int = BROADCAST_POINTS, block_rows: int = BLOCK_ROWS, codes: int = 0
) -> DataFrame:
    """``a, b, dist, take``: the k nearest rows of point a, as points b with how many of b's rows count.

    Ties at the k-th place go to the smaller pid.
    """
    return knn_search(points, k, broadcast_points, block_rows, codes).pairs


@dataclass(frozen=True)
class Projections:
    """Random projections of one table: those of the grid with their cuts, and one that cuts full cells again."""

    grid: np.ndarray
    cuts: np.ndarray
    further: np.ndarray

    @staticmethod
    def drawn(sample: np.ndarray, directions: int, seed: int, table: int) -> Projections:
        rng = np.random.default_rng([seed, table])
        grid = rng.normal(size=(directions, sample.shape[1]))
        levels = np.arange(1, GRID) / GRID
        cuts = np.quantile(sample @ grid.T, levels, axis=0).T if directions else np.zeros((0, GRID - 1))
        return Projections(grid, cuts, rng.normal(size=sample.shape[1]))

    def cells(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, own, further) of every row's own cell and of those across its nearest boundaries."""
        rows = np.arange(len(x))
        cell = np.zeros(len(x), dtype=np.int64)
        further = x @ self.further
        if not len(self.grid):
            return rows, cell, np.ones(len(x), bool), further
        value = x @ self.grid.T
        place = np.array([np.searchsorted(c, v) for c, v in zip(self.cuts, value.T)]).T
        weight = GRID ** np.arange(len(self.grid), dtype=np.int64)
        cell = place @ weight
        gap = np.abs(value[:, :, None] - self.cuts[None])
        nearest = gap.argmin(axis=2)
        order = gap.min(axis=2).argsort(axis=1, kind="stable")[:, :probes]
        found = [(rows, cell, np.ones(len(x), bool))]
        for p in range(order.shape[1]):
            j = order[:, p]
            across = np.where(place[rows, j] <= nearest[rows, j], 1, -1)
            found.append((rows, cell + across * weight[j], np.zeros(len(x), bool)))
        r, c, own = (np.concatenate(part) for part in zip(*found))
        return r, c, own, further[r]


def _filed(points: DataFrame, tables: dict[int, Projections], probes: int) -> DataFrame:
    """(pid, no, cell, further, own): where a point stands (own) and asks, by table."""
    held = points.sparkSession.sparkContext.broadcast(tables)
    kind = points.schema["pid"].dataType.simpleString()

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"))
            for number, table in held.value.items() if len(x) else ():
                r, cell, own, further = table.cells(x, probes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("pid").take(pa.array(r)), pa.array(np.full(len(r), number, np.int32)), pa.array(cell),
                        pa.array(further), pa.array(own),
                    ],
                    names=["pid", "no", "cell", "further", "own"],
                )

    return points.select("pid", "v").mapInArrow(file, f"pid {kind}, no int, cell long, further double, own boolean")


def _parted(filed: DataFrame, cell_rows: int) -> DataFrame:
    """Adds ``block``: the cell, cut again where it holds too many points."""
    sizes = filed.where("own").groupBy("no", "cell")
    levels = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    full = sizes.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("further", levels, 4 * PARTS).alias("at"))
    full = full.where(F.col("n") > 2 * cell_rows)
    parts = F.least(F.lit(PARTS), F.ceil(F.col("n") / cell_rows).cast("int"))
    inner = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda i: F.get("at", (i * PARTS / F.col("parts")).cast("int") - 1))
    full = full.withColumn("parts", parts).select("no", "cell", inner.alias("cuts"))
    cut = filed.join(bounded(full, max_rows=20_000)[0], ["no", "cell"], "left")
    part = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("further"))))
    cut = cut.withColumn("part", part).drop("cuts")
    # Where points share one projected value even that leaves too many: those are dealt by hash, and asked so too.
    still = cut.where("own").groupBy("no", "cell", "part").agg(F.ceil(F.count(F.lit(1)) / (4 * cell_rows)).alias("deals")).where("deals > 1")
    cut = cut.join(bounded(still)[0], ["no", "cell", "part"], "left")
    deal = F.pmod(F.xxhash64("pid"), F.coalesce("deals", F.lit(1)))
    return cut.select("pid", "own", F.concat_ws("-", "no", "cell", "part", deal.cast("string")).alias("block"))


def _candidates(filed: DataFrame, asks: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Nearest candidates of the asking rows (pid, block) among the points that stand in their blocks."""
    offered = filed.where("own").join(points, "pid").select("block", "pid", "v", "w")
    asking = _with_vectors(asks, points).select("block", "pid", "v", F.lit(float("inf")).alias("bound"))
    asking = asking.select(*[F.col(c).alias(c) for c in asking.columns])
    met = asking.groupBy("block").cogroup(offered.groupBy("block")).applyInArrow(_compare(k), _pair_schema(points))
    return _nearest(met.distinct(), k).drop("before")  # tables find the same pairs


def _exact_answers(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Exact neighbours of a bounded number of points, in one pass over all."""
    table = asked.select("pid", "v").toArrow()  # at most AUDITED rows
    held = points.sparkSession.sparkContext.broadcast(table)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pids = held.value["pid"].combine_chunks()
        x, place = matrix(held.value["v"]), {p: i for i, p in enumerate(pids.to_pylist())}
        for batch in batches:
            if not batch.num_rows:
                continue
            theirs = batch.column("pid")
            own = np.full(len(x), -1)
            for i, p in enumerate(theirs.to_pylist()):
                if p in place:
                    own[place[p]] = i
            weights = batch.column("w").to_numpy()
            order = np.argsort(theirs.to_numpy(zero_copy_only=False), kind="stable").argsort()
            r, c, d = near_candidates(x, own, matrix(batch.column("v")), weights, order, k)
            yield pa.RecordBatch.from_arrays(
                [pids.take(pa.array(r)), theirs.take(pa.array(c)), pa.array(d), pa.array(weights[c])], names=["a", "b", "dist", "w"]
            )

    return _nearest(points.select("pid", "v", "w").mapInArrow(near, _pair_schema(points)), k).drop("before")


def _recall(found: DataFrame, exact: DataFrame) -> float:
    """Mean share of a point's exact neighbours that were found."""
    got = exact.join(found.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    shares = got.groupBy("a").agg((F.sum(F.col("w") * F.coalesce("hit", F.lit(0))) / F.sum("w")).alias("share"))
    return shares.agg(F.avg("share")).first()[0] or 0.0


def _few_points(points: DataFrame, count: int, n: int) -> DataFrame:
    """A draw of n points by the hash of their pid, thinned before it is sorted."""
    share = min(1.0, (4 * n + 100) / max(1, count))
    drawn = points.where(F.pmod(F.xxhash64(F.lit("draw"), "pid"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return drawn.orderBy(F.xxhash64(F.lit("draw"), "pid"), "pid").limit(n)


def approximate_knn_search(
    points: DataFrame, k: int, recall: float = RECALL, seed: int = 0, tables: int = TABLES, max_tables: int = MAX_TABLES,
    probes: int = PROBES, cell_rows: int = CELL_ROWS,
) -> NeighbourSearch:
    """Neighbours by random-projection tables, with exact distances and an audited recall.

    ``points`` as of ``distinct_points``. Every listed distance is exact; a listed neighbour may be one that a
    nearer, missed point should have displaced. ``AUDITED`` points are answered exactly as well; while the mean
    share of their neighbours that the tables find is below ``recall``, the tables are doubled up to
    ``max_tables``, and after that the exact join answers. Grid cuts are fitted on at most ``FITTED`` points; all
    points are filed.
    """
    count = points.count()
    sample = matrix(_few_points(points, count, FITTED).select("v").toArrow()["v"])
    directions = max(0, int(np.log(max(1.0, count / cell_rows)) / np.log(GRID)))
    if count <= 2 * cell_rows:
        directions, tables, max_tables = 0, 1, 1  # one cell holds all, whatever the projection
    audited = stored(_few_points(points, count, AUDITED), "audited")
    exact = stored(_exact_answers(points, audited, k), "audited-neighbours")
    filed, number = [], 0
    while True:
        drawn = {t: Projections.drawn(sample, directions, seed, t) for t in range(number, tables)}
        filed.append(stored(_parted(stored(_filed(points, drawn, probes), "filed"), cell_rows), "parted"))
        number, every = tables, filed[0]
        for more in filed[1:]:
            every = every.unionByName(more)
        asks = stored(every.join(F.broadcast(audited.select("pid")), "pid").select("pid", "block"), "audit-asks")
        blocks = F.broadcast(asks.select("block").distinct())  # a few blocks a table and audited point
        share = _recall(_candidates(every.join(blocks, "block"), asks, points, k), exact)
        if share >= recall or tables >= max_tables:
            break
        tables = min(2 * tables, max_tables)
    if share < recall and count:
        return knn_search(points, k)
    pairs = stored(_candidates(every, every.select("pid", "block"), points, k), "near-candidates")
    held = every.where("own").select("block").distinct().count()
    return NeighbourSearch(_with_own(points, pairs, k), count, held, every.count(), share if count else 1.0, number)
