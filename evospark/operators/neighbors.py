"""Nearest neighbours: exact, by local precedence, and by probes along space-filling curves."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..session import ship, stored
from .slices import PER_SLICE, sliced

#: Queries that may go to every task, and the stored points that a block of them meets beyond that.
QUERY_BLOCK, STORE_BLOCK = 4_096, 16_384
#: Stored points that give the centres of cells, cells and a cell's rings at most, rows of a slice.
SAMPLED, CELLS, RINGS, ROWS = 4_096, 256, 64, 8_192
#: Queries that are tried on the sample, and the share of it up to which cells are worth their work.
TRIED, WORTH = 256, 0.4
#: Pairs whose distances are held at once; a larger block goes piece by piece.
PAIRS = 1 << 18
#: Where all pairs are asked for: points of a block at least, components at most, blocks of a table between.
LEAST_BLOCK, MOST_VALUES, BLOCKS = 1_024, 1_310_720, 32
#: Dimensions of the grid of a radius join; a point is copied to 3 ** GRID cells.
GRID = 3


def usable(vector: str) -> Column:
    """Vectors that can have a neighbour: not null, not empty, every component finite."""
    x = F.col(vector)
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


Stored = Iterator[tuple[np.ndarray, np.ndarray]]


def by_length(batch: pa.RecordBatch | pa.Table, size: int = ROWS) -> Stored:
    """Ids and vectors of a batch in matrices of one width each, of at most ``size`` rows."""
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        ids, column = part.column("id").to_numpy(), part.column("v")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            yield ids[own], flat[starts[own, None] + np.arange(n)]


def _pieces(n: int, others: int) -> Iterator[slice]:
    """Rows of ``n`` that meet ``others``, PAIRS pairs or one row at a time."""
    step = max(1, PAIRS // max(1, others))
    return (slice(at, at + step) for at in range(0, n, step))


def _distances(points: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """Over the shorter width of both."""
    d = np.zeros((len(points), len(stored)))
    for dim in range(min(points.shape[1], stored.shape[1])):  # in order, so that sums are those of a plain loop
        d += (points[:, dim, None] - stored[None, :, dim]) ** 2
    return np.sqrt(d)


class Cells:
    """Voronoi cells around the centres of a bounded sample, and what the triangle inequality says of
    them: a stored point at r from its centre is at least ``|d - r|`` from a query at d from that
    centre, and at least as far as the plane between the cell's centre and the query's own."""

    def __init__(self, sample: np.ndarray, most: int = CELLS):
        self.sample = sample
        n = max(1, min(most, len(sample) // 32))
        self.centres = sample[:: max(1, len(sample) // n)][:n].copy()
        for _ in range(4):
            own = self.distances(sample).argmin(1)
            for c in range(len(self.centres)):
                if (own == c).any():
                    self.centres[c] = sample[own == c].mean(0)
        self.between = _distances(self.centres, self.centres)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return _distances(x, self.centres)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(x)
        cell = d.argmin(1)
        return cell, d[np.arange(len(x)), cell]

    def planes(self, d: np.ndarray) -> np.ndarray:
        """The least distance of queries at ``d`` from the centres to the points of every cell."""
        own = d.argmin(1)
        to_own = d[np.arange(len(d)), own][:, None]
        width = self.between[own]
        return np.where(width > 0, (d * d - to_own * to_own) / np.maximum(2 * width, 1e-300), 0.0)

    def kth(self, points: np.ndarray, k: int) -> np.ndarray:
        """An upper bound of the distance to the k-th neighbour: that in the sample, a part of the store."""
        if len(self.sample) < k:
            return np.full(len(points), np.inf)
        return np.concatenate([np.partition(_distances(points[own], self.sample), k - 1, 1)[:, k - 1] for own in _pieces(len(points), len(self.sample))] or [np.zeros(0)])

    def share(self, points: np.ndarray, k: int) -> float:
        """The share of the sample that some queries have to meet."""
        d, limit = self.distances(points), self.kth(points, k)
        cell, r = self.assign(self.sample)
        least = np.maximum(np.abs(d[:, cell] - r), self.planes(d)[:, cell])
        return float((least <= limit[:, None]).mean())


def _slack(x: np.ndarray) -> np.ndarray:
    """Room for rounding in the bounds: a pair too many costs time only."""
    return 1e-9 * (1.0 + np.where(np.isfinite(x), x, 0.0))


def _least(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distances up to its k-th least, ties included, and their ids; the rest is infinite."""
    if d.shape[1] <= 4 * k:
        return d, np.broadcast_to(ids, d.shape)
    row, column = np.nonzero((d <= np.partition(d, k - 1, 1)[:, k - 1 : k]) & np.isfinite(d))
    n = np.bincount(row, minlength=len(d))
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    out, own = np.full((len(d), n.max()), np.inf), np.full((len(d), n.max()), np.iinfo(np.int64).max)
    out[row, at], own[row, at] = d[row, column], ids[column]
    return out, own


class Nearest:
    """The best k of the stored rows for queries of one width, k rows a query held at a time.

    With ``cells``, a slice's stored rows are told apart by cell, and a query meets those of a cell
    only if its bounds leave room for a neighbour nearer than the k-th it knows of. ``compared``
    counts the pairs whose distance was taken.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int, cells: Cells | None = None, limit: np.ndarray | None = None):
        self.ids, self.points, self.k, self.compared = ids, points, k, 0
        self.best_d = np.full((len(ids), k), np.inf)
        self.best_i = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.limit = np.full(len(ids), np.inf) if limit is None else limit.copy()
        self.cells = cells if cells is not None and cells.centres.shape[1] == points.shape[1] else None
        if self.cells is not None:
            self.to_centres = cells.distances(points)
            self.to_planes = cells.planes(self.to_centres)
            self.limit = np.minimum(self.limit, cells.kth(points, k))

    def _take(self, q: np.ndarray, sid: np.ndarray, stored: np.ndarray) -> None:
        for own in _pieces(len(q), len(stored)):
            self._take_piece(q[own], sid, stored)

    def _take_piece(self, q: np.ndarray, sid: np.ndarray, stored: np.ndarray) -> None:
        d = _distances(self.points[q], stored)
        self.compared += d.size
        d[d > (self.limit[q] + _slack(self.limit[q]))[:, None]] = np.inf
        near = np.isfinite(d).any(1)
        q, d = q[near], d[near]
        if len(q):
            d, i = _least(d, sid, self.k)
            all_d, all_i = np.hstack((self.best_d[q], d)), np.hstack((self.best_i[q], i))
            order = np.lexsort((all_i, all_d), axis=1)[:, : self.k]
            self.best_d[q], self.best_i[q] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
            self.limit[q] = np.minimum(self.limit[q], self.best_d[q, -1])

    def see(self, sid: np.ndarray, stored: np.ndarray) -> None:
        if self.cells is None or stored.shape[1] != self.points.shape[1]:
            return self._take(np.arange(len(self.ids)), sid, stored)
        cell, r = self.cells.assign(stored)
        order = np.lexsort((r, cell))
        bounds = np.flatnonzero(np.append(np.diff(cell[order]) != 0, True)) + 1
        at = 0
        for end in bounds.tolist():
            own, c = order[at:end], cell[order[at]]
            d = self.to_centres[:, c]
            least = np.maximum(np.maximum(d - r[own[-1]], r[own[0]] - d), self.to_planes[:, c])
            q = np.flatnonzero(least <= self.limit + _slack(d))
            if len(q):
                self._take(q, sid[own], stored[own])
            at = end

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, r = np.nonzero(np.isfinite(self.best_d))
        return self.ids[q], self.best_i[q, r], self.best_d[q, r]


class Sums:
    """The sum of each query's distances and their number."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points, self.total, self.n = ids, points, np.zeros(len(ids)), 0

    def see(self, sid: np.ndarray, stored: np.ndarray) -> None:
        for own in _pieces(len(self.ids), len(sid)):
            self.total[own] += _distances(self.points[own], stored).sum(1)
        self.n += len(sid)

    def found(self) -> tuple[np.ndarray, ...]:
        return self.ids, self.total, np.full(len(self.ids), self.n)


FOUND, SUMMED = "query_id long, store_id long, d double", "query_id long, total double, n long"


def _record(parts: list[tuple[np.ndarray, ...]], schema: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64 if "long" in f else np.float64) for f in schema.split(", ")]
    return pa.record_batch([pa.array(c) for c in columns], names)


def _seen(works: list, rows: Stored, schema: str) -> pa.RecordBatch:
    for sid, stored in rows:
        for work in works:
            work.see(sid, stored)
    return _record([w.found() for w in works], schema)


def _meet(asked: DataFrame, rows: DataFrame, works: Callable[[Stored], list], schema: str, block: int, stored_block: int, taken: pa.Table) -> DataFrame:
    """All queries and stored points (``id, v``), a row for each query and part of the store.

    Up to ``block`` queries, which are then all of ``taken``, go to the tasks that scan the store,
    which stays in place. Beyond that, queries and stored points are dealt into blocks by their ids,
    and each pair of blocks is a group of its own: a task holds two blocks.
    """
    if taken.num_rows <= block:

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if taken.num_rows:
                yield _seen(works(by_length(taken, block)), (part for batch in batches for part in by_length(batch)), schema)

        return rows.mapInArrow(scan, schema)
    parts = lambda df, size: df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("n")).scalar()
    dealt = lambda df, own, other, is_query: df.select("id", "v", F.lit(is_query).alias("asked"), F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))
    with_parts = lambda df: df.withColumn("qb", parts(asked, block)).withColumn("sb", parts(rows, stored_block))
    both = dealt(with_parts(asked), "qb", "sb", True).select("id", "v", "asked", "qb", "sb").union(dealt(with_parts(rows), "sb", "qb", False).select("id", "v", "asked", "qb", "sb"))

    def compare(table: pa.Table) -> pa.Table:
        own, other = table.filter(table.column("asked")), table.filter(pc.invert(table.column("asked")))
        return pa.Table.from_batches([_seen(works(by_length(own, max(1, own.num_rows))), by_length(other), schema)])

    return both.groupBy("qb", "sb").applyInArrow(compare, schema)


def _cells(rows: DataFrame) -> Cells | None:
    """Cells of the commonest width, from SAMPLED stored points at most, the least by hash."""
    sample = list(by_length(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLED).toArrow(), SAMPLED))
    return Cells(max((m for _, m in sample), key=len)) if sample else None


@dataclass(frozen=True)
class Rings:
    """Blocks of the store: each cell cut into rings by the quantiles of the distance to its centre,
    and a crowded ring by its points' hash."""

    edges: list[np.ndarray]
    ends: np.ndarray
    parts: np.ndarray

    @staticmethod
    def of(placed: DataFrame, cells: Cells, size: int) -> Rings:
        stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"), F.percentile_approx("r", [i / RINGS for i in range(1, RINGS)], 1000).alias("e")).collect()  # a row for each of CELLS at most
        edges, ends, parts = [np.zeros(0)] * len(cells.centres), np.zeros((len(cells.centres), 2)), np.zeros(len(cells.centres), np.int64)
        for row in stats:
            rings = min(RINGS, -(-row["n"] // size))
            edges[row["cell"]] = np.unique([row["e"][i * RINGS // rings - 1] for i in range(1, rings)])
            ends[row["cell"]], parts[row["cell"]] = (row["low"], row["high"]), -(-row["n"] // (size * rings))
        return Rings(edges, ends, parts)

    def ring(self, cell: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cell), np.int64)
        for c in np.unique(cell):
            own = cell == c
            out[own] = np.searchsorted(self.edges[c], r[own], side="left")
        return out


def _by_cells(asked: DataFrame, rows: DataFrame, cells: Cells, k: int, block: int, size: int) -> DataFrame:
    """Candidates of many queries, all vectors of one width: first of each query's own block, whose
    k-th neighbour bounds the distance to others, then of the blocks that may hold a nearer one."""
    found, key = FOUND, ["cell", "ring", "part"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, m in by_length(batch):
                cell, r = cells.assign(m)
                yield pa.record_batch([pa.array(cell, pa.int32()), pa.array(r)], ["cell", "r"])

    rings = Rings.of(rows.mapInArrow(assign, "cell int, r double"), cells, size)

    def listed(m: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))

    def blocks(ids, m, cell, ring, part, limit) -> pa.RecordBatch:
        return pa.record_batch([pa.array(ids), listed(m), *(pa.array(x, pa.int32()) for x in (cell, ring, part)), pa.array(limit)], ["id", "v", *key, "bound"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, m in by_length(batch):
                cell, r = cells.assign(m)
                yield blocks(ids, m, cell, rings.ring(cell, r), (ids * 0x9E3779B1 >> 7) % np.maximum(rings.parts[cell], 1), np.zeros(len(ids)))

    def spread(ids, m, q, cell, ring, limit) -> pa.RecordBatch:
        n = rings.parts[cell]  # a row for each part of a crowded ring
        at = np.repeat(np.arange(len(q)), n)
        return blocks(ids[q[at]], m[q[at]], cell[at], ring[at], np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n), limit[q[at]])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, m in by_length(batch):
                cell, r = cells.assign(m)
                yield spread(ids, m, np.arange(len(ids)), cell, rings.ring(cell, r), cells.kth(m, k))

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits = dict(zip(batch.column("id").to_numpy().tolist(), batch.column("bound").to_numpy().tolist()))
            for ids, m in by_length(batch, 256):
                d, limit = cells.distances(m), np.array([limits[i] for i in ids.tolist()])
                unknown = np.isinf(limit)  # its own block holds fewer than k points
                limit[unknown] = cells.kth(m[unknown], k)
                planes, own = cells.planes(d), d.argmin(1)
                at_home = rings.ring(own, d[np.arange(len(ids)), own])
                room = limit + _slack(d.max(1))
                for c in np.flatnonzero(rings.parts):
                    low, high = np.append(rings.ends[c, 0], rings.edges[c]), np.append(rings.edges[c], rings.ends[c, 1])
                    least = np.maximum(np.maximum(d[:, c, None] - high, low - d[:, c, None]), planes[:, c, None])
                    q, ring = np.nonzero((least <= room[:, None]) & ~((own[:, None] == c) & (at_home[:, None] == np.arange(len(low)))))
                    if len(q):
                        yield spread(ids, m, q, np.full(len(q), c), ring, limit)

    def compare(table: pa.Table) -> pa.Table:
        own, other = table.filter(table.column("asked")), table.filter(pc.invert(table.column("asked")))
        works = [Nearest(i, m, k, None, own.column("bound").to_numpy()) for i, m in by_length(own, max(1, own.num_rows))]  # of one cell
        return pa.Table.from_batches([_seen(works, by_length(other), found)])

    schema = "id long, v array<double>, cell int, ring int, part int, bound double"
    store = rows.mapInArrow(place, schema)

    def met(copies: DataFrame) -> DataFrame:
        """A block's queries are dealt into parts of ``block``, each with a copy of its stored rows."""
        load = copies.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("load"))
        q = copies.join(load, key).select(*copies.columns, F.pmod(F.xxhash64("id"), F.col("load")).cast("int").alias("deal"), F.lit(True).alias("asked"))
        s = store.join(load, key).select(*copies.columns, F.explode(F.sequence(F.lit(0), F.col("load") - 1)).alias("deal"), F.lit(False).alias("asked"))
        return q.union(s).groupBy(*key, "deal").applyInArrow(compare, found)

    first = stored(_ranked(met(asked.mapInArrow(home, schema)), k), "near")
    known = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("d")).alias("bound"))
    bounded = asked.join(known.withColumnRenamed("query_id", "id"), "id", "left").select("id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    return first.select("query_id", "store_id", "d").union(met(bounded.mapInArrow(away, schema)))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "store_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _sides(queries: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    ship(queries.sparkSession)
    side = lambda df, i, v: df.filter(F.col(i).isNotNull() & usable(v)).select(F.col(i).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"))
    return side(queries, "query_id", "g"), side(store, "store_id", "sg")


def knn(queries: DataFrame, store: DataFrame, k: int, block: int = QUERY_BLOCK, stored_block: int = STORE_BLOCK) -> DataFrame:
    """``query_id, store_id, d, rank``: the k nearest of ``store`` (store_id, sg) by distance, then
    id, for each of ``queries`` (query_id, g). Vectors of different lengths are compared over the
    shorter one; null and empty vectors and such with a component that is null or not finite have no
    neighbours and are nobody's.

    The store is cut into Voronoi cells around centres of a bounded sample. Up to ``block`` queries
    go to the tasks that scan the store in place, and skip cells that can't hold a nearer point.
    More queries are sent to the blocks of cells that can, in two rounds. If lengths differ,
    triangles say nothing, and all blocks of queries meet all of the store; so they do where queries
    that are tried on the sample have to meet more than WORTH of it. The rows are the same. A part of the store
    gives k candidates a query, and only those are ranked.
    """
    asked, rows = _sides(queries, store)
    cells = _cells(rows)
    taken = asked.limit(block + 1).toArrow()  # no more ever come to the driver
    tried = next((m for _, m in by_length(taken, TRIED)), None)
    if cells is not None and (tried is None or tried.shape[1] != cells.centres.shape[1] or cells.share(tried, k) > WORTH):
        cells = None
    if taken.num_rows > block and cells is not None:
        width = asked.select("v").union(rows.select("v")).agg(F.min(F.size("v")), F.max(F.size("v"))).first()
        if width[0] == width[1]:
            return _ranked(_by_cells(asked, rows, cells, k, block, stored_block), k)
    works = lambda parts: [Nearest(i, m, k, cells) for i, m in parts]
    return _ranked(_meet(asked, rows, works, FOUND, block, stored_block, taken), k)


def mean_distance(queries: DataFrame, store: DataFrame, block: int = QUERY_BLOCK, stored_block: int = STORE_BLOCK) -> DataFrame:
    """``query_id, mean_distance`` over the whole store: sums of each part, never pairs."""
    asked, rows = _sides(queries, store)
    taken = asked.limit(block + 1).toArrow()
    found = _meet(asked, rows, lambda parts: [Sums(i, m) for i, m in parts], SUMMED, block, stored_block, taken)
    return found.groupBy("query_id").agg((F.sum("total") / F.sum("n")).alias("mean_distance"))


def lookup_exact(queries: DataFrame, store: DataFrame) -> DataFrame:
    """``query_id, exact_id``: the first stored point that equals the query, or null; points that can
    have no neighbour equal nothing."""
    first = store.filter(usable("sg")).groupBy("sg").agg(F.min("store_id").alias("exact_id"))
    return queries.join(first, queries["g"] == first["sg"], "left").select("query_id", "exact_id")


def nearest_local_first(queries: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """The nearest local point; the nearest remote one only where nothing is local."""
    near = knn(queries, local, 1).select("query_id", F.col("store_id").alias("local_id"), F.col("d").alias("local_d"))
    far = knn(queries, remote, 1).select("query_id", F.col("store_id").alias("remote_id"), F.col("d").alias("remote_d"))
    joined = queries.select("query_id").join(near, "query_id", "left").join(far, "query_id", "left")
    return joined.select("query_id", F.coalesce("local_id", "remote_id").alias("nn_id"), F.coalesce("local_d", "remote_d").alias("d"), F.col("local_id").isNotNull().alias("is_local"))


def _block(points: DataFrame) -> tuple[int, int]:
    """The number of ``points`` (id, v), and how many make a block. A point is copied once a block it
    meets: a share of the table, bounded by memory alone, keeps copies from growing with the points."""
    n, width = points.select(F.count("*"), F.max(F.size("v"))).first()
    return n, max(LEAST_BLOCK, min(MOST_VALUES // max(width or 1, 1), n // BLOCKS))


def _lists(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Ids and vectors in matrices of one width each, by id, and where they hold nulls, if any do; a
    null vector is one null."""
    ids, column = table.column("id").to_numpy(), table.column("v").combine_chunks()
    sizes, flat = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), column.flatten()
    gone, flat = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None, flat.to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    order = np.argsort(ids, kind="stable")
    for n in np.unique(sizes):
        own = order[sizes[order] == n]
        at = starts[own, None] + np.arange(max(n, 0))
        yield ids[own], flat[at], np.ones((len(own), 1), bool) if n < 0 else None if gone is None else gone[at]


def _lost(gone: np.ndarray | None, width: int, least: int) -> np.ndarray | None:
    """Vectors of a width that are null or hold a null among their first ``least`` components."""
    return None if gone is None else (gone if gone.shape[1] > width else gone[:, :least]).any(1)


def _comparer(radius: float | None, one_way: bool):
    """Writes the pairs of two blocks (``id, v, home``) piece by piece. With ``one_way`` the point at
    home is ``a``, and pairs with a >= b are left out; else the lesser id is ``a``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        same = pc.all(pc.equal(table.column("i"), table.column("j"))).as_py() if not one_way else True
        home, away = table.filter(table.column("home")), table.filter(pc.invert(table.column("home")))
        if not home.num_rows or not away.num_rows:
            return
        others = list(_lists(away))
        for ids, v, gone in _lists(home):
            for sid, w, none in others:
                least = min(v.shape[1], w.shape[1])
                left, right = _lost(gone, v.shape[1], least), _lost(none, w.shape[1], least)
                for own in _pieces(len(ids), len(sid)):
                    with np.errstate(invalid="ignore", over="ignore"):
                        d = _distances(v[own], w)
                    a, b = np.broadcast_to(ids[own, None], d.shape), np.broadcast_to(sid, d.shape)
                    keep = a < b if same else a != b
                    if radius is not None:
                        keep &= d < radius
                    a, b = a[keep], b[keep]
                    lost = None if left is None and right is None else ((False if left is None else left[own, None]) | (False if right is None else right[None, :]) | np.zeros(d.shape, bool))[keep]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d[keep], mask=lost)], ["a", "b", "d"])

    return compare


def _compared(both: DataFrame, keys: list[str], radius: float | None, one_way: bool) -> DataFrame:
    """The pairs of each group of blocks. The number of partitions is given, because the work grows
    with the pairs and Spark would put small blocks together by their bytes."""
    spark = both.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return both.repartition(parts, *keys).groupBy(*keys).applyInArrow(_comparer(radius, one_way), "a long, b long, d double")


def pairwise(points: DataFrame) -> DataFrame:
    """``a, b, d`` for all pairs a < b of ``points`` (id, v); what is asked for is quadratic. Points
    are dealt into blocks of neighbouring ids, each pair of blocks is a group of its own, and pairs
    leave it piece by piece in the order of ``a`` and ``b``, of which files then need next to
    nothing. Vectors of different lengths are compared over the shorter one; a null gives null.
    """
    ship(points.sparkSession)
    own = points.filter(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    total, size = _block(own)
    n = max(1, -(-total // size))
    edges = own.select(F.percentile_approx("id", [k / n for k in range(1, n)])).first()[0] if n > 1 else []
    dealt = own.withColumn("blk", F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<bigint>"), lambda edge: edge < F.col("id"))))
    left = dealt.select("id", "v", F.lit(True).alias("home"), F.col("blk").alias("i"), F.explode(F.sequence(F.col("blk"), F.lit(n - 1))).alias("j"))
    right = dealt.select("id", "v", F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("i"), F.col("blk").alias("j"))
    return _compared(left.union(right), ["i", "j"], None, False)


def _every(lists: Column, ends: Column) -> Column:
    """Each of ``lists`` with each of ``ends`` after it."""
    return F.flatten(F.transform(lists, lambda head: F.transform(ends, lambda end: F.concat(head, F.array(end)))))


def radius_pairs(points: DataFrame, radius: float, grid: int = GRID) -> DataFrame:
    """``a, b, d`` for the pairs a < b of ``points`` (id, v) nearer than ``radius``, by an epsilon grid.

    The ``grid`` dimensions of the largest variance cut the space into cells of the radius' width. A
    point has one home cell, and is copied to that and its neighbours; a pair meets in the home cell
    of ``a`` alone, so none comes twice. A cell's points at home and around are dealt into blocks,
    each pair of blocks is a group of its own, and pairs leave it piece by piece. Points that can
    have no neighbour have no pairs; lengths that differ are compared over the shorter vector, whose
    cells then go by the dimensions that all vectors have.
    """
    ship(points.sparkSession)
    own = points.filter(F.col("id").isNotNull() & usable("v")).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    size = _block(own)[1]
    shortest = own.agg(F.min(F.size("v"))).scalar()
    spread = own.select(F.posexplode(F.slice("v", F.lit(1), shortest)).alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("s"))
    dims = [r["dim"] for r in spread.orderBy(F.desc("s"), "dim").limit(grid).collect()]
    at = [F.get("v", F.lit(i)) / radius for i in dims]
    home = F.array(*(F.floor(x).cast("long") for x in at)).cast("array<bigint>")
    around = reduce(_every, (F.array(*(F.floor(x).cast("long") + i for i in (-1, 0, 1))) for x in at), F.array(F.array().cast("array<bigint>")))
    at_home, around = own.select("id", "v", home.alias("cell")), own.select("id", "v", F.explode(around).alias("cell"))
    parts = F.ceil(F.count("*") / size).cast("int")
    load = at_home.groupBy("cell").agg(parts.alias("homes")).join(around.groupBy("cell").agg(parts.alias("guests")), "cell")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = at_home.join(load, "cell").select("id", "v", F.lit(True).alias("home"), "cell", part("homes").alias("i"), every("guests").alias("j"))
    right = around.join(load, "cell").select("id", "v", F.lit(False).alias("home"), "cell", every("homes").alias("i"), part("guests").alias("j"))
    return _compared(left.union(right), ["cell", "i", "j"], radius, True)


def probe(keys: DataFrame, queries: DataFrame, window: int, both_ways: bool = False, per_slice: int = PER_SLICE) -> DataFrame:
    """Candidates ``query_id, store_id``: entries that follow (or surround) a query along each curve.

    ``keys`` holds (curve, hkey, store_id) and ``queries`` (curve, hkey, query_id). Both are put in
    one order per curve, so that every query knows its rank among the stored entries, and a query
    meets entries by rank: an equi-join on (curve, rank), not a range join. Ranks are counted within
    slices, cut where sketches of the first 13 and the next 13 digits say, so a cluster of near keys
    is many slices too, and shifted by the slices' sums.
    """
    rows = keys.select("curve", "hkey", F.col("store_id").alias("id"), F.lit(1).alias("stored"))
    asked = queries.select("curve", "hkey", F.col("query_id").alias("id"), F.lit(0).alias("stored"))
    digits = lambda start: F.conv(F.substring(F.rpad("hkey", 26, "0"), start, 13), 16, 10).cast("double")
    both = sliced(stored(rows.union(asked), "probed-keys").select("*", digits(1).alias("_v"), digits(14).alias("_w")), "_v", "_w", ["curve"], per_slice)
    before = Window.partitionBy("curve").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = both.groupBy("curve", "_s").agg(F.sum("stored").alias("n"))
    base = sums.select("curve", "_s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("curve", "_s").orderBy("hkey", "stored", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("rank", F.sum("stored").over(within)).join(base, ["curve", "_s"]).withColumn("rank", F.col("rank") + F.col("base"))
    entries = placed.filter("stored = 1").select("curve", F.col("rank"), F.col("id").alias("store_id"))
    low = -window + 1 if both_ways else 1
    wanted = placed.filter("stored = 0").select("curve", F.col("id").alias("query_id"), F.explode(F.sequence(F.col("rank") + low, F.col("rank") + window)).alias("rank"))
    return wanted.join(entries, ["curve", "rank"]).select("query_id", "store_id").distinct()


def rerank(candidates: DataFrame, queries: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """The k nearest of the candidates by distance, then id."""
    full = candidates.join(queries.select("query_id", "g"), "query_id").join(store.select("store_id", "sg"), "store_id")
    scored = full.select("query_id", "store_id", V.l2(F.col("g"), F.col("sg")).alias("d"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "store_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def knn_regress(neighbours: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean target weighted by 1 / (distance + 1e-12), and the mean distance."""
    rows = neighbours.join(targets, "store_id").withColumn("w", 1.0 / (F.col("d") + 1e-12))
    return rows.groupBy("query_id").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("prediction"), F.avg("d").alias("mean_distance"))
