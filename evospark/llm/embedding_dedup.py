"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

Equal vectors are folded into one with a weight first. For each length of vectors a spherical
k-means, fitted on a bounded sample, gives each vector its home cell and the cells whose bisector
with the home cell lies within ``margin`` of it. A linked pair lies within a chord of
sqrt(2 - 2 * 0.95) = 0.316; for any direction that leads from one cell to another, the two distances
to the bisector add up to no more than the chord's part in that direction, so the default, half the
chord (0.158), loses no pair at all.

Cells are compared in blocks: home vectors of a cell with all vectors in it, a block of each to a
task's group. A pair that meets in two cells counts in the smaller one. Blocks give each vector's
number of links and a forest that spans the links, never all pairs.

Defined cases: null or zero vectors and vectors with null or non-finite components link with
nothing; finite vectors of any size do (each is scaled by a power of two first); only vectors of one length are compared; equal vectors of different ids link, rows of one
id don't link with each other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import lean, stored
from .graph import components

#: Rows that the k-means is fitted on, cells at most, vectors to a cell and to a block.
SAMPLE, CELLS, PER_CELL, BLOCK = 32_768, 2_048, 128, 1_024


def fit_cells(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids; an empty cell takes a row of the sample anew."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 2048))])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1)
        empty = norms < 1e-12
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centres = sums / np.linalg.norm(sums, axis=1)[:, None]
    return centres


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # exact; squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1)[:, None]


def _assign(cells: dict[int, tuple[int, np.ndarray]], margin: float):
    # a closure of the centroids alone, by length with their first number: their distances are made
    # for the rows at hand
    @lean
    def assign(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                first, centres = cells[d]
                own = batch.take(pa.array(np.flatnonzero(dims == d)))
                for at in range(0, own.num_rows, 1024):
                    yield placed(own.slice(at, 1024), first, centres)

    def placed(part, first, centres):
        dots = _unit(part.column("embedding")) @ centres.T
        home = dots.argmax(1)
        gaps = np.sqrt(np.maximum(2 - 2 * centres[home] @ centres.T, 1e-18))
        away = (dots[np.arange(len(home)), home][:, None] - dots) / gaps
        near = away <= margin
        near[np.arange(len(home)), home] = True
        row, cell = np.nonzero(near)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(near.sum(1)))), pa.int32()), pa.array(cell + first, pa.int32()))
        return pa.record_batch([part.column("id"), part.column("weight"), part.column("embedding"), pa.array(home + first, pa.int32()), lists], ["id", "weight", "embedding", "home", "cells"])

    return assign


def _compare(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("id").to_numpy()
        weight, home, left = (table.column(c).to_numpy() for c in ("weight", "home", "is_left"))
        cells = table.column("cells").to_pylist()
        cell = table.column("cell")[0].as_py()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        unit = _unit(table.column("embedding").combine_chunks())
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        x, y = np.nonzero(unit[a] @ unit[b].T >= threshold)
        x, y = a[x], b[y]
        keep = ids[x] != ids[y]
        # home vectors of this cell meet twice, once with either as the left one: the smaller id counts
        keep &= (home[y] != cell) | (ids[x] < ids[y])
        x, y = x[keep], y[keep]
        away = np.flatnonzero(home[y] != cell)
        if len(away):  # this pair may meet in the other one's home cell too
            reach: dict[int, set[int]] = {}
            drop = [k for k in away.tolist() if home[y[k]] < cell and home[y[k]] in reach.setdefault(x[k], set(cells[x[k]]))]
            x, y = np.delete(x, drop), np.delete(y, drop)
        links = np.bincount(x, weights=weight[y], minlength=len(ids)) + np.bincount(y, weights=weight[x], minlength=len(ids))
        root = np.arange(len(ids))
        while len(x):  # labels over the links of this block
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        used = np.flatnonzero(links > 0)
        return pa.table({"id": pa.array(ids[used]), "links": pa.array(links[used].astype(np.int64)), "root": pa.array(ids[root[used]])})

    return compare


def link_vectors(df: DataFrame, threshold: float = 0.95, margin: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, per_cell: int = PER_CELL, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row; see the module's notes."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("embedding", F.when(good, F.col("embedding")))
    plain = [F.col("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    if margin is None:
        margin = float(np.sqrt(max(0.0, (1 - threshold) / 2))) + 1e-6
    ids = rows.filter("embedding is not null").groupBy("vec_id", "embedding").agg(F.count("*").alias("own"))
    vectors = stored(ids.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.sum("own").alias("weight"), F.size("embedding").alias("dims")), "vectors")
    sizes = vectors.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect()  # a row for each length
    if not sizes:
        return rows.select(*plain)
    cells, first = {}, 0
    for d, n in sizes:
        k = max(1, min(CELLS, n // per_cell, sample))
        if k == 1:
            centres = np.full((1, d), d**-0.5)
        else:
            taken = vectors.filter(F.col("dims") == d).orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow().column("embedding").combine_chunks()
            centres = fit_cells(_unit(taken), k)
        cells[d] = (first, centres)
        first += k
    placed = stored(vectors.mapInArrow(_assign(cells, margin), f"id long, weight long, embedding {dict(vectors.dtypes)['embedding']}, home int, cells array<int>"), "placed")
    in_cell = placed.select("*", F.explode("cells").alias("cell")).withColumn("at_home", F.col("cell") == F.col("home"))
    counts = F.broadcast(in_cell.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("at_home").alias("n_home")))  # a row for each of at most CELLS cells a length
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")
    in_cell = in_cell.join(counts, "cell").select("*", F.pmod(F.xxhash64("id", "cell"), blocks("n")).cast("int").alias("own"), F.pmod(F.xxhash64("cell", "id"), blocks("n_home")).cast("int").alias("own_home"))
    columns = ["cell", "id", "weight", "embedding", "home", "cells"]
    lefts = in_cell.filter("at_home").select(*columns, F.lit(True).alias("is_left"), F.col("own_home").alias("i"), F.explode(F.sequence(F.lit(0), blocks("n") - 1)).alias("j"))
    rights = in_cell.withColumn("cells", F.lit(None).cast("array<int>")).select(*columns, F.lit(False).alias("is_left"), F.explode(F.sequence(F.lit(0), blocks("n_home") - 1)).alias("i"), F.col("own").alias("j"))
    found = stored(lefts.union(rights).groupBy("cell", "i", "j").applyInArrow(_compare(threshold), "id long, links long, root long"), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    folded = stored(vectors.join(links, "id", "left").join(reached, "id", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "folded")
    linked = ids.join(folded, "embedding").select("vec_id", (F.col("n_links") + 1 - F.col("own")).alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), F.explode(F.array_repeat(F.lit(0), F.col("own").cast("int")))).drop("col")
    return linked.union(rows.filter("embedding is null").select(*plain))
