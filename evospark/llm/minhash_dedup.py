"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A text's set holds its distinct word shingles. The sketch has ``BANDS * ROWS`` coordinates and is
filled in rounds: in each of the first t rounds an element throws its hash into one hashed bin, in
the last t rounds into one fixed bin each, and a bin keeps the least (round, hash). A set stops
after the round that leaves no bin empty, so that large sets are hashed once and small ones fill
every coordinate all the same; coordinates agree with the probability of the Jaccard similarity,
with the concentration of independent ones. Bands of coordinates give buckets, and every link is
confirmed on the full sets.

Texts with equal sets are one class from the start. Within a bucket every class is compared with
the bucket's least one; components of the links follow. Where a bucket then still holds several
components, its sets are open: a pair of them could be linked. Open sets of one family (joined by
comparisons of 50 percent or more) are compared in blocks, inside tasks, which give a forest of
links; open sets of different families are paired by prefix filtering, only where they share one
of their rarest elements (a linked pair must) and their sizes allow a link. So no link that a
bucket shows is lost, and no bucket or family becomes rows for all its pairs. At a similarity of
0.85 all bands miss a pair with probability (1 - 0.85^5)^25 = 4e-7.

Defined cases: a text without words, null or empty, has an empty set and links with nothing; with
fewer words than a shingle has, the whole sequence is the one shingle; repeated rows are linked;
an empty table gives an empty result; extra columns are ignored; different texts are taken to have
different ids; a null id stays null and never stands for its class unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, RollingHash, chunks, lean, mix, pick, stored, text_bytes, to_signed, words_of
from .filters import bits_of, is_set, with_bit
from .graph import components

BANDS, ROWS = 25, 5
NO_ID = 2**63 - 1
#: Hashed counts of elements, a fixed number, that order them by rarity.
COUNTERS = 1 << 18
#: The similarity, in percent, that makes a family of compared sets, and the sets of its blocks.
RELATED, FAMILY = 50, 1_024


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle of ``width`` words, in order of row and hash."""
    raw, offsets = text_bytes(column)
    raw = _LOWER[raw]
    start, end, row = words_of(raw, offsets)
    word = RollingHash(raw).spans(start, end)
    n = np.bincount(row, minlength=len(column))
    full = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :]) if len(row) >= width else np.zeros(0, np.int64)
    value = np.zeros(len(full), np.uint64)
    for k in range(width):
        value = mix(value + word[full + k])
    first = np.concatenate(([0], np.cumsum(n)))
    short_rows, short = np.flatnonzero((n > 0) & (n < width)), []
    for r in short_rows:
        h = np.zeros(1, np.uint64)
        for k in range(first[r], first[r + 1]):
            h = mix(h + word[k : k + 1])
        short.append(mix(h + np.uint64(n[r])))
    rows = np.concatenate((row[full], short_rows))
    values = np.concatenate((value, *short)) if short else value
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[fresh], values[fresh]


def sketch(rows: np.ndarray, values: np.ndarray, n: int, t: int) -> np.ndarray:
    """``(n, t)`` coordinates; rows without elements keep the largest value."""
    empty = np.uint64(2**64 - 1)
    out = np.full(n * t, empty)
    shift = np.uint64(64 - (2 * t).bit_length())  # rounds come before hashes
    for i in range(2 * t):
        if not len(rows):
            break
        h = mix(values + np.uint64((i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, rows * t + bins, np.uint64(i) << shift | mix(h) >> (np.uint64(64) - shift))
        waiting = (out.reshape(n, t) == empty).any(1)
        keep = waiting[rows]
        rows, values = rows[keep], values[keep]
    return out.reshape(n, t)


def band_hashes(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = coordinates.reshape(-1, bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), parts.shape[:2])
    for k in range(rows):
        h = mix(h + parts[:, :, k])
    return h


def _sketcher(width: int, bands: int, rows: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                n = part.num_rows
                row, value = shingles(part.column("text"), width)
                count = np.bincount(row, minlength=n)
                sums = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
                for k, s in enumerate(sums):
                    np.add.at(s, row, mix(value + np.uint64(k + 1)))
                h = band_hashes(sketch(row, value, n, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(to_signed(np.ascontiguousarray(h)).ravel()))
                yield pa.record_batch([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(to_signed(sums[0])), pa.array(to_signed(sums[1])), lists], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return run


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id, elements``, a row for each id asked for (and some more that share a bit with one): the
    full sets, kept once for all that follows."""
    words = bits_of(ids)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(is_set(words, batch)))
            for part in chunks(batch):
                row, value = shingles(part.column("text"), width)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.record_batch([part.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(to_signed(value)))], ["id", "elements"])

    rows = with_bit(docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text"))
    return stored(rows.mapInArrow(run, "id long, elements array<long>").groupBy("id").agg(F.first("elements").alias("elements")), "sets")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int, related: int | None = None) -> DataFrame:
    """Of the distinct pairs ``a < b``, those whose full sets are at least ``related`` percent similar,
    and whether they are linked. Nothing follows the joins, so that Spark may split the partition of
    a set that is in very many pairs."""
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("of_b")), "b")
    joined = joined.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("of_a")), "a")
    both = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    either = F.size("of_a") + F.size("of_b") - both
    rows = joined.select("a", "b", (100 * both >= percent * either).alias("linked"), (100 * both >= F.lit(related or percent) * either).alias("related"))
    return stored(rows.filter("related").select("a", "b", "linked"), "confirmed")


def _family_links(percent: int):
    """Links between different components among two blocks of a family, as a forest.

    Elements that two sets share become bits, so that a pair costs a row of ANDs; pairs stay in
    the task, and a row for each linked set comes out.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        get = lambda c: table.column(c).to_numpy()
        ids, comp, block = get("id"), get("component"), get("block")
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        lists = table.column("elements").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        row, value = np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy()
        _, at, times = np.unique(value, return_inverse=True, return_counts=True)
        shared = times >= 2
        place = np.cumsum(shared) - 1
        keep = shared[at]
        words = max(1, -(-int(shared.sum()) // 64))
        bits = np.zeros((len(n), words), np.uint64)
        bit = place[at[keep]]
        np.bitwise_or.at(bits, (row[keep], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        size = n.astype(np.int64)
        xs, ys = [], []
        step = max(1, 4_000_000 // max(1, len(right) * words))
        for k in range(0, len(left), step):
            x = left[k : k + step]
            both = np.bitwise_count(bits[x][:, None, :] & bits[right][None, :, :]).sum(-1, dtype=np.int64)
            either = size[x][:, None] + size[right][None, :] - both
            u, v = np.nonzero((100 * both >= percent * either) & (comp[x][:, None] != comp[right][None, :]))
            xs.append(x[u])
            ys.append(right[v])
        x, y = np.concatenate(xs or [left[:0]]), np.concatenate(ys or [right[:0]])
        root = np.arange(len(ids))
        while len(x):
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[moved]), "b": pa.array(ids[root[moved]])})

    return run


def _within_families(sets: DataFrame, open_ids: DataFrame, families: DataFrame, reached: DataFrame, percent: int) -> DataFrame:
    """Links across components between open sets of one family, compared in blocks of ``FAMILY``."""
    own = open_ids.join(families, "id").join(reached, "id", "left").select("id", "family", F.coalesce("component", "id").alias("component"))
    own = stored(own, "family-members")
    sizes = own.groupBy("family").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    own = own.join(stored(sizes.select("family", F.ceil(F.col("n") / FAMILY).cast("int").alias("blocks")), "families"), "family")
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = own.join(sets, "id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("family", "id", "component", "elements", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return stored(rows.groupBy("family", "i", "j").applyInArrow(_family_links(percent), "a long, b long"), "family-links")


def link_documents(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row: classes of texts linked at a Jaccard
    similarity of ``percent`` / 100 or more on shingles of ``width`` words."""
    docs = pick(docs, id_col, text_col)
    sketched = stored(docs.mapInArrow(_sketcher(width, bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "sketches")
    key = F.coalesce("doc_id", F.lit(NO_ID)).alias("id")
    classes = stored(sketched.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min(key).alias("id"), F.first("n_shingles").alias("n")), "classes")
    own = sketched.filter("n_shingles > 0").select("d1", "d2", key, "bands").join(classes, ["d1", "d2", "id"], "left_semi")
    entries = stored(own.select("id", F.explode("bands").alias("bucket")), "buckets")
    leaders = stored(entries.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("other")).filter("leader <> other").select("bucket", "leader"), "leaders")
    members = stored(entries.join(leaders, "bucket"), "members")
    first = stored(members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    sets = _sets(docs, stored(members.select("id").distinct(), "wanted"), width)
    compared = _confirmed(sets, first, percent, RELATED)
    links = compared.filter("linked").select("a", "b")
    reached = components(links)
    open_ids = stored(_open(members, reached).select("id").distinct(), "open-ids")
    if open_ids.limit(1).count():
        families = components(compared).withColumnRenamed("component", "family")
        links = links.union(_within_families(sets, open_ids, families, reached, percent))
        rest = _across(sets, open_ids, families, reached, classes, first, percent)
        reached = components(links.union(_confirmed(sets, rest, percent).select("a", "b")))
    labelled = stored(classes.join(reached, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component")), "labelled")
    alone = sketched.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    found = sketched.filter("n_shingles > 0").join(labelled, ["d1", "d2"], "left")
    component = F.nullif("component", F.lit(NO_ID))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")).union(alone)


def _prefixes(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """``bucket, id``: the elements of which two sets of these ids share one if they are linked.

    A linked pair shares percent / 100 of either set at least, so under one order of all elements
    both have a common one among their first n - ceil(n * percent / 100) + 1. Any order is right;
    rare elements first leaves few pairs, and a table of ``COUNTERS`` hashed counts is enough to
    know which are rare.
    """
    sets = stored(sets.join(ids, "id", "left_semi"), "open-sets")

    def slots(column: pa.Array) -> np.ndarray:
        return (mix(column.flatten().to_numpy().view(np.uint64)) % np.uint64(COUNTERS)).astype(np.int64)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(slots(batch.column("elements")), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["slot", "n"])

    table = sets.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[table.column("slot").to_numpy()] = table.column("n").to_numpy()

    @lean
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("elements")
            n = np.diff(column.offsets.to_numpy())
            row, value = np.repeat(np.arange(len(n)), n), column.flatten().to_numpy()
            order = np.lexsort((value, counts[slots(column)], row))
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            taken = order[place < (n - -(-n * percent // 100) + 1)[row]]
            yield pa.record_batch([pa.array(value[taken]), batch.column("id").take(pa.array(row[taken]))], ["bucket", "id"])

    return sets.mapInArrow(first, "bucket long, id long")


def _open(members: DataFrame, reached: DataFrame) -> DataFrame:
    """Members, with their component, of the buckets that hold several; ``main`` is the largest."""
    own = stored(members.join(reached, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component")), "bucket-components")
    sizes = own.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = stored(sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("bucket", "main"), "main-components")
    return own.join(main, "bucket")


def _across(sets: DataFrame, ids: DataFrame, families: DataFrame, reached: DataFrame, classes: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """Pairs of different families and components that share a rare element and whose sizes allow
    a link, less those compared before."""
    rows = _open(_prefixes(sets, ids, percent), reached).join(classes.select("id", "n"), "id").join(families, "id", "left")
    rows = stored(rows.withColumn("family", F.coalesce("family", "id")), "open-members")
    left = rows.filter("component <> main").select("bucket", F.col("id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("family").alias("fx"))
    right = rows.select("bucket", F.col("id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("family").alias("fy"))
    fits = F.lit(100) * F.least("nx", "ny") >= F.lit(percent) * F.greatest("nx", "ny")
    apart = (F.col("cx") != F.col("cy")) & (F.col("fx") != F.col("fy"))
    pairs = left.join(right, "bucket").filter(apart & fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return stored(pairs.join(done, ["a", "b"], "left_anti"), "pairs-across")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class; of equal rows all that have its id."""
    found = link_documents(docs, width, percent, id_col=id_col, text_col=text_col).filter("kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(found, id_col, "left_semi").union(docs.filter(F.col(id_col).isNull()))
