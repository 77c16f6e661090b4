"""Best-fit packing with a swap-based local search.

Documents become token ids plus one end id; only those longer than a sequence are cut, into full
pieces behind a first piece that takes the remainder. Pieces are interchangeable by length, so the
plan is made on the histogram of lengths, which has one entry per length whatever the number of
documents: best-fit decreasing places whole runs of equal lengths into whole runs of equal bins,
then a local search exchanges one-for-one, two-for-one or moves pieces between underfull bins.
Every move raises the sum of squared fills, so the search ends; bins that empty are dropped.
Pieces take their places by their rank within their length.

Defined cases: null and empty text is the end id alone; repeated rows are packed as rows of their
own; an empty table gives an empty result; a null id stays null; extra columns are ignored.

Scale: the texts are read once and never shuffled. Ranks come from per-task counts (one row for
each task and length), the plan goes to tasks as arrays whose size depends on the number of
lengths, and the rows keep the order they were written in.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_bpe import default_path, engine
from .common import lean, pick, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of ``n`` ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(i, capacity) for i in range(first, n, capacity)]


def _cutter(path: str, capacity: int, end_id: int):
    @lean
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, seen = engine(path).ids, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = np.append(ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(found), capacity)):
                    out.append((doc_id, k, start, n, zlib.crc32(found[start : start + n]), part, int(seen[n])))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*out)) or [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    return pieces


class Plan:
    """Bins by content: a sorted tuple of lengths -> how many bins hold it."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.bins = self._search(self._best_fit(histogram))

    def _best_fit(self, histogram: dict[int, int]) -> dict[tuple[int, ...], int]:
        room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # bins by free space

        def put(content: tuple[int, ...], n: int, free: int) -> None:
            room[free][content] = room[free].get(content, 0) + n

        for length in sorted(histogram, reverse=True):
            left = histogram[length]
            while left:
                free = min((f for f in room if f >= length and room[f]), default=None)
                if free is None:
                    each = self.capacity // length
                    if left >= each:
                        put((length,) * each, left // each, self.capacity - each * length)
                        left %= each
                    else:
                        put((length,) * left, 1, self.capacity - left * length)
                        left = 0
                    continue
                content, n = room[free].popitem()
                fit = min(free // length, left)
                used = min(n, left // fit)
                if n > used:
                    put(content, n - used, free)
                put((*content, *(length,) * fit), used, free - fit * length)
                left -= used * fit
        out: dict[tuple[int, ...], int] = defaultdict(int)
        for group in room.values():
            for content, n in group.items():
                out[tuple(sorted(content))] += n
        return out

    def _search(self, bins: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], int]:
        """Fullest underfull bins take from the emptiest ones until no exchange helps."""
        work = dict(bins)
        stuck: set[tuple[tuple[int, ...], tuple[int, ...]]] = set()
        while True:
            open_bins = sorted((b for b in work if sum(b) < self.capacity), key=lambda b: (-sum(b), b))
            for giver in reversed(open_bins):
                found = next((x for x in ((taker, self._exchange(taker, giver)) for taker in open_bins if (taker, giver) not in stuck and (taker != giver or work[taker] > 1)) if x[1] or stuck.add((x[0], giver))), None)
                if found:
                    break
            else:
                return work
            taker, (fuller, emptier) = found
            n = work[taker] // 2 if taker == giver else min(work[taker], work[giver])
            for content, change in ((taker, -n), (giver, -n), (fuller, n), (emptier, n)):
                if content:
                    work[content] = work.get(content, 0) + change
                    if not work[content]:
                        del work[content]

    def _exchange(self, taker: tuple[int, ...], giver: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """The move, one-for-one or two-for-one exchange that fills ``taker`` most."""
        free, fill, other = self.capacity - sum(taker), sum(taker), sum(giver)
        out_sets = [(), *((x,) for x in set(taker)), *((a, b) for i, a in enumerate(taker) for b in taker[i + 1 :])]
        in_sets = [*((x,) for x in set(giver)), *((a, b) for i, a in enumerate(giver) for b in giver[i + 1 :])]
        best, gain = None, 0
        for put in out_sets:
            for get in in_sets:
                if len(put) + len(get) > 3 or (not put and len(get) > 1):
                    continue
                d = sum(get) - sum(put)
                if 0 < d <= free and d > gain and (fill + d) ** 2 + (other - d) ** 2 > fill**2 + other**2:
                    best, gain = (put, get), d
        if not best:
            return None

        def swapped(content, drop, add):
            rest = list(content)
            for x in drop:
                rest.remove(x)
            return tuple(sorted((*rest, *add)))

        return swapped(taker, best[0], best[1]), swapped(giver, best[1], best[0])

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of ranks: (length << 40 | first rank), its bin, the ranks per bin, its offset."""
        nxt: dict[int, int] = defaultdict(int)
        rows, base = [], 0
        for content, n in sorted(self.bins.items()):
            at = 0
            for length in content:
                rows.append((length << 40 | nxt[length], base, at))
                nxt[length] += n
                at += length
            base += n
        rows.sort()
        return tuple(np.array(c, np.int64) for c in (zip(*rows) if rows else ((), (), ())))


def _placer(places: tuple[np.ndarray, ...]):
    keys, bins, offsets = places

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            key = length << 40 | rank
            at = np.searchsorted(keys, key, side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(bins[at] + key - keys[at]), pa.array(offsets[at])], [*names, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, capacity: int = 1024, tokenizer_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece."""
    pieces = stored(pick(docs, id_col, text_col).mapInArrow(_cutter(tokenizer_path or default_path(), capacity, end_id), PIECES), "pieces")
    by_task = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = Plan(histogram, capacity).places()
    before = by_task.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("local") + F.col("before"))
    return ranked.mapInArrow(_placer(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
