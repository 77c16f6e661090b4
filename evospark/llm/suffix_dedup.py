"""Suffix-array dedup: bytes of 50-byte strings that an earlier document holds are removed.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document with a
smaller id, judged on the input. What decides is the longest-previous-factor array over documents:
in suffix order, the previous and the next suffix of a smaller document give the longest earlier
match of each position. Suffix arrays are built over bounded groups that provably hold all the
matches between their members:

1. Anchors. Of the ``gram``-byte strings in each ``length``-byte window the one with the least hash
   is an anchor, so equal windows have equal anchors. An anchor's context is the union of the
   windows that hold it.
2. Anchors meet by hash, packed into one row for each task's chunk and bucket. Occurrences with an
   equal context in a smaller document are covered as a whole. A context that differs from another
   one of its anchor in a different document goes on, once, from the first document that has it.
3. Contexts of an anchor meet in a group, where the suffix array of their concatenation, to a depth
   of ``length``, and the previous and next smaller documents in it give the positions that repeat.
4. Anchors with more than ``HOT`` different contexts would make a group too large: their windows
   meet one by one, by a hash of 128 bits, in sums that combine before the shuffle.

Windows whose first occurrence is in document m are in m's contexts and in those of any later
document, whatever the other contexts look like, so no match is missed; all four ways only cover
bytes of true matches. Contexts, windows and whole texts are equal if 64, 128 or 256 bits of hash
are.

Defined cases: null and empty text has nothing to remove; repeated rows (same id and text) don't
remove each other; an empty table gives an empty result; texts under ``length`` bytes stay; a null
id counts as the largest; extra columns are ignored (``remove`` keeps them); different texts are
taken to have different ids.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, chunks, lean, mix, pick, stored, text_bytes, to_signed
from .filters import bits_of, is_set, keep, with_bit

LENGTH, GRAM = 50, 20
#: Bytes of text to a bucket of anchors, contexts to a group, contexts of one anchor in a group.
BUCKET_BYTES, GROUP, HOT = 8_000_000, 10_000, 10_000
#: Bytes of text to a task of groups.
TASK_BYTES = 64_000_000
NO_ID = 2**63 - 1
RUNS = "id long, starts array<int>, ends array<int>"


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every window of ``width`` values, by doubling."""
    out, size = a, 1
    while size * 2 <= width:
        out = op(out[:-size], out[size:])
        size *= 2
    n, rest = len(a) - width + 1, width - size
    return op(out[:n], out[rest : rest + n])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Position, row, context start and end, anchor hash and context hash of every anchor."""
    n, width = len(raw), length - gram + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolling = RollingHash(raw)
    start = np.arange(n - gram + 1)
    h = rolling.spans(start, start + gram)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    broken = row[: n - gram + 1] != row[gram - 1 :]
    least = _slide(np.where(broken, np.uint64(2**64 - 1), h), width, np.minimum)
    least[row[: n - length + 1] != row[length - 1 :]] = 0  # not a window of one text
    edge = np.zeros(width - 1, np.uint64)
    top = _slide(np.concatenate((edge, least, edge)), width, np.maximum)
    at = np.flatnonzero((top == h) & ~broken)
    lo = np.maximum(at + gram - length, offsets[row[at]])
    hi = np.minimum(at + length, offsets[row[at] + 1])
    context = mix(rolling.spans(lo, hi) + (at - lo).astype(np.uint64))
    return at, row[at], lo, hi, h[at], context


def _merged(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals within each group; intervals that touch become one."""
    if not len(group):
        return group, start, end
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    edge = np.concatenate(([True], group[1:] != group[:-1]))
    big = np.int64(1) << 40
    base = np.cumsum(edge) * big
    reach = np.maximum.accumulate(end + base)
    fresh = edge.copy()
    fresh[1:] |= (start + base)[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(group)) - 1
    return group[first], start[first], (reach - base)[last]


def _lists(ids: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """A row for each id (equal ids are adjacent) with lists of the values."""
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    ends = pa.array(np.append(first, len(ids)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in values]
    return [pa.array(ids[first], pa.int64()), *lists]


PACKED = "bucket int, h binary, c binary, doc binary, pos binary, span binary, id long, starts array<int>, ends array<int>"


def _packer(length: int, gram: int, buckets: int, words: np.ndarray):
    """A chunk's anchors of one bucket in a row; and, in rows without anchors, what is covered by an
    equal context in a smaller document of the same chunk."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(is_set(words, batch)))
            for part in chunks(batch):
                raw, offsets = text_bytes(part.column("text"))
                at, row, lo, hi, h, c = anchors(raw, offsets, length, gram)
                if not len(at):
                    continue
                doc, base = part.column("id").to_numpy()[row], offsets[row]
                # groups of equal (h, c); were two groups to share a key, they would only be split
                order = np.argsort(mix(h + c * np.uint64(0x9E3779B97F4A7C15)))
                hs, cs, ds = h[order], c[order], doc[order]
                fresh = np.concatenate(([True], (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])))
                first = np.minimum.reduceat(ds, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
                later = order[ds > first]
                rest = np.sort(order[ds == first])
                g, s, e = _merged(doc[later], (lo - base)[later], (hi - base)[later])
                covered = _lists(g, s, e)
                bucket = (h[rest] % np.uint64(buckets)).astype(np.int32)
                by = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
                rest, bucket = rest[by], bucket[by]
                cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                columns = [(h[rest] // np.uint64(buckets)).astype(np.uint32), c[rest], doc[rest], (at - base)[rest].astype(np.int32), ((at - lo)[rest] << 8 | (hi - at)[rest]).astype(np.uint16)]
                packed = [[x[i:j].tobytes() for i, j in zip(cuts, [*cuts[1:], len(rest)])] for x in columns]
                k, m = len(cuts), len(covered[0])
                nothing = pa.nulls(m, pa.binary())
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate((bucket[cuts], (mix(covered[0].to_numpy().astype(np.uint64)) % np.uint64(buckets)).astype(np.int32))), pa.int32()),
                        *(pa.concat_arrays([pa.array(x, pa.binary()), nothing]) for x in packed),
                        pa.concat_arrays([pa.nulls(k, pa.int64()), covered[0]]),
                        *(pa.concat_arrays([pa.nulls(k, pa.list_(pa.int32())), x.cast(pa.list_(pa.int32()))]) for x in covered[1:]),
                    ],
                    ["bucket", "h", "c", "doc", "pos", "span", "id", "starts", "ends"],
                )

    return run


FOUND = "id long, starts array<int>, ends array<int>, open array<int>, groups array<int>, hot array<int>"


def _matcher(gram: int, groups: int, hot: int):
    """A bucket's anchors: what equal contexts cover, and the anchors whose contexts go on."""

    fields = [("id", pa.int64()), *((n, pa.list_(pa.int32())) for n in ("starts", "ends", "open", "groups", "hot"))]
    none = lambda n: pa.nulls(n, pa.list_(pa.int32()))

    def found(rows: list) -> pa.Table:
        return pa.concat_tables(pa.table({n: x.cast(t) for x, (n, t) in zip(r, fields)}) for r in rows)

    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_null(table.column("h"))).combine_chunks()
        table = table.filter(pc.is_valid(table.column("h")))
        rows = [[*(known.column(n) for n in ("id", "starts", "ends")), *[none(known.num_rows)] * 3]]
        if not table.num_rows:
            return found(rows)
        get = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        h, c, doc, pos, span = get("h", np.uint32), get("c", np.uint64), get("doc", np.int64), get("pos", np.int32), get("span", np.uint16)
        # by h, then by half of c: contexts that share the half and not the rest are only split
        order = np.argsort(h.astype(np.uint64) << np.uint64(32) | c >> np.uint64(32))
        h, c, doc, pos, span = h[order], c[order], doc[order], pos[order].astype(np.int64), span[order].astype(np.int64)
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        new_c = new_h | np.concatenate(([True], c[1:] != c[:-1]))
        of_h, of_c = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
        at_h = np.flatnonzero(new_h)
        many = np.minimum.reduceat(doc, at_h) != np.maximum.reduceat(doc, at_h)
        contexts = np.bincount(of_h, weights=new_c)
        first = np.minimum.reduceat(doc, np.flatnonzero(new_c))[of_c]
        covered = doc > first
        going = ~covered & (many & (contexts > 1))[of_h]
        crowded = (contexts > hot)[of_h]
        g, s, e = _merged(doc[covered], (pos - (span >> 8))[covered], (pos + (span & 255))[covered])
        ids, starts, ends = _lists(g, s, e)
        rows.append([ids, starts, ends, none(len(ids)), none(len(ids)), none(len(ids))])
        mixed = mix(h.astype(np.uint64) + np.uint64(1)) % np.uint64(groups)
        for mask, place in ((going & ~crowded, 3), (going & crowded, 5)):
            by = np.argsort(doc[mask], kind="stable")
            ids, p, m = _lists(doc[mask][by], pos[mask][by], mixed[mask][by].astype(np.int32))
            row = [ids, *[none(len(ids))] * 5]
            row[place] = p
            if place == 3:
                row[4] = m
            rows.append(row)
        return found(rows)

    return run


def _contexts(length: int, gram: int):
    """A row for each context that goes on: its group, document, start and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups, starts, context = [], [], [], []
            for doc, text, at, group in zip(*(batch.column(x) for x in ("id", "text", "open", "groups"))):
                raw = text.as_py().encode()
                for p, g in zip(at.as_py(), group.as_py()):
                    lo = max(0, p + gram - length)
                    ids.append(doc.as_py())
                    groups.append(g)
                    starts.append(lo)
                    context.append(raw[lo : p + length])
            yield pa.record_batch([pa.array(groups, pa.int32()), pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(context, pa.binary())], ["grp", "id", "start", "context"])

    return run


def suffix_ranks(raw: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Dense ranks of the suffixes of ``raw`` by their first ``depth`` bytes, by prefix doubling; a
    suffix ends at its ``ends`` entry and sorts before any that goes on."""
    n = len(raw)
    left = ends - np.arange(n)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate((raw.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)))
    for k in range(7):
        key = key * np.uint64(257) + np.where(left > k, padded[k : k + n], 0)

    def dense(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (x[order][1:] != x[order][:-1]).astype(np.int64)))) + 1
        return rank

    rank, size = dense(key), 7
    while size < depth:
        step = min(size, depth - size)
        beyond = np.where(left > step, np.concatenate((rank[step:], np.zeros(step, np.int64))), 0)
        rank = dense(rank * np.int64(n + 2) + beyond)
        size += step
    return rank


def repeats(raw: np.ndarray, ends: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Where the longest previous factor, over smaller documents, has ``length`` bytes or more.

    In suffix order, suffixes that agree in ``length`` bytes are neighbours; the previous smaller
    and next smaller document of a suffix within its run are running minima from either side.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, bool)
    rank = suffix_ranks(raw, ends, length)
    order = np.argsort(rank)
    _, small = np.unique(doc, return_inverse=True)
    d, run = small[order], rank[order]
    big = np.int64(len(d) + 2)
    before = np.minimum.accumulate(d - run * big) + run * big
    back = run.max() - run
    after = (np.minimum.accumulate((d - back * big)[::-1]) + (back * big)[::-1])[::-1]
    found = np.zeros(n, bool)
    found[order] = (before < d) | (after < d)
    return found & (ends - np.arange(n) >= length)


def _grouped(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        context = pa.chunked_array(table.column("context")).combine_chunks()
        raw, offsets = text_bytes(context)
        n = np.diff(offsets)
        where = np.repeat(np.arange(len(n)), n)
        doc, start = table.column("id").to_numpy()[where], table.column("start").to_numpy()[where].astype(np.int64)
        hit = np.flatnonzero(repeats(raw, offsets[1:][where], doc, length))
        s = start[hit] + hit - offsets[:-1][where[hit]]
        g, s, e = _merged(doc[hit], s, s + length)
        ids, starts, ends = _lists(g, s, e)
        return pa.table({"id": ids, "starts": starts, "ends": ends})

    return run


def _windows(length: int, gram: int):
    """The windows of the contexts of crowded anchors, by a hash of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                raw, offsets = text_bytes(part.column("text"))
                at = part.column("hot").combine_chunks() if isinstance(part.column("hot"), pa.ChunkedArray) else part.column("hot")
                n = np.diff(at.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), n)
                p = at.flatten().to_numpy().astype(np.int64) + offsets[row]
                lo, hi = np.maximum(p + gram - length, offsets[row]), np.minimum(p, offsets[row + 1] - length)
                count = np.maximum(hi - lo + 1, 0)
                row = np.repeat(row, count)
                start = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                key = np.unique(row * (len(raw) + 1) + start)
                row, start = key // (len(raw) + 1), key % (len(raw) + 1)
                one = RollingHash(raw).spans(start, start + length)
                two = RollingHash(raw ^ np.uint8(0x5A)).spans(start, start + length)
                yield pa.record_batch([pa.array(to_signed(one)), pa.array(to_signed(two)), pa.array(part.column("id").to_numpy()[row]), pa.array((start - offsets[row]).astype(np.int32))], ["w1", "w2", "id", "start"])

    return run


def find_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, group: int = GROUP, hot: int = HOT) -> DataFrame:
    """``id, starts, ends``: byte intervals to remove, a row for each document that has any; they
    may overlap or touch. The id of a row without one is the largest number."""
    rows = pick(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    spark = docs.sparkSession
    sizes = stored(rows.select("id", F.octet_length("text").alias("n"), F.unhex(F.sha2("text", 256)).alias("digest")), "sizes")
    firsts = stored(sizes.groupBy("digest").agg(F.min("id").alias("first"), F.first("n").alias("n")), "firsts")
    total = firsts.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-total // bucket_bytes))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (length - gram) // group)
    copies = sizes.join(firsts.select("digest", "first"), "digest").filter((F.col("id") > F.col("first")) & (F.col("n") >= length)).select("id", F.array(F.lit(0)).alias("starts"), F.array("n").alias("ends"))

    # texts that are surely later copies of another one have nothing to add
    words = bits_of(firsts.select(F.col("first").alias("id")))
    packed = with_bit(rows).mapInArrow(_packer(length, gram, buckets, words), PACKED)
    # a bucket is a task, however many there are
    found = stored(packed.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(_matcher(gram, groups, hot), FOUND), "found")
    covered = [copies, found.filter("starts is not null").select("id", "starts", "ends")]

    going = stored(found.filter("open is not null or hot is not null").groupBy("id").agg(F.flatten(F.collect_list("open")).alias("open"), F.flatten(F.collect_list("groups")).alias("groups"), F.flatten(F.collect_list("hot")).alias("hot")), "going")
    wanted = keep(rows, bits_of(going))
    texts = wanted.join(going, "id")
    contexts = texts.filter(F.size("open") > 0).select("id", "text", "open", "groups").mapInArrow(_contexts(length, gram), "grp int, id long, start int, context binary")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)
    covered.append(contexts.repartition(tasks, "grp").groupBy("grp").applyInArrow(_grouped(length), RUNS))
    if going.filter(F.size("hot") > 0).limit(1).count():
        windows = stored(texts.filter(F.size("hot") > 0).select("id", "text", "hot").mapInArrow(_windows(length, gram), "w1 long, w2 long, id long, start int"), "windows")
        shared = stored(windows.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last"), "shared-windows")
        covered.append(windows.join(shared, ["w1", "w2"]).filter("id > first").select("id", F.array("start").alias("starts"), F.array(F.col("start") + length).alias("ends")))
    runs = covered[0]
    for more in covered[1:]:
        runs = runs.union(more)
    return stored(runs.groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")), "runs")


def _spans(starts: list[int] | None, ends: list[int] | None) -> list[tuple[int, int]]:
    """Maximal intervals, in order."""
    if not starts:
        return []
    _, s, e = _merged(np.zeros(len(starts), np.int64), np.array(starts, np.int64), np.array(ends, np.int64))
    return list(zip(s.tolist(), e.tolist()))


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    out.append(raw[at:])
    return b"".join(out)


def _summary(words: np.ndarray | None = None):
    """Digests of what is left; with ``words``, of the rows that no interval is for."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if words is not None:
                batch = batch.filter(pa.array(~is_set(words, batch)))
            sizes, removed, counts, digests = [], [], [], []
            none = ((None, None) for _ in range(batch.num_rows))
            lists = none if words is not None else zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist())
            for text, (s, e) in zip(batch.column("text"), lists):
                raw = text.as_py().encode()
                spans = _spans(s, e)
                rest = kept_bytes(raw, spans)
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                counts.append(len(spans))
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.record_batch([batch.column("id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(digests, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row."""
    rows = pick(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    runs = find_runs(docs, id_col=id_col, text_col=text_col)
    words, schema = bits_of(runs), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    whole = with_bit(rows).mapInArrow(_summary(words), schema)
    cut = keep(rows, words).join(runs, "id", "left").mapInArrow(_summary(), schema)
    return whole.union(cut).select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the bytes to remove; bytes of a character that lost others go with them."""
    runs = find_runs(docs, id_col=id_col, text_col=text_col)
    names = docs.columns
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, s, e in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                texts.append(text if text is None or not s else kept_bytes(text.encode(), _spans(s, e)).decode("utf-8", "ignore"))
            columns = [batch.column(k) for k in range(len(names))]
            columns[where] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names)

    key, starts, ends = (f"_{c}_{uuid.uuid4().hex}" for c in ("id", "starts", "ends"))  # no column of ``docs``
    keyed = runs.select(F.col("id").alias(key), F.col("starts").alias(starts), F.col("ends").alias(ends))
    joined = docs.join(keyed, F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)) == keyed[key], "left").select(*(docs[c] for c in names), starts, ends)
    return joined.mapInArrow(run, docs.schema)
