"""Byte-level BPE encoding and decoding in padded matrices.

A text is split by the tokenizer's pattern, and each distinct match of a chunk becomes a row of
byte ids. Rows of about one length are padded to one matrix, which goes through rounds: every row
merges its leftmost pair of minimum rank, found by a hashed lookup of the pairs that may merge;
rows without such a pair leave the matrix, and columns that no row reaches any more go too. A
match above ``WIDE`` bytes is a matrix of its own whose pairs are folded into rows of ``FOLD``;
the rows' minima are kept, so that a round looks at one row and the minima. A worker keeps the
ids of the matches that it met last.

Ranks are ids, as in the files of the ``tiktoken`` library, whose ids these are; special strings
in a text are ordinary text. Decoding concatenates the ids' bytes.

Defined cases: null and empty text has no ids and decodes to no bytes; a null list of ids decodes
to no bytes, an id that the vocabulary doesn't have raises ``ValueError``; a null document id
stays null; repeated rows each get their row; an empty table gives an empty result; extra columns
are ignored, whatever their names. A very long text is a chunk of its own and is held whole by one
task. Ties in rank are one pair at several places, of which the leftmost goes first.

Scale: one pass over the scan's partitions, no shuffle; a task holds a chunk of texts and at most
``KEPT`` matches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, pick

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Matches a worker keeps; cells of one matrix; the longest row of a shared matrix; a fold's width.
KEPT, CELLS, WIDE, FOLD = 200_000, 1 << 20, 1_024, 256
NONE = np.iinfo(np.int32).max
_EMPTY, _SPIN = np.uint64(2**64 - 1), np.uint64(0x9E3779B97F4A7C15)

_encoders: dict[tuple[str, str], Encoder] = {}


def _ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[start : start + size]``."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class PairTable:
    """(left id, right id) -> the id of their merger: open addressing in arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.ids = np.full(1 << self.bits, _EMPTY), np.full(1 << self.bits, NONE, np.int32)
        left = np.fromiter((a for a, _ in pairs), np.uint64, len(pairs))
        right = np.fromiter((b for _, b in pairs), np.uint64, len(pairs))
        keys = left << np.uint64(32) | right
        for key, slot, i in zip(keys, self._slots(keys).tolist(), pairs.values()):
            while self.keys[slot] != _EMPTY:
                slot = (slot + 1) & (1 << self.bits) - 1
            self.keys[slot], self.ids[slot] = key, i

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPIN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the mergers, NONE where there is none; negative ids are padding."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo].astype(np.uint64) << np.uint64(32) | right[todo].astype(np.uint64)
        slots = self._slots(keys)
        while len(todo):
            met = self.keys[slots]
            hit = met == keys
            out[todo[hit]] = self.ids[slots[hit]]
            on = ~hit & (met != _EMPTY)
            todo, keys, slots = todo[on], keys[on], (slots[on] + 1) & (1 << self.bits) - 1
        return out.reshape(shape)


class Encoder:
    """Ids of texts by the ranks of a file, and bytes of ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes((b,))] for b in range(256)], np.int32)
        self.pairs = {(ranks[token[:i]], ranks[token[i:]]): rank for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks}
        self.table = PairTable(self.pairs)
        by_id = {rank: token for token, rank in ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.known = np.array([i in by_id for i in range(len(tokens))])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids of each row of a padded matrix, one after another, and their numbers."""
        n, width = rows.shape
        out, sizes = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        live, ranks = np.arange(n), self.table.find(rows[:, :-1], rows[:, 1:]) if width > 1 else np.full((n, 0), NONE, np.int32)
        while True:
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE, np.int32)
            done = best == NONE
            if done.any():  # compaction of rows
                out[live[done], : rows.shape[1]] = rows[done]
                sizes[live[done]] = (rows[done] >= 0).sum(1)
                live, rows, ranks, at, best = live[~done], rows[~done], ranks[~done], at[~done], best[~done]
                if not len(live):
                    return out[out >= 0], sizes
            own = np.arange(len(rows))
            rows[own, at] = best
            columns = np.arange(rows.shape[1] - 1)
            rows = np.take_along_axis(rows, columns + (columns > at[:, None]), 1)  # without the pair's right
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= at[:, None]), 1)
            for side in (at - 1, at):  # the pairs beside the merger
                there = (side >= 0) & (side < ranks.shape[1])
                i, j = own[there], side[there]
                ranks[i, j] = self.table.find(rows[i, j], rows[i, j + 1])
            used = int((rows >= 0).sum(1).max())  # compaction of columns
            rows, ranks = rows[:, :used], ranks[:, : max(used - 1, 0)]

    def merge_wide(self, ids: np.ndarray) -> np.ndarray:
        """The same for one long row, folded."""
        n = len(ids)
        ranks = np.full((n + FOLD - 1) // FOLD * FOLD, NONE, np.int32)
        ranks[: n - 1] = self.table.find(ids[:-1], ids[1:])
        folded, flat = ranks.reshape(-1, FOLD), ids.tolist()
        minima = folded.min(1)
        after, before, find = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs.get
        while True:
            row = int(minima.argmin())
            if minima[row] == NONE:
                break
            at = row * FOLD + int(folded[row].argmin())
            flat[at], gone = int(ranks[at]), after[at]
            after[at] = following = after[gone]
            flat[gone], ranks[gone] = -1, NONE
            if following < n:
                before[following] = at
            ranks[at] = find((flat[at], flat[following]), NONE) if following < n else NONE
            prior = before[at]
            if prior >= 0:
                ranks[prior] = find((flat[prior], flat[at]), NONE)
            for x in {row, gone // FOLD, max(prior, 0) // FOLD}:
                minima[x] = folded[x].min()
        merged = np.array(flat, np.int32)
        return merged[merged >= 0]

    def merged(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each match, one after another, and their numbers."""
        lengths = np.fromiter(map(len, matches), np.int64, len(matches))
        raw = self.byte_ids[np.frombuffer(b"".join(matches), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        bucket = np.where(lengths > WIDE, -1, np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        sizes, parts = np.zeros(len(matches), np.int64), []
        for b in np.unique(bucket).tolist():
            of = np.flatnonzero(bucket == b)
            step = max(1, CELLS >> b) if b >= 0 else 1
            for part in (of[i : i + step] for i in range(0, len(of), step)):
                if b < 0:
                    ids = self.merge_wide(raw[starts[part[0]] : starts[part[0]] + lengths[part[0]]])
                    sizes[part] = len(ids)
                else:
                    columns = np.arange(lengths[part].max())
                    inside = columns < lengths[part][:, None]
                    ids, sizes[part] = self.merge_rows(np.where(inside, raw[np.minimum(starts[part][:, None] + columns, len(raw) - 1)], -1))
                parts.append((part, ids))
        flat, at = np.zeros(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
        for part, ids in parts:
            n = sizes[part]
            flat[np.repeat(at[part] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return flat, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each text's."""
        matches: list[str] = []
        counts = []
        for text in texts:
            found = self.split(text)
            counts.append(len(found))
            matches += found
        if len(self.index) > KEPT:
            self.forget()
        fresh = list(set(matches).difference(self.index))
        if fresh:
            flat, sizes = self.merged([m.encode() for m in fresh])
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, flat))
        codes = np.fromiter(map(self.index.__getitem__, matches), np.int64, len(matches))
        sizes = self.sizes[codes]
        before = np.concatenate(([0], np.cumsum(sizes)))
        bounds = before[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
        return _ragged(self.flat, self.starts[codes], sizes), np.diff(bounds)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids, which stand one after another."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.token_sizes[ids]
        raw = _ragged(self.token_bytes, self.token_starts[ids], sizes).tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)].tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def default_path() -> str:
    return public_tokenizers.path(RANKS)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))


def _encoding(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part in chunks(batch):
                yield pa.record_batch([part.column("doc_id"), _lists(*own.encode(part.column("text").to_pylist()))], ["doc_id", "ids"])

    return run


def _decoding(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            ids = batch.column("ids")
            counts = np.asarray(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            content = pa.array(own.decode(ids.flatten().to_numpy(zero_copy_only=False), counts), pa.binary())
            columns = [batch.column("doc_id"), *([ids] if keep_ids else []), content]
            yield pa.record_batch(columns, ["doc_id", *(["ids"] if keep_ids else []), "content"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hexed = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())
    for batch in batches:
        ids = batch.column("ids")
        raw, ends = ids.flatten().to_numpy().astype("<u4"), np.cumsum(ids.value_lengths().to_numpy()).tolist()
        own = [raw[a:b] for a, b in zip([0, *ends], ends)]
        yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) for x in own], pa.int64()), hexed(own), hexed(x.as_py() for x in batch.column("content"))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row."""
    return pick(docs, id_col, text_col).mapInArrow(lean(_encoding(ranks_path or default_path(), pattern)), "doc_id long, ids array<int>")


def decode(rows: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, content``: the bytes of the ids of every row."""
    own = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return own.mapInArrow(lean(_decoding(ranks_path or default_path(), public_tokenizers.PATTERN, False)), "doc_id long, content binary")


def report(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded, decoded again and digested in one
    pass, so that neither ids nor bytes leave the Python worker."""
    path = ranks_path or default_path()
    encoding, decoding = _encoding(path, pattern), _decoding(path, pattern, True)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _digests(decoding(encoding(batches)))

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
