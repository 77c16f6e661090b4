"""Phrase collocations from vertical positional inverted lists.

Texts are lower-cased (A to Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
``[^\\x20\\x09]+``. A block of texts is turned into lists: for each frequent word of a language, the
places where it stands. Places count up within a piece and skip one between pieces, so that
neighbours in a piece are one apart and no others are. A frequent phrase is extended by
merge-joining its places with the postings of adjacent words, one place on: the words themselves
at first, later those that end a frequent phrase of the same length there. The length of the
joined list is the exact frequency in the block; a sum over the blocks decides which phrases go on
to the next round, of which there are four.

A phrase is known by its language and words themselves, so no count depends on a hash. A phrase inside a longer one that occurs as often is also inside one that is
one word longer and occurs as often, because frequencies only fall with length: that one is looked
for.

Defined cases: null, empty or separator-only text has no words; a null language is ``und``;
repeated rows count each time; without candidates, or on an empty table, the result is empty; ties
in score and frequency go by the phrase's UTF-8 bytes; ids and extra columns, whatever their names,
aren't read. A very long text is a block of its own, held whole by one task.

Scale: words are counted before the lists are built. Lists are stored by block (``BLOCK_BYTES`` of
text or one text), a row each, and never leave it: rounds shuffle only sums, which each task
combines first, so a word that fills a third of the table is one row a block. With every phrase
frequent a block's row is some five times its text; row groups of a few such rows are written and
read one at a time, however many blocks a task has. Which phrases go on is
told to the blocks by a bit filter of fixed size; a bit that is set without a frequent phrase costs
time, and its lists' extensions can't reach the threshold. Leaders of a language are picked in
shards before they are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from .common import _LOWER, RollingHash, chunks, lean, spread, stored, text_bytes
from .filters import FILTER_BITS, are_set, set_bits

#: Bytes of texts that make a block; the longest phrase; shards of a language's leaders; languages
#: whose totals may be broadcast.
BLOCK_BYTES, LONGEST, SHARDS, LANGS = 1 << 20, 5, 64, 10_000
#: Phrases of a block that are hashed at once.
PIECE = 10_000
_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_APART = _CUT.copy()
_APART[[9, 32]] = True
#: A block's lists: language and phrase of each list with a line feed between (no word holds one),
#: the phrase's last word, where each list ends, and all places.
LISTS = "phrases array<string>, words array<string>, ends binary, places binary"
#: Rows of lists are large: Parquet would look at a row group's size after 100 of them only.
ROW_GROUPS = {"parquet.enable.dictionary": "false", "parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def words_and_places(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a text column, their rows and their places."""
    raw, offsets = text_bytes(column)
    if not len(raw):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw, inside = _LOWER[raw], ~_APART[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    start = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | first[:-1]))
    sizes = np.diff(np.append(np.cumsum(inside, dtype=np.int32)[start] - 1, inside.sum()))
    pieces = np.cumsum(_CUT[raw] | first[:-1], dtype=np.int32)[start]
    places = np.arange(len(start)) + np.concatenate(([0], np.cumsum(np.diff(pieces) != 0))) if len(start) else start
    ends = np.concatenate(([0], np.cumsum(sizes)))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[inside].tobytes())])
    return words.cast(pa.large_string()), np.searchsorted(offsets, start, side="right") - 1, places


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches ``lang, text`` cut and put together to BLOCK_BYTES at most, or one longer text."""
    held, size = [], 0
    for part in (x for batch in batches for x in chunks(batch, limit=BLOCK_BYTES)):
        more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
        if held and size + more > BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(part)
        size += more
    if held:
        yield pa.Table.from_batches(held)


def _postings(table: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Phrases of one word, the words, ends of their lists and places, one list after another."""
    words, rows, places = words_and_places(table.column("text").combine_chunks())
    langs, known = table.column("lang").combine_chunks().dictionary_encode(), words.dictionary_encode()
    keys = np.asarray(known.indices).astype(np.int64) * max(len(langs.dictionary), 1) + np.asarray(langs.indices)[rows]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    last = _lasts(keys)
    word, lang = np.divmod(keys[last], max(len(langs.dictionary), 1))
    word = known.dictionary.take(pa.array(word)).cast(pa.string())
    return _joined(langs.dictionary.take(pa.array(lang)), word, "\n"), word, last + 1, places[order].astype(np.int32)


def _joined(a: pa.Array, b: pa.Array, mark: str) -> pa.Array:
    return pc.binary_join_element_wise(a.cast(pa.string()), b, mark)


def _lasts(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys end."""
    return np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) if len(keys) else np.zeros(0, np.int64)


def _bits(phrases: pa.Array) -> np.ndarray:
    """Hashes of PIECE phrases at a time: their prefix sums take many times the phrases' bytes."""
    out = np.zeros(len(phrases), np.int64)
    for at in range(0, len(phrases), PIECE):
        raw, offsets = text_bytes(phrases.slice(at, PIECE))
        out[at : at + PIECE] = RollingHash(raw).spans(offsets[:-1], offsets[1:]) & np.uint64(FILTER_BITS - 1)
    return out


@lean
def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array(_bits(batch.column("phrase")))], ["bit"])


@lean
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _blocks(batches):
        phrases, _, ends, _ = _postings(table)
        yield pa.record_batch([phrases, pa.array(np.diff(ends, prepend=0), pa.int64())], ["phrase", "n"])


def _block(phrases: pa.Array, words: pa.Array, ends: np.ndarray, places: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The lists whose bit is set, as one row."""
    on, sizes = are_set(bits, _bits(phrases)) if len(phrases) else np.zeros(0, bool), np.diff(ends, prepend=0)
    if on.any():
        mask, listed = pa.array(on), lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        raw = [np.cumsum(sizes[on]).astype(np.int64).tobytes(), places[np.repeat(on, sizes)].tobytes()]
        yield pa.record_batch([listed(phrases.filter(mask)), listed(words.filter(mask)), *(pa.array([x], pa.binary()) for x in raw)], ["phrases", "words", "ends", "places"])


def _listing(bits: np.ndarray):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            yield from _block(*_postings(table), bits)

    return run


def _extended(batch: pa.RecordBatch, row: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases and last words of a block's lists; of the lists that are one word longer, which list
    and which adjacent one make them, ends and places. The lists, merged into the order of places
    where each place has one list, join with themselves one place on."""
    phrases, words = (batch.column(c)[row].values for c in ("phrases", "words"))
    ends, places = (np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in (("ends", np.int64), ("places", np.int32)))
    order = np.argsort(places, kind="stable")
    lists, places = np.repeat(np.arange(len(phrases)), np.diff(ends, prepend=0))[order], places[order]
    met = np.flatnonzero(np.diff(places) == 1)
    pair = lists[met] * len(phrases) + lists[met + 1]
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    last = _lasts(pair)
    first, second = np.divmod(pair[last], max(len(phrases), 1))
    return phrases, words, first, second, last + 1, places[met[order]]


@lean
def _count_longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            phrases, words, first, second, ends, _ = _extended(batch, row)
            n = np.diff(ends, prepend=0)
            for at in range(0, len(n), 50_000):
                a, b = (pa.array(x[at : at + 50_000]) for x in (first, second))
                yield pa.record_batch([_joined(phrases.take(a), words.take(b), " "), pa.array(n[at : at + 50_000], pa.int64())], ["phrase", "n"])


def _extending(bits: np.ndarray):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                phrases, words, first, second, ends, places = _extended(batch, row)
                on = np.zeros(len(first), bool)
                for at in range(0, len(first), PIECE):
                    a, b = (pa.array(x[at : at + PIECE]) for x in (first, second))
                    on[at : at + PIECE] = are_set(bits, _bits(_joined(phrases.take(a), words.take(b), " ")))
                sizes = np.diff(ends, prepend=0)
                adjacent = words.take(pa.array(second[on]))
                longer = _joined(phrases.take(pa.array(first[on])), adjacent, " ")
                yield from _block(longer, adjacent, np.cumsum(sizes[on]), places[np.repeat(on, sizes)], bits)

    return run


def frequent_phrases(docs: DataFrame, least: int, lang_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all phrases of one to LONGEST words that occur ``least`` times,
    and ``lang, n``: all words."""
    ship(docs.sparkSession)
    texts = spread(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    phrase = F.substring_index("phrase", "\n", -1)
    lang = F.left("phrase", F.length("phrase") - F.length(phrase) - 1).alias("lang")
    words = stored(texts.mapInArrow(_count_words, "phrase string, n long").groupBy("phrase").agg(F.sum("n").alias("f")), "word-counts")
    totals = words.groupBy(lang).agg(F.sum("f").alias("n"))
    sums, found = words, []
    for m in range(1, LONGEST + 1):
        found.append(stored(sums.filter(F.col("f") >= least), f"frequent-{m}").withColumn("size", F.lit(m)))
        if m < LONGEST:
            bits = set_bits(found[-1].select("phrase").mapInArrow(_bits_of, "bit long"))
            lists = stored(texts.mapInArrow(_listing(bits), LISTS) if m == 1 else lists.mapInArrow(_extending(bits), LISTS), f"lists-{m}", ROW_GROUPS)
            sums = lists.mapInArrow(_count_longer, "phrase string, n long").groupBy("phrase").agg(F.sum("n").alias("f"))
    return reduce(DataFrame.union, found).select(lang, phrase.alias("phrase"), "size", "f"), totals


def _some(words: Column | str, start: Column | int, n: Column) -> Column:
    return F.concat_ws(" ", F.slice(words, start, n))


def _ranked(rows: DataFrame, top: int, *by: str) -> DataFrame:
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rank = F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = 100, top: int = 2_000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language."""
    every, totals = frequent_phrases(docs, least, lang_col, text_col)
    phrases = every.withColumn("words", F.split("phrase", " "))
    candidates = phrases.filter("size > 1").withColumnRenamed("f", "a")
    few = totals.limit(LANGS + 1).count() <= LANGS
    parts = candidates.join(F.broadcast(totals) if few else totals, "lang").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = parts.select("lang", "phrase", "a", "n", "k", _some("words", F.lit(1), F.col("k")).alias("head"), _some("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    frequency = lambda part, name: phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    scored = cuts.join(frequency("head", "l"), ["lang", "head"]).join(frequency("tail", "r"), ["lang", "tail"])
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    scored = scored.withColumn("over", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).withColumn("under", exact("l") * exact("r"))
    best = scored.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    shorter = F.array(_some("words", F.lit(1), F.col("size") - 1), _some("words", F.lit(2), F.col("size") - 1))
    longer = candidates.filter("size > 2").select("lang", "a", F.explode(shorter).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    left = best.join(covered, ["lang", "phrase"], "left").filter("within is null or within < a")
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SHARDS)).alias("shard"))
    return _ranked(_ranked(left, top, "shard").drop("rank"), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
