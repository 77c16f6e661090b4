"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are ordered grades (0 toxic, 1 poor, 2 good). One weight vector over hashed words, their stems and a few
measures of a text is shared by all grades; ordered thresholds cut its score:
``P(grade <= k) = sigmoid(threshold_k - score)``. The model gives an expected grade and the tail
probability of the best grade, which decides what is kept.

The fit uses a bounded sample of rated rows, the first ``sample`` by a hash of their id; whatever
else is computed covers every row. Texts are never shuffled: the sampled ids go to the texts.

Defined cases: a text without words isn't kept and has grade 0; a row whose id is null is scored
like any other; repeated rows each get their row; ratings with null parts or without a text count
for nothing; without any rating every text with words is kept and grades are null; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, chunks, lean, pick, text_bytes, words_of

#: Hashed words and stems, measures, rows of the fit at most, rows that a word needs in the fit and
#: the share of rows beyond which it says nothing, and the lengths of stems in bytes.
SLOTS, MEASURES, SAMPLE, LEAST_ROWS, COMMON = 1 << 18, 32, 8_000, 4, 0.2
STEMS = (4, 5, 6)
#: Shares are small numbers: they weigh so many times more.
SCALE = 5.0
GRADES = 3
#: Rows of the fit that are summed at a time.
AT_ONCE = 500

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Word endings that are measured, each as the share of words that end so.
_ENDINGS = b"*!%&$#|.,?:;"


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and slot of every distinct word and stem of a row, and the rows' measures."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    start, end, row = words_of(raw, offsets)
    words = np.bincount(row, minlength=n).astype(np.float64)
    per_word = np.maximum(words, 1)
    measures = np.zeros((n, MEASURES))
    measures[:, 0] = np.log1p(words) / 10
    if len(start):
        last = raw[end - 1]
        for k, byte in enumerate(_ENDINGS):
            measures[:, 1 + k] = np.bincount(row[last == byte], minlength=n) / per_word
        upper = np.concatenate(([0], np.cumsum((raw >= 65) & (raw <= 90))))
        lower = np.concatenate(([0], np.cumsum((raw >= 97) & (raw <= 122))))
        digit = np.concatenate(([0], np.cumsum((raw >= 48) & (raw <= 57))))
        shouts = (upper[end] - upper[start] >= 2) & (lower[end] == lower[start])
        measures[:, 20] = np.bincount(row[shouts], minlength=n) / per_word
        measures[:, 21] = np.bincount(row, weights=end - start, minlength=n) / per_word / 20
        measures[:, 22] = np.bincount(row[digit[end] > digit[start]], minlength=n) / per_word
        stop = end.copy()
        for _ in range(4):  # the word without up to four marks at its end
            stop -= _PUNCTUATION[raw[stop - 1]] & (stop - 1 > start)
        measures[:, 24] = np.bincount(row[end - stop >= 2], minlength=n) / per_word
        rolling = RollingHash(_FOLD[raw])
        word = rolling.spans(start, stop)
        again = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1]))
        measures[:, 25] = np.bincount(row[again], minlength=n) / per_word
        place = lambda h: (h >> np.uint64(20)).astype(np.int64) % SLOTS
        measures[:, 23] = np.bincount(np.unique(row * SLOTS + place(word)) // SLOTS, minlength=n) / per_word
        keys = [row * SLOTS + place(word)]
        for size in STEMS:
            longer = stop - start > size
            keys.append(row[longer] * SLOTS + place(rolling.spans(start[longer], start[longer] + size) * np.uint64(2 * size + 1)))
        key = np.unique(np.concatenate(keys))
        row, slot = key // SLOTS, key % SLOTS
        measures[:, 1:] *= SCALE
    else:
        slot = np.zeros(0, np.int64)
    return row, slot, measures


@dataclass
class Model:
    weights: np.ndarray
    measures: np.ndarray
    thresholds: np.ndarray

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all grades but the last."""
        return 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None], -40, 40)))

    def score(self, row: np.ndarray, slot: np.ndarray, measures: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=self.weights[slot], minlength=len(measures)) + measures @ self.measures


def fit(row: np.ndarray, slot: np.ndarray, measures: np.ndarray, grade: np.ndarray, rounds: int = 250, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Adam over all rows at once; thresholds stay ordered as a first one and positive steps."""
    n = len(grade)
    rows_of = np.bincount(slot, minlength=SLOTS)
    frequent = (rows_of >= LEAST_ROWS) & (rows_of <= max(COMMON * n, LEAST_ROWS))
    used = np.flatnonzero(frequent)
    place = np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)  # among the used slots
    parts = []  # some rows at a time, so that no step needs an array of all words
    for first in range(0, n, AT_ONCE):
        last = min(first + AT_ONCE, n)
        a, b = np.searchsorted(row, (first, last))
        at = place[slot[a:b]]
        parts.append((first, last, (row[a:b] - first)[at >= 0].astype(np.int32), at[at >= 0]))
    model = Model(np.zeros(len(used)), np.zeros(MEASURES), np.zeros(GRADES - 1))
    params = np.zeros(len(used) + MEASURES + GRADES - 1)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=GRADES))[:-1] / n, 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(GRADES - 1))
    params[-(GRADES - 1)] = cuts[0]
    params[-(GRADES - 2) :] = np.log(np.maximum(np.diff(cuts), 1e-2))
    first, second = np.zeros_like(params), np.zeros_like(params)
    every = np.arange(n)
    for t in range(1, rounds + 1):
        model.weights = params[: len(used)]
        model.measures = params[len(used) : len(used) + MEASURES]
        steps = np.exp(params[-(GRADES - 2) :])
        model.thresholds = params[-(GRADES - 1)] + np.concatenate(([0], np.cumsum(steps)))
        score = np.concatenate([np.bincount(r, weights=model.weights[at], minlength=last - first) for first, last, r, at in parts]) + measures @ model.measures
        cdf = np.hstack((np.zeros((n, 1)), model.below(score), np.ones((n, 1))))
        hi, lo = cdf[every, grade + 1], cdf[every, grade]
        p = np.maximum(hi - lo, 1e-9)
        by_score = (hi + lo - 1) / n  # of the negative log likelihood
        by_cut = np.zeros((n, GRADES + 1))
        by_cut[every, grade + 1] -= hi * (1 - hi) / p
        by_cut[every, grade] += lo * (1 - lo) / p
        by_cut = by_cut.sum(0)[1:-1] / n
        by_slot = sum(np.bincount(at, weights=-by_score[first:last][r], minlength=len(used)) for first, last, r, at in parts)
        g = np.concatenate((by_slot, -(measures.T @ by_score), [by_cut.sum()], [by_cut[k + 1 :].sum() * steps[k] for k in range(GRADES - 2)]))
        g[: len(used)] += decay * params[: len(used)]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        params = params - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(SLOTS)
    weights[used] = model.weights
    return Model(weights, model.measures, model.thresholds)


@lean
def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            row, slot, measures = text_features(part.column("text"))
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.record_batch([part.column("doc_id"), part.column("grade"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(slot, pa.int32())), pa.array(list(measures), pa.list_(pa.float64()))], ["doc_id", "grade", "slots", "measures"])


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """``ratings`` holds ``doc_id`` and an int ``grade``; None without a rated text."""
    chosen = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).dropna().filter(F.col("grade").between(0, GRADES - 1))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    rows = pick(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # ``sample`` rows at most
    table = rows.select("doc_id", "text", "grade").mapInArrow(_vectors, "doc_id long, grade int, slots array<int>, measures array<double>").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])  # sums in one order
    if not table.num_rows:
        return None
    lists = table.column("slots").combine_chunks()
    row = np.repeat(np.arange(table.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    measures = np.array(table.column("measures").to_pylist())
    slot = lists.flatten().to_numpy()
    return fit(row, slot, measures, table.column("grade").to_numpy().astype(np.int64))


def _scorer(model: Model | None):
    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                row, slot, measures = text_features(part.column("text"))
                blank = np.bincount(row, minlength=part.num_rows) == 0
                if model is None:
                    none = np.ones(part.num_rows, bool)
                    expected, tail = np.zeros(part.num_rows), np.where(blank, 0.0, 1.0)
                else:
                    none = np.zeros(part.num_rows, bool)
                    below = model.below(model.score(row, slot, measures))
                    below[blank] = 1.0
                    expected, tail = (1 - below).sum(1), 1 - below[:, -1]
                yield pa.record_batch([part.column("doc_id"), pa.array(expected, mask=none), pa.array(tail, mask=none), pa.array(tail >= 0.5)], ["doc_id", "expected_grade", "p_good", "kept"])

    return score


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, p_good, kept`` for every row."""
    return pick(docs, id_col, text_col).mapInArrow(_scorer(model), "doc_id long, expected_grade double, p_good double, kept boolean")


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    from ..session import ship

    ship(docs.sparkSession)
    score = _scorer(model)

    @lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(text_col).cast(pa.string()), "")
            rows = pa.record_batch([pa.nulls(batch.num_rows, pa.int64()), text], ["doc_id", "text"])
            kept = [x.column("kept") for x in score(iter([rows]))]
            yield batch.filter(pa.concat_arrays(kept)) if kept else batch

    return docs.mapInArrow(keep, docs.schema)


def grades(labels: DataFrame) -> DataFrame:
    """Grades of the ``labels`` table: 0 toxic, 1 not toxic but poor, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
