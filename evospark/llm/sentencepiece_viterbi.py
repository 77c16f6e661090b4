"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton holds every normal piece. One pass over a text meets, at each position, the pieces
that end there, longest first as the output links lead; each relaxes the best score of its end.
The best segmentation by the sum of scores follows from the pieces kept, and characters that no
piece covers become byte pieces. Where no piece holds a space mark after another character, as in
the usual vocabularies, the marks part a text into units whose segmentations don't depend on each
other; a worker keeps those of the units it met last.

The scores are the model file's. For a BPE model they are merge ranks, and the result is the
segmentation with the best sum of them, the one that the library gives when the same file is read
as a unigram model; it isn't the result of BPE merges.

Defined cases: null and empty text has no pieces and decodes to the empty text; repeated rows each
get their row; an empty table gives an empty result; extra columns are ignored. A text that holds
the space mark itself decodes to spaces, as in the library.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import chunks, lean, pick

PIECES = "piece_bpe_32k.model"
MARK = "▁"
#: Units that a worker keeps, and how far below the lowest score an uncovered character counts.
KEPT, UNKNOWN = 400_000, 10.0

_models: dict[str, Model] = {}


class Model(dict):
    """Unit -> its ids as little-endian unsigned 32-bit numbers; missing units are segmented."""

    def __init__(self, path: str):
        super().__init__()
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        scores = [lib.get_score(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(n)]
        is_byte = [lib.is_byte(i) for i in range(n)]
        normal = [i for i in range(n) if not special[i] and not is_byte[i]]
        self.unknown_id = lib.unk_id()
        self.byte_ids = {int(names[i][3:-1], 16): i for i in range(n) if is_byte[i]}
        self.bytes_of = [b"" if special[i] else bytes((int(names[i][3:-1], 16),)) if is_byte[i] else names[i].encode() for i in range(n)]
        self.lowest = min(scores[i] for i in normal) - UNKNOWN
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(names[i], (len(names[i]), scores[i], i))
        self.automaton.make_automaton()
        apart = not any(MARK in names[i].lstrip(MARK) for i in normal)
        self.units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if apart else "(?s:.+)").findall

    def segment(self, unit: str) -> list[int]:
        """The best ids of one unit; among equals, the longest last piece."""
        best, back, piece, done = [0.0], [0], [-1], 0  # positions up to ``done`` can be reached
        lowest = self.lowest
        for last, (size, score, i) in self.automaton.iter(unit):
            end = last + 1
            while done < end:  # a character that no piece covers
                best.append(best[done] + lowest)
                back.append(done)
                piece.append(-1)
                done += 1
            found = best[end - size] + score
            if found > best[end]:
                best[end], back[end], piece[end] = found, end - size, i
        for at in range(done, len(unit)):
            back.append(at)
            piece.append(-1)
        out, at = [], len(unit)
        while at:
            start, i = back[at], piece[at]
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte_ids.get(b, self.unknown_id) for b in reversed(unit[start:at].encode())]
            at = start
        out.reverse()
        return out

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        found = array("I", self.segment(unit)).tobytes()
        self[unit] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.units(MARK + text.replace(" ", MARK)))) if text else b""

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").replace(MARK, " ")[1:]


def model(path: str) -> Model:
    """One model per Python worker."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _run(path: str, with_ids: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in chunks(batch):
                texts = part.column("text").to_pylist()
                ids = [m.encode(t) for t in texts]
                decoded = [m.decode(x) for x in ids]
                columns = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array([a == b for a, b in zip(decoded, texts)], pa.bool_())]
                names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
                if with_ids:
                    columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.record_batch(columns, names)

    return run


def encode(docs: DataFrame, model_path: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, round_trip`` and, unless left out, ``ids, decoded``."""
    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>, decoded string" * with_ids
    return pick(docs, id_col, text_col).mapInArrow(_run(model_path or public_tokenizers.path(PIECES), with_ids), schema)
