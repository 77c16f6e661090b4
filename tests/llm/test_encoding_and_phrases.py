"""Matrix BPE against the library, and collocations against a brute-force count."""

import base64
import collections
import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evospark.llm import bpe_matrix, collocations

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe_matrix.default_path(), "rb"))}
LIB = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe_matrix.encoder(bpe_matrix.default_path(), public_tokenizers.PATTERN)
rng = random.Random(5)
HARD = ["", "a", "x" * 60_000, "ab" * 3_000, "".join(rng.choice("abcde") for _ in range(5_000)), "".join(rng.choice("aé😀ß中 \n") for _ in range(5_000)), " " * 2_000, "\n \n" * 700, "it's 'S I'll  we've\x85　x\x1c​", "<|endoftext|>", "!" * 1_500, "0123456789" * 200, "\x00\x00﻿İİı"]


def lists(texts):
    ids, counts = OWN.encode(texts)
    out, at = [], 0
    for n in counts.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_ids_are_the_librarys():
    assert lists(HARD) == [LIB.encode_ordinary(t) for t in HARD]
    OWN.forget()
    assert lists(HARD[::-1]) == [LIB.encode_ordinary(t) for t in HARD[::-1]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=200), max_size=4))
def test_ids_of_any_text(texts):
    assert lists(texts) == [LIB.encode_ordinary(t) for t in texts]
    ids, counts = OWN.encode(texts)
    assert OWN.decode(ids, counts) == [t.encode() for t in texts]


def test_wide_rows_give_what_shared_ones_do():
    for text in ("abab" * 200, "".join(rng.choice("aab") for _ in range(900)), "z" * 1_000):
        raw = OWN.byte_ids[list(text.encode())]
        assert OWN.merge_wide(raw).tolist() == OWN.merge_rows(raw[None, :])[0].tolist() == LIB.encode_ordinary(text)


def test_bpe_report_and_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(100, None), (3, HARD[3]), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "content": F.lit(1), "n_tokens": F.lit(2)})
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = []
    for i, t in rows:
        ids = LIB.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe_matrix.report(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    back = bpe_matrix.decode(bpe_matrix.encode(docs)).collect()
    assert sorted(bytes(r["content"]) for r in back) == sorted((t or "").encode() for _, t in rows)
    assert bpe_matrix.report(docs.limit(0)).collect() == []


def test_decoding_odd_ids(spark):
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["content"]) for r in bpe_matrix.decode(null).collect()] == [b"", b""]
    with pytest.raises(ValueError):
        OWN.decode(bpe_matrix.np.array([len(RANKS) + 5]), bpe_matrix.np.array([1]))


# Collocations


def brute(rows, least, top):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= f[p[i:j]]}
        kept = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts(n=240, seed=9):
    rng = random.Random(seed)
    words = ["the", "of", "new", "york", "city", "État", "x1", "The", "a-b", "naïve"]
    common = "in the City of new york; and so ON"
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "fr", None])
        body = " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rng.randint(0, 60)))
        rows.append((lang, body + (" " + common if rng.random() < 0.3 else "")))
    return rows + [("en", None), (None, ""), ("de", " \t\n.,;"), ("en", "aa " * 5_000), ("fr", "Mot"), ("en", rows[0][1]), ("en", rows[0][1])]


@pytest.mark.parametrize("least,top", [(3, 40), (20, 2_000), (100_000, 5)])
def test_collocations_by_brute_force(spark, least, top, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"n": F.lit("clash"), "block": F.lit(0), "words": F.lit(1), "doc_id": F.lit(None).cast("long")}).repartition(5)
    got = sorted(tuple(r) for r in collocations.mine(docs, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, least, top)


def test_small_blocks_and_shards_change_nothing(spark, monkeypatch):
    rows = texts(120, 4)
    monkeypatch.setattr(collocations, "LANGS", 0)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(9)
    got = sorted(tuple(r) for r in collocations.mine(docs, 4, 30).collect())
    assert got == brute(rows, 4, 30)


def test_no_collocations_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None)], "lang string, text string"), 1).collect() == []


def test_exact_beyond_64_bits(spark):
    """The score's products are decimals: 1000 * a * n and l * r of 10^12 words."""
    row = spark.range(1).select(F.expr("cast(1000 as decimal(4,0)) * cast(999999999999 as decimal(18,0)) * cast(1000000000000 as decimal(18,0)) div (cast(999999999999 as decimal(18,0)) * cast(2 as decimal(18,0)))").alias("s")).first()
    assert row["s"] == 1000 * 999_999_999_999 * 10**12 // (999_999_999_999 * 2)


def test_phrases_are_hashed_in_pieces(monkeypatch):
    import pyarrow as pa

    from evospark.llm import collocations as C

    phrases, seen, plain = pa.array([f"en\nword {i}" for i in range(25_000)]), [], C.RollingHash
    monkeypatch.setattr(C, "RollingHash", lambda raw: seen.append(len(raw)) or plain(raw))
    got = C._bits(phrases)
    assert max(seen) < 250_000 and len(got) == 25_000 and got[24_999] == C._bits(phrases.slice(24_999))[0]


def test_blocks_hold_so_many_bytes_or_one_text(monkeypatch):
    import pyarrow as pa

    from evospark.llm import collocations as C

    monkeypatch.setattr(C, "BLOCK_BYTES", 1_000)
    texts = ["ab " * 30] * 50 + ["", "long " * 400] + ["c"] * 5
    batch = pa.record_batch([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    blocks = [t.column("text").to_pylist() for t in C._blocks([batch, batch.slice(0, 0), batch])]
    assert [x for b in blocks for x in b] == texts * 2
    assert all(sum(map(len, b)) <= 1_000 or [x for x in b if x] == [texts[51]] for b in blocks)
    assert len(blocks) < 25 and list(C._blocks([])) == []


def test_row_groups_of_lists_are_bounded_where_every_phrase_is_frequent(spark, monkeypatch):
    """A task's blocks were one row group, which the writer and the reader hold whole."""
    import pyarrow.parquet as pq

    files, plain = [], collocations.stored
    monkeypatch.setattr(collocations, "spread", lambda df: df.coalesce(1))
    monkeypatch.setattr(collocations, "stored", lambda df, name, *more: files.append((name, (out := plain(df, name, *more)).inputFiles())) or out)
    draw = random.Random(3)
    rows = [("en", " ".join(f"w{draw.randrange(20_000)}" for _ in range(80_000))) for _ in range(16)]
    every, totals = collocations.frequent_phrases(spark.createDataFrame(rows, "lang string, text string"), 1, "lang", "text")
    assert [tuple(r) for r in totals.collect()] == [("en", 16 * 80_000)] and every.filter("size = 2").agg(F.sum("f")).first()[0] == 16 * 79_999
    groups = [meta.row_group(i).total_byte_size for name, paths in files if name.startswith("lists") for p in paths for meta in [pq.read_metadata(p.removeprefix("file://").removeprefix("file:"))] for i in range(meta.num_row_groups)]
    assert len(groups) > 8 and max(groups) < 16 << 20
