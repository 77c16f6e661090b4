"""The corpus pipeline on planted cases, and the queries on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evospark.llm import queries

from .test_operators import _brute_removed, _check_packing, _rated

DATA = "/root/testdata/sf0.001"


def _stage(spark, docs, sf_dir, name):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)


def test_stages_on_planted_cases(spark, tmp_path):
    docs, ratings = _rated(600, 10)
    clean = [t for (i, t), (_, g) in zip(docs, ratings) if g == 2]
    rows = docs + [(1000, clean[0]), (1001, clean[1] + " tail"), (1002, clean[2][:120] + " " + clean[3] + " mail a.b@c.org"), (1003, None)]
    labels = [(i, int(g == 2), int(g == 0)) for i, g in ratings]
    table = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    grade = dict(ratings)

    good = _stage(spark, table, sf, "quality_classifier").cache()
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == table.columns and not any(grade.get(i) == 0 for i in kept)
    assert sum(i in kept for i, g in ratings if g == 2) > 0.97 * len(clean)

    one = _stage(spark, good, sf, "minhash_near_dedup").cache()
    left = {r.doc_id for r in one.collect()}
    assert one.columns == table.columns and 1000 not in left and 1001 not in left and 1002 in left and len(kept) - len(left) <= 4

    cut = _stage(spark, one, sf, "suffix_array_dedup").cache()
    want = _brute_removed([(r.doc_id, r.text) for r in one.collect()])
    for r in cut.collect():
        assert len(r.text.encode()) == want[r.doc_id][0] - want[r.doc_id][1] and r.n_chars == len(r.text)

    clear = _stage(spark, cut, sf, "pii_redaction").cache()
    assert "[EMAIL]" in {r.doc_id: r.text for r in clear.collect()}[1002] and clear.columns == table.columns

    packed = _stage(spark, clear, sf, "best_fit_packing").collect()
    _check_packing(packed, [(r.doc_id, r.text) for r in clear.collect()])
    whole = corpus_pipeline.run(spark, sf)
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(whole.collect()) == key(packed)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_a_row_for_each(spark, name):
    rows = queries.QUERIES[name](spark, DATA)
    source = {"op6": "embeddings", "op9": "pages"}.get(name.split("_")[0], "documents")
    key = rows.columns[0]
    n = spark.read.parquet(f"{DATA}/{source}.parquet").count()
    assert rows.select(key).distinct().count() == n
