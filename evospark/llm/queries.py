"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_matrix, collocations, embedding_dedup, html_extract, minhash_dedup, packing, pii, quality, sentencepiece_viterbi, suffix_dedup, tiff, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.grades(_table(spark, sf_dir, "labels")))
    return quality.classify(docs, model).select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_good", 6).alias("p_good"), "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(_table(spark, sf_dir, "documents"), tail_bytes=32)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(_table(spark, sf_dir, "embeddings"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.link_documents(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode(_table(spark, sf_dir, "documents"), with_ids=False)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_matrix.report(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"), least=100, top=2_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_best_fit_packing, op3_media_tiff, op4_pii, op5_token_counts, op6_embedding_dedup, op7_minhash_dedup, op8_sentencepiece, op9_html_extraction, op10_suffix_dedup, op11_byte_bpe, op12_collocations)
}

REACH = "r AS (SELECT id, id AS root FROM ids UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)"

#: What SQL can say: the links and components of vectors and of shingle sets, by brute force. The
#: other queries are held against brute force, round trips or held-out rows in the tests.
ORACLES: dict[str, str] = {
    "op6_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), ids AS (SELECT id FROM v),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN e]) AND list_sum([x * x FOR x IN e]) > 0),
l AS (SELECT a.id AS a, b.id AS b FROM ok a, ok b WHERE a.id <> b.id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95), {REACH}
SELECT c.id AS vec_id, (SELECT count(*) FROM l WHERE l.a = c.id) AS n_links, component_id, c.id = component_id AS kept FROM c""",
    "op7_minhash_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
ids AS (SELECT id FROM s), g AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS same, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b USING (g) WHERE a.id <> b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * same >= 85 * (na + nb - same)), {REACH}
SELECT c.id AS doc_id, len(s.s) AS n_shingles, component_id, c.id = component_id AS kept FROM c JOIN s USING (id)""",
    "op10_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(greatest(strlen(h) // 2 - 49, 0))) AS i FROM d)),
f AS (SELECT x, min(doc_id) AS m FROM w GROUP BY x), hit AS (SELECT w.doc_id, w.i FROM w JOIN f USING (x) WHERE f.m < w.doc_id),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, range(50) t(k)),
b AS (SELECT doc_id, unnest(l) AS byte, unnest(range(len(l))) AS p FROM (SELECT doc_id, regexp_extract_all(h, '..') AS l FROM d)),
k AS (SELECT doc_id, string_agg(byte, '' ORDER BY p) AS kept FROM b ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS removed, count(*) FILTER (p IS DISTINCT FROM last + 1) AS spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM cov) GROUP BY doc_id)
SELECT doc_id, strlen(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(from_hex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op12_collocations": r"""WITH w AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM w),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), range(1, 6) t(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM g WHERE m = 1 GROUP BY lang), q AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE f >= 100),
c AS (SELECT lang, phrase, f, n, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM q JOIN n USING (lang), range(1, 5) t(k) WHERE m > 1 AND k < m),
s AS (SELECT c.lang, c.phrase, c.f AS a, c.k, x.f AS l, y.f AS r, c.n, (1000::HUGEINT * c.f * c.n) // (x.f::HUGEINT * y.f) AS score FROM c JOIN q x ON x.lang = c.lang AND x.phrase = c.head JOIN q y ON y.lang = c.lang AND y.phrase = c.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(f) AS f FROM q, range(1, 6) t(i), range(1, 6) u(j) WHERE i < j AND j <= m AND j - i + 1 < m GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR o.f < a QUALIFY rank <= 2000""",
}
