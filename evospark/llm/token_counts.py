"""Token counts through a digest cache.

A cache table holds ``(tokenizer, digest, n_tokens)``. Contents are normalised (null is the empty
text; nothing else may change a count), digested with SHA-256 and joined to the counts stored for
the tokenizer's version, which is the SHA-256 of its file. Only distinct misses are encoded, and
their counts are appended to the cache.

Defined cases: null and empty text count 0 tokens; repeated rows each get their row; an empty
table gives an empty result; a null id stays null; extra columns are ignored.

Scale: repeats within a partition are dropped before the one shuffle of texts, so that a content
that fills a third of the table is sent once per task; counts join by digest, where Spark splits
skewed partitions. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .byte_bpe import default_path, engine, file_digest
from .common import lean, pick, stored

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: A task forgets which digests it has passed on after so many; a repeat is then dropped later.
SEEN = 1_000_000


@lean
def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest this task has not yet passed on."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for digest in batch.column("digest").to_pylist():
            keep.append(digest not in seen)
            seen.add(digest)
        if len(seen) > SEEN:
            seen.clear()
        yield batch.filter(pa.array(keep, pa.bool_()))


def _counter(path: str):
    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, done = engine(path).ids, set()
        for batch in batches:
            digests, counts = [], []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text")):
                if digest not in done:
                    done.add(digest)
                    digests.append(digest)
                    counts.append(len(ids(text.as_py())))
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return count


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table at ``path``, made empty where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def count_tokens(docs: DataFrame, cache_path: str | None = None, tokenizer_path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; see the module's notes."""
    spark = docs.sparkSession
    tokenizer_path = tokenizer_path or default_path()
    version = file_digest(tokenizer_path)
    cache_path = cache_path or shared_path(spark, "token-cache")
    keyed = pick(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = open_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("digest")
    texts = keyed.select("digest", "text").mapInArrow(_fresh, "digest binary, text string")
    misses = texts.join(known, "digest", "left_anti").repartition("digest")
    counted = misses.mapInArrow(_counter(tokenizer_path), "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    counts = stored(open_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    rows = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return rows.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
