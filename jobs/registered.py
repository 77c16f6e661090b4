"""The jobs as queries: each runs twice into one new folder of the shared ones, which stays."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evospark.functions import vectors as V
from evospark.session import shared_dir, ship

from . import log_archive, training_set


def _folder(spark: SparkSession, name: str) -> str:
    ship(spark)
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = training_set.Settings(f"{sf_dir}/embeddings.parquet", _folder(spark, "job1"), generations=4)
    training_set.run(spark, settings)
    samples = training_set.run(spark, settings)
    scaler = training_set.read(spark, settings, "scaler")
    column = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("dim", name))), lambda s: s[name]).alias(name)
    arrays = scaler.agg(column("mean"), column("std"))  # a row of ten genes
    z = F.zip_with(F.zip_with("g", "mean", lambda a, b: a - b), "std", lambda a, b: a / b)
    rows = samples.join(F.broadcast(arrays)).join(training_set.read(spark, settings, "report").select("part", "era", "designs"), ["part", "era"])
    return rows.select("vec_id", "part", F.col("era").cast("bigint").alias("era"), "designs", *(F.round(c, 6).alias(c) for c in ("fitness", "wing_span", "naca_m")), F.round(F.sqrt(V.total(F.transform(z, lambda x: x * x))), 6).alias("z_norm"))


def job2_log_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job2")
    settings = log_archive.Settings(f"{sf_dir}/documents*.parquet", f"{folder}/archive", f"{folder}/checkpoint")
    log_archive.run(spark, settings)
    log_archive.run(spark, settings)
    seen = log_archive.read_templates(spark, settings).groupBy("source", "template_id").agg(F.sum("n").alias("n_same"))
    return log_archive.read_lines(spark, settings).join(seen, ["source", "template_id"]).select("doc_id", "line_no", "source", "level", "island", "role", "message", "template_id", "n_same")


QUERIES = {f.__name__: f for f in (job1_training_set, job2_log_archive)}

_TENTH = "('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % 10"
ORACLES = {
    "job1_training_set": f"""WITH gen AS (SELECT vec_id, [(x::DOUBLE + 1.0) / 2.0 FOR x IN embedding[1:10]] AS g FROM embeddings),
d AS (SELECT min(vec_id) AS vec_id, g FROM gen GROUP BY g), s AS (SELECT vec_id, g, vec_id // 200 AS era, CASE WHEN {_TENTH} < 6 THEN 'train' WHEN {_TENTH} < 8 THEN 'validation' ELSE 'test' END AS part,
15.0::DOUBLE / (1.0 + 3.0 * list_sum([(x - 0.5) * (x - 0.5) FOR x IN g])) AS fitness FROM d), x AS (SELECT unnest(range(1, 11)) AS i, unnest(g) AS x FROM s WHERE part = 'train'),
m AS (SELECT list(mean ORDER BY i) AS mean, list(std ORDER BY i) AS std FROM (SELECT i, avg(x) AS mean, CASE WHEN stddev_pop(x) > 1e-8 THEN stddev_pop(x) ELSE 1 END AS std FROM x GROUP BY i))
SELECT vec_id, part, era, count(*) OVER (PARTITION BY part, era) AS designs, round(fitness, 6) AS fitness, round(80.0 + 140.0 * least(greatest(g[1], 0.0), 1.0), 6) AS wing_span, round(5.0 * least(greatest(g[8], 0.0), 1.0), 6) AS naca_m, round(sqrt(list_sum([power((g[i] - mean[i]) / std[i], 2) FOR i IN range(1, 11)])), 6) AS z_norm FROM s, m""",
    "job2_log_archive": r"""WITH d AS (SELECT doc_id, coalesce(nullif(source, ''), 'unknown') AS source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, source, unnest(lines) AS message, unnest(range(len(lines))) AS line_no FROM d), k AS (SELECT *, upper(regexp_extract(message, '(?i)^\[?(ERROR|CRIT|FATAL|WARNING|WARN|INFO|DEBUG|TRACE)\]?[:\s]', 1)) AS said, md5(regexp_replace(message, '[0-9]+', '#', 'g')) AS template_id FROM l WHERE trim(message) <> '')
SELECT doc_id, line_no::INT AS line_no, source, CASE WHEN said = '' THEN 'INFO' WHEN said = 'WARNING' THEN 'WARN' WHEN said IN ('CRIT', 'FATAL') THEN 'ERROR' ELSE said END AS level, 'default' AS island, 'unknown' AS role, message, template_id, count(*) OVER (PARTITION BY source, template_id) AS n_same FROM k""",
}
