"""Queries on sources, sinks and streams, which run over what is there and end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import airframe as A
from ..operators import logs as L
from ..registry import query
from ..session import shared_path
from ..sources import files as S
from ..streaming import streams as W
from .base import EVAL_SQL, evaluated, genomes, r6
from .logs import raw_logs


def _log_stream(spark, d):
    path = shared_path(spark, "logs")
    raw_logs(spark, d).select("event_id", "raw", "topic", "broker_ts").repartitionByRange(4, "event_id").write.parquet(path)
    return W.normalized(W.file_logs(spark, path))


def _run(df, mode):
    return W.to_memory(df, f"t{uuid.uuid4().hex}", mode)


@query("log_stream", "WITH e AS (SELECT event_id % 5 AS k FROM events) SELECT CASE k WHEN 1 THEN 'logs.lead' WHEN 4 THEN 'logs.other' ELSE 'logs.worker' END AS source, CASE k WHEN 0 THEN 'WARN' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARN' WHEN 3 THEN 'DEBUG' ELSE 'INFO' END AS level, count(*) AS n FROM e GROUP BY 1, 2")
def log_stream(spark, d):
    """Counts of a log stream by source and level."""
    return _run(W.live_counts(_log_stream(spark, d)), "complete").select("source", "level", "n")


@query("live_best", "SELECT 'isle-x' AS island, max(event_id) AS event_id, 1.5::DOUBLE AS fitness FROM events WHERE event_id % 5 = 2")
def live_best(spark, d):
    """Best candidate of every island of a stream; later ones win ties."""
    return _run(W.live_best(_log_stream(spark, d)), "complete")


@query("sliding_window_stream", "SELECT 'isle-x' AS island, least(count(*), 300)::INT AS size, greatest(count(*) - 300, 0) AS dropped FROM events WHERE event_id % 5 = 2")
def sliding_window_stream(spark, d):
    """What a stateful window of 300 samples holds at the end of a stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _run(W.sliding_windows(_log_stream(spark, d), cap=300), "update")
    return rows.groupBy("island").agg(F.max_by(F.struct("size", "dropped"), "dropped").alias("w")).select("island", "w.size", "w.dropped")


@query("log_push")
def log_push(spark, d):
    """Rows that each pushed micro-batch held."""
    sent = []
    W.push(_log_stream(spark, d), lambda df, i: sent.append((i, df.count())), once=True).awaitTermination()
    return spark.createDataFrame(sent, "batch bigint, n bigint")


@query("online_training")
def online_training(spark, d):
    """Version and accuracy of a surrogate after a stream of samples."""
    import numpy as np

    from ..models import surrogates as M

    path = shared_path(spark, "samples")
    rows = evaluated(spark, d).select(F.col("vec_id").alias("event_id"), "g", "fitness")
    rows.repartitionByRange(3, "event_id").write.parquet(path)
    stream = spark.readStream.schema("event_id bigint, g array<double>, fitness double").option("maxFilesPerTrigger", 1).parquet(path)
    registry = W.Registry()
    fit = lambda held: M.GaussianProcess().fit(np.array([h[0] for h in held]), np.array([h[1] for h in held]))
    W.online_training(stream, registry, fit).awaitTermination()
    version, model = registry.active
    out = M.predict(rows, model, "g", ("event_id", "fitness"))
    return out.agg(F.lit(version).alias("version"), r6(F.corr("fitness", "mean")).alias("corr"))


def _records(spark, d):
    p = A.parameters(F.col("g"))
    config = F.struct(*(p[n].alias(n) for n in S.CONFIG))
    ld = F.when(F.col("vec_id") % 3 != 0, F.col("fitness"))
    aero = F.struct(*((ld if n == "ld" else F.lit(1.0)).alias(n) for n in S.RESULTS))
    fitness = F.when(F.col("vec_id") % 10 == 0, A.REJECT).otherwise(F.col("fitness"))
    return evaluated(spark, d).select("vec_id", config.alias("config"), aero.alias("aero"), fitness.alias("fitness"))


@query("dataset_filter", f"WITH {EVAL_SQL} SELECT count(*) AS n, count(*) FILTER (vec_id % 3 <> 0) AS with_ld, round(sum(fitness), 4) AS total FROM ev WHERE vec_id % 10 <> 0")
def dataset_filter(spark, d):
    """Usable training records of a JSON file."""
    path = shared_path(spark, "dataset")
    _records(spark, d).select("config", "aero", "fitness").write.json(path)
    rows = S.usable(spark.read.schema(S.RECORD).json(path))
    return rows.agg(F.count("*").alias("n"), F.count("aero.ld").alias("with_ld"), F.round(F.sum("fitness"), 4).alias("total"))


@query("tolerant_load", f"WITH {EVAL_SQL} SELECT count(*) AS n FROM ev")
def tolerant_load(spark, d):
    """Records between comments and broken lines."""
    path = shared_path(spark, "tolerant")
    good = _records(spark, d).select(F.to_json(F.struct("config", "aero", "fitness")).alias("value"))
    noise = spark.createDataFrame([("# a comment",), ("// another",), ("{broken",), ('{"aero": null}',)], "value string")
    good.union(noise).write.text(path)
    return S.load_tolerant(spark, path).agg(F.count("*").alias("n"))


@query("run_scan", f"WITH {EVAL_SQL} SELECT generation, round(max(fitness), 6) AS best_fitness, count(*) AS members FROM ev GROUP BY generation")
def run_scan(spark, d):
    """Telemetry written as JSON lines and read back."""
    path = shared_path(spark, "telemetry")
    rows = evaluated(spark, d).groupBy("generation").agg(F.max("fitness").alias("best_fitness"), F.collect_list("g").alias("population"))
    S.write_telemetry(rows, path)
    return S.read_runs(spark, path).select("generation", r6("best_fitness").alias("best_fitness"), F.size("population").cast("bigint").alias("members"))


@query("stl_export", f"WITH {EVAL_SQL} SELECT vec_id AS id, 192 AS facets FROM ev")
def stl_export(spark, d):
    """Facets of wings, a mesh for each design."""
    p = A.parameters(F.col("g"))
    designs = genomes(spark, d).select(F.col("vec_id").alias("id"), *(p[n].alias(n) for n in ("wing_span", "wing_root_chord", "wing_tip_chord", "wing_sweep", "naca_m")))
    return S.wing_facets(designs).groupBy("id").agg(F.count("*").alias("facets"))


@query("csv_roundtrip", f"WITH {EVAL_SQL} SELECT vec_id, round(fitness, 6) AS fitness FROM ev")
def csv_roundtrip(spark, d):
    path = shared_path(spark, "csv")
    S.write_csv(evaluated(spark, d).select("vec_id", r6("fitness").alias("fitness")), path)
    return spark.read.schema("vec_id bigint, fitness double").option("header", True).csv(path)
