"""Queries on log streams, over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as L
from ..registry import query
from .base import table


def event_ms():
    return F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


LOG_SQL = "lg AS (SELECT event_id, event_type AS source, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' WHEN 'signup' THEN '2' WHEN 'view' THEN 'debug' ELSE 'INFO' END AS level, 'island-' || (user_id % 4)::VARCHAR AS island, user_id::VARCHAR AS worker_id, (epoch_us(ts) // 1000) AS ts, value AS fitness, props FROM events)"


def logs(spark, d):
    e = table(spark, d, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARN").when(F.col("event_type") == "signup", "2").when(F.col("event_type") == "view", "debug").otherwise("INFO")
    return e.select("event_id", F.col("event_type").alias("source"), level.alias("level"), F.concat(F.lit("island-"), (F.col("user_id") % 4).cast("string")).alias("island"), F.col("user_id").cast("string").alias("worker_id"), event_ms().alias("ts"), F.col("value").alias("fitness"), "props")


@query("log_filter", f"WITH {LOG_SQL} SELECT event_id FROM lg WHERE source = 'click' AND island = 'island-1' AND ts >= 1704067200000 AND fitness IS NOT NULL AND worker_id = (SELECT min(worker_id) FROM lg WHERE source = 'click' AND island = 'island-1')")
def log_filter(spark, d):
    rows = logs(spark, d)
    who = rows.filter("source = 'click' and island = 'island-1'").agg(F.min("worker_id")).first()[0]
    return L.matching(rows, L.Filter(source="click", island="island-1", since=1704067200000, worker_id=who)).filter("fitness is not null").select("event_id")


@query("log_level_filter", f"WITH {LOG_SQL} SELECT 'ERROR' AS want, event_id FROM lg WHERE level IN ('ERROR', '2') UNION ALL SELECT 'WARN', event_id FROM lg WHERE level IN ('ERROR', '2', 'WARN') UNION ALL SELECT 'DEBUG', event_id FROM lg WHERE level = 'debug'")
def log_level_filter(spark, d):
    rows = logs(spark, d)
    parts = [L.matching(rows, L.Filter(level=w)).select(F.lit(w).alias("want"), "event_id") for w in ("ERROR", "WARN", "DEBUG")]
    return parts[0].union(parts[1]).union(parts[2])


@query("log_search", f"WITH {LOG_SQL} SELECT event_id FROM lg WHERE contains(lower(source || '|' || level || '|' || island || '|' || props), 'k\": 8')")
def log_search(spark, d):
    rows = logs(spark, d).withColumn("props", F.regexp_replace("props", '"', "'"))
    return L.matching(rows.select("event_id", "source", "level", "island", "props"), L.Filter(search="K': 8")).select("event_id")


@query("log_tail", f"WITH {LOG_SQL} SELECT event_id, ts FROM lg ORDER BY ts DESC, event_id DESC LIMIT 500")
def log_tail(spark, d):
    return L.newest(logs(spark, d), 900, "event_id").select("event_id", "ts")


@query("log_history", f"WITH {LOG_SQL}, m AS (SELECT (min(ts) + max(ts)) // 2 AS mid FROM lg) SELECT event_id, ts FROM lg, m WHERE ts < mid ORDER BY ts DESC, event_id DESC LIMIT 100")
def log_history(spark, d):
    rows = logs(spark, d)
    mid = rows.agg(F.expr("(min(ts) + max(ts)) div 2")).first()[0]
    return L.page_before(rows, mid, 100, "event_id").select("event_id", "ts")


@query("log_stats", f"WITH {LOG_SQL} SELECT 'source' AS kind, source AS key, count(*) AS n FROM lg GROUP BY source UNION ALL SELECT 'level', level, count(*) FROM lg GROUP BY level UNION ALL SELECT 'total', '', count(*) FROM lg")
def log_stats(spark, d):
    return L.counts(logs(spark, d))


@query("latest_candidate", f"WITH {LOG_SQL} SELECT island, max(event_id) AS event_id, max_by(fitness, event_id) AS fitness FROM lg GROUP BY island UNION ALL SELECT 'all', max(event_id), max_by(fitness, event_id) FROM lg")
def latest_candidate(spark, d):
    rows = logs(spark, d)
    return L.latest_candidate(rows, ["island"], "event_id").union(L.latest_candidate(rows.withColumn("island", F.lit("all")), ["island"], "event_id"))


@query("best_by_island", f"WITH {LOG_SQL}, r AS (SELECT island, event_id, fitness, row_number() OVER (PARTITION BY island ORDER BY coalesce(fitness, '-inf'::DOUBLE) DESC, event_id DESC) AS rn FROM lg) SELECT island, event_id, fitness FROM r WHERE rn = 1")
def best_by_island(spark, d):
    return L.best_candidate(logs(spark, d), ["island"], "event_id")


def raw_logs(spark, d):
    """Raw records of several shapes, made of the events."""
    e = table(spark, d, "events")
    kind = F.col("event_id") % 5
    user = F.col("user_id").cast("string")
    container = F.concat(F.lit("/compose-worker-"), user)
    j = lambda *cols: F.to_json(F.struct(*cols))
    raw = (
        F.when(kind == 0, j(container.alias("container_name"), F.concat(F.lit("WARNING: slow "), user, F.lit("\n")).alias("message"), F.lit("2024-05-01T00:00:00Z").alias("timestamp")))
        .when(kind == 1, j(F.lit("/var/log/lead-node.log").alias("file_path"), j(F.lit("error").alias("level"), F.lit("lost").alias("msg"), F.lit("rpc").alias("logger")).alias("log")))
        .when(kind == 2, j(F.lit("stderr").alias("stream"), F.concat(F.lit("Gen 7 best_ever=1.5 best genome: [0.1, 0.2, "), (F.col("user_id") / 1000.0).cast("string"), F.lit("]")).alias("msg"), F.lit("isle-x").alias("island_id")))
        .when(kind == 3, j(F.struct(F.lit("DEBUG").alias("level"), F.lit("deep").alias("message"), F.lit("core").alias("target"), F.lit("surrogate").alias("role")).alias("fields"), F.lit(1700000000).alias("@timestamp")))
        .otherwise(F.concat(F.lit("plain line "), user))
    )
    topic = F.when(kind == 1, "logs.lead").when(kind == 4, "logs.other").otherwise("logs.worker")
    return e.select("event_id", "user_id", raw.alias("raw"), topic.alias("topic"), event_ms().alias("broker_ts"))


NORMAL_SQL = """WITH e AS (SELECT *, event_id % 5 AS k, user_id::VARCHAR AS u FROM events)
SELECT event_id, CASE k WHEN 1 THEN 'logs.lead' WHEN 4 THEN 'logs.other' ELSE 'logs.worker' END AS source,
CASE k WHEN 0 THEN 'compose-worker-' || u WHEN 1 THEN 'lead-node' END AS source_tag,
CASE k WHEN 0 THEN 'WARN' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARN' WHEN 3 THEN 'DEBUG' ELSE 'INFO' END AS level,
CASE k WHEN 0 THEN 'WARNING: slow ' || u WHEN 1 THEN 'lost' WHEN 2 THEN 'Gen 7' WHEN 3 THEN 'deep' ELSE 'plain line ' || u END AS head,
CASE k WHEN 0 THEN 'compose-worker-' || u WHEN 1 THEN 'rpc' WHEN 2 THEN 'logs.worker' WHEN 3 THEN 'core' ELSE 'logs.other' END AS target,
CASE k WHEN 0 THEN 'island-' || u WHEN 1 THEN 'lead' WHEN 2 THEN 'isle-x' WHEN 3 THEN 'island-1' ELSE 'default' END AS island,
CASE k WHEN 0 THEN 'worker' WHEN 1 THEN 'lead' WHEN 2 THEN 'worker' WHEN 3 THEN 'surrogate' ELSE 'unknown' END AS role,
CASE WHEN k = 2 THEN 7 END AS gen, CASE WHEN k = 2 THEN 1.5::DOUBLE END AS fitness, CASE WHEN k = 2 THEN 3 END AS genes FROM e"""


@query("log_normalize", NORMAL_SQL)
def log_normalize(spark, d):
    n = L.normalize(raw_logs(spark, d))
    head = F.when(F.col("message").startswith("Gen 7"), "Gen 7").otherwise(F.col("message"))
    return n.select("event_id", "source", "source_tag", "level", head.alias("head"), "target", "island", "role", "gen", "fitness", F.when(F.col("genome").isNotNull(), F.size("genome")).alias("genes"))


@query("log_ts", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1714521600000 WHEN 3 THEN 1700000000000 ELSE (epoch_us(ts) // 1000) END AS ts FROM events")
def log_ts(spark, d):
    return L.normalize(raw_logs(spark, d)).select("event_id", "ts")
