"""Queries on live state: streams over files that are restarted once from their checkpoint, held
against the rows that a batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..session import shared_path
from ..streaming import live as V
from .base import table


def _final(rows, by):
    """The rows of each key's last batch."""
    return rows.withColumn("_last", F.max("batch").over(Window.partitionBy(by))).filter("batch = _last").drop("_last", "batch")


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "user_id")


@query("live_log_ring", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type AS source, event_id, n AS arrivals FROM r WHERE rn <= CASE WHEN n <= 125 THEN n ELSE 80 + (n - 126) % 46 END")
def live_log_ring(spark, d):
    """Rings of a hundred lines of each source."""
    rows = _events(spark, d).select("event_id", F.col("event_type").alias("source"))
    return _final(V.with_restart(rows, "event_id", lambda s: V.log_ring(s, 100), shared_path(spark, "live-ring")), "source")


@query("live_drift", "WITH e AS (SELECT user_id % 8 AS node, (event_id % 16)::INT AS leaf, (event_id * 7919) % 5 < 2 AND event_id % 16 < 11 AS fresh FROM events) SELECT node, count(*) AS total, count(*) FILTER (fresh) AS inserts, count(*) >= 50 AND (count(*) FILTER (fresh))::DOUBLE / count(*) >= 0.25 AS ready, count(DISTINCT leaf) FILTER (fresh) AS dirty FROM e GROUP BY node")
def live_drift(spark, d):
    """Drift of each node's index and how many leaves are dirty."""
    i = F.col("event_id")
    rows = _events(spark, d).select("event_id", (F.col("user_id") % 8).alias("node"), (i % 16).cast("int").alias("leaf"), (((i * 7919) % 5 < 2) & (i % 16 < 11)).alias("fresh"))
    out = _final(V.with_restart(rows, "event_id", lambda s: V.drift(s, ratio=0.25, activate=False), shared_path(spark, "live-drift")), "node")
    return out.select("node", "total", "inserts", "ready", F.size("dirty").cast("long").alias("dirty"))


@query("live_mailbox", "WITH e AS (SELECT event_id, user_id % 4 AS island, event_type = 'signup' AND event_id % 3 = 0 AS drains FROM events), m AS (SELECT island, event_id, drains, min(CASE WHEN drains THEN event_id END) OVER (PARTITION BY island ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS drained_at FROM e) SELECT island, drained_at, event_id FROM m WHERE NOT drains AND drained_at IS NOT NULL")
def live_mailbox(spark, d):
    """Immigrants that each drain of an island's mailbox takes out, once."""
    rows = _events(spark, d).select("event_id", (F.col("user_id") % 4).alias("island"), ((F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0)).alias("drains"))
    return V.with_restart(rows, "event_id", V.mailbox, shared_path(spark, "live-mailbox")).drop("batch")


@query("live_ages", "WITH e AS (SELECT user_id % 4 AS island, user_id AS id, event_id // 100 AS generation FROM events), l AS (SELECT island, id, max(generation) AS last FROM e GROUP BY 1, 2), g AS (SELECT island, max(generation) AS generation FROM e GROUP BY 1) SELECT island, generation, id, last FROM l JOIN g USING (island) WHERE generation - last <= 5")
def live_ages(spark, d):
    """Points that were used within five generations of their island's latest."""
    rows = _events(spark, d).select("event_id", (F.col("user_id") % 4).alias("island"), F.col("user_id").alias("id"), F.expr("event_id div 100").alias("generation"))
    return _final(V.with_restart(rows, "event_id", V.ages, shared_path(spark, "live-ages")), "island")
