"""An archive of log lines that takes only what is new, for search, history pages and noise reports.

A file stream reads documents (``doc_id, text, source``) from a folder, or a pattern of files or
folders, that grows; a document is what a container wrote, a line is a record. Lines are normalized
as the library's log streams are (level, island, role, message, ts), and a message with its numbers
masked is the template that repeated messages share. Each micro-batch writes

* ``lines``, partitioned by ``batch``, ``source`` and ``level``;
* ``templates``: how often each template came in the batch, partitioned by ``batch``.

The checkpoint says which files have been read. A batch that is run again after a failure
overwrites the partitions of its own number with the same rows; a run without new files writes
nothing. Blank lines are skipped, a null text has none, a missing source is ``unknown``.

    python -m jobs.log_archive --config jobs/log_archive.json --input GLOB --output PATH --checkpoint PATH
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evospark.operators import logs as L

from .settings import from_command_line

log = logging.getLogger("jobs.log_archive")
DOCUMENTS = "doc_id bigint, text string, source string"
LINES = "doc_id bigint, line_no int, island string, role string, ts bigint, message string, template_id string, batch bigint, source string, level string"
TEMPLATES = "source string, level string, template_id string, template string, n bigint, batch bigint"


@dataclass(frozen=True)
class Settings:
    input: str
    output: str
    checkpoint: str
    files_per_batch: int = 1_000


def masked(message: str) -> Column:
    """The template of a message."""
    return F.regexp_replace(message, "[0-9]+", "#")


def lines_of(documents: DataFrame) -> DataFrame:
    """A normalized row of each line, with the id of its message's template."""
    raw = documents.select("doc_id", F.col("source").alias("topic"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw")).filter(F.trim("raw") != "")
    rows = L.normalize(raw.withColumn("broker_ts", F.lit(None).cast("bigint")))
    return rows.select("doc_id", "line_no", "source", "level", "island", "role", "ts", "message", F.md5(masked("message")).alias("template_id"))


def write_batch(documents: DataFrame, batch: int, settings: Settings) -> None:
    dynamic = {"partitionOverwriteMode": "dynamic"}
    rows = lines_of(documents).withColumn("batch", F.lit(batch).cast("bigint"))
    lines = rows.select("doc_id", "line_no", "island", "role", "ts", "message", "template_id", "batch", "source", "level")
    lines.hint("rebalance", "source", "level").write.mode("overwrite").options(**dynamic).partitionBy("batch", "source", "level").parquet(f"{settings.output}/lines")
    # Counted from the files just written: a cached partition would hold all lines of a split of the input.
    held = read_lines(documents.sparkSession, settings).filter(F.col("batch") == batch).withColumn("template", masked("message"))
    counts = held.groupBy("source", "level", "template_id", "template", "batch").agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").options(**dynamic).partitionBy("batch").parquet(f"{settings.output}/templates")
    wrote = documents.sparkSession.read.schema(TEMPLATES).parquet(f"{settings.output}/templates").filter(F.col("batch") == batch).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    log.info("batch %d: wrote %d lines of %d templates to %s", batch, *wrote, settings.output)


def read_lines(spark: SparkSession, settings: Settings) -> DataFrame:
    """The archive as it stands."""
    return spark.read.schema(LINES).parquet(f"{settings.output}/lines")


def read_templates(spark: SparkSession, settings: Settings) -> DataFrame:
    """``source, level, template_id, template, n`` over all batches."""
    held = spark.read.schema(TEMPLATES).parquet(f"{settings.output}/templates")
    return held.groupBy("source", "level", "template_id").agg(F.first("template").alias("template"), F.sum("n").alias("n"))


def run(spark: SparkSession, settings: Settings) -> int:
    """Archives what is new and returns how many documents that were."""
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", settings.files_per_batch).parquet(settings.input)
    writer = stream.writeStream.option("checkpointLocation", settings.checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(lambda rows, batch: write_batch(rows, batch, settings)).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    taken = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %d new documents of %s", taken, settings.input)
    return taken


def main(argv: list[str] | None = None) -> None:
    settings = from_command_line(Settings, argv, "Archives the new log lines of a folder that grows.")
    spark = SparkSession.builder.appName("log-archive").getOrCreate()
    try:
        run(spark, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
