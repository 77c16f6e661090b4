"""Structured Streaming: log streams, live counts and candidates, and sliding training windows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import logs as L
from ..session import ship
from .tail import TailSource

TOPICS = ("logs.orchestrator", "logs.worker", "logs.lead", "logs.surrogate")
LOG_LINE = "event_id bigint, raw string, topic string, broker_ts bigint"


def kafka_logs(spark: SparkSession, servers: str, topics: tuple[str, ...] = TOPICS) -> DataFrame:
    """Raw records from the latest offsets on; needs the Kafka connector on the class path."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "latest").load()
    return rows.select(F.col("offset").alias("event_id"), F.col("value").cast("string").alias("raw"), "topic", F.unix_millis("timestamp").alias("broker_ts"))


def file_logs(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same columns from a folder that grows, one Parquet file after another."""
    return spark.readStream.schema(LOG_LINE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tail_files(spark: SparkSession, globs: dict[str, str]) -> DataFrame:
    """Lines that are appended to text files, tagged by the pattern they match, in the columns that
    ``normalized`` takes. Ids are unique and rise with the lines of a file and with the batches."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format(TailSource.name()).option("globs", json.dumps(globs)).load()


def normalized(stream: DataFrame) -> DataFrame:
    """A batch is dealt out over all cores first: a file may be one split, and parsing is the work."""
    return L.normalize(stream.repartition(stream.sparkSession.sparkContext.defaultParallelism), now=F.unix_millis(F.current_timestamp()))


def live_counts(stream: DataFrame) -> DataFrame:
    """Counts by source and level, for complete mode."""
    return stream.groupBy("source", "level").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))


def live_best(stream: DataFrame, order: str = "event_id") -> DataFrame:
    """Best candidate of every island, for update or complete mode."""
    return L.best_candidate(stream.filter(F.col("genome").isNotNull()), ["island"], order)


def to_memory(df: DataFrame, name: str, mode: str, checkpoint: str | None = None):
    """Runs a stream over what is there into a table of the session."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def push_to_clients(df: DataFrame, clients: dict[str, L.Filter], send: Callable[[str, str, DataFrame], None], seconds: int = 1, once: bool = False):
    """Hands each client the rows of a normalized stream that its own filter lets through, as
    ``send(client, "logs", rows)``, the batch's candidates as ``"candidates"``, and its counts as
    ``"stats"``, at most once a second."""

    def batch(rows: DataFrame, _: int) -> None:
        stats = rows.groupBy("source", "level").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))
        candidates = rows.filter(F.col("genome").isNotNull())
        for client, wanted in clients.items():
            send(client, "logs", L.matching(rows, wanted))
            send(client, "candidates", candidates)
            send(client, "stats", stats)

    return push(df, batch, seconds, once)


def push(df: DataFrame, send: Callable[[DataFrame, int], None], seconds: int = 1, once: bool = False):
    """Hands every micro-batch to ``send``, at most once a second."""
    writer = df.writeStream.foreachBatch(send)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


WINDOW_OUT = "island string, event_id bigint, size int, dropped bigint, retrain boolean"


def sliding_windows(stream: DataFrame, cap: int = 1000, least: int = 100, fresh: int = 20) -> DataFrame:
    """Per island, a window of the last ``cap`` samples that share the first sample's dimension, and
    after each batch whether a retrain is due: ``least`` samples and ``fresh`` new ones.

    The state is one value of bounded size per island.
    """

    class Windows(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("window", "value string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            held = json.loads(self.state.get()[0]) if self.state.exists() else {"dim": None, "ids": [], "dropped": 0, "new": 0}
            event, dim = np.concatenate([pdf[["event_id", "dim"]].to_numpy(np.int64) for pdf in rows]).T
            order = np.lexsort((dim, event))
            event, dim = event[order], dim[order]
            fits = np.ones(len(dim), bool)
            if not held["dim"]:  # the first sample that isn't empty says it
                begin = int(np.argmax(dim > 0)) if (dim > 0).any() else len(dim)
                held["dim"] = int(dim[begin]) if begin < len(dim) else 0
                fits[begin:] = dim[begin:] == held["dim"]
            else:
                fits = dim == held["dim"]
            last, fit = int(event[-1]), event[fits].tolist()
            ids = held["ids"] + fit
            held["new"] += len(fit)
            held["dropped"] += max(0, len(ids) - cap)
            held["ids"] = ids[-cap:]
            due = len(held["ids"]) >= least and held["new"] >= fresh
            if due:
                held["new"] = 0
            self.state.update((json.dumps(held),))
            yield pd.DataFrame({"island": [key[0]], "event_id": [last], "size": [len(held["ids"])], "dropped": [held["dropped"]], "retrain": [due]})

        def close(self) -> None:
            pass

    rows = stream.filter(F.col("genome").isNotNull()).select("island", "event_id", F.size("genome").alias("dim"))
    return rows.groupBy("island").transformWithStateInPandas(Windows(), WINDOW_OUT, "Update", "None")


class Registry:
    """Versions of a surrogate: a new one replaces the active one whole, and can be rolled back."""

    def __init__(self):
        self.versions: list[tuple[int, object]] = []
        self.pending: tuple[int, object] | None = None

    @property
    def active(self) -> tuple[int, object] | None:
        return self.versions[-1] if self.versions else None

    def propose(self, model: object) -> int:
        version = (self.pending or self.active or (0, None))[0] + 1
        self.pending = (version, model)
        return version

    def promote(self, version: int) -> bool:
        if self.pending is None or self.pending[0] != version:
            return False
        self.versions.append(self.pending)
        self.pending = None
        return True

    def roll_back(self) -> bool:
        """To the version before; the first one stays."""
        if len(self.versions) < 2:
            return False
        self.versions.pop()
        return True


def online_training(stream: DataFrame, registry: Registry, fit: Callable[[list], object], cap: int = 1000, least: int = 100, fresh: int = 20, force: bool = False):
    """Refits from the last ``cap`` samples (``g``, ``fitness``) whenever enough are new: one fit at a
    time, in the order of the batches, swapped in when it is done."""
    ship(stream.sparkSession)
    held: list = []
    state = {"new": 0}

    def batch(df: DataFrame, _: int) -> None:
        rows = df.orderBy(F.desc("event_id")).limit(cap).select("g", "fitness").collect()  # no more than the window holds
        held.extend((r["g"], r["fitness"]) for r in reversed(rows))
        del held[:-cap]
        state["new"] += len(rows)
        if force or (len(held) >= least and state["new"] >= fresh):
            registry.promote(registry.propose(fit(list(held))))
            state["new"] = 0

    return stream.writeStream.foreachBatch(batch).trigger(availableNow=True).start()
