"""Live state of log streams and islands: what each key holds, kept by Spark between batches.

A ring of the newest lines of each source, the drift of an index with its dirty leaves, a mailbox
that is drained once, and the live points by age. State is one key's and of bounded size, or as
large as the live set; it survives restarts with the stream's checkpoint. Rows of a key come in any
order within a batch, and are taken in the order of their event ids.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

# Spark also starts the processors in a process of the driver's, which doesn't have the shipped code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that keyed state needs, for streams that start inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)


def _value(state, default: tuple) -> tuple:
    return tuple(state.get()) if state.exists() else default


class Ring(StatefulProcessor):
    """The newest ids of a source: past 125 % of the capacity, a ring is cut to 80 % of it. What n
    arrivals leave follows from n, so a batch is added at once."""

    def __init__(self, cap: int):
        self.trigger, self.keep = int(cap * 1.25), int(cap * 0.8)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getListState("ids", "event_id long")
        self.arrivals = handle.getValueState("arrivals", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = _value(self.arrivals, (0,))[0]
        ids = np.array([r[0] for r in self.ids.get()], np.int64)
        for pdf in rows:
            n += len(pdf)
            ids = np.sort(np.concatenate((ids, pdf["event_id"].to_numpy(np.int64))))[-self.trigger :]
        left = n if n <= self.trigger else self.keep + (n - self.trigger - 1) % (self.trigger - self.keep + 1)
        ids = ids[-left:]
        self.ids.put([(int(i),) for i in ids])
        self.arrivals.update((n,))
        yield pd.DataFrame({"source": key[0], "event_id": ids, "arrivals": n})

    def close(self) -> None:
        pass


class Drift(StatefulProcessor):
    """Inserts since a node's index was activated, of all its keys, and the leaves they made dirty.

    Ready with ``least`` keys and a share of ``ratio``; with ``activate`` a ready index is activated
    at the end of the batch: its version goes up, inserts start anew and no leaf is dirty.
    """

    def __init__(self, least: int, ratio: float, activate: bool):
        self.least, self.ratio, self.activate = least, ratio, activate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "total long, inserts long, version long")
        self.dirty = handle.getMapState("dirty", "leaf int", "inserts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, inserts, version = _value(self.counts, (0, 0, 0))
        leaves: dict[int, int] = {}
        for pdf in rows:
            total += len(pdf)
            fresh = pdf.loc[pdf["fresh"], "leaf"]
            inserts += len(fresh)
            for leaf, n in fresh.value_counts().items():
                leaves[int(leaf)] = leaves.get(int(leaf), 0) + int(n)
        for leaf, n in leaves.items():
            self.dirty.updateValue((leaf,), (n + (self.dirty.getValue((leaf,))[0] if self.dirty.containsKey((leaf,)) else 0),))
        ready = total >= self.least and inserts / total >= self.ratio
        held = sorted(k[0] for k in self.dirty.keys()) if self.dirty.exists() else []
        yield pd.DataFrame({"node": [key[0]], "total": [total], "inserts": [inserts], "version": [version], "ready": [ready], "dirty": [held]})
        if ready and self.activate:
            version, inserts = version + 1, 0
            self.dirty.clear()
        self.counts.update((total, inserts, version))

    def close(self) -> None:
        pass


class Mailbox(StatefulProcessor):
    """What was sent to an island since it last drained its box, handed over once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.box = handle.getListState("box", "event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.box.get()]
        drained: list[tuple[int, int]] = []
        for event, drains in sorted(pair for pdf in rows for pair in zip(pdf["event_id"].tolist(), pdf["drains"].tolist())):
            if drains:
                drained += [(event, i) for i in held]
                held = []
            else:
                held.append(event)
        self.box.put([(i,) for i in held]) if held else self.box.clear()
        yield pd.DataFrame({"island": key[0], "drained_at": [d for d, _ in drained], "event_id": [i for _, i in drained]}).astype({"drained_at": "int64", "event_id": "int64", "island": "int64"})

    def close(self) -> None:
        pass


class Ages(StatefulProcessor):
    """The points of an island that were used within ``max_age`` generations of its latest."""

    def __init__(self, max_age: int):
        self.max_age = max_age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "generation long")
        self.last = handle.getMapState("last", "id long", "generation long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used: dict[int, int] = {}
        for pdf in rows:
            for i, g in pdf.groupby("id")["generation"].max().items():
                used[int(i)] = max(used.get(int(i), -1), int(g))
        now = max([_value(self.latest, (-1,))[0], *used.values()])
        live = {k[0]: v[0] for k, v in self.last.iterator()} if self.last.exists() else {}
        changed = {i: max(g, live.get(i, -1)) for i, g in used.items()}
        for i, g in changed.items():
            if now - g <= self.max_age:
                self.last.updateValue((i,), (g,))
        live |= changed
        for i in [i for i, g in live.items() if now - g > self.max_age]:
            if self.last.containsKey((i,)):
                self.last.removeKey((i,))
            del live[i]
        self.latest.update((now,))
        yield pd.DataFrame({"island": key[0], "generation": now, "id": list(live), "last": list(live.values())}).astype({"island": "int64", "generation": "int64", "id": "int64", "last": "int64"})

    def close(self) -> None:
        pass


def _keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    ship(stream.sparkSession)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Update", "None")


def log_ring(stream: DataFrame, cap: int = 1_000) -> DataFrame:
    """``source, event_id, arrivals``: after each batch, the ring of every source that had lines."""
    return _keyed(stream.select("source", "event_id"), "source", Ring(cap), "source string, event_id long, arrivals long")


def drift(stream: DataFrame, least: int = 50, ratio: float = 0.40, activate: bool = True) -> DataFrame:
    """``node, total, inserts, version, ready, dirty`` after each batch, of rows ``node, leaf, fresh``."""
    return _keyed(stream.select("node", "leaf", "fresh"), "node", Drift(least, ratio, activate), "node long, total long, inserts long, version long, ready boolean, dirty array<int>")


def mailbox(stream: DataFrame) -> DataFrame:
    """``island, drained_at, event_id``: what each drain took out, of rows ``island, event_id, drains``."""
    return _keyed(stream.select("island", "event_id", "drains"), "island", Mailbox(), "island long, drained_at long, event_id long")


def ages(stream: DataFrame, max_age: int = 5) -> DataFrame:
    """``island, generation, id, last``: after each batch, the live points, of rows ``island, id, generation``."""
    return _keyed(stream.select("island", "id", "generation"), "island", Ages(max_age), "island long, generation long, id long, last long")


def to_folder(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there; each batch writes its own partition of the folder, the same
    one when it runs again."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    with state_store(stream.sparkSession):
        query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema.add("batch", "integer")).parquet(path)


def with_restart(rows: DataFrame, order: str, live: Callable[[DataFrame], DataFrame], folder: str, files: int = 2) -> DataFrame:
    """What a live operator writes over files of rows in their order, of which the second half
    arrives after the stream has ended, and is taken up by a restart from the checkpoint."""
    spark, source = rows.sparkSession, f"{folder}/in"
    # Taken once: sketches that are merged in another order give another middle, and rows between the
    # two would come twice or never.
    middle = rows.agg(F.percentile_approx(order, 0.5)).first()[0]
    out = None
    for part in (rows.filter(F.col(order) <= F.lit(middle)), rows.filter(F.col(order) > F.lit(middle))):
        part.repartitionByRange(files, order).sortWithinPartitions(order).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source)
        out = to_folder(live(stream), f"{folder}/out", f"{folder}/checkpoint")
    return out
