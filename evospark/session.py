"""Sessions, and the package's own code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch on its way to Python, where the session says nothing else: a
#: worker holds a few batches at a time, whatever the length of the texts.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

_local_dir: str | None = None
_ROOT = os.path.dirname(os.path.abspath(__file__))


def _given(spark: SparkSession) -> set[str]:
    return {k for k, _ in spark.sparkContext.getConf().getAll()}


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application."""
    for key, value in BATCHES.items():
        if key not in _given(spark):
            spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_evospark_shipped", False) or not os.path.isdir(_ROOT):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="evospark-"), "evospark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_ROOT):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("evospark", os.path.relpath(full, _ROOT)))
    context.addPyFile(path)
    context._evospark_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode; a
    cluster's executors wouldn't share that, so there it is an error."""
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="evospark-")
    return _local_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application's file system closes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage and repeated work end there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("evospark")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
