"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SET: set[str] = set()  # what it was set to here
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(app: str = "cloakframe", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .getOrCreate()
    )


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Let batches that go to Python end at ``size`` bytes where the session has not chosen another size."""
    if spark.conf.get(_BATCH, None) in (None, "67108864b", "64MB", *_SET):
        _SET.add(str(size))
        spark.conf.set(_BATCH, str(size))


def run_folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a local one only where none is named and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cloakframe-run-")
    return f"{root.rstrip('/')}/run-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Rows written once to a new shared folder and read from there, for work that passes over them many times."""
    folder = run_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names; a local one only where none is set and all runs on one machine."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cloakframe-checkpoint-"))
    return df.checkpoint(eager=True)
