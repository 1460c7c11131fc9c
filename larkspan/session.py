"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    base = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers on machines that see this folder import the package (elsewhere, pass it with --py-files), and keeps the batches that they
    get small, so that very long texts don't fill their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, below spark.checkpoint.dir. Only where they are one process may that be unset."""
    import tempfile
    from uuid import uuid4

    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="larkspan-scratch-")
    return f"{folder.rstrip('/')}/scratch-{uuid4().hex}"


#: Rows that one task joins or sorts.
TASK_ROWS = 1 << 20


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of so many rows: as many as set, more where a task would get over ``TASK_ROWS``, so that a task's memory does not grow with
    the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def materialized(df: DataFrame) -> DataFrame:
    """df from reliable files below spark.checkpoint.dir: what made it is not run again, also if executors are lost."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df from Parquet files below spark.checkpoint.dir, so its size is known. A checkpoint keeps the estimate of its plan, and a self-join squares that: in a loop
    the digits of the estimate double in each round, and planning soon takes minutes."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
