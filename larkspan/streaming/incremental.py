"""Incremental processing (X1-X4): each micro-batch is merged by key, so a repeated delivery changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import keep_first


def run_available(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands everything there is to ``merge(batch, epoch)`` and stops; the next call continues after it."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_distinct(stream: DataFrame, time: str, keys: list[str], age: str = "90 days") -> DataFrame:
    """Drops repeats of a key within the age, and rows later than it. State is bounded by the watermark."""
    return stream.withWatermark(time, age).dropDuplicatesWithinWatermark(keys)


def merge_parquet(path: str, keys: list[str], latest: list[Column]) -> Callable[[DataFrame, int], None]:
    """A merge into a Parquet table: the latest row of each key stays. Each epoch writes a new version of the table beside the old one, which
    stays readable and makes a repeated epoch harmless. The base is the last version before it that was written whole."""

    def merge(batch: DataFrame, epoch: int) -> None:
        before = [v for v in versions(batch.sparkSession, path) if v < epoch]
        rows = batch.sparkSession.read.parquet(f"{path}/v{before[-1]}").unionByName(batch) if before else batch
        keep_first(rows, keys, latest).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return merge


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a merged table that were written whole, ascending, by Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The merged table as of its last whole version."""
    return spark.read.parquet(f"{path}/v{versions(spark, path)[-1]}")
