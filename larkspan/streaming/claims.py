"""Claims of queue rows by several workers (S10): no row is taken twice while a claim lasts, and a claim that ran out is taken again.

A claim is optimistic: a worker reads the log, picks the first free rows, writes their ids as Parquet and publishes them under the log's next number. If
another worker was faster, the number is taken, and it picks again. The rows themselves are never locked or copied.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import log

CLAIMED, DONE, ERROR, STATE = "claimed", "done", "error", "state"
_STATE = "id {kind}, worker string, until double, status string, number long"


@dataclass(frozen=True)
class Claims:
    """The log of a queue's claims in a folder that all workers share. ``kind``: the type of the ids."""

    spark: SparkSession
    folder: str
    kind: str = "long"
    #: Entries after which the state is written down whole, so that a reader opens no more than these.
    fold: int = 32

    def state(self, upto: int | None = None) -> tuple[DataFrame, int]:
        """The latest entry of each id that was ever claimed (id, worker, until, status, number), and the number of the last entry."""
        found = [n for n in log.numbers(self.spark, self.folder) if upto is None or n <= upto]
        entries: list[tuple[int, dict]] = []
        for n in reversed(found):
            entries.append((n, log.entry(self.spark, self.folder, n)))
            if entries[-1][1]["status"] == STATE:
                break
        rows = self.spark.createDataFrame([], _STATE.format(kind=self.kind))
        for n, e in entries:
            data = self.spark.read.schema(_STATE.format(kind=self.kind)).parquet(e["data"])
            rows = rows.unionByName(data if e["status"] == STATE else data.withColumn("number", F.lit(n).cast("long")))
        last = rows.groupBy("id").agg(F.max_by(F.struct("worker", "until", "status", "number"), "number").alias("s"))
        return last.select("id", "s.*"), found[-1] if found else -1

    def _add(self, rows: DataFrame, number: int, status: str) -> str | None:
        data = f"{self.folder}/data/{uuid4().hex}"
        rows.write.parquet(data)
        if log.publish(self.spark, self.folder, number, {"status": status, "data": data}):
            return data
        log.remove(self.spark, data)
        return None

    def claim(self, waiting: DataFrame, id_col: str, n: int, worker: str, lease: float, order: list[str] | None = None, now: float | None = None) -> DataFrame:
        """The first n rows of ``waiting`` in the order (ties by id) that nobody holds: never claimed, or by a claim that ran out before ``now`` and was
        not finished. They are this worker's for ``lease`` seconds. Fewer or no rows if there are no more. Null ids are never claimed."""
        while True:
            at = time.time() if now is None else now
            state, last = self.state()
            if last >= 0 and (last + 1) % self.fold == 0:
                self._add(state, last + 1, STATE)
                continue
            held = state.where((F.col("status") != CLAIMED) | (F.col("until") > at)).select("id")
            free = waiting.where(F.col(id_col).isNotNull()).join(held.withColumnRenamed("id", id_col), id_col, "left_anti")
            some = free.orderBy(*(order or []), id_col).limit(n).select(F.col(id_col).cast(self.kind).alias("id"))
            rows = some.select("id", F.lit(worker).alias("worker"), F.lit(float(at + lease)).alias("until"), F.lit(CLAIMED).alias("status"), F.lit(last + 1).cast("long").alias("number"))
            data = self._add(rows, last + 1, CLAIMED)
            if data is not None:
                return waiting.join(self.spark.read.parquet(data).select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi").select(*waiting.columns)

    def finish(self, ids: DataFrame, id_col: str, worker: str, status: str = DONE) -> int:
        """Marks the ids that this worker still holds (nobody claimed them after it) as done, or as an error. Returns how many."""
        while True:
            state, last = self.state()
            mine = state.where((F.col("status") == CLAIMED) & (F.col("worker") == worker)).join(ids.select(F.col(id_col).cast(self.kind).alias("id")).distinct(), "id", "left_semi")
            data = self._add(mine.withColumn("status", F.lit(status)), last + 1, status)
            if data is not None:
                return self.spark.read.parquet(data).count()
