"""A keyed table in hash buckets (K3, X3): a merge writes what it brings, and only buckets that gathered too many pieces are written anew.

Each version of the table is an entry of a log that lists the pieces of every bucket, so a reader sees a version whole, and a merge takes effect in one
step. Pieces that no kept version lists are removed.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import keep_first
from . import log


@dataclass(frozen=True)
class BucketTable:
    """keys tell rows apart, ``latest`` orders the rows of one key, the first one counts. A bucket has at most ``pieces`` before it becomes one again;
    ``versions`` are kept."""

    path: str
    keys: list[str]
    latest: list[Column]
    buckets: int = 64
    pieces: int = 4
    versions: int = 3

    def _last(self, spark: SparkSession) -> tuple[int, dict]:
        found = log.numbers(spark, f"{self.path}/log")
        return (found[-1], log.entry(spark, f"{self.path}/log", found[-1])) if found else (-1, {"buckets": {}, "epochs": [], "schema": None})

    def _first(self, rows: DataFrame) -> DataFrame:
        return keep_first(rows, list(self.keys), self.latest)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame | None:
        """The table, or one of its kept versions; None before the first merge. Buckets of one piece are read as they are."""
        entry = log.entry(spark, f"{self.path}/log", version) if version is not None else self._last(spark)[1]
        if entry["schema"] is None:
            return None
        each = spark.read.schema(entry["schema"])
        single = [p[0] for p in entry["buckets"].values() if len(p) == 1]
        several = [p for ps in entry["buckets"].values() if len(ps) > 1 for p in ps]
        parts = ([each.parquet(*single)] if single else []) + ([self._first(each.parquet(*several))] if several else [])
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def merge(self, batch: DataFrame, epoch: int) -> bool:
        """Takes the rows in; the column list is that of the first batch. False if the epoch has been taken before, or brings no rows: nothing changes."""
        spark = batch.sparkSession
        while True:
            number, entry = self._last(spark)
            if epoch in entry["epochs"]:
                return False
            key = F.xxhash64(*(F.col(k) for k in self.keys))
            rows = self._first(batch.select(*entry["columns"]) if entry["schema"] else batch).withColumn("_bucket", F.pmod(key, F.lit(self.buckets)).cast("int"))
            folder = f"{self.path}/data/{uuid4().hex}"
            rows.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
            touched = [int(c.split("=")[1]) for c in log.children(spark, folder) if c.startswith("_bucket=")]
            if not touched:
                log.remove(spark, folder)
                return False
            new = {b: [*p] for b, p in entry["buckets"].items()}
            for b in touched:
                new.setdefault(str(b), []).append(f"{folder}/_bucket={b}")
            schema = entry["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
            full = [b for b in touched if len(new[str(b)]) > self.pieces]
            again = f"{self.path}/data/{uuid4().hex}"
            if full:
                # Buckets that are full become one piece each.
                whole = self._first(spark.read.schema(schema).parquet(*(p for b in full for p in new[str(b)])))
                whole.withColumn("_bucket", F.pmod(key, F.lit(self.buckets)).cast("int")).repartition("_bucket").write.partitionBy("_bucket").parquet(again)
                for b in full:
                    new[str(b)] = [f"{again}/_bucket={b}"]
            # Epochs come in order, so the last ones tell a repeated one.
            content = {"buckets": new, "epochs": [*entry["epochs"], epoch][-1000:], "schema": schema, "columns": entry.get("columns") or batch.columns}
            if log.publish(spark, f"{self.path}/log", number + 1, content):
                if len(full) == len(touched):  # all that came is in the buckets written anew
                    log.remove(spark, folder)
                self._forget(spark)
                return True
            log.remove(spark, folder)
            log.remove(spark, again)

    def _forget(self, spark: SparkSession) -> None:
        """Removes old versions and the folders that no kept version lists and that are older than all of these."""
        found = log.numbers(spark, f"{self.path}/log")
        old, kept = found[: -self.versions], found[-self.versions :]
        folders = lambda n: {p.rsplit("/", 1)[0] for ps in log.entry(spark, f"{self.path}/log", n)["buckets"].values() for p in ps}
        used = set().union(*(folders(n) for n in kept))
        for n in old:
            for folder in folders(n) - used:
                log.remove(spark, folder)
            log.remove(spark, f"{self.path}/log/{n:020d}.json")
