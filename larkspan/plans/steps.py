"""Step registry with transitive dependencies (the orchestration of SURVEY 3.1, Q11), and one round of collecting pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ingest, records

Step = Callable[[dict[str, DataFrame], bool], DataFrame]


class Steps:
    """Named steps; each gets the results so far and ``force``."""

    def __init__(self) -> None:
        self.functions: dict[str, Step] = {}
        self.needs: dict[str, list[str]] = {}

    def add(self, name: str, function: Step, needs: list[str] = ()) -> Steps:
        unknown = [n for n in needs if n not in self.functions]
        if unknown:
            raise ValueError(f"{name} needs unknown steps {unknown}")
        self.functions[name], self.needs[name] = function, list(needs)
        return self

    def expand(self, wanted: list[str]) -> list[str]:
        """The steps wanted and all they need, in order of registration."""
        unknown = [n for n in wanted if n not in self.functions]
        if unknown:
            raise ValueError(f"unknown steps {unknown}")
        found, todo = set(), list(wanted)
        while todo:
            name = todo.pop()
            if name not in found:
                found.add(name)
                todo += self.needs[name]
        return [n for n in self.functions if n in found]

    def run(self, inputs: dict[str, DataFrame], wanted: list[str] | None = None, force: bool = False) -> dict[str, DataFrame]:
        results = dict(inputs)
        for name in self.expand(list(self.functions) if wanted is None else wanted):
            results[name] = self.functions[name](results, force)
        return results


def collect(queue: DataFrame, pages: DataFrame, known: DataFrame, site: records.Site, n: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """The first n waiting rows of the queue (id, url, source, status, ...), their landed pages (url, html) as records merged into the
    known ones by vacancy and source, and the queue with each row's outcome: done, or error without a page. Returns the records, with the columns of
    the known ones, and the queue. One pass over sets; an empty batch changes nothing."""
    batch = ingest.dequeue(queue, n, F.col("status") == "pending", "id")
    landed = batch.select("url").join(pages.select("url", "html"), "url", "left")
    found = records.record(landed.where("html IS NOT NULL"), site).select(*known.columns)
    found = ingest.keep_first(found, ["vacancy_id", "source"], [F.col(c) for c in known.columns])
    missing = F.col("html").isNull()
    outcome = landed.select("url", F.when(missing, "error").otherwise("done").alias("status"), F.when(missing, "no page").alias("error")).distinct()
    return ingest.upsert(known, found, ["vacancy_id", "source"]), ingest.set_status(queue, outcome, "url", now)
