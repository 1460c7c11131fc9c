"""Tables that grow are dealt to more tasks, so that none joins or sorts more than a fixed number of rows."""

import duckdb
import pytest

from larkspan import session
from larkspan.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def _most(spark, df) -> int:
    """Rows of the largest task that reads a shuffle."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    status = spark.sparkContext._jsc.sc().statusStore()
    none = jvm.java.util.ArrayList

    def stages():
        found = status.stageList(none(), False, False, gateway.new_array(jvm.double, 0), none())
        return {found.apply(i).stageId(): found.apply(i).attemptId() for i in range(found.size())}

    before, most = set(stages()), 0
    df.write.format("noop").mode("overwrite").save()
    for stage, attempt in stages().items():
        if stage not in before:
            tasks = status.taskList(stage, attempt, 10000)
            for i in range(tasks.size()):
                m = tasks.apply(i).taskMetrics()
                most = max(most, m.get().shuffleReadMetrics().recordsRead() if m.isDefined() else 0)
    return most


@pytest.mark.parametrize("name", ["first_wins_dedup", "cluster_share"])
def test_tasks_grow_with_rows(spark, monkeypatch, name):
    monkeypatch.setattr(session, "TASK_ROWS", 200, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalogue.queries()[name](spark, FOLDER)
        assert _most(spark, df) < 800
        rows = sorted((tuple(r) for r in df.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    duck = duckdb.connect()
    for table in "part orders lineitem embeddings".split():
        duck.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    assert rows == sorted(duck.sql(f"select {', '.join(df.columns)} from ({catalogue.oracle_sql()[name]})").fetchall(), key=repr)
