"""Claims by several workers at once, and a bucketed table under merges."""

import threading

import pytest
from pyspark.sql import functions as F

from larkspan.streaming import log
from larkspan.streaming.buckets import BucketTable
from larkspan.streaming.claims import DONE, ERROR, Claims


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_number_is_published_once(spark, tmp_path):
    folder, won = f"{tmp_path}/log", []
    threads = [threading.Thread(target=lambda i=i: won.append(log.publish(spark, folder, 7, {"who": i}))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 7 + [True] and log.numbers(spark, folder) == [7] and "who" in log.entry(spark, folder, 7)
    assert [c for c in log.children(spark, folder) if "json" not in c] == []


def test_two_workers_share_a_queue(spark, tmp_path):
    waiting = spark.range(60).repartition(2)
    taken, failed = {"a": [], "b": []}, []

    def work(name):
        try:
            claims = Claims(spark, f"{tmp_path}/claims", fold=5)
            while True:
                got = claims.claim(waiting, "id", 9, name, lease=1000)
                rows = ids(got)
                if not rows:
                    return
                taken[name] += rows
                assert claims.finish(got, "id", name) == len(rows)
        except Exception as e:  # shown by the assertion below
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in taken]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and sorted(taken["a"] + taken["b"]) == list(range(60))
    assert {r.status for r in Claims(spark, f"{tmp_path}/claims").state()[0].collect()} == {DONE}


def test_leases_run_out(spark, tmp_path):
    waiting = spark.createDataFrame([(i, -i) for i in range(6)] + [(None, 0)], "id long, rank int")
    claims = Claims(spark, f"{tmp_path}/claims")
    first = claims.claim(waiting, "id", 2, "a", 10, ["rank"], now=100.0)
    assert ids(first) == [4, 5] and ids(claims.claim(waiting, "id", 2, "b", 10, ["rank"], now=105.0)) == [2, 3]
    # a's claim ran out, b's did not; what a finishes afterwards is no longer a's.
    assert ids(claims.claim(waiting, "id", 9, "c", 10, ["rank"], now=112.0)) == [0, 1, 4, 5]
    assert claims.finish(first, "id", "a") == 0 and claims.finish(first, "id", "c", ERROR) == 2
    assert ids(claims.claim(waiting, "id", 9, "d", 10, now=1000.0)) == [0, 1, 2, 3]
    assert ids(claims.claim(waiting.limit(0), "id", 9, "d", 10, now=1000.0)) == []


@pytest.fixture
def table(tmp_path):
    return BucketTable(f"{tmp_path}/t", ["k"], [F.desc("at"), F.col("v")], buckets=256, pieces=3, versions=2)


def rows(spark, items):
    return spark.createDataFrame(items, "k long, v string, at int")


def test_merges(spark, table):
    assert table.read(spark) is None and table.merge(rows(spark, []), 0) is False
    expected = {i: ("first", 0) for i in range(500)}
    assert table.merge(rows(spark, [(i, "first", 0) for i in range(500)] + [(3, "older", -1)]), 1)
    for epoch in range(2, 9):
        some = [(i, f"e{epoch}", epoch) for i in range(epoch, 500, 97)] + [(1000 + epoch, "new", epoch), (5, "late", -5)]
        assert table.merge(rows(spark, some), epoch) and table.merge(rows(spark, some), epoch) is False
        expected |= {k: (v, at) for k, v, at in some if at > 0}
        found = table.read(spark).collect()
        assert len(found) == len(expected) and {r.k: (r.v, r["at"]) for r in found} == expected
    assert len(log.numbers(spark, f"{table.path}/log")) == 2
    with_null = rows(spark, [(None, "null key", 1), (None, "again", 2)])
    assert table.merge(with_null, 50) and [r.v for r in table.read(spark).where("k IS NULL").collect()] == ["again"]


def test_a_small_epoch_writes_little(spark, table):
    table.merge(rows(spark, [(i, "x" * 20, 0) for i in range(20000)]), 1)
    before = set(log.children(spark, f"{table.path}/data"))
    table.merge(rows(spark, [(i, "y", 1) for i in range(0, 20000, 100)]), 2)
    new = set(log.children(spark, f"{table.path}/data")) - before
    written = spark.read.parquet(*(f"{table.path}/data/{n}" for n in new)).count()
    assert written == 200 and table.read(spark).where("v = 'y'").count() == 200 and table.read(spark).count() == 20000


def test_old_versions_go(spark, table):
    for epoch in range(1, 12):
        table.merge(rows(spark, [(i, f"e{epoch}", epoch) for i in range(4)]), epoch)
    listed = {p.rsplit("/", 1)[0].rsplit("/", 1)[1] for n in log.numbers(spark, f"{table.path}/log") for ps in log.entry(spark, f"{table.path}/log", n)["buckets"].values() for p in ps}
    assert set(log.children(spark, f"{table.path}/data")) <= listed and len(listed) <= 8
    before = log.numbers(spark, f"{table.path}/log")[0]
    assert {r["at"] for r in table.read(spark, before).collect()} == {10}
