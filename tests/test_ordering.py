"""Numbers in a total order, exact selection, stratified and drawn resampling against numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import metrics, ordering, resampling


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 2000), np.round(rng.standard_normal(2000), 2))]
    return out + [(7, 5.0)] * 600 + [(8, 1.5), (None, 2.5), (None, 3.5), (9, None)] + [(0, 0.25)] * 500


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g int, v double").repartition(3)


@pytest.mark.parametrize("held", [1 << 16, 40])
@pytest.mark.parametrize("continuous", [True, False])
def test_quantiles(df, rows, held, continuous):
    cuts = [0.1, 0.5, 0.975, 0, 1]
    got = {r.g: (r.n, r.q) for r in ordering.quantiles(df, "g", "v", cuts, continuous, held).collect()}
    for g in {r[0] for r in rows}:
        x = [v for a, v in rows if a == g and v is not None]
        if not x:
            assert got[g] == (0, None)
            continue
        expected = [np.percentile(x, 100 * p, method="linear" if continuous else "inverted_cdf") for p in cuts]
        assert got[g][0] == len(x) and np.allclose(got[g][1], expected), g


def test_quantiles_of_one_group_with_all_rows(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(0, 4, 3000), np.full(2500, 7.25), -rng.lognormal(0, 9, 500)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(4)
    got = ordering.quantiles(df, None, "v", [0.001, 0.3, 0.5, 0.77], held=30).first()
    assert got.n == len(x) and np.allclose(got.q, np.percentile(x, [0.1, 30, 50, 77]), rtol=1e-12)
    assert ordering.quantiles(df.limit(0), None, "v", [0.5]).count() == 0


def test_ranks_beyond_a_group_are_left_out(spark, df):
    wanted = spark.createDataFrame([(8, 0), (8, 1), (7, 599), (7, 600), (77, 0)], "g int, rank long")
    for held in (1 << 16, 40):
        assert sorted(tuple(r) for r in ordering.order_statistics(df, "g", "v", wanted, held).collect()) == [(7, 599, 5.0), (8, 0, 1.5)]


def test_placed(df, rows):
    own = df.withColumn("id", F.monotonically_increasing_id())
    for r in (ordering.placed(own, [F.col("v").asc_nulls_first(), F.col("id")], "k", start=5).collect(), metrics.numbered(own, "v", "id", "k").collect()):
        r = sorted(r, key=lambda x: x.k)
        assert [x.k - r[0].k for x in r] == list(range(len(rows))) and [(x.v is not None, x.v or 0.0, x.id) for x in r] == sorted((x.v is not None, x.v or 0.0, x.id) for x in r)
    found = ordering.placed(own, [F.desc_nulls_last("v"), F.col("id")], "k", ["g"]).collect()
    for g in {r[0] for r in rows}:
        r = sorted((x.k, -(x.v or 0), x.id) for x in found if x.g == g)
        assert [k for k, *_ in r] == list(range(len(r))) and [x[1:] for x in r] == sorted(x[1:] for x in r)


def test_placed_splits_one_frequent_value(spark):
    df = spark.range(4000).withColumn("v", F.lit(1.0))
    found = ordering.placed(df.repartition(4), [F.col("v"), F.col("id")], "k")
    assert found.where("id <> k").count() == 0
    # No task had all rows: the ranges are cut within the value.
    dealt = df.repartitionByRange(4, "v", "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 3000
    assert ordering.placed(df.limit(0), [F.col("id")], "k").count() == 0


def test_multinomial_keeps_strata_whole(monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 16)
    resampling._block_counts.cache_clear()
    sizes = [100, 37, 1, 16]
    strata, places = np.repeat(range(4), sizes), np.concatenate([np.arange(n) for n in sizes])
    rounds = np.arange(-1, 200)
    w = resampling.multinomial(strata, places, sizes, rounds)
    resampling._block_counts.cache_clear()
    assert all((w[strata == s].sum(0) == n).all() for s, n in enumerate(sizes)) and (w[:, 0] == 1).all()
    # In another order and with other rounds beside, the numbers are the same.
    order = np.random.default_rng(0).permutation(len(strata))[:50]
    assert (resampling.multinomial(strata[order], places[order], sizes, rounds[70:90]) == w[order][:, 70:90]).all()
    resampling._block_counts.cache_clear()
    many = w[:100, 1:]
    assert abs(many.var() - 0.99) < 0.06 and abs((many == 0).mean() - 0.99**100) < 0.01 and abs(np.corrcoef(many)[np.triu_indices(100, 1)].mean() + 1 / 99) < 0.005


def test_stratified_rounds(spark):
    rows = [(i, "ab"[i % 3 > 0], float(i) if i % 10 else None) for i in range(300)] + [(900, None, 1.0)]
    df = spark.createDataFrame(rows, "k long, s string, v double")
    found = {(r.s, r["round"]): r for r in resampling.stratified_rounds(df.repartition(3), "k", "s", "v", 70).collect()}
    assert len(found) == 140 and all(r.n == (100 if s == "a" else 200) and 0 < r.rows <= r.n for (s, _), r in found.items())
    again = {(r.s, r["round"]): r for r in resampling.stratified_rounds(df.repartition(5), "k", "s", "v", 70).collect()}
    assert all(found[k].rows == again[k].rows and abs(found[k]["mean"] - again[k]["mean"]) < 1e-9 for k in found)
    assert resampling.stratified_rounds(df.limit(0), "k", "s", "v", 3).count() == 0


def test_drawn_interval(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["a", "b", None][i % 3], 0.1 * (i % 5), float(rng.standard_normal()), float(rng.standard_normal())) for i in range(120)] + [(900, "one", 0.5, 3.0, 4.0), (901, "none", 0.5, None, None)]
    df = spark.createDataFrame(rows, "k int, g string, mu double, e double, cv double")
    found = {r.k: r for r in resampling.drawn_interval(df, "g", "mu", "e", 0.1, draws=777, fallback="cv").collect()}
    assert len(found) == len(rows)
    for g in ("a", "b", None, "one"):
        pool = np.sort([r[3] for r in rows if r[1] == g]) if g != "one" else np.sort([r[4] for r in rows if r[4] is not None])
        u = np.array([int(hashlib.md5(f"42:{g or ''}:{b}".encode()).hexdigest()[:13], 16) / (1 << 52) for b in range(777)])
        drawn = np.exp(pool[np.minimum((u * len(pool)).astype(int), len(pool) - 1)])
        for r in (r for r in rows if r[1] == g):
            expected = np.exp(r[2]) * np.percentile(drawn, [10, 90, 20, 80])
            assert np.allclose([found[r[0]][c] for c in ("lower_a", "upper_a", "lower_2a", "upper_2a")], expected)
    assert found[901].lower_a is None or found[901].lower_a > 0
