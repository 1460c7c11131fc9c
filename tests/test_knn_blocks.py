"""Imputation by nearest neighbours against brute force, over many blocks and beyond the number of rows that one task held."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import features


def test_blocks(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(0, 3)) for _ in range(3)], float(rng.randint(0, 9))) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None, 1.0), (901, [1.0, None, 2.0], 1.0)], "id long, v array<double>, y double")
    known = [r for r in rows if r[0] % 3]
    expected = {}
    for i, v, _ in rows:
        if i % 3 == 0:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j, y) for j, w, y in known)[:7]
            expected[i] = max(sum(y for *_, y in near) / 7, 3.0)
    found = features.knn_impute(df.where("id % 3 = 0"), df.where("id % 3 <> 0"), "id", "v", "y", k=7, floor=3.0, block=16, query_block=8)
    assert {r.id: r.imputed for r in found.collect()} == pytest.approx(expected)


def test_more_known_rows_than_the_former_cap(spark):
    known = spark.range(200_003).select("id", F.array(F.col("id").cast("double")).alias("v"), F.col("id").cast("double").alias("y"))
    unknown = spark.createDataFrame([(-1, [150_000.2]), (-2, [200_002.0])], "id long, v array<double>")
    found = {r.id: r.imputed for r in features.knn_impute(unknown, known, "id", "v", "y", k=3).collect()}
    assert found == {-1: pytest.approx(np.mean([149_999, 150_000, 150_001])), -2: pytest.approx(200_001)}
