"""The diversity feature: same values however its vectors and items are dealt, and no vector beside an item in a shuffle."""

import math
import random

import numpy as np
import pytest

from larkspan.operators import features

ODD = {3: [0.0] * 8, 5: [1.0, 2.0], 7: [1.0, None, 2.0], 11: [float("nan")] * 8, 13: None}


def _tables(spark):
    draw = random.Random(5)
    vectors = [(k, None if k % 4 == 3 else k % 4, ODD.get(k, [draw.gauss(0, 1) for _ in range(8)])) for k in range(40)]
    vectors += [(20, 0, [1.0] * 8), (20, 1, [2.0] * 8), (None, 1, [1.0] * 8)]
    items = [(o, k) for o in range(60) for k in draw.choices(range(44), k=draw.randrange(1, 9))]
    items += [(None, k) for k in range(40)] + [(99, 21)] * 5 + [(98, 20)] * 3 + [(97, None)]
    return spark.createDataFrame(items, "o long, k long"), spark.createDataFrame(vectors, "k long, c int, v array<float>"), items, vectors


def _expected(items, vectors):
    groups: dict = {}
    for o, k in items:
        for key, c, v in vectors:
            if k is not None and k == key:
                groups.setdefault((o, c), []).append(v)
    out = {}
    for g, found in groups.items():
        n, total, nz, some = len(found), np.zeros(8), 0, False
        for v in found:
            if v is not None and None not in v:
                x = np.zeros(8)
                x[: len(v)] = np.float32(v)
                s = math.sqrt((x * x).sum())
                some, nz = True, nz + (s > 0 or math.isnan(s))
                total += x / (s or 1)
        out[g] = (n, math.log(2) if n == 1 else None if not some or None in found else math.log1p(n * (1 - ((total * total).sum() - nz) / (n * (n - 1)))))
    return out


@pytest.mark.parametrize("listed, block, per_cell", [(256, 1 << 23, 1 << 23), (4, 1 << 23, 20), (256, 16, 20), (4, 16, 1 << 23)])
def test_any_dealing(spark, listed, block, per_cell):
    items, vectors, i, v = _tables(spark)
    rows = features.diversity(items, vectors, "o", "k", "c", "v", listed, block, per_cell).collect()
    expected = _expected(i, v)
    assert len(rows) == len(expected)
    for r in rows:
        n, value = expected[r.o, r.c]
        assert r.k == n
        assert (r.diversity is None) == (value is None), (r, value)
        assert value is None or r.diversity == pytest.approx(value, abs=1e-9, nan_ok=True)


def test_shuffled_bytes(spark):
    """Ten times the dimensions of the vectors may not be ten times the shuffle."""
    size = {}
    for d in (0, 8, 256):
        vectors = spark.range(40).selectExpr("id as k", "int(id % 4) as c", f"transform(sequence(1, {d or 1}), i -> float(pmod(xxhash64(id, i), 1000) - 500)) as v")
        items = spark.range(40000 if d else 0).selectExpr("id div 5 as o", "pmod(xxhash64(id), 40) as k")
        df = features.diversity(items, vectors, "o", "k", "c", "v")
        df.write.format("noop").mode("overwrite").save()
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        size[d] = sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))
    assert size[256] - size[8] < 3 * (size[8] - size[0]), size
