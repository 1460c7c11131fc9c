"""The ordered probit against a brute-force likelihood on the same values."""

import math
import random

import pytest

from larkspan.operators import models


def likelihood(rows, fit, weights, thresholds):
    cdf = lambda v: 0.5 * math.erfc(-v / math.sqrt(2))
    edges, total = [-math.inf, *thresholds, math.inf], 0.0
    for a, b, y in rows:
        eta = sum(w * (v - m) / s for w, v, m, s in zip(weights, (a, b), fit.mean, fit.scale))
        k = fit.classes.index(y)
        total += math.log(cdf(edges[k + 1] - eta) - cdf(edges[k] - eta))
    return total


def skewed(n=400):
    rng, rows = random.Random(4), []
    for _ in range(n):
        a, b = rng.lognormvariate(0, 1.3), rng.gauss(0, 1)
        v = 0.15 * a - 0.7 * b + rng.gauss(0, 1)
        rows.append((a, b, 1 if v < -0.3 else 2 if v < 0.6 else 4))
    return rows


def test_maximum_of_the_likelihood(spark):
    rows = skewed()
    df = spark.createDataFrame([*rows, (None, 1.0, 2), (1.0, 1.0, None)], "a double, b double, y int").repartition(3)
    fit = models.fit_ordered_probit(df, ["a", "b"], "y")
    found = dict(models.ordered_probit(df, ["a", "b"], "y"))
    weights, thresholds = [found["weight_a"], found["weight_b"]], [found["threshold_1"], found["threshold_2"]]
    best = likelihood(rows, fit, weights, thresholds)
    assert best == pytest.approx(fit.log_likelihood, abs=1e-6)
    # Its slope is zero in every direction.
    for i in range(4):
        sides = []
        for d in (-1e-4, 1e-4):
            v = [*weights, *thresholds]
            v[i] += d
            sides.append(likelihood(rows, fit, v[:2], v[2:]))
        assert abs(sides[1] - sides[0]) / 2e-4 < 1e-3 and max(sides) <= best + 1e-9


def test_no_convergence_is_an_error(spark):
    apart = spark.createDataFrame([(float(i), 1 + (i >= 20)) for i in range(40)], "a double, y int")
    with pytest.raises(RuntimeError, match="converge"):
        models.ordered_probit(apart, ["a"], "y", steps=8)
    assert models.ordered_probit(apart.where("y = 1"), ["a"], "y") == []
