"""Density clusters against the definition on a full matrix."""

import numpy as np
import pytest

from larkspan.operators import density, topics


def parts(w, nodes, below):
    left, out = set(nodes), []
    while left:
        todo = [left.pop()]
        found = set(todo)
        while todo:
            a = todo.pop()
            near = [b for b in left if w[a, b] < below]
            left.difference_update(near)
            found.update(near)
            todo += near
        out.append(sorted(found))
    return out


def brute(x, least):
    """Top-down: each cluster loses its pieces as the distance falls, until two pieces of the least size part."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d + np.diag([np.inf] * n), 1)[:, least - 1]
    w = np.round(np.maximum(np.maximum(np.maximum(d, core[:, None]), core[None]), density.NEAREST), 12)
    clusters = []

    def grow(points, birth):
        own = {"points": points, "birth": birth, "leave": {}, "below": []}
        clusters.append(own)
        now = points
        while True:
            values = np.unique(w[np.ix_(now, now)][np.triu_indices(len(now), 1)])
            lo, hi = 0, len(values) - 1
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if len(parts(w, now, np.nextafter(values[mid], np.inf))) == 1 else (mid + 1, hi)
            pieces = parts(w, now, values[lo])
            big = [p for p in pieces if len(p) >= least]
            for p in pieces:
                if len(big) != 1 or p is not big[0]:
                    own["leave"].update(dict.fromkeys(p, 1 / values[lo]))
            if len(big) != 1:
                own["below"] = [grow(p, 1 / values[lo]) for p in big]
                return own
            now = big[0]

    def value(c):
        below = sum(map(value, c["below"]))
        own = sum(v - c["birth"] for v in c["leave"].values())
        c["better"] = own >= below - 1e-9
        return max(own, below)

    def pick(c):
        return [c["points"]] if c["better"] else [p for b in c["below"] for p in pick(b)]

    label = np.full(n, -1)
    root = grow(list(range(n)), 0.0)
    for b in root["below"]:
        value(b)
    for k, p in enumerate(sorted((p for b in root["below"] for p in pick(b)), key=lambda p: (-len(p), p[0]))):
        label[p] = k
    return label


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(0)
    groups = [rng.standard_normal((rng.integers(6, 25), 3)) * rng.choice([0.1, 0.3, 1]) + rng.standard_normal(3) * 4 for _ in range(5)]
    x = np.vstack([*groups, rng.standard_normal((8, 3)) * 6])
    return np.vstack([x, x[:2], np.repeat(x[7:8], 5, 0)])


@pytest.mark.parametrize("sizes,kw", [([5, 3], {}), ([3], {"block": 30, "level": 30}), ([4], {"per_task": 40})])
def test_density_clusters(spark, x, sizes, kw, monkeypatch):
    monkeypatch.setattr(density, "PART", 17)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(900, None, "x"), (901, [None, 1.0, 2.0], "x"), (902, [float("nan")] * 3, "x"), (903, [1.0], "x"), (None, [1.0, 2.0, 3.0], "x")]
    got = density.density_clusters(spark.createDataFrame(rows, "k long, v array<double>, topic string"), "k", "v", sizes, **kw).toPandas()
    assert len(got) == len(sizes) * len(rows)
    for least in sizes:
        own = got[(got.min_size == least) & (got.k < 900)].sort_values("k")
        assert own.topic.tolist() == brute(x, least).tolist() and own.topic.max() >= 2
        assert ((own.strength > 0) == (own.topic >= 0)).all() and own.strength.max() == 1
        assert (got[(got.min_size == least) & ~(got.k < 900)].topic == -1).all()


def test_density_of_little(spark):
    schema = "k long, v array<double>"
    assert density.density_clusters(spark.createDataFrame([], schema), "k", "v", [3]).count() == 0
    same = density.density_clusters(spark.createDataFrame([(i, [1.0, 1.0]) for i in range(6)], schema), "k", "v", [3]).collect()
    assert [r.topic for r in same] == [-1] * 6
    one = density.core_distances(spark.createDataFrame([(1, [1.0, 2.0])], schema), "k", "v", 5).collect()
    assert [(r.k, r.core) for r in one] == [(1, 0.0)]


def test_spanning_tree_by_rounds(spark):
    rng = np.random.default_rng(3)
    n = 60
    w = {(i, j): float(rng.integers(1, 30)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3 and (i < 50) == (j < 50)}
    top, expected = list(range(n)), []

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for v, i, j in sorted((v, i, j) for (i, j), v in w.items()):
        if find(i) != find(j):
            top[find(i)] = find(j)
            expected.append((i, j, v))
    edges = spark.createDataFrame([(i, j, v) for (i, j), v in w.items()], "a long, b long, w double").repartition(3)
    for per_task in (1 << 20, 5):
        assert sorted(tuple(r) for r in density.spanning_tree(edges, per_task).collect()) == sorted(expected)


def test_noise_is_reassigned(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 1), (4, [0.1, 1.0], -1), (5, [-1.0, -1.0], -1), (6, None, -1), (7, [2.0, 0.1], None)]
    df = spark.createDataFrame(rows, "k long, v array<double>, topic int")
    assert sorted(tuple(r) for r in topics.reassign_noise(df, "k", "v", "topic").collect()) == [(1, 0, False), (2, 0, False), (3, 1, False), (4, 1, True), (5, -1, False), (6, -1, False), (7, 0, True)]


def test_estimates_stay_small(spark):
    """The self-joins of a deep chain of clusters don't square the planner's estimate of their size in each round."""
    chain = spark.range(200).selectExpr("id AS cluster", "id + 1 AS parent", "id = 150 AS better")
    found = density.selected(chain)
    assert int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 60
    assert {r.cluster: r.topic for r in found.collect()} == {i: 150 if i <= 150 else None for i in range(200)}


def test_spanning_trees_by_passes(spark, monkeypatch):
    """Tight groups that no list of near rows leaves, far away and with equal rows, in several blocks: the weights of a tree by Prim."""
    monkeypatch.setattr(density, "PART", 13)
    monkeypatch.setattr(density, "COLUMNS", 11)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.standard_normal(4) * 1e3 + rng.standard_normal((15, 4)) * s for s in (1e-7, 0.01, 1, 1, 30)])
    x[3] = x[4] = x[5]
    n, sizes, k = len(x), [2, 4], 5
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, x array<double>")
    near = density.nearest_rows(rows, n, k, 20)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    by_distance = np.sort(d + np.diag([np.inf] * n), 1)
    assert np.allclose([[e.d for e in r.near] for r in near.sort("node").collect()], by_distance[:, :k], rtol=1e-12, atol=0)
    cores = [near["near"][s - 1]["d"].alias(f"core{i}") for i, s in enumerate(sizes)]
    trees = density.spanning_trees(rows.join(near, "node").select("node", "x", *cores), near, n, len(sizes), 20)
    for s, tree in zip(sizes, trees):
        core = by_distance[:, s - 1]
        w = np.maximum(np.maximum(np.maximum(d, core[:, None]), core), density.NEAREST)
        best, weights, out = w[0].copy(), [], np.zeros(n, bool)
        out[0] = True
        for _ in range(n - 1):
            j = int(np.where(out, np.inf, best).argmin())
            weights.append(best[j])
            out[j], best = True, np.minimum(best, w[j])
        assert np.allclose(sorted(r.w for r in tree.collect()), sorted(weights), rtol=1e-12, atol=0)
