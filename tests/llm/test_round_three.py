"""Periodic runs, near duplicates of vectors and whitening against brute force, with the awkward cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import periodic_runs, queries, vector_dedup, whitening
from larkspan.llm.core import materialize


def brute_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            if i > s and size >= max(6, 4 * q) and not any(a <= s and a + m >= s + size for a, m, _ in out):
                out.add((s, size, q))
            i += i == s
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(3000):
        k, w = rng.choice([1, 2, 2, 3, 4]), []
        for _ in range(rng.randint(0, 12)):
            w += [b"abcd"[x : x + 1] for x in [rng.randrange(k) for _ in range(rng.randint(1, 5))]] * rng.choice([1, 1, 2, 4, 5, 7])
            if rng.random() < 0.2:
                w += w[-rng.randint(1, len(w)) :] * rng.randint(1, 3)
        assert periodic_runs.runs(w[:200]) == brute_runs(w[:200])


def test_long_pairs_agree_as_they_say():
    rng = random.Random(2)
    for _ in range(300):
        w = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(1, 6))] * rng.randint(1, 30) + [b"c"] * rng.randint(0, 9)
        for up in (True, False):
            for j, r, common in periodic_runs.long_pairs(w, up):
                assert w[j : j + common] == w[r : r + common] and (r + common == len(w) or w[j + common] != w[r + common])


def test_comparisons_stay_linear(monkeypatch):
    """One word over and over, a long period and Fibonacci words: the words that are compared beyond the first are a few times the text's."""
    seen = []
    real = periodic_runs.agreement
    monkeypatch.setattr(periodic_runs, "agreement", lambda words, j, r, known: seen.append((real(words, j, r, known), known)) or seen[-1][0])
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 20000:
        a, b = b, b + a
    for w in ([b"x"] * 20000, [b"%d" % (i % 977) for i in range(20000)], b, ([b"p", b"q"] * 50 + [b"r"]) * 200):
        seen.clear()
        list(periodic_runs.long_pairs(w, True)), list(periodic_runs.long_pairs(w, False))
        assert sum(got - max(known, 0) for got, known in seen) <= 6 * len(w)


def test_split_keeps_words_of_long_texts(monkeypatch):
    text = ("wörter und \x0b mehr davon\t" * 40).encode() + b"x" * 300
    monkeypatch.setattr(periodic_runs, "PIECE", 37)
    assert periodic_runs.split(text) == text.split()


def test_periodic_runs(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b y", "ä ö ä ö ä ö ä ö ä", "no run at all here", "w " * 50000, "a b a b a b a b a b a b", "q " * 6 + "z " * 9, "1 2 3 4 5 " * 5000 + "6"]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(3, "b b b b b b b", "clash", 1), (None, "c " * 7, None, 2), (5, texts[5], None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    found = periodic_runs.periodic_runs(docs).collect()
    assert len(found) == len(rows)
    expected = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        runs = periodic_runs.runs(w) if len(w) > 1000 else brute_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        expected.append((i, len(w), runs, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=repr) == sorted(expected, key=repr)
    assert [(0, 50000, 1)] in [e[2] for e in expected] and [(0, 25000, 5)] in [e[2] for e in expected]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, exponent=3)


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(-20, 180)] + [(7, None), (None, "z " * 8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in queries.queries()["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    expected, tails = set(), 0
    for i, t in rows:
        w = (t or "").split()
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p, tails = 1 + (n - a) // (3 + g % 8), tails + 1
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(x for k, x in enumerate(w) if k not in gone))]
        expected.add((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digest))
    assert got == expected and tails > 5


def brute_links(rows, threshold=0.93):
    top, links, ok = {}, [0] * len(rows), []

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for i, (a, g, v) in enumerate(rows):
        if a is None or g is None or not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        v = np.array(v) / max(map(abs, v))
        ok.append((i, a, g, v / np.sqrt((v * v).sum())))
    for (i, a, g, u), (j, b, h, w) in itertools.combinations(ok, 2):
        if g == h and len(u) == len(w) and u @ w >= threshold:
            links[i] += 1
            links[j] += 1
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    takes = {o[0] for o in ok}
    out = [(a, links[i], find(a) if i in takes else a) for i, (a, _, _) in enumerate(rows)]
    return sorted(((a, n, c, a is None or a == c) for a, n, c in out), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((25, 20))
    rows = [(i, int(rng.integers(3)), (10.0 ** rng.choice([0, 200, -200, -310, 300]) * (base[rng.integers(25)] + rng.standard_normal(20) * rng.choice([0, 0.15, 0.3, 0.4]))).tolist()) for i in range(350)]
    rows += [(1000, 1, None), (1001, 1, []), (1002, 1, [0.0] * 20), (1003, 1, [float("nan")] * 20), (1004, 1, [None] + [1.0] * 19), (None, 1, rows[0][2]), (1005, None, rows[0][2])]
    rows += [(1006, 0, [1.0]), (1007, 0, [2.0]), (1008, 0, [float("inf")] * 20), (7, 2, rows[5][2]), (8, 0, rows[9][2]), (8, 0, rows[9][2])]
    return rows + [(2000 + i, 2, rows[5][2]) for i in range(60)]


@pytest.mark.parametrize("block", [16384, 40])
def test_vector_duplicates(spark, vectors, block):
    rows = [(*r, "clash", 1) for r in vectors]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, component_id string, node int")
    found = vector_dedup.near_duplicate_vectors(df, block=block)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()), key=repr) == brute_links(vectors)


def test_vector_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vector_dedup.near_duplicate_vectors(df).count() == 0
    one = spark.createDataFrame([(1, 1, [0.0])], df.schema)
    assert [tuple(r) for r in vector_dedup.near_duplicate_vectors(one).collect()] == [(1, 0, 1, True)]


def test_vector_duplicates_of_one_hot_vector(spark):
    """A third of the rows hold one vector, and another third are near it: rows of the hot class are not shuffled to one task, links are counted."""
    rng = np.random.default_rng(9)
    hot = rng.standard_normal(16)
    rows = [(i, 0, hot.tolist()) for i in range(400)] + [(i, 0, (hot + rng.standard_normal(16) * 0.05).tolist()) for i in range(400, 800)] + [(i, 0, rng.standard_normal(16).tolist()) for i in range(800, 1200)]
    found = {r.vec_id: r for r in vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), block=100).collect()}
    assert {(found[i].n_links, found[i].component_id) for i in range(400)} == {(799, 0)} and all(found[i].kept == (i == 0 or i >= 800) for i in found)


def test_error_bounds_hold():
    rng = np.random.default_rng(5)
    u = vector_dedup.units(rng.standard_normal((60, 1500)) ** 3)
    codes, scale, error = vector_dedup.quantised(u)
    near = vector_dedup.code_products(codes, codes) * scale[:, None] * scale[None, :]
    assert (vector_dedup.code_products(codes, codes) == codes.astype(np.int64) @ codes.astype(np.int64).T).all()
    assert (np.abs(near - u @ u.T) <= error[:, None] + error[None, :] + error[:, None] * error[None, :] + 1e-12).all()


def expected_whitening(x, k):
    u = np.unique(x, axis=0)
    n, s = len(u), u.astype(object).sum(0)
    mean, part = np.array([v // n for v in s], np.int64), np.array([(v % n) / n for v in s])
    c = (u - mean) - part
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    deviation = [int(d) for d in ((n * x.astype(object) - s) ** 2).sum(1)]
    return n, deviation, ((x - mean) - part) @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitening(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((500, 24)) * np.linspace(1, 3, 24)
    v = np.vstack([v, v[:40], np.repeat(v[3:4], 200, 0)])
    rows = [(i, r.tolist(), "clash") for i, r in enumerate(v)]
    bad = [(9000, None, "x"), (9001, [None] + [1.0] * 23, "x"), (9002, [float("nan")] * 24, "x"), (9003, [float("inf")] * 24, "x"), (9004, [1.0], "x"), (9005, [], "x"), (9006, [1e200] * 24, "x")]
    out = whitening.whiten(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n string"), 16).toPandas()
    n, deviation, white, explained = expected_whitening(np.floor(64 * v).astype(np.int64) + 1000000, 16)
    assert len(out) == 16 * len(v) and set(out.vec_id) == set(range(len(v))) and set(out.n) == {n}
    got = out.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.abs(got * np.sign((got * white).sum(0)) - white).max() < 1e-9
    assert out[out.component == 1].sort_values("vec_id").deviation.tolist() == deviation
    first = out[out.vec_id == 0].sort_values("component")
    assert np.allclose(first.explained, explained, rtol=1e-10) and out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9 and (out.residual < 1e-11).all()


def test_subspaces_smaller_than_the_space(spark):
    """Few columns more than components, and a subspace that starts again: the residuals still certify all of them."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.standard_normal((400, 40)) * np.linspace(1, 4, 40) * 64).astype(np.int64) + 10
    fitted = materialize(spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>"))
    exact = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:4]
    for extra, subspace in ((2, 1024), (4, 20)):
        basis = whitening.fit(fitted, 4, extra, subspace=subspace)
        assert 2 < basis.passes < 200 and (basis.residuals < 1e-11).all() and np.allclose(basis.values, exact, rtol=1e-11)
    unfinished = whitening.fit(fitted, 4, 1, passes=2)
    assert unfinished.passes == 3 and unfinished.residuals.max() > 1e-9


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (None, [2.0, 2.0]), (2, [2.0, 2.0])], schema)).collect()
    assert [(r.vec_id, r.component, r.n) for r in line].count((None, 1, 3)) == 1 and len(line) == 4 and all(abs(r.explained - 1) < 1e-12 for r in line)
    wide = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1e11, 1e11])], schema)).collect()
    assert all(r.deviation is None for r in wide) and len(wide) == 2
