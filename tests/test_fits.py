"""Fits without SQL against brute force; numbering, streams and records on awkward input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import text
from larkspan.operators import features, ingest, metrics, models, records, resampling, skills
from larkspan.streaming import incremental


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        a, b = rng.gauss(5, 2), rng.expovariate(1)
        v = 0.8 * (a - 5) - b + rng.gauss(0, 1.2)
        rows.append((i, a, b, 1 if v < -1.2 else 2 if v < 0.4 else 5))
    return rows, spark.createDataFrame(rows, "k long, a double, b double, y int").repartition(3)


def balanced_fit(z, k, w, c, steps=200):
    """Gradient zero of the weighted multinomial loss, by damped Newton steps."""
    theta, n = np.zeros((c, z.shape[1])), w.sum()
    totals = np.array([w[k == i].sum() for i in range(c)])
    s = w * (n / (c * totals))[k]
    ridge = np.tile(np.append(0.0, np.ones(z.shape[1] - 1)), c)
    for _ in range(steps):
        p = models._softmax(z, theta)
        m = p.copy()
        m[np.arange(len(k)), k] -= 1
        g = ((m * s[:, None]).T @ z).ravel() + ridge * theta.ravel()
        h = np.zeros((c, z.shape[1], c, z.shape[1]))
        for i in range(c):
            for j in range(c):
                h[i, :, j, :] = (z * (s * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ z
        step = np.linalg.pinv(h.reshape(len(ridge), -1) + np.diag(ridge)) @ g
        theta -= step.reshape(c, -1)
        if np.abs(step).max() < 1e-11:
            break
    return theta


def test_bootstrap_refits_and_votes(spark, graded, monkeypatch):
    monkeypatch.setattr(models, "ROUNDS", 4)
    rows, df = graded
    fit = models.bootstrap_logit(df, "k", ["a", "b"], "y", 9)
    x = np.array([[r[1], r[2]] for r in rows])
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    k = np.array([fit.classes.index(r[3]) for r in rows])
    assert fit.classes == [1, 2, 5] and np.allclose(fit.plain, balanced_fit(z, k, np.ones(len(k)), 3), atol=1e-6)
    order = {r.k: r.h for r in df.select("k", F.xxhash64("k").alias("h")).collect()}
    places, sizes = np.zeros(len(rows)), [int((k == c).sum()) for c in range(3)]
    for c in range(3):
        for at, i in enumerate(sorted(np.flatnonzero(k == c), key=lambda i: order[rows[i][0]])):
            places[i] = at
    w = resampling.multinomial(k, places, sizes, np.arange(9))
    assert fit.sizes == sizes and not fit.open_rounds and all((w[k == c].sum(0) == sizes[c]).all() for c in range(3))
    for b in range(9):
        assert np.allclose(fit.thetas[b], balanced_fit(z, k, w[:, b], 3), atol=1e-6)
    # Weights look like draws with replacement.
    many = resampling.multinomial(k, places, sizes, np.arange(400))
    assert abs(many.mean() - 1) < 0.02 and abs(many.var() - 1) < 0.05 and abs((many == 0).mean() - math.exp(-1)) < 0.02
    votes = {r.k: r for r in models.out_of_bag(df, fit, "k", "y").collect()}
    for i in range(len(rows)):
        said = [int((z[i] @ fit.thetas[b].T).argmax()) for b in range(9) if w[i, b] == 0]
        if not said:
            assert i not in votes
            continue
        best = max(said, key=lambda v: (said.count(v), -said.index(v)))
        assert (votes[i].actual, votes[i].vote, votes[i].n_votes) == (k[i], best, len(said))
    rows_ = models.bootstrap_intervals(fit)
    assert {r[1] for r in rows_} == {"1", "2", "5", "1->2", "2->5"} and all(r[3] <= r[4] for r in rows_)
    assert models.bootstrap_logit(df.where("y = 1"), "k", ["a", "b"], "y", 2) is None


def test_draws_of_the_means():
    """Poisson(1), alike for neighbouring keys and rounds, and not tied to either."""
    w = models._draws(np.arange(4000), np.arange(50))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - math.exp(-1)) < 0.01
    assert np.abs(w.mean(0) - 1).max() < 0.08 and np.abs(np.corrcoef(w.T) - np.eye(50)).max() < 0.09
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.01


def test_means_by_hand(spark):
    rows = [(i, ["a", "b", None][i % 3], None if i % 10 == 9 else float(i % 7)) for i in range(200)]
    found = {r.g: r for r in models.bootstrap_means(spark.createDataFrame(rows, "k int, g string, v double").repartition(3), "k", "g", "v", 40).collect()}
    w = models._draws(np.arange(200), np.arange(40))
    for g in ("a", "b", None):
        at = [i for i, h, v in rows if h == g and v is not None]
        m = (w[at] * np.array([rows[i][2] for i in at])[:, None]).sum(0) / w[at].sum(0)
        assert np.allclose([found[g]["mean"], found[g].ci_low, found[g].ci_high], [m.mean(), *np.percentile(m, [2.5, 97.5])])


def test_plain_logit_is_the_librarys(graded):
    rows, df = graded
    fit = models.bootstrap_logit(df, "k", ["a", "b"], "y", 1)
    x = np.array([[r[1], r[2]] for r in rows])
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    mine = [fit.classes[i] for i in (z @ fit.plain.T).argmax(1)]
    theirs = {r.k: int(r.prediction) for r in models.balanced_logit(features.standardize(df, ["a", "b"]), ["a", "b"], "y").collect()}
    assert np.mean([theirs[r[0]] == m for r, m in zip(rows, mine)]) > 0.99


def test_ordered_predictions_and_effects(graded):
    rows, df = graded
    fit = models.fit_ordered_probit(df, ["a", "b"], "y")
    cdf = lambda v: 0.5 * math.erfc(-v / math.sqrt(2))
    pdf = lambda v: math.exp(-v * v / 2) / math.sqrt(2 * math.pi)
    edges = [-math.inf, *fit.thresholds, math.inf]
    effects, found = np.zeros((3, 2)), {r.k: r.prediction for r in models.predict_ordered(df, fit).collect()}
    for r in rows:
        eta = sum(w * (v - m) / s for w, v, m, s in zip(fit.weights, r[1:3], fit.mean, fit.scale))
        p = [cdf(edges[i + 1] - eta) - cdf(edges[i] - eta) for i in range(3)]
        assert found[r[0]] == fit.classes[int(np.argmax(p))]
        for i in range(3):
            d = (0 if i == 0 else pdf(edges[i] - eta)) - (0 if i == 2 else pdf(edges[i + 1] - eta))
            effects[i] += d * np.array(fit.weights) / len(rows)
    mine = {(r["class"], r.feature): r.effect for r in models.marginal_effects(df, fit).collect()}
    for i, c in enumerate(fit.classes):
        assert np.allclose([mine[c, "a"], mine[c, "b"]], effects[i], atol=1e-12)


def test_a_class_that_is_never_likeliest():
    """The points where the likeliest class changes skip it."""
    from pyspark.sql import SparkSession

    fit = models.OrderedProbit(["a"], ["x", "y", "z"], np.zeros(1), np.ones(1), np.ones(1), np.array([-0.01, 0.01]), 0.0)
    df = SparkSession.active().createDataFrame([(-1.0,), (0.5,), (None,)], "a double")
    assert [r.prediction for r in models.predict_ordered(df, fit).collect()] == ["x", "z", None]


def test_l1_path(graded):
    rows = models.l1_path(graded[1].withColumn("noise", F.rand(3)), ["a", "b", "noise"], "y", [0.001, 0.1, 10.0])
    assert [r[3] for r in rows] == sorted(r[3] for r in rows) and rows[0][3] == 0 and rows[-1][3] == 3 and rows[-1][1] > rows[0][1]
    assert models.l1_path(graded[1].limit(0), ["a"], "y") == []


def test_ols_with_large_means_and_a_collinear_design(spark):
    rng = np.random.default_rng(5)
    g = rng.integers(0, 4, 400)
    x = rng.normal(size=400) + 1e7
    y = 3 * (x - 1e7) + g + rng.normal(size=400) * 0.1 + 1e8
    df = spark.createDataFrame([(float(a), float(b), *[float(c == i) for i in range(4)]) for a, b, c in zip(x, y, g)], "x double, y double, d0 double, d1 double, d2 double, d3 double")
    fit = models.ols(df, ["x", "d0", "d1", "d2", "d3"], "y")
    design = np.column_stack([np.ones(400), x - 1e7, *[(g == i).astype(float) for i in range(4)]])
    best, *_ = np.linalg.lstsq(design, y - 1e8, rcond=None)
    resid = y - 1e8 - design @ best
    assert fit.df == 400 - 5 and abs(fit.coef[1] - best[1]) < 1e-6
    assert abs((1 - fit.r2) * ((y - y.mean()) ** 2).sum() - resid @ resid) < 1e-3
    # The intercept of the smallest solution is the sum of the dummies' coefficients.
    plain = models.ols(df, ["d0", "d1", "d2", "d3"], "y")
    own = np.linalg.pinv(np.delete(design, 1, 1)) @ y
    assert np.allclose(plain.coef, own, rtol=1e-9) and abs(plain.coef[0] - plain.coef[1:].sum()) < 1e-3
    assert models.gram(df.limit(0), ["x"], "y") is None
    wide = df.select("y", *[(F.col("x") * (i % 5) + F.rand(i)).alias(f"c{i}") for i in range(35)])
    assert len(models.ols(wide, [f"c{i}" for i in range(35)], "y").coef) == 36


def test_lasso_path(spark):
    """Kept features and cross-validated errors of coordinate descent on the rows themselves, fold by fold."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 3)) * [1, 2, 0.5] + 50
    y = 2 * x[:, 0] - 0.7 * x[:, 1] + rng.normal(size=240) + 1000
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    rows = df.select("a", "b", "c", "y", F.pmod(F.xxhash64("a", "b", "c", "y"), F.lit(5)).alias("f")).collect()
    x, y, fold = np.array([r[:3] for r in rows]), np.array([r.y for r in rows]), np.array([r.f for r in rows])

    def descend(x, y, alpha):
        m, w = x.mean(0), np.zeros(3)
        z, v = x - m, y - y.mean()
        for _ in range(2000):
            for j in range(3):
                r = z[:, j] @ (v - z @ w + z[:, j] * w[j]) / len(y)
                w[j] = np.sign(r) * max(abs(r) - alpha, 0) / (z[:, j] @ z[:, j] / len(y))
        return w, y.mean() - m @ w

    found = models.lasso(df, ["a", "b", "c"], "y", n_alphas=6)
    assert found[0][1] == 0 and found[-1][1] == 3
    for alpha, kept, rmse in found:
        assert kept == (np.abs(descend(x, y, alpha)[0]) > 1e-10).sum()
        errors = np.concatenate([y[fold == f] - x[fold == f] @ w - c for f in range(5) for w, c in [descend(x[fold != f], y[fold != f], alpha)]])
        assert abs(rmse - np.sqrt((errors**2).mean())) < 1e-6
    assert models.lasso(df.limit(0), ["a"], "y") == []


def test_interval_regression(spark):
    """At the maximum no small move of a parameter raises the likelihood worked out row by row; open ends, points, and rows left out."""
    rng = random.Random(12)
    rows = []
    for i in range(500):
        a, b = rng.gauss(100, 20), rng.lognormvariate(0, 1)
        y = 3 + 0.05 * a - 0.4 * b + rng.gauss(0, 0.7)
        lo, hi = y - rng.random() * 2, y + rng.random()
        rows.append((a, b, *[(lo, hi), (y, y), (lo, None), (None, hi)][i % 4]))
    bad = [(1.0, 1.0, None, None), (1.0, None, 1.0, 2.0), (1.0, 1.0, 3.0, 2.0)]
    fit = models.interval_regression(spark.createDataFrame(rows + bad, "a double, b double, lo double, hi double").repartition(3), ["a", "b"], "lo", "hi")
    cdf = lambda v: 0.5 * math.erfc(-v / math.sqrt(2))

    def likelihood(c, wa, wb, s):
        total = 0.0
        for a, b, lo, hi in rows:
            m = c + wa * a + wb * b
            if lo == hi:
                total += -math.log(s) - (lo - m) ** 2 / (2 * s * s)
            else:
                total += math.log((1 if hi is None else cdf((hi - m) / s)) - (0 if lo is None else cdf((lo - m) / s)))
        return total

    best = [fit.intercept, *fit.weights, fit.sigma]
    top = likelihood(*best)
    for i in range(4):
        for d in (-1e-4, 1e-4):
            moved = list(best)
            moved[i] += d
            assert likelihood(*moved) <= top + 1e-7
    assert abs(fit.weights[0] - 0.05) < 0.01 and abs(fit.weights[1] + 0.4) < 0.1 and abs(fit.sigma - 0.7) < 0.1
    assert models.interval_regression(spark.createDataFrame(bad, "a double, b double, lo double, hi double"), ["a", "b"], "lo", "hi") is None


def test_merged_topics_lie_with_the_nearest_centre(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(n, 3)) * 0.1 + 5 * np.eye(3)[i] for i, n in enumerate((30, 20, 10))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None), (None, [0.0] * 3)], "k long, v array<double>")
    found = {r.k: r.cluster for r in models.merge_topics(df, "k", "v", 3).collect()}
    assert [found[i] for i in range(60)] == [0] * 30 + [1] * 20 + [2] * 10 and len(found) == 60


def test_numbers_with_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1.0, 1.0, 2.0, 5.5, float(i)])) for i in range(200)]
    found = {r.k: r.x for r in metrics.numbered(spark.createDataFrame(rows, "k int, v double"), "v", "k").collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert [found[k] for k, _ in order] == list(range(200))
    assert metrics.numbered(spark.createDataFrame([], "k int, v double"), "v", "k").count() == 0


def test_a_merge_goes_on_from_the_last_whole_version(spark, tmp_path):
    merge = incremental.merge_parquet(str(tmp_path / "t"), ["k"], [F.desc("at")])
    batch = lambda *rows: spark.createDataFrame(rows, "k int, at int")
    merge(batch((1, 1), (2, 1)), 0)
    # An epoch that broke off leaves files without a mark; the next one has no such base.
    batch((9, 9)).write.parquet(str(tmp_path / "t" / "v1"))
    (tmp_path / "t" / "v1" / "_SUCCESS").unlink()
    merge(batch((2, 5), (3, 1)), 2)
    merge(batch((2, 5), (3, 1)), 2)
    assert sorted(map(tuple, incremental.latest(spark, str(tmp_path / "t")).collect())) == [(1, 1), (2, 5), (3, 1)]


def test_records_of_poor_pages(spark):
    site = records.Site("s", r"/v/(\d+)", title=("h1", None, None), pay=(None, "class", "pay"))
    lists = '<script type="application/ld+json">[{"@type":"X"},{"@type":"JobPosting","title":"L","baseSalary":{"currency":"USD","value":7},"hiringOrganization":{"name":3}}]</script>'
    rows = [(1, "http://a/v/5?x", None), (2, "http://a/b/c/", "<p>nothing"), (3, "http://a/v/6", lists + "<h1>H</h1>"), (4, None, '<script type="application/ld+json">{oops</script><h1> H </h1><b class="pay x">до 100 000 руб</b>')]
    found = {r.i: r for r in records.record(spark.createDataFrame(rows, "i int, url string, html string"), site).collect()}
    assert (found[1].vacancy_id, found[1].title, found[1].remote) == ("5", None, False)
    assert (found[2].vacancy_id, found[2].salary_from, found[2].currency) == ("c", None, None)
    assert (found[3].title, found[3].salary_from, found[3].salary_to, found[3].currency, found[3].company_name) == ("L", 7.0, 7.0, "USD", None)
    assert (found[4].vacancy_id, found[4].title, found[4].salary_from, found[4].salary_to, found[4].currency) == (None, "H", None, 100000.0, "RUB")


def test_sections_match_once(spark):
    """A key that holds a later pattern is not split; of headers within one another the outer counts; at one place the earlier pattern wins."""
    heads = [("main tasks:", "the tasks"), ("tasks:", "t"), ("(?:we|you) (offer|get):", "offer"), ("We offer:", "late")]
    one = lambda s: [tuple(x) for x in spark.range(1).select(text.sections(F.lit(s), heads).alias("s")).first().s]
    assert one("Hi. Main tasks: - a\x01b Tasks: c We Offer: d") == [("", "Hi."), ("the tasks", "a b"), ("t", "c"), ("offer", "d")]
    assert one("none") == [("", "none")]


def test_null_keys_and_marks(spark):
    old = spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "c"), (2, "d")], "k int, v string")
    assert sorted(map(tuple, ingest.upsert(old, new, ["k"]).collect()), key=str) == [(1, "b"), (2, "d"), (None, "c")]
    lines = spark.createDataFrame([("$$$",), ("@@@ &&",), ("+++",), ("ab",), ("abc",), ("",)], "x string")
    assert [r[0] for r in lines.select(text.is_junk_line(F.col("x"))).collect()] == [True, True, False, True, False, False]


def test_compounds_with_one_known_part_stay(spark):
    known = spark.createDataFrame([("bash",), ("Python",), ("kubernetes",)], "name string")
    aliases = spark.createDataFrame([("py", "Python")], "key string, canonical string")
    names = ["Bash/Python", "bash / py / odd", "Bash/odd", "CI/CD", "Bash and Python", "bash py a b c", "k8s-x/bash", None, "", "Python"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    found = {}
    for r in skills.split_compounds(df, "name", known, aliases, ["ci/cd"], prefixes={"k8s": "Kubernetes"}).collect():
        found.setdefault(r.i, []).append(r.name)
    assert {i: sorted(v, key=str) for i, v in found.items()} == {0: ["Bash", "Python"], 1: ["bash", "odd", "py"], 2: ["Bash/odd"], 3: ["CI/CD"], 4: ["Bash", "Python"], 5: ["bash py a b c"], 6: ["bash", "k8s-x"], 7: [None], 8: [""], 9: ["Python"]}


def test_fixed_tables_on_their_own_language(spark):
    from larkspan.functions import rules

    titles = {
        "Стажёр DevOps": ("Intern", "Intern", None, ["DevOps"]),
        "Системный администратор / DevOps-инженер": (None, None, None, ["DevOps", "System Administrator"]),
        "SRE/DevOps инженер": (None, None, None, ["SRE", "DevOps"]),
        "Middle/Senior DevOps Engineer": ("Middle/Senior", "Senior", "senior", ["DevOps"]),
        "Ведущий инженер": (None, None, "senior", ["Ведущий"]),
        "Руководитель группы": ("Lead", "Lead", "senior", ["Руководитель"]),
        "": (None, None, None, []),
        None: (None, None, None, []),
    }
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    c = F.col("t")
    for r in df.select("t", rules.grade(c).alias("g"), rules.title_grade(c).alias("h"), rules.title_class(c).alias("k"), rules.positions(c).alias("p")).collect():
        assert (r.g, r.h, r.k, r.p) == titles[r.t], r
    one = lambda f, s: spark.createDataFrame([(s,)], "x string").select(f(F.col("x"))).first()[0]
    said = "Привет. Основные задачи: - чинить Требования: уметь Условия: офис Обязанности: писать"
    assert [tuple(x) for x in one(text.sections, said)] == [("", "Привет."), ("responsibilities", "чинить"), ("requirements", "уметь"), ("noise_conditions", "офис"), ("responsibilities", "писать")]
    assert [tuple(x) for x in one(lambda c: text.merge_sections(text.sections(c)), said)] == [("responsibilities", "чинить\nписать"), ("requirements", "уметь")]
    assert one(text.format_sections, said) == "Привет.\n\nчинить\nписать\n\nуметь" and one(text.format_sections, "без") == "без"
    assert one(text.message_clean, "#вакансия @канал\n━━━\nКонтакты: Иван\n• пункт\n-\nдальше") == "Иван пункт\n\nдальше"
    assert one(text.message_clean, "#a\n---") is None and one(rules.wanted_message, "#Вакансия") and not one(rules.wanted_message, "#вакансия #резюме")
