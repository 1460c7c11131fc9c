import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspan import schemas
from larkspan.functions import money, rules, text
from larkspan.operators import features, ingest, metrics, models, skills
from larkspan.plans.steps import Steps
from larkspan.streaming import incremental

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_urls(spark):
    rows = [("https://a.b/x/1?q=1#f",), ("/v/2?z",), ("//c.d/e",), ("rel",), (None,)]
    found = values(spark, rows, "u string", text.clean_url("u", "https://h.i/dir/page"), text.id_from_url("u", r"/x/(\d+)"))
    assert [r[0] for r in found] == ["https://a.b/x/1", "https://h.i/v/2", "https://c.d/e", "https://h.i/dir/rel", None]
    assert [r[1] for r in found] == ["1", "2", "e", "rel", None]


def test_html(spark):
    rows = [("<p>A &amp;amp; B!!!</p><ul><li>one</li><li>two</li></ul>--<p>ab</p><p>ﬁn.....</p>",), (None,), ("<br>",), ("",)]
    assert [r[0] for r in values(spark, rows, "h string", text.html_clean("h"))] == ["A & B!  one  two  fin...", None, None, None]
    assert values(spark, [('<h1 class="t big">x<b>y</b></h1>',)], "h string", text.css_text("h", tag="h1", attribute="class", value="big")) == [("xy",)]


def test_message_and_sections(spark):
    raw = "#job @x Hello\n-----\nsource: Acme corp\n- item\n\nend"
    assert values(spark, [(raw,)], "t string", text.message_clean("t", "source")) == [("Hello Acme corp item end",)]
    heads = [("main tasks:", "duties"), ("tasks:", "duties"), ("we offer:", "noise")]
    found = values(spark, [("intro main tasks: - do x we offer: y tasks: z",), ("plain",)], "t string", text.merge_sections(text.sections("t", heads), ["noise"]), text.format_sections("t", heads, ["noise"]))
    assert [tuple(x) for x in found[0][0]] == [("duties", "do x\nz")]
    assert found[0][1] == "intro\n\ndo x\nz" and found[1][1] == "plain"


def test_json(spark):
    rows = [('x ```json\n{"a": {"k": "3"}}\n``` y',), ("no",), ('pre {"a": {"k": 4}} post',), (None,)]
    assert [r[0] for r in values(spark, rows, "r string", text.tolerant_number(text.salvage_json("r"), "$.a.k"))] == [3.0, None, 4.0, None]
    page = '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@type":"JobPosting","jobLocationType":"TELECOMMUTE"}</script>'
    assert values(spark, [(page, "t")], "h string, t string", text.is_remote(text.json_posting("h"), "t")) == [(True,)]


def test_rules(spark):
    table = [(r"(?iu)\bdev\b", r"(?iu)ops", "dev"), ("(?iu)лид", None, "lead")]
    found = values(spark, [("Dev", None), ("dev ops", "old"), ("ЛИД dev", "dev"), (None, None)], "t string, r string", rules.reasons(F.col("t"), table, F.col("r")))
    assert [r[0] for r in found] == ["dev", "old", "dev; lead", None]
    assert values(spark, [("a b",), ("z",)], "t string", rules.all_matches(F.col("t"), [("b", "B"), ("a", "A"), ("b", "B")], F.col("t"))) == [(["B", "A"],), (["z"],)]


def test_salary_text(spark):
    rows = [("от 100 000 до 150 000 ₽",), ("до 200 $",), ("от 50 €",), ("нет",), (None,)]
    found = [r[0] for r in values(spark, rows, "s string", money.parse_salary(F.col("s")))]
    assert [tuple(x) if x else x for x in found] == [(100000.0, 150000.0, "RUB"), (None, 200.0, "USD"), (50.0, None, "EUR"), (None, None, None), (None, None, None)]


def test_pay_period(spark):
    rows = [(500.0, "USD", "per hour"), (50.0, "USD", "x"), (700.0, "USD", "per hour"), (700.0, "USD", "x"), (60000.0, "USD", "per year"), (50.0, "USD", "")]
    factor = money.monthly(F.col("a"), F.lit(None).cast("double"), F.col("c"), F.col("t"), "hour", "year")
    assert [round(r[0], 4) for r in values(spark, rows, "a double, c string, t string", factor)] == [160.0, 160.0, 160.0, 1.0, 0.0833, 1.0]


def test_times(spark):
    rows = [("2024-01-01T10:00:00+03:00",), ("bad",), (None,)]
    show = lambda c: F.date_format(c, "HH")
    assert values(spark, rows, "t string", show(money.parse_time(F.col("t"))), show(money.parse_time(F.col("t"), False))) == [("07", "10"), (None, None), (None, None)]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, c int")
    new = spark.createDataFrame([(2, None, 9), (3, "z", 9)], "k int, v string, c int")
    assert sorted(map(tuple, ingest.upsert(old, new, ["k"], ["c"]).collect())) == [(1, "a", 1), (2, None, 2), (3, "z", 9)]
    assert sorted(map(tuple, ingest.patch(old, new, ["k"], ["v"]).collect())) == [(1, "a", 1), (2, "b", 2)]
    assert ingest.insert_ignore(old, new.union(new), ["k"], [F.col("c")]).count() == 3
    assert ingest.missing_required(new, ["v"]).select("k", "lacking").collect()[0].lacking == ["v"]
    assert set(schemas.evolve(old, schemas.QUEUE).columns) >= {"url", "status"}


def test_names(spark):
    rows = spark.createDataFrame([(1, " Go. "), (2, "k8s cluster"), (3, " "), (4, None), (5, "Rust")], "i int, n string")
    aliases = spark.createDataFrame([("go", "Golang")], "key string, canonical string")
    assert {r.i: r.n for r in skills.normalize(rows, "n", aliases, {"k8s": "Kubernetes"}).collect()} == {1: "Golang", 2: "Kubernetes", 3: None, 4: None, 5: "Rust"}
    c = skills.assign_clusters(spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "a", 2), (2, "z", 0)], "o int, n string, p int"), spark.createDataFrame([("a", "7"), ("b", "3")], "n string, cluster_id string"), "o", "n", "p")
    assert {r.o: r.clusters for r in c.collect()} == {1: ["7", "3"], 2: []}


@quick
@given(st.lists(st.lists(st.floats(-2, 2), min_size=3, max_size=3), min_size=1, max_size=6))
def test_diversity_is_the_pair_loop(spark, vectors):
    items = spark.createDataFrame([(1, i) for i in range(len(vectors))], "o int, k int")
    table = spark.createDataFrame([(i, 0, v) for i, v in enumerate(vectors)], "k int, c int, v array<double>")
    got = features.diversity(items, table, "o", "k", "c", "v").first().diversity
    v = np.array(vectors)
    n = np.linalg.norm(v, axis=1)
    u = v / np.where(n == 0, 1, n)[:, None]
    k = len(v)
    expected = math.log(2) if k == 1 else math.log1p(k * (1 - np.mean([a @ b for a, b in itertools.combinations(u, 2)])))
    assert got == pytest.approx(expected, abs=1e-6)


def test_ols_on_a_collinear_design(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, 200)
    x = rng.normal(size=200)
    y = 2 * x + g + rng.normal(size=200)
    rows = [(float(a), *(float(b == i) for i in range(3)), float(c)) for a, b, c in zip(x, g, y)]
    fit = models.ols(spark.createDataFrame(rows, "x double, g0 double, g1 double, g2 double, y double"), ["x", "g0", "g1", "g2"], "y")
    design = np.column_stack([np.ones(200), x, *(g == i for i in range(3))])
    assert np.allclose(fit.coef, np.linalg.pinv(design) @ y) and fit.df == 196
    assert fit.coef[0] == pytest.approx(fit.coef[2:].sum())
    assert models.t_two_sided(1.96832, 285) == pytest.approx(0.05, abs=1e-4)


def test_metrics_edges(spark):
    one = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, r double")
    assert {r.g: round(r.sigma, 4) for r in metrics.group_sigma(one, "g", "r").collect()} == {"a": 0.9428, "b": 1.0}
    assert metrics.histogram(one.limit(0), "r", 3).count() == 0
    assert features.standardize(spark.createDataFrame([(2.0,), (2.0,)], "z double"), ["z"]).first().z == 0.0


def test_steps(spark):
    s = Steps().add("a", lambda r, f: 1).add("b", lambda r, f: r["a"] + 1, ["a"]).add("c", lambda r, f: r["b"] + 1, ["b"])
    assert s.expand(["c"]) == ["a", "b", "c"] and s.run({}, ["c"])["c"] == 3
    with pytest.raises(ValueError):
        s.expand(["x"])


def test_stream_merge(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, t int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t int").parquet(str(tmp_path / "in"))
    q = incremental.run_available(stream, incremental.merge_parquet(str(tmp_path / "out"), ["k"], [F.desc("t")]), str(tmp_path / "cp"))
    assert q.awaitTermination(60) is not False
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/v0")).collect())) == [(1, 2), (2, 1)]
