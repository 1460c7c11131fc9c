import re

from pyspark.sql import functions as F

from larkspan.functions import money, text
from larkspan.operators import skills
from larkspan.sources import io

HEADERS = [(r"tasks:", "duties"), (r"main tasks:", "main"), (r"we offer\b", "offer"), (r"about (?:us|you)", "noise")]


def brute(t):
    found = {}
    for p, key in HEADERS:
        for m in re.finditer(p, t, re.I):
            found.setdefault(m.start(), (m.end(), key))
    at = sorted(found)
    out = [("", t[: at[0] if at else len(t)].strip(" "))]
    for i, a in enumerate(at):
        body = t[found[a][0] : at[i + 1] if i + 1 < len(at) else len(t)]
        out.append((found[a][1], re.sub(" {3,}", "  ", re.sub(r"^[•\-*_\s]+", "", body)).strip(" ")))
    return out


def test_headers_within_headers(spark):
    texts = ["Hello. Main tasks: - do it    now We offer tea", "tasks: a TASKS: b main tasks:", "no header", "", "é • About us x about you main tasks: tasks: y", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.nested_sections("t", HEADERS).alias("s")).orderBy("i").collect()
    for r in got[:-1]:
        assert [tuple(x) for x in r.s] == brute(texts[r.i]), texts[r.i]
    assert ("main", "") in [tuple(x) for x in got[0].s]


def test_rates_in_windows_1251(spark, tmp_path):
    (tmp_path / "r.xml").write_bytes('<?xml version="1.0" encoding="windows-1251"?><ValCurs><Valute><CharCode>USD</CharCode><Nominal>10</Nominal><Name>Доллар «№»</Name><Value>905,5</Value></Valute></ValCurs>'.encode("cp1251"))
    row = io.read_texts(spark, str(tmp_path), "windows-1251").select("text", io.xml_rates(F.col("text")).alias("r")).first()
    assert "Доллар «№»" in row.text and [tuple(x) for x in row.r] == [("USD", 90.55)]


def test_one_rate_and_one_alias_for_each_code(spark):
    rates = spark.createDataFrame([("USD", 90.0), ("USD", 80.0)], "code string, rate double")
    df = spark.createDataFrame([(1, "USD"), (2, None), (3, "X")], "i int, code string")
    assert sorted((r.i, r.rate) for r in money.with_rates(df, "code", rates, rates.limit(0)).collect() if r.rate) == [(1, 80.0), (2, 1.0)]
    aliases = spark.createDataFrame([("k8s", "Kubernetes"), ("K8S.", "Kube")], "key string, canonical string")
    assert [r.n for r in skills.normalize(spark.createDataFrame([("K8s",)], "n string"), "n", aliases).collect()] == ["Kube"]
    long = "x" * 1_200_000
    assert spark.createDataFrame([(long,)], "n string").select(F.length(skills.capitalized(F.col("n"))).alias("l")).first().l == len(long)
