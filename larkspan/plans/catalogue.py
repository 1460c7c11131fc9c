"""Registered queries on the test tables, each with the SQL that checks it where SQL can.

An order stands for a vacancy, its priority for the grade, its total price for the pay, its parts for skills; embeddings give a part its vector and
cluster; nations stand for currencies, pages for crawled pages, documents for descriptions, events for the message feed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, rules, text
from ..operators import features, ingest, metrics, models, skills
from ..operators.ordering import sent
from ..session import ship, tasks_for
from ..sources.io import table

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def query(sql: str | None = None):
    def register(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda name: table(spark, sf_dir, name), spark)

        _Q[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _parts(t) -> DataFrame:
    """Order and its parts' clusters: the number of vectors is one aggregated value, joined as such."""
    n = t("embeddings").agg(F.count("*").alias("n_vec"))
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(F.broadcast(n), F.lit(True))
    return items.select("l_orderkey", "l_linenumber", "l_partkey", F.expr("pmod(l_partkey, n_vec)").alias("vec_id"))


def _clustered(t, items: DataFrame | None = None) -> DataFrame:
    return (_parts(t) if items is None else items).join(sent(t("embeddings").select("vec_id", F.col("label").cast("long").alias("label"))), "vec_id")


def _ordered(t, *columns: str) -> DataFrame:
    """Clustered parts with columns of their orders, dealt by order: what is grouped by order then needs no other shuffle."""
    parts, orders = _parts(t), t("orders").select("o_orderkey", *columns)
    n = tasks_for(orders.sparkSession, max(t("lineitem").count(), orders.count()))
    return _clustered(t, parts.repartition(n, "l_orderkey")).join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


_PARTS = "p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % (SELECT count(*) FROM embeddings) AS vec_id FROM lineitem)"
_CLUST = _PARTS + ", c AS (SELECT p.*, CAST(label AS BIGINT) AS label FROM p JOIN embeddings e USING (vec_id))"


@query(
    f"""WITH {_PARTS}, k AS (SELECT l_orderkey, vec_id, count(*) AS c FROM p GROUP BY ALL),
    u AS (SELECT vec_id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (CASE WHEN s = 0 THEN 1 ELSE s END)) AS v, s FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS s FROM embeddings)),
    d AS (SELECT l_orderkey, label, c, s, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM k JOIN u USING (vec_id)),
    t AS (SELECT l_orderkey, label, i, sum(c * x) AS x, sum(c) AS k, sum(CASE WHEN s > 0 THEN c ELSE 0 END) AS nz FROM d GROUP BY ALL)
    SELECT l_orderkey, label, CAST(max(k) AS BIGINT) AS k, round(CASE WHEN max(k) = 1 THEN ln(2.0) ELSE ln(1 + max(k) * (1 - (sum(x * x) - max(nz)) / (max(k) * (max(k) - 1)))) END, 6) + 0.0::DOUBLE AS diversity FROM t GROUP BY ALL"""
)
def diversity_feature(t, spark):
    return _diversity(t, _parts(t))


def _diversity(t, parts: DataFrame) -> DataFrame:
    e = t("embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    return features.diversity(parts, e, "l_orderkey", "vec_id", "label", "embedding").withColumn("diversity", F.round("diversity", 6) + 0.0)


@query("SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1")
def dedup_latest(t, spark):
    rest = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")]
    return ingest.keep_first(t("lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_shipdate").desc_nulls_last(), *rest])


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders WHERE o_orderkey % 2 = 0) WHERE rn = 1 UNION ALL SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders WHERE o_orderkey % 2 = 1) WHERE rn = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def insert_ignore(t, spark):
    o = t("orders").select("o_custkey", "o_orderkey")
    old = ingest.keep_first(o.where("o_orderkey % 2 = 0"), ["o_custkey"], [F.col("o_orderkey")])
    return ingest.insert_ignore(old, o.where("o_orderkey % 2 = 1"), ["o_custkey"], [F.col("o_orderkey")])


@query(
    "WITH o AS (SELECT user_id, event_type, value, event_id AS created FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) rn FROM events WHERE event_id % 2 = 0) WHERE rn = 1), n AS (SELECT user_id, nullif(event_type, 'click') AS event_type, value, event_id AS created FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events WHERE event_id % 2 = 1) WHERE rn = 1) SELECT coalesce(n.user_id, o.user_id) AS user_id, CASE WHEN n.user_id IS NULL THEN o.event_type ELSE n.event_type END AS event_type, CASE WHEN n.user_id IS NULL THEN o.value ELSE n.value END AS value, CASE WHEN o.user_id IS NULL THEN n.created ELSE o.created END AS created FROM o FULL JOIN n ON o.user_id = n.user_id"
)
def upsert_merge(t, spark):
    e = t("events")
    cols = ["user_id", "event_type", "value", F.col("event_id").alias("created")]
    old = ingest.keep_first(e.where("event_id % 2 = 0"), ["user_id"], [F.col("event_id")]).select(*cols)
    new = ingest.keep_first(e.where("event_id % 2 = 1"), ["user_id"], [F.desc("event_id")]).withColumn("event_type", F.nullif("event_type", F.lit("click"))).select(*cols)
    return ingest.upsert(old, new, ["user_id"], keep=["created"])


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'patched' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def patch_coalesce(t, spark):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "patched").alias("o_orderstatus"))
    return ingest.patch(o, new, ["o_orderkey"], ["o_orderstatus"])


@query("SELECT event_id, event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) rn FROM events WHERE value > 10) WHERE rn <= 50")
def dequeue_batch(t, spark):
    return ingest.dequeue(t("events"), 50, F.col("value") > 10, "event_id", per="event_type").select("event_id", "event_type", "user_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_scan(t, spark):
    return ingest.not_done(t("documents").select("doc_id", "source"), t("labels"), ["doc_id"])


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def age_cutoff(t, spark):
    last = t("events").agg(F.max("ts").alias("last"))
    return t("events").select("event_id", "ts").join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS")).drop("last")


@query("SELECT doc_id FROM documents WHERE contains(text, '#') AND NOT contains(text, '@')")
def tag_filter(t, spark):
    return t("documents").where(F.col("text").contains("#") & ~F.col("text").contains("@")).select("doc_id")


_RULES = [(r"(?i)\b(red|blue)\b", r"(?i)widget", "colour"), (r"(?i)gear|bolt", None, "metal"), (r"(?i)^s", r"(?i)bolt$", "s-word")]


@query("SELECT p_partkey, nullif(concat_ws('; ', CASE WHEN regexp_matches(p_name, '(?i)\\b(red|blue)\\b') AND NOT regexp_matches(p_name, '(?i)widget') THEN 'colour' END, CASE WHEN regexp_matches(p_name, '(?i)gear|bolt') THEN 'metal' END, CASE WHEN regexp_matches(p_name, '(?i)^s') AND NOT regexp_matches(p_name, '(?i)bolt$') THEN 's-word' END), '') AS reasons, length(trim(p_name)) < 9 AS short FROM part")
def rule_flags(t, spark):
    return t("part").select("p_partkey", rules.reasons(F.col("p_name"), _RULES).alias("reasons"), rules.too_short(F.col("p_name"), 9).alias("short"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) FILTER (o_totalprice > 100000) AS large FROM orders")
def review_summary(t, spark):
    return metrics.conditional_counts(t("orders"), closed=F.col("o_orderstatus") == "F", large=F.col("o_totalprice") > 100000)


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"n_F\", count(*) FILTER (o_orderstatus = 'O') AS \"n_O\", count(*) FILTER (o_orderstatus = 'P') AS \"n_P\" FROM orders GROUP BY 1")
def status_pivot(t, spark):
    return metrics.status_table(t("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


_BOUNDS = "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END"


@query(f"SELECT o_orderkey, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(a, b) END, 4) AS target FROM (SELECT o_orderkey, nullif({_BOUNDS}, 0) AS a, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice * 1.5 END AS b FROM orders WHERE o_orderkey NOT IN (1, 2, 3, 4) AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')) WHERE coalesce(a, b) > 0")
def target_midpoint(t, spark):
    o = t("orders").where(~F.col("o_orderkey").isin(1, 2, 3, 4) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW"))
    low = F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("o_totalprice"))
    high = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") * 1.5)
    return o.select("o_orderkey", F.round(money.midpoint(low, high), 4).alias("target")).where("target IS NOT NULL")


@query(f"WITH {_CLUST}, f AS (SELECT l_orderkey, label, min(CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS pos FROM c GROUP BY ALL) SELECT l_orderkey, string_agg(CAST(label AS VARCHAR), ',' ORDER BY pos) AS clusters FROM f GROUP BY 1")
def assign_clusters(t, spark):
    items = _parts(t).withColumn("pos", F.col("l_linenumber").cast("long") * F.lit(1000000000) + F.col("l_partkey"))
    e = t("embeddings").select("vec_id", F.col("label").cast("long").alias("cluster_id"))
    return skills.assign_clusters(items, e, "l_orderkey", "vec_id", "pos").select("l_orderkey", F.array_join(F.col("clusters").cast("array<string>"), ",").alias("clusters"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def unmapped_topk(t, spark):
    return skills.unmapped(t("lineitem").select("l_partkey"), t("embeddings").select(F.col("vec_id").alias("l_partkey")), "l_partkey")


@query(f"WITH {_CLUST}, s AS (SELECT DISTINCT l_orderkey FROM c WHERE label = 3) SELECT o_orderpriority, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM s)) AS n_with, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM s)) AS n_without FROM orders GROUP BY 1")
def semi_anti_split(t, spark):
    have = _clustered(t).where("label = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    o = t("orders").select("o_orderkey", "o_orderpriority")
    both = o.join(have, "o_orderkey", "left_semi").withColumn("w", F.lit(1)).unionByName(o.join(have, "o_orderkey", "left_anti").withColumn("w", F.lit(0)))
    return both.groupBy("o_orderpriority").agg(F.count_if(F.col("w") == 1).alias("n_with"), F.count_if(F.col("w") == 0).alias("n_without"))


_RATES, _FALLBACK = [("FRANCE", 98.5), ("GERMANY", 98.5), ("CHINA", 12.25)], [("CHINA", 1.0), ("JAPAN", 0.5)]


@query("SELECT s_suppkey, n_name, round(CASE WHEN n_name IN ('FRANCE', 'GERMANY') THEN s_acctbal * 98.5 WHEN n_name = 'CHINA' THEN s_acctbal * 12.25 WHEN n_name = 'JAPAN' THEN s_acctbal * 0.5 ELSE s_acctbal END, 2) AS home FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def left_lookup_default(t, spark):
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "s_acctbal")
    mine = money.with_rates(s, "n_name", spark.createDataFrame(_RATES, "code string, rate double"), spark.createDataFrame(_FALLBACK, "code string, rate double"), home="RUSSIA")
    return mine.select("s_suppkey", "n_name", F.round(money.to_home(F.col("s_acctbal"), F.col("rate")), 2).alias("home"))


@query("WITH i AS (SELECT l_orderkey, p_type, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), s AS (SELECT a.p_type, b.p_type AS other, CAST(sum(b.c) AS BIGINT) AS n FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.p_type <> b.p_type GROUP BY ALL) SELECT p_type, other, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, other) AS rank FROM s) WHERE rank <= 3")
def cooccurrence_topk(t, spark):
    items = t("lineitem").select("l_orderkey", "l_partkey").join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return skills.cooccurrence(items, "l_orderkey", "p_type", 3)


@query("WITH f AS (SELECT p_name, count(*) AS n FROM (SELECT p_name FROM part UNION ALL SELECT p_name FROM part WHERE p_partkey % 10 = 0) GROUP BY 1) SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM f WHERE n >= 30)")
def singleton_removal(t, spark):
    p = t("part").select("p_partkey", "p_name")
    return skills.drop_singletons(p, "p_name", skills.frequencies(p, p.where("p_partkey % 10 = 0"), name="p_name"), 30)


@query("SELECT n_regionkey, count(*) AS n, round(least(min(s_acctbal), min(s_acctbal * 2)), 4) AS low, round(greatest(max(s_acctbal), max(s_acctbal * 2)), 4) AS high FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def currency_report(t, spark):
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    b = F.col("s_acctbal")
    return s.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.round(F.least(F.min(b), F.min(b * 2)), 4).alias("low"), F.round(F.greatest(F.max(b), F.max(b * 2)), 4).alias("high"))


@query(f"WITH {_CLUST} SELECT l_orderkey, " + ", ".join(f"CAST(max(CASE WHEN label = {i} THEN 1 ELSE 0 END) AS BIGINT) AS has_{i}" for i in range(10)) + " FROM c GROUP BY 1")
def onehot_pivot(t, spark):
    return skills.onehot(_clustered(t), "l_orderkey", "label", list(range(10)))


@query("SELECT p_brand, p_type, n, row_number() OVER (ORDER BY n DESC, p_brand, p_type) - 1 AS cluster FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)")
def pair_clusters(t, spark):
    n = t("part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return skills.ranked(n, [F.desc("n"), F.col("p_brand"), F.col("p_type")], "cluster")


@query("SELECT label, size, rank, CASE rank WHEN 0 THEN 'Core' WHEN 1 THEN 'Tools' WHEN 2 THEN 'Cloud' ELSE 'Other' END AS name FROM (SELECT *, row_number() OVER (ORDER BY size DESC, label) - 1 AS rank FROM (SELECT label, count(*) AS size FROM embeddings GROUP BY 1))")
def size_rank_naming(t, spark):
    n = t("embeddings").groupBy("label").agg(F.count("*").alias("size"))
    return skills.named_by_size(n.withColumnRenamed("label", "lab"), ["Core", "Tools", "Cloud"], "size", "lab").select(F.col("lab").alias("label"), "size", "rank", F.col("label").alias("name"))


@query("SELECT p_name, n, CAST(ceil(row_number() OVER (ORDER BY n DESC, p_name) / 10.0) AS BIGINT) AS batch FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)")
def batch_number(t, spark):
    r = skills.ranked(skills.frequencies(t("part"), name="p_name"), [F.desc("n"), F.col("p_name")], "rn", 1)
    return r.select("p_name", "n", F.ceil(F.col("rn") / 10).cast("long").alias("batch"))


@query("SELECT l_orderkey, p_name, pos FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, lower(p_name) ORDER BY pos) rn FROM (SELECT l_orderkey, p_name, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS pos FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey)) WHERE rn = 1")
def first_wins_dedup(t, spark):
    # Repeated lines need no distinct: the first of them is one row.
    i = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    n = tasks_for(spark, i.count())
    i = i.repartition(n, "l_partkey").join(t("part").select("p_partkey", "p_name").repartition(n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    i = i.select("l_orderkey", "p_name", (F.col("l_linenumber").cast("long") * F.lit(1000000000) + F.col("l_partkey")).alias("pos"))
    return skills.first_spelling(i.repartition(n, F.col("l_orderkey"), F.lower("p_name")), "l_orderkey", "p_name", "pos")


@query("SELECT o_orderpriority, next, round(delta, 4) AS delta FROM (SELECT o_orderpriority, lead(o_orderpriority) OVER (ORDER BY o_orderpriority) AS next, lead(a) OVER (ORDER BY o_orderpriority) - a AS delta FROM (SELECT o_orderpriority, avg(o_totalprice) AS a FROM orders GROUP BY 1)) WHERE next IS NOT NULL")
def adjacent_delta(t, spark):
    a = t("orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("a"))
    return metrics.adjacent_delta(a, "o_orderpriority", "a").select("o_orderpriority", "next", F.round("delta", 4).alias("delta"))


@query(f"WITH {_CLUST}, g AS (SELECT label, o_orderpriority, count(*) AS n FROM c JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), b AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, o_orderpriority) rn FROM g) WHERE rn = 1) SELECT label, o_orderpriority, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, label) AS rank FROM b) WHERE rank <= 3")
def anchor_topk(t, spark):
    g = _ordered(t, "o_orderpriority").groupBy("label", "o_orderpriority").agg(F.count("*").alias("n"))
    return metrics.anchors(g, "label", "o_orderpriority", "n", 3)


@query("SELECT p_name, max(p_size) FILTER (p_partkey % 2 = 0) AS x FROM part GROUP BY 1 HAVING x IS NOT NULL UNION ALL SELECT p_name, max(p_size) + 1000 FROM part WHERE p_partkey % 2 = 1 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0) GROUP BY 1")
def dict_merge(t, spark):
    p = t("part")
    old = p.where("p_partkey % 2 = 1").groupBy("p_name").agg((F.max("p_size") + 1000).alias("x"))
    return ingest.merge_dictionaries(old, p.where("p_partkey % 2 = 0").groupBy("p_name").agg(F.max("p_size").alias("x")), "p_name")


@query("SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS link, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '[^/]*$') AS id FROM pages")
def canonical_url(t, spark):
    return t("pages").select(text.clean_url("url").alias("link"), text.id_from_url("url", "zz(x)").alias("id")).distinct()


@query()
def html_text(t, spark):
    return t("pages").select("page_id", text.html_clean("html").alias("text"), text.css_text("html", tag="title").alias("title"))


@query(
    r"""WITH l AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x, ' ')) AS l FROM documents),
    f AS (SELECT doc_id, list_filter(l, lambda x: x <> '' AND NOT regexp_matches(x, '^[\s\-─━═▬•*~=_|/\\,.;:!?\[\]{}<>«»""''`]{3,}$')) AS l FROM l),
    c AS (SELECT doc_id, list_filter(list_transform(l, lambda x: trim(regexp_replace(trim(regexp_replace(x, '(?i)^(?:source|author|contact|channel|via|link)\s*:\s*', ''), ' '), '[#@][\p{L}\p{M}\p{N}\p{Pc}]+\s*', '', 'g'), ' ')), lambda x: x <> '') AS l FROM f),
    b AS (SELECT doc_id, array_to_string(list_transform(l, lambda x: CASE WHEN trim(regexp_replace(x, '^[•\-]\s*', ''), ' ') = '' THEN chr(1) ELSE trim(regexp_replace(x, '^[•\-]\s*', ''), ' ') END), ' ') AS t FROM c)
    SELECT doc_id, nullif(regexp_replace(regexp_replace(t, ' *\x01[\x01 ]*', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '') AS text FROM b"""
)
def message_clean(t, spark):
    return t("documents").select("doc_id", text.message_clean("text", "source|author|contact|channel|via|link").alias("text"))


@query(
    r"""WITH m AS (SELECT doc_id, string_split(regexp_replace(text, '(?i)(?:(the )|(la ))', chr(1) || '\1' || chr(3) || '\2' || chr(2), 'g'), chr(1)) AS p FROM documents), e AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) - 1 AS i FROM m)
    SELECT doc_id, CAST(i AS INTEGER) AS i, CASE WHEN contains(p, chr(2)) THEN CASE WHEN starts_with(p, chr(3)) THEN 'second' ELSE 'first' END ELSE '' END AS key,
    CASE WHEN contains(p, chr(2)) THEN trim(regexp_replace(regexp_replace(string_split(p, chr(2))[2], '^[•\-*_\s]+', ''), ' {3,}', '  ', 'g'), ' ') ELSE trim(p, ' ') END AS content FROM e"""
)
def section_split(t, spark):
    heads = [("the ", "first"), ("la ", "second")]
    return t("documents").select("doc_id", F.posexplode(text.sections("text", heads)).alias("i", "s")).select("doc_id", "i", "s.key", "s.content")


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)widget') THEN 'Senior' WHEN regexp_matches(p_name, '(?i)bolt') THEN 'Middle' WHEN regexp_matches(p_name, '(?i)red') THEN 'Junior' END AS grade, CASE WHEN contains(p_name, 'blue') OR contains(p_name, 'green') THEN 'cool' WHEN contains(p_name, 'red') THEN 'warm' END AS tone FROM part")
def title_rules(t, spark):
    n = F.col("p_name")
    return t("part").select("p_partkey", rules.first_match(n, [("(?i)widget", "Senior"), ("(?i)bolt", "Middle"), ("(?i)red", "Junior")]).alias("grade"), rules.contains_first(n, [(["blue", "green"], "cool"), (["red"], "warm")]).alias("tone"))


@query("SELECT p_partkey, CASE WHEN lower(p_name) = 'red widget' THEN 'Canonical One' WHEN lower(p_name) LIKE 'blue%' THEN 'Blue Family' ELSE p_name END AS name FROM part")
def alias_normalize(t, spark):
    a = spark.createDataFrame([("Red Widget.", "Canonical One")], "key string, canonical string")
    return skills.normalize(t("part").select("p_partkey", F.col("p_name").alias("name")), "name", a, {"blue": "Blue Family"})


@query("WITH k AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS w FROM part WHERE p_size > 25 UNION SELECT 'red'), e AS (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS w FROM part), s AS (SELECT p_partkey FROM e WHERE w IN (SELECT w FROM k) GROUP BY 1 HAVING count(*) >= 2) SELECT p_partkey, w AS name FROM e WHERE p_partkey IN (SELECT p_partkey FROM s) UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM s)")
def compound_split(t, spark):
    p = t("part")
    known = p.where("p_size > 25").select(F.get(F.split("p_name", " "), F.lit(1)).alias("name")).union(spark.createDataFrame([("red",)], "name string")).distinct()
    return skills.split_compounds(p.select("p_partkey", F.col("p_name").alias("name")), "name", known)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def json_extract(t, spark):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n``` ok"))).otherwise(F.concat(F.lit("so "), "props", F.lit(" done")))
    return t("events").select("event_id", text.tolerant_number(text.salvage_json(raw), "$.k").alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS low, CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice) AS DOUBLE) WHEN o_orderkey % 3 = 1 THEN CAST(floor(o_totalprice) + 500 AS DOUBLE) END AS high, 'USD' AS currency FROM orders")
def salary_text_parse(t, spark):
    a, b = F.floor("o_totalprice").cast("string"), (F.floor("o_totalprice") + 500).cast("string")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("upto "), a, F.lit(" $"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("since "), a, F.lit(" upto "), b, F.lit(" $"))).otherwise(F.concat(F.lit("since "), a, F.lit(" $")))
    return t("orders").select("o_orderkey", money.parse_salary(raw, "upto", "since").alias("s")).select("o_orderkey", "s.low", "s.high", "s.currency")


@query("SELECT n_nationkey, CASE WHEN regexp_matches(n_name, '(?i)united') THEN 'USD' WHEN regexp_matches(n_name, '(?i)an') THEN 'EUR' WHEN regexp_matches(n_name, '(?i)ia$') THEN 'GBP' END AS currency FROM nation")
def currency_infer(t, spark):
    return t("nation").select("n_nationkey", rules.first_match(F.col("n_name"), [("(?iu)united", "USD"), ("(?iu)an", "EUR"), ("(?iu)ia$", "GBP")]).alias("currency"))


@query("SELECT o_orderkey, round(o_totalprice * CASE WHEN o_totalprice < 10000 THEN 160 WHEN o_totalprice > 200000 THEN 1.0::DOUBLE / 12 ELSE 1 END, 6) AS by_size, round(o_totalprice * CASE WHEN o_orderpriority LIKE '%LOW%' AND o_totalprice >= 30000 * 12 * 1.5 THEN 1.0::DOUBLE / 12 WHEN o_totalprice < 30000 THEN 160 WHEN o_totalprice > 60000 THEN 1 WHEN o_orderpriority LIKE '%HIGH%' THEN 160 ELSE 1 END, 6) AS by_text FROM orders")
def monthly_normalize(t, spark):
    p = F.col("o_totalprice")
    none = F.lit(None).cast("double")
    by_text = money.monthly(p, none, F.lit("RUB"), F.col("o_orderpriority"), "HIGH", "LOW")
    return t("orders").select("o_orderkey", F.round(p * money.monthly_by_size(p, none, 10000, 200000), 6).alias("by_size"), F.round(p * by_text, 6).alias("by_text"))


@query("SELECT event_id, CAST(date_trunc('second', ts) AS VARCHAR) AS kept, CAST(date_trunc('second', ts) - INTERVAL 3 HOUR AS VARCHAR) AS applied FROM events")
def iso_timestamp(t, spark):
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return t("events").select("event_id", show(money.parse_time(raw, False)).alias("kept"), show(money.parse_time(raw)).alias("applied"))


@query(_SQL["diversity_feature"].replace("SELECT l_orderkey, label, CAST(max(k)", ", m AS (SELECT l_orderkey, label, CAST(max(k)") + ") SELECT l_orderkey, " + ", ".join(f"coalesce(max(CASE WHEN label = {i} THEN diversity END), 0) AS f_{i}" for i in range(10)) + ", " + ", ".join(f"max(CASE WHEN o_orderpriority = '{p}' THEN 1.0::DOUBLE ELSE 0 END) AS grade_{i}" for i, p in enumerate(PRIORITIES)) + " FROM m JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def feature_matrix(t, spark):
    # The join drops parts without an order; dropped before, both uses of the lists of parts stay one shuffle.
    d = features.feature_matrix(_diversity(t, _parts(t).where("l_orderkey IS NOT NULL")), "l_orderkey", "label", "diversity", list(range(10)))
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), *features.dummies(F.col("o_orderpriority"), PRIORITIES, "grade_"))
    return d.join(o, "l_orderkey")


@query("SELECT o_orderkey, round((o_totalprice - m) / (CASE WHEN s = 0 THEN 1 ELSE s END), 6) AS z FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")
def standardize(t, spark):
    z = features.standardize(t("orders").select("o_orderkey", F.col("o_totalprice").alias("z")), ["z"])
    return z.withColumn("z", F.round("z", 6))


def _residuals(t) -> DataFrame:
    m = t("orders").groupBy("o_orderpriority").agg(F.avg(F.log("o_totalprice")).alias("mu"))
    return t("orders").join(m, "o_orderpriority").select("o_orderkey", "o_orderpriority", "o_totalprice", "mu", (F.log("o_totalprice") - F.col("mu")).alias("res"))


_RES = "r AS (SELECT o_orderkey, o_orderpriority, o_totalprice, avg(ln(o_totalprice)) OVER (PARTITION BY o_orderpriority) AS mu, ln(o_totalprice) - avg(ln(o_totalprice)) OVER (PARTITION BY o_orderpriority) AS res FROM orders)"


@query(f"WITH {_RES} SELECT o_orderpriority, count(*) AS n, round(CASE WHEN count(*) < 2 THEN (SELECT stddev_pop(res) FROM r) ELSE stddev_pop(res) END, 6) AS sigma FROM r GROUP BY 1")
def group_sigma(t, spark):
    return metrics.group_sigma(_residuals(t), "o_orderpriority", "res").withColumn("sigma", F.round("sigma", 6))


@query(f"WITH {_RES}, q AS (SELECT o_orderpriority, exp(any_value(mu) + quantile_disc(res, 0.1::DOUBLE)) AS lo, exp(any_value(mu) + quantile_disc(res, 0.9::DOUBLE)) AS hi, exp(any_value(mu) + quantile_disc(res, 0.2::DOUBLE)) AS lo2, exp(any_value(mu) + quantile_disc(res, 0.8::DOUBLE)) AS hi2 FROM r GROUP BY 1) SELECT o_orderpriority, round(any_value(lo), 2) AS lower_a, round(any_value(hi), 2) AS upper_a, round(any_value(lo2), 2) AS lower_2a, round(any_value(hi2), 2) AS upper_2a FROM r JOIN q USING (o_orderpriority) GROUP BY 1")
def residual_interval(t, spark):
    d = metrics.residual_interval(_residuals(t), "o_orderpriority", "mu", "res")
    return d.groupBy("o_orderpriority").agg(*(F.round(F.max(c), 2).alias(c) for c in ("lower_a", "upper_a", "lower_2a", "upper_2a")))


@query(f"WITH {_RES}, s AS (SELECT o_orderpriority, any_value(mu) AS mu, stddev_pop(res) AS s FROM r GROUP BY 1) SELECT o_orderpriority, round(exp(mu - 1.2815515655446004::DOUBLE * s), 4) AS lower, round(exp(mu + 1.2815515655446004::DOUBLE * s), 4) AS upper FROM s")
def gaussian_interval(t, spark):
    s = _residuals(t).groupBy("o_orderpriority").agg(F.max("mu").alias("mu"), F.stddev_pop("res").alias("s"))
    return metrics.gaussian_interval(s, "mu", "s").select("o_orderpriority", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@query(f"WITH {_RES}, s AS (SELECT o_orderpriority, any_value(mu) AS mu, stddev_pop(res) AS s FROM r GROUP BY 1) SELECT o_orderpriority, round(100 * avg(CASE WHEN o_totalprice BETWEEN exp(s.mu - 1.2815515655446004::DOUBLE * s) AND exp(s.mu + 1.2815515655446004::DOUBLE * s) THEN 1.0::DOUBLE ELSE 0 END), 4) AS coverage FROM r JOIN s USING (o_orderpriority) GROUP BY 1")
def interval_coverage(t, spark):
    r = _residuals(t)
    s = r.groupBy("o_orderpriority").agg(F.stddev_pop("res").alias("s"))
    d = metrics.gaussian_interval(r.join(s, "o_orderpriority"), "mu", "s")
    return metrics.coverage(d, "o_totalprice", "lower", "upper", "o_orderpriority").withColumn("coverage", F.round("coverage", 4))


@query(f"WITH {_CLUST}, j AS (SELECT DISTINCT l_orderkey, label, o_orderpriority FROM c JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT o_orderpriority, count(DISTINCT l_orderkey) AS n FROM j GROUP BY 1), h AS (SELECT o_orderpriority, label, count(*) AS h FROM j GROUP BY ALL), g AS (SELECT n.o_orderpriority, l.label, round(coalesce(h, 0) * 100.0::DOUBLE / n, 1) AS pct FROM n CROSS JOIN (SELECT DISTINCT label FROM j) l LEFT JOIN h ON h.o_orderpriority = n.o_orderpriority AND h.label = l.label) SELECT *, CASE WHEN pct >= 60 THEN 'core' WHEN pct >= 40 THEN 'regular' WHEN pct >= 20 THEN 'episodic' ELSE 'rare' END AS tier FROM g")
def cluster_share(t, spark):
    j = _ordered(t, "o_orderpriority")
    return metrics.share_by_group(j, "l_orderkey", "o_orderpriority", "label")


_PRED = "CAST(left(o_orderpriority, 1) AS BIGINT) AS a, (CAST(left(o_orderpriority, 1) AS BIGINT) + o_orderkey % 4) % 5 + 1 AS p"


def _predicted(t) -> DataFrame:
    a = F.substring("o_orderpriority", 1, 1).cast("long")
    return t("orders").select(a.alias("a"), ((a + F.col("o_orderkey") % 4) % 5 + 1).alias("p"))


@query(f"SELECT round(avg(CAST(a = p AS INT)), 6) AS accuracy, round(avg(CAST(abs(a - p) <= 1 AS INT)), 6) AS adjacent, round(avg(abs(a - p)), 6) AS ordinal_error FROM (SELECT {_PRED} FROM orders)")
def ordinal_metrics(t, spark):
    m = metrics.ordinal_metrics(_predicted(t), "a", "p")
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query(f"WITH x AS (SELECT {_PRED} FROM orders), k AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS BIGINT) AS class), c AS (SELECT class, count(*) FILTER (a = class AND p = class) AS tp, count(*) FILTER (p = class) AS np, count(*) FILTER (a = class) AS na FROM k, x GROUP BY 1) SELECT class, round(CASE WHEN np = 0 THEN 0 ELSE tp::DOUBLE / np END, 3) AS precision, round(CASE WHEN na = 0 THEN 0 ELSE tp::DOUBLE / na END, 3) AS recall, round(CASE WHEN np + na = 0 THEN 0 ELSE 2 * tp::DOUBLE / (np + na) END, 3) AS f1 FROM c")
def class_report(t, spark):
    r = metrics.class_report(_predicted(t), "a", "p", [1, 2, 3, 4, 5])
    return r.withColumn("class", F.col("class").cast("long"))


@query(f"WITH x AS (SELECT {_PRED} FROM orders) SELECT a, " + ", ".join(f"count(*) FILTER (p = {i}) AS n_{i}" for i in range(1, 6)) + " FROM x GROUP BY 1")
def confusion_matrix(t, spark):
    return metrics.status_table(_predicted(t), "a", "p", [1, 2, 3, 4, 5])


@query("SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) rn FROM (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL)) WHERE rn = 1")
def majority_vote(t, spark):
    return metrics.majority(t("events"), "user_id", "event_type")


@query("SELECT event_type, round(quantile_cont(value, 0.025::DOUBLE), 6) AS ci_low, round(quantile_cont(value, 0.975::DOUBLE), 6) AS ci_high FROM events GROUP BY 1")
def quantile_ci(t, spark):
    return metrics.quantile_ci(t("events"), "event_type", "value").select("event_type", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_gram(t, spark):
    fit = models.ols(t("lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(float(fit.coef[0]), 3), round(float(fit.coef[1]), 3), round(float(fit.r2), 6))], "intercept double, slope double, r2 double")


@query("WITH f AS (SELECT o_orderkey, o_orderkey % 5 AS fold, o_totalprice AS y FROM orders), s AS (SELECT fold, sum(y) AS s, count(*) AS n FROM f GROUP BY 1) SELECT o_orderkey, round(y - ((SELECT sum(s) FROM s) - s.s) / ((SELECT sum(n) FROM s) - s.n), 3) AS residual FROM f JOIN s USING (fold)")
def kfold_residuals(t, spark):
    o = t("orders").select("o_orderkey", F.col("o_totalprice").alias("y"))
    return models.kfold_predictions(o, [], "y", F.col("o_orderkey") % 5, 5).select("o_orderkey", F.round(F.col("y") - F.col("prediction"), 3).alias("residual"))


_D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


@query(f"WITH d AS (SELECT a.vec_id, b.vec_id AS other, b.label AS y, {_D2} AS d FROM embeddings a, embeddings b WHERE a.label >= 8 AND b.label < 8), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) rn FROM d) SELECT vec_id, round(greatest(avg(y), 0.5), 6) AS imputed FROM r WHERE rn <= 10 GROUP BY 1")
def knn_impute(t, spark):
    e = t("embeddings")
    return features.knn_impute(e.where("label >= 8"), e.where("label < 8"), "vec_id", "embedding", "label").withColumn("imputed", F.round("imputed", 6))


@query("WITH m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), b AS (SELECT label, list(x ORDER BY i) AS embedding FROM m GROUP BY 1), d AS (SELECT a.vec_id, b.label, " + _D2 + " AS d FROM embeddings a, b) SELECT vec_id, label AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) rn FROM d) WHERE rn = 1")
def nearest_centroid(t, spark):
    return features.nearest_centroid(t("embeddings"), features.centroids(t("embeddings"), "label", "embedding"), "vec_id", "embedding", "label")


@query("WITH r AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, count(*) AS n FROM orders) SELECT CAST(least(floor((o_totalprice - a) / ((b - a) / 12)), 11) AS BIGINT) AS bin, count(*) AS n, round(count(*) / (any_value(r.n) * (any_value(b) - any_value(a)) / 12), 12) AS density FROM orders, r GROUP BY 1")
def histogram(t, spark):
    return metrics.histogram(t("orders"), "o_totalprice", 12).withColumn("density", F.round("density", 12))


@query("SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25::DOUBLE), 4) AS q1, round(quantile_cont(o_totalprice, 0.5::DOUBLE), 4) AS median, round(quantile_cont(o_totalprice, 0.75::DOUBLE), 4) AS q3, max(o_totalprice) AS high FROM orders GROUP BY 1")
def box_stats(t, spark):
    return metrics.box_stats(t("orders"), "o_orderpriority", "o_totalprice").withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query()
def lasso_path(t, spark):
    rows = models.lasso(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", n_alphas=50)
    return spark.createDataFrame(rows, "alpha double, n_kept long, cv_rmse double")


@query()
def balanced_logit(t, spark):
    o = t("orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("y"), F.log("o_totalprice").alias("x"))
    return models.balanced_logit(o, ["x"], "y").groupBy("y", "prediction").agg(F.count("*").alias("n"))


_MOD = f" % {(1 << 31) - 1}"
_POISSON = " + ".join(f"CAST(u >= {c!r}::DOUBLE AS INTEGER)" for c in models.POISSON_CUTS)


@query(
    f"""WITH r AS (SELECT CAST(left(o_orderpriority, 1) AS INTEGER) AS g, ln(o_totalprice) AS x, b, (o_orderkey{_MOD} * 48271 + b * 16807 + 1){_MOD} AS x1, o_orderkey{_MOD} AS h FROM orders, (SELECT unnest(range(100)) AS b)), r2 AS (SELECT *, (x1 * x1 + b + 7){_MOD} AS x2 FROM r), r3 AS (SELECT *, (x2 * x2 + h){_MOD} AS x3 FROM r2), r4 AS (SELECT g, x, b, (x3 * x3 + b * 31 + 3){_MOD} / {(1 << 31) - 1}::DOUBLE AS u FROM r3), w AS (SELECT g, b, x, {_POISSON} AS w FROM r4),
    m AS (SELECT g, b, sum(w * x) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL) SELECT g, round(avg(m), 9) AS mean, round(quantile_cont(m, 0.025::DOUBLE), 9) AS ci_low, round(quantile_cont(m, 0.975::DOUBLE), 9) AS ci_high FROM m GROUP BY 1"""
)
def bootstrap_ci(t, spark):
    o = t("orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("g"), F.log("o_totalprice").alias("x"))
    return models.bootstrap_means(o, "o_orderkey", "g", "x", 100).withColumns({c: F.round(c, 9) for c in ("mean", "ci_low", "ci_high")})


@query()
def ordered_probit(t, spark):
    o = t("orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("y"), F.log("o_totalprice").alias("x"))
    fit = models.ordered_probit(o, ["x"], "y")
    return spark.createDataFrame([(n, float(v)) for n, v in fit], "name string, value double")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) rn FROM events) WHERE rn = 1")
def stream_dedup_batch(t, spark):
    return ingest.keep_first(t("events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], [F.col("event_id")]).select("event_id", "user_id")


from . import modelling, reports  # noqa: E402, F401  register their queries here
