"""Registered queries of topics, selection, resampling and merging. Tables stand for the same things as in ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density, resampling, topics
from ..session import scratch
from ..streaming.buckets import BucketTable
from ..streaming.claims import Claims
from .catalogue import query

# ---- topics ----


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    d AS (SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    r AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM d) SELECT vec_id, round(d, 9) AS core FROM r WHERE k = 10"""
)
def core_distances(t, spark):
    """Distance to the tenth nearest vector."""
    return density.core_distances(t("embeddings"), "vec_id", "embedding", 10).withColumn("core", F.round("core", 9))


@query()
def hdbscan_topics(t, spark):
    """Coarse, medium and fine topics of all embeddings."""
    return density.density_clusters(t("embeddings"), "vec_id", "embedding", [10, 5, 3])


@query(
    """WITH w AS (SELECT source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{3,}')) AS word FROM documents WHERE source IS NOT NULL),
    c AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT source, sum(n) AS size FROM c GROUP BY 1), o AS (SELECT word, sum(n) AS total FROM c GROUP BY 1),
    x AS (SELECT source, word, n::DOUBLE / size * ln(1 + (SELECT avg(size) FROM s) / total) AS score FROM c JOIN s USING (source) JOIN o USING (word)),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 12) DESC, word) AS rank FROM x) SELECT source, word, round(score, 9) AS score, rank FROM r WHERE rank <= 10"""
)
def topic_words(t, spark):
    """The words of each source's documents."""
    return topics.topic_words(t("documents"), "source", "text").withColumn("score", F.round("score", 9))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS topic FROM embeddings),
    m AS (SELECT topic, i, avg(v[i]) AS m FROM v, unnest(range(1, len(v) + 1)) AS t(i) WHERE topic >= 0 GROUP BY ALL),
    c AS (SELECT vec_id, m.topic, sum(v[i] * m) / (sqrt(sum(v[i] * v[i])) * sqrt(sum(m * m))) AS c FROM v JOIN m ON true WHERE v.topic < 0 GROUP BY ALL),
    b AS (SELECT vec_id, arg_max(topic, (c, -topic)) AS topic, max(c) AS c FROM c GROUP BY 1)
    SELECT v.vec_id, CASE WHEN c >= 0.05 THEN b.topic ELSE v.topic END AS topic, coalesce(c >= 0.05, false) AS moved FROM v LEFT JOIN b USING (vec_id)"""
)
def reassigned_noise(t, spark):
    """Noise goes to the nearest topic."""
    rows = t("embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 3 == 0, -1).otherwise(F.col("label")).alias("topic"))
    return topics.reassign_noise(rows, "vec_id", "embedding", "topic", least=0.05)


# ---- resampling ----

_POOLS = "g AS (SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'single' ELSE o_orderpriority END AS grade, ln(o_totalprice) AS y FROM orders), r AS (SELECT *, avg(y) OVER (PARTITION BY grade) AS mu, y - avg(y) OVER () AS res FROM g)"


@query(
    f"""WITH {_POOLS}, n AS (SELECT grade, count(*) AS own FROM r GROUP BY 1), s AS (SELECT grade, own < 2 AS small, CASE WHEN own < 2 THEN (SELECT count(*) FROM r) ELSE own END AS n FROM n),
    d AS (SELECT grade, small, CAST(least(floor(CAST('0x' || substr(md5('42:' || grade || ':' || b), 1, 13) AS BIGINT) / 4503599627370496::DOUBLE * n), n - 1) AS BIGINT) AS k FROM s, (SELECT unnest(range(10000)) AS b)),
    o AS (SELECT grade, false AS small, res, row_number() OVER (PARTITION BY grade ORDER BY res) - 1 AS k FROM r),
    a AS (SELECT res, row_number() OVER (ORDER BY res) - 1 AS k FROM r),
    e AS (SELECT d.grade, exp(o.res) AS f FROM d JOIN o ON o.grade = d.grade AND o.k = d.k WHERE NOT d.small UNION ALL SELECT d.grade, exp(a.res) FROM d JOIN a ON a.k = d.k WHERE d.small),
    q AS (SELECT grade, quantile_cont(f, 0.1::DOUBLE) AS la, quantile_cont(f, 0.9::DOUBLE) AS ua, quantile_cont(f, 0.2::DOUBLE) AS l2, quantile_cont(f, 0.8::DOUBLE) AS u2 FROM e GROUP BY 1)
    SELECT grade, count(*) AS n, round(max(exp(mu) * la), 4) AS lower_a, round(max(exp(mu) * ua), 4) AS upper_a, round(max(exp(mu) * l2), 4) AS lower_2a, round(max(exp(mu) * u2), 4) AS upper_2a,
      round(avg(CAST(exp(y) BETWEEN exp(mu) * la AND exp(mu) * ua AS DOUBLE)) * 100, 3) AS inside FROM r JOIN q USING (grade) GROUP BY 1"""
)
def drawn_interval(t, spark):
    """Intervals of 10,000 draws from each grade's residuals; a grade of one row draws from all."""
    first = t("orders").agg(F.min("o_orderkey").alias("first"))
    rows = t("orders").join(F.broadcast(first), F.lit(True)).select("o_orderkey", F.when(F.col("o_orderkey") == F.col("first"), "single").otherwise(F.col("o_orderpriority")).alias("grade"), F.log("o_totalprice").alias("y"))
    mean = rows.groupBy("grade").agg(F.avg("y").alias("mu"))
    all_ = rows.agg(F.avg("y").alias("centre"))
    rows = rows.join(F.broadcast(mean), "grade").join(F.broadcast(all_), F.lit(True)).withColumn("res", F.col("y") - F.col("centre"))
    out = resampling.drawn_interval(rows, "grade", "mu", "res")
    names = ["lower_a", "upper_a", "lower_2a", "upper_2a"]
    inside = (F.avg(F.exp("y").between(F.col("lower_a"), F.col("upper_a")).cast("double")) * 100).alias("inside")
    return out.groupBy("grade").agg(F.count("*").alias("n"), *(F.round(F.max(c), 4).alias(c) for c in names), F.round(inside, 3).alias("inside"))


@query("SELECT o_orderpriority, CAST(b AS INTEGER) AS round, n, true AS plausible FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), (SELECT unnest(range(1000)) AS b)")
def stratified_rounds(t, spark):
    """1000 rounds, each draws as many rows of each grade as it has. plausible: nearly 1 - 1/e of them are drawn at least once, and the mean of the
    drawn is within six standard errors."""
    o = t("orders").select("o_orderkey", "o_orderpriority", F.log("o_totalprice").alias("x"))
    found = resampling.stratified_rounds(o, "o_orderkey", "o_orderpriority", "x", 1000)
    own = o.groupBy("o_orderpriority").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("size"))
    share = F.abs(F.col("rows") / F.col("size") - (1 - F.exp(F.lit(-1.0)))) < 4 / F.sqrt("size")
    near = F.abs(F.col("mean") - F.col("m")) <= 6 * F.col("s") / F.sqrt("size")
    return found.join(F.broadcast(own), "o_orderpriority").select("o_orderpriority", "round", "n", (share & near).alias("plausible"))


# ---- queues and merges ----


@query(
    """WITH w AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS k FROM events WHERE value > 10)
    SELECT 'a' AS worker, event_id, event_type FROM w WHERE k <= 400 UNION ALL SELECT 'b', event_id, event_type FROM w WHERE k > 400 AND k <= 800
    UNION ALL SELECT 'c', event_id, event_type FROM w WHERE k <= 400 AND event_id % 2 = 1 UNION ALL SELECT 'c', event_id, event_type FROM w WHERE k > 800"""
)
def claimed_batches(t, spark):
    """Three workers claim rows of one queue in turn. a finishes half of its rows before its lease runs out; c takes the other half again, and
    all that is left."""
    claims, waiting = Claims(spark, f"{scratch(spark)}/claims"), t("events").where("value > 10")
    take = lambda n, worker, now: claims.claim(waiting, "event_id", n, worker, 60, ["ts"], now)
    a = take(400, "a", 1000.0)
    b = take(400, "b", 1030.0)
    claims.finish(a.where("event_id % 2 = 0"), "event_id", "a")
    c = take(waiting.count(), "c", 1070.0)
    out = [rows.select(F.lit(w).alias("worker"), "event_id", "event_type") for w, rows in (("a", a), ("b", b), ("c", c))]
    return out[0].union(out[1]).union(out[2])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn = 1")
def bucket_merge(t, spark):
    """The events of each weekday as an epoch, all delivered twice, merged by user."""
    table = BucketTable(f"{scratch(spark)}/table", ["user_id"], [F.desc("event_id")], buckets=16)
    rows = t("events").select("user_id", "event_id", "event_type", F.weekday("ts").alias("day"))
    for _ in range(2):
        for day in range(7):
            table.merge(rows.where(F.col("day") == day).drop("day"), day)
    return table.read(spark)
