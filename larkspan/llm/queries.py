"""Registered queries of this subpackage and the SQL that checks them, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .ann import nearest
from .core import HELD_IDS, materialize, read
from .lm_score import cross_entropy_difference
from .minhash import near_duplicates
from .packing import pack
from .periodic_runs import periodic_runs
from .quality import quality
from .suffix_dedup import suffix_dedup
from .token_count import token_counts
from .toxicity import toxicity
from .urlfilter import DISTINCT_SOFT, SOFT, STRICT, filter_urls
from .vector_dedup import near_duplicate_vectors
from .whitening import whiten
from .winnow import decontaminate


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents")).drop("text")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = materialize(read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("good")).where("good = 1"))
    # Few ids go to every task, so the texts stay where they are.
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(good) if good.count() <= HELD_IDS else good, "doc_id", "left")
    scored = cross_entropy_difference(docs, F.col("good") == 1)
    # Eight decimals: sums of logarithms in another order agree no further.
    return scored.withColumns({c: F.round(c, 8) + 0.0 for c in ("target_loss", "background_loss", "score")})


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=4)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; of each tenth document, by checksum of its id, the words from some place on repeat those that follow it. Null ids: as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumn("words", F.when(h % 10 == 0, words)).withColumn("g", F.floor(h / 10)).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.expr("array_join(transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) AS int)]), ' ')")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periodic_tails(read(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    found = found.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(ship(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_quality, op3_suffix_dedup, op4_ann, op5_lm_score, op6_token_counts, op7_decontaminate, op8_near_duplicates, op9_packing, op10_url_filter, op11_vector_duplicates, op12_periodic_runs, op13_whitening)
    return {f.__name__: _shipped(f) for f in own}


#: Of each row with an id divisible by 100, the exact nearest rows in double precision.
_ANN_SQL = """
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
  GROUP BY vec_id
), d AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, sqrt(list_sum(list_transform(list_zip(q.v, x.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _url_sql() -> str:
    strict = "|".join(STRICT)  # letters and hyphens only
    found = " + ".join(f"CAST(regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){t}([^\\p{{L}}\\p{{N}}]|$)') AS INTEGER)" for t in SOFT)
    return rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
    translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), s AS (
  SELECT *, regexp_matches(u, '(^|[^\p{{L}}\p{{N}}])({strict})([^\p{{L}}\p{{N}}]|$)') OR {found} >= {DISTINCT_SOFT} AS bad,
    CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bad THEN 'block' ELSE 'allow' END AS verdict
FROM s
"""


_UPPER, _LOWERED = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), {_UPPER}, {_LOWERED}), '{pattern}')"


#: Bytes, which of their 100-byte strings came before, what these cover, and the slices that are left.
_SUFFIX_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
g AS (SELECT doc_id, i, md5(b[i : i + 99]) AS g FROM d, unnest(range(1, n - 98)) AS t(i) WHERE n >= 100),
s AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM g),
p AS (SELECT doc_id, i FROM d, unnest(range(1, n + 1)) AS t(i)),
c AS (SELECT doc_id, i, coalesce(max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM p LEFT JOIN s USING (doc_id, i)),
r AS (SELECT doc_id, i, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c),
k AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run, i FROM c WHERE NOT gone),
e AS (SELECT doc_id, min(i) AS lo, max(i) AS hi FROM k GROUP BY doc_id, run),
x AS (SELECT doc_id, string_agg(hex(b[lo : hi]), '' ORDER BY lo) AS kept FROM e JOIN d USING (doc_id) GROUP BY 1),
m AS (SELECT doc_id, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_removed, CAST(sum(CAST(begins AS INTEGER)) AS BIGINT) AS n_spans FROM r GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN x USING (doc_id)
"""

#: Exact counts of words and bigrams, as text, in both models, less the document's own.
_LM_SQL = rf"""
WITH good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
d AS (SELECT doc_id, {_words("text", r"[^ \x09-\x0D]+")} AS w, doc_id IN (SELECT doc_id FROM good) AS own FROM documents),
t AS (SELECT doc_id, own, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS p FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
u AS (SELECT w, count(*) AS n, count(*) FILTER (own) AS n_own FROM t GROUP BY 1),
b AS (SELECT p, w, count(*) AS n, count(*) FILTER (own) AS n_own FROM t GROUP BY ALL),
s AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n_own) AS DOUBLE) AS n_own, count(*) AS words, (SELECT count(*) FROM d WHERE len(w) > 0) AS starts, (SELECT count(*) FROM d WHERE len(w) > 0 AND own) AS starts_own FROM u),
o AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL),
q AS (SELECT doc_id, p, w, count(*) AS n FROM t GROUP BY ALL),
x AS (SELECT t.doc_id, t.own,
  u.n - o.n AS w, u.n_own - CASE WHEN t.own THEN o.n ELSE 0 END AS w_own,
  b.n - q.n AS b, b.n_own - CASE WHEN t.own THEN q.n ELSE 0 END AS b_own,
  CASE WHEN t.p IS NULL THEN s.starts - 1 ELSE h.n - k.n END AS h,
  CASE WHEN t.p IS NULL THEN s.starts_own - CASE WHEN t.own THEN 1 ELSE 0 END ELSE h.n_own - CASE WHEN t.own THEN k.n ELSE 0 END END AS h_own,
  s.n + s.words - len(d.w) AS total, s.n_own + s.words - CASE WHEN t.own THEN len(d.w) ELSE 0 END AS total_own
  FROM t JOIN d USING (doc_id) JOIN u ON u.w = t.w JOIN o ON o.doc_id = t.doc_id AND o.w = t.w JOIN b ON b.w = t.w AND b.p IS NOT DISTINCT FROM t.p
  JOIN q ON q.doc_id = t.doc_id AND q.w = t.w AND q.p IS NOT DISTINCT FROM t.p LEFT JOIN u h ON h.w = t.p LEFT JOIN o k ON k.doc_id = t.doc_id AND k.w = t.p, s),
l AS (SELECT doc_id, -ln(0.6::DOUBLE * b_own / greatest(h_own, 1) + 0.4::DOUBLE * (w_own + 1) / total_own) AS target, -ln(0.6::DOUBLE * b / greatest(h, 1) + 0.4::DOUBLE * (w + 1) / total) AS background FROM x)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_tokens, coalesce(round(avg(target), 8), 0) AS target_loss, coalesce(round(avg(background), 8), 0) AS background_loss, coalesce(round(avg(background) - avg(target), 8), 0) AS score
FROM d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id, d.w
"""

#: Windows of the items, of 13 words or the item's own number, in the documents.
_WINNOW_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_words("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS g FROM i, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(k) WHERE len(w) > 0),
dw AS (SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n),
m AS (SELECT r, k, n, item FROM dw JOIN iw USING (n, g)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS x FROM m) GROUP BY 1),
f AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN f USING (r)
"""

#: All pairs that share a shingle, and what can be reached by those that are alike.
_NEAR_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", r"[^ \x09-\x0D]+")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT e.b, reached.m FROM reached JOIN e ON e.a = reached.doc_id),
o AS (SELECT doc_id, min(m) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM o LEFT JOIN n USING (doc_id)
"""


#: All pairs of rows of one label, and what can be reached by those that are alike.
_VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT r, vec_id, label, v, sqrt(list_sum(list_transform(v, lambda c: c * c))) AS z FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
  AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
e AS (SELECT x.r, x.vec_id AS a, y.vec_id AS b FROM f x JOIN f y ON x.label = y.label AND len(x.v) = len(y.v) AND x.r <> y.r
  WHERE list_sum(list_transform(list_zip(x.v, y.v), lambda c: c[1] * c[2])) / (x.z * y.z) >= 0.93),
n AS (SELECT r, count(*) AS n FROM e GROUP BY 1),
reached AS (SELECT DISTINCT vec_id, vec_id AS m FROM f UNION SELECT e.b, reached.m FROM reached JOIN e ON e.a = reached.vec_id),
o AS (SELECT vec_id, min(m) AS c FROM reached GROUP BY 1)
SELECT v.vec_id, coalesce(n, 0) AS n_links, CASE WHEN f.r IS NULL THEN v.vec_id ELSE c END AS component_id, coalesce(v.vec_id = CASE WHEN f.r IS NULL THEN v.vec_id ELSE c END, true) AS kept
FROM v LEFT JOIN f USING (r) LEFT JOIN n USING (r) LEFT JOIN o ON o.vec_id = v.vec_id
"""

#: One step of CRC-32 over the bits of a byte, after it has been added.
_CRC = "list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS UBIGINT))), lambda x, c: list_reduce([xor(x, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, CAST(3988292384 AS UBIGINT) * (y & 1))))"

#: Stretches of words that equal those q before them, of every q; of two with one place the smaller period counts.
_RUNS_SQL = rf"""
WITH c AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w, xor(CAST({_CRC} AS BIGINT), 4294967295) AS h FROM documents),
g AS (SELECT *, len(w) AS n, CAST(h // 10 AS BIGINT) AS g FROM c),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT r, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS w FROM p, unnest(range(n)) AS t(i)),
e AS (SELECT x.r, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS run FROM e) GROUP BY r, q, run HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.r = s.r AND o.q < s.q AND o.s <= s.s AND o.s + o.len >= s.s + s.len)),
best AS (SELECT r, count(*) AS n_runs, arg_max(s, (len, -s, -q)) AS start, max(len) AS length, arg_max(q, (len, -s, -q)) AS period, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM u GROUP BY 1),
gone AS (SELECT DISTINCT r, i FROM (SELECT r, unnest(range(s + q, s + len)) AS i FROM u)),
k AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = t.r AND gone.i = t.i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM p LEFT JOIN best USING (r) LEFT JOIN k USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_vector_duplicates": _VECTOR_SQL, "op12_periodic_runs": _RUNS_SQL, "op3_suffix_dedup": _SUFFIX_SQL, "op4_ann": _ANN_SQL, "op5_lm_score": _LM_SQL, "op7_decontaminate": _WINNOW_SQL, "op8_near_duplicates": _NEAR_SQL, "op10_url_filter": _url_sql()}
