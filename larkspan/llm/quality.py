"""Document quality by hierarchical empirical Bayes.

A logistic document classifier gives each document's own evidence. Its mean over a host, and over a path within the host, is a noisy estimate of
how good that site is; each is shrunk toward the level above by a prior whose strength is estimated from the spread between sites (method of
moments), so a sparse site says little and a large one much. A document's final odds combine its own evidence with its path's posterior, from
which its own contribution is left out. Everything but the fit of the classifier is grouped aggregation and SQL expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import materialize
from .toxicity import calibrate

#: Bound on labelled rows that the document classifier is fitted on, the first by hash of the id. Only their features are collected.
TRAIN_DOCS = 5000
FEATURES = 8
#: Paths (with their hosts) that the last join may send to every task: names and four numbers of each, some MB. Beyond it, both sides are shuffled.
HELD_PATHS = 1 << 16


def features(text: Column) -> list[Column]:
    """Length, symbols, digits, capitals, word length, doubled marks, repeated lines, line length; all defined for empty texts."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t) + 1
    left = lambda chars: F.length(F.translate(t, chars, ""))
    share = lambda chars: (F.length(t) - left(chars)) / n
    lines = F.split(t, "\n")
    return [
        F.log1p(F.length(t).cast("double")),
        F.sqrt(share("|%&*$#^~=<>{}[]\\")),
        share("0123456789"),
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        F.least(n / (F.length(t) - left(" \n") + 1), F.lit(30.0)),
        (F.length(t) - F.length(F.replace(F.replace(t, F.lit("!!"), F.lit("")), F.lit("..."), F.lit("")))) / n,
        F.size(F.array_distinct(lines)) / F.size(lines),
        F.log1p(n / F.size(lines)),
    ]


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def fit(rows: list[tuple[list[float], int]]) -> tuple[float, list[float]]:
    """Intercept and weights on raw features; the smoothed base rate alone where the rows have fewer than two classes."""
    y = np.array([r[1] for r in rows], float)
    if len(set(y.tolist())) < 2:
        rate = (y.sum() + 1) / (len(y) + 2)
        return float(np.log(rate / (1 - rate))), [0.0] * FEATURES
    w, mean, scale = calibrate(np.array([r[0] for r in rows], float), y)
    return float(w[0] - (w[1:] * mean / scale).sum()), (w[1:] / scale).tolist()


def strength(mean: float | None, spread: float | None) -> float:
    """Pseudo-count of a Beta prior with this mean and variance between groups, within [2, 10000]."""
    if mean is None or spread is None or spread <= 0:
        return 1e4
    return float(min(max(mean * (1 - mean) / spread - 1, 2.0), 1e4))


def quality(docs: DataFrame, labels: DataFrame, host: str | Column = "source", path: str | Column = "lang", id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, evidence (the document classifier's probability), host_posterior, path_posterior, score, keep (score >= 0.5).

    host and path: columns or expressions that name a document's site and its place there; null is a site of its own. Null or empty text: scored
    by its features, all of a text without characters. Null id: scored, never learned from. Repeated rows: scored each. Labels other than 0 and 1
    aren't learned from; no usable labels: evidence is 0.5. Empty table: empty result. Other columns are not read.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    site = lambda c: F.coalesce(F.concat(F.lit("="), as_column(c).cast("string")), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), site(host).alias("host"), site(path).alias("path"), F.array(*(f.cast("double") for f in features(F.col(text_col)))).alias("x"))
    own = materialize(own)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("y").alias("y"))
    sample = own.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "x", "y").limit(max_docs).collect()
    w0, w = fit([(r.x, r.y) for r in sample])
    logit = F.lit(w0)
    for i, c in enumerate(w):
        logit = logit + F.lit(c) * F.col("x")[i]
    scored = own.select("doc_id", "host", "path", _sigmoid(F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))).alias("evidence"))
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), F.sum("s").alias("s_host"))

    def spread(groups: DataFrame, n: str, s: str, center: Column) -> tuple[float, float]:
        """Mean, and variance between groups less what sampling alone gives, weighted by rows; groups of one row tell nothing of it."""
        r = groups.where(F.col(n) > 1).agg((F.sum(F.col(n) * (F.col(s) / F.col(n) - center) ** 2) / F.sum(n)).alias("v"), (F.sum(F.lit(1.0)) / F.sum(n)).alias("per_row"), (F.sum(s) / F.sum(n)).alias("m")).first()
        return (r.m, r.v - r.m * (1 - r.m) * r.per_row) if r.m is not None else (None, None)

    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("paths")).first()
    mean = (total.s + 1) / (total.n + 2) if total.n else 0.5
    m_host = strength(*spread(hosts, "n_host", "s_host", F.lit(mean)))
    m_path = strength(*spread(paths.join(hosts, "host"), "n", "s", F.col("s_host") / F.col("n_host")))
    sites = paths.join(hosts, "host")
    if total.paths <= HELD_PATHS:
        sites = F.broadcast(sites)
    host_left = (F.col("s_host") - F.col("evidence") + m_host * mean) / (F.col("n_host") - 1 + m_host)
    path_left = (F.col("s") - F.col("evidence") + m_path * F.col("host_posterior")) / (F.col("n") - 1 + m_path)
    joined = scored.join(sites, ["host", "path"]).withColumn("host_posterior", host_left).withColumn("path_posterior", path_left)
    prior = _logit(F.lit(mean))
    out = joined.withColumn("score", _sigmoid(_logit(F.col("evidence")) + _logit(F.col("path_posterior")) - prior))
    return out.select("doc_id", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).alias("keep"))
