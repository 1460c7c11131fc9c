"""What topics are about, and where noise belongs (M17): class-based term weights, reassignment by similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import centroids, cosine


def topic_words(df: DataFrame, topic: str, text: str, n: int = 10, pattern: str = "[a-z]{3,}") -> DataFrame:
    """topic, word, score, rank: of each topic the n words of largest class-based TF-IDF (ties by word). A word's score is its share of the topic's
    words, times ln(1 + mean number of words of a topic / the word's number over all topics).

    A-Z are lower-cased, words are matches of the pattern. Texts that are null or without words, and rows without a topic, play no part. Words are
    counted by topic before anything is shuffled; totals are made of these counts."""
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = df.where(F.col(topic).isNotNull()).select(topic, F.explode(F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0))).alias("word"))
    counts = words.groupBy(topic, "word").agg(F.count("*").alias("_n"))
    sizes = counts.groupBy(topic).agg(F.sum("_n").alias("_size"))
    totals = counts.groupBy("word").agg(F.sum("_n").alias("_total"))
    mean = sizes.agg(F.avg("_size").alias("_mean"))
    score = F.col("_n") / F.col("_size") * F.log(1 + F.col("_mean") / F.col("_total"))
    scored = counts.join(totals, "word").join(sizes, topic).join(F.broadcast(mean), F.lit(True)).select(topic, "word", score.alias("score"))
    rn = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc(F.round("score", 12)), "word"))
    return scored.withColumn("rank", rn.cast("long")).where(F.col("rank") <= n)


def reassign_noise(df: DataFrame, key: str, vector: str, topic: str, noise: Column | None = None, least: float = 0.0) -> DataFrame:
    """key, topic, moved: rows of noise (topic -1, or as given) go to the topic whose mean vector is nearest by cosine (ties: smaller topic), if that is
    at least ``least``; all others stay. Topics are a bounded dimension, so their means are one row that meets every row; noise without a vector stays."""
    is_noise = F.coalesce(F.col(topic) == -1, F.lit(True)) if noise is None else noise
    means = centroids(df.where(~is_noise), topic, vector)
    all_ = means.groupBy().agg(F.collect_list(F.struct("centroid", F.col(topic).alias("t"))).alias("_all"))
    near = F.array_min(F.transform("_all", lambda c: F.struct((-cosine(F.col(vector), c["centroid"])).alias("d"), c["t"].alias("t"))))
    placed = df.select(key, vector, topic, is_noise.alias("_noise")).join(F.broadcast(all_), F.lit(True)).withColumn("_near", F.when(F.col("_noise") & F.col(vector).isNotNull(), near))
    goes = F.coalesce(-F.col("_near.d") >= least, F.lit(False))
    return placed.select(key, F.when(goes, F.col("_near.t")).otherwise(F.col(topic)).alias(topic), goes.alias("moved"))
