"""Resampling with replacement without copies of rows: stratified multinomial counts (M12) and drawn residual intervals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import order_statistics, placed

#: Rows of one block, and rounds whose draws share a seed.
BLOCK, GROUP = 4096, 64


@lru_cache(maxsize=8)
def _block_counts(seed: int, stratum: int, n: int, block: int, group: int) -> np.ndarray:
    """How often each row of a block is drawn in each of a group's rounds (rounds x rows), when each round draws n of the stratum's n rows.

    The n draws fall into the two halves of the blocks by a binomial draw, those into quarters, and so on down to the block, each draw seeded by its
    place in that tree: any task finds the same numbers, and those of a round add up to n over all blocks. Within the block rows are drawn alike."""
    lo, hi, drawn = 0, -(-n // BLOCK), np.full(GROUP, n, np.int64)
    while hi - lo > 1:
        middle = (lo + hi) // 2
        rows, left = min(hi * BLOCK, n) - lo * BLOCK, (middle - lo) * BLOCK
        first = np.random.default_rng([seed, stratum, group, lo, hi]).binomial(drawn, left / rows)
        lo, hi, drawn = (lo, middle, first) if block < middle else (middle, hi, drawn - first)
    size = min((block + 1) * BLOCK, n) - block * BLOCK
    at = np.random.default_rng([seed, stratum, group, block]).integers(0, size, int(drawn.sum()))
    return np.bincount(np.repeat(np.arange(GROUP), drawn) * size + at, minlength=GROUP * size).reshape(GROUP, size).astype(np.int32)


def multinomial(strata: np.ndarray, places: np.ndarray, sizes: list[int], rounds: np.ndarray, seed: int = 42) -> np.ndarray:
    """rows x rounds: how often each row, at its place (from 0) in its stratum, is drawn in each round. Negative rounds are the sample as it is."""
    out = np.ones((len(places), len(rounds)))
    keys = strata.astype(np.int64) << 40 | places.astype(np.int64) // BLOCK
    for key in np.unique(keys):
        rows, stratum, block = np.flatnonzero(keys == key), int(key >> 40), int(key & ((1 << 40) - 1))
        inside = places[rows].astype(np.int64) - block * BLOCK
        for group in np.unique(rounds[rounds >= 0] // GROUP):
            at = np.flatnonzero((rounds >= 0) & (rounds // GROUP == group))
            counts = _block_counts(seed, stratum, sizes[stratum], block, int(group))
            out[np.ix_(rows, at)] = counts[np.ix_(rounds[at] - group * GROUP, inside)].T
    return out


def stratified_rounds(df: DataFrame, key: str, stratum: str, value: str, rounds: int, seed: int = 42) -> DataFrame:
    """M12's resampling: for each stratum and round (from 0) n, the number of rows drawn (with replacement, as many as the stratum has), rows, that of
    different ones, and mean, the drawn rows' mean value (null values don't count).

    Rows of a stratum are numbered in the order of a hash of the key; each task sums up its own rows' counts, and sends one row for each stratum and
    round. Rows without a stratum are left out. Empty table: empty result."""
    kind = df.schema[stratum].dataType.simpleString()
    own = df.where(F.col(stratum).isNotNull()).select(stratum, key, F.col(value).cast("double").alias("_v"))
    counted = own.groupBy(stratum).agg(F.count("*").alias("n")).orderBy(stratum).collect()
    strata, sizes = [r[0] for r in counted], [r.n for r in counted]
    numbered = placed(own, [F.xxhash64(key), F.col(key), F.col("_v")], "_at", [stratum])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, sums = {s: i for i, s in enumerate(strata)}, {}
        for batch in batches:
            own = np.array([code[s] for s in batch.column(0).to_pylist()], np.int64)
            v, at = batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).to_numpy()
            for lo in range(0, rounds, GROUP):
                r = np.arange(lo, min(lo + GROUP, rounds))
                w = multinomial(own, at, sizes, r, seed)
                known = ~np.isnan(v)
                for s in np.unique(own):
                    mine = w[own == s]
                    k, x = known[own == s], v[own == s]
                    total = np.stack([mine.sum(0), (mine > 0).sum(0), mine[k].sum(0), x[k] @ mine[k]])
                    sums[int(s), lo] = sums.get((int(s), lo), 0) + total
        for (s, lo), total in sums.items():
            size = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([strata[s]] * size), pa.array(np.arange(lo, lo + size), pa.int32()), *(pa.array(t) for t in total)], [stratum, "round", "n", "rows", "known", "total"])

    parts = numbered.select(stratum, "_v", "_at").mapInArrow(run, f"`{stratum}` {kind}, round int, n double, rows double, known double, total double")
    added = parts.groupBy(stratum, "round").agg(*(F.sum(c).alias(c) for c in ("n", "rows", "known", "total")))
    return added.select(stratum, "round", F.col("n").cast("long").alias("n"), F.col("rows").cast("long").alias("rows"), F.try_divide("total", "known").alias("mean"))


def uniform(*parts: object) -> F.Column:
    """A number in [0, 1) with 52 bits, drawn by the md5 of the parts, which SQL has as well."""
    text = F.concat_ws(":", *(p if isinstance(p, F.Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def drawn_interval(df: DataFrame, group: str, mu: str, residual: str, alpha: float = 0.1, draws: int = 10_000, seed: int = 42, least: int = 2, fallback: str | None = None) -> DataFrame:
    """M13 as drawn: df with lower_a, upper_a (outer band, alpha and 1 - alpha), lower_2a, upper_2a (inner band): percentiles, interpolated, of exp(mu + e)
    over ``draws`` residuals e drawn with replacement from the row's group, or from all rows' ``fallback`` residuals (``residual`` if not given)
    where the group has fewer than ``least``.

    No row is copied: a group draws places in its sorted residuals, and only the two at each percentile are looked up, by exact selection. Seeded by
    group, so repeatable; all rows of a group share the draws. Null residuals are not drawn from; no residuals at all: null bounds."""
    sizes = df.groupBy(group).agg(F.count(residual).alias("_n"))
    overall = df.agg(F.count(fallback or residual)).first()[0]
    pool = sizes.select(group, (F.col("_n") < least).alias("_small"), F.when(F.col("_n") < least, overall).otherwise(F.col("_n")).alias("_n")).where("_n > 0")
    cuts = [("lower_a", alpha), ("upper_a", 1 - alpha), ("lower_2a", 2 * alpha), ("upper_2a", 1 - 2 * alpha)]
    each = pool.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    place = F.least(F.floor(uniform(seed, F.coalesce(F.col(group).cast("string"), F.lit("")), F.col("_b").cast("string")) * F.col("_n")), F.col("_n") - 1)
    drawn = each.groupBy(group, "_small").agg(F.sort_array(F.collect_list(place)).alias("_places"))
    ends = []
    for name, p in cuts:
        at = (draws - 1) * p
        low = min(int(at), draws - 1)
        ends.append(F.struct(F.lit(name).alias("cut"), F.get("_places", F.lit(low)).alias("low"), F.get("_places", F.lit(min(low + 1, draws - 1))).alias("high"), F.lit(at - low).alias("share")))
    asked = drawn.select(F.col(group).alias("_g"), "_small", F.explode(F.array(*ends)).alias("e")).select("_g", "_small", "e.*")
    ranks = asked.select("_g", "_small", F.explode(F.array("low", "high")).alias("rank"))
    own = order_statistics(df.select(F.col(group).alias("_g"), F.col(residual).cast("double").alias("_v")), "_g", "_v", ranks.where("NOT _small").select("_g", "rank")).withColumn("_small", F.lit(False))
    every = df.select(F.lit(0).alias("_g"), F.col(fallback or residual).cast("double").alias("_v"))
    shared = order_statistics(every, "_g", "_v", ranks.where("_small").select(F.lit(0).alias("_g"), "rank"))
    found = own.select("_g", "_small", "rank", "_v")
    if pool.where("_small").limit(1).count():
        found = found.union(ranks.where("_small").select("_g", "rank").distinct().join(shared.select("rank", "_v"), "rank").select("_g", F.lit(True).alias("_small"), "rank", "_v"))
    low, high = (found.select(F.col("_g").alias(f"_{s}"), F.col("rank").alias(f"_{s}k"), F.col("_v").alias(f"_{s}v")) for s in ("l", "h"))
    met = asked.join(low, asked["_g"].eqNullSafe(low["_l"]) & (asked["low"] == low["_lk"])).join(high, asked["_g"].eqNullSafe(high["_h"]) & (asked["high"] == high["_hk"]))
    factor = F.exp("_lv") + (F.exp("_hv") - F.exp("_lv")) * F.col("share")
    bounds = met.groupBy("_g").agg(*(F.max(F.when(F.col("cut") == name, factor)).alias(f"_{name}") for name, _ in cuts))
    out = df.join(bounds, df[group].eqNullSafe(bounds["_g"]), "left")
    return out.select(*(df[c] for c in df.columns), *((F.exp(df[mu]) * F.col(f"_{name}")).alias(name) for name, _ in cuts))
