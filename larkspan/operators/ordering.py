"""Numbers in a total order and exact order statistics, without one task for all rows or for all values of a group."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized

#: Rows that may go to every task.
HELD = 1 << 20
#: A group of at most so many rows, or what is left of a larger one, is sorted in one task.
SORTED = 1 << 16
#: Ranges that one round cuts the rest of a large group into.
RANGES = 256


def sent(df: DataFrame) -> DataFrame:
    """df, to be sent to every task if it is small; its rows are counted."""
    return F.broadcast(df) if df.count() <= HELD else df


def placed(df: DataFrame, order: list[Column], column: str, within: list[str] = (), start: int = 0) -> DataFrame:
    """Rows numbered from ``start`` in a total order, of each value of ``within`` if given (a null is a value).

    Rows are dealt out by ranges of the whole composite key and sorted there, so a frequent value is split at its ties; a row's number is its place in its
    range plus the sizes of the ranges before. Rows that are equal in all of the order take their numbers in any order. The sorted rows are
    written once, as ranges are drawn from a sample."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(c).asc_nulls_first() for c in within), *order]
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = materialized(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)))
    before = F.sum("_n").over((Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each range and group in it.
    ranges = dealt.groupBy("_part", *within).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ranges = materialized(ranges.withColumn("_base", F.coalesce(before, F.lit(0)) - F.col("_first") + start).drop("_n", "_first"))
    named = ranges.select(F.col("_part").alias("_p"), "_base", *(F.col(c).alias(f"_w_{c}") for c in within))
    same = F.col("_part") == F.col("_p")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    return dealt.join(sent(named), same).withColumn(column, (F.col("_at") + F.col("_base")).cast("long")).select(*df.columns, column)


def order_statistics(df: DataFrame, group: str, value: str, wanted: DataFrame, held: int = SORTED, ranges: int = RANGES) -> DataFrame:
    """group, rank, value: the values at the wanted (group, rank) places, from 0, of each group's non-null values in rising order. Exact; ranks beyond the
    group are left out.

    Small groups are sorted. The values of large groups stay where they are: each round counts those within bounds by ranges cut at approximate
    quantiles, and the range that holds a rank gives its next bounds, until few rows or one value are left. No buffer grows with a group."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"))
    wanted = materialized(wanted.select(F.col(group).alias("_g"), F.col("rank").cast("long").alias("_k")).distinct())
    sizes = materialized(rows.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    # Large groups are fewer than the rows by the size that makes them large.
    large = sizes.where(F.col("_n") > held)
    sizes_sent = sent(large.select("_g"))
    here = lambda left, right: left["_g"].eqNullSafe(right["_g"])

    def sorted_out(cells: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
        listed = cells.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_l"))
        match = [listed[k].eqNullSafe(targets[k]) for k in keys]
        found = targets.join(listed, [m for m in match]).select(targets["_g"].alias("_g"), targets["_k"].alias("_k"), F.get("_l", (targets["_k"] - targets["_below"]).cast("int")).alias("_v"))
        return found.where("_v IS NOT NULL")

    out = sorted_out(rows.join(sizes_sent, here(rows, sizes_sent), "left_anti").withColumn("_cell", F.lit(0)), wanted.withColumn("_below", F.lit(0).cast("long")).withColumn("_cell", F.lit(0)), ["_g", "_cell"])
    if not large.limit(1).count():
        return out.select(F.col("_g").alias(group), F.col("_k").alias("rank"), F.col("_v").alias(value))
    open_ = wanted.join(large, here(wanted, large)).where(F.col("_k") < F.col("_n")).select(wanted["_g"].alias("_g"), "_k", F.lit(0).cast("long").alias("_below"), "_n", "_lo", "_hi")
    while True:
        open_ = materialized(open_)
        done = open_.where(F.col("_lo") == F.col("_hi")).select("_g", "_k", F.col("_lo").alias("_v"))
        out = out.union(done)
        few = open_.where((F.col("_lo") != F.col("_hi")) & (F.col("_n") <= held))
        many = open_.where((F.col("_lo") != F.col("_hi")) & (F.col("_n") > held))

        def within(targets: DataFrame) -> DataFrame:
            """The rows between the bounds of a target, once for each pair of bounds."""
            bounds = sent(targets.select(F.col("_g").alias("_h"), F.col("_lo").alias("_cell"), "_hi").distinct())
            return rows.join(bounds, rows["_g"].eqNullSafe(bounds["_h"]) & (rows["_v"] >= bounds["_cell"]) & (rows["_v"] <= bounds["_hi"])).select("_g", "_cell", "_v")

        if few.limit(1).count():
            out = out.union(materialized(sorted_out(within(few), few.withColumn("_cell", F.col("_lo")), ["_g", "_cell"])))
        if not many.limit(1).count():
            return out.select(F.col("_g").alias(group), F.col("_k").alias("rank"), F.col("_v").alias(value))
        cells = within(many)
        cuts = F.percentile_approx("_v", F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(8 * ranges))
        pivots = sent(materialized(cells.groupBy("_g", "_cell").agg(F.array_distinct(cuts).alias("_cuts"))).select(F.col("_g").alias("_h"), F.col("_cell").alias("_c"), "_cuts"))
        met = cells.join(pivots, cells["_g"].eqNullSafe(pivots["_h"]) & (cells["_cell"] == pivots["_c"]))
        # Values equal to a cut are a range of their own, so a frequent value ends the search.
        below, equal = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.array_contains("_cuts", F.col("_v")).cast("int")
        counted = met.groupBy("_g", "_cell", (2 * below + equal).alias("_range")).agg(F.count("*").alias("_m"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        w = Window.partitionBy("_g", "_cell").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        counted = materialized(counted.withColumn("_before", F.coalesce(F.sum("_m").over(w), F.lit(0))).withColumnRenamed("_g", "_h"))
        place = F.col("_k") - F.col("_below")
        open_ = many.join(counted, many["_g"].eqNullSafe(counted["_h"]) & (many["_lo"] == counted["_cell"]) & (place >= F.col("_before")) & (place < F.col("_before") + F.col("_m")))
        open_ = open_.select("_g", "_k", (F.col("_below") + F.col("_before")).alias("_below"), F.col("_m").alias("_n"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi"))


def quantiles(df: DataFrame, group: str | None, value: str, probabilities: list[float], continuous: bool = True, held: int = SORTED) -> DataFrame:
    """group, n, q (an array in the order of the probabilities): exact quantiles of each group's non-null values; of all rows as one group if that is None.
    Continuous ones are interpolated between two order statistics; else the first value whose share of values up to it reaches the probability.
    A group without values has n = 0 and null."""
    g = group or "_all"
    rows = df.select((F.col(group) if group else F.lit(0)).alias(g), F.col(value).cast("double").alias("_value"))
    sizes = materialized(rows.groupBy(g).agg(F.count("_value").alias("n")))
    if not sizes.where(F.col("n") > held).limit(1).count():
        # No group is large, so each can be sorted where it is aggregated.
        parts = [f"percentile(_value, {float(p)!r}D)" if continuous else f"percentile_disc({float(p)!r}D) WITHIN GROUP (ORDER BY _value)" for p in probabilities]
        out = rows.groupBy(g).agg(F.count("_value").alias("n"), F.array(*(F.expr(p) for p in parts)).alias("q")).withColumn("q", F.when(F.col("n") > 0, F.col("q")))
        return out if group else out.drop(g)
    each, n = [], F.col("n").cast("decimal(20,0)")
    for i, p in enumerate(probabilities):
        # Probabilities as they are written, so that n * p is exact.
        exact = Decimal(repr(float(p)))
        at = ((n - 1) * F.lit(exact)).cast("double") if continuous else F.greatest(F.ceil(n * F.lit(exact)) - 1, F.lit(0)).cast("double")
        each.append(F.struct(F.lit(i).alias("i"), F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("share")))
    asked = sizes.where("n > 0").select(g, F.explode(F.array(*each)).alias("a")).select(g, "a.*")
    found = order_statistics(rows, g, "_value", asked.select(g, F.explode(F.array("low", "high")).alias("rank")), held)
    low, high = (found.select(F.col(g).alias(f"_{s}g"), F.col("rank").alias(f"_{s}k"), F.col("_value").alias(f"_{s}v")) for s in ("l", "h"))
    met = asked.join(low, asked[g].eqNullSafe(low["_lg"]) & (asked["low"] == low["_lk"])).join(high, asked[g].eqNullSafe(high["_hg"]) & (asked["high"] == high["_hk"]))
    value_ = F.when(F.col("share") == 0, F.col("_lv")).otherwise(F.col("_lv") + (F.col("_hv") - F.col("_lv")) * F.col("share"))
    listed = met.groupBy(g).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value_.alias("v")))), lambda s: s["v"]).alias("q"))
    sized = sizes.withColumnRenamed(g, "_s")
    out = sized.join(listed, sized["_s"].eqNullSafe(listed[g]), "left").select(F.col("_s").alias(g), "n", "q")
    return out if group else out.drop(g)
