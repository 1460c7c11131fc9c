"""Evaluation and summaries."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized
from .ordering import placed, quantiles


def conditional_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """A1: one row: total and the rows that meet each condition."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def status_table(df: DataFrame, group: str, status: str, values: list[str]) -> DataFrame:
    """Counts by group and status, a column for each of a fixed list of statuses."""
    return df.groupBy(group).agg(*(F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values))


def errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """R2, MAE, median absolute error (exact, by selection), RMSE."""
    e = F.col(actual) - F.col(predicted)
    sst = F.var_pop(actual) * F.count(actual)
    middle = quantiles(df.select(F.abs(e).alias("e")), None, "e", [0.5]).select(F.col("q")[0].alias("median_ae"))
    found = df.agg((1 - F.sum(e * e) / sst).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return found.join(F.broadcast(middle), F.lit(True), "left").select("r2", "mae", "median_ae", "rmse")


def group_sigma(df: DataFrame, group: str, residual: str, least: int = 2) -> DataFrame:
    """Population deviation of each group, the overall one for groups of fewer rows."""
    overall = df.agg(F.stddev_pop(residual)).first()[0]
    return df.groupBy(group).agg(F.count("*").alias("n"), F.stddev_pop(residual).alias("_s")).select(group, "n", F.when(F.col("n") < least, F.lit(overall)).otherwise(F.col("_s")).alias("sigma"))


def coverage(df: DataFrame, actual: str, low: str, high: str, group: str | None = None) -> DataFrame:
    """Percent of actual values within the bounds."""
    share = (F.avg(F.col(actual).between(F.col(low), F.col(high)).cast("double")) * 100).alias("coverage")
    return df.groupBy(group).agg(share) if group else df.agg(share)


def residual_interval(df: DataFrame, group: str, mu: str, residual: str, alpha: float = 0.1) -> DataFrame:
    """M13 in the limit of many draws: exp(mu + order statistic of the group's residuals), outer (alpha) and inner (2 alpha) band. The order statistics
    are exact, by selection."""
    q = quantiles(df, group, residual, [alpha, 1 - alpha, 2 * alpha, 1 - 2 * alpha], continuous=False).select(F.col(group).alias("_g"), "q")
    names = ["lower_a", "upper_a", "lower_2a", "upper_2a"]
    return df.join(q, F.col(group) == F.col("_g")).select(*df.columns, *(F.exp(F.col(mu) + F.col("q")[i]).alias(n) for i, n in enumerate(names)))


def gaussian_interval(df: DataFrame, mu: str, sigma: str, alpha: float = 0.1) -> DataFrame:
    """M14, F40."""
    z = NormalDist().inv_cdf(1 - alpha)
    return df.withColumns({"lower": F.exp(F.col(mu) - z * F.col(sigma)), "upper": F.exp(F.col(mu) + z * F.col(sigma))})


def ordinal_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """A18 on ordinal numbers."""
    d = F.abs(F.col(actual) - F.col(predicted))
    return df.agg(F.avg((d == 0).cast("double")).alias("accuracy"), F.avg((d <= 1).cast("double")).alias("adjacent"), F.avg(d.cast("double")).alias("ordinal_error"))


def class_report(df: DataFrame, actual: str, predicted: str, classes: list) -> DataFrame:
    """Precision, recall, F1 of each class, 0 where undefined, 3 decimals."""
    each = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("class"), (F.col(actual) == c).alias("a"), (F.col(predicted) == c).alias("p")) for c in classes))).alias("s"))
    g = each.groupBy(F.col("s.class").alias("class")).agg(F.count_if(F.col("s.a") & F.col("s.p")).alias("tp"), F.count_if("s.p").alias("np"), F.count_if("s.a").alias("na"))
    safe = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    return g.select("class", F.round(safe(F.col("tp"), F.col("np")), 3).alias("precision"), F.round(safe(F.col("tp"), F.col("na")), 3).alias("recall"), F.round(safe(2 * F.col("tp"), F.col("np") + F.col("na")), 3).alias("f1"))


def majority(df: DataFrame, key: str, vote: str) -> DataFrame:
    """Most frequent vote; ties by the vote itself."""
    counted = df.groupBy(key, vote).agg(F.count("*").alias("votes"))
    # The first vote by falling number, then by itself: kept in part before the shuffle, with no sort.
    best = counted.groupBy(key).agg(F.min(F.struct((-F.col("votes")).alias("n"), F.col(vote).isNotNull().alias("known"), vote)).alias("_b"))
    return best.select(key, F.col("_b")[vote].alias(vote), (-F.col("_b.n")).alias("votes"))


def quantile_ci(df: DataFrame, group: str, value: str, alpha: float = 0.05, accuracy: int | None = None) -> DataFrame:
    """Linear interpolation; nulls and NaN don't count. Exact, by selection; with an accuracy approximate, in one pass, see percentile_approx."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    cuts = [alpha / 2, 1 - alpha / 2]
    if accuracy is not None:
        found = df.groupBy(group).agg(F.percentile_approx(v, F.array(*(F.lit(p) for p in cuts)), accuracy).cast("array<double>").alias("q"))
    else:
        found = quantiles(df.select(group, v.alias("_q")), group, "_q", cuts)
    return found.select(group, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def share_by_group(items: DataFrame, owner: str, group: str, cluster: str) -> DataFrame:
    """Percent of a group's owners that have the cluster, on the full grid, with its tier.

    One pass: each owner of a group counts once for each of its clusters, and once for itself. Rows that are dealt by owner are not shuffled."""
    sets = items.groupBy(group, owner).agg(F.collect_set(cluster).alias("_l"))
    each = sets.select(group, owner, F.explode(F.concat(F.array(F.struct(F.lit(True).alias("all"), F.lit(None).cast(items.schema[cluster].dataType).alias("c"))), F.transform("_l", lambda c: F.struct(F.lit(False).alias("all"), c.alias("c"))))).alias("_e"))
    counted = materialized(each.groupBy(group, F.col("_e.all").alias("_all"), F.col("_e.c").alias(cluster)).agg(F.count(owner).alias("_h")))
    owners = counted.where("_all").select(group, F.col("_h").alias("_n"))
    have = counted.where("NOT _all").drop("_all")
    # Groups and clusters are dimensions of bounded size; the grid is their product: one row of all clusters beside each group.
    listed = have.where(F.col(cluster).isNotNull()).agg(F.array_sort(F.collect_set(cluster)).alias("_l"))
    grid = owners.join(F.broadcast(listed), F.lit(True)).select(group, "_n", F.explode("_l").alias(cluster))
    pct = F.round(F.coalesce("_h", F.lit(0)) * 100.0 / F.col("_n"), 1)
    tier = F.when(F.col("pct") >= 60, "core").when(F.col("pct") >= 40, "regular").when(F.col("pct") >= 20, "episodic").otherwise("rare")
    return grid.join(have, [group, cluster], "left").select(group, cluster, pct.alias("pct")).withColumn("tier", tier)


def adjacent_delta(df: DataFrame, order: str, value: str, partition: list[str] = ()) -> DataFrame:
    """Value of the next step less this one's; the last step has none."""
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))).orderBy(order)
    return df.withColumn("next", F.lead(order).over(w)).withColumn("delta", F.lead(value).over(w) - F.col(value)).where("next IS NOT NULL")


def anchors(df: DataFrame, feature: str, group: str, value: str, n: int) -> DataFrame:
    """The group in which each feature is largest, then the n largest features of each group."""
    first = Window.partitionBy(feature).orderBy(F.desc(value), group)
    second = Window.partitionBy(group).orderBy(F.desc(value), feature)
    best = df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return best.withColumn("rank", F.row_number().over(second).cast("long")).where(F.col("rank") <= n)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """V8: equal bins between minimum and maximum; count and density."""
    r = df.agg(F.min(value).cast("double"), F.max(value).cast("double"), F.count(value)).first()
    if not r[2]:
        return df.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("density")).limit(0)
    width = (r[1] - r[0]) / bins or 1.0
    bin_ = F.least(F.floor((F.col(value) - F.lit(r[0])) / F.lit(width)), F.lit(bins - 1)).cast("long")
    return df.where(F.col(value).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).withColumn("density", F.col("n") / (r[2] * width))


def box_stats(df: DataFrame, group: str, value: str, accuracy: int | None = None) -> DataFrame:
    """V9. Quartiles are exact, by selection; accuracy: as for quantile_ci."""
    cuts = [0.25, 0.5, 0.75]
    if accuracy is not None:
        found = df.groupBy(group).agg(F.percentile_approx(value, F.array(*(F.lit(p) for p in cuts)), accuracy).cast("array<double>").alias("q"))
    else:
        found = quantiles(df, group, value, cuts)
    found = found.select(F.col(group).alias("_g"), *(F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))))
    ends = df.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return ends.join(found, F.col(group).eqNullSafe(F.col("_g"))).select(group, "n", "low", "q1", "median", "q3", "high")


def class_counts(df: DataFrame, column: str, classes: list) -> DataFrame:
    """Rows of each class of a fixed list, 0 where there are none, in the order of the list."""
    n = df.where(F.col(column).isin(classes)).agg(*(F.count_if(F.col(column) == c).alias(f"n{i}") for i, c in enumerate(classes)))
    return n.select(F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("place"), F.lit(c).alias("class"), F.col(f"n{i}").alias("n")) for i, c in enumerate(classes)))))


def depth(df: DataFrame, group: str, cluster: str, value: str) -> DataFrame:
    """Mean value of each cluster in each group."""
    return df.groupBy(group, cluster).agg(F.avg(value).alias("depth"))


def multiplier(beta: Column) -> Column:
    """percent that a unit of a feature adds where the target is a logarithm."""
    return F.expm1(beta) * 100


def half_width(low: Column, high: Column, predicted: Column) -> Column:
    """half the interval, in percent of the prediction."""
    return F.try_divide((high - low) / 2, predicted) * 100


def coefficient_bars(coefs: DataFrame, feature: str, value: str, kind: Column, wanted: str | None = None) -> DataFrame:
    """Multiplier of each feature of a kind, largest absolute coefficient first (ties by name), numbered from 0."""
    own = coefs if wanted is None else coefs.where(kind == wanted)
    return placed(own, [F.desc(F.abs(value)), F.col(feature)], "place").select(feature, multiplier(F.col(value)).alias("multiplier_pct"), "place")


def points(df: DataFrame, actual: str, predicted: str, low: str, high: str, group: str, order: list[str]) -> DataFrame:
    """V3: actual and predicted values by group of a fixed order, with whether the interval holds the actual one."""
    place = F.array_position(F.array(*(F.lit(o) for o in order)), F.col(group)) - 1
    return df.where(F.col(group).isin(order)).select(group, place.alias("place"), actual, predicted, F.col(actual).between(F.col(low), F.col(high)).alias("inside"))


def numbered(df: DataFrame, value: str, tie: str, column: str = "x") -> DataFrame:
    """Rows numbered from 0 by a value and a tie-break, without one task for all. Null values come first."""
    return placed(df, [F.col(value).asc_nulls_first(), F.col(tie)], column)


def band(df: DataFrame, actual: str, tie: str, columns: list[str]) -> DataFrame:
    """Rows by rising actual value (ties by key), numbered from 0."""
    return numbered(df, actual, tie).select("x", tie, actual, *columns)


def with_bounds(predictions: DataFrame, bounds: DataFrame, key: str, low: str, high: str, middle: str) -> DataFrame:
    """The known bounds of each prediction's row, its middle where a bound is unknown or 0."""
    b = bounds.select(key, F.col(low).alias("_low"), F.col(high).alias("_high"))
    joined = predictions.join(b, key, "left")
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.col(middle))
    return joined.withColumns({low: known("_low"), high: known("_high")}).drop("_low", "_high")


def picked(df: DataFrame, number: str, places: list[int]) -> DataFrame:
    """The rows of these numbers."""
    return df.where(F.col(number).isin(places))


def medians(df: DataFrame, group: str, columns: list[str], order: list) -> DataFrame:
    """V7: medians of each group of a fixed list, 0 where a group has no rows."""
    out = df.sparkSession.createDataFrame([(o,) for o in order], [group])
    for c in columns:
        out = out.join(quantiles(df, group, c, [0.5]).select(group, F.col("q")[0].alias(c)), group, "left")
    return out.fillna(0.0, columns)


def mean_abs(coefs: DataFrame, feature: str, value: str) -> DataFrame:
    """Mean absolute coefficient of a feature over the classes."""
    return coefs.groupBy(feature).agg(F.avg(F.abs(value)).alias("importance"))


def mean_probabilities(df: DataFrame, actual: str, probabilities: list[str]) -> DataFrame:
    """Mean predicted probability of each class by actual class."""
    return df.groupBy(actual).agg(F.count("*").alias("n"), *(F.avg(p).alias(p) for p in probabilities))


def mistakes(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Correct and wrong rows of each class, and the confusions off the diagonal as (predicted, n), most frequent first."""
    n = df.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    wrong = F.col(actual) != F.col(predicted)
    listed = F.array_sort(F.collect_list(F.when(wrong, F.struct((-F.col("n")).alias("m"), F.col(predicted).alias("p")))))
    total = n.groupBy(actual).agg(F.sum(F.when(~wrong, F.col("n")).otherwise(0)).alias("correct"), F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("wrong"), listed.alias("_l"))
    return total.select(actual, "correct", "wrong", F.transform("_l", lambda s: F.struct(s["p"].alias("predicted"), (-s["m"]).alias("n"))).alias("confused_with"))


def anchor_report(best: DataFrame, names: DataFrame, feature: str, name: str, size: str, n: int) -> DataFrame:
    """Each anchor feature with the n largest names of its cluster, in order. names: (feature, name, size)."""
    rn = F.row_number().over(Window.partitionBy(feature).orderBy(F.desc(size), name))
    top = names.withColumn("_rn", rn).where(F.col("_rn") <= n).groupBy(feature).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", name))), lambda s: s[name]).alias("examples"))
    return best.join(top, feature, "left")
