"""Merging, queues and incremental scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order. Null keys group together."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """K1: rows of ``new`` whose key is not in ``old``, first of each key, added to ``old``."""
    return old.unionByName(keep_first(new, keys, order).join(old.select(*keys).distinct(), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """K3: whole-row replacement by key (nulls of ``new`` overwrite), but for the columns to keep, which stay as in ``old`` where the key is known.
    A null key equals a null key."""
    o, n = old.withColumn("_o", F.lit(True)), new.withColumn("_n", F.lit(True))
    joined = o.alias("o").join(n.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in keys else F.when(F.col("n._n") & ~(F.coalesce(F.col("o._o"), F.lit(False)) if c in keep else F.lit(False)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return joined.select(*cols)


def patch(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """K2, K4: non-null values of ``new`` replace those of ``old``; rows are neither added nor lost."""
    n = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return old.join(n, keys, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns))


def keep_raw(df: DataFrame, raw: str, current: str) -> DataFrame:
    """K6."""
    return df.withColumn(raw, F.coalesce(raw, current))


def missing_required(df: DataFrame, columns: list[str]) -> DataFrame:
    """K8: rows that lack a required value, with the names of what they lack."""
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)))
    return df.withColumn("lacking", lacking).where(F.size("lacking") > 0)


def dequeue(queue: DataFrame, n: int, status: Column, order: str, per: str | None = None) -> DataFrame:
    """The first n rows in waiting, of each value of ``per`` if given."""
    waiting = queue.where(status)
    if per is None:
        return waiting.orderBy(order).limit(n)
    return waiting.withColumn("_rn", F.row_number().over(Window.partitionBy(per).orderBy(order))).where(F.col("_rn") <= n).drop("_rn")


def not_done(df: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Rows without a result so far; all with force."""
    return df if force else df.join(done.select(*keys).distinct(), keys, "left_anti")


def matching(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """All conditions given."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def random_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """S14, repeatable: the first n by hash of the key."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def scan(df: DataFrame, order: str, *conditions: Column | None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows that meet all conditions, in order, from an offset and at most so many."""
    found = matching(df, *conditions).orderBy(order)
    found = found.offset(offset) if offset else found
    return found if limit is None else found.limit(limit)


def pay_scan(df: DataFrame, low: str, high: str, skills: str) -> DataFrame:
    """Rows with a bound of pay and skills."""
    return df.where((F.col(low).isNotNull() | F.col(high).isNotNull()) & F.col(skills).isNotNull())


def grade_scan(df: DataFrame, grade: str, skills: str) -> DataFrame:
    """Rows with a grade and at least one skill."""
    return df.where((F.coalesce(grade, F.lit("")) != "") & (F.coalesce(F.size(skills), F.lit(0)) > 0))


def feed_scan(df: DataFrame, order: str, time: str, cutoff: Column, before: int | None = None, size: int | None = None) -> DataFrame:
    """Messages from newest to oldest, up to the first that is older than the cutoff. before: only those of smaller number (the next page's
    place); size: at most so many. The stop is one aggregated row, so no task reads the feed in order."""
    page = df if before is None else df.where(F.col(order) < before)
    stop = page.where(F.col(time) < cutoff).agg(F.max(order).alias("_stop"))
    found = page.join(F.broadcast(stop), F.lit(True)).where(F.col("_stop").isNull() | (F.col(order) > F.col("_stop"))).drop("_stop")
    return found if size is None else found.orderBy(F.desc(order)).limit(size)


def write_back(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """K5: columns of ``old`` take the values of ``new``, nulls too, where the key is in ``new`` (each key once); other rows stay."""
    n = new.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    joined = old.join(n, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns))


def set_status(queue: DataFrame, updates: DataFrame, key: str, now: Column) -> DataFrame:
    """Status and error of the updated keys, with the time of the update; other rows stay."""
    u = updates.select(key, F.col("status").alias("_status"), F.col("error").alias("_error"), F.lit(True).alias("_hit"))
    hit = lambda new, old: F.when(F.col("_hit"), new).otherwise(F.col(old)).alias(old)
    new = {"status": hit(F.col("_status"), "status"), "error": hit(F.col("_error"), "error"), "updated_at": hit(now, "updated_at")}
    return queue.join(u, key, "left").select(*(new.get(c, F.col(c)) for c in queue.columns))


def reflagged(df: DataFrame, flag: str, reasons: str, found: Column, force: bool = False) -> DataFrame:
    """P10: flags and reasons from the reasons found now; those of before count too, unless forced anew."""
    kept = F.lit(None).cast("string") if force else F.col(reasons)
    both = F.array_distinct(F.filter(F.split(F.concat_ws("; ", kept, found), "; "), lambda x: x != ""))
    text = F.nullif(F.array_join(both, "; "), F.lit(""))
    return df.withColumns({reasons: text, flag: text.isNotNull()})


def min_years(grade: Column, raw: Column, zero_for: str = "Intern") -> Column:
    """Years from text or number; one grade has 0, whatever it says; null where unknown."""
    return F.when(grade == zero_for, 0.0).otherwise(raw.try_cast("double"))


def merge_dictionaries(first: DataFrame, second: DataFrame, key: str, new_wins: bool = True) -> DataFrame:
    """Union by key; of equal keys the second's row (or the first's) stays."""
    base, extra = (second, first) if new_wins else (first, second)
    return base.unionByName(extra.join(base.select(key), key, "left_anti"))


def changes(df: DataFrame, before: str, after: str) -> DataFrame:
    """Number of rows by what cleaning did."""
    kind = F.when(F.col(after).isNull(), "empty").when(F.col(after).eqNullSafe(F.col(before)), "unchanged").otherwise("changed")
    return df.groupBy(kind.alias("change")).agg(F.count("*").alias("n"))
