"""Names: aliases, compounds, clusters, frequencies, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized
from .ordering import placed, sent

#: Names of an owner whose pairs one task makes.
PAIRED = 1000


def name_key(c: Column) -> Column:
    """Lower case, without outer blanks and dots."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"^\.+|\.+$", ""))


def normalize(df: DataFrame, column: str, aliases: DataFrame, prefixes: dict[str, str] = {}) -> DataFrame:
    """Canonical name by alias (key, canonical), else by prefix of the key, else as it is, trimmed; empty is null. Of several canonical names
    of one key the smallest counts."""
    known = aliases.groupBy(name_key(F.col("key")).alias("_key")).agg(F.min("canonical").alias("canonical"))
    out = F.col("canonical")
    for prefix, name in prefixes.items():
        out = F.coalesce(out, F.when(F.col("_key").startswith(prefix), F.lit(name)))
    out = F.nullif(F.coalesce(out, F.trim(column)), F.lit(""))
    return df.withColumn("_key", name_key(F.col(column))).join(known, "_key", "left").withColumn(column, out).drop("_key", "canonical")


def capitalized(c: Column) -> Column:
    """F16: only the first letter changes."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, (1 << 31) - 1))


#: Words between the parts of a compound, which are no parts.
CONNECTORS = ["and", "&", ",", "/"]


def split_compounds(df: DataFrame, column: str, known: DataFrame, aliases: DataFrame | None = None, protected: list[str] = (), slash: str = "/", least: int = 2, most_words: int = 4, prefixes: dict[str, str] = {}) -> DataFrame:
    """a name with slashes (and not protected) of which at least ``least`` parts are known gives a row for each part, unknown ones too; else a
    name of at most ``most_words`` words does so for its words without connectors; others stay. A part is known if it or its canonical name is in
    ``known(name)``, in whatever case. Both tables may be of any size: parts are looked up by joins. Null names stay."""
    # Names are settled once each, however many rows have them.
    n = F.col("_name")
    words = F.filter(F.split(F.trim(n), r"\s+"), lambda p: p != "")
    slashed = F.filter(F.transform(F.split(n, slash), lambda p: F.trim(p)), lambda p: p != "")
    slashed = F.when(n.contains(slash) & ~F.lower(n).isin(list(protected) or [""]) & (F.size(slashed) > 1), slashed)
    parts = F.filter(words, lambda p: ~F.lower(p).isin(CONNECTORS))
    parts = F.when(F.trim(n).contains(" ") & (F.size(words) <= most_words) & (F.size(parts) > 1), parts)
    both = df.select(F.col(column).alias("_name")).where("_name IS NOT NULL").distinct().withColumns({"_slashed": slashed, "_worded": parts}).where("_slashed IS NOT NULL OR _worded IS NOT NULL")
    ways = F.array(F.struct(F.lit(0).alias("way"), F.col("_slashed").alias("parts")), F.struct(F.lit(1).alias("way"), F.col("_worded").alias("parts")))
    each = both.select("_name", F.explode(ways).alias("_w")).select("_name", F.col("_w.way").alias("_way"), F.posexplode("_w.parts").alias("_i", "_p"))
    each = each.withColumn("_canonical", F.col("_p"))
    if aliases is not None:
        each = normalize(each, "_canonical", aliases, prefixes)
    names = known.select(F.lower("name").alias("_k")).distinct()
    asked = each.select("_name", "_way", "_i", F.explode(F.array_distinct(F.array(F.lower("_p"), F.lower("_canonical")))).alias("_k"))
    hits = asked.join(names, "_k", "left_semi").select("_name", "_way", "_i").distinct().groupBy("_name", "_way").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    best = hits.groupBy("_name").agg(F.min("_way").alias("_way"))
    settled = both.join(best, "_name").select("_name", F.when(F.col("_way") == 0, F.col("_slashed")).otherwise(F.col("_worded")).alias("_parts"))
    joined = df.join(settled, F.col(column) == F.col("_name"), "left")
    return joined.withColumn(column, F.explode(F.coalesce("_parts", F.array(column)))).drop("_name", "_parts")


def prepare(items: DataFrame, owner: str, position: str, name: str, aliases: DataFrame, known: DataFrame, protected: list[str] = (), prefixes: dict[str, str] = {}, existing: DataFrame | None = None, priority: str | None = None, least: int = 2) -> DataFrame:
    """Normalise, split, normalise again, keep names of more than one character, of an owner's names that differ in case only the
    first; then only names that occur ``least`` times, those of ``existing(name)`` counted too. Columns beside stay with each part; a null priority
    is 'required'."""
    # Each different name is settled once; the rows meet the result in one join.
    names = items.select(F.col(name).alias("_from")).where("_from IS NOT NULL").distinct().withColumn("_to", F.col("_from"))
    first = normalize(names, "_to", aliases, prefixes).where("_to IS NOT NULL")
    parts = split_compounds(first, "_to", known, aliases, protected, prefixes=prefixes)
    settled = normalize(parts, "_to", aliases, prefixes).where(F.length("_to") > 1)
    again = items.join(settled, F.col(name) == F.col("_from")).withColumn(name, F.col("_to")).drop("_from", "_to")
    if priority:
        again = again.withColumn(priority, F.coalesce(priority, F.lit("required")))
    unique = keep_first_name(again, owner, name, position)
    counts = frequencies(*([unique] if existing is None else [unique, existing]), name=name)
    return drop_singletons(unique, name, counts, least)


def keep_first_name(items: DataFrame, owner: str, name: str, position: str) -> DataFrame:
    """W5 in a total order: the first by position, of parts of one place the first by name."""
    rn = F.row_number().over(Window.partitionBy(owner, F.lower(name)).orderBy(position, name))
    return items.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def with_catch_all(c: Column, label: str) -> Column:
    """empty names get one label."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(label))


def partial_alias(df: DataFrame, column: str, aliases: list[tuple[str, str]]) -> DataFrame:
    """The canonical name of the longest alias that the name contains (ties by alias), else the name. A short list of (alias, canonical)."""
    out = F.col(column)
    for alias, name in sorted(sorted(aliases, reverse=True), key=lambda a: len(a[0])):
        out = F.when(F.lower(column).contains(alias.lower()), F.lit(name)).otherwise(out)
    return df.withColumn(column, out)


def pair_clusters(pairs: DataFrame, raw: list[str], normal: list[str], count: str) -> DataFrame:
    """The normalised pairs numbered from 0 by the largest count of a raw pair of theirs, ties by the raw pair; with that count and the total."""
    first = pairs.groupBy(*normal).agg(F.max(count).alias("_max"), F.sum(count).alias("total"), F.min(F.struct((-F.col(count)).alias("n"), *raw)).alias("_first"))
    return ranked(first, [F.col("_first")], "cluster").select(*normal, "cluster", "total", F.col("_max").alias("largest"), *(F.col("_first")[c].alias(f"top_{c}") for c in raw))


def owner_sets(items: DataFrame, owner: str, cluster: str) -> DataFrame:
    """The sorted set of each owner's clusters."""
    return items.groupBy(owner).agg(F.sort_array(F.collect_set(cluster)).alias("clusters"))


def pair_counts(items: DataFrame, first: str, second: str) -> DataFrame:
    """A10: counts of first names, second names and pairs at once; level says which. Null or empty first names are no records, nor are empty second
    names counted for themselves."""
    clean = items.select(F.trim(first).alias(first), F.trim(F.coalesce(second, F.lit(""))).alias(second)).where(f"`{first}` <> ''")
    g = clean.groupingSets([[first], [second], [first, second]], first, second).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 1, first).when(F.col("_g") == 2, second).otherwise("pair")
    return g.select(level.alias("level"), first, second, "n").where(~((F.col("level") == second) & (F.col(second) == "")))


def assign_clusters(items: DataFrame, clusters: DataFrame, owner: str, name: str, position: str, cluster: str = "cluster_id") -> DataFrame:
    """Owner and its distinct clusters in order of first appearance; owners without any get an empty array."""
    hit = items.join(clusters.select(name, cluster).where(F.col(cluster).isNotNull()), name, "left")
    first = hit.groupBy(owner, cluster).agg(F.min(position).alias("_pos"))
    listed = F.array_sort(F.collect_list(F.when(F.col(cluster).isNotNull(), F.struct("_pos", cluster))))
    return first.groupBy(owner).agg(F.transform(listed, lambda x: x[cluster]).alias("clusters"))


def unmapped(items: DataFrame, clusters: DataFrame, name: str, n: int = 10) -> DataFrame:
    """The n most frequent names without a cluster; ties by name."""
    return items.join(clusters.select(name).distinct(), name, "left_anti").groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(n)


def cooccurrence(items: DataFrame, owner: str, name: str, n: int = 10) -> DataFrame:
    """Of each name the n other names most often with it in one owner. An owner's names are first counted, so its repeats are not paired;
    the pair counts are partially summed before they are dealt out. An owner of m different names makes m * m pairs, which is what is asked for; beyond
    ``PAIRED`` names it is dealt to several tasks, by the first name of the pair."""
    counted = items.groupBy(owner, name).agg(F.count("*").alias("c"))
    # Owners of many names are fewer than the names by that number.
    many = materialized(counted.groupBy(owner).agg(F.count("*").alias("_m")).where(F.col("_m") > PAIRED).select(owner, F.ceil(F.col("_m") / PAIRED).cast("int").alias("_tasks")))
    dealt = counted.join(sent(many), owner, "left").withColumn("_tasks", F.coalesce("_tasks", F.lit(1)))
    left = dealt.select(F.col(owner).alias("_o"), F.col(name).alias("_a"), F.expr(f"pmod(xxhash64(`{name}`), _tasks)").cast("int").alias("_t"))
    right = dealt.select(F.col(owner).alias("_p"), F.col(name).alias("other"), "c", F.explode(F.expr("sequence(0, _tasks - 1)")).alias("_u"))
    pairs = left.join(right, (F.col("_o") == F.col("_p")) & (F.col("_t") == F.col("_u"))).where("_a <> other")
    sums = pairs.groupBy(F.col("_a").alias(name), "other").agg(F.sum("c").alias("n"))
    rn = F.row_number().over(Window.partitionBy(name).orderBy(F.desc("n"), "other"))
    return sums.withColumn("rank", rn.cast("long")).where(F.col("rank") <= n)


def frequencies(*frames: DataFrame, name: str) -> DataFrame:
    """A4, A5, U4: occurrences of each name over all frames."""
    total = frames[0].select(name)
    for f in frames[1:]:
        total = total.unionAll(f.select(name))
    return total.groupBy(name).agg(F.count("*").alias("n"))


def drop_singletons(items: DataFrame, name: str, counts: DataFrame, least: int = 2) -> DataFrame:
    """Items whose name occurs often enough."""
    return items.join(counts.where(F.col("n") >= least).select(name), name, "left_semi")


def first_spelling(items: DataFrame, owner: str, name: str, position: str) -> DataFrame:
    """Of names of an owner that differ in case only, the first."""
    rn = F.row_number().over(Window.partitionBy(owner, F.lower(name)).orderBy(position))
    return items.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def ranked(df: DataFrame, order: list[Column], column: str, start: int = 0) -> DataFrame:
    """Dense numbers in a total order, of any number of rows."""
    return placed(df, order, column, start=start)


def named_by_size(sizes: DataFrame, names: list[str], size: str, tie: str, other: str = "Other") -> DataFrame:
    """The i-th largest gets the i-th name, the rest one name."""
    r = ranked(sizes, [F.desc(size), F.col(tie)], "rank")
    return r.withColumn("label", F.coalesce(F.get(F.array(*(F.lit(n) for n in names)), F.col("rank").cast("int")), F.lit(other)))


def onehot(items: DataFrame, owner: str, name: str, values: list) -> DataFrame:
    """0/1 columns, one for each value; the list bounds the width."""
    return items.groupBy(owner).agg(*(F.max((F.col(name) == v).cast("long")).alias(f"has_{v}") for v in values)).fillna(0)
