"""Diversity features and feature matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialized
from .ordering import placed, sent

#: Rows of a block of known rows, and of unknown ones, in the nearest-neighbour search.
KNOWN_BLOCK, UNKNOWN_BLOCK = 4096, 512
#: Items of an owner that one task lists; components of vectors that one task holds; items that share a copy of a block of vectors.
LISTED, COMPONENTS, CELL = 256, 1 << 23, 1 << 23


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """a zero norm counts as 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot / (one(norm(a)) * one(norm(b)))


def _added(d: int):
    """Sums of unit vectors. The rows of a cell come together, its vectors (no ``counts``) first: of each list of keys the sum of their vectors by their counts,
    as its square or, where the list is a piece of a group, as it is."""

    def matrix(vectors: pa.Array) -> np.ndarray:
        """Unit vectors, 0 where a component is missing; with a missing component they are 0 throughout."""
        n, flat = vectors.value_lengths().to_numpy(), vectors.flatten()
        lost = np.unique(np.repeat(np.arange(len(n)), n)[flat.is_null().to_numpy(zero_copy_only=False)])
        x = np.zeros((len(n), d))
        x[np.arange(d) < n[:, None]] = flat.to_numpy(zero_copy_only=False)
        x[lost] = 0
        with np.errstate(invalid="ignore", over="ignore"):
            length = np.zeros(len(x))
            for i in range(d):
                length += x[:, i] ** 2
            length = np.sqrt(length)
            return x / np.where(length == 0, 1.0, length)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, known, arrived, names = None, None, [], []
        for batch in batches:
            cells, isvec = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (isvec[1:] != isvec[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(cells)]) if len(cells) else ():
                part = batch.slice(lo, hi - lo)
                keys = part.column(2).flatten().to_numpy(zero_copy_only=False)
                if cells[lo] != cell:
                    cell, known, arrived = cells[lo], None, []
                if isvec[lo]:
                    arrived.append((keys, matrix(part.column(4))))
                    continue
                if known is None:
                    # A key with several vectors stands for their sum.
                    names, at = np.unique(np.concatenate([k for k, _ in arrived]), return_inverse=True)
                    known = np.zeros((len(names), d))
                    np.add.at(known, at, np.concatenate([x for _, x in arrived]))
                    arrived = []
                n = part.column(2).value_lengths().to_numpy()
                with np.errstate(invalid="ignore", over="ignore"):
                    each = known[np.searchsorted(names, keys)] * part.column(3).flatten().to_numpy()[:, None]
                    total = np.add.reduceat(each, np.concatenate([[0], np.cumsum(n)[:-1]]), 0)
                    square = (total * total).sum(1)
                piece = part.column(5)
                sums = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * d, pa.int32()), pa.array(total.ravel()))
                sums = pc.if_else(piece, sums, pa.scalar(None, sums.type)) if pc.any(piece).as_py() else pa.nulls(len(n), sums.type)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(6, 11)), pa.array(square), sums], ["_o", "_g", "k", "_nz", "_bad", "_sq", "_sum"])

    return run


def diversity(items: DataFrame, vectors: DataFrame, owner: str, key: str, cluster: str, vector: str, listed: int = LISTED, block: int = COMPONENTS, per_cell: int = CELL) -> DataFrame:
    """M1: ln(1 + k (1 - mean pairwise cosine)) of an owner's k items of a cluster; ln 2 for one item.

    With unit vectors u the mean over pairs is (|sum u|^2 - #nonzero) / (k (k - 1)), so there is no self-join. Vectors are not joined to items: an
    owner's keys of a cluster are listed, and lists of more than one key meet the vectors of their cluster, of which each task holds a block of at most
    ``block`` components; a block is copied once for about ``per_cell`` items. Groups of one key need no vector. The keys of owners of more than ``listed``
    items, and of clusters of more than one block, are listed in pieces, whose sums are added up by dimension, so no buffer grows with a group. Vectors
    of fewer dimensions than the longest have 0 there.
    """
    d, n = vectors.agg(F.max(F.size(vector)), F.count("*")).first()
    d = max(d or 0, 1)
    # The length is bound once for each vector, not found again for each component.
    bound = lambda f: F.transform(F.array(norm(F.col(vector))), f)[0]
    square = bound(lambda n: F.aggregate(F.transform(vector, lambda x: F.coalesce(x.cast("double") / F.when(n == 0, 1.0).otherwise(n), F.lit(0.0))), F.lit(0.0), lambda t, x: t + x * x))
    own = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(cluster).alias("_g"), F.col(vector).alias("_v"), (norm(F.col(vector)) > 0).cast("long").alias("_z"), square.alias("_s"))
    sizes = items.groupBy(owner).agg(F.count("*").alias("_n"))
    large = materialized(sizes.where(F.col("_n") > listed).select(F.col(owner).alias("_o"), "_n"))
    n_items, rows_of_block = items.count(), max(1, block // d)
    # Each cluster's blocks, and copies of them.
    dealt = placed(own.groupBy("_g").agg(F.count("*").alias("_m")), [F.col("_g").asc_nulls_first()], "_no")
    copies = F.least(F.ceil(F.col("_m") / F.lit(max(n, 1)) * F.lit(n_items) / F.ceil(F.col("_m") / rows_of_block) / per_cell), F.lit(1 << 14))
    dealt = materialized(dealt.select(F.col("_g").alias("_gg"), "_no", F.ceil(F.col("_m") / rows_of_block).alias("_blocks"), F.greatest(copies, F.lit(1)).alias("_copies")))
    own = own.join(sent(dealt), F.col("_g").eqNullSafe(F.col("_gg"))).withColumn("_cell", F.col("_no") * (1 << 28) + F.pmod(F.xxhash64("_k"), "_blocks") * (1 << 14)).drop("_gg", "_no")
    split = F.col("_blocks") > 1
    known = own.groupBy("_k", "_g", "_cell", "_copies", split.alias("_split")).agg(F.count("*").alias("_m"), F.sum("_z").alias("_z"), F.max(F.col("_v").isNull()).alias("_bad"), F.sum("_s").alias("_s"))
    known = materialized(known)
    rows = items.select(F.col(owner).alias("_o"), F.col(key).alias("_ik")).join(sent(known), F.col("_ik") == F.col("_k")).drop("_ik")
    has_large, has_split = (df.limit(1).count() > 0 for df in (large, known.where("_split")))
    marks = sent(large) if has_large else None
    whole = rows.join(marks.select(F.col("_o").alias("_lo")), F.col("_o").eqNullSafe(F.col("_lo")), "left_anti") if has_large else rows
    totals = lambda c: [F.sum(c * F.col("_m")).alias("k"), F.sum(c * F.col("_z")).alias("_nz"), F.max("_bad").alias("_bad")]
    one = F.lit(1).cast("long")
    # What is of one key, or the same for all keys, comes as one value, so that both uses of the lists are one shuffle.
    most = F.max(F.struct("_bad", "_m", "_s", "_cell", "_copies")).alias("_t")
    lists = whole.where(~F.col("_split")).groupBy("_o", "_g").agg(*totals(one)[:2], most, F.collect_list("_k").alias("_keys")).select("_o", "_g", "k", "_nz", "_keys", "_t.*")
    same = (F.size(F.array_distinct("_keys")) == 1) & (F.col("_m") == 1)
    # Of one key the square is known.
    lists = lists.withColumn("_sq", F.col("_s") * F.size("_keys") * F.size("_keys"))
    single = lists.where(same).select("_o", "_g", "k", "_nz", "_bad", "_sq")
    columns = ["_cell", "_copies", "_keys", "_counts", "_piece", "_o", "_g", "k", "_nz", "_bad"]
    many = lists.where(~same).withColumn("_counts", F.array_repeat(one, F.size("_keys"))).withColumn("_piece", F.lit(False)).select(*columns, "_sq")
    if has_large or has_split:
        counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_c"))
        if has_large:
            counted = counted.join(marks.select(F.col("_o").alias("_lo"), "_n"), F.col("_o").eqNullSafe(F.col("_lo")), "left").where(F.col("_n").isNotNull() | F.col("_split"))
            counted = counted.withColumn("_chunk", F.pmod(F.xxhash64("_k"), F.coalesce(F.ceil(F.col("_n") / listed), one)))
        else:
            counted = counted.where("_split").withColumn("_chunk", one)
        pieces = counted.groupBy("_o", "_g", "_cell", "_copies", "_chunk").agg(*totals(F.col("_c")), F.collect_list("_k").alias("_keys"), F.collect_list("_c").alias("_counts"))
        many = many.unionByName(pieces.withColumn("_piece", F.lit(True)).withColumn("_sq", F.lit(0.0)).select(*columns, "_sq"))
    null = lambda t: F.lit(None).cast(t)
    asked = many.select((F.col("_cell") + F.pmod(F.xxhash64("_keys"), "_copies")).alias("_cell"), F.lit(False).alias("_isvec"), "_keys", "_counts", null(vectors.schema[vector].dataType).alias("_v"), "_piece", "_o", "_g", "k", "_nz", "_bad", "_sq")
    held = own.select(F.explode(F.sequence(F.col("_cell"), F.col("_cell") + F.col("_copies") - 1)).alias("_cell"), F.lit(True).alias("_isvec"), F.array("_k").alias("_keys"), null("array<bigint>").alias("_counts"), F.coalesce("_v", F.array().cast(vectors.schema[vector].dataType)).alias("_v"), *(null(asked.schema[c].dataType).alias(c) for c in asked.columns[5:]))
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = asked.union(held).repartition(parts, "_cell").sortWithinPartitions("_cell", F.desc("_isvec"))
    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in ("_o", "_g", "k", "_nz", "_bad"))
    found = met.mapInArrow(_added(d), f"{kinds}, _sq double, _sum array<double>")
    out = single.unionByName(found.where("_sum IS NULL").drop("_sum"))
    if has_large or has_split:
        found = materialized(found)
        out = single.unionByName(found.where("_sum IS NULL").drop("_sum"))
        sums = found.where("_sum IS NOT NULL").groupBy("_o", "_g").agg(F.sum("k").alias("k"), F.sum("_nz").alias("_nz"), F.max("_bad").alias("_bad"), *(F.sum(F.get("_sum", F.lit(i))).alias(f"_s{i}") for i in range(d)))
        square = F.aggregate(F.array(*(f"_s{i}" for i in range(d))), F.lit(0.0), lambda t, x: t + x * x)
        out = out.unionByName(sums.select("_o", "_g", "k", "_nz", "_bad", square.alias("_sq")))
    mean = (F.when(~F.col("_bad"), F.col("_sq")) - F.col("_nz")) / (F.col("k") * (F.col("k") - 1))
    return out.select(F.col("_o").alias(owner), F.col("_g").alias(cluster), "k", F.when(F.col("k") == 1, F.log(F.lit(2.0))).otherwise(F.log1p(F.col("k") * (1 - mean))).alias("diversity"))


def feature_matrix(features: DataFrame, owner: str, cluster: str, value: str, clusters: list) -> DataFrame:
    """M2: one column for each cluster of a fixed list, 0 where absent."""
    return features.groupBy(owner).agg(*(F.coalesce(F.max(F.when(F.col(cluster) == c, F.col(value))), F.lit(0.0)).alias(f"f_{c}") for c in clusters))


def dummies(column: Column, values: list, prefix: str) -> list[Column]:
    """F42."""
    return [F.coalesce((column == v).cast("double"), F.lit(0.0)).alias(f"{prefix}{i}") for i, v in enumerate(values)]


def design(rows: DataFrame, owner: str, matrices: list[DataFrame], duties: DataFrame | None = None, clusters: str = "clusters", kept: list = ()) -> DataFrame:
    """M2: the owners of ``rows`` with their columns, those of each matrix (0 where it has no such owner), and a 0/1 column ``resp_`` for each kept
    cluster of the owner's set."""
    out = rows
    for m in matrices:
        out = out.join(m, owner, "left").fillna(0.0, [c for c in m.columns if c != owner])
    if duties is not None:
        out = out.join(duties.select(owner, clusters), owner, "left")
        out = out.withColumns({f"resp_{c}": F.coalesce(F.array_contains(clusters, c).cast("double"), F.lit(0.0)) for c in kept}).drop(clusters)
    return out


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with the population deviation; no variance divides by 1. The moments are one aggregated row."""
    moments = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns)).first()
    z = {c: (F.col(c) - F.lit(moments[f"_m_{c}"])) / F.lit(moments[f"_s_{c}"] or 1.0) for c in columns}
    return df.withColumns(z)


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _block_nearest(k: int):
    """Of each unknown row of a block its k nearest known rows of another: distances sum the dimensions in order, ties go to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unknown, known in zip(batch.column(0), batch.column(1)):
                (keys, q), (ids, x) = ((s.values.field(0), s.values.field(1)) for s in (unknown, known))
                values = known.values.field(2).to_numpy(zero_copy_only=False)
                q, x = (np.array(v.flatten()).reshape(len(v), -1) for v in (q, x))
                # Rows by ascending id, so that a stable sort by distance leaves ties in order.
                order = np.array(pc.sort_indices(ids))
                x, values, ids = x[order], values[order], ids.take(pa.array(order))
                with np.errstate(invalid="ignore", over="ignore"):
                    # One matrix product bounds all distances; those that can be among the nearest are computed again, exactly.
                    qq, xx = (q * q).sum(1), (x * x).sum(1)
                    near = qq[:, None] + xx[None, :] - 2 * (q @ x.T)
                    slack = 1e-10 * (qq + xx.max(initial=0))
                    best, d = [], []
                    for row, vector, s in zip(near, q, slack):
                        at = np.arange(len(x))
                        if len(x) > k:
                            at = np.flatnonzero(~(row > np.partition(row, k - 1)[k - 1] + 2 * s))
                        exact = np.zeros(len(at))
                        for i in range(q.shape[1]):
                            exact += (x[at, i] - vector[i]) ** 2
                        exact[np.isnan(exact)] = np.inf
                        first = np.argsort(exact, kind="stable")[:k]
                        best.append(at[first])
                        d.append(exact[first])
                n, at = [len(v) for v in best], np.concatenate(best)
                near = pa.StructArray.from_arrays([pa.array(np.concatenate(d)), ids.take(pa.array(at)), pa.array(values[at], pa.float64(), from_pandas=True)], ["_d", "_id", "_y"])
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), near)], ["_key", "near"])

    return run


def knn_impute(unknown: DataFrame, known: DataFrame, key: str, vector: str, value: str, k: int = 10, floor: float = 0.5, block: int = KNOWN_BLOCK, query_block: int = UNKNOWN_BLOCK) -> DataFrame:
    """Mean value of the k nearest known rows (squared Euclidean distance; ties to the smaller id), at least ``floor``.

    Exact, whatever the number of rows: blocks of unknown rows meet blocks of known rows, each pair of blocks returns k rows for an unknown one, and
    these are merged. Rows with a null vector, a null component or a null key play no part; vectors are of one length. A null value counts as one of
    the nearest, but not in the mean.
    """
    kind = known.schema[key].dataType.simpleString()
    usable = lambda df: df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(F.col(vector), lambda c: c.isNotNull()))
    v = F.col(vector).cast("array<double>").alias("_v")
    right = usable(known).select(F.col(key).alias("_id"), v, F.col(value).cast("double").alias("_y"))
    left = usable(unknown).select(F.col(key).cast(kind).alias("_key"), v)
    n_left, n_right = (max(1, -(-df.count() // size)) for df, size in ((left, query_block), (right, block)))
    # Rows of the same key are dealt by their vector too.
    left = left.groupBy(F.pmod(F.xxhash64("_key", "_v"), F.lit(n_left)).alias("i")).agg(F.collect_list(F.struct("_key", "_v")).alias("unknown"))
    right = right.groupBy(F.pmod(F.xxhash64("_id", "_v"), F.lit(n_right)).alias("j")).agg(F.collect_list(F.struct("_id", "_v", "_y")).alias("known"))
    pairs = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))).select("unknown", F.col("j").cast("long").alias("j"), "i")
    met = pairs.join(right, "j").select("unknown", "known")
    found = met.mapInArrow(_block_nearest(k), f"_key {kind}, near array<struct<_d: double, _id: {kind}, _y: double>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    merged = found.groupBy("_key").agg(best.alias("near"))
    values = F.filter(F.transform("near", lambda s: s["_y"]), lambda y: y.isNotNull())
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, y: a + y) / F.size(values))
    return merged.select(F.col("_key").alias(key), F.greatest(mean, F.lit(floor)).alias("imputed"))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group, by dimension."""
    each = df.select(group, F.posexplode(vector).alias("_i", "_x")).groupBy(group, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))


def nearest_centroid(df: DataFrame, centers: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """Group of the nearest centroid of each row (ties: smaller group). The centroids, one for each group of a bounded dimension, are one row, so
    rows are neither multiplied nor shuffled. Null without centroids or a vector."""
    all_ = centers.groupBy().agg(F.collect_list(F.struct("centroid", F.col(group).alias("g"))).alias("_all"))
    best = F.array_min(F.transform("_all", lambda c: F.struct(distance2(F.col(vector), c["centroid"]).alias("d"), c["g"].alias("nearest"))))
    return df.select(key, vector).join(F.broadcast(all_), F.lit(True)).select(key, best["nearest"].alias("nearest"))


def oversample(df: DataFrame, group: str, key: str) -> DataFrame:
    """M11, repeatable: each group grows to the size of the largest, by whole copies and then the first rows by hash."""
    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n")).first()[0] or 0
    sized = placed(df.where(F.col(group).isNotNull()), [F.xxhash64(key), F.col(key)], "_rn", [group], 1).join(counts, group)
    copies = (F.floor(F.lit(most) / F.col("_n")) + (F.col("_rn") <= F.lit(most) % F.col("_n")).cast("int")).cast("int")
    return sized.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_n", "_rn", "_copy")
