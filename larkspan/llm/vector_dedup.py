"""Near duplicates of vectors by int8 tile products with quantisation error bounds.

Equal vectors of a group form a class at once, one member stands for it. Classes of a group are dealt into blocks, and each pair of blocks is one
piece of work. Unit vectors are quantised to int8, each with its own scale, and the length of its quantisation error is known. So the product of
two codes tells the cosine up to a proven error, and only pairs that may reach the threshold are computed again, in double precision. A
pair of blocks returns a row for each linked class: the number of its links, and one other class of its tree. So links are never written
down one by one, however many a group of near copies has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import HELD_IDS, by_class, light, mapped, materialize, shuffle_partitions
from .minhash import components

#: Classes of a block, and rows and columns of one tile.
BLOCK, TILE = 16384, 1024
#: Dimensions that single precision adds up exactly in products of int8 codes.
EXACT = (1 << 24) // (127 * 127)
#: Pairs computed again at once.
PAIRS = 1 << 15


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are scaled by a power of two first, so that no finite number over- or underflows."""
    _, power = np.frexp(np.abs(v).max(1))
    v = np.ldexp(v, -power[:, None])
    return v / np.sqrt((v * v).sum(1))[:, None]


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and a bound of the length of each row's error."""
    scale = np.abs(u).max(1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((u - codes * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-12


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 codes, exact: single precision holds the sums over ``EXACT`` dimensions."""
    total = np.zeros((len(a), len(b)))
    for lo in range(0, a.shape[1], EXACT):
        total += a[:, lo : lo + EXACT].astype(np.float32) @ b[:, lo : lo + EXACT].astype(np.float32).T
    return total


class Side:
    """Vectors of a block, quantised."""

    def __init__(self, node: np.ndarray, rep: np.ndarray, copies: np.ndarray, v: np.ndarray) -> None:
        self.node, self.rep, self.copies, self.unit = node, rep, copies, units(v)
        self.codes, self.scale, self.error = quantised(self.unit)

    def links(self, other: Side, lo: int, hi: int, x: int, y: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of self in lo..hi, row of other in x..y) with a cosine of the threshold or more."""
        near = code_products(self.codes[lo:hi], other.codes[x:y]) * self.scale[lo:hi, None] * other.scale[None, x:y]
        # |u.v - c.d| <= |u - c| |v| + |c| |v - d|, with |v| = 1 and |c| <= 1 + |u - c|.
        e, f = self.error[lo:hi, None], other.error[None, x:y]
        near += e + f + e * f + 1e-12
        a, b = np.nonzero(near >= threshold)
        if len(a) * 8 > near.size:
            cosine = self.unit[lo:hi] @ other.unit[x:y].T
            ok = cosine[a, b] >= threshold
        else:
            ok = np.zeros(len(a), bool)
            for i in range(0, len(a), PAIRS):
                s = slice(i, i + PAIRS)
                ok[s] = np.einsum("ij,ij->i", self.unit[lo + a[s]], other.unit[x + b[s]]) >= threshold
        return lo + a[ok], x + b[ok]


def hook(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of the links (a, b); top holds the root of each node's tree, and does so again afterwards."""
    a, b = top[a], top[b]
    while (apart := a != b).any():
        a, b = a[apart], b[apart]
        least = np.minimum(a, b)
        np.minimum.at(top, a, least)
        np.minimum.at(top, b, least)
        while (top[top] != top).any():
            top[:] = top[top]
        a, b = top[a], top[b]


class Pair:
    """One pair of blocks. The first one is held, of the second a batch at a time."""

    def __init__(self, first: Side, threshold: float) -> None:
        self.first, self.threshold = first, threshold
        self.links, self.top = np.zeros(len(first.node), np.int64), np.arange(len(first.node))
        self.others: list[Side] = []

    def within(self) -> None:
        f, n = self.first, len(self.first.node)
        for lo in range(0, n, TILE):
            for x in range(lo, n, TILE):
                a, b = f.links(f, lo, min(lo + TILE, n), x, min(x + TILE, n), self.threshold)
                a, b = (a[a < b], b[a < b]) if lo == x else (a, b)
                self._add(a, b, f.copies[a], f.copies[b])

    def across(self, other: Side) -> None:
        at, n, m = len(self.top), len(self.first.node), len(other.node)
        self.top, self.links = np.append(self.top, np.arange(at, at + m)), np.append(self.links, np.zeros(m, np.int64))
        for lo in range(0, n, TILE):
            for x in range(0, m, TILE):
                a, b = self.first.links(other, lo, min(lo + TILE, n), x, min(x + TILE, m), self.threshold)
                self._add(a, at + b, self.first.copies[a], other.copies[b])
        self.others.append(other)

    def _add(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> None:
        if len(a):
            np.add.at(self.links, a, of_b)
            np.add.at(self.links, b, of_a)
            hook(self.top, a, b)

    def rows(self) -> pa.RecordBatch:
        node, rep = (np.concatenate([getattr(s, c) for s in (self.first, *self.others)]) for c in ("node", "rep"))
        at = np.flatnonzero(self.links)
        return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(self.links[at]), pa.array(rep[at]), pa.array(rep[self.top[at]])], ["node", "links", "a", "b"])


def _tiles(threshold: float):
    """Rows (grp, d, lo, hi, side, node, rep, copies, v) by pair of blocks, the first block's before the second's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, pair = None, [], None

        def began() -> Pair:
            return Pair(Side(*(np.concatenate(c) for c in zip(*held))), threshold)

        def ended() -> Iterator[pa.RecordBatch]:
            if held or pair is not None:
                last = pair or began()
                if now[2] == now[3]:
                    last.within()
                if last.links.any():
                    yield last.rows()

        for batch in batches:
            if not batch.num_rows:
                continue
            grp = batch.column(0)
            d, lo, hi, side, node, rep, copies = (batch.column(i).to_numpy() for i in range(1, 8))
            new = (np.diff(d) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0) | (np.diff(side) != 0)
            if batch.num_rows > 1:
                new |= pc.not_equal(grp.slice(1), grp.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(new) + 1), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                place = (grp[i].as_py(), int(d[i]), int(lo[i]), int(hi[i]))
                if place != now:
                    yield from ended()
                    now, held, pair = place, [], None
                part = batch.column(8).slice(i, j - i)
                rows = (node[i:j], rep[i:j], copies[i:j], np.asarray(part.flatten(), np.float64).reshape(j - i, -1))
                if side[i] == 0:
                    held.append(rows)
                elif held or pair is not None:
                    if pair is None:
                        pair, held = began(), []
                    pair.across(Side(*rows))
        yield from ended()

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """Links between vectors of one group whose cosine, in double precision, is the threshold (above 0) or more: a row for each vector with vec_id,
    n_links (other rows linked directly), component_id (smallest id reachable, itself included), kept (vec_id = component_id). Exact.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows without a group or an id (component_id
    null, kept). Vectors of different lengths don't link. Finite components of any size take part. Rows that repeat an id have a row and links
    each, and one component, as paths lead by ids. Equal vectors are linked. Empty table: empty result. Other columns are not read.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    spark = vectors.sparkSession
    all_rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(group_col).cast("string").alias("grp"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("grp").isNotNull() & F.col("v").isNotNull() & sound, F.lit(False))
    keys = ["grp", "d", "k1", "k2"]
    # 128 bits stand for a vector.
    own = all_rows.where(fit).select("vec_id", "grp", F.size("v").alias("d"), F.xxhash64(F.lit(1), "v").alias("k1"), F.xxhash64(F.lit(2), "v").alias("k2"), "v")
    classes = materialize(own.groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("node", F.monotonically_increasing_id()))
    sizes = classes.groupBy("grp", "d").agg(F.count("*").alias("n"), F.sum("copies").alias("rows"))
    totals = sizes.agg(F.sum("rows").alias("rows"), F.sum(F.col("n") * F.ceil(F.col("n") / block)).alias("sent")).first()
    # Groups of several blocks: there are fewer of them than blocks.
    big = materialize(sizes.where(F.col("n") > block).select("grp", "d", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    x = classes.join(F.broadcast(big) if big.count() <= HELD_IDS else big, ["grp", "d"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    x = x.withColumn("i", F.expr("pmod(xxhash64(node), blocks)").cast("int")).withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)")))
    x = x.select("grp", "d", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") > F.col("j")).cast("int").alias("side"), "node", "rep", "copies", "v")
    place = ["grp", "d", "lo", "hi"]
    parts = max(shuffle_partitions(spark), -(-(totals.sent or 0) // (4 * block)))
    met = x.repartition(parts, *place).sortWithinPartitions(*place, "side")
    linked = materialize(met.transform(mapped, _tiles(threshold), "node long, links long, a long, b long"))
    # An id with several vectors may be in several classes: what stands for them is joined.
    narrow = materialize(own.drop("v"))
    twice = narrow.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    joined = narrow.join(twice, "vec_id", "left_semi").join(classes.select(*keys, "rep"), keys).where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    found = components(linked.select("a", "b").union(joined))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    told = classes.select(*keys, "node", "copies", "rep").join(links, "node", "left")
    told = told.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    told = materialize(light(told.select(*keys, "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))))
    out = by_class(narrow, told, keys, "copies", totals.rows or 0).select("vec_id", "n_links", "component_id")
    rest = all_rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
