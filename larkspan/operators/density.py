"""Density clustering of vectors (M17): mutual reachability, minimum spanning tree, condensed tree, clusters of most stability.

The distance of two rows is the largest of their Euclidean distance and both core distances (that to the k-th nearest other row). A pass over all pairs
of blocks finds the nearest rows of each row. Edges to them make a forest; those of its edges that no edge between rows that are not near could
replace are in the whole tree. What they join are the first components. In further passes, rows of all components but the largest meet all rows, and
each component chooses its least edge that leaves it (Boruvka), until one is left. All sizes share the passes. The tree's edges are merged by rising
weight, ``LEVEL`` of them at a time, so a task never holds more; between two levels merged nodes are one node.

Products are made in single precision, whose error is bounded; the pairs that may count by them are computed again in double precision. Weights that
are equal are merged at once, so the result does not depend on which of several minimum trees was found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Vectors of a block; rows and columns of one matrix of distances; blocks that a task's own block meets; edges that one task takes to its own tree;
#: merges of one level.
BLOCK, PART, COLUMNS, HELD, EDGES, LEVEL = 32768, 512, 2048, 4, 1 << 21, 1 << 20
#: Least vectors of a block and blocks of a table, as long as that many vectors are there; nearest rows beyond those that make the core distances.
SMALL, BLOCKS, MORE = 1024, 8, 6
#: Least distance: nearer rows count as this far apart, so that densities stay finite.
NEAREST = 1e-9


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """node and x of the rows with a key and a vector of finite components, of the most frequent length (ties: the shorter); of a repeated key the
    smallest vector."""
    own = vectors.select(F.col(key).cast("long").alias("node"), F.col(vector).cast("array<double>").alias("x"))
    own = own.where(F.col("node").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    sizes = own.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return own.where(F.size("x") == (sizes[0].d if sizes else 0)).groupBy("node").agg(F.min("x").alias("x"))


def _packed(columns: list[str]):
    """One row of a task's rows: i, and the bytes of its arrays by ascending node; x in single precision where that loses nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            node = table["node"].to_numpy()
            order = np.argsort(node)
            x = np.concatenate([c.flatten().to_numpy() for c in table["x"].chunks]).reshape(len(node), -1)[order]
            single = x.astype(np.float32) if np.abs(x).max() < np.finfo(np.float32).max else x
            arrays = [node[order], *(table[c].to_numpy()[order] for c in columns), single if (single == x).all() else x]
            yield pa.RecordBatch.from_arrays([table["i"].chunk(0)[:1], pa.array([x.shape[1]], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in arrays)], ["i", "d", "node", *columns, "x"])

    return run


def blocks_of(rows: DataFrame, n: int, columns: list[str], block: int) -> tuple[DataFrame, int]:
    """One row for each block: i, and the bytes of node, the columns and x; and how many numbers of blocks there are."""
    count = max(1, -(-n // block), min(BLOCKS, n // SMALL))
    dealt = rows.select(F.pmod(F.xxhash64("node"), F.lit(count)).cast("int").alias("i"), "node", *columns, "x").repartitionById(count, "i")
    return written(dealt.mapInArrow(_packed(columns), ", ".join(["i int", "d int", *(f"{c} binary" for c in ("node", *columns, "x"))]))), count


def met(own: tuple[DataFrame, int], all_: tuple[DataFrame, int]) -> DataFrame:
    """Each block of ``own`` with every block of ``all_``: a task gets one of ``own`` (of them) and at most ``HELD`` others, or fewer where there are idle cores."""
    (one, n), (other, m) = own, all_
    groups = max(-(-m // HELD), min(m, -(-3 * one.sparkSession.sparkContext.defaultParallelism // n)))
    columns = [c for c in one.columns if c != "i"]
    left = one.select(F.explode(F.sequence(F.col("i") * groups, F.col("i") * groups + (groups - 1))).alias("task"), F.lit(True).alias("own"), *columns)
    right = other.select(F.explode(F.sequence(F.col("i") % groups, F.col("i") % groups + (n - 1) * groups, F.lit(groups))).alias("task"), F.lit(False).alias("own"), *columns)
    return left.union(right).repartitionById(n * groups, "task")


def _sides(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """The arrays of a task's own block with those of each other block; x is last."""
    own, waiting = None, []
    for batch in batches:
        for at in range(batch.num_rows):
            is_own, d, *row = (c[at] for c in batch.columns[1:])
            arrays, x = [np.frombuffer(c.as_buffer(), k) for c, k in zip(row, kinds)], row[-1].as_buffer()
            single = len(x) == 4 * len(arrays[0]) * d.as_py()
            arrays.append(np.frombuffer(x, np.float32 if single else np.float64).astype(np.float64).reshape(-1, d.as_py()))
            if is_own.as_py():
                own = arrays
                for other in waiting:
                    yield own, other
                waiting = []
            elif own is None:
                waiting.append(arrays)
            else:
                yield own, arrays


class Tiles:
    """Squared distances of two blocks in single precision. All are divided by a power of four, so that none over- or underflows; ``error`` bounds what
    those of a row are off by."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.power = int(np.frexp(max(np.abs(x).max(), np.abs(y).max()))[1])
        x, y = np.ldexp(x, -self.power), np.ldexp(y, -self.power)
        centre = x.mean(0)
        x, y = x - centre, y - centre
        p, q = (x * x).sum(1), (y * y).sum(1)
        self.error = 2.1 * (x.shape[1] + 8) * 2.0**-24 * (p + q.max()) + 1e-30
        self.left = np.column_stack([-2 * x, p, np.ones(len(x))]).astype(np.float32)
        self.right = np.column_stack([y, np.ones(len(y)), q]).astype(np.float32)

    def scaled(self, d: np.ndarray) -> np.ndarray:
        return np.ldexp(d, -self.power) ** 2

    def of(self, rows: slice, columns: slice) -> np.ndarray:
        return self.left[rows] @ self.right[columns].T


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a and b, one by one, adding the dimensions in order."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += (a[:, i] - b[:, i]) ** 2
    return np.sqrt(total)


def _ranks(row: np.ndarray) -> np.ndarray:
    """Numbers from 0 within each run of equal rows."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    return np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))


def _nearest(k: int):
    """The k nearest of the other blocks' rows to each row of a task's own block: node and near."""

    def meet(nodes: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, d: np.ndarray, m: np.ndarray, there: np.ndarray) -> None:
        tiles = Tiles(x, y)
        for lo in range(0, len(x), PART):
            rows = slice(lo, lo + PART)
            error = tiles.error[rows]
            with np.errstate(over="ignore"):
                most = (tiles.scaled(d[rows, -1]) + error).astype(np.float32) * np.float32(1 + 1e-6)
            found = []
            for at in range(0, len(y), COLUMNS):
                near = tiles.of(rows, slice(at, at + COLUMNS))
                if near.shape[1] > k and not np.isfinite(most).all():
                    # A row of its own may be among the k + 1.
                    most = np.minimum(most, np.partition(near, k, 1)[:, k] + (2 * error).astype(np.float32))
                hit = np.flatnonzero(near <= most[:, None])
                found.append((hit // near.shape[1], hit % near.shape[1] + at, near.ravel()[hit]))
            r, c, v = (np.concatenate(f) for f in zip(*found))
            apart = nodes[rows][r] != others[c]
            r, c, v = r[apart], c[apart], v[apart]
            order = np.lexsort((v, r))
            r, c, v = r[order], c[order], v[order]
            # Those that the k-th by single precision may be farther than.
            last = np.full(len(error), np.inf)
            kth = _ranks(r) == k - 1
            last[r[kth]] = v[kth]
            keep = v <= last[r] + 2 * error[r]
            r, c = r[keep], c[keep]
            full = np.flatnonzero(there[rows].ravel())
            r_all = np.concatenate([full // k, r])
            d_all = np.concatenate([d[rows].ravel()[full], exact(x[rows][r], y[c])])
            m_all = np.concatenate([m[rows].ravel()[full], others[c]])
            order = np.lexsort((m_all, d_all, r_all))
            r_all, d_all, m_all = r_all[order], d_all[order], m_all[order]
            rank = _ranks(r_all)
            keep = rank < k
            d[lo + r_all[keep], rank[keep]] = d_all[keep]
            m[lo + r_all[keep], rank[keep]] = m_all[keep]
            there[lo + r_all[keep], rank[keep]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for own, other in _sides(batches, [np.int64]):
            if best is None:
                shape = (len(own[0]), k)
                best = [np.full(shape, np.inf), np.zeros(shape, np.int64), np.zeros(shape, bool)]
            meet(*own, *other, *best)
        if best is not None:
            d, m, there = best
            ends = np.append(0, there.sum(1).cumsum()).astype(np.int32)
            near = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(d[there]), pa.array(m[there])], ["d", "m"]))
            yield pa.RecordBatch.from_arrays([pa.array(own[0]), near], ["node", "near"])

    return run


def nearest_rows(rows: DataFrame, n: int, k: int, block: int = BLOCK) -> DataFrame:
    """node, near: distance d and node m of its k nearest other rows, ascending (fewer where there are fewer)."""
    blocks = blocks_of(rows, n, [], block)
    found = met(blocks, blocks).mapInArrow(_nearest(k), "node long, near array<struct<d: double, m: long>>")
    return found.groupBy("node").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def nearest_distances(rows: DataFrame, n: int, k: int, block: int = BLOCK) -> DataFrame:
    """node, d: the distances to its k nearest other rows, ascending (fewer where there are fewer)."""
    return nearest_rows(rows, n, k, block).select("node", F.col("near.d").alias("d"))


def core_distances(vectors: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """key, core: the distance to the k-th nearest other row, or to the farthest where there are fewer; 0 for a single row. Rows without a key or a
    vector of finite components of the usual length are left out."""
    rows = written(usable(vectors, key, vector))
    near = nearest_distances(rows, rows.count(), k, block)
    return near.select(F.col("node").alias(key), F.coalesce(F.get("d", F.size("d") - 1), F.lit(0.0)).alias("core"))


def forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """The minimum spanning forest of edges, in the total order (w, a, b)."""
    order = np.lexsort((b, a, w))
    a, b, w = a[order], b[order], w[order]
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = ends[: len(a)], ends[len(a) :]
    x, y, left, top = one, two, np.arange(len(a)), np.arange(len(nodes))
    keep = np.zeros(len(a), bool)
    while True:
        x, y = top[x], top[y]
        apart = x != y
        x, y, left = x[apart], y[apart], left[apart]
        if not len(left):
            return [a[keep], b[keep], w[keep]]
        # Edges are in order, so the first one of each tree is its least.
        first = np.full(len(nodes), len(a))
        np.minimum.at(first, x, left)
        np.minimum.at(first, y, left)
        chosen = np.unique(first[first < len(a)])
        keep[chosen] = True
        p, q = one[chosen], two[chosen]
        while (top[p] != top[q]).any():
            low = np.minimum(top[p], top[q])
            np.minimum.at(top, top[p], low)
            np.minimum.at(top, top[q], low)
            while (top[top] != top).any():
                top = top[top]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The minimum spanning forest of one task's edges."""
    parts = [[b.column(i).to_numpy() for i in range(3)] for b in batches if b.num_rows]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest(*(np.concatenate(c) for c in zip(*parts)))], ["a", "b", "w"])


def _sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0: an edge of the forest of near rows, 1: node a, and w, below which no edge of its own is that is not between near rows). Returns the edges
    that are in the whole tree (kind 0), those that may be replaced (kind 1), and for each node a its component b by the former (kind 2).

    Edges join components by rising weight. If no other edge that leaves one of the two can be lighter, an edge is its least one."""
    parts = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
    if not parts:
        return
    kind, a, b, w = (np.concatenate(c) for c in zip(*parts))
    nodes, floor = a[kind == 1], w[kind == 1]
    order = np.argsort(nodes)
    nodes, floor = nodes[order], floor[order].tolist()
    a, b, w = (c[kind == 0] for c in (a, b, w))
    order = np.lexsort((b, a, w))
    a, b, w = a[order], b[order], w[order]
    sure, tops = np.zeros(len(a), bool), [list(range(len(nodes))) for _ in range(2)]

    def find(top: list[int], i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for at, (i, j, weight) in enumerate(zip(np.searchsorted(nodes, a).tolist(), np.searchsorted(nodes, b).tolist(), w.tolist())):
        p, q = find(tops[0], i), find(tops[0], j)
        sure[at] = max(floor[p], floor[q]) >= weight
        tops[0][max(p, q)] = min(p, q)
        floor[min(p, q)] = min(floor[p], floor[q])
        if sure[at]:
            p, q = find(tops[1], i), find(tops[1], j)
            tops[1][max(p, q)] = min(p, q)
    where = nodes[[find(tops[1], i) for i in range(len(nodes))]]
    kinds = np.concatenate([np.where(sure, 0, 1), np.full(len(nodes), 2)])
    arrays = [kinds.astype(np.int32), np.concatenate([a, nodes]), np.concatenate([b, where]), np.concatenate([w, np.zeros(len(nodes))])]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], ["kind", "a", "b", "w"])


def _lightest(count: int):
    """For each of the sizes and each component of a task's own block that has a bound (at least 0): the least edge to the other blocks' rows that leaves it
    and is not above the bound."""

    def meet(nodes: np.ndarray, x: np.ndarray, own: list[tuple], others: np.ndarray, y: np.ndarray, theirs: list[tuple], best: list[tuple]) -> None:
        tiles = Tiles(x, y)
        far = [tiles.scaled(core) for _, core, _ in theirs]
        near_ = [tiles.scaled(core) for _, core, _ in own]
        for lo in range(0, len(x), PART):
            rows = slice(lo, lo + PART)
            error = tiles.error[rows]
            for at in range(0, len(y), COLUMNS):
                columns = slice(at, at + COLUMNS)
                d = tiles.of(rows, columns)
                most = [np.where(b[0][i[rows]] < 0, -np.inf, tiles.scaled(b[0][i[rows]]) * (1 + 1e-9) + error) for (i, _, _), b in zip(own, best)]
                # Rounded up, as it is compared in single precision.
                limits = [(t * (1 + 1e-6)).astype(np.float32)[:, None] for t in most]
                hits = np.flatnonzero(d <= np.maximum.reduce(limits))
                dense = len(hits) > d.size // 64
                for which, ((i, core, comp), (_, their_core, their_comp), b) in enumerate(zip(own, theirs, best)):
                    t = most[which]
                    if not len(hits) or t.max() < 0:
                        continue
                    hit = np.flatnonzero((d <= limits[which]) & (comp[rows][:, None] != their_comp[columns])) if dense else hits
                    r, c = hit // d.shape[1], hit % d.shape[1]
                    v = np.maximum(d.ravel()[hit], np.maximum(near_[which][rows][r], far[which][columns][c]))
                    keep = (v <= t[r]) & (comp[rows][r] != their_comp[columns][c])
                    r, c, v = r[keep], c[keep], v[keep]
                    group, off = i[rows][r], error[r]
                    least = np.full(len(b[0]), np.inf)
                    np.minimum.at(least, group, v + off)
                    keep = v - off <= least[group]
                    r, c, group = r[keep] + lo, c[keep] + at, group[keep]
                    w = np.maximum(np.maximum(exact(x[r], y[c]), np.maximum(core[r], their_core[c])), NEAREST)
                    one, two = np.minimum(nodes[r], others[c]), np.maximum(nodes[r], others[c])
                    order = np.lexsort((two, one, w, group))
                    order = order[_ranks(group[order]) == 0]
                    for g, *edge in zip(group[order].tolist(), w[order].tolist(), one[order].tolist(), two[order].tolist()):
                        now = (b[0][g], b[1][g], b[2][g])
                        if tuple(edge) < now if b[3][g] else edge[0] <= now[0]:
                            b[0][g], b[1][g], b[2][g], b[3][g] = *edge, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for own, other in _sides(batches, [np.int64, *[np.float64, np.int64, np.float64] * count]):
            sides = [[side[1 + 3 * i : 4 + 3 * i] for i in range(count)] for side in (own, other)]
            if best is None:
                best, mine, names = [], [], []
                for core, comp, bound in sides[0]:
                    found, first, i = np.unique(comp, return_index=True, return_inverse=True)
                    names.append(found)
                    mine.append((i, core, comp))
                    best.append((bound[first].copy(), np.zeros(len(found), np.int64), np.zeros(len(found), np.int64), np.zeros(len(found), bool)))
            meet(own[0], own[-1], mine, other[0], other[-1], [(None, core, comp) for core, comp, _ in sides[1]], best)
        for which, b in enumerate(best or []):
            yes = b[3]
            arrays = [np.full(yes.sum(), which, np.int32), names[which][yes], b[0][yes], b[1][yes], b[2][yes]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], ["which", "comp", "w", "a", "b"])

    return run


def _tops(chosen: DataFrame) -> DataFrame:
    """which, x, top: the number of the tree of each x, by following the choices x -> up, which lead to two that chose each other (the smaller is the top)
    or to one that chose nothing."""
    back = chosen.select("which", F.col("x").alias("up"), F.col("up").alias("back"))
    up = chosen.select("which", "x", "up").join(back, ["which", "up"], "left").select("which", "x", F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("up")), F.col("x")).otherwise(F.col("up")).alias("up"))
    ends = chosen.select("which", F.col("up").alias("x")).distinct().join(chosen, ["which", "x"], "left_anti")
    up = written(up.unionByName(ends.withColumn("up", F.col("x"))))
    while True:
        above = up.select("which", F.col("x").alias("up"), F.col("up").alias("top"))
        further = written(up.join(above, ["which", "up"]).select("which", "x", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        up = further.select("which", "x", "up")
        if not further.where("moved").limit(1).count():
            return up.withColumnRenamed("up", "top")


def spanning_trees(cored: DataFrame, near: DataFrame, n: int, count: int, block: int = BLOCK, per_task: int = EDGES) -> list[DataFrame]:
    """Minimum spanning trees (a < b, w) of mutual reachability by each of the core distances core0, core1, ... of the rows (node, x): see above."""
    edge = "struct<w: double, a: long, b: long>"
    cores = [f"core{i}" for i in range(count)]
    pairs = near.select("node", F.explode("near").alias("e")).select(F.least("node", "e.m").alias("a"), F.greatest("node", "e.m").alias("b"), F.col("e.d").alias("d")).distinct()
    ends = [cored.select(F.col("node").alias(c), *(F.col(core).alias(f"{c}_{core}") for core in cores)) for c in "ab"]
    listed = written(pairs.join(ends[0], "a").join(ends[1], "b"))
    sure, spare, labels, label = None, None, cored.select("node"), [f"comp{i}" for i in range(count)]
    for i, core in enumerate(cores):
        edges = listed.select("a", "b", F.greatest("d", f"a_{core}", f"b_{core}", F.lit(NEAREST)).alias("w"))
        # No row that is not near is nearer than the farthest that is; where all are near, there is none.
        floors = near.join(cored, "node").select("node", F.when(F.size("near") >= n - 1, F.lit(float("inf"))).otherwise(F.greatest(F.col("near.d")[F.size("near") - 1], core, F.lit(NEAREST))).alias("floor"))
        if n <= per_task:
            tree = spanning_tree(edges, per_task)
            given = tree.select(F.lit(0).alias("kind"), "a", "b", "w").union(floors.select(F.lit(1), "node", "node", "floor"))
            told = written(given.coalesce(1).mapInArrow(_sure, "kind int, a long, b long, w double"))
            ours, rest, placed = told.where("kind = 0"), told.where("kind = 1"), told.where("kind = 2").select(F.col("a").alias("node"), F.col("b").alias("comp"))
        else:
            # Each row's own least edge, where no other can be less.
            ways = edges.select(F.col("a").alias("x"), F.col("b").alias("up"), F.struct("w", "a", "b").alias("e")).union(edges.select("b", "a", F.struct("w", "a", "b")))
            least = ways.groupBy("x").agg(F.min(F.struct("e", "up")).alias("c")).join(floors.withColumnRenamed("node", "x"), "x").where(F.col("c.e.w") <= F.col("floor"))
            chosen = written(least.select(F.lit(i).alias("which"), "x", F.col("c.up").alias("up"), F.col("c.e").alias("e")))
            ours, rest = chosen.select("e.a", "e.b", "e.w").distinct(), edges
            placed = cored.select("node").join(_tops(chosen).select(F.col("x").alias("node"), "top"), "node", "left").select("node", F.coalesce("top", "node").alias("comp"))
        own, left = (f.select(F.lit(i).alias("which"), F.struct("w", "a", "b").cast(edge).alias("e")) for f in (ours, rest))
        sure, spare = (own, left) if sure is None else (sure.union(own), spare.union(left))
        labels = labels.join(placed.withColumnRenamed("comp", label[i]), "node")
    labels = written(labels)
    while True:
        long = F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.col(c).alias("comp")) for i, c in enumerate(label)))).alias("_l")
        places = labels.select("node", long).select("node", "_l.which", "_l.comp")
        sizes = written(places.groupBy("which", "comp").agg(F.count("*").alias("n")))
        most = sizes.groupBy("which").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("comps")).select("which", "m.comp", "comps").collect()
        if all(r.comps == 1 for r in most):
            return [written(sure.where(F.col("which") == i).select("e.a", "e.b", "e.w")) for i in range(count)]
        at = [places.select("which", F.col("node").alias(f"e_{c}"), F.col("comp").alias(f"comp_{c}")) for c in "ab"]
        spare = spare.select("which", "e", F.col("e.a").alias("e_a"), F.col("e.b").alias("e_b")).join(at[0], ["which", "e_a"]).join(at[1], ["which", "e_b"]).where("comp_a <> comp_b")
        spare = written(spare.select("which", "e", "comp_a", "comp_b"))
        leaving = spare.select("which", F.explode(F.array("comp_a", "comp_b")).alias("comp"), "e.w").groupBy("which", "comp").agg(F.min("w").alias("bound"))
        # The largest component of a size may be chosen, but need not choose.
        largest = F.lit(False)
        for r in most:
            largest = largest | ((F.col("which") == r.which) & (F.col("comp") == r.comp))
        bounds = written(sizes.join(leaving, ["which", "comp"], "left").select("which", "comp", F.when(largest, F.lit(-1.0)).otherwise(F.coalesce("bound", F.lit(float("inf")))).alias("bound")))
        state = cored.join(labels, "node")
        for i, c in enumerate(label):
            state = state.join(bounds.where(F.col("which") == i).select(F.col("comp").alias(c), F.col("bound").alias(f"bound{i}")), c)
        state = written(state)
        asking = state.where(" OR ".join(f"bound{i} >= 0" for i in range(count)))
        columns = [f"{c}{i}" for i in range(count) for c in ("core", "comp", "bound")]
        passed = met(blocks_of(asking, asking.count(), columns, block), blocks_of(state, n, columns, block)).mapInArrow(_lightest(count), "which int, comp long, w double, a long, b long")
        least = written(passed.groupBy("which", "comp").agg(F.min(F.struct("w", "a", "b")).alias("e")))
        ways = least.select("which", F.col("comp").alias("x"), "e", F.col("e.a").alias("e_a"), F.col("e.b").alias("e_b")).join(at[0], ["which", "e_a"]).join(at[1], ["which", "e_b"])
        chosen = written(ways.select("which", "x", F.when(F.col("comp_a") == F.col("x"), F.col("comp_b")).otherwise(F.col("comp_a")).alias("up"), "e"))
        sure, spare = written(sure.union(chosen.select("which", "e").distinct())), spare.select("which", "e")
        tops = _tops(chosen)
        for i, c in enumerate(label):
            moved = tops.where(F.col("which") == i).select(F.col("x").alias(c), "top")
            labels = labels.join(moved, c, "left").withColumn(c, F.coalesce("top", c)).drop("top")
        labels = written(labels)


def spanning_tree(edges: DataFrame, per_task: int = EDGES) -> DataFrame:
    """Minimum spanning forest of the edges (a < b, w), in the total order (w, a, b).

    Each task first keeps the forest of its own edges. Where one task then takes all, that is the result. Else Boruvka rounds: each tree chooses its
    least edge, trees that are joined get one number by following the choices, and edges within a tree go."""
    edges = written(edges.mapInArrow(_forest, "a long, b long, w double"))
    n = edges.count()
    while n > per_task:
        # As long as fewer tasks keep less.
        fewer = written(edges.repartition(-(-n // per_task)).mapInArrow(_forest, "a long, b long, w double"))
        n, before = fewer.count(), n
        edges = fewer
        if -(-n // per_task) == -(-before // per_task):
            break
    if n <= per_task:
        return written(edges.coalesce(1).mapInArrow(_forest, "a long, b long, w double"))
    alive = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("w", "a", "b").alias("e"))
    tree = edges.limit(0)
    while True:
        ways = alive.union(alive.select(F.col("y").alias("x"), F.col("x").alias("y"), "e"))
        chosen = written(ways.groupBy("x").agg(F.min(F.struct("e", "y")).alias("c")).select("x", F.col("c.y").alias("up"), F.col("c.e").alias("e")))
        if not chosen.limit(1).count():
            return written(tree)
        tree = written(tree.union(chosen.select("e.a", "e.b", "e.w").distinct()))
        # Choices lead to two trees that chose each other; the smaller number is the root.
        back = chosen.select(F.col("x").alias("up"), F.col("up").alias("back"))
        up = chosen.select("x", "up").join(back, "up").select("x", F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("up")), F.col("x")).otherwise(F.col("up")).alias("up"))
        up = written(up)
        while True:
            further = up.join(up.select(F.col("x").alias("up"), F.col("up").alias("top")), "up").select("x", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
            further = written(further)
            up = further.select("x", "up")
            if not further.where("moved").limit(1).count():
                break
        alive = alive.join(up, "x").drop("x").withColumnRenamed("up", "x").join(up.select(F.col("x").alias("y"), F.col("up").alias("z")), "y").where("x <> z")
        alive = alive.groupBy(F.least("x", "z").alias("x"), F.greatest("x", "z").alias("y")).agg(F.min("e").alias("e"))
        alive = written(alive)


#: What one level returns: kind 0: node ``a`` of the level fell from cluster ``b`` at density ``x``; 1: cluster ``a`` ended below cluster ``b`` and is (n = 1) or
#: is not (n = 0) better than its parts; 2: node ``a`` now belongs to node ``b``; 3: the node ``a`` has n rows and, where ``b`` is not null, that cluster, with
#: the sum ``x`` of densities of what left it and the value ``y`` of its parts.
_EVENTS = "kind int, a long, b long, n long, x double, y double"


def _merge(least: int, first: int):
    """Merges of one level by rising weight. Rows: kind 3 as above, the nodes, and kind 4: an edge (a, b, weight x). New clusters are numbered from ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        edges = sorted((x, a, b) for kind, a, b, _, x, _ in rows if kind == 4)
        top: dict[int, int] = {}
        size, cluster, sums, parts = {}, {}, {}, {}
        members: dict[int, list[int]] = {}
        for kind, a, b, n, x, y in rows:
            if kind == 3:
                size[a], cluster[a], sums[a], parts[a], members[a] = n, b, x, y, [a]
        out: list[tuple] = []
        number = first

        def find(a: int) -> int:
            while top.get(a, a) != a:
                top[a] = top.get(top[a], top[a])
                a = top[a]
            return a

        at = 0
        while at < len(edges):
            # All edges of one weight at once: the nodes that they join are one merge.
            stop = at
            while stop < len(edges) and edges[stop][0] == edges[at][0]:
                stop += 1
            density, groups, old = 1 / edges[at][0], {}, set()
            for _, a, b in edges[at:stop]:
                old |= {find(a), find(b)}
            for _, a, b in edges[at:stop]:
                p, q = find(a), find(b)
                if p != q:
                    top[max(p, q)] = min(p, q)
            for a in old:
                groups.setdefault(find(a), []).append(a)
            for root, joined in groups.items():
                big = [a for a in joined if cluster[a] is not None]
                small = [a for a in joined if cluster[a] is None]
                total, own, total_sum, value = sum(size[a] for a in joined), None, 0.0, 0.0
                if len(big) == 1:
                    own, total_sum, value = cluster[big[0]], sums[big[0]], parts[big[0]]
                elif big or total >= least:
                    own = number
                    number += 1
                    for a in big:
                        stability = sums[a] - size[a] * density
                        out.append((1, cluster[a], own, int(stability >= parts[a]), None, None))
                        value += max(stability, parts[a])
                        total_sum += size[a] * density
                fallen = [m for a in small for m in members[a]]
                if own is not None:
                    out += [(0, m, own, None, density, None) for m in fallen]
                    total_sum += sum(size[a] for a in small) * density
                    fallen = []
                size[root], cluster[root], sums[root], parts[root], members[root] = total, own, total_sum, value, fallen
                for a in joined:
                    if a != root:
                        out.append((2, a, root, None, None, None))
            at = stop
        final = [(2, a, find(b), None, None, None) if kind == 2 else (kind, a, b, n, x, y) for kind, a, b, n, x, y in out]
        final += [(3, a, cluster[a], size[a], sums[a], parts[a]) for a in size if find(a) == a]
        for lo in range(0, len(final), 1 << 16):
            cols = list(zip(*final[lo : lo + (1 << 16)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["kind", "a", "b", "n", "x", "y"])

    return run


def condensed(tree: DataFrame, nodes: DataFrame, least: int, level: int = LEVEL) -> tuple[DataFrame, DataFrame]:
    """The condensed tree of a spanning tree: (node, cluster, density) of where each node leaves it, and (cluster, parent, better) of each cluster but the
    topmost: ``better`` if it is at least as stable as its parts. Nodes that never are in a cluster are not returned."""
    null = F.lit(None)
    at = written(nodes.select("node", F.col("node").alias("place")))
    state = nodes.select(F.lit(3).alias("kind"), F.col("node").alias("a"), null.cast("long").alias("b"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    n, falls, clusters, first = tree.count(), [], [], 0
    # Weights that end a level, from the exact counts of the weights.
    ends = [float("inf")]
    if n > level:
        parts = [i / -(-n // level) for i in range(1, -(-n // level))]
        ends = sorted({float(v) for v in tree.approxQuantile("w", parts, 0.25 * level / n)}) + ends
    low = 0.0
    for high in ends:
        edges = tree.where((F.col("w") > low) & (F.col("w") <= high)) if high < float("inf") else tree.where(F.col("w") > low)
        low = high
        mapped = edges.join(at.select(F.col("node").alias("a"), F.col("place").alias("p")), "a").join(at.select(F.col("node").alias("b"), F.col("place").alias("q")), "b")
        ours = written(mapped.select(F.lit(4).alias("kind"), F.col("p").alias("a"), F.col("q").alias("b"), F.lit(0).cast("long").alias("n"), F.col("w").alias("x"), F.lit(0.0).alias("y")))
        touched = written(ours.select("a").union(ours.select(F.col("b").alias("a"))).distinct())
        given = ours.union(state.join(touched, "a", "left_semi").select("kind", "a", "b", "n", "x", "y"))
        events = written(given.coalesce(1).mapInArrow(_merge(least, first), _EVENTS))
        # The last of the new clusters has no parent yet, so it is among the nodes' clusters.
        first = max(first, events.where("kind = 3").agg(F.coalesce(F.max("b"), F.lit(-1)) + 1).first()[0])
        fell = events.where("kind = 0").select(F.col("a").alias("place"), F.col("b").alias("cluster"), F.col("x").alias("density"))
        falls.append(written(at.join(fell, "place").select("node", "cluster", "density")))
        clusters.append(events.where("kind = 1").select(F.col("a").alias("cluster"), F.col("b").alias("parent"), (F.col("n") == 1).alias("better")))
        if high < float("inf"):
            moved = events.where("kind = 2").select(F.col("a").alias("place"), F.col("b").alias("to"))
            at = written(at.join(moved, "place", "left").select("node", F.coalesce("to", "place").alias("place")))
            state = written(state.join(touched, "a", "left_anti").select("kind", "a", "b", "n", "x", "y").union(events.where("kind = 3")))
    out = [frames[0] for frames in (falls, clusters)]
    for i, frames in enumerate((falls, clusters)):
        for f in frames[1:]:
            out[i] = out[i].union(f)
    return out[0], out[1]


def selected(clusters: DataFrame) -> DataFrame:
    """cluster, topic: of each cluster below the topmost one the highest cluster at or above it that is better than its parts, by following parents twice
    as far in each round. Null: none."""
    own = clusters.select("cluster", "parent", F.when(F.col("better"), F.col("cluster")).alias("topic"))
    while True:
        own = written(own)
        above = own.select(F.col("cluster").alias("parent"), F.col("parent").alias("further"), F.col("topic").alias("higher"))
        if not own.join(above, "parent", "left_semi").limit(1).count():
            return own.select("cluster", "topic")
        own = own.join(above, "parent", "left").select("cluster", F.col("further").alias("parent"), F.coalesce("higher", "topic").alias("topic"))


def density_clusters(vectors: DataFrame, key: str, vector: str, sizes: list[int], block: int = BLOCK, per_task: int = EDGES, level: int = LEVEL) -> DataFrame:
    """For each least size of a cluster (which is also the number of neighbours that make the core distance) and each row: min_size, key, topic,
    strength. Topics are the clusters of most stability, numbered from 0 by falling size (ties: smallest key); -1 is noise, of strength 0. Strength is
    the density at which the row leaves its topic, by the topic's largest.

    Rows without a key or a vector of finite components of the usual length are noise as well; so are all rows where there are fewer than the least
    size, or no two clusters. A repeated key: the smallest of its vectors stands for all. Empty table: empty result.
    """
    from .skills import ranked

    everyone = vectors.select(F.col(key).cast("long").alias("node"))
    rows = written(usable(vectors, key, vector))
    n = rows.count()
    near = written(nearest_rows(rows, n, max(sizes) + MORE, block))
    cores = [F.coalesce(F.get("near.d", F.least(F.size("near"), F.lit(s)) - 1), F.lit(0.0)).alias(f"core{i}") for i, s in enumerate(sizes)]
    cored = written(rows.join(near, "node").select("node", "x", *cores))
    trees = spanning_trees(cored, near, n, len(sizes), block, per_task)
    nodes, found = rows.select("node"), None
    for i, size in enumerate(sizes):
        falls, clusters = condensed(trees[i], nodes, size, level)
        placed = written(falls.join(selected(clusters), "cluster").where("topic IS NOT NULL").select("node", F.col("topic").alias("cluster"), "density"))
        counted = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("density").alias("top"))
        # Clusters are fewer than rows by the least size; their numbers are few.
        numbers = ranked(counted, [F.desc("n"), F.col("least")], "topic").select("cluster", "topic", "top")
        named = placed.join(numbers, "cluster").select("node", "topic", (F.col("density") / F.col("top")).alias("strength"))
        told = everyone.join(named, "node", "left").select(F.lit(size).alias("min_size"), F.col("node").alias(key), F.coalesce("topic", F.lit(-1)).cast("long").alias("topic"), F.coalesce("strength", F.lit(0.0)).alias("strength"))
        found = told if found is None else found.union(told)
    return found
