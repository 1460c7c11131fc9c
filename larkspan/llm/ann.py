"""Nearest neighbours by a block matrix join.

Candidates and queries lie in blocks, each vector quantised to int8 with its own scale. The product of two int8 tiles gives all distances of a
pair of tiles up to the quantisation errors of both vectors, which are known; what can't be among a query's k nearest of the tile by these bounds
is dropped, and the rest is recomputed in double precision on the original vectors. Results are merged by heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import mapped, materialize, shuffle_partitions

#: Vectors of a tile of candidates, and of queries.
BLOCK, QUERY_BLOCK = 4096, 512
#: Bytes of the candidates that one task holds where there are many: each query is sent to as many tasks as there are such parts.
HELD_BYTES = 64 << 20
#: Between these, squares neither overflow nor lose anything.
SMALL, LARGE = 1e-140, 1e140


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and Euclidean error of each row; no entry above 1 in absolute value."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
    # A little more than the error, for the rounding of this computation.
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-12 * scale + SMALL


def _lengths(d: np.ndarray) -> np.ndarray:
    """Length of each row, adding the dimensions one after the other."""
    total = np.zeros(len(d))
    for c in range(d.shape[1]):
        total += d[:, c] ** 2
    return np.sqrt(total)


def exact_distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances in double precision. Differences whose squares would over- or underflow are scaled by a power of two first."""
    with np.errstate(over="ignore"):
        d = x - q
        top = np.abs(d).max(1)
        odd = np.flatnonzero(((top > LARGE) | (top < SMALL)) & (top > 0) & np.isfinite(top))
        out = _lengths(d)
        if len(odd):
            _, power = np.frexp(top[odd])
            out[odd] = np.ldexp(_lengths(np.ldexp(d[odd], -power[:, None])), power)
        return out


def block_neighbours(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k nearest of a block, itself left out: (score, id) ascending."""
    # For the bounds only, all entries are at most 1 after scaling by a power of two.
    _, power = np.frexp(max(np.abs(q).max(), np.abs(x).max()))
    cq, sq, eq = quantise(np.ldexp(q, -power))
    cx, sx, ex = quantise(np.ldexp(x, -power))
    # Sums of products of int8 codes are whole numbers, which single precision holds exactly up to 2**24 (and BLAS is fast at).
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    tile = (cq.astype(kind) @ cx.T.astype(kind)).astype(np.float64)
    qq, xx = (s * s * (c.astype(np.float64) ** 2).sum(1) for s, c in ((sq, cq), (sx, cx)))
    near = np.sqrt(np.maximum(qq[:, None] + xx[None, :] - 2 * sq[:, None] * sx[None, :] * tile, 0))
    # Quantisation, and the rounding of the line above, of which little is left where nearly equal squares cancel.
    slack = eq[:, None] + ex[None, :] + 1e-6 * near + 1e-7 * (np.sqrt(qq)[:, None] + np.sqrt(xx)[None, :])
    low, high = near - slack, near + slack
    own = q_ids[:, None] == ids[None, :]
    high[own] = np.inf
    for i in range(len(q_ids)):
        ok = ~own[i]
        n = int(ok.sum())
        if not n:
            continue
        bound = np.partition(high[i], k - 1)[k - 1] if n > k else np.inf
        at = np.flatnonzero(ok & (low[i] <= bound))
        score = exact_distance(q[i], x[at])
        order = np.lexsort((ids[at], score))[:k]
        yield int(q_ids[i]), [(float(score[o]), int(ids[at[o]])) for o in order]


def _join(k: int, query_block: int):
    """Rows (part, kind, vec_id, v) by part, its candidates (kind 0) before the queries (kind 1): a block of candidates is held, queries pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block, asked, n = None, [], None, [], 0

        def stacked(rows: list) -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])

        def answers() -> Iterator[pa.RecordBatch]:
            if not asked or block is None:
                return
            q_ids, q = stacked(asked)
            for at in range(0, len(block[0]), BLOCK):
                found = list(block_neighbours(q_ids, q, block[0][at : at + BLOCK], block[1][at : at + BLOCK], k))
                if not found:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()), pa.array([[s for s, _ in f[1]] for f in found], pa.list_(pa.float64())), pa.array([[i for _, i in f[1]] for f in found], pa.list_(pa.int64()))],
                    ["query_id", "scores", "ids"],
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            part, kind, ids = (batch.column(i).to_numpy() for i in range(3))
            vectors = np.asarray(batch.column(3).flatten(), np.float64).reshape(batch.num_rows, -1)
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
                if part[i] != now:
                    yield from answers()
                    now, held, block, asked, n = part[i], [], None, [], 0
                if kind[i] == 0:
                    held.append((ids[i:j], vectors[i:j]))
                    continue
                if block is None and held:
                    block, held = stacked(held), []
                for lo in range(i, j, query_block):
                    hi = min(lo + query_block, j)
                    asked.append((ids[lo:hi], vectors[lo:hi]))
                    n += hi - lo
                    if n >= query_block:
                        yield from answers()
                        asked, n = [], 0
        yield from answers()

    return run


def _merge(k: int):
    """Heaps over the block results of each query, which come together and number one for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                best = heapq.merge(*(list(zip(p["scores"], p["ids"])) for p in parts))
                for rank, (score, i) in enumerate(x for _, x in zip(range(k), best)):
                    out.append((query, rank + 1, i, score))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k nearest rows (Euclidean, double precision; ties to the smaller id) of each row whose id is divisible by ``every``, itself left out:
    query_id, rank, vec_id, score. Exact.

    Finite components of any size take part. Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows with a null
    id or of another length than the most frequent one. A repeated id: the smallest of its vectors stands. Empty table, or no queries: empty result. Other columns are not read.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    own = own.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fit)
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d, n = (sizes[0].d, sizes[0].n) if sizes else (0, 0)
    own = materialize(own.where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v")))
    # As many parts as there are tasks, if they fill tiles; more only where a part would hold too much.
    blocks = max(1, -(-n * d * 8 // HELD_BYTES), min(shuffle_partitions(vectors.sparkSession), -(-n // block)))
    candidates = own.select(F.expr(f"pmod(xxhash64(vec_id), {blocks})").alias("part"), F.lit(0).alias("kind"), "vec_id", "v")
    # Of the two sides the queries are the smaller, so they go to every part of the candidates; these are shuffled once.
    queries = own.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("part"), F.lit(1).alias("kind"), "vec_id", "v")
    met = candidates.union(queries).repartition(max(shuffle_partitions(vectors.sparkSession), blocks), "part").sortWithinPartitions("part", "kind")
    found = met.transform(mapped, _join(k, QUERY_BLOCK), "query_id long, scores array<double>, ids array<long>")
    grouped = found.groupBy("query_id").agg(F.collect_list(F.struct("scores", "ids")).alias("parts"))
    return grouped.transform(mapped, _merge(k), "query_id long, rank int, vec_id long, score double")
