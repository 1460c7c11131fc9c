"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian verification of signatures, exact verification of survivors.

1. A sketch of each document: size and hash of its shingle set, signature, band keys. Documents with equal sets form a class at once; from
   here on one representative (smallest id) stands for each class, so copies are never paired.
2. Every member of a band bucket is paired with the bucket's smallest member only, which is linear in the bucket. Pairs are compared by
   batches of signature values; a pair is dropped as soon as the posterior probability that its similarity reaches the threshold falls
   below the miss probability; survivors are verified on full shingle sets.
3. Components are found. Only buckets in which members of different components meet need more: their members are compared in blocks, pairs
   across components only, by signature; the members of surviving pairs meet in blocks again, on full sets. Pairs within a component
   can't change it, so no link is lost to the short cut. Members of the bucket's main component (its smallest member's) lie in blocks of their
   own, which don't meet each other: a group of near copies of any size costs as many block pairs as it has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import LOWER, NOT_SPACE, STEP, U, by_class, documents_input, gram_hashes, groups, light, mapped, matching, materialize, mix, shuffle_partitions, span_hashes, text_bytes, word_spans

#: Rows of a band key, and number of bands: a pair at the threshold 0.8 shares no band with probability 3e-6.
ROWS, BANDS = 6, 42
#: Signature values kept for verification (16 bits of each), and how many one step of it compares.
SIGNATURE, STEP_VALUES = 128, 16
_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * U(2) + U(1)
#: Members of one block when a bucket holds several components, with signatures and with full sets.
BLOCK, SET_BLOCK = 512, 128
#: Bytes of full sets that make a block full as well.
SET_BYTES = 16 << 20
#: Links that one task joins into trees before components are sought across tasks.
EDGES = 1 << 18


def shingle_sets(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document one after the other, ascending within it, and their numbers. At most 256 documents."""
    s, e, n = word_spans(b, starts, ends, NOT_SPACE)
    words = span_hashes(b, s, e)
    at = np.cumsum(n) - n
    count = np.where(n >= k, n - k + 1, 0)
    grams = gram_hashes(words, k)
    doc = np.repeat(np.arange(len(n)), count)
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at, count)
    h = grams[inside] if len(inside) else np.zeros(0, U)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        h = np.concatenate([h, np.array([gram_hashes(words[at[d] : at[d] + n[d]], int(n[d]))[0] for d in short], U)])
        doc = np.concatenate([doc, short])
    # 56 bits of hash below the document's number: one plain sort settles all documents.
    bits = U(max(1, int(len(n) - 1).bit_length()))
    x = np.sort((doc.astype(U) << (U(64) - bits)) | (h >> bits))
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    x = x[keep]
    size = np.bincount((x >> (U(64) - bits)).astype(np.int64), minlength=len(n))
    return (x << bits) >> U(8), size


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, starts, ends = text_bytes(batch.column(1))
            if not batch.num_rows:
                continue
            for i, j in groups(starts, ends, STEP, 256):
                lo = int(starts[i])
                x, size = shingle_sets(LOWER[b[lo : int(ends[j - 1])]], starts[i:j] - lo, ends[i:j] - lo, k)
                full = np.flatnonzero(size)
                at = (np.cumsum(size) - size)[full]
                sets = np.zeros((2, j - i), U)
                signature = np.zeros((len(full), ROWS * BANDS), U)
                if len(full):
                    h = mix(x + U(1))
                    sets[0, full] = np.add.reduceat(mix(h ^ U(0xA5A5A5A5)), at)
                    sets[1, full] = np.add.reduceat(h, at)
                    y = np.empty_like(h)
                    for c, seed in enumerate(_SEEDS):
                        np.multiply(h, seed, out=y)
                        signature[:, c] = np.minimum.reduceat(y, at)
                bands = np.zeros((len(full), BANDS), U)
                for c in range(ROWS):
                    bands = mix(bands * U(31) + signature[:, c::ROWS])
                bands += np.arange(BANDS, dtype=U)
                # The least bits: the greatest ones of a minimum are mostly 0.
                values = signature[:, :SIGNATURE].astype("<u2")
                sig: list[bytes | None] = [None] * (j - i)
                keys: list[np.ndarray | None] = [None] * (j - i)
                for r, d in enumerate(full):
                    sig[d], keys[d] = values[r].tobytes(), bands[r].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), *(pa.array(v.view(np.int64)) for v in sets), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sig", "bands"],
                )

    return run


def posterior_bounds(threshold: float, miss: float, n_values: int = SIGNATURE, step: int = STEP_VALUES) -> np.ndarray:
    """Least number of equal values after each step at which a pair goes on: below it, P(similarity >= threshold | values so far) < miss, with a
    uniform prior. The posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(step, n_values + 1, step):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return np.array(out)


def _alive(a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices survive every step."""
    left, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, bound in enumerate(bounds):
        cols = slice(i * STEP_VALUES, (i + 1) * STEP_VALUES)
        equal = equal + (a[left, cols] == b[left, cols]).sum(1)
        ok = equal >= bound
        left, equal = left[ok], equal[ok]
    return left


def _prune(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SIGNATURE) for c in (2, 3))
            keep = pa.array(_alive(a, b, bounds), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return run


def common_sizes(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs of two lists of sets, as products of incidence matrices over the elements that occur more than once."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.cumsum(count > 1) - 1
    ok = count[which] > 1
    owner, column = owner[ok], often[which[ok]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        i, j = np.searchsorted(column, [lo, lo + columns])
        x = np.zeros((len(sets), columns), np.float32)
        x[owner[i:j], column[i:j] - lo] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out.astype(np.int64)


def _block_pairs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, list[dict], list[dict]]]:
    """band, whether both sides are one block, and the members of both sides."""
    for row in range(batch.num_rows):
        band, same, left, right = (c[row].as_py() for c in batch.columns)
        yield band, same, left, left if same else right


def _across(left: list[dict], right: list[dict], same: bool, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of the left side, with those of the right side that lie in another component and whose signature survives every step."""
    comps = np.array([r["component"] for r in right])
    sigs = np.frombuffer(b"".join(r["sig"] for r in right), "<u2").reshape(-1, SIGNATURE)
    for i, r in enumerate(left):
        at = np.flatnonzero(comps != r["component"])
        at = at[at > i] if same else at
        if len(at):
            own = np.broadcast_to(np.frombuffer(r["sig"], "<u2"), (len(at), SIGNATURE))
            yield i, at[_alive(own, sigs[at], bounds)]


def _meet_blocks(bounds: np.ndarray):
    """The members of a bucket that have a surviving pair across components, of pairs whose first common band this is: such a pair meets in each of
    its common bands, and one is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, same, left, right in _block_pairs(batch):
                keys = [np.array([r["marks"] for r in side], np.int32) for side in (left, right)]
                own = np.int64(band).astype(np.int32)
                found: dict[int, int] = {}
                for i, at in _across(left, right, same, bounds):
                    first = (keys[1][at] == keys[0][i]).argmax(1)
                    at = at[keys[0][i][first] == own]
                    if len(at):
                        found[left[i]["doc_id"]] = left[i]["n_shingles"]
                        found.update((right[j]["doc_id"], right[j]["n_shingles"]) for j in at)
                ids = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([band] * len(ids), ids, [found[i] for i in ids])], ["band", "doc_id", "n_shingles"])

    return run


def _link_blocks(percent: int):
    """Links between members of two blocks of a bucket, across components, on full sets. Of the links found, those are returned that join components not
    yet joined here, so at most one for each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, same, left, right in _block_pairs(batch):
                x, y = ([np.frombuffer(r["set"], U) for r in side] for side in (left, right))
                common = common_sizes(x, y)
                sizes = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None, :]
                linked = (common > 0) & (100 * common >= percent * (sizes - common))
                linked &= np.array([r["component"] for r in left])[:, None] != np.array([r["component"] for r in right])[None, :]
                root: dict[int, int] = {}

                def top(c: int) -> int:
                    while root.get(c, c) != c:
                        c = root[c]
                    return c

                found = []
                for i, j in zip(*np.nonzero(np.triu(linked) if same else linked)):
                    p, q = top(left[i]["component"]), top(right[j]["component"])
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        found.append((left[i]["doc_id"], right[j]["doc_id"]))
                if found:
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, starts, ends = text_bytes(batch.column(1))
            out = []
            for s, e in zip(starts, ends):
                x, _ = shingle_sets(LOWER[b[s:e]], np.array([0]), np.array([e - s]), k)
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "set"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                p, q = np.frombuffer(x, U), np.frombuffer(y, U)
                common = len(np.intersect1d(p, q, assume_unique=True))
                if common and 100 * common >= percent * (len(p) + len(q) - common):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as (node, smallest node that they reach)."""
    sides = [np.concatenate(x) for x in zip(*((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows))]
    if not sides:
        return
    nodes, at = np.unique(np.concatenate(sides), return_inverse=True)
    a, b = at[: len(sides[0])], at[len(sides[0]) :]
    top = np.arange(len(nodes))
    while (top[a] != top[b]).any():
        least = np.minimum(top[a], top[b])
        np.minimum.at(top, top[a], least)
        np.minimum.at(top, top[b], least)
        while (top[top] != top).any():
            top = top[top]
    below = np.flatnonzero(top != np.arange(len(nodes)))
    for i in range(0, len(below), 1 << 16):
        some = below[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[top[some]])], ["a", "b"])


def components(edges: DataFrame, per_task: int = EDGES) -> DataFrame:
    """node, component (smallest node reachable) for every node of the undirected edges (a, b).

    Each task joins its own links into trees, about ``per_task`` of them; where one task has them all, that is the result. Else alternating large- and
    small-star steps follow, each a grouped minimum and a join, until nothing changes. Every step is checkpointed."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(light(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    tasks = max(1, -(-edges.count() // per_task))
    edges = materialize(edges.coalesce(tasks).transform(mapped, _trees, "a long, b long"))
    state, before = None, ()
    while tasks > 1 and state != before:
        pairs = both(edges)
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = pairs.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        edges = materialize(large.join(least, "a").select(ends.alias("e")).select("e.a", "e.b").where("a <> b").distinct().coalesce(tasks))
        before, state = state, edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by Jaccard similarity >= threshold of their k-word shingle sets (A-Z lower-cased; words are runs of other
    bytes than ASCII white space; fewer than k words: the whole sequence is the one shingle).

    Returns doc_id, n_shingles, component_id (smallest id reachable, itself included), kept (doc_id = component_id).

    Null or empty text, or no words: an empty set, linked with nothing. Null id: linked with nothing, component_id null, kept. Rows that repeat an
    id are one document: they share the links of all of them. Empty table: empty result. Other columns are not read.
    """
    percent = round(threshold * 100)
    own = documents_input(docs, id_col, text_col)
    sketch = materialize(own.transform(mapped, _sketch(k), "doc_id long, n_shingles long, set_a long, set_b long, sig binary, bands array<long>"))
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    keys = ["set_a", "set_b", "n_shingles"]
    placed = materialize(light(full.select("doc_id", *keys)))
    classes = materialize(light(placed.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))))
    n_full = classes.agg(F.sum("copies")).first()[0] or 0
    # One row stands for each class: the sketch of its representative. Only the copies' ids travel, not the sketches.
    copies = by_class(placed, classes, keys, "copies", n_full).where("doc_id <> rep").select("doc_id", *keys)
    reps = matching(full, copies, "left_anti").select("doc_id", "n_shingles", "sig", "bands")
    # An id with several texts may be in several classes: their representatives are linked.
    repeated = materialize(light(placed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")))
    held = docs.sparkSession.createDataFrame([], "a long, b long")
    if repeated.limit(1).count():
        reps = reps.distinct()
        held = matching(placed, repeated, "left_semi").join(classes, keys).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    members = reps.select("doc_id", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    # From here on only documents that share a bucket play a part.
    shared = materialize(members.join(buckets.select("band", "pivot"), "band"))
    bounds = posterior_bounds(threshold, miss)
    # The place of a pair's first common band is found with 32 bits of each band's key.
    marks = F.transform("bands", lambda b: F.shiftright(F.shiftleft(b, 32), 32).cast("int"))
    sigs = materialize(matching(reps.select("doc_id", "n_shingles", "sig", marks.alias("marks")), shared.select("doc_id"), "left_semi"))

    def with_signatures(pairs: DataFrame) -> DataFrame:
        """Pairs (pivot, member) with both signatures; that of a pivot with a great part of the pairs goes to every task."""
        pairs = materialize(light(pairs))
        often = pairs.groupBy("a").agg(F.count("*").alias("n"))
        x = by_class(pairs, often.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a"), ["a"], "n", pairs.count())
        return x.join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b")

    def sets_of(ids: DataFrame) -> DataFrame:
        """Full sets, made of the documents in question only."""
        return materialize(matching(own, ids, "left_semi").transform(mapped, _sets(k), "doc_id long, set binary").where(F.length("set") > 0).dropDuplicates())

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that hold on full sets."""
        pairs = materialize(light(pairs.distinct()))
        sets = sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))))
        x = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
        x = x.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
        return materialize(light(x.transform(mapped, _exact(percent), "a long, b long").distinct()))

    star = shared.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    edges = verified(with_signatures(star).transform(mapped, _prune(bounds), "a long, b long")).union(held)
    found = materialize(light(components(edges)))

    def component(df: DataFrame, c: str) -> DataFrame:
        name = "component" if c != "pivot" else "main"
        return df.join(found.select(F.col("node").alias(c), F.col("component").alias(name)), c, "left").withColumn(name, F.coalesce(name, F.col(c)))

    # Side 0 of a bucket is the component of its pivot, side 1 are all others.
    members = materialize(component(component(shared, "doc_id"), "pivot").select("band", "doc_id", "component", (F.col("component") != F.col("main")).cast("int").alias("side")))

    def sized(members: DataFrame) -> tuple[DataFrame, int]:
        """Members of the buckets that have a side 1, with the sizes of both sides, and the largest bucket's size. A member counts its weight."""
        n0, n1 = F.sum((1 - F.col("side")) * F.col("weight")), F.sum(F.col("side") * F.col("weight"))
        sizes = materialize(light(members.groupBy("band").agg(n0.alias("n0"), n1.alias("n1")).where("n1 > 0")))
        return members.join(sizes, "band"), sizes.agg(F.max(F.col("n0") + F.col("n1"))).first()[0] or 0

    def compared(members: DataFrame, largest: int, columns: list[str], block: int, kernel, schema: str) -> DataFrame:
        """The kernel over all pairs of blocks of each bucket but those of two blocks of side 0. members: band, doc_id, component, side, the sizes of
        both sides and the columns. A bucket of one block, as nearly all are, needs no join, so its rows are shuffled once."""
        x = members.withColumn("one", F.col("n0") + F.col("n1") <= block).withColumn("side", F.when(F.col("one"), 0).otherwise(F.col("side")))
        x = x.withColumn("b0", F.ceil(F.col("n0") / block).cast("int")).withColumn("b1", F.ceil(F.col("n1") / block).cast("int"))
        x = x.withColumn("block", F.when(F.col("one"), 0).otherwise(F.expr("pmod(xxhash64(doc_id), if(side = 0, b0, b1))").cast("int")))
        place = ["band", "side", "block"]

        def blocks(which: str) -> DataFrame:
            # Dealt by block, not by band: a bucket of any size is many tasks' work.
            dealt = x.where(which).repartition(shuffle_partitions(docs.sparkSession), *place)
            return dealt.groupBy(*place, "b0", "b1").agg(F.collect_list(F.struct("doc_id", "component", *columns)).alias("rows"))

        pairs = blocks("one").select("band", F.lit(True).alias("same"), F.col("rows").alias("left_rows"), F.slice("rows", 1, 0).alias("right_rows"))
        if largest > block:
            many = materialize(blocks("NOT one"))
            meets = F.expr("concat(transform(sequence(block, b1 - 1), j -> struct(1 AS side, j AS j)), if(b0 = 0, array(), transform(sequence(0, greatest(b0, 1) - 1), j -> struct(0 AS side, j AS j))))")
            left = many.where("side = 1").select("band", F.col("block").alias("i"), F.col("rows").alias("left_rows"), F.explode(meets).alias("m")).select("band", "i", "left_rows", "m.side", "m.j")
            right = many.select("band", "side", F.col("block").alias("j"), F.col("rows").alias("right_rows"))
            met = left.join(right, ["band", "side", "j"])
            pairs = pairs.union(met.select("band", ((F.col("side") == 1) & (F.col("i") == F.col("j"))).alias("same"), "left_rows", "right_rows"))
        return materialize(light(pairs.transform(mapped, kernel, schema).distinct()))

    # Signatures first; full sets travel only to buckets where a pair across components survives, and of its common bands to the first.
    inside, largest = sized(members.withColumn("weight", F.lit(1)))
    met = compared(inside.join(sigs, "doc_id"), largest, ["n_shingles", "sig", "marks"], BLOCK, _meet_blocks(bounds), "band long, doc_id long, n_shingles long")
    # A long set counts for several, so that a block's bytes are bounded as well.
    heavy = met.select("band", "doc_id", (1 + F.floor(F.col("n_shingles") * 8 * SET_BLOCK / SET_BYTES)).alias("weight"))
    again, largest = sized(heavy.join(inside.select("band", "doc_id", "component", "side"), ["band", "doc_id"]))
    again = again.join(sets_of(met.select("doc_id")), "doc_id")
    extra = compared(again, largest, ["set"], SET_BLOCK, _link_blocks(percent), "a long, b long")
    if extra.limit(1).count():
        found = materialize(light(components(edges.union(extra))))
    last = component(classes.withColumnRenamed("rep", "doc_id"), "doc_id").select(*keys, "copies", F.col("component").alias("component_id"))
    linked = by_class(placed, materialize(light(last)), keys, "copies", n_full)
    return (
        linked.select("doc_id", "n_shingles", "component_id")
        .union(sketch.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
