"""Benchmark decontamination by winnowed k-gram fingerprints.

Both sides keep the smallest hash of every ``w`` consecutive k-grams of words. A shared span of k + w - 1 words (the window of the contamination
rule) has the same smallest hash on both sides, so it always shares a fingerprint. Each shared fingerprint is extended word by word, and the
windows in which all words agree are hits. Items shorter than a window count as one window of their own length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import ALNUM, LOWER, STEP, U, carried, gram_hashes, groups, mapped, materialize, merged, mix, sliding, span_hashes, text_bytes, word_spans

#: Words of a window, and of a fingerprinted k-gram.
WINDOW, GRAM = 13, 7
#: The benchmark is held by every task up to this many bytes of text; beyond, fingerprints are joined.
HELD_BYTES = 16 << 20
_SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents, and each one's number of words."""
    b = LOWER[b]
    s, e, n = word_spans(b, starts, ends, ALNUM)
    return span_hashes(b, s, e), n


def fingerprints(words: np.ndarray, n: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the k-grams start that are the smallest (each, at ties) of some window within a document, and their hashes."""
    width = window - k + 1
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, U)
    grams = gram_hashes(words, k)
    least = sliding(grams, width)
    left = np.repeat(np.cumsum(n), n)[: len(least)] - np.arange(len(least))
    least[left < window] = 0  # no window of one document starts here; no hash is as small
    padded = np.concatenate([np.zeros(width - 1, U), least, np.zeros(width - 1, U)])
    at = np.flatnonzero(sliding(padded, width, np.maximum) == grams)
    at = at[grams[at] > 0]
    return at, grams[at]


class Benchmark:
    """Words and sorted fingerprints of the items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, k: int = GRAM) -> None:
        self.window, self.k, self.names = window, min(k, window), [i for i, _ in items]
        size = np.array([len(t) for _, t in items], np.int64)
        ends = np.cumsum(size)
        self.words, self.n = words_of(np.frombuffer(b"".join(t for _, t in items), np.uint8), ends - size, ends)
        self.first = np.cumsum(self.n) - self.n
        at, h = fingerprints(self.words, self.n, window, self.k)
        owner = np.repeat(np.arange(len(items)), self.n)
        # Where a fingerprint has the same words around it, as far as its windows reach, one place stands for all: a repetitive item has few.
        order, self.group = _distinct(h, self._around(at, owner), owner[at])
        self.at, self.hash, self.owner = at[order], h[order], owner
        #: Items shorter than a window: length -> (sorted distinct hashes, the items of each).
        self.short = {}
        for length in sorted({int(x) for x in self.n if 0 < x < window}):
            own = np.flatnonzero(self.n == length)
            h = np.array([gram_hashes(self.words[self.first[i] : self.first[i] + length], length)[0] for i in own], U)
            order, group = _distinct(h, np.zeros(len(h), U), own)
            self.short[length] = (h[order], group)

    def _around(self, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Hash of the words from where the earliest window with the k-gram begins to where the latest one ends; beyond the item there are none."""
        h = np.zeros(len(at), U)
        for step in range(self.k - self.window, self.window):
            x = at + step
            inside = (x >= 0) & (x < len(self.words))
            x = np.where(inside, x, 0)
            inside &= owner[x] == owner[at]
            h = mix(h * U(0x9E3779B97F4A7C15) + np.where(inside, self.words[x] | U(1), U(0)))
        return h

    def hits(self, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words lie in an occurrence of a window, and the distinct (document, item) pairs as document * items + item."""
        hit, found = np.zeros(len(words) + 1, np.int32), []
        doc = np.repeat(np.arange(len(n)), n)
        at, h = fingerprints(words, n, self.window, self.k)
        i, j = _matches(h, self.hash)
        if len(i):
            d, g = self._extend(words, doc, at[i], j, hit)
            found.append(self._pairs(d, g, self.group))
        for length, (known, group) in self.short.items():
            if len(words) < length:
                continue
            h = gram_hashes(words, length)
            ok = np.flatnonzero(doc[: len(h)] == doc[length - 1 :])
            i, j = _matches(h[ok], known)
            np.add.at(hit, ok[i], 1)
            np.add.at(hit, ok[i] + length, -1)
            found.append(self._pairs(doc[ok[i]], j, group))
        return np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def _pairs(self, doc: np.ndarray, place: np.ndarray, group: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """(document, item) of the distinct (document, place); group: where each place's items begin, and the items."""
        if not len(doc):
            return np.zeros(0, np.int64)
        begins, items = group
        both = np.unique(doc.astype(np.int64) * (len(begins) - 1) + place)
        d, g = both // (len(begins) - 1), both % (len(begins) - 1)
        n = begins[g + 1] - begins[g]
        which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[g], n)
        return np.unique(np.repeat(d, n) * len(self.names) + items[which])

    def _extend(self, words: np.ndarray, doc: np.ndarray, here: np.ndarray, place: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks the windows that agree word by word around each shared fingerprint; the distinct (document, place) of those there are."""
        reach, found = self.window - self.k, []
        for lo in range(0, len(here), 1 << 15):
            a, p = here[lo : lo + (1 << 15)], place[lo : lo + (1 << 15)]
            b = self.at[p]
            d, own = doc[a], self.owner[b]
            step = np.arange(-reach, self.window)
            x, y = a[:, None] + step, b[:, None] + step
            inside = (x >= 0) & (x < len(words)) & (y >= 0) & (y < len(self.words))
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            same = inside & (words[x] == self.words[y]) & (doc[x] == d[:, None]) & (self.owner[y] == own[:, None])
            run = np.cumsum(same, axis=1)
            run = np.concatenate([np.zeros((len(a), 1), run.dtype), run], axis=1)
            r, c = np.nonzero(run[:, self.window :] - run[:, : -self.window] == self.window)
            start = a[r] - reach + c
            np.add.at(hit, start, 1)
            np.add.at(hit, start + self.window, -1)
            found.append(np.unique(np.column_stack([d[r], p[r]]), axis=0))
        d, p = np.concatenate(found).T
        return d, p


def _distinct(h: np.ndarray, around: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """One row of each distinct (h, around), in the order of h, and the owners of each: where they begin, and they themselves."""
    order = np.lexsort((owner, around, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (around[order][1:] != around[order][:-1])
    width = int(owner.max(initial=0)) + 1
    both = np.unique((np.cumsum(new) - 1) * width + owner[order])
    return order[new], (np.searchsorted(both // width, np.arange(int(new.sum()) + 1)), both % width)


def _matches(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) with h[i] == known[j]; known is sorted."""
    if not len(known) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    i = np.flatnonzero(known[at] == h)
    lo, hi = at[i], np.searchsorted(known, h[i], "right")
    n = hi - lo
    return np.repeat(i, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _verdicts(words: np.ndarray, n: np.ndarray, bench: Benchmark) -> list[tuple[int, int, int, str, bool]]:
    hit, pairs = bench.hits(words, n)
    at = np.cumsum(n)
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[at] - total[at - n]
    names: dict[int, list[str]] = {}
    for p in pairs.tolist():
        names.setdefault(p // len(bench.names), []).append(bench.names[p % len(bench.names)])
    none = hashlib.sha256(b"").hexdigest()
    out = []
    for d in range(len(n)):
        own = sorted(set(names.get(d, [])))
        out.append((int(n[d]), int(n_hit[d]), len(own), hashlib.sha256(",".join(own).encode()).hexdigest() if own else none, bool(n_hit[d] > 0 and 20 * n_hit[d] >= n[d])))
    return out


def _columns(rows: list[tuple]) -> list[pa.Array]:
    x = list(zip(*rows)) if rows else [()] * 5
    return [pa.array(c, t) for c, t in zip(x, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))]


_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _with_carried(batch: pa.RecordBatch, rows: list[tuple], own: int) -> pa.RecordBatch:
    """Verdicts, and behind them the text and what lies after the operator's own columns, if anything does."""
    at = [1, *range(own, batch.num_columns)] if batch.num_columns > own else []
    return pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows), *(batch.column(i) for i in at)], [*_NAMES, *(batch.schema.names[i] for i in at)])


def _held(items, window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(items.value, window, k)
        for batch in batches:
            b, starts, ends = text_bytes(batch.column(1))
            rows = []
            for i, j in groups(starts, ends, STEP, 1 << 20) if batch.num_rows else []:
                lo = int(starts[i])
                words, n = words_of(b[lo : int(ends[j - 1])], starts[i:j] - lo, ends[i:j] - lo)
                rows += _verdicts(words, n, bench)
            yield _with_carried(batch, rows, 2)

    return run


def _reported(window: int, k: int, side: str, lengths: tuple[int, ...]):
    """(fingerprint, id) rows, each once for a text; items shorter than a window give their own kind of fingerprint, documents those of such lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text", STEP):
            b, starts, ends = text_bytes(batch.column(1))
            words, n = words_of(b, starts, ends)
            at, h = fingerprints(words, n, window, k)
            doc = np.repeat(np.arange(len(n)), n)
            kinds = [(np.zeros(len(h), np.int64), h, doc[at])]
            for length in lengths:
                x = gram_hashes(words, length)
                ok = np.flatnonzero(doc[: len(x)] == doc[length - 1 :]) if len(x) else np.zeros(0, np.int64)
                if side == "item":
                    ok = ok[n[doc[ok]] == length]
                kinds.append((np.full(len(ok), length), x[ok], doc[ok]))
            kind, h, d = (np.concatenate(c) for c in zip(*kinds))
            order = np.lexsort((d, h, kind))
            kind, h, d = kind[order], h[order], d[order]
            new = np.ones(len(order), bool)
            new[1:] = (kind[1:] != kind[:-1]) | (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            kind, h, d = kind[new], h[new], d[new]
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(h.view(np.int64)), batch.column(0).take(pa.array(d))], ["kind", "fp", side])

    return run


def _pairwise(window: int, k: int):
    """doc_id, text, items (id, text): the verdict of each row on its own candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            b, starts, ends = text_bytes(batch.column(1))
            for s, e, items in zip(starts, ends, batch.column(2).to_pylist()):
                words, n = words_of(b[s:e], np.array([0]), np.array([e - s]))
                rows += _verdicts(words, n, Benchmark([(x["item"], (x["item_text"] or "").encode()) for x in items or []], window, k)) if items else [(int(n[0]), 0, 0, hashlib.sha256(b"").hexdigest(), False)]
            yield _with_carried(batch, rows, 3)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", held_bytes: int = HELD_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Words of documents that lie in an occurrence of a benchmark window (``window`` consecutive words of an item; a shorter item is one window).

    Returns doc_id, n_words, n_hit, n_items (items with occurring windows), items_sha256 (their ids, sorted as text, comma-joined), contaminated
    (n_hit > 0 and 20 * n_hit >= n_words).

    A benchmark of at most ``held_bytes`` of text goes to every task, and documents are not shuffled at all. A larger one is found by a join of
    fingerprints. Null or empty text: no words, not contaminated. Null document id: judged like any other. Null item ids are no items; a repeated
    item counts once. Repeated documents are judged each. Empty tables: no hits, or no rows. Other columns are not read,
    but for those to carry: they and the text come back beside each row's own verdict.
    """
    spark = docs.sparkSession
    k = min(k, window)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(carry or []))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if size <= held_bytes:
        known = spark.sparkContext.broadcast([(r.item, r.text.encode()) for r in items.collect()])
        return own.transform(mapped, _held(known, window, k), f"doc_id long, {_SCHEMA}" + carried(own, carry))
    # Rows have no key of their own that is sure to be unique, so each gets one that is written down before it is used twice.
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()))
    theirs = materialize(items.select("item", "text").transform(mapped, _reported(window, k, "item", tuple(range(1, window))), "kind long, fp long, item string").distinct())
    lengths = tuple(sorted(r.kind for r in theirs.where("kind > 0").select("kind").distinct().collect()))
    ours = own.select("row", "text").transform(mapped, _reported(window, k, "row", lengths), "kind long, fp long, row long")
    pairs = ours.join(theirs, ["kind", "fp"]).select("row", "item").distinct()
    listed = pairs.join(items.select("item", F.col("text").alias("item_text")), "item").groupBy("row").agg(F.collect_set(F.struct("item", "item_text")).alias("items"))
    return own.join(listed, "row", "left").select("doc_id", "text", "items", *(carry or [])).transform(mapped, _pairwise(window, k), f"doc_id long, {_SCHEMA}" + carried(own, carry))
