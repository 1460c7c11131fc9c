"""Toxicity by compression distance.

Two Zstandard dictionaries are trained on the labelled rows: one of text that marks toxic documents, one of text that marks ordinary ones. Each
window of a document is compressed with both; by how many bytes the toxic dictionary does better is the window's gain. A document's gains (total,
windows beyond a threshold, share) are calibrated on held-back training rows, so a score is a probability.

Dictionary training: taken from text as it is (by the library's own trainer), the two dictionaries tell the classes apart hardly better than chance,
since nearly all of a toxic document is ordinary language, so the training is by contrast. Word beginnings that are significantly more frequent (a lower against an upper confidence bound) in documents of one class
are its segments; they are laid down by rising value, so the best get the shortest offsets.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import carried, mapped

#: Bound on labelled documents that a model is fitted on, for each class, and on bytes of one that training reads (a document beyond is left out).
TRAIN_DOCS, TRAIN_BYTES = 2000, 1 << 16
#: Words of a window; bytes of each part of a dictionary, of which the best segments get as many as fit; gain from which a window counts as marked.
WINDOW, DICTIONARY, MARKED = 6, 4096, 2
#: Folds of the cross-fitting.
FOLDS = 4
#: Both dictionaries end with this and every window starts with it: so each frame holds a match anyhow, and a further one shows at its full worth.
PREAMBLE = b"\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1d\x1e\x1f"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PARAMS = dict(window_log=14, hash_log=13, chain_log=13, search_log=6, min_match=5, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]


def _words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def _copy_marks(words: list[bytes]) -> list[int]:
    """Two minima of hashed 4-word shingles: near copies nearly always share one, other texts none."""
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    return [min(zlib.crc32(g) for g in grams), 1 << 32 | min(zlib.crc32(g, 77) for g in grams)]


def train_dictionaries(texts: list[bytes], toxic: list[int], size: int = DICTIONARY) -> tuple[bytes, bytes]:
    """Raw-content dictionaries (toxic, ordinary). Of near copies one counts."""
    begins, n, seen = (Counter(), Counter()), [0, 0], set()
    for text, y in zip(texts, toxic):
        listed = _words(text)
        marks = _copy_marks(listed)
        copy = any(m in seen for m in marks)
        seen.update(marks)
        if copy:
            continue
        words = {w.strip(b".,;:!?") for w in listed}
        n[y] += 1
        begins[y].update({w[:k] for w in words for k in range(4, 11) if len(w) >= k})
    found = []
    for y in (1, 0):
        mine, other, scored = begins[y], begins[1 - y], []
        for g, c in mine.items():
            if c < max(3, 0.012 * n[y]):
                continue
            low, high = (c - c**0.5) / max(n[y], 1), (other[g] + 2 * other[g] ** 0.5 + 1) / max(n[1 - y], 1)
            # Log-likelihood ratio against chance, for the many candidates.
            both, c0 = (c + other[g]) / (n[0] + n[1]), other[g]
            chance = c * np.log(c / n[y] / both) + (c0 * np.log(c0 / n[1 - y] / both) if c0 else 0)
            if low > 2 * high and chance > 9:
                scored.append((c * (len(g) - 2) * float(np.log(low / high)), g))
        # Of segments that begin alike the best one stays.
        stems, taken, begun = [], set(), set()
        for _, g in sorted(scored, reverse=True):
            if g not in begun and not any(g[:k] in taken for k in range(4, len(g))):
                stems.append(g)
                taken.add(g)
                begun.update(g[:k] for k in range(4, len(g) + 1))
        text = b""
        for g in stems:
            # With the space before it and no other neighbour, a segment matches the beginning of a word and nothing else.
            part = b" " + g + b"\0"
            if len(text) + len(part) > size:
                break
            text = part + text
        found.append(text.rjust(size, b"\0"))
    # Toxic text holds ordinary language too, so its dictionary does; both have it at the same distance, and differ in the marking part only.
    marking, common = found
    return common + marking + PREAMBLE, common + bytes(size) + PREAMBLE


class Scorer:
    """Compresses windows with both dictionaries of a model."""

    def __init__(self, toxic: bytes, ordinary: bytes, window: int = WINDOW) -> None:
        params = zstandard.ZstdCompressionParameters(**_PARAMS)
        self.window, self.press = window, []
        for content in (toxic, ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.press.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
        probe = PREAMBLE + bytes(range(0x80, 0xA8))
        self.plain = len(self.press[0](probe)) - len(probe)

    def features(self, text: bytes) -> tuple[float, ...]:
        words, k = _words(text), self.window
        toxic, ordinary = self.press
        total = marked = most = n = 0
        for i in range(0, len(words), k):
            w = PREAMBLE + b" " + b" ".join(words[i : i + k]) + b" "
            n += 1
            size = len(toxic(w))
            # Not below the size without a match: nothing gained over the other dictionary.
            if size < len(w) + self.plain:
                gain = len(ordinary(w)) - size
                if gain > 0:
                    total += gain
                    most = max(most, gain)
                    marked += gain >= MARKED
        return float(np.log1p(total)), float(np.log1p(marked)), float(min(most, 12)), float(np.log1p(100 * marked / max(n, 1))), float(np.log1p(n))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps: weights (intercept first) of standardised features, their means and scales."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge * len(x) / 100] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def fit(texts: list[bytes], toxic: list[int], window: int = WINDOW, rate: float | None = None) -> Model:
    """Cross-fitted: each fold's features come from dictionaries of the other folds, so the calibration sees unseen texts. Copies share a fold.
    rate is the share of toxic rows among all labelled ones, which the sample, bounded for each class, does not show.
    With no rows, or of one class only, the score is the smoothed base rate."""
    fold = [zlib.crc32(t) % FOLDS for t in texts]
    sampled = (sum(toxic) + 0.5) / (len(toxic) + 10)
    rate = sampled if rate is None else min(max(rate, 1e-6), 1 - 1e-6)
    flat = Model(b"\0" * 64 + PREAMBLE, b"\0" * 64 + PREAMBLE, (float(np.log(rate / (1 - rate))), 0.0, 0.0, 0.0, 0.0, 0.0), (0.0,) * 5, (1.0,) * 5)
    x, y = [], []
    for k in range(FOLDS):
        mine = [i for i, f in enumerate(fold) if f != k]
        if len({toxic[i] for i in mine}) < 2:
            continue
        scorer = Scorer(*train_dictionaries([texts[i] for i in mine], [toxic[i] for i in mine]), window)
        x += [scorer.features(texts[i]) for i, f in enumerate(fold) if f == k]
        y += [toxic[i] for i, f in enumerate(fold) if f == k]
    if len(set(y)) < 2:
        return flat
    w, mean, scale = calibrate(np.array(x), np.array(y, float))
    w[0] += np.log(rate / (1 - rate)) - np.log(np.mean(y) / (1 - np.mean(y)))
    # The calibration holds for dictionaries of this kind; the ones in use see all rows.
    final = train_dictionaries(texts, toxic)
    return Model(*final, tuple(w.tolist()), tuple(mean.tolist()), tuple(scale.tolist()))


def _score(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        scorer = Scorer(m.toxic, m.ordinary, window)
        w, mean, scale = np.array(m.weights), np.array(m.mean), np.array(m.scale)
        for batch in batches:
            x = np.array([scorer.features((t or "").encode()) for t in batch.column(1).to_pylist()]).reshape(-1, len(mean))
            p = 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[1:] + w[0], -30, 30)))
            ids = [None if i is None else zlib.crc32(str(i).encode()) % 5 == 0 for i in batch.column(0).to_pylist()]
            columns = [batch.column(0), pa.array(ids, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]
            # What is carried lies behind the id and the text.
            kept = batch.columns[1:] if batch.num_columns > 2 else []
            yield pa.RecordBatch.from_arrays([*columns, *kept], ["doc_id", "held_out", "score", "predicted", *(batch.schema.names[1:] if kept else [])])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES, window: int = WINDOW) -> Model:
    """Fits on at most ``max_docs`` labelled rows of each class, the first by hash of the id, of those with crc32(id) mod 5 other than 0. Of an id with
    several texts the smallest is learned from."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 5 <> 0")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()]
    label = {r.doc_id: r.y for r in picked}
    # At most 2 * max_docs ids, so the filter and its result are bounded.
    ids = docs.sparkSession.createDataFrame([(i,) for i in label], "doc_id long")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= max_bytes)
    rows = own.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect() if label else []
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text.encode() for r in rows], [label[r.doc_id] for r in rows], window, (n.get(1, 0) + 0.5) / (sum(n.values()) + 10))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = TRAIN_DOCS, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """Scores whole texts: doc_id, held_out (crc32(id as text) mod 5 is 0: never learned from), score (0 to 1), predicted (score >= 0.5).

    Null or empty text: scored as a text without windows. Null id: scored, held_out null. Repeated rows: scored each. Labels other than 0 and 1,
    or null: not learned from; an id with both labels counts as toxic. No usable labels: every score is a base rate. Empty table: empty result.
    Other columns are not read, but for those to carry: they and the text come back beside each row's own verdict.
    """
    model = train(docs, labels, id_col, text_col, label_col, max_docs, window=window)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(carry or []))
    return own.transform(mapped, _score(docs.sparkSession.sparkContext.broadcast(model), window), "doc_id long, held_out boolean, score double, predicted int" + carried(own, carry))
