"""Cross-entropy difference of two matched bigram models.

The target model counts documents of the wanted kind, the background model all documents. Both count every word and every bigram of the corpus, each
under its own 64-bit fingerprint. Documents are packed into blocks; a block sends each of its distinct n-grams once, with its counts, to the slice of
the fingerprint's range, which adds the counts of all blocks up and sends the totals back in the same order. So a frequent n-gram is one entry of a
block, nothing but a slice or a block is ever held, and the tables grow with the corpus. A document is scored by what the other documents say: its own
counts are taken out of each model that counted it. Its score is the mean over its tokens of background loss minus target loss: higher is nearer the
target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import LOWER, NOT_SPACE, STEP, U, groups, mapped, materialize, mix, pack, shuffle_partitions, span_hashes, text_bytes, unpack, word_spans

#: Bytes of text of a block, and of text for each slice of the fingerprints; the least number of slices (as a power of 2); weight of the bigram estimate.
BLOCK_BYTES, SLICE_BYTES, SLICE_BITS, BIGRAM_WEIGHT = 8 << 20, 16 << 20, 8, 0.6

_SUMS = ["n_words", "n_own", "n_all", "own_starts", "all_starts"]


def ngrams(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of each word (even) and of its bigram (odd), and each document's number of words. A document's first word follows 0, the start."""
    words, pairs, counts = [], [], []
    for i, j in groups(starts, ends, STEP, 1 << 20):
        lo = int(starts[i])
        part = b[lo : int(ends[j - 1])]
        s, e, n = word_spans(part, starts[i:j] - lo, ends[i:j] - lo, NOT_SPACE)
        h = span_hashes(LOWER[part], s, e)
        before = np.zeros_like(h)
        before[1:] = h[:-1]
        before[(np.cumsum(n) - n)[n > 0]] = 0
        words.append(h & ~U(1))
        pairs.append(mix(before * U(0x9E3779B97F4A7C15) + h) | U(1))
        counts.append(n)
    if not counts:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(pairs), np.concatenate(counts)


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def cut() -> pa.RecordBatch:
            text, lengths, wanted, ids = zip(*held)
            ids = pa.concat_arrays(ids)
            text = b"".join(text)
            columns = [pa.array([task << 32 | number], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([zstandard.ZstdCompressor(level=3).compress(text)], pa.binary())]
            columns.append(pa.array([pack(np.concatenate(lengths).astype("<i8"), np.concatenate(wanted).astype("u1"))], pa.binary()))
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], ["block", "n_bytes", "texts", "docs", "ids"])

        for batch in batches:
            b, starts, ends = text_bytes(batch.column(1))
            wanted = np.array(batch.column(2).to_pylist(), bool)
            for i, j in groups(starts, ends, max(block_bytes // 8, 1), 1 << 16):
                text = b[starts[i] : ends[j - 1]].tobytes()
                # Documents without text take room too.
                if held and size + len(text) + 16 * (j - i) > block_bytes:
                    yield cut()
                    held, size, number = [], 0, number + 1
                held.append((text, ends[i:j] - starts[i:j], wanted[i:j], batch.column(0).slice(i, j - i)))
                size += len(text) + 16 * (j - i)
        if held:
            yield cut()

    return run


def _open(texts: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's bytes, where each text starts and ends, and which are wanted."""
    lengths, wanted = unpack(docs, "<i8", "u1")
    ends = np.cumsum(lengths)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8), ends - lengths, ends, wanted.astype(bool)


def _count(bits: int):
    """Of each block and slice: the distinct n-grams in ascending order with their counts, and how many texts with words there are (in one row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts, docs in zip(*(c.to_pylist() for c in batch.columns)):
                b, starts, ends, wanted = _open(texts, docs)
                words, pairs, n = ngrams(b, starts, ends)
                inside = np.repeat(wanted, n)
                keys, all_ = np.unique(np.concatenate([words, pairs]), return_counts=True)
                own = np.bincount(np.searchsorted(keys, np.concatenate([words[inside], pairs[inside]])), minlength=len(keys))
                at = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1).astype(U))
                slices = np.flatnonzero(np.diff(at))
                payload = [pack(np.diff(keys[i:j], prepend=U(0)), own[i:j].astype("<u4"), all_[i:j].astype("<u4")) for i, j in zip(at[slices], at[slices + 1])]
                starts = [[int((n > 0)[wanted].sum()), int((n > 0).sum())]] + [[0, 0]] * len(slices)
                own_starts, all_starts = zip(*starts[: len(slices)]) if len(slices) else ((), ())
                columns = [pa.array(slices, pa.int32()), pa.array([block] * len(slices), pa.int64()), pa.array(payload, pa.binary()), pa.array(own_starts, pa.int64()), pa.array(all_starts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "block", "payload", "own_starts", "all_starts"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """Rows that lie together and agree in a column."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[column] != held[0][column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _runs(batches, 0):
        parts = [unpack(r[2], "<u8", "<u4", "<u4") for r in rows]
        keys, at = np.unique(np.concatenate([np.cumsum(p[0], dtype=U) for p in parts]), return_inverse=True)
        # Whole numbers add up exactly in double precision.
        own, all_ = (np.bincount(at, np.concatenate([p[side] for p in parts])).astype("<u8") for side in (1, 2))
        # How often each word occurs in the models and how many words there are, said once for each slice.
        word = (keys & U(1)) == 0
        sums = (int(word.sum()), int(own[word].sum()), int(all_[word].sum()), sum(r[3] for r in rows), sum(r[4] for r in rows))
        i = 0
        for k, (r, p) in enumerate(zip(rows, parts)):
            mine = at[i : i + len(p[0])]
            i += len(mine)
            said = sums if k == 0 else (0,) * 5
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((r[1], r[0], pack(own[mine], all_[mine]), *said), (pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 5))], ["block", "slice", "counts", *_SUMS])


def losses(word: np.ndarray, pair: np.ndarray, history: np.ndarray, total: np.ndarray) -> np.ndarray:
    """-log p from counts of words, their bigrams and the words before: bigram and add-one unigram estimates, interpolated."""
    return -np.log(BIGRAM_WEIGHT * pair / np.maximum(history, 1.0) + (1 - BIGRAM_WEIGHT) * (word + 1.0) / total)


def _within(doc: np.ndarray, at: np.ndarray, n_keys: int) -> np.ndarray:
    """How often each token's n-gram is in its own document."""
    _, which, count = np.unique(doc * n_keys + at, return_inverse=True, return_counts=True)
    return count[which].astype(np.float64)


def _score(totals: tuple[float, float], first: tuple[int, int]):
    """totals: tokens of each model and distinct words of both; first: documents with words of each model, which its starts number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The texts (slice -1) come first, then the counts by ascending slice, which is the order of the n-grams.
        for (_, _, texts, docs, ids, _), *answers in _runs(batches, 0):
            *text, wanted = _open(texts, docs)
            words, pairs, n = ngrams(*text)
            keys = np.unique(np.concatenate([words, pairs]))
            sides = [np.concatenate(x) for x in zip(*(unpack(a[5], "<u8", "<u8") for a in answers))] if answers else [np.zeros(0, "<u8")] * 2
            if len(sides[0]) != len(keys):
                raise RuntimeError(f"{len(sides[0])} counts for {len(keys)} n-grams")
            at, pair_at, doc, found = np.searchsorted(keys, words), np.searchsorted(keys, pairs), np.repeat(np.arange(len(n)), n), []
            start = (np.cumsum(n) - n)[n > 0]
            own_words, own_pairs = _within(doc, at, len(keys)), _within(doc, pair_at, len(keys))
            for counts, total, starts, inside in zip(sides, totals, first, (wanted[doc], np.ones(len(doc), bool))):
                word = counts[at] - np.where(inside, own_words, 0)
                history = np.zeros_like(word)
                history[1:] = word[:-1]
                history[start] = starts - inside[start]
                pair = counts[pair_at] - np.where(inside, own_pairs, 0)
                found.append(np.bincount(doc, losses(word, pair, history, total - np.where(inside, n[doc], 0)), len(n)) / np.maximum(n, 1))
            t, g = found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(t), pa.array(g), pa.array(g - t)], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def cross_entropy_difference(docs: DataFrame, target: str | Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (mean nats per token), score (their difference: higher is more like the target).

    target: a boolean column or expression that marks the documents of the target model; null is false. Tokens are runs of bytes other than ASCII
    white space, A-Z lower-cased. A row's own counts are left out of the background model, and of the target model if it is one of its rows. Null or
    empty text: no tokens, losses and score 0. Null id: counted and scored. Repeated rows: each, as one more document. No target rows: the target
    model is uniform. Empty table: empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    marked = F.coalesce((F.col(target) if isinstance(target, str) else target).cast("boolean"), F.lit(False))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), marked.alias("wanted"))
    blocks = materialize(own.transform(mapped, _blocks(block_bytes), "block long, n_bytes long, texts binary, docs binary, ids array<long>"))
    size = blocks.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    bits = max(SLICE_BITS, (size.bytes // SLICE_BYTES).bit_length())
    parts = shuffle_partitions(spark)
    counts = blocks.select("block", "texts", "docs").transform(mapped, _count(bits), "slice int, block long, payload binary, own_starts long, all_starts long")
    counts = counts.repartition(max(parts, 1 << bits - 2), "slice").sortWithinPartitions("slice", "block")
    answers = materialize(counts.transform(mapped, _add, "block long, slice int, counts binary, " + ", ".join(f"{c} long" for c in _SUMS)))
    sums = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS)).first()
    kinds = {"texts": "binary", "docs": "binary", "ids": "array<long>", "counts": "binary"}
    rows = lambda df, slice_: df.select("block", slice_.alias("slice"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
    met = rows(blocks, F.lit(-1)).union(rows(answers, F.col("slice"))).repartition(max(parts, size.n), "block").sortWithinPartitions("block", "slice")
    score = _score((float(sums.n_own + sums.n_words), float(sums.n_all + sums.n_words)), (sums.own_starts, sums.all_starts))
    return met.transform(mapped, score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
