"""Exact substring removal with a logarithmic family of sampled suffix arrays.

Every string of ``length`` bytes contains a k-byte *anchor*: the k-gram of smallest hash among its length - k + 1 ones. Equal strings have
equal anchors, so the positions of a document fall into runs (*segments*) that share an anchor, and a string can only repeat under its own.

1. Each input batch reports one entry for each segment (anchor, hash of the segment's bytes, place). Shards keep the entries in an
   ``IndexFamily``: a batch becomes a sorted array of suffix entries, is merge-scanned against the levels there are, and joins them as the
   lowest one; levels of equal size merge. A segment seen before is removed as a whole. What remains are the first copies of segments; those
   whose anchor has other segments too (the edges of repeated passages) are checked string by string.
2. For these, each ``length``-byte suffix prefix is an entry of a second family, dealt by its own hash, so no common line is one task's work.
3. Each document gets its removed ranges back and is cut.

Copies within a batch meet before the shuffle: a batch sends each distinct string at most once, whatever share of the rows a hot group has.
Entries are ordered by the 64-bit fingerprint of a suffix's first ``length`` bytes (with a second hash to confirm), not by the alphabet: only
equality over ``length`` bytes counts, and alphabetic order would need these bytes in the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import U, by_bucket, by_class, doc_group, light, mapped, materialize, merged, mix, pack, powers, prefix_hashes, shuffle_partitions, sliding, text_bytes, unpack

#: Bytes of one anchor. Any value up to ``length`` gives the same result; about half makes the two shuffles equally large.
ANCHOR = 50
#: Bytes of text that make up one batch of the index, and strings that are checked in one.
BATCH_BYTES, BATCH_STRINGS = 2 << 20, 1 << 18
#: Bytes of text for each shard of the index, which one task holds.
SHARD_BYTES = 32 << 20
#: An anchor with more distinct segments in one batch is a common line: its segments are checked by string at once, and the anchor's shard hears of
#: it by one mark, so a batch never sends a shard more than this for one anchor.
HOT_SEGMENTS = 8
_ROWS = "bucket int, kind int, payload binary"
_ENTRY = ("<u8", "<u8", "<i8", "<u4", "<u4")
_WINDOW = ("<u8", "<u4", "<i8", "<u4")
_RANGE = ("<i8", "<u4", "<u4", "<u1")


class IndexFamily:
    """Sorted arrays of suffix entries in levels of geometrically growing size.

    An entry is (fingerprint, confirmation, place...). ``add`` sorts a batch, scans it against every level and returns the entries that lose,
    that is, equal a string with a smaller place; the index keeps the winner. Levels at most twice as large as the newest merge into it.
    """

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []

    def add(self, *columns: np.ndarray) -> list[np.ndarray]:
        """columns: fingerprint, confirmation, document, position, more. Returns the same columns of the losers."""
        lost: list[list[np.ndarray]] = []
        batch = self._settle(list(columns), lost)
        for level in self.levels:
            at = np.searchsorted(level[0], batch[0])
            at[at == len(level[0])] = 0
            same = (level[0][at] == batch[0]) & (level[1][at] == batch[1]) if len(level[0]) else np.zeros(len(batch[0]), bool)
            mine, theirs = np.flatnonzero(same), at[same]
            later = (batch[2][mine] > level[2][theirs]) | ((batch[2][mine] == level[2][theirs]) & (batch[3][mine] > level[3][theirs]))
            # A tie in place is one row that came twice; it neither loses nor stays twice.
            equal = (batch[2][mine] == level[2][theirs]) & (batch[3][mine] == level[3][theirs])
            win = theirs[~later & ~equal]
            if later.any():
                lost.append([c[mine[later]] for c in batch])
            if len(win):
                lost.append([c[win] for c in level])
                for c, own in zip(level, batch):
                    c[win] = own[mine[~later & ~equal]]
            keep = np.ones(len(batch[0]), bool)
            keep[mine] = False
            batch = [c[keep] for c in batch]
        if len(batch[0]):
            while self.levels and len(self.levels[-1][0]) <= 2 * len(batch[0]):
                batch = self._merge(self.levels.pop(), batch)
            self.levels.append(batch)
        return [np.concatenate(x) for x in zip(*lost)] if lost else [c[:0] for c in columns]

    def entries(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.levels)] if self.levels else []

    @staticmethod
    def _settle(columns: list[np.ndarray], lost: list[list[np.ndarray]]) -> list[np.ndarray]:
        order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
        columns = [c[order] for c in columns]
        same = np.zeros(len(order), bool)
        same[1:] = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])
        if same.any():
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            twice = same & (columns[2] == columns[2][head]) & (columns[3] == columns[3][head])
            lost.append([c[same & ~twice] for c in columns])
        return [c[~same] for c in columns]

    @staticmethod
    def _merge(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        at = np.searchsorted(a[0], b[0], "right") + np.arange(len(b[0]))
        rest = np.ones(len(a[0]) + len(b[0]), bool)
        rest[at] = False
        out = []
        for x, y in zip(a, b):
            z = np.empty(len(rest), x.dtype)
            z[at], z[rest] = y, x
            out.append(z)
        return out


def _blocks(starts: np.ndarray, ends: np.ndarray, length: int, step: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, start, end) arrays of pieces to work on together; a long document comes in pieces that overlap by length - 1 bytes."""
    which, lo, hi, size = [], [], [], 0
    for d, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        if which and e - s > 2 * step:
            yield np.array(which), np.array(lo), np.array(hi)
            which, lo, hi, size = [], [], [], 0
        while e - s > 2 * step:
            yield np.array([d]), np.array([s]), np.array([s + step + length - 1])
            s += step
        if e - s < length:
            continue
        which.append(d), lo.append(s), hi.append(e)
        size += e - s
        if size >= step:
            yield np.array(which), np.array(lo), np.array(hi)
            which, lo, hi, size = [], [], [], 0
    if which:
        yield np.array(which), np.array(lo), np.array(hi)


def _strings(b: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Prefix hashes; of the string at each position its anchor hash, whether a run starts with it, whether it lies in a document; the first byte. Pieces lie in ascending order."""
    base = int(lo[0])
    x = b[base : int(hi[-1])]
    k = min(ANCHOR, length)
    p = prefix_hashes(x)
    grams = mix((p[k:] - p[:-k]) * powers(len(x))[1][: len(x) - k + 1])
    anchor = sliding(grams, length - k + 1)
    # A run also ends where the string's first k-gram is its anchor: each run has one anchor place, the leftmost, so no two of its strings are equal.
    new = np.ones(len(anchor), bool)
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    new[1:] |= grams[: len(anchor) - 1] == anchor[:-1]
    edge = np.zeros(len(anchor) + 1, np.int32)
    np.add.at(edge, lo - base, 1)
    np.add.at(edge, hi - length + 1 - base, -1)
    new[lo - base] = True
    return p, anchor, new, np.cumsum(edge[:-1]) > 0, base


def _hash_spans(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((p[e] - p[s]) * powers(len(p))[1][s] + (e - s).astype(U))


def _segments(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> list[np.ndarray]:
    """anchor, hash, document number, first string, number of strings of each segment."""
    found = []
    for which, lo, hi in _blocks(starts, ends, length):
        p, anchor, new, valid, base = _strings(b, lo, hi, length)
        first = np.flatnonzero(new & valid)
        piece = np.searchsorted(lo - base, first, "right") - 1
        last = np.minimum(np.append(first[1:], len(anchor)), (hi - length + 1 - base)[piece])
        found.append([anchor[first], _hash_spans(p, first, last + length - 1), which[piece], first + base - starts[which[piece]], last - first])
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 5


def _runs(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that touch or overlap within a document become one."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order].astype(np.int64), e[order].astype(np.int64)
    rank = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    shift = rank * (int(e.max()) + 2)
    reach = np.maximum.accumulate(e + shift)
    new = np.append(True, s[1:] + shift[1:] > reach[:-1])
    head = np.flatnonzero(new)
    return doc[head], s[head], np.maximum.reduceat(e, head)


def _answers(doc: np.ndarray, s: np.ndarray, e: np.ndarray, check: np.ndarray, n_groups: int) -> Iterator[tuple[int, int, bytes]]:
    """Ranges as rows for the groups of documents."""
    for g, rows in by_bucket(doc_group(doc, n_groups)):
        yield g, 1, pack(doc[rows].astype("<i8"), s[rows].astype("<u4"), e[rows].astype("<u4"), check[rows].astype("<u1"))


def _out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    x = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(x[0], pa.int32()), pa.array(x[1], pa.int32()), pa.array(x[2], pa.binary())], ["bucket", "kind", "payload"])


def _flush(rows: list[tuple[int, int, bytes]], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    at, size = 0, 0
    for i, r in enumerate(rows):
        size += len(r[2])
        if size > most:
            yield _out(rows[at : i + 1])
            at, size = i + 1, 0
    if at < len(rows):
        yield _out(rows[at:])


def _scan(length: int, n_buckets: int, n_groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text", BATCH_BYTES):
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            b, starts, ends = text_bytes(batch.column(1))
            anchor, sign, doc, pos, n = _segments(b, starts, ends, length)
            if not len(anchor):
                continue
            doc = ids[doc]
            order = np.lexsort((pos, doc, sign, anchor))
            anchor, sign, doc, pos, n = (x[order] for x in (anchor, sign, doc, pos, n))
            again = np.zeros(len(anchor), bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (sign[1:] == sign[:-1])
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
            twice = again & (doc == doc[head]) & (pos == pos[head])
            gone = again & ~twice
            first = np.flatnonzero(~again)
            _, which, count = np.unique(anchor[first], return_inverse=True, return_counts=True)
            hot = count[which] > HOT_SEGMENTS
            direct, asked = first[hot], first[~hot]
            said = np.concatenate([np.flatnonzero(gone), direct])
            rows = list(_answers(doc[said], pos[said], pos[said] + n[said] + length - 1, np.arange(len(said)) >= gone.sum(), n_groups))
            marks = np.unique(anchor[direct])
            # A mark tells the shard that an anchor has several segments: an entry of no strings.
            columns = [np.concatenate([x[asked], y]) for x, y in zip((anchor, sign, doc, pos, n), (marks, marks, np.full(len(marks), -1), np.zeros(len(marks), np.int64), np.zeros(len(marks), np.int64)))]
            order = np.lexsort((columns[3], columns[2]))
            columns = [c[order] for c in columns]
            for k, r in by_bucket((columns[0] % U(n_buckets)).astype(np.int64)):
                rows.append((k, 0, pack(*(c[r].astype(t) for c, t in zip(columns, _ENTRY)))))
            yield from _flush(rows)

    return run


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield row


def _judge_segments(length: int, n_groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, family, marks, said, rows = None, IndexFamily(), [], [], []

        def close() -> None:
            if now is None:
                return
            kept = family.entries()
            if kept:
                sign, anchor, doc, pos, n = kept
                order = np.argsort(anchor, kind="stable")
                a = anchor[order]
                other = np.zeros(len(a), bool)
                other[1:] |= a[1:] == a[:-1]
                other[:-1] |= a[1:] == a[:-1]
                ask = np.zeros(len(a), bool)
                ask[order] = other
                if marks:
                    ask |= np.isin(anchor, np.concatenate(marks))
                said.append((doc[ask], pos[ask].astype(np.int64), pos[ask].astype(np.int64) + n[ask] + length - 1, np.ones(int(ask.sum()), bool)))
            if said:
                rows.extend(_answers(*(np.concatenate(x) for x in zip(*said)), n_groups))

        for bucket, kind, payload in _sharded(batches):
            if bucket != now:
                close()
                yield from _flush(rows)
                now, family, marks, said, rows = bucket, IndexFamily(), [], [], []
            if kind == 1:
                rows.append((bucket, kind, payload))
                continue
            anchor, sign, doc, pos, n = unpack(payload, *_ENTRY)
            mark = n == 0
            if mark.any():
                marks.append(anchor[mark])
                anchor, sign, doc, pos, n = (x[~mark] for x in (anchor, sign, doc, pos, n))
            if len(anchor):
                _, _, doc, pos, n = family.add(sign, anchor, doc, pos, n)
                said.append((doc, pos.astype(np.int64), pos.astype(np.int64) + n + length - 1, np.zeros(len(doc), bool)))
        close()
        yield from _flush(rows)

    return run


def _judge_strings(length: int, n_groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, family, said, rows = None, IndexFamily(), [], []

        def close() -> None:
            if said:
                doc, s, e = _runs(*(np.concatenate(x) for x in zip(*said)))
                rows.extend(_answers(doc, s, e, np.zeros(len(doc), bool), n_groups))

        for bucket, kind, payload in _sharded(batches):
            if bucket != now:
                close()
                yield from _flush(rows)
                now, family, said, rows = bucket, IndexFamily(), [], []
            if kind == 1:
                rows.append((bucket, kind, payload))
                continue
            _, _, doc, pos = family.add(*unpack(payload, *_WINDOW))
            said.append((doc, pos.astype(np.int64), pos.astype(np.int64) + length))
        close()
        yield from _flush(rows)

    return run


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a group: its removed ranges and those to check."""
    now, parts = None, []

    def rows() -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        doc, s, e, check = (np.concatenate(x) for x in zip(*parts))
        out: dict[int, list[bytes | None]] = {}
        for flag in (0, 1):
            d, lo, hi = _runs(*(x[check == flag] for x in (doc, s, e)))
            cuts = np.flatnonzero(np.diff(d)) + 1
            for at in np.split(np.arange(len(d)), cuts) if len(d) else []:
                out.setdefault(int(d[at[0]]), [None, None])[flag] = np.column_stack([lo[at], hi[at]]).astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), *(pa.array([v[i] for v in out.values()], pa.binary()) for i in (0, 1))], ["r_id", "gone", "check"])

    for bucket, _, payload in _sharded(batches):
        if bucket != now:
            yield from rows()
            now, parts = bucket, []
        parts.append(unpack(payload, *_RANGE))
    yield from rows()


def _ranges(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x or b"", "<u4").reshape(-1, 2).astype(np.int64)


def _scan_strings(length: int, n_buckets: int, n_groups: int):
    """The strings of the ranges to check, each batch its distinct ones; what repeats within the batch is answered at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text", BATCH_BYTES):
            if batch.column(2).null_count == batch.num_rows:
                continue
            ids = np.asarray(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
            b, starts, ends = text_bytes(batch.column(1))
            marks = np.zeros(len(b) + 1, np.int32)
            some = False
            for d, x in enumerate(batch.column(2).to_pylist()):
                r = _ranges(x)
                r = np.minimum(r, ends[d] - starts[d])
                r = r[r[:, 1] - r[:, 0] >= length]
                if len(r):
                    some = True
                    np.add.at(marks, starts[d] + r[:, 0], 1)
                    np.add.at(marks, starts[d] + r[:, 1] - length + 1, -1)
            if not some:
                continue
            wanted = np.cumsum(marks[:-1]) > 0
            found, n = [], 0
            for which, lo, hi in _blocks(starts, ends, length):
                if not wanted[int(lo[0]) : int(hi[-1])].any():
                    continue
                p, anchor, _, valid, base = _strings(b, lo, hi, length)
                at = np.flatnonzero(valid & wanted[base : base + len(valid)])
                piece = which[np.searchsorted(lo - base, at, "right") - 1]
                found.append((_hash_spans(p, at, at + length), (anchor[at] >> U(32)).astype("<u4"), ids[piece], (at + base - starts[piece]).astype("<u4")))
                n += len(at)
                if n >= BATCH_STRINGS:
                    yield from settled(found)
                    found, n = [], 0
            if n:
                yield from settled(found)

    def settled(found: list) -> Iterator[pa.RecordBatch]:
        lost: list = []
        kept = IndexFamily._settle([np.concatenate(x) for x in zip(*found)], lost)
        rows = []
        if lost:
            doc, pos = lost[0][2], lost[0][3].astype(np.int64)
            doc, s, e = _runs(doc, pos, pos + length)
            rows += _answers(doc, s, e, np.zeros(len(doc), bool), n_groups)
        order = np.lexsort((kept[3], kept[2]))
        kept = [c[order] for c in kept]
        for k, r in by_bucket((kept[0] % U(n_buckets)).astype(np.int64)):
            rows.append((k, 0, pack(*(c[r].astype(t) for c, t in zip(kept, _WINDOW)))))
        yield from _flush(rows)

    return run


def _dealt(df: DataFrame, fn, n: int) -> DataFrame:
    return df.repartition(n, "bucket").sortWithinPartitions("bucket").transform(mapped, fn, _ROWS)


def numbered(own: DataFrame) -> DataFrame:
    """own (doc_id, text and more) with a number ``key`` for each document, in the order of their ids. Where each id has one text, as is usual, that is the
    id. Else documents of one id with different texts are told apart by 128 bits of their texts, and follow each other in the order of these."""
    marks = [F.xxhash64(F.lit(i), F.coalesce("text", F.lit(""))).alias(f"mark{i}") for i in (1, 2)]
    some = own.where(F.col("doc_id").isNotNull()).select("doc_id", *marks)
    several = some.groupBy("doc_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("mark1", "mark2") for f in (F.min, F.max))).where("min_mark1 <> max_mark1 OR min_mark2 <> max_mark2")
    if not several.limit(1).count():
        return own.withColumn("key", F.col("doc_id"))
    keys = ["doc_id", "mark1", "mark2"]
    documents = some.groupBy(*keys).agg(F.count("*").alias("copies")).orderBy(*keys).withColumn("key", F.monotonically_increasing_id())
    documents = materialize(documents)
    n_rows = documents.agg(F.sum("copies")).first()[0]
    marked = own.select("*", *marks)
    told = by_class(marked.where(F.col("doc_id").isNotNull()), documents, keys, "copies", n_rows)
    return told.select(*own.columns, "key").unionByName(own.where(F.col("doc_id").isNull()).withColumn("key", F.lit(None).cast("long")))


def removed_ranges(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """documents with the byte ranges to remove: doc_id, text, gone, more (both binary, pairs of unsigned 32-bit numbers), and the struct ``carried``."""
    # A shard's share of the text is the same at every size.
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    n = max(shuffle_partitions(docs.sparkSession), -(-size // SHARD_BYTES))
    # Answers go back to groups of documents, fewer than there are shards, so that their rows stay few.
    g = max(8, n // 4)
    carried = F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(0).alias("none"))
    own = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), carried.alias("carried")))
    found = _dealt(own.where(F.col("key").isNotNull()).select("key", "text").transform(mapped, _scan(length, n, g), _ROWS), _judge_segments(length, g), n)
    first = materialize(light(found.repartition(n, "bucket").sortWithinPartitions("bucket")).transform(mapped, _per_document, "r_id long, gone binary, check binary"))
    joined = own.join(first, F.col("key") == F.col("r_id"), "left").select("key", "text", "gone", "check", "carried", "doc_id")
    # No filter on the ranges here: with one, this join's exchange of the texts would differ from the last join's and be written twice.
    strings = joined.select("key", "text", "check", "carried", "doc_id").transform(mapped, _scan_strings(length, n, g), _ROWS)
    second = _dealt(strings, _judge_strings(length, g), n).repartition(n, "bucket").sortWithinPartitions("bucket").transform(mapped, _per_document, "r_id long, gone binary, check binary")
    second = second.select("r_id", F.col("gone").alias("more"))
    return joined.join(second, F.col("key") == F.col("r_id"), "left").select("doc_id", "text", "gone", "more", "carried")


def _cut(b: np.ndarray, *ranges: np.ndarray) -> tuple[np.ndarray, int]:
    """Which bytes stay, and the number of removed runs."""
    edge = np.zeros(len(b) + 1, np.int32)
    for r in ranges:
        r = np.minimum(r, len(b))
        np.add.at(edge, r[:, 0], 1)
        np.add.at(edge, r[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return ~gone, int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def _whole_characters(b: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """keep, with every character of which a byte stays kept whole."""
    lead = (b & 0xC0) != 0x80
    number = np.cumsum(lead) - 1
    stays = np.zeros(int(number[-1]) + 1 if len(b) else 0, bool)
    stays[number[keep]] = True
    return stays[number] if len(b) else keep


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b, starts, ends = text_bytes(batch.column(1))
        out = []
        for s, e, gone, more in zip(starts, ends, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x = b[s:e]
            keep, spans = _cut(x, _ranges(gone), _ranges(more)) if gone or more else (slice(None), 0)
            left = x[keep]
            text = x[_whole_characters(x, keep)].tobytes().decode("utf-8", "replace") if spans else None
            out.append((len(x), len(x) - len(left), spans, hashlib.sha256(left.tobytes()).hexdigest(), text))
        n, removed, spans, sha, text = zip(*out) if out else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pc.coalesce(pa.array(text, pa.string()), batch.column(1).cast(pa.string())), batch.column(4)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "carried"],
        )


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes that also starts earlier (smaller id; same document, earlier start).

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what is left, where a character cut in two stays whole; the text itself, null or
    not, if nothing was removed), and the columns named in ``carry`` as they were.

    Null text: as empty. Null id: the row is returned uncut and is no source of copies. Rows that repeat an id and a text are one document and
    get the same result each. Different texts of one id are documents of their own, one of which counts as the earlier (by a hash of the text).
    Empty table: empty result. Other columns are not read.
    """
    found = removed_ranges(docs, length, id_col, text_col, carry)
    kind = found.schema["carried"].dataType.simpleString()
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, carried {kind}"
    out = found.transform(mapped, _digest, schema)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", *(F.col("carried")[c].alias(c) for c in carry))
