"""Maximal periodic runs of words, by Lyndon arrays over an ordered alphabet (Ellert and Fischer).

Every run has a root that is the longest Lyndon word at its place in one of two orders of the alphabet: the order of the words, or its reverse. So for
both orders the next smaller suffix of each place is sought, from left to right, with a stack of the places that have none yet. Words are only
ever compared with each other: there are no suffix arrays, trees or hashes, and no numbering of the words. How far two suffixes agree is mostly
known before a word is compared, from what was matched earlier:

* of neighbours on the stack it is stored how far they agree, so a suffix that agrees with the upper one to another length than the lower one
  does is settled at once, and one that agrees to the same length goes on from there;
* the match that reaches furthest to the right is held: pairs within its copy have their originals' answer, and a pair at its distance begins
  where it ends.

A pair (j, r) of a place and its next smaller suffix, r - j = q, that agrees over more than 2q words is a run of exponent 4 or more, if it is as
long once it has been extended to the left; each run is extended once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .core import documents_input, mapped, text_bytes

#: Least exponent of a run that is kept, and its least number of words.
EXPONENT, LENGTH = 4, 6
#: Words that one list comparison takes, once so many have agreed one by one.
STRIDE, SINGLES = 256, 8
#: Text of a longer document is split in pieces of so many bytes, whose equal words share one object.
PIECE = 8 << 20


def agreement(words: list, j: int, r: int, known: int) -> int:
    """Number of words that the suffixes at j < r have in common, of which ``known`` are known."""
    n, i, k = len(words), j + known, r + known
    stop = min(n, k + SINGLES)
    while k < stop and words[i] == words[k]:
        i, k = i + 1, k + 1
    if k == stop:
        while k + STRIDE <= n and words[i : i + STRIDE] == words[k : k + STRIDE]:
            i, k = i + STRIDE, k + STRIDE
        while k < n and words[i] == words[k]:
            i, k = i + 1, k + 1
    return k - r


def long_pairs(words: list, up: bool) -> Iterator[tuple[int, int, int]]:
    """Pairs (place, its next smaller suffix, number of words both have in common), that number above twice their distance. ``up``: the words' own
    order, else its reverse; a suffix is greater than its own beginning in both."""
    n = len(words)
    #: The previous smaller suffix of each place: what lies below it on the stack, whose top is the place before the one in turn.
    below: list[int] = []
    # How far places with equal first words agree: with the next smaller suffix (which it is, and how far), and with the previous one.
    following: dict[int, tuple[int, int]] = {}
    before: dict[int, int] = {}
    copy, distance, end = 0, 0, 0
    for r, word in enumerate(words):
        j = r - 1
        if up:
            while j >= 0 and words[j] > word:
                j = below[j]
        else:
            while j >= 0 and words[j] < word:
                j = below[j]
        if j < 0 or words[j] != word:
            below.append(j)
            continue
        common = 1
        while True:  # words[j] == word, and the two suffixes agree over common words at least
            settled = False
            if r < end:
                if j >= copy:
                    first, second = j - distance, r - distance
                    pair = following.get(first)
                    known = pair[1] if pair is not None and pair[0] == second else before.get(second, 0) if below[second] == first else 0
                    if known:
                        settled = r + known < end
                        common = known if settled else end - r
                elif r - j == distance:
                    common = end - r
            if not settled:
                common = agreement(words, j, r, common)
            k = r + common
            if k > end:
                copy, distance, end = r, r - j, k
            if k < n and (words[j + common] > words[k]) is not up:
                before[r] = common
                break
            # The suffix at j is greater, and so are those below it that agree with it further than r does.
            while True:
                following[j] = r, common
                if common > 2 * (r - j):
                    yield j, r, common
                agreed = before.get(j, 0)
                j = below[j]
                if agreed <= common:
                    break
            if agreed < common:
                # What is below agrees with r as far as with the place above it, and is smaller than both.
                if agreed:
                    before[r] = agreed
                break
        below.append(j)


def runs(words: list, exponent: int = EXPONENT, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run with at least ``exponent`` periods and ``length`` words, in order. ``exponent`` is at least 4."""
    found = set()
    for up in (True, False):
        ends: dict[int, int] = {}
        for j, r, common in long_pairs(words, up):
            q, end = r - j, r + common
            if ends.get(q) == end:
                continue
            ends[q] = end
            while j and words[j - 1] == words[j - 1 + q]:
                j -= 1
            if end - j >= max(length, exponent * q):
                found.add((j, end - j, q))
    return sorted(found, key=lambda x: (x[0], x[2]))


def split(text: bytes) -> list[bytes]:
    """Words: runs of other bytes than space, tab, LF, VT, FF and CR."""
    if len(text) <= PIECE:
        return text.split()
    out, one, at = [], {}, 0
    while at < len(text):
        # A piece ends behind a white-space byte, so that no word is cut.
        stop = min(at + PIECE, len(text))
        while stop < len(text) and text[stop - 1] not in b" \t\n\v\f\r":
            stop += 1
        out += [one.setdefault(w, w) for w in text[at:stop].split()]
        at = stop
    return out


def collapse(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that lie in a run beyond its first period."""
    out, at = [], 0
    for lo, hi in sorted((start + q, start + n) for start, n, q in found):
        out += words[at:lo]
        at = max(at, hi)
    return out + words[at:]


def _find(exponent: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            b, starts, ends = text_bytes(batch.column(1))
            numbers, spans, texts = [], [], []
            for s, e in zip(starts, ends):
                words = split(b[s:e].tobytes())
                found = runs(words, exponent, length)
                numbers.append(len(words))
                spans.append([{"start": a, "length": n, "period": q} for a, n, q in found])
                texts.append(b" ".join(collapse(words, found) if found else words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_words, runs (array of start, length, period in words, by start, then period) and collapsed (the text without what runs repeat,
    words joined by one space).

    Words are runs of other bytes than ASCII white space. A run is a stretch with smallest period q, of at least ``length`` words and ``exponent``
    (4 at least) periods, that no neighbouring word extends. Null or empty text, or white space only: no words, no runs, '' left. Rows are judged
    one by one: repeated ids or rows give a row each, a null id stays null. Empty table: empty result. Other columns are not read. Nothing is
    shuffled; a task holds one batch of texts and the words of one document.
    """
    if exponent < 4:
        raise ValueError("exponent must be 4 or more")
    return documents_input(docs, id_col, text_col).transform(mapped, _find(exponent, length), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
