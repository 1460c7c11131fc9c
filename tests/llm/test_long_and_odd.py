"""Texts that are one long run, ids with several texts, and components of any finite size."""

import hashlib
from functools import partial

import numpy as np
import pytest

import corpus_pipeline
from larkspan.llm import ann, packing, suffix_dedup, token_count
from larkspan.llm.tokens import LONG_SPACE, default_vocabulary, encoder

RUNS = [" ", "\n", " ", " \n", "^", "a", "7", "é"]


@pytest.mark.parametrize("n", [LONG_SPACE - 1, LONG_SPACE, 400_000])
def test_long_runs_have_the_ids_of_the_library(n):
    e = encoder(default_vocabulary())
    for c in RUNS:
        run = (c * n)[:n]
        for text in ("x" + run + "y", run, "x " + run, run + " y", "x" + run + "\x1cy" + run + ", z"):
            assert e(text).tolist() == e.slow.encode(text, add_special_tokens=False).ids, (c, n, text[:3])


def test_a_panic_goes_to_the_other_library(monkeypatch):
    class PanicException(BaseException):
        pass

    def panics(text):
        raise PanicException

    e = encoder(default_vocabulary())
    text = "some words, " * 3000
    expected = e(text).tolist()
    monkeypatch.setattr(e, "fast", type("Fast", (), {"encode_ordinary": staticmethod(panics)}))
    assert e(text).tolist() == expected


def test_very_long_runs_pass(spark):
    rows = [(1, "a" + " " * 10_000_000 + "b"), (2, "\n" * 3_000_000), (3, "^" * 2_000_000), (4, "q" * 2_000_000), (5, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {i: len(encoder(default_vocabulary()).slow.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    packed = packing.pack(docs).collect()
    assert {r.doc_id: r.doc_tokens for r in packed} == expected and sum(r.length for r in packed) == sum(expected.values())
    assert token_count.token_counts(docs).count() == len(rows)


def brute(rows, length=100):
    """Documents in the order of their ids, those of one id in any order: the results of all orders."""
    seen, out = set(), []
    for i, t in rows:
        b, gone = t.encode(), bytearray(len(t.encode()))
        for at in range(len(b) - length + 1):
            w = b[at : at + length]
            if w in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(w)
        out.append((i, len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_texts_of_one_id_are_cut_apart(spark):
    rng = np.random.default_rng(1)
    a, b, c = ("".join(chr(97 + x) for x in rng.integers(0, 26, 400)) for _ in range(3))
    rows = [(1, a), (2, "zz " + a), (2, b), (3, b + c), (3, "short"), (4, c), (4, c)]
    found = suffix_dedup.suffix_dedup(spark.createDataFrame([*rows, (None, a), (5, None)], "doc_id long, text string")).collect()
    kept = {(r.doc_id, r.n_bytes): (r.n_removed, r.text) for r in found}
    assert kept[(2, 400)] == (0, b) and kept[(2, 403)][0] == 400 and kept[(3, 800)] == (400, c) and kept[(None, 400)] == (0, a) and kept[(5, 0)] == (0, None)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in found if r.doc_id not in (None, 5)) == sorted([*brute([r for r in rows if r[0] < 4]), *[(4, 400, 400, hashlib.sha256(b"").hexdigest())] * 2])


def test_texts_of_one_id_that_share_a_passage(spark):
    rng = np.random.default_rng(2)
    p, q, r = ("".join(chr(97 + x) for x in rng.integers(0, 26, 150)) for _ in range(3))
    rows = [(7, p + q), (7, p + r), (8, p)]
    found = sorted((x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256) for x in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found in (brute(rows), brute([rows[1], rows[0], rows[2]]))


def test_pipeline_stage_keeps_what_repeats_nothing(spark):
    rng = np.random.default_rng(3)
    a, b = ("".join(chr(97 + x) for x in rng.integers(0, 26, 400)) for _ in range(2))
    docs = spark.createDataFrame([(1, a, "en", "s", 400), (2, "zz " + a, "en", "s", 403), (2, b, "en", "s", 400)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()} == {(1, a, 400), (2, "zz ", 3), (2, b, 400)}


def test_neighbours_of_any_finite_size(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 5))
    x[10], x[30], x[20] = x[10] * 1e200, x[30] * 1e200, x[20] * 1e-200
    x[40:50] *= 1e-200
    x[50] = 1.7e308
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    wide = x.astype(np.longdouble)
    for q in range(0, 60, 10):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        order = [i for i in sorted(range(60), key=lambda i: (float(d[i]), i)) if i != q][:10]
        assert [found[q][k + 1][1] for k in range(10)] == order, q
        assert np.allclose([found[q][k + 1][0] for k in range(10)], [float(d[i]) for i in order], rtol=1e-12, atol=0)


def test_neighbours_in_several_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((900, 6)))], "vec_id long, embedding array<double>")
    expected = sorted(ann.nearest(df, every=9).collect())
    monkeypatch.setattr(ann, "HELD_BYTES", 6 * 8 * 100)
    assert sorted(ann.nearest(df, every=9).collect()) == expected
