"""Operators against brute force on small fixtures that hold the awkward cases: nulls, empty, very long, repeated rows, ties, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import ann, lm_score, minhash, packing, quality, suffix_dedup, token_count, tokens, toxicity, urlfilter, winnow

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = " ".join(words(60))
    rows = []
    for i in range(n):
        w = words(rng.choice([0, 1, 3, 12, 13, 80, 200]))
        if i % 5 == 0:
            w.insert(len(w) // 2, passage)
        rows.append((i, " ".join(w)))
    base = words(150)
    for i in range(n, n + 12):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "ab" * 900), (203, "x" * 400), (204, rows[5][1]), (205, rows[5][1].upper()), (206, "word " * 3000), (207, rows[60][1])]
    rows += [rows[60], (None, rows[60][1]), (None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, 1) for i, t in rows], "doc_id long, text string, bucket string, r_id int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_suffix_dedup(docs, empty, rows):
    seen, expected = set(), {}
    for i, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for at in range(len(b) - 99):
            w = b[at : at + 100]
            if w in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        expected[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    found = suffix_dedup.suffix_dedup(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found if r.doc_id is not None} == expected
    assert all(r.n_removed == 0 for r in found if r.doc_id is None)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_pieces_of_long_documents_are_bounded():
    """Short documents before a long one don't join its pieces."""
    at = np.array([0, 300, 300 + (12 << 20)])
    spans = [int(hi[-1] - lo[0]) for _, lo, hi in suffix_dedup._blocks(at[:-1], at[1:], 100)]
    assert max(spans) <= (1 << 20) + 100 and sum(spans) >= 12 << 20


def test_suffix_dedup_in_many_batches(docs, monkeypatch):
    """Batches and shards of other sizes give the same result."""
    want = {(r.doc_id, r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect()}
    for name, value in (("BATCH_BYTES", 3000), ("BATCH_STRINGS", 500), ("SHARD_BYTES", 2000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert {(r.doc_id, r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect()} == want


def test_index_family_levels():
    rng = np.random.default_rng(3)
    family, all_ = suffix_dedup.IndexFamily(), {}
    for step in range(20):
        key = rng.integers(0, 300, 40).astype(np.uint64)
        doc, pos = rng.integers(0, 50, 40), rng.integers(0, 1000, 40).astype("<u4")
        family.add(key, key, doc, pos)
        for k, d, p in zip(key.tolist(), doc.tolist(), pos.tolist()):
            all_[k] = min(all_.get(k, (10**9, 0)), (d, p))
    k, _, d, p = family.entries()
    assert dict(zip(k.tolist(), zip(d.tolist(), p.tolist()))) == all_
    sizes = [len(x[0]) for x in family.levels]
    assert all(a > 2 * b or a > b for a, b in zip(sizes, sizes[1:]))


def test_near_duplicates(docs, empty, rows):
    sets, k = {}, 4
    for i, t in rows:
        if i is not None:
            w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)) if x]
            sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    found = minhash.near_duplicates(docs, k=4).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is not None} == {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}
    assert all(r.kept for r in found if r.doc_id is None)
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [1024, 5])
def test_near_duplicates_beyond_the_pivot(spark, monkeypatch, block):
    """Families that drift: most links are not with a bucket's smallest member, and similarities lie on both sides of the threshold."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SET_BLOCK", min(block, 7))
    rng = random.Random(11)
    rows = []
    for family in range(3):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(40):
            for _ in range(rng.choice([1, 2, 2, 3, 4])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in (t.split() for _, t in rows)]
    own = list(range(len(rows)))
    links = [[b for b in own if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])] for a in own]
    for _ in rows:
        own = [min(own[b] for b in near) for near in links]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(own)) and 3 < len(set(own)) < 100


def test_near_duplicates_of_ids_with_several_texts(spark):
    """An id shares the links of all its texts, be one of them another id's copy or not."""
    words = lambda k, i: [f"{k}{j}" for j in range(i)]
    a, b = " ".join(words("a", 60)), words("b", 80)
    near = " ".join([*b[:-1], "other"])
    rows = [(3, a), (5, a), (5, " ".join(b)), (9, near), (9, near), (11, " ".join(words("c", 20)))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (5, 3), (5, 3), (9, 3), (9, 3), (11, 11)]


@pytest.mark.parametrize("per_task", [1 << 18, 7])
def test_components(spark, per_task):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(7, 7), (400, 401), (401, 400)]
    own = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in own:
        for a, b in edges:
            if a != b:
                own[a] = own[b] = min(own[a], own[b])
    found = minhash.components(spark.createDataFrame(edges, "a long, b long"), per_task=per_task).collect()
    assert {r.node: r.component for r in found} == own and len(found) == len(own)
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_block_links_and_bounds():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, 60)).astype(np.uint64) for _ in range(9)]
    common = minhash.common_sizes(sets[:4], sets[4:], columns=16)
    assert common.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    b = minhash.posterior_bounds(0.8, 1e-6)
    assert (np.diff(b) > 0).all() and b[-1] < 0.8 * minhash.SIGNATURE


def test_components_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 50), (50, 101)], "a long, b long")
    assert {r.node: r.component for r in minhash.components(e).collect()} == {**{i: 0 for i in range(21)}, 50: 50, 100: 50, 101: 50}


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_decontaminate(spark, docs, empty, rows, held):
    items = [(1, rows[0][1][:200]), (10, "word word word"), (2, rows[7][1]), (3, None), (None, "x"), (4, "..."), (1, rows[0][1][:200]), (5, rows[61][1].upper()), (6, "word " * 700), (7, "left " + "word " * 30 + "right"), (8, "word word word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    expected = []
    for d, t in rows:
        w, names = split(t), set()
        hit = [0] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    names |= own
                    hit[k : k + n] = [1] * n
        expected.append((d, len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    found = winnow.decontaminate(docs, bench, held_bytes=held).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert winnow.decontaminate(empty, bench, held_bytes=held).count() == 0
    assert winnow.decontaminate(docs, bench.limit(0), held_bytes=held).where("contaminated").count() == 0


def test_repetitive_items_have_few_places():
    """A text of one repeated word against an item of one: work grows with the text, not with the product."""
    bench = winnow.Benchmark([("a", b"word " * 20000), ("b", b"word " * 50), ("c", b"x " + b"word " * 50)])
    assert len(bench.at) < 100
    words, n = winnow.words_of(np.frombuffer(b"word " * 3000, np.uint8), np.array([0]), np.array([15000]))
    hit, pairs = bench.hits(words, n)
    assert hit.all() and pairs.tolist() == [0, 1, 2]


def test_packing_round_trip(docs, empty, rows):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokens.default_vocabulary())
    found = packing.pack(docs).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in {r for r in rows if r[0] is not None}:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        times = sum(r == (i, t) for r in rows)
        own = sorted(by[i], key=lambda r: r.start)
        assert sum(r.length for r in own) == times * len(ids) and {r.doc_tokens for r in own} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty).count() == 0


def test_encoder_gives_the_librarys_ids(rows):
    e = tokens.encoder(tokens.default_vocabulary())
    assert e.fast is not None
    for t in [*(t for _, t in rows if t), "a <|endoftext|> b", "  \n\n x\u00a0y 漢字 🙂 \x00"]:
        assert e(t).tolist() == e.slow.encode(t, add_special_tokens=False).ids


def test_token_counts(docs, empty, rows, spark, tmp_path):
    e = tokens.encoder(tokens.default_vocabulary(), True)
    found = token_count.token_counts(docs, block=64).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in found), key=repr) == sorted(((i, len(e(t or ""))) for i, t in rows), key=repr)
    assert token_count.token_counts(empty).count() == 0
    # The same in a store that only Spark can open, where the blocks are rows.
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_count, "_opened", lambda path: False)
        rows_only = token_count.token_counts(docs, block=64).collect()
    assert sorted(map(str, rows_only)) == sorted(map(str, found))
    flat = np.array([5, 6, 9, 9, 7, 8], "<u2")
    (tmp_path / "f.bin").write_bytes(flat.tobytes())
    scan = token_count.separator_scan(token_count.flat_file_blocks(spark, str(tmp_path), 4), end=9)
    assert sorted((r.ordinal, r.start, r.n_tokens) for r in scan.collect()) == [(0, 0, 2), (1, 3, 0), (2, 4, 2)]


@pytest.mark.parametrize("splits", [1, 1 << 20])
def test_flat_files(spark, tmp_path, splits):
    """Several files, cut into ranges that tasks read by themselves: separators at every kind of place, an empty file, no separator at the end."""
    rng = np.random.default_rng(4)
    want = []
    for k in range(5):
        ids = rng.integers(0, 12, [0, 1, 500, 64, 333][k]).astype("<u2")
        (tmp_path / f"part-{k}.bin").write_bytes(ids.tobytes())
        at = np.flatnonzero(ids == 9)
        start = np.append(0, at + 1)
        stop = np.append(at, len(ids))
        docs = [(int(a), int(b - a)) for a, b in zip(start, stop)]
        want += docs if docs[-1][1] else docs[:-1]
    blocks = token_count.flat_file_blocks(spark, str(tmp_path), 16, blocks_each=splits)
    scan = token_count.separator_scan(blocks, end=9)
    assert sorted((r.start, r.n_tokens) for r in scan.collect()) == sorted(want)
    # A gap in the numbers of blocks is no gap in the file.
    gaps = blocks.withColumn("block", F.col("block") * 3000)
    assert sorted((r.start, r.n_tokens) for r in token_count.separator_scan(gaps, end=9).collect()) == sorted(want)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 8)).astype(np.float32)
    v[300] = v[200]
    rows = [(i, v[i].tolist(), 1) for i in range(700)] + [(900, None, 1), (1000, [0.0] * 8, 1), (1100, [float("nan")] * 8, 1), (1200, [1.0, None] + [0.0] * 6, 1), (None, v[0].tolist(), 1), (5, v[5].tolist(), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int")
    assert sorted(ann.nearest(df, every=7, block=100).collect()) == sorted(ann.nearest(df, every=7, block=1 << 20).collect())
    found = ann.nearest(df, block=128).collect()
    x = v.astype(np.float64)
    for q in range(0, 700, 100):
        d = ann.exact_distance(x[q], x)
        best = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert mine == [(k + 1, i, d[i]) for k, i in enumerate(best)]
    assert {r.query_id for r in found} == set(range(0, 700, 100)) and ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("query_block", [512, 3])
def test_nearest_of_few_and_of_mixed_lengths(spark, monkeypatch, query_block):
    """Fewer candidates than neighbours: all of them. Vectors of another length than the most frequent take no part. Equal vectors: the smaller id."""
    monkeypatch.setattr(ann, "QUERY_BLOCK", query_block)
    rows = [(i, [float(i // 2), 1.0]) for i in range(6)] + [(100, [1.0, 2.0, 3.0]), (200, [])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=2, block=4).collect()
    for q in (0, 2, 4):
        want = sorted((abs(q // 2 - i // 2) * 1.0, i) for i in range(6) if i != q)
        assert [(r.score, r.vec_id) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == want
    assert len(found) == 15


def test_urls(spark):
    urls = ["http://www.EXAMPLE.com/en/a?x", "https://m.casino.org", "http://a.net/es/", "http://free-bets.org/x", "http://free.org/", "casino", None, "x://h#f", "http://freebets.org", "http://example.com/de/"]
    found = {r.page_id: r for r in urlfilter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [found[i].verdict for i in range(10)] == ["allow", "block", "block", "block", "allow", "block", "allow", "allow", "allow", "allow"]
    assert (found[0].host, found[0].path, found[0].rule) == ("www.example.com", "/en/a", "www.example.com/en/") and (found[7].host, found[7].path) == ("h", "")


def test_urls_on_awkward_rows(spark):
    """Null ids, repeated rows, a clashing column and a very long url are judged like others; an empty table is empty; terms may come as a table."""
    long = "http://a.org/" + "x" * 200_000 + "/casino"
    rows = [(None, "http://a.org/porn", "h"), (1, long, "h"), (1, long, "h"), (2, "", "h"), (3, "://", "h"), (4, "http://a.com", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = sorted(map(tuple, urlfilter.filter_urls(df).select("page_id", "host", "rule", "verdict").collect()), key=str)
    assert found == sorted([(None, "a.org", None, "block"), (1, "a.org", None, "block"), (1, "a.org", None, "block"), (2, "", None, "allow"), (3, "", None, "allow"), (4, "a.com", None, "allow")], key=str)
    assert urlfilter.filter_urls(df.limit(0)).count() == 0
    terms = spark.createDataFrame([("Xxx", False), ("apple", True), ("apple", False), (None, True), ("", True), ("pear", None)], "term string, strict boolean")
    strict, soft = urlfilter.vocabulary_terms(terms)
    assert (strict, soft) == (["apple"], ["Xxx", "pear"])
    urls = spark.createDataFrame([(0, "http://a.org/apple"), (1, "http://a.org/xxx"), (2, "http://a.org/XXX-pear")], "page_id long, url string")
    assert [r.verdict for r in urlfilter.filter_urls(urls, strict=strict, soft=soft).orderBy("page_id").collect()] == ["block", "allow", "block"]


def test_quality_by_hand(spark):
    """Posteriors of each document without its own part, worked out row by row; sites of one row, conflicting and foreign labels, null host and id."""
    rng = random.Random(6)
    rows = []
    for i in range(240):
        host = rng.choice(["a", "a", "a", "b", "c", None])
        words = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(3, 60)))
        rows.append((i, words + ("!!! $$$ ..." * rng.randint(1, 5) if (i % 3 == 0) ^ (host == "b") else ""), host, rng.choice(["x", "y", f"only{i}"])))
    rows += [(None, "some text", "a", "x"), (240, "", "lone", "x"), (241, None, "a", "x"), (7, rows[7][1], rows[7][2], rows[7][3])]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)] + [(1, 0), (2, 5), (None, 1)], "doc_id long, quality int")
    found = quality.quality(df, labels, host="host", path="path")
    mine = found.collect()
    assert len(mine) == len(rows)
    # The same features and fit; everything after them by hand.
    x = {(r.doc_id, r.text): r.x for r in df.select("doc_id", "text", F.array(*(f.cast("double") for f in quality.features(F.col("text")))).alias("x")).collect()}
    y = {}
    for i, v in [(i, int(i % 3 > 0)) for i in range(120)] + [(1, 0)]:
        y[i] = min(v, y.get(i, 1))
    order = sorted(((r.h, r.doc_id, r.text) for r in df.where("doc_id < 120").select(F.xxhash64("doc_id").alias("h"), "doc_id", "text").collect()))
    w0, w = quality.fit([(x[d, t], y[d]) for _, d, t in order])
    data = [(d, h or "", p, 1 / (1 + np.exp(-np.clip(w0 + float(np.dot(w, x[d, t])), -30, 30)))) for d, t, h, p in rows]
    total = sum(e for *_, e in data)
    mean = (total + 1) / (len(data) + 2)

    def sites(key):
        out = {}
        for r in data:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, s + r[3])
        return out

    hosts, paths = sites(lambda r: r[1]), sites(lambda r: (r[1], r[2]))

    def strength(groups, center):
        some = [(n, s, center(k)) for k, (n, s) in groups.items() if n > 1]
        n_all = sum(n for n, *_ in some)
        m = sum(s for _, s, _ in some) / n_all
        return quality.strength(m, sum(n * (s / n - c) ** 2 for n, s, c in some) / n_all - m * (1 - m) * len(some) / n_all)

    m_host, m_path = strength(hosts, lambda k: mean), strength(paths, lambda k: hosts[k[0]][1] / hosts[k[0]][0])
    logit = lambda q: np.log(q / (1 - q))
    want = []
    for d, h, p, e in data:
        at_host = (hosts[h][1] - e + m_host * mean) / (hosts[h][0] - 1 + m_host)
        at_path = (paths[h, p][1] - e + m_path * at_host) / (paths[h, p][0] - 1 + m_path)
        score = 1 / (1 + np.exp(-(logit(np.clip(e, 1e-6, 1 - 1e-6)) + logit(np.clip(at_path, 1e-6, 1 - 1e-6)) - logit(mean))))
        want.append((-1 if d is None else d, e, at_host, at_path, score))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.evidence, r.host_posterior, r.path_posterior, r.score) for r in mine)
    assert np.allclose(np.array(got), np.array(sorted(want)), atol=1e-9)
    # Labels of one class: the evidence is one rate.
    one = quality.quality(df, labels.where("quality = 1 AND doc_id > 50"), host="host", path="path").select("evidence").distinct().collect()
    assert len(one) == 1 and 0.5 < one[0].evidence < 1


def test_toxicity_learns_and_never_sees_held_out_rows(spark, docs, empty):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    data = [(i, " ".join([*(rng.choice(words) for _ in range(40)), *(["nastyword", "vilename"] if i % 6 == 0 else [])])) for i in range(900)]
    d, labels = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in data] + [(None, 1), (3, None)], "doc_id long, toxic int")
    found = toxicity.toxicity(d, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in found if r.held_out]) > 0.95
    flipped = labels.withColumn("toxic", F.when(F.expr("crc32(cast(doc_id AS string)) % 5 = 0"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(d, flipped).collect()} == {r.doc_id: r.score for r in found}
    assert toxicity.toxicity(docs, labels.limit(0)).count() == docs.count() and toxicity.toxicity(empty, labels).count() == 0


def test_quality_and_lm(spark, docs, empty, rows):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    found = quality.quality(docs, labels, host="bucket", path=F.col("r_id"))
    assert found.count() == len(rows) and found.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.quality(empty, labels, host="bucket", path="bucket").count() == 0
    assert quality.strength(0.5, 0.25 / 11) == pytest.approx(10) and quality.strength(None, None) == 1e4
    lm = lm_score.cross_entropy_difference(docs, F.col("doc_id") < 30).collect()
    assert len(lm) == len(rows) and all(r.score == 0 for r in lm if not r.n_tokens)
    # Documents like the target's score higher, those of the target itself no more than others like them.
    rng = random.Random(2)
    own = [(i, " ".join(f"{'near' if i % 2 else 'far'}{rng.randrange(40)}" if rng.random() < 0.5 else f"both{rng.randrange(40)}" for _ in range(60))) for i in range(200)]
    lm = lm_score.cross_entropy_difference(spark.createDataFrame(own, "doc_id long, text string"), F.expr("doc_id < 100 AND doc_id % 2 = 1")).collect()
    mean = lambda ok: np.mean([r.score for r in lm if ok(r.doc_id)])
    target, like, other = mean(lambda i: i < 100 and i % 2), mean(lambda i: i >= 100 and i % 2), mean(lambda i: i % 2 == 0)
    assert target > other + 0.5 and like > other + 0.5 and abs(target - like) < 0.05
    assert lm_score.cross_entropy_difference(empty, F.lit(True)).count() == 0
