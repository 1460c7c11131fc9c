"""Losses of the language models against counts of every n-gram."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspan.llm import lm_score


@pytest.mark.parametrize("small", [{}, {"block_bytes": 1 << 10}])
def test_losses_of_exact_counts(spark, small):
    rng = random.Random(3)
    vocabulary = [f"Wort{i}" for i in range(3000)] + ["é", "a"]
    rows = [(i, " ".join(rng.choice(vocabulary if rng.random() < 0.5 else vocabulary[:20]) for _ in range(rng.choice([0, 1, 30, 90])))) for i in range(200)]
    rows += [(300, None), (301, " \t\n"), (None, "Wort1 Wort2"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = [(i, (t or "").translate({**{c: c + 32 for c in range(65, 91)}}).split()) for i, t in rows]
    model = {}
    for side, ok in (("t", lambda i: i is not None and i < 60), ("g", lambda i: True)):
        words = Counter(w for i, t in tokens if ok(i) for w in t)
        pairs = Counter(p for i, t in tokens if ok(i) for p in zip(["", *t], t))
        words[""] = sum(bool(t) for i, t in tokens if ok(i))
        model[side] = words, pairs, sum(words.values()) - words[""]
    n_words = len({w for _, t in tokens for w in t})

    def loss(side, t, inside):
        """By the counts of the other documents."""
        words, pairs, n = model[side]
        if inside:
            own = Counter(t)
            own[""] = bool(t)
            words, pairs, n = words - own, pairs - Counter(zip(["", *t], t)), n - len(t)
        p = [0.6 * pairs[h, w] / max(words[h], 1) + 0.4 * (words[w] + 1) / (n + n_words) for h, w in zip(["", *t], t)]
        return sum(-math.log(x) for x in p) / max(len(t), 1)

    expected = sorted((-1 if i is None else i, len(t), loss("t", t, i is not None and i < 60), loss("g", t, True)) for i, t in tokens)
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in lm_score.cross_entropy_difference(docs, F.col("doc_id") < 60, **small).collect())
    assert len(found) == len(expected)
    for f, e in zip(found, expected):
        assert f[:2] == e[:2] and f[2:] == pytest.approx(e[2:], abs=1e-9)
