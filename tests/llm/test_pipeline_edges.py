"""Every stage on an empty table, with clashing columns, and with repeated rows; the whole run."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row", "component", "bucket", "gone", "more", "check", "r_id", "carried", "band", "sig", "items", "predicted", "contaminated", "n_bytes", "sequence_id", "y", "a", "b"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(rng.randint(30, 90)), "en", "s", 1) for i in range(80)]
    rows += [rows[3], rows[3], (90, None, None, None, None), (91, "", "en", "s", 0), (92, "one", "en", "s", 3), (93, rows[5][1], "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, say(40))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("place", range(5))
def test_empty_and_clashing(spark, folder, place, tmp_path):
    name, stage = corpus_pipeline.STAGES[place]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    empty = stage(spark, docs.limit(0), folder)
    assert empty.count() == 0
    plain = stage(spark, docs, folder)
    docs.withColumns({c: F.lit("x") for c in CLASHES}).write.parquet(str(tmp_path / "wide"))
    wide = stage(spark, spark.read.parquet(str(tmp_path / "wide")), folder)
    assert plain.columns == wide.columns == empty.columns
    own = [c for c in plain.columns if c not in ("sequence_id", "offset")]
    assert sorted(map(str, plain.select(*own).collect())) == sorted(map(str, wide.select(*own).collect()))
    if place < 4:
        # Nothing is toxic or contaminated here; of copies one row stays.
        kept = sorted(r.doc_id for r in plain.collect())
        assert plain.columns == corpus_pipeline.COLUMNS
        assert kept == ([*range(80), 90, 91, 92] if name == "near_duplicates" else sorted(r.doc_id for r in docs.collect()))


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    found = {r.doc_id: r.doc_tokens for r in out.collect()}
    assert set(found) == {*range(80), 90, 91, 92} and found[90] == found[91] == 1
