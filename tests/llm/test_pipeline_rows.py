"""Each row has its own verdict in the filter stages, without an id and with a repeated one."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_without_or_with_a_shared_id(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bad, item = " nastyword vilename", say(40)
    docs = {i: say(rng.randint(60, 240)) + (bad if i % 5 == 0 else "") for i in range(400)}
    nasty, clean, lone, copied, contaminated = say(90) + bad, say(90), say(80), say(70), item + " " + say(30)
    rows = [*docs.items(), (None, nasty), (500, nasty + " too"), (500, clean), (None, docs[7]), (501, lone), (501, copied), (None, copied), (None, contaminated), (502, contaminated + " too"), (502, say(75))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    left = lambda name: [(r.doc_id, r.text) for r in stage[name](spark, df, str(tmp_path)).collect()]
    assert sorted(left("toxicity"), key=str) == sorted((r for r in rows if bad.strip() not in r[1]), key=str)
    near = left("near_duplicates")
    assert (None, docs[7]) not in near and (7, docs[7]) in near and (None, copied) not in near
    assert (501, lone) in near and (501, copied) in near and (500, clean) in near
    clear = left("decontamination")
    assert (None, contaminated) not in clear and (502, rows[-1][1]) in clear and len(clear) == len(rows) - 2
