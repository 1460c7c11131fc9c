"""The stages in order on a small fixture."""

import random

import corpus_pipeline
from larkspan.llm.core import read


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage, item = " ".join(say(60)), " ".join(say(40))
    docs = {i: " ".join(say(rng.randint(60, 240))) for i in range(400)}
    for i in range(0, 400, 5):
        docs[i] += " nastyword vilename"
    docs[401], docs[402] = " ".join([*say(90), passage]), " ".join([*say(50), passage, *say(150)])
    docs[403] = docs[3][:-8] + " changed"
    docs[404] = item + " " + " ".join(say(60))
    docs[405] = ""
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(406, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = read(spark, str(tmp_path), "documents"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen[name] = now
        if k < 4:
            assert now.columns == corpus_pipeline.COLUMNS
    ids = lambda n: {r.doc_id for r in seen[n].select("doc_id").collect()}
    clean = set(docs) | {406}
    assert ids("toxicity") == clean - set(range(0, 400, 5))
    assert ids("near_duplicates") == ids("toxicity") - {403}
    cut = {r.doc_id: r.text for r in seen["suffix_dedup"].collect()}
    assert set(cut) == ids("near_duplicates") and passage not in cut[402] and cut[7] == docs[7] and cut[406] is None
    assert ids("decontamination") == set(cut) - {404}
    assert {r.doc_id for r in now.collect()} == ids("decontamination")
