from __future__ import annotations

import random

import corpus_pipeline
from tests.llm import brute


def test_each_stage_takes_effect(spark, tmp_path):
    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choice("aeinorst") for _ in range(5)) for _ in range(n))
    leak, copy = words(15), words(80)
    data = [(i, words(40) + (" loser scum idiot" if i % 4 == 0 else ""), "en", "s", 1) for i in range(80)]
    data += [(100, words(10) + " " + leak, "en", "s", 1), (101, copy, "en", "s", 1), (102, copy + " end", "en", "s", 1), (103, words(20) + " me@here.org", "en", "s", 1), (104, None, "en", "s", 0), (105, copy, "en", "s", 1)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, cols).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in cols.split(", ")], name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({x.doc_id: x.text for x in docs.collect()})
    toxic, near, leaks, private = kept
    assert set(toxic) == {d[0] for d in data if not (d[0] < 80 and d[0] % 4 == 0)}
    assert set(toxic) - set(near) == {102, 105}
    assert set(near) - set(leaks) == {100}
    assert set(private) == set(leaks) and private[103].endswith("<email>") and private[104] is None
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(private) and out[104].ids_sha256 == brute.sha(b"2")
