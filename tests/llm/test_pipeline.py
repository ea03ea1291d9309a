"""The pipeline against plain versions of its stages, each on what the one before kept."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
from folioforge.llm import bpe

from . import brute


def corpus():
    r = random.Random(21)
    prose = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    texts = [prose(r.randrange(60, 200)) for _ in range(60)]
    benchmark = [(1, prose(30)), (2, prose(20))]
    texts += [texts[3], texts[4] + " tail", "short", None, "", ("same words here " * 60), prose(60) + " " + benchmark[0][1], prose(900) + " " + benchmark[1][1]]
    texts += [prose(80) + ' token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061aaa" ' + prose(5), prose(70) + " $$$$" * 50, None, prose(90)]
    return [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)], benchmark


def test_stages(spark, tmp_path):
    rows, benchmark = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            docs.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    texts = {r[0]: r[1] for r in rows}
    assert set(kept[0]) == {k for k, t in texts.items() if not brute.quality(t)[5]} - {69}
    same = brute.near_dup(kept[0], 5)
    assert set(kept[1]) == {k for k, (_, c) in same.items() if k == c}
    assert set(kept[2]) == {k for k, t in kept[1].items() if not brute.contamination(t, benchmark)[4]}
    assert set(kept[3]) == set(kept[2]) and "f3ef4d" not in kept[3][68]
    assert all(kept[3][k] == t for k, t in kept[2].items() if k != 68)
    t = bpe.make()
    for r in docs.collect():
        ids = t.encode(kept[3][r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[3])
