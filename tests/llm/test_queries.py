"""The registered queries over a folder of small tables: the contract's columns, every row, and SQL where there is some."""

from __future__ import annotations

import random
import zlib

import duckdb
import pytest

from folioforge.llm import registry

from . import brute
from .test_operators import odd_texts, words

COLUMNS = {
    "op1_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op2_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op4_near_dup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_quality_gam": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op12_mixture": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, r = str(tmp_path_factory.mktemp("sf")), random.Random(31)
    texts = odd_texts() + [words(r, r.randrange(60, 150), 2000) + (" horribleword again" if k % 3 == 0 else "") + (" $$$ ###" * 30 if k % 4 == 0 else "") for k in range(160)]
    rows = [(k, t, ["en", "de"][k % 2], f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    first = len(odd_texts())
    labels = [(k, int((k - first) % 4 != 0), int((k - first) % 3 == 0)) for k in range(first, len(texts))]
    benchmark = [(1, texts[5]), (2, texts[10][:600]), (3, "solo"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, labels


@pytest.fixture(scope="module")
def results(spark, folder):
    return {name: f(spark, folder[0]).toPandas() for name, f in registry.QUERIES.items()}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, folder, results, name):
    kinds = dict(registry.QUERIES[name](spark, folder[0]).dtypes)
    assert all(kinds[c] == k for c, k in COLUMNS[name].items())
    assert sorted(results[name]["doc_id"]) == list(range(len(folder[1])))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_agrees(folder, results, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder[0]}/{t}.parquet/*.parquet'")
    res = con.execute(registry.ORACLES[name])
    cols = [d[0] for d in res.description]
    theirs = sorted(str([str(v) for v in row]) for row in res.fetchall())
    mine = sorted(str([str(v) for v in row]) for row in results[name][cols].itertuples(index=False))
    assert mine == theirs


def test_base_rules_hold_in_the_queries(folder, results):
    rows = {n: {r.doc_id: r for r in results[n].itertuples()} for n in ("op1_pii", "op2_secret_scan", "op9_license_scan", "op8_sharding")}
    for k, t in enumerate(folder[1]):
        assert rows["op1_pii"][k].base_sha256 == brute.spans(t, brute.PII)[2]
        assert rows["op2_secret_scan"][k].base_sha256 == brute.spans(t, brute.SECRETS)[2]
        assert rows["op9_license_scan"][k].n_base == brute.licenses(t)[1]
        raw = (t or "").encode()
        assert (rows["op8_sharding"][k].size, rows["op8_sharding"][k].text_crc32) == (len(raw) + 1, zlib.crc32(raw))


@pytest.mark.parametrize(("name", "label", "parts", "part"), [("op5_toxicity", 2, 3, 1), ("op7_quality_gam", 1, 4, 2)])
def test_held_out_accuracy(folder, results, name, label, parts, part):
    truth = {r[0]: r[label] for r in folder[2]}
    own = results[name]
    assert all(own["held_out"] == [zlib.crc32(str(k).encode()) % parts == part for k in own["doc_id"]])
    held = own[own["held_out"] & own["doc_id"].isin(truth)]
    assert (held["predicted"] == held["doc_id"].map(truth)).mean() >= 0.9
    assert ((own["score"] >= 0.7) == (own["predicted"] == 1)).all() and own["score"].between(0, 1).all()
