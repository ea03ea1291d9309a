"""Operators that write, chunk, stream or guard."""

from __future__ import annotations

import datetime as dt
import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.facade import Library, resolve, search_all
from folioforge.operators import catalogue as cat
from folioforge.operators import chunking as ck
from folioforge.operators import chunkstore as cs
from folioforge.operators import filters as flt
from folioforge.operators import html
from folioforge.operators import lifecycle as life
from folioforge.operators import repair
from folioforge.operators import retrieval as ret
from folioforge.operators import segments, tables, vectors
from folioforge.operators.vectors import IVF, embed_texts, hashed_embedder
from folioforge.sources import annotations, books, chats, clippings, folders, notes, prepared, sqlite
from folioforge.streaming import incremental as inc
from tests.conftest import most_rows

CHUNK = "id string, book_id string, text string, chunk_type string, section_type string, language string, tags string, chunk_index int, parent_id string, page_number int, page_label string, indexed_at string, metadata_hash string, annotation_hash string"


def chunk(i, book, text, kind="content", tags="", parent="", page=1, label=""):
    return (i, book, text, kind, "main_content", "en", tags, int(i[1:] or 0), parent, page, label, "2024-01-01", "h", "")


@pytest.fixture(scope="module")
def chunks(spark):
    pad = " filler" * 30
    rows = [chunk("c1", "b1", "Immanuel Kant on pure reason." + pad, tags="Philosophy, Kant"), chunk("c2", "b1", "Kantine means canteen in German." + pad), chunk("c3", "b2", "The critique of pure reason, Kant wrote." + pad, label="xiv"), chunk("c4", "b2", "short"), chunk("c5", "b1", "Kant and Kant again." + pad), chunk("c6", "b3", "parent text " * 60, "parent"), chunk("c7", "b3", "Reason is a child chunk." + pad, "child", parent="c6"), chunk("c8", "b4", "Comment on Kant." + pad, "calibre_comment")]
    return spark.createDataFrame(rows, CHUNK)


def test_search_diversifies_and_cites(spark, chunks):
    lib = Library(chunks, embed_texts(chunks.select("id", "text")))
    rows = lib.search("Kant reason", per_book=1).collect()
    assert len({r["book_id"] for r in rows}) == len(rows) and {r["id"] for r in rows} <= {"c1", "c2", "c3", "c5", "c7"}
    assert {r["id"]: r["citation"] for r in rows}["c3"] == "xiv"
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))
    text, used = lib.search_with_citations("Kant reason")
    assert "<documents>" in text and used.count() > 0
    assert lib.search_annotations("Kant").select("id").collect()[0]["id"] == "c8"
    assert lib.search("pure reason", phrase=True).count() == 2
    with pytest.raises(ValueError, match="fuzzy"):
        lib.duplicates("fuzzy")


def test_several_libraries(spark, chunks):
    libs = {"a": Library(chunks), "b": Library(chunks.withColumn("id", F.concat("id", F.lit("x"))))}
    rows = search_all(libs, "Kant", k=4, mode="keyword").orderBy("rank").collect()
    assert [r["source"] for r in rows] == ["a", "b", "a", "b"] and resolve(libs, "a") is libs["a"]
    with pytest.raises(KeyError):
        resolve(libs)


def test_interest_boost_counts_whole_words(spark, chunks):
    scored = chunks.filter("id IN ('c1', 'c2')").withColumn("score", F.lit(1.0))
    got = {r["id"]: r["score"] for r in ret.interest_boost(scored, ["Kant"]).collect()}
    assert got == {"c1": 1.15, "c2": 1.0}


def test_context_prefers_the_parent(spark, chunks):
    got = {r["id"]: r["context"] for r in ret.expand_context(chunks, chunks).collect()}
    assert got["c7"].startswith("parent text") and got["c4"] == "short"


def test_pushdown_and_plans(spark, tmp_path, chunks, capsys):
    chunks.write.parquet(f"{tmp_path}/c")
    df = spark.read.parquet(f"{tmp_path}/c").filter(flt.chunk_filter(section="main", chunk_type="content", language="en")).select("id")
    df.explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(x for x in plan.split("\n") if x.startswith("PushedFilters"))
    assert "EqualTo(language,en)" in pushed and "In(chunk_type, [child,content])" in pushed
    assert "text:string" not in next(x for x in plan.split("\n") if x.startswith("ReadSchema"))
    ranked = ret.ranked(chunks.select("id", F.lit(1.0).alias("score")), 3)
    assert "TakeOrderedAndProject" in ranked._jdf.queryExecution().executedPlan().toString()
    div = ret.diversify(chunks.withColumn("rank", F.col("chunk_index")), 2, 5)
    assert "WindowGroupLimit" in div._jdf.queryExecution().executedPlan().toString()


def test_store_round_trip(spark, tmp_path, chunks):
    path = f"{tmp_path}/store"
    cs.swap_in(chunks, path, ["chunk_type"])
    new = chunks.filter("id = 'c1'").withColumn("text", F.lit("new"))
    cs.swap_in(cs.upsert(cs.read_chunks(spark, path), new), path, ["chunk_type"])
    back = cs.read_chunks(spark, path)
    assert back.count() == 8 and back.filter("id = 'c1'").first()["text"] == "new"
    cs.swap_in(cs.without(cs.read_chunks(spark, path), F.col("book_id") == "b1"), path)
    assert cs.read_chunks(spark, path).count() == 5
    with pytest.raises(ValueError, match="text"):
        cs.update_metadata(back, "b1", {"text": "no"})


def test_versions_of_a_table(spark, tmp_path):
    """A reader sees the old version or the new one; versions past the retention go; buckets that no new row falls into stay."""
    import os

    path, rows = f"{tmp_path}/t", spark.range(100).withColumn("v", F.lit(1))
    tables.publish(rows, path)
    first, before = tables.current(spark, path), tables.read(spark, path)
    tables.publish(rows.limit(3), path)
    assert before.count() == 100 and tables.read(spark, path).count() == 3 and os.path.isdir(first)
    rows.write.parquet(f"{path}/v-broken")  # what a writer that died left
    assert tables.read(spark, path).count() == 3
    tables.publish(rows.limit(5), path, retain=0)
    assert tables.read(spark, path).count() == 5 and not os.path.isdir(first)
    own = f"{tmp_path}/b"
    tables.change_buckets(rows, own, cs.upsert, buckets=8)
    kept = {n: tables.current(spark, f"{own}/{n}") for n in os.listdir(own) if n.startswith("b-")}
    tables.change_buckets(spark.createDataFrame([(7, 2)], "id long, v int"), own, cs.upsert, buckets=8)
    moved = [n for n in kept if tables.current(spark, f"{own}/{n}") != kept[n]]
    assert len(moved) == 1 and {r["id"]: r["v"] for r in tables.read_buckets(spark, own).collect()} == {k: 2 if k == 7 else 1 for k in range(100)}


def files_of(path):
    import os

    return {os.path.relpath(os.path.join(at, n), path) for at, _, names in os.walk(path) for n in names if n.startswith("part-")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_text_index_scores_as_a_scan(spark, tmp_path, chunks):
    index = ret.TextIndex.build(chunks.filter("id <> 'c3'"), f"{tmp_path}/index")
    index.add(chunks.filter("id IN ('c3', 'c1')"))
    for query in ("Kant reason", "filler the of", "nothing here", "..."):
        want = {r["id"]: r["score"] for r in ret.bm25(chunks, query).collect()}
        assert {r["id"]: r["score"] for r in index.bm25(query).collect()} == want
        assert index.top(query, 3).collect() == ret.ranked(ret.bm25(chunks, query), 3).collect()
    few = chunks.filter("book_id = 'b1'").select("id")
    assert {r["id"] for r in index.bm25("Kant", few).collect()} == {r["id"] for r in ret.bm25(chunks, "Kant", F.col("book_id") == "b1").collect()}
    plan = plan_of(index.bm25("Kant"))
    assert "bucket#" in plan[plan.index("PartitionFilters") :][:200] and "term,kant" in plan.lower().replace(", [", ",").replace("in(term", "term") and "text:string" not in plan


def test_text_index_is_kept_up_and_read_in_part(spark, tmp_path, monkeypatch):
    """After changes of every kind the best k are those of a scan, before and after a merge, in this session's object and a new one."""
    import random

    monkeypatch.setattr(ret, "BLOCK", 8)
    monkeypatch.setattr(ret, "PER_BUCKET", 75)
    monkeypatch.setattr(segments, "FILE_ROWS", 20)
    r = random.Random(6)
    text = lambda: " ".join(r.choice(["the"] * 6 + ["of"] * 3 + [f"w{j}" for j in range(40)]) for _ in range(r.randrange(1, 60)))
    rows = {k: text() for k in range(300)} | {600: None, 601: "", 602: "the " * 300}
    table = lambda d: spark.createDataFrame(sorted(d.items()), "id long, text string")
    path = f"{tmp_path}/t"
    index = ret.TextIndex.build(table(rows), path)

    def agrees():
        whole = table(rows)
        for query, own in (("the w3 w7", index), ("w39 zzz", index), ("of the", ret.TextIndex.open(spark, path))):
            assert own.top(query, 7).collect() == ret.ranked(ret.bm25(whole, query), 7).collect(), query
        assert {x["id"]: x["score"] for x in index.bm25("the w3").collect()} == {x["id"]: x["score"] for x in ret.bm25(whole, "the w3").collect()}
        among = whole.filter("id % 3 = 0").select("id")
        assert index.top("the w5", 5, among).collect() == ret.ranked(ret.bm25(whole, "the w5", F.col("id") % 3 == 0), 5).collect()

    agrees()
    before = files_of(path)
    change = {3: "w3 w3 w3", 10: "the", 700: "w7 w3 the", 701: text()}
    index.add(table(change))
    rows |= change
    index.drop(table({4: "", 602: "", 999: ""}).select("id"))
    rows = {k: v for k, v in rows.items() if k not in (4, 602)}
    agrees()
    stored = {f for f in before if "state" not in f and "numbers" not in f}
    assert stored <= files_of(path)  # what was stored is untouched
    index.merge()
    agrees()
    assert index.own.state().upto(None)[1] == [] and len(index.blocks.state().upto(None)[0]) == 1
    # a frequent word's list is in several files, and a search for a rare word beside it leaves most of it unread
    hot = index._blocks_of(["the"])
    assert hot.count() > 20 and len({x[0] for x in hot.select(F.input_file_name()).distinct().collect()}) > 1


def test_a_change_that_was_cut_off_does_not_count(spark, tmp_path):
    table = lambda d: spark.createDataFrame(sorted(d.items()), "id long, text string")
    index = ret.TextIndex.build(table({1: "a b", 2: "a"}), f"{tmp_path}/t")
    whole = index.own.change

    def broken(*a, **k):
        raise OSError("lost")

    index.own.change = broken
    with pytest.raises(OSError, match="lost"):
        index.add(table({2: "b b", 3: "a a a"}))
    index.own.change = whole
    want = ret.ranked(ret.bm25(table({1: "a b", 2: "a"}), "a b"), 5).collect()
    assert index.top("a b", 5).collect() == want and ret.TextIndex.open(spark, f"{tmp_path}/t").top("a b", 5).collect() == want
    index.add(table({2: "b b", 3: "a a a"}))
    assert index.top("a b", 5).collect() == ret.ranked(ret.bm25(table({1: "a b", 2: "b b", 3: "a a a"}), "a b"), 5).collect()


def test_library_searches_its_stored_indexes(spark, tmp_path, chunks):
    lib = Library(chunks, embed_texts(chunks.select("id", "text")))
    for mode in ("hybrid", "semantic", "keyword"):
        lib.vector_index = lib.text_index = None
        plain = [(r["id"], r["score"]) for r in lib.search("Kant reason", mode=mode).collect()]
        lib.build_indexes(f"{tmp_path}/{mode}")
        assert [(r["id"], r["score"]) for r in lib.search("Kant reason", mode=mode).collect()] == plain


def product_recall(spark, v, queries, k=10):
    index = vectors.IVFPQ.fit(v, v.count())
    coded = index.encode(v).cache()
    found = 0
    for q in queries:
        want = {r["id"] for r in ret.vector_search(v, q, k).collect()}
        found += len(want & {r["id"] for r in index.search(coded, v, q, k).collect()})
    assert coded.count() == v.count() and all(len(r["code"]) == vectors.SUB_VECTORS for r in coded.limit(5).collect())
    return found / (k * len(queries)), index


def test_product_codes_recall(spark):
    """On the embeddings table, whose vectors have little structure, and on clustered ones with new queries."""
    import numpy as np
    import os

    if os.path.isdir("/root/testdata/sf0.1"):
        v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector").cache()
        own = [[float(x) for x in r["vector"]] for r in v.filter("id % 50 = 0").limit(20).collect()]
        r = np.random.default_rng(1)
        mixed = [list(map(float, 0.7 * np.array(a) + 0.3 * np.array(b) + r.normal(0, 0.02, len(a)))) for a, b in zip(own, own[1:] + own[:1], strict=True)]
        recall, index = product_recall(spark, v, own[:10] + mixed[:10])
        assert recall >= 0.9 and index.probes <= len(index.lists.centroids)
    r = np.random.default_rng(2)
    centres = r.normal(size=(30, 40))
    x = (centres[r.integers(0, 30, 3000)] + r.normal(0, 0.3, (3000, 40))).astype(np.float32)
    v = spark.createDataFrame([(k, [float(a) for a in row]) for k, row in enumerate(x)], "id long, vector array<float>").cache()
    recall, index = product_recall(spark, v, [[float(a) for a in centres[k] + r.normal(0, 0.3, 40)] for k in range(12)])
    assert recall >= 0.9 and index.probes < len(index.lists.centroids)


def test_vector_index_is_kept_up(spark, tmp_path):
    """New, changed and deleted vectors, a merge, and a new session's object: recall against brute force on what is there."""
    import numpy as np

    r = np.random.default_rng(3)
    x = r.normal(size=(30, 16))[r.integers(0, 30, 900)] + 0.3 * r.normal(size=(900, 16))
    rows = {k: [float(a) for a in v] for k, v in enumerate(x)}
    table = lambda d: spark.createDataFrame(list(d.items()), "id long, vector array<float>")
    path = f"{tmp_path}/v"
    index = vectors.VectorIndex.build(table({k: v for k, v in rows.items() if k < 800}), path)
    before = files_of(path)

    def recall(own):
        now, found = table(rows), 0
        queries = [rows[k] for k in sorted(rows)[::90]]
        for q in queries:
            found += len({a["id"] for a in own(q, 10).collect()} & {a["id"] for a in ret.vector_search(now, q, 10).collect()})
        return found / (10 * len(queries))

    change = {k: rows[k] for k in range(800, 900)} | {7: [-a for a in rows[7]], 9: rows[9]}
    index.add(table(change))
    rows |= change
    assert index(rows[7], 1).first()["id"] == 7 and 7 not in {a["id"] for a in index([-a for a in rows[7]], 5).collect()}
    index.delete(table({k: rows[k] for k in (10, 850, 5000) if k in rows}).select("id"))
    gone = [rows.pop(10), rows.pop(850)]
    assert not {10, 850} & {a["id"] for q in gone for a in index(q, 5).collect()}
    assert {f for f in before if "state" not in f} <= files_of(path)  # nothing that was stored is rewritten
    for own in (index, vectors.VectorIndex.open(spark, path)):
        assert recall(own) >= 0.9
    index.merge()
    again = vectors.VectorIndex.open(spark, path)
    assert recall(again) >= 0.9 and index.rows.live().count() == len(rows)
    assert again(rows[20], 1, table(rows).filter("id = 30").select("id")).first()["id"] == 30
    plans = plan_of(again.rows.stored().filter(F.col("list_id").isin([1, 2])).select("id", "code"))
    assert "vector" not in plans[plans.index("ReadSchema") :] and "list_id" in plans[plans.index("PartitionFilters") :][:200]
    late = plan_of(again(rows[20], 3))
    assert "list_id" in late[late.index("PartitionFilters") :][:200] and "id" in late[late.index("PushedFilters") :][:200]


def test_vector_index_grows_from_a_few_rows(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(4)
    rows = [(k, [float(a) for a in r.normal(size=8)]) for k in range(400)]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    small = vectors.VectorIndex.build(v.filter("id < 100"), f"{tmp_path}/s")
    assert small.index is None and small(rows[7][1], 1).first()["id"] == 7
    small.add(v.filter("id < 200"))
    assert vectors.VectorIndex.open(spark, f"{tmp_path}/s").index is None and small(rows[150][1], 1).first()["id"] == 150
    small.add(v.filter("id >= 90"))
    own = vectors.VectorIndex.open(spark, f"{tmp_path}/s")
    assert small.index is not None and own.rows.live().count() == 400
    assert [own(rows[k][1], 1).first()["id"] for k in (5, 95, 350)] == [5, 95, 350]
    again = vectors.VectorIndex.build(v.filter("id < 300"), f"{tmp_path}/s")
    assert again.rows.live().count() == 300


def test_close_titles_are_all_pairs_within_the_bound(spark):
    import random

    r = random.Random(4)
    texts = {"".join(r.choice("abc ") for _ in range(r.randrange(1, 14))) for _ in range(150)} | {"", "a"}
    by = [(t, "x") for t in texts] + [(t, "y") for t in list(texts)[:40]]
    x = spark.createDataFrame(by, "__x string, g string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    for share in (0.15, 0.3, 0.45):
        got = {(p["g"], p["__x"], p["__y"]) for p in cat.close_titles(x, x.withColumnRenamed("__x", "__y"), share, ["g"]).collect()}
        want = {(g, a, b) for a, g in by for b, h in by if g == h and a and b and edits(a, b) <= max(len(a), len(b), 1) * share + 1e-6}
        assert {p for p in got if p[1] and p[2]} == want


def test_running_lines_are_grouped_and_removed(spark):
    pages = [("b", k, f"{'The History of Rome' if k % 3 else 'The Hist0ry of Rome'} {k}\nbody {'x' * k} of page\n\nmore text {k * 7}\nlast words {chr(97 + k % 26) * 9}\nVerlag Beispiel, {k}") for k in range(1, 13)]
    pages += [("c", 1, "The History of Rome 1\ntext"), ("c", 2, "other\nThe History of Rome 2"), ("d", 1, "")]
    df = spark.createDataFrame(pages, "book string, page int, text string")
    got = {(r["book"], r["place"], r["line"]): r["pages"] for r in ck.running_lines(df).collect()}
    assert got[("b", "header", "the history of rome #")] == 12 and got[("b", "footer", "verlag beispiel, #")] == 12 and not any(b == "c" for b, *_ in got)
    left = {(r["book"], r["page"]): r["text"] for r in ck.without_running_lines(df).collect()}
    assert left["b", 5].startswith("body") and "Verlag" not in left["b", 5] and left["c", 1] == pages[12][2] and left["d", 1] == ""


def test_page_labels_roman_and_gaps():
    assert ck.page_labels(["i", "ii", None, "iv", "1", "2", None, "4", "5", "6", "7", "8", None, "10", "11", None]) == ["i", "ii", "3", "iv", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12"]
    assert ck.page_labels([None, None]) == [None, None] and ck.page_labels([None, "5", None]) == ["4", "5", "6"] and ck.page_labels([]) == []
    assert [ck._roman(x) for x in ("XIV", "iiii", "MCMXC", "vx", "IX")] == [14, None, 1990, None, 9]


def test_dialogue_markers():
    assert ck.dialogue_turns("**User:** hi\nthere\n\n**Claude**: yo\nUser:\n") == [("User", "hi\nthere"), ("Claude", "yo\nUser:")]
    assert ck.dialogue_turns("**[YOU]**\nabc\n**[BOT 2]**\nx") == [("You", "abc"), ("Bot 2", "x")]
    assert ck.dialogue_turns("User:\nhey\nAI model:\nok\nnot a marker: x") == [("User", "hey"), ("AI model", "ok\nnot a marker: x")]
    assert ck.dialogue_turns("2nd:\nx\n**a*b**: y\n" + "x" * 40 + ":\n") == [] and ck.dialogue_turns(None) == []


def test_messages():
    from folioforge.functions import messages as m

    assert m.say("books", "de_AT.UTF-8", n=3) == "3 Bücher" and m.say("comment", "de") == "Kommentar" and m.say("comment", "fr") == "Comment" and m.say("no such key", "fr") == "no such key"
    assert m.say("no_results", None, query="x") == "Nothing was found for 'x'." and m.say("books", "en") == "{n} books"
    assert m.ocr_codes("de, fr,xx,de") == "deu+fra" and m.ocr_codes("") == "eng" and m.ocr_codes("zh,ja,ko") == "chi_sim+jpn+kor"
    assert m.MESSAGES["de"].keys() == m.MESSAGES["en"].keys()


def test_orphan_bound(spark):
    ids = lambda a, b: spark.range(a, b).selectExpr("cast(id as string) id")
    bound = lambda *a, **k: life.orphan_bound(*a, **k).first()["allowed"]
    assert bound(ids(0, 1250), ids(25, 1250))  # exactly 2 % and 25
    assert not bound(ids(0, 1000), ids(26, 1000)) and bound(ids(0, 1000), ids(26, 1000), allow_large=True)
    assert bound(ids(0, 100), ids(20, 100))  # a large share of a few
    assert not bound(ids(0, 100), ids(1, 100), partial=True) and not bound(ids(0, 100), ids(0, 0))


def test_sessions_split_after_the_gap(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m) if m is not None else None
    rows = [("u", k, t(m)) for k, m in enumerate([0, 30, 61, 62, None])]
    got = life.sessions(spark.createDataFrame(rows, "u string, k int, ts timestamp"), "u", "ts", "k").orderBy("k").collect()
    assert [r["session"] for r in got] == [0, 0, 1, 1, 1]
    stale = cs.stale_rows(spark.createDataFrame([("b", t(m)) for m in (0, 15, 31, 40)], "b string, ts timestamp"), "b", "ts")
    assert stale.count() == 2


def test_routine_throttle():
    d = dt.date
    assert life.should_skip(d(2024, 12, 30), "weekly", d(2025, 1, 2)) and not life.should_skip(d(2024, 12, 29), "weekly", d(2025, 1, 2))
    assert life.should_skip(d(2024, 1, 1), "daily", d(2024, 1, 1)) and not life.should_skip(None, "daily", d(2024, 1, 1))
    assert life.interests({"research_interests": []}, {"research_interests": ["x"]}) == [] and life.interests(None, {"research_interests": ["x"]}) == ["x"]
    assert life.execution_plan(6)["batch"] == 8 and life.execution_plan(None)["device"] == "cpu"


def test_paragraph_chunks_lose_nothing():
    paras = [f"Paragraph {k}. " + "word " * 60 for k in range(40)]
    out = ck.paragraph_chunks("\n\n".join(paras))
    assert all(any(p.strip() in c["text"] for c in out) for p in paras) and all(len(c["window_text"]) >= len(c["text"]) for c in out)
    assert ck.paragraph_chunks("") == [] and ck.paragraph_chunks(None) == []
    long = " ".join(f"s{k} end." for k in range(2000))
    assert set(" ".join(c["text"] for c in ck.paragraph_chunks(long)).split()) == set(long.split())


def test_window_chunks():
    out = ck.window_chunks("aaaa bbbb cccc dddd ee", 10, 0, 3)
    assert [c["text"] for c in out] == ["aaaa bbbb", "cccc", "dddd ee"]
    assert ck.window_chunks("   ", 10, 2, 3) == []


def test_semantic_sections():
    text = "intro\n# One\nbody one\n## Two\nbody two\n### Deep\nbody three"
    assert [(n, t.split("\n")[0]) for n, t, _ in ck.sections(text)] == [(0, "intro"), (1, "# One"), (2, "## Two"), (3, "### Deep")]
    out = ck.semantic_chunks(text, overlap=0)
    assert [c["text"].split("\n")[0] for c in out] == ["intro", "# One", "## Two"] and "body three" in out[2]["text"]


@pytest.mark.parametrize("text", ["**User:** hi\n\n**Claude:** hello\n", "**[USER]**\nhi\n**[CLAUDE]**\nhello", "User:\nhi\nClaude:\nhello"])
def test_dialogues(text):
    turns = ck.dialogue_turns(text)
    assert [(a.lower(), b) for a, b in turns] == [("user", "hi"), ("claude", "hello")] and ck.dialogue_turns("no turns") == []
    assert ck.exchanges([*turns, ("User", "q1"), ("User", "q2")])[-1] == ("q1\n\nq2", "", "")
    long = [("User", "q" * 2000), ("AI", "\n\n".join(["p" * 900] * 6))]
    parts = ck.dialogue_chunks(long)
    assert len(parts) > 1 and all(c["text"].startswith("**User:** qqq") and "…" in c["text"] for c in parts)


def test_dialogue_query_reads_whole_texts(spark, tmp_path):
    from folioforge import catalog

    long = " ".join(f"w{k}" for k in range(900))
    rows = [(1, 0, "user", long + " end"), (1, 1, "assistant", "short\n\nand more"), (2, 0, "system", "x"), (2, 1, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["id"], r["chunk_index"]): (r["speaker"], r["text"]) for r in catalog.QUERIES["chk7_dialogue_turns"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): ("User", long + " end"), (1, 1): ("Assistant", "short\n\nand more"), (2, 0): ("System", "x"), (2, 1): ("User", "")}


def test_hierarchy_and_pages():
    kids = [{"text": "w " * 700, "chunk_index": k, "section": "a" if k < 3 else "b"} for k in range(5)]
    rows = ck.hierarchy(kids, "b1")
    assert [r["id"] for r in rows if r["chunk_type"] == "parent"] == ["b1_parent_0", "b1_parent_1", "b1_parent_2"]
    assert all(r["parent_id"] for r in rows if r["chunk_type"] == "child") and len(rows) == 8
    out = ck.page_chunks([(1, "p1 " * 200), (2, "p2 " * 200), (3, "p3 " * 300)])
    assert [c["page"] for c in out][0] == 1 and sum("p3" in c["text"] for c in out) >= 1
    assert ck.page_labels(["ii", "3", None, "5", "99", "7"]) == ["ii", "3", "4", "5", "6", "7"]


def test_comment_chunks():
    rows = ck.comment_chunks("<p>Start <b>Key</b></p><h2>Part</h2><p>!!!Mark!!! text.</p>", "9")
    assert rows[0]["text"] == "[CALIBRE_COMMENT] Key points: Key Start Key" and rows[1]["text"] == "[CALIBRE_COMMENT] ## Part ## Key points: Mark Mark text."
    assert [r["chunk_index"] for r in rows] == [-1, -2] and ck.comment_chunks("", "9") == []


def test_html():
    title, heads, text = html.read("<html><title>T &amp; x</title><script>no</script><nav>no</nav><h1>A<i>b</i></h1><div>one<p>two</p></div>")
    assert title == "T & x" and heads == [(1, "Ab")] and text == "Ab\none\ntwo" and html.read(None) == ("", [], "")


def test_ivf_recall(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(20, 16))[r.integers(0, 20, 1500)] + 0.2 * r.normal(size=(1500, 16))
    v = spark.createDataFrame([(k, [float(y) for y in row]) for k, row in enumerate(x)], "id long, vector array<float>")
    ivf = IVF.fit(v, 1500)
    assigned = ivf.assign(v).cache()
    hits = 0
    for q in range(0, 1500, 300):
        near = {a["id"] for a in ivf.search(assigned, x[q].tolist(), 10).collect()}
        hits += len(near & {a["id"] for a in ret.vector_search(v, x[q].tolist(), 10).collect()})
    assert hits >= 45
    assert abs(float((hashed_embedder()(["a b", ""])[0] ** 2).sum()) - 1) < 1e-6


@pytest.mark.parametrize("lists", [16, 100, 256])
def test_ivf_search_is_exact_on_the_embeddings(spark, monkeypatch, lists):
    import os

    import numpy as np

    from folioforge.operators import vectors

    path = f"{os.environ.get('FOLIOFORGE_TEST_DIR', '/root/testdata/sf0.001')}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    monkeypatch.setattr(vectors, "n_lists", lambda n: lists)
    v = spark.read.parquet(path).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).cache()
    ivf = IVF.fit(v, v.count())
    assigned = ivf.assign(v).cache()
    radii = ivf.radii(assigned)
    r = np.random.default_rng(1)
    queries = [row[0] for row in v.orderBy("id").limit(4).select("vector").collect()] + [r.normal(size=len(v.first()["vector"])).tolist()]
    for q in queries:
        assert ivf.search(assigned, q, 10, probes=2, radii=radii).collect() == ret.vector_search(v, q, 10).collect()


CLIPPINGS = """Die Blechtrommel (Günter Grass)
- Ihre Markierung bei Position 1234-1256 | Hinzugefügt am Montag, 15. März 2026 10:23:45

Zugegeben: ich bin Insasse
==========
A Book
- Your Note on page 7 | Location 99 | Added on Sunday, March 15, 2026 1:23:45 PM

First
second
==========
Broken
- what is this

==========
"""


def test_clippings(spark, tmp_path):
    (tmp_path / "c.txt").write_text("﻿" + CLIPPINGS, encoding="utf-8")
    rows = clippings.parse(clippings.read(spark, str(tmp_path)), "file").orderBy("type").collect()
    assert [(r["book_title"], r["book_author"], r["type"], r["page"], r["location"], r["text"]) for r in rows] == [("Die Blechtrommel", "Günter Grass", "highlight", None, "loc:1234-1256", "Zugegeben: ich bin Insasse"), ("A Book", None, "note", 7, "loc:99", "First\nsecond")]
    assert [r["created_at"] for r in rows] == [dt.datetime(2026, 3, 15, 10, 23, 45), dt.datetime(2026, 3, 15, 13, 23, 45)]


def test_prepared_files(spark, tmp_path):
    whole = ['{"_header":true,"book_id":"b","chunk_count":2}', '{"id":"b_0","text":"x","chunk_index":0}', '{"id":"b_1","text":"y","chunk_index":1}']
    (tmp_path / "a.jsonl").write_text("\n".join(whole))
    (tmp_path / "b.jsonl").write_text("\n".join(whole[:2]))
    lines = prepared.read_lines(spark, str(tmp_path))
    assert sorted(r["whole"] for r in prepared.completeness(lines).collect()) == [False, True] and prepared.rows(lines).count() == 2
    out = f"{tmp_path}/out"
    prepared.write(spark.createDataFrame([("b", "b_0", "x"), ("c", "c_0", "z")], "book_id string, id string, text string"), "book_id", out)
    again = prepared.completeness(prepared.read_lines(spark, f"{out}/*"))
    assert [r["whole"] for r in again.collect()] == [True, True]


def test_folders(spark, tmp_path):
    (tmp_path / "sub" / ".git").mkdir(parents=True)
    for name, body in {"2026-03-01_claude_josephus-context.md": "# x", "sub/7570_goodman_rome-and-jerusalem.md": "y", "sub/book.pdf": "%PDF-1.4", "sub/pic.png": "p", "sub/.git/x.md": "no", "draft_x.txt": "d", "sub/book.json": json.dumps({"title": "Side", "authors": ["A"], "tags": ["t"], "year": 1999})}.items():
        (tmp_path / name).write_text(body)
    got = {r["rel"]: r for r in folders.scan(spark, str(tmp_path), ["DRAFT*"]).collect()}
    assert set(got) == {"2026-03-01_claude_josephus-context.md", "sub/7570_goodman_rome-and-jerusalem.md", "sub/book.pdf"}
    assert got["sub/book.pdf"]["title"] == "Side" and got["sub/book.pdf"]["year"] == 1999
    assert got["sub/7570_goodman_rome-and-jerusalem.md"]["title"] == "Rome And Jerusalem" and got["sub/7570_goodman_rome-and-jerusalem.md"]["authors"] == ["Goodman"]
    assert folders.adapter_of(str(tmp_path)) == "folder"
    files = books.read_files(spark, str(tmp_path))
    kinds = {r["path"].split("/")[-1]: r["f"] for r in files.select("path", books.detect_format(F.col("path"), F.col("content")).alias("f")).collect()}
    assert kinds["book.pdf"] == "pdf" and kinds["draft_x.txt"] == "txt"
    assert books.primary_files(files).filter("folder LIKE '%sub'").first()["path"].endswith("book.pdf")


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OPS/c.opf"/></rootfiles></container>')
        z.writestr("OPS/c.opf", '<package xmlns="o" xmlns:dc="d"><metadata><dc:title>T</dc:title><dc:identifier>urn:isbn:978-3-16-148410-0</dc:identifier></metadata><manifest><item id="a" href="a.xhtml" media-type="x"/><item id="b" href="b.xhtml" media-type="x"/><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OPS/t.ncx", '<ncx xmlns="n"><navMap><navPoint><navLabel><text>First</text></navLabel><content src="a.xhtml#x"/></navPoint></navMap></ncx>')
        z.writestr("OPS/a.xhtml", "<p>Alpha</p>")
        z.writestr("OPS/b.xhtml", "<p>Beta</p>")
    return out.getvalue()


def test_epub(spark):
    meta, chapters = books.read_epub(epub())
    assert meta == {"title": "T", "isbn": "9783161484100"} and chapters == [{"title": "First", "text": "Alpha"}, {"title": "First", "text": "Beta"}]
    rows = books.epub_chapters(spark.createDataFrame([("a", bytearray(epub())), ("bad", bytearray(b"no"))], "path string, content binary")).collect()
    assert len(rows) == 3 and [r["path"] for r in rows if r["error"]] == ["bad"]
    assert books.decode_text("é".encode("cp1252")) == "é" and books.decode_text("é".encode("utf-16")) == "é"


def test_sqlite(spark, tmp_path):
    path = f"{tmp_path}/m.db"
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE books (id INTEGER PRIMARY KEY, title TEXT, rating REAL)")
        c.executemany("INSERT INTO books VALUES (?, ?, ?)", [(k, f"t{k}" if k % 3 else None, k / 2) for k in range(1, 30)])
    df = sqlite.read_table(spark, path, "books", 4)
    assert df.count() == 29 and df.filter("id = 5").first()["rating"] == 2.5 and df.rdd.getNumPartitions() == 4
    with pytest.raises(sqlite3.OperationalError), sqlite.connect(path) as c:
        c.execute("DELETE FROM books")


def test_chats(spark, tmp_path):
    node = lambda i, p, kids, role, text: {"id": i, "parent": p, "children": kids, "message": {"author": {"role": role}, "content": {"parts": [text]}}}
    tree = [{"id": "c", "title": "t", "mapping": {"r": {"id": "r", "parent": None, "children": ["a"], "message": None}, "a": node("a", "r", ["b", "d"], "user", "q"), "b": node("b", "a", [], "assistant", "old"), "d": node("d", "a", [], "assistant", "new")}}]
    (tmp_path / "t.json").write_text(json.dumps(tree))
    rows = chats.read_tree(spark, f"{tmp_path}/t.json").orderBy("depth").collect()
    assert [(r["role"], r["text"]) for r in rows] == [("user", "q"), ("assistant", "new")]
    flat = [{"uuid": "u", "name": "n", "chat_messages": [{"sender": "human", "text": "a", "created_at": "2024-01-01T00:00:00Z"}, {"sender": "system", "text": "z"}]}]
    (tmp_path / "f.json").write_text(json.dumps(flat))
    assert [(r["role"], r["ts"]) for r in chats.read_flat(spark, f"{tmp_path}/f.json").collect()] == [("user", dt.datetime(2024, 1, 1))]


def test_matching_does_not_pair_entries_with_all_books_of_a_title(spark):
    """One title of many entries and books: a row for each pair was made. Authors still count, and the least id wins."""
    n = 1000
    lib = spark.range(n).select("id", F.lit("Works").alias("title"), F.when(F.col("id") % 2 == 0, "Ann Ba").otherwise("Cy Do").alias("author"), F.lit(None).cast("string").alias("asin"))
    author = F.element_at(F.array(F.lit("Ba"), F.lit(""), F.lit("do"), F.lit("nobody"), F.lit(None)), (F.col("id") % 5 + 1).cast("int"))
    e = spark.range(n).select(F.col("id").alias("entry"), F.lit("The Works!").alias("title"), author.alias("author"), F.when(F.col("id") == 7, "a").alias("asin"))
    rows, most = most_rows(spark, cat.match_books(e, lib.unionByName(spark.createDataFrame([(2000, "Else", "X", "a")], lib.schema))))
    want = {0: (0, "title"), 1: (0, "title"), 2: (1, "title"), 3: (None, None), 4: (0, "title")}
    assert {r["entry"]: (r["book"], r["how"]) for r in rows} == {k: (2000, "asin") if k == 7 else want[k % 5] for k in range(n)}
    assert most <= 4 * n


def test_unmatched_entries_are_found_without_pairs(spark):
    n = 1000
    lib = spark.range(n).select("id", F.lit("Works").alias("title"), F.lit("x").alias("author"), F.lit("none").alias("asin"))
    e = spark.range(n).select(F.col("id").alias("entry"), F.when(F.col("id") % 2 == 0, "WORKS").otherwise("Works zz").alias("title"), F.lit("").alias("author"), F.lit(None).cast("string").alias("asin"))
    rows, most = most_rows(spark, cat.match_books(e, lib).filter("book IS NULL"))
    assert sorted(r["entry"] for r in rows) == list(range(1, n, 2)) and most <= 4 * n


def test_notes(spark, tmp_path):
    (tmp_path / "n.md").write_text("---\ntitle: A\ntags: [x, y]\n---\n# Head\n\nFirst para [[Link|l]] #tag/sub\n")
    (tmp_path / "bad.md").write_text("---\n: [\n---\nText")
    got = {r["file"].split("/")[-1]: r for r in notes.parse(notes.read(spark, str(tmp_path))).collect()}
    assert got["n.md"]["front"] == {"title": "A", "tags": "x, y"} and got["n.md"]["links"] == ["Link"] and got["n.md"]["tags"] == ["tag/sub"]
    assert got["n.md"]["preview"].startswith("First para") and got["bad.md"]["front"] == {}


def test_viewer_annotations(spark, tmp_path):
    rows = [{"type": "highlight", "highlighted_text": "h", "notes": "", "spine_index": 2, "pos_frac": 0.5}, {"type": "bookmark"}]
    (tmp_path / "aa.json").write_text(json.dumps(rows))
    (tmp_path / "bb.json").write_text(json.dumps({"annotations": rows[:1]}))
    got = annotations.read_viewer(spark, str(tmp_path))
    assert got.count() == 3 and annotations.highlights(got).count() == 2 and annotations.bookmarks(got).count() == 1
    assert [r["hash"] for r in annotations.annotated_books(got).collect()] == ["aa", "bb"]


def test_matching(spark):
    lib = spark.createDataFrame([(1, "The Name of the Rose", "Umberto Eco", None), (2, "Other", "X", "B00")], "id int, title string, author string, asin string")
    e = spark.createDataFrame([(1, "Name of the Rose", "Eco", None), (2, "whatever", "", "B00"), (3, "Name of the Rose", "Nobody", None)], "entry int, title string, author string, asin string")
    assert sorted((r["entry"], r["book"], r["how"]) for r in cat.match_books(e, lib).collect() if r["book"]) == [(1, 1, "title"), (2, 2, "asin")]
    f = spark.createDataFrame([(1, "Nme of the Rose", "Umberto Eco")], "entry int, title string, author string")
    assert cat.fuzzy_match(f, lib).first()["book"] == 1


def plain_match(entries, books, least):
    """The best book of each entry by all pairs."""
    import re
    import unicodedata

    def key(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(c))
        return " ".join(re.sub(r"[^\w\s]", " ", t).split())

    def ratio(a, b):
        if not a or not b:
            return 0.0
        row = [0] * (len(b) + 1)
        for c in a:
            before = row
            row = [0]
            for k, d in enumerate(b):
                row.append(before[k] + 1 if c == d else max(before[k + 1], row[k]))
        return 200.0 * row[-1] / (len(a) + len(b))

    in_order = lambda t: " ".join(sorted(t.split(" ")))
    best = {}
    for e, title, author in entries:
        x, xa = key(re.sub(r"\s*\([\w\s]+Edition\)\s*$", "", title or "", flags=re.IGNORECASE)), key(author)
        for b, other, writer in books:
            y, ya = key(other), key(writer)
            if not x or not y:
                continue
            exact = x == y and (xa in ya or ya in xa)
            t = ratio(in_order(x), in_order(y))
            score = 100.0 if exact else t if not xa or not ya else 0.7 * t + 0.3 * ratio(in_order(xa), in_order(ya))
            if score >= least - 1e-9:
                best[e] = max(best.get(e, (False, 0, 0)), (exact, round(score, 4), -b))
    return best


@pytest.mark.parametrize("least", [90.0, 80.0, 70.0])
def test_fuzzy_match_is_that_of_all_pairs(spark, least):
    import random

    r = random.Random(3)
    titles = ["Ulysses", "Middlemarch", "It", "We", "Go On", "Aaaaaaaa", "Emma", "The Red and the Black", "Ubik", "", "Sein und Zeit", "Öde Ode", "Ética", "Die Blechtrommel", "abababababababababab"]
    titles += ["".join(r.choice("abé ") for _ in range(r.randrange(1, 14))) for _ in range(40)]

    def misspelt(t):
        for _ in range(r.randrange(1, 4)):
            k = r.randrange(len(t) + 1)
            t = r.choice([t[:k] + r.choice("abx") + t[k:], t[:k] + t[k + 1 :], t[:k] + r.choice("aby") + t[k + 1 :]])
        return t + r.choice(["", "", " (Kindle Edition)"])

    books = [(k, t, r.choice(["Joyce, James", "George Eliot", None, ""])) for k, t in enumerate(titles + titles[:5])]
    entries = [(0, "Ulyses", "Joyce"), (1, "Middlemarsh", "Eliot"), (2, "Wee", "Eliot"), (3, None, None), *[(k + 4, misspelt(r.choice(titles)), r.choice(["James Joyce", "Eliott", "Géorge Eliot", None])) for k in range(160)]]
    b = spark.createDataFrame(books, "id int, title string, author string")
    e = spark.createDataFrame(entries, "entry int, title string, author string")
    want = plain_match(entries, books, least)
    assert {x["entry"]: (x["how"] == "exact", x["score"], -x["book"]) for x in cat.fuzzy_match(e, b, least).collect()} == want
    assert len(want) > 20 and {x[0] for x in want.values()} == {True, False}


def test_fuzzy_match_without_authors_with_editions_and_accents(spark):
    books = [(1, "Middlemarch", "George Eliot"), (2, "Ética", "Spinoza"), (3, "Die Blechtrommel", "Günter Grass"), (4, "The Structure of Scientific Revolutions", "Thomas S. Kuhn"), (5, "It", "King")]
    said = [("a", "Middlemarch", None), ("b", "Middlemarch (Kindle Edition)", "George Eliot"), ("c", "Etica", None), ("d", "Die Blechtrommel (German Edition)", "Grass, Günter"), ("e", "Structure of Scientific Revolutions", "Thomas Kuhn"), ("f", "Itt", ""), ("g", "Midlemarch", None), ("h", "Nothing like it at all", "Nobody"), ("i", "", "King")]
    got = {x["entry"]: (x["book"], x["how"]) for x in cat.fuzzy_match(spark.createDataFrame(said, "entry string, title string, author string"), spark.createDataFrame(books, "id int, title string, author string")).collect()}
    assert got == {"a": (1, "exact"), "b": (1, "exact"), "c": (2, "exact"), "d": (3, "fuzzy"), "e": (4, "fuzzy"), "f": (5, "fuzzy"), "g": (1, "fuzzy")}
    assert cat.fuzzy_match(spark.createDataFrame([], "entry string, title string, author string"), spark.createDataFrame(books, "id int, title string, author string")).count() == 0
    with pytest.raises(ValueError, match="bound"):
        cat.close_by_ratio(spark.createDataFrame([("a",)], "__x string"), spark.createDataFrame([("a",)], "__y string"), 50)


def test_stream_ingest_and_windows(spark, tmp_path):
    src, table = f"{tmp_path}/in", f"{tmp_path}/table"
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(10)], "id long, text string")
    docs.write.parquet(src)
    for n in (10, 12):
        if n == 12:
            spark.createDataFrame([(k, f"newer {k}") for k in range(8, 12)], "id long, text string").write.mode("append").parquet(src)
        inc.ingest(inc.watch(spark, src, docs.schema), lambda b: b, table, f"{tmp_path}/cp").awaitTermination()
        assert tables.read_buckets(spark, table).count() == n
    assert tables.read_buckets(spark, table).filter("text LIKE 'newer%'").count() == 4
    ev = spark.createDataFrame([("u", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for m in (0, 30, 61, 5000)], "u string, ts timestamp")
    ev.write.parquet(f"{tmp_path}/ev")
    inc.run_to_files(inc.session_windows(inc.watch(spark, f"{tmp_path}/ev", ev.schema), "u", "ts", late="1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp2")
    got = sorted((r["start"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = sorted((r["start"], r["n"]) for r in inc.session_windows(ev, "u", "ts").collect())
    assert got == batch[:2] and [n for _, n in batch] == [2, 1, 1]


def test_runs_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    """Files in several batches, rows out of order and rows that join two runs; the last run of a key ends by its timer."""
    import random

    r = random.Random(12)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"u{r.randrange(4)}", start + dt.timedelta(minutes=r.randrange(6000))) for _ in range(260)] + [("u0", start), ("u0", start + dt.timedelta(minutes=30)), ("u0", start + dt.timedelta(minutes=60, seconds=1)), ("u9", None)]
    r.shuffle(rows)
    kind = "u string, ts timestamp"
    for k in range(0, len(rows), 90):
        spark.createDataFrame(rows[k : k + 90], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ev")
    end = [("end", start + dt.timedelta(days=60))]
    run = lambda: inc.run_to_files(inc.strict_runs(inc.watch(spark, f"{tmp_path}/ev", kind, files_at_once=1), "u", "ts", late="10 days"), f"{tmp_path}/out", f"{tmp_path}/cp")
    run()
    assert spark.read.schema(inc.RUNS).parquet(f"{tmp_path}/out").isEmpty()  # nothing can have ended yet
    spark.createDataFrame(end, kind).write.mode("append").parquet(f"{tmp_path}/ev")
    run()
    want = []
    for u in {u for u, t in rows if t}:
        times = sorted(t for v, t in rows if v == u and t)
        own = [[times[0], times[0], 1]]
        for t in times[1:]:
            if t - own[-1][1] > dt.timedelta(minutes=30):
                own.append([t, t, 1])
            else:
                own[-1][1:] = [t, own[-1][2] + 1]
        want += [(u, *x) for x in own]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(want)


def test_each_changed_file_comes_once(spark, tmp_path):
    import os

    from folioforge.sources.changes import local, watch_changes

    root = tmp_path / "lib"
    (root / "a").mkdir(parents=True)
    (root / ".git").mkdir()
    for name in ("a/one.md", "two.md", ".git/x.md", "_tmp.md", "three.txt"):
        (root / name).write_text(name)
    seen = lambda: sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    run = lambda: inc.run_to_files(watch_changes(spark, f"file://{root}", suffixes=(".md",)), f"{tmp_path}/out", f"{tmp_path}/cp")
    run()
    assert seen() == ["one.md", "two.md"]
    run()
    assert seen() == ["one.md", "two.md"]  # nothing has changed
    (root / "four.md").write_text("4")
    (root / "two.md").write_text("changed")
    run()
    assert seen() == ["four.md", "one.md", "two.md", "two.md"]
    os.remove(root / "four.md")
    run()
    assert len(seen()) == 4 and {r["size"] for r in spark.read.parquet(f"{tmp_path}/out").filter("path LIKE '%two.md'").collect()} == {6, 7}
    os.utime(root / "a/one.md", (1e9, 1e9))
    inc.run_to_files(watch_changes(spark, str(root), since="2020-01-01T00:00:00"), f"{tmp_path}/out2", f"{tmp_path}/cp2")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(f"{tmp_path}/out2").collect()) == ["three.txt", "two.md"]
    with pytest.raises(ValueError, match="mounted"):
        local("s3a://bucket/x")


def test_long_threads_and_broken_trees(spark):
    nodes = "conv_id string, node string, parent string, role string, text string"
    long = spark.range(50_000).selectExpr("'long' conv_id", "lpad(id, 6, '0') node", "CASE WHEN id > 0 THEN lpad(id - 1, 6, '0') END parent", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END role", "string(id) text")
    odd = spark.createDataFrame([("b", "r", None, "system", "s"), ("b", "c1", "r", "user", "old"), ("b", "c2", "r", "user", "new"), ("b", "d1", "c1", "assistant", "x"), ("b", "d2", "c2", "assistant", "y"), ("b", "lone", "nowhere", "user", "z"), ("ring", "p", "q", "user", "1"), ("ring", "q", "p", "user", "2"), (None, "n", None, "user", "3")], nodes)
    got = chats.flatten_tree(long.union(odd))
    assert sorted(tuple(r) for r in got.filter("conv_id <> 'long'").collect()) == [("b", 0, "user", "z")]
    deep = got.filter("conv_id = 'long'").agg(F.count(F.lit(1)), F.max("depth"), F.count_if(F.col("depth") != F.col("text").cast("int"))).first()
    assert tuple(deep) == (50_000, 49_999, 0)
    tree = chats.flatten_tree(odd.filter("node <> 'lone'"))
    assert sorted(tuple(r) for r in tree.filter("conv_id = 'b'").collect()) == [("b", 1, "user", "new"), ("b", 2, "assistant", "y")]


def test_notes_are_matched_in_order(spark):
    parts = [("v", 1, "One[^1] and two [^a] here.\n\n[^1]: first body"), ("v", 2, "[^b]: too early\nthen [^b] and [^1]"), ("v", 3, "  [^1]: again\n[^z]: nobody's"), ("w", 1, "[^z] elsewhere"), ("w", 2, None)]
    df = spark.createDataFrame(parts, "book string, k int, text string")
    got = {tuple(r) for r in repair.unmatched_notes(df).collect()}
    assert got == {("v", "a", 1, "unresolved"), ("v", "z", 3, "orphaned"), ("w", "z", 1, "unresolved")}
    pages = spark.createDataFrame([("v", 1, True), ("v", 2, True), ("w", 1, True), ("x", 1, True), ("x", 2, False)], "book string, page int, present boolean")
    profile = spark.createDataFrame([("v", 9, 0.9, 0.0), ("w", 0, None, 0.1), ("x", None, 0.2, 0.7)], "book string, certain int, attested double, inherited double")
    out = {r["book"]: r for r in repair.admission(pages, 0.95, df, profile).collect()}
    assert out["v"]["reasons"] == ["1 unresolved notes", "1 orphaned notes", "4 definitions of 9"] and not out["v"]["admitted"]
    assert out["w"]["reasons"] == ["1 unresolved notes", "attested share unknown"] and out["x"]["reasons"] == ["coverage 0.5", "attested 0.2", "inherited 0.7"]
    assert repair.admission(pages.filter("book <> 'x'")).filter("admitted").count() == 2


def test_a_run_that_was_cut_off_leaves_each_book_once(spark, tmp_path):
    queue = spark.createDataFrame([(k, f"b{k}") for k in range(40)] + [(3, "again")], "book long, title string")
    calls = []

    def work(rows, die=99):
        calls.append(1)
        if len(calls) == die:
            raise OSError("killed")
        return rows.select("book", F.explode(F.array(F.lit(1), F.lit(2))).alias("part"), F.when((F.col("book") % 10 == 7) & F.rand(1).isNotNull(), F.lit("no text")).alias("error"))

    path = f"{tmp_path}/run"
    with pytest.raises(OSError, match="killed"):
        repair.drive(queue, "book", lambda r: work(r, 3), path, size=10)
    half = repair.driven_rows(spark, path).count()
    assert 0 < half < 72
    said = repair.drive(queue, "book", work, path, size=10)
    assert said.count() == 40 and {r["key"] for r in said.filter("status = 'failed'").collect()} == {"7", "17", "27", "37"}
    rows = repair.driven_rows(spark, path)
    assert rows.filter("book <> 3").groupBy("book").count().filter("count <> 2").isEmpty() and rows.select("book").distinct().count() == 36
    n = len(calls)
    assert repair.drive(queue, "book", work, path, size=10).count() == 40 and len(calls) == n
    more = repair.drive(queue.union(spark.createDataFrame([(99, "new")], queue.schema)), "book", work, path, size=10)
    assert more.count() == 41 and len(calls) == n + 1


def exth(records):
    body = b"".join(k.to_bytes(4, "big") + (len(v) + 8).to_bytes(4, "big") + v for k, v in records)
    mobi = b"MOBI" + (8).to_bytes(4, "big")
    return bytes(78) + (100).to_bytes(4, "big") + bytes(100 - 82) + bytes(16) + mobi + b"EXTH" + (12 + len(body)).to_bytes(4, "big") + len(records).to_bytes(4, "big") + body


def test_book_headers(spark):
    from folioforge.sources import readers

    raw = exth([(100, "É. Author".encode()), (999, b"x"), (503, "Tïtle".encode("latin-1"))])
    assert readers.read_exth(raw) == {"author": "É. Author", "title": "Tïtle"}
    assert readers.read_exth(raw[:150]) == {} and readers.read_exth(b"") == {} and readers.read_exth(None) == {}
    df = spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(b"no"))], "path string, content binary")
    assert {r["path"]: r["header"] for r in readers.book_headers(df).collect()} == {"a": {"author": "É. Author", "title": "Tïtle"}, "b": {}}
    side = spark.createDataFrame([("f", json.dumps({"payload": {"records": [{"type": "note", "text": "n\n\nA. B. T (S. 3). Kindle-Version.", "startPosition": "5"}]}})), ("g", "<x/>")], "file string, value string")
    assert [(r["file"], r["text"], r["location"]) for r in readers.side_records(side).collect()] == [("f", "n", "5")]


def test_dispatch_and_notebooks(spark, tmp_path):
    from folioforge.sources import readers

    files = spark.createDataFrame([("a.epub", bytearray(epub())), ("b.txt", bytearray("é".encode())), ("c.html", bytearray(b"<html><p>x</p>")), ("d.pdf", bytearray(b"%PDF-1")), ("e.epub", bytearray(b"PK\x03\x04broken"))], "path string, content binary")
    got = {r["path"]: (r["text"], r["error"] is None) for r in readers.dispatch(files).collect()}
    assert got["a.epub"] == ("Alpha\n\nBeta", True) and got["b.txt"] == ("é", True) and got["c.html"] == ("x", True) and not got["d.pdf"][1] and not got["e.epub"][1]
    (tmp_path / "My Book" / "Notes").mkdir(parents=True)
    (tmp_path / "My Book" / "Notes" / "n.html").write_text("<title>N</title><p>hello</p>")
    row = readers.read_notebooks(spark, str(tmp_path)).first()
    assert (row["notebook"].replace("%20", " "), row["kind"], row["title"], row["text"]) == ("My Book", "note", "N", "hello")


def test_language_lists_and_tagless_boost(spark, chunks):
    mixed = chunks.withColumn("language", F.when(F.col("id") == "c1", "de").when(F.col("id") == "c2", "fr").otherwise("en"))
    assert {r["id"] for r in mixed.filter(flt.chunk_filter(language="de, fr")).collect()} == {"c1", "c2"}
    tagged = chunks.filter("id = 'c2'").withColumns({"score": F.lit(1.0), "tags": F.lit("Kant")})
    assert [ret.interest_boost(tagged, ["Kant"], include_tags=x).first()["score"] for x in (True, False)] == [1.15, 1.0]


def test_edits_are_counted_up_to_a_bound():
    import random

    r = random.Random(9)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    for _ in range(3000):
        a, b = ("".join(r.choice("abä") for _ in range(r.randrange(12))) for _ in range(2))
        most = r.randrange(8)
        assert cat.edits_at_most(a, b, most) == (edits(a, b) <= most)


def test_running_lines_pair_only_lines_that_share_a_segment(spark):
    """Lines of the same common letters, none alike: each pair was a row of a shuffle."""
    import random

    r = random.Random(3)
    n = 600
    said = [" ".join("".join(r.choice("etaoin") for _ in range(6)) for _ in range(8)) for _ in range(n)]
    rows = [("b", k, f"{said[k]}\nthe book of runs {k}\nx") for k in range(n)]
    df = spark.createDataFrame(rows, "book string, page int, text string")
    got, most = most_rows(spark, ck.running_lines(df))
    assert {(x["place"], x["line"], x["pages"]) for x in got} == {(p, "the book of runs #", n) for p in ("header", "footer")}
    lines = spark.createDataFrame([(x, k, 0) for k, x in enumerate(said)], "__t string, __id long, __b long")
    assert cat.sharing_segments(lines, lines, 0.15).filter("__l <> __s").count() < n * n / 100


def test_indexes_shuffle_texts_and_each_posting_once(spark, tmp_path):
    """Postings of 400 chunks of 200 different words: they went through a shuffle four times in a build, once in a list of postings."""
    n, words = 400, 200
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda k: F.concat(F.lit("w"), ((k + F.col("id")) % 500).cast("string"))), " ")
    chunks = spark.range(n).select("id", text.alias("text")).unionByName(spark.createDataFrame([(n, ""), (n + 1, None)], "id long, text string"))

    def shuffled(run):
        store = spark._jvm.org.apache.spark.SparkContext.getOrCreate().statusStore()
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        total = lambda: sum(s.shuffleWriteRecords() for s in (stages.apply(i) for stages in [store.stageList(None, False, False, none, None)] for i in range(stages.size())))
        before = total()
        return run(), total() - before

    rows, moved = shuffled(lambda: ret.postings(chunks).collect())
    assert len(rows) == n * words and all(r["tf"] == 1 and r["dl"] == words for r in rows) and moved < 2 * n
    index, moved = shuffled(lambda: ret.TextIndex.build(chunks, f"{tmp_path}/i"))
    assert index.numbers()[:3] == (n + 2, n + 1, n * words) and moved < 2 * n * words
    assert index.top("w7 w450", 5).collect() == ret.ranked(ret.bm25(chunks, "w7 w450"), 5).collect()


def test_long_lines_are_paired_by_length_and_letters(spark):
    """Each place of a long line was a row of a shuffle, and lines of the same short words had a segment in common."""
    import random

    r = random.Random(5)
    n = 60
    said = []
    for k in range(n):
        own = ["".join(r.choice("etaoin" if k % 2 else "shrdlu") for _ in range(5)) for _ in range(10)]
        said.append(" ".join(own * 50))
    lines = spark.createDataFrame([(x, k, 0) for k, x in enumerate(said)], "__t string, __id long, __b long")
    got, most = most_rows(spark, cat.sharing_segments(lines, lines, 0.15, lines, 6))
    assert not any(a["edits"] and a["__l"] != a["__s"] for a in got) and most < n * 1000  # of 3000 characters each

    # every pair with the most edits that are allowed, on either side of the length from which lines count as long
    def spoilt(x, edits):
        out = list(x)
        for at in sorted(r.sample(range(len(x)), edits), reverse=True):
            out[at : at + 1] = r.choice(([], [r.choice("xyz")], [out[at], r.choice("xyz")]))
        return "".join(out)

    rows = []
    for size in (100, 220, 250, 256, 257, 262, 300, 700):
        x = "".join(r.choice("etaoin shrdlu") for _ in range(size))
        rows += [(x, spoilt(x, e)) for e in (0, 1, size // 20, size * 3 // 20, size * 3 // 20 + 4, size // 5)]
    texts = sorted({t for pair in rows for t in pair})
    x = spark.createDataFrame([(t,) for t in texts], "__x string")
    got = {(a["__x"], a["__y"]) for a in cat.close_titles(x, x.withColumnRenamed("__x", "__y"), 0.15).collect()}
    assert got == {(a, b) for a in texts for b in texts if cat.edits_at_most(a, b, int(max(len(a), len(b)) * 0.15 + 1e-6))}


def test_chunk_workers_hold_few_characters(spark):
    """Chunks were handed on by their number, however long they are: each says how many there were when it was made."""

    class Made(dict):
        alive = 0

        def __init__(self, **own):
            Made.alive += 1
            super().__init__(own, alive=Made.alive)

        def __del__(self):
            Made.alive -= 1

    df = spark.range(0, 2000, 1, 1).select("id", F.lit("x").alias("text"))
    got = ck.explode_chunks(df, lambda x: [Made(text=x * 5000), Made(text=None)], "text string, alive int").select("id", "chunk_index", F.length("text").alias("n"), "alive").collect()
    assert [(r["id"], r["chunk_index"], r["n"]) for r in got] == [(k, i, n) for k in range(2000) for i, n in enumerate((5000, None))]
    assert max(r["alive"] for r in got) <= 2 * ((1 << 20) // 5000 + 2)


def test_pairs_of_one_identifier_are_dealt_over_tasks(spark):
    """All pairs of an identifier were made by one task."""
    own = spark.range(0, 1500, 1, 1).select(F.col("id").alias("book"), F.lit("isbn").alias("type"), F.when(F.col("id") < 1300, "x").when(F.col("id") < 1400, F.col("id").cast("string")).otherwise(F.concat(F.lit("y"), (F.col("id") % 40).cast("string"))).alias("val"))
    odd = spark.createDataFrame([(1, "isbn", None), (2, "isbn", None), (3, None, "z"), (4, None, "z"), (None, "isbn", "x"), (7, "asin", "z"), (7, "asin", "z"), (9, "asin", "z"), (9, "isbn", "z")], "book long, type string, val string")
    every = own.unionByName(odd)
    got = cat.duplicate_pairs(every).withColumn("task", F.spark_partition_id()).collect()
    held = {}
    for r in every.collect():
        held.setdefault((r["type"], r["val"]), []).append(r["book"])
    want = sorted((a, b, *k) for k, v in held.items() if None not in k for a in v for b in v if a is not None and b is not None and a < b)
    assert sorted((r["book1"], r["book2"], r["type"], r["val"]) for r in got) == want
    tasks = [r["task"] for r in got]
    assert max(tasks.count(k) for k in set(tasks)) < len(tasks) / 2


def test_lines_within_others_are_looked_for_whole(spark):
    """Lines that begin alike met every line that has these six characters anywhere."""
    import random

    r = random.Random(11)
    word = lambda k: "".join(r.choice("etaoin") for _ in range(k))
    held = ["the bo" + word(k) for k in (0, 1, 2, 5, 6, 7, 17, 18, 41, 42, 90, 185, 186, 187, 300)]
    said = [*held, *(f"{word(4)} the book {word(30)} {k}" for k in range(400)), *(f"{word(3)}{x}{word(9)}é" for x in held), held[3] * 2, "short"]
    lines = spark.createDataFrame([(x, k, 0) for k, x in enumerate(said)] + [(held[9], len(said), 1)], "__t string, __id long, __b long")
    within = lines.filter(F.length("__t") > 5)
    got, most = most_rows(spark, cat.sharing_segments(lines, lines, 0.0, within, 6).filter("NOT edits"))
    want = {(a, b) for a, x in enumerate(said) for b, y in enumerate(said) if a != b and 6 <= len(x) < len(y) and x in y}
    assert {(p["__l"], p["__s"]) for p in got if p["__l"] < len(said) and p["__s"] < len(said)} >= want
    assert len(got) < 2 * len(want) and most < 10 * len(said)
