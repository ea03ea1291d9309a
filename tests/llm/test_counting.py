"""Operators 11 to 13 against plain versions: odd rows, ties, repeats, empty tables, clashing columns, many groups."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import collocations, divergence, mixture

from .test_operators import odd_texts

DOCS = "doc_id long, text string, lang string, source string, term string, n long, key string, rank int, `a.b` string, slot map<string,int>"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("on", "Thé", "x", "日本") for b in ("a", "ing", "🙂")]
    made = []
    for k in range(320):
        size = r.choice([3, 12, 60, 60])
        text = "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " 7 ", "-"]) for _ in range(size))
        made.append((text + (" red herring pie" if k % 4 == 0 else ""), ["en", "en", "de", None, "und"][k % 5], ["s1", "s1", "s2", None, "", "é"][k % 6]))
    made += [(t, "en", "odd") for t in odd_texts()[:12]] + [(None, "fr", "none"), ("", "fr", "none2"), ("word " * 30_000, "en", "s1"), ("sole", "zz", "only")]
    out = [(k, t, lang, source) for k, (t, lang, source) in enumerate(made)]
    return out + out[:9] + [(None, *x[1:]) for x in out[5:12]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, "t", 1, "k", 2, "dotted", {"x": 1}) for x in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def plain_divergence(rows):
    docs_of, n, groups = defaultdict(set), Counter(), set()
    for k, (_, t, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t)):
            docs_of[lang, x].add(k)
            n[lang, source, x] += 1
    out = []
    for lang in {g[0] for g in groups}:
        terms = [x for (a, x), d in docs_of.items() if a == lang and len(d) >= 10]
        own = sorted(s for a, s in groups if a == lang)
        price = lambda c, total: 1 + 10**9 * (c + 2) // max(total + 2 * len(terms), 1)
        at = {s: [n[lang, s, x] for x in terms] for s in own}
        p = {s: [price(c, sum(at[s])) for c in at[s]] for s in own}
        whole = [sum(at[s][i] for s in own) for i in range(len(terms))]
        q = [price(c, sum(whole)) for c in whole]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pair = sorted((-sum(f(a, b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in own if o != s)
            term = sorted((-f(p[s][i], q[i]), x.encode()) for i, x in enumerate(terms) if at[s][i] and p[s][i] > q[i])[:10]
            out += [(lang, s, part, x.decode(), -v, k) for part, found in (("pair", pair), ("term", term)) for k, (v, x) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_agrees_with_dense_sums(docs, rows, nothing):
    found = divergence.audit(docs)
    assert sorted(map(tuple, found.collect())) == plain_divergence(rows)
    assert divergence.audit(nothing).count() == 0


def test_divergence_joins_by_shuffle_beyond_the_broadcast_bound(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_SENT", 0)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == plain_divergence(rows)


def test_prices_are_exact_beyond_64_bits(spark):
    n, total = 7 * 10**14 + 3, 9 * 10**14 + 7
    got = spark.range(1).select(F.lit(n).alias("n"), F.lit(total).alias("t")).select(divergence.price("n", "t")).first()[0]
    assert got == 1 + 10**9 * (n + 2) // total


def plain_mixture(rows, weights=(5, 2, 1)):
    sized = [(i, t or "", s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s in rows]
    sources = sorted({s for *_, s, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for *_, o, n in sized if o == s) for s in sources}
    weight = {s: weights[k % 3] for k, s in enumerate(sources)}
    left, target, free = 3 * sum(size.values()), {}, list(sources)  # in halves of a word
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * left > 4 * size[s] * total]
        if not over:
            target |= {s: weight[s] * left / (2 * total) for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= 4 * size[s]
            free.remove(s)
    out = []
    for s in sources:
        own = defaultdict(list)
        for i, t, o, n in sized:
            if o == s:
                own[int(hashlib.md5(f"{'' if i is None else i}:{t}".encode()).hexdigest()[:15], 16)].append((i, n))
        whole, rest = divmod(int(target[s]), size[s]) if size[s] else (0, 0)
        for h in sorted(own):
            tie = sum(n for _, n in own[h])
            part = min(rest, tie)
            out += [(i, n, size[s], target[s], whole * n + (n * part // tie if tie else 0)) for i, n in own[h]]
            rest -= part
    return sorted(out, key=str)


def test_mixture_agrees_with_sorting(docs, rows, nothing):
    found = mixture.mix(docs)
    assert found.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    got = [tuple(x) for x in found.collect()]
    assert sorted(got, key=str) == plain_mixture(rows)
    assert sorted((tuple(x) for x in mixture.mix(docs.repartition(7)).collect()), key=str) == plain_mixture(rows)
    assert all(0 <= taken <= 2 * size for _, size, _, _, taken in got)
    by = defaultdict(int)
    for _, _, size, target, taken in got:
        by[size, target] += taken
    repeats = max(Counter((x[0], x[1], x[3]) for x in rows).values())
    assert all(abs(v - target) <= 1 + repeats for (_, target), v in by.items())
    assert mixture.mix(nothing).count() == 0


def test_mixture_of_many_sources_and_of_equal_rows(spark):
    r = random.Random(3)
    many = [(k, "w " * r.randrange(9), None, f"s{r.randrange(60)}") for k in range(400)] + [(None, "a b c", None, None)] * 50 + [(k, " \n", None, "blank") for k in range(5)]
    d = spark.createDataFrame(many, "doc_id long, text string, lang string, source string")
    assert sorted((tuple(x) for x in mixture.mix(d).collect()), key=str) == plain_mixture(many)
    none = d.filter("source = 'blank'")
    assert {tuple(x)[1:] for x in mixture.mix(none).collect()} == {(0, 0, 0.0, 0)}


def plain_collocations(rows, limit=2000):
    f, n = Counter(), Counter()
    for _, t, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    for (lang, x), a in f.items():
        if len(x) == 1 or a < 10:
            continue
        if len(x) == 2 and any(100 * b >= 50 * a for (o, y), b in f.items() if o == lang and len(y) == 3 and b >= 10 and x in (y[:2], y[1:])):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, x[:k]] * f[lang, x[k:]]), k, f[lang, x[:k]], f[lang, x[k:]]) for k in range(1, len(x)))
        out[lang].append((-score, -a, " ".join(x).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:limit], 1))


def test_collocations_agree_with_counting(docs, rows, nothing):
    found = collocations.mine(docs)
    assert found.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((c, "bigint") for c in ("a", "l", "r", "n", "score"))]
    want = plain_collocations(rows)
    assert len({x[0] for x in want}) >= 3 and any(x[2].count(" ") == 2 for x in want)
    assert sorted(map(tuple, found.collect())) == want
    assert collocations.mine(nothing).count() == 0


def test_collocations_with_many_hashes_shards_and_slices(docs, rows, monkeypatch):
    for name, value in {"GROUP": 40, "SENT": 2, "HELD": 300, "SHARD": 500, "SLICE": 16, "SLICE_BYTES": 512, "FAN": 2, "RANKED": 5, "MERGED": 2, "BLOCKS": 1}.items():
        monkeypatch.setattr(collocations, name, value)
    assert sorted(map(tuple, collocations.mine(docs, limit=7).collect())) == plain_collocations(rows, 7)


def test_collocations_shuffle_no_row_for_each_rare_word_or_phrase(spark):
    """Each word of a task was a row of a shuffle, and words came with every candidate, whether it could rank or not."""
    r = random.Random(4)
    often = [f"w{k}" for k in range(200)]
    made = [(k, " ".join([*(f"rare{k}x{j}" for j in range(60)), ".", *(f"{often[j]} {often[(j + 1) % 200]}." for j in r.sample(range(200), 40))]), "en", "s") for k in range(300)]
    store = spark._jvm.org.apache.spark.SparkContext.getOrCreate().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    total = lambda: sum(s.shuffleWriteRecords() for s in (stages.apply(i) for stages in [store.stageList(None, False, False, none, None)] for i in range(stages.size())))
    before = total()
    found = collocations.mine(spark.createDataFrame(made, "doc_id long, text string, lang string, source string").repartition(4), limit=20)
    assert sorted(map(tuple, found.collect())) == plain_collocations(made, 20)
    assert total() - before < 300 * 60 / 4


def test_minimal_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 5000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        h = collocations.MinimalHash(keys)
        assert sorted(h.find(keys)) == list(range(len(keys)))
        strangers = np.setdiff1d(rng.integers(0, 2**63, 2000, dtype=np.uint64), keys)
        assert (h.find(strangers) == -1).all()
    with pytest.raises(ValueError, match="distinct"):
        collocations.MinimalHash(np.array([5, 5], np.uint64))


def test_words_whose_keys_are_equal_keep_slots_of_their_own(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations.Vocabulary, "_keys", staticmethod(lambda words, salts: np.array([len(x) for x in words.to_pylist()], np.uint64)))
    v = collocations.Vocabulary(["en", "en", "de", "en"], ["ab", "cd", "ab", "xyz"])
    slots = [v.find("en", pa.array(["ab", "cd", "xyz", "ef", "x"])), v.find("de", pa.array(["ab", "cd"])), v.find("fr", pa.array(["ab"]))]
    assert sorted([*slots[0][:3], slots[1][0]]) == [0, 1, 2, 3] and list(slots[0][3:]) == [-1, -1] and slots[1][1] == -1 and slots[2][0] == -1
