"""Scalar functions on hand-made cases."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions.fold import fold, fold_text


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "word", "found"), [("Die Kantine", "kant", False), ("Nach Kant.", "Kant", True), ("banknotes", "notes", False), ("the protocol", "toc", False), ("Vorteil", "teil", False), ("Teil 1", "teil", True), ("xä kantä", "kant", False), (None, "a", False)])
def test_keywords_are_whole_words(spark, text, word, found):
    assert one(spark, T.has_keyword(F.col("t"), [word]), t=text) is found


@pytest.mark.parametrize(("title", "key"), [("The Name of the Rose!", "name of the rose"), ("Der Prozeß", "prozeß"), ("L'été", "lété"), ("  An  Idea ", "an idea"), ("Las Meninas", "meninas"), (None, "")])
def test_titles(spark, title, key):
    assert one(spark, T.normalize_title(F.col("t")), t=title) == key


def canonical(d):
    return hashlib.md5(json.dumps(d, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


@pytest.mark.parametrize("title", ["Plain", 'Quote " and \\', "Ünïcode 日本", "line\nbreak\ttab", "", "a/b </script>"])
@pytest.mark.parametrize("tags", [["b", "a"], []])
def test_metadata_hash_is_that_of_the_json(spark, title, tags):
    got = one(spark, T.metadata_hash(F.col("a"), F.col("c"), F.lit(""), F.col("g"), F.col("t")), a="A. Author", c="<p>x</p>", g=tags, t=title)
    assert got == canonical({"author": "A. Author", "comments": "<p>x</p>", "publisher": "", "tags": sorted(tags), "title": title})


def test_item_hash(spark):
    got = one(spark, T.item_hash(F.col("a"), F.array(F.lit("z"), F.lit("b")), F.lit("2020"), F.array(F.lit("t")), F.lit("T")), a="abs")
    assert got == canonical({"abstract": "abs", "authors": ["b", "z"], "date": "2020", "tags": ["t"], "title": "T"})


@pytest.mark.parametrize(("h", "n", "out"), [("x", "y", "[ANNOTATION] x | Note: y"), (" x ", "", "[ANNOTATION] x"), ("", "n", "[ANNOTATION_NOTE] n"), (None, " ", "")])
def test_annotation_text(spark, h, n, out):
    assert one(spark, T.annotation_text(F.col("h"), F.col("n")), h=h, n=n) == out


@pytest.mark.parametrize(("said", "n", "out"), [("all", 3, [0, 1, 2]), ("0,3, 5-7,15", 10, [0, 3, 5, 6, 7]), ("", 4, []), ("ALL", 0, []), ("2,2,1", 5, [1, 2])])
def test_selection(spark, said, n, out):
    assert one(spark, T.selection(F.col("s"), F.col("n")), s=said, n=n) == out


@pytest.mark.parametrize(("r", "ok", "v"), [("XIV", True, 14), ("mcmxc", True, 1990), ("IIII", False, 4), ("", False, 0), ("abc", False, 100)])
def test_roman(spark, r, ok, v):
    assert one(spark, T.is_roman(F.col("r")), r=r) is ok
    assert one(spark, T.roman_value(F.col("r")), r=r) == v


def test_snippets(spark):
    text = "a" * 300 + " evangelista\net a presbyteris " + "b" * 300
    got = one(spark, T.snippet(F.col("t"), "evangelista et a presbyteris"), t=text)
    assert got.startswith("...") and got.endswith("...") and "evangelista\net" in got
    assert one(spark, T.snippet(F.col("t"), "nowhere"), t="x" * 400) == "x" * 300 + "..."
    assert one(spark, T.snippet(F.col("t"), "Bc"), t="abcd") == "abcd"


def test_phrases_and_terms(spark):
    assert one(spark, T.occurrences(F.col("t"), "Of  the"), t="of the\nOf\nthe of them") == 3
    assert one(spark, T.highlight_terms(F.col("t"), ["art", "Party"]), t="party ART") == "**p**art**y** **ART**"


def test_slug_html_xml(spark):
    assert one(spark, T.slug(F.col("t")), t=" Über große Öfen & Maß! ") == "ueber-grosse-oefen-mass"
    assert one(spark, T.slug(F.col("t")), t="!!!") == "untitled"
    assert one(spark, T.clean_html(F.col("t")), t="<p>A&nbsp;<b>great</b>  book &amp;lt;</p>") == "A great book <"
    assert one(spark, T.escape_xml(F.col("t")), t="<a b='c'>&\"") == "&lt;a b=&#x27;c&#x27;&gt;&amp;&quot;"


def test_stop_words(spark):
    assert one(spark, T.without_stop_words(F.col("t"), "de"), t="Die Würde, des Menschen") == "Würde, Menschen"
    assert one(spark, T.without_stop_words(F.col("t"), "en"), t="to be") == "to be"
    assert T.clean_query("the nature of it", "en") == ("nature", ["the", "of", "it"])


def test_key_values(spark):
    got = one(spark, T.key_values(F.col("t")), t="Original Title: Foo\r\nnoise\nrating: 8\nRating: 9\n: x")
    assert got == {"original_title": "Foo", "rating": "9"}


def test_folding(spark):
    assert fold_text("Ærøskøbing  École ﬁn") == "ærøskøbing ecole fin" and fold_text(None) is None
    assert one(spark, fold(F.col("t")), t="ÀÉî") == "aei"


def test_years(spark):
    assert [one(spark, T.first_year(F.col("t")), t=x) for x in ("2020-01-15", "c. 1987, repr.", "n.d.", None)] == [2020, 1987, None, None]


def test_votes_cut_a_text_once(spark):
    """Each language's count and share once was worked out from a cut of its own."""
    df = spark.createDataFrame([("the cat and le chat et la souris",), ("",), (None,)], "t string")
    for col in (T.language_votes(F.col("t")), T.detect_language(F.col("t"), least=5, share=0.3)):
        assert df.select(col.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("split(lower") == 1
    rows = [[(v["share"] and round(v["share"], 4), v["lang"]) for v in r["x"]] for r in df.select(T.language_votes(F.col("t")).alias("x")).collect()]
    assert rows == [[(0.3333, "fr"), (0.2222, "it"), (0.2222, "en")], [(0.0, "ru"), (0.0, "pt"), (0.0, "nl")], [(None, "ru"), (None, "pt"), (None, "nl")]]
    assert one(spark, T.detect_language(F.col("t"), least=5, share=0.3), t="der Hund und die Katze") == "de"
