"""Chat notes and pages, exports of activity and notebooks, sections of pages, the chain of readers."""

from __future__ import annotations

import datetime as dt
import html as std_html
import re

import pytest
from pyspark.sql import functions as F

from folioforge.operators import catalogue as cat
from folioforge.operators import filters as flt
from folioforge.sources import books, chat_notes, readers


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


TURNS = [(1, 0, "system", "be brief"), (1, 2, "assistant", " Because\nof x. "), (1, 1, "user", 'Why "x" < y?\nSay.'), (1, 3, "user", "  "), (2, 0, "system", "nothing follows"), (3, 0, "user", None), (3, 1, "assistant", "Unasked"), (None, 0, "user", "of no one")]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id int, turn int, role string, text string")


def test_notes(spark, turns):
    about = spark.createDataFrame([(1, None, dt.datetime(2024, 2, 29, 23, 59)), (3, 'He said "no"', None)], "conv_id int, title string, created timestamp")
    got = {r["conv_id"]: r for r in chat_notes.to_notes(turns, "claude", about).collect()}
    assert set(got) == {None, 1, 3}  # one without a word has no note
    assert (got[1]["folder"], got[1]["name"]) == ("2024-02", "2024-02-29_claude_why-x-y.md")
    assert got[1]["markdown"].splitlines() == ["---", "title: \"Why 'x' < y?\"", "authors: [Claude]", "tags: [chat-protokoll, KI-generiert]", "type: chat", "source_llm: claude", "source_platform: claude.ai", "created: 2024-02-29", "message_count: 2", "---", "", '# Why "x" < y?', "", "**User:**", 'Why "x" < y?', "Say.", "", "**Claude:**", "Because", "of x."]
    assert (got[3]["folder"], got[3]["name"]) == ("undated", "unknown_claude_he-said-no.md") and "message_count: 1" in got[3]["markdown"]


def test_notes_without_metadata(spark, turns):
    got = {r["conv_id"]: r["name"] for r in chat_notes.to_notes(turns, "grok").collect()}
    assert got == {1: "unknown_grok_why-x-y.md", 3: "unknown_grok_untitled.md", None: "unknown_grok_of-no-one.md"}
    assert chat_notes.to_notes(turns.limit(0), "grok").count() == 0


@pytest.mark.parametrize("text", ["a < b & `c > d` 'q'", "x\n```py\nif a < b:\n  pass\n```\nthen ```raw``` end", "open ```py\nnever `closed`", "", "``` ```", "a ```b``` c ```d"])
def test_code_blocks_agree_with_a_plain_reading(spark, text):
    def inline(s):
        return re.sub(r"`([^`\n]+)`", r"<code>\1</code>", std_html.escape(s))

    out, at = "", 0
    for m in re.finditer(r"```(?:(\w*)\n)?(.*?)```", text, re.S):
        kind = f' class="language-{m[1]}"' if m[1] else ""
        out += inline(text[at : m.start()]) + f"<pre><code{kind}>{std_html.escape(m[2].rstrip())}</code></pre>"
        at = m.end()
    assert one(spark, chat_notes.code_to_html(F.col("t")), t=text) == out + inline(text[at:])


def test_pages(spark, turns):
    got = {r["conv_id"]: r["html"] for r in chat_notes.to_pages(turns.filter("conv_id = 1"), "gemini").collect()}
    assert "<title>Why &quot;x&quot; &lt; y?</title>" in got[1] and "unknown date" in got[1]
    assert got[1].index('class="turn user"><h2>You</h2>') < got[1].index("<h2>Gemini</h2>") and got[1].count("<section") == 2


@pytest.mark.parametrize(
    ("text", "want"),
    [("14.03.2026, 13:08:30 MEZ", "2026-03-14 13:08:30"), ("Mar 4, 2026, 1:08:30 PM", "2026-03-04 13:08:30"), ("at mar 14, 2026, 12:00:00 AM x", "2026-03-14 00:00:00"), ("Dec 1 2025 12:01:02 pm", "2025-12-01 12:01:02"), ("31.02.2026, 10:00:00", None), ("no time", None), ("", None), (None, None), ("Oct 5, 2025, 17:00:01", "2025-10-05 17:00:01")],
)
def test_local_times(spark, text, want):
    assert one(spark, F.date_format(chat_notes.local_time(F.col("t")), "yyyy-MM-dd HH:mm:ss"), t=text) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h2>Head <b>bold</b></h2><p>One<br>two</p><p> </p><p>Three</p>", "## Head **bold**\n\nOne\ntwo\n\nThree"), ("<ul><li>a</li><li><i>b</i></li></ul>after", "- a\n- *b*\n\nafter"),
        ('see <a class="k" href="http://x/y">it</a> and <a href=\'z\'></a>', "see [it](http://x/y) and [z](z)"), ("a<hr/>b", "a\n---\n\nb"), ("<b> </b>x<em></em>", "x"), ("<strong>s</strong><script>no()</script>", "**s**"),
        ("1 &lt; 2 &amp;amp; 3", "1 < 2 &amp; 3"), ("<h6>deep</h6>", "##### deep"), ("<body>plain</body>", "plain"), (None, ""), ("", ""), ("a $1 \\ b <b>$2</b>", "a $1 \\ b **$2**"),
    ],
)
def test_markdown_of_html(spark, html, want):
    assert one(spark, chat_notes.html_to_markdown(F.col("h")), h=html) == want


def test_activity_becomes_conversations(spark):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [("f", 0, "b", "c", t + dt.timedelta(minutes=30)), ("f", 1, "a", "", t), ("f", 2, "d", None, t + dt.timedelta(minutes=60, seconds=1)), ("g", 0, "", "alone", t), ("g", 1, "late", "x", None)]
    made = chat_notes.activity_turns(spark.createDataFrame(rows, "file string, k int, prompt string, reply string, ts timestamp"), 30)
    said = {r["conv_id"]: r["markdown"].split("\n\n# ")[1].split("\n\n", 1)[1] for r in chat_notes.to_notes(made, "gemini").collect()}
    assert said == {"f#0": "**User:**\na\n\n**User:**\nb\n\n**Gemini:**\nc\n", "f#1": "**User:**\nd\n", "g#0": "**Gemini:**\nalone\n\n**User:**\nlate\n\n**Gemini:**\nx\n"}


def test_notebook_notes(spark):
    rows = [("n/Chat%20one.html", "N", "before\nUSER: <p>Hi</p>\n<p>there</p>\nmodel : <p><b>Yo</b></p>\nUSER:\n"), ("n/idea 5%.html", "N", "<h1>Idea</h1><p>x</p>"), ("m/log.html", "M", "MODEL: a"), ("m/none.html", None, None)]
    files = spark.createDataFrame(rows, "file string, notebook string, value string")
    sources = spark.createDataFrame([("N", "Z", "http://z"), ("N", "A", None), ("N", "A", None), ("N", None, None)], "notebook string, title string, url string")
    got = {r["file"]: (r["kind"], r["markdown"]) for r in chat_notes.notebook_notes(files, sources).collect()}
    assert got["n/Chat%20one.html"] == ("chat", '---\ntitle: "Chat one"\nnotebook: "N"\ntype: chat\nsources: ["A", "Z http://z", "untitled"]\n---\n\n**User:**\nHi\n\nthere\n\n**Gemini:**\n**Yo**\n')
    assert got["n/idea 5%.html"][0] == "note" and got["n/idea 5%.html"][1].endswith("# Idea\n\nx\n") and 'title: "idea 5%"' in got["n/idea 5%.html"][1]
    assert got["m/log.html"][0] == "chat" and "sources" not in got["m/log.html"][1]
    assert got["m/none.html"][0] == "note"


def plain_sections(text, headings):
    """One paragraph after the other."""
    flat, out, head, held = {" ".join(h.split()) for h in headings}, [], None, []
    for p in text.split("\n\n"):
        if " ".join(p.split()) in flat:
            if held:
                out.append((head, "\n\n".join(held)))
            head, held = p.strip(), [p]
        else:
            held.append(p)
    return [*out, (head, "\n\n".join(held))] if held else out


@pytest.mark.parametrize(("text", "headings"), [("intro\n\nOne  more\n\na\n\nb\n\nTwo\n\n Two \n\nc", ["One more", "Two"]), ("One\n\nx", ["One"]), ("no\n\nheads", []), ("x\n\ny", ["z"]), ("", ["One"]), ("One", ["One", "One"]), ("a\n\nOne", ["One"])])
def test_split_by_headings(spark, text, headings):
    rows = spark.createDataFrame([("d", text, headings)], "id string, text string, headings array<string>")
    got = books.split_by_headings(rows).orderBy("section").collect()
    assert [(r["heading"], r["text"]) for r in got] == plain_sections(text, headings) and [r["section"] for r in got] == list(range(len(got)))


def test_split_by_headings_of_nothing(spark):
    rows = spark.createDataFrame([("d", None, None), ("e", "x", None)], "id string, text string, headings array<string>")
    assert sorted((r["id"], r["section"], r["heading"], r["text"]) for r in books.split_by_headings(rows).collect()) == [("d", 0, None, ""), ("e", 0, None, "x")]
    assert books.split_by_headings(rows.limit(0)).count() == 0


def test_split_by_anchors(spark):
    kind = "id int, html string, anchors array<struct<title:string,anchor:string>>"
    page = "<p>In</p><h2 class='c' id='b'>B</h2><p>bb &amp; b</p><h2 id=\"a\"><i id=\"a2\">A</i></h2>aa<p id='e'></p>"
    rows = [(1, page, [("A", "a"), ("B", "b"), ("not there", "q"), ("B again", "b"), ("Inner", "a2"), ("Empty", "e")]), (2, page, []), (3, page, None), (4, None, [("A", "a")]), (5, '<h1 id="x">t</h1>', [("X", "x")])]
    got = sorted((r["id"], r["section"], r["heading"], r["text"]) for r in books.split_by_anchors(spark.createDataFrame(rows, kind)).collect())
    whole = "InBbb & bAaa"
    assert got == [(1, 0, None, "In"), (1, 1, "B", "Bbb & b"), (1, 2, "Inner", "Aaa"), (2, 0, None, whole), (3, 0, None, whole), (5, 0, "X", "t")]


def test_readers_in_a_chain(spark):
    files = spark.createDataFrame([("a.txt", bytearray(b"plain")), ("b.mobi", bytearray(b"\0" * 60 + b"BOOKMOBI")), ("c.epub", bytearray(b"PK\x03\x04 broken")), ("d.pdf", bytearray(b"%PDF-1.4"))], "path string, content binary")
    made = spark.createDataFrame([("a.txt", "not used"), ("b.mobi", "from outside"), ("c.epub", None)], "path string, text string")
    got = {r["path"]: r for r in readers.dispatch(files, made).collect()}
    assert {k: (v["text"], v["reader"]) for k, v in got.items()} == {"a.txt": ("plain", "native"), "b.mobi": ("from outside", "converter"), "c.epub": (None, None), "d.pdf": (None, None)}
    assert got["d.pdf"]["error"] == "no reader for pdf; the converter gave nothing" and got["c.epub"]["error"].startswith("BadZipFile") and got["a.txt"]["error"] is None
    assert {r["path"]: r["reader"] for r in readers.dispatch(files).collect()}["b.mobi"] is None


def test_tag_instructions(spark):
    rows = [(3, "k"), (1, "k"), (2, "K"), (4, ""), (5, ""), (6, None), (7, None), (8, "k")]
    got = cat.tag_instructions(spark.createDataFrame(rows, "id int, t string"), F.lower("t")).collect()
    assert sorted(r["id"] for r in got) == [2, 3, 8] and {r["id"]: r["command"] for r in got}[2] == "calibredb set_metadata 2 --field tags:+duplicate"


def test_book_ids_of_a_column(spark):
    values = ["7", "007", "a7", "", "9" * 30, "-1"]
    got = [tuple(r["r"]) for r in spark.createDataFrame([(v,) for v in values], "v string").select(flt.resolved_book_ids(F.col("v")).alias("r")).collect()]
    assert got == [(None, 7, "7"), (None, 7, "007"), ("a7", None, "a7"), ("", None, ""), ("9" * 30, None, "9" * 30), ("-1", None, "-1")]
    assert [flt.resolve_book_id(v)[:2] for v in values[:3]] == [g[:2] for g in got[:3]]
