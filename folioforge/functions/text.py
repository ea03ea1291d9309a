"""Scalar text functions as Columns: everything stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import ARTICLES, BACK_MATTER, FRONT_MATTER, SENTENCE_ENDS, STOP_WORDS, TOC_MARKERS, stop_words

_WS = r"(?U)\s+"


def _quoted(word: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", word)


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, _WS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.size(words(text))).otherwise(0).cast("long")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def has_keyword(text: Column, keywords: Iterable[str]) -> Column:
    """Whether any keyword stands in the text as a whole word or phrase, in either case."""
    alternatives = "|".join(_quoted(k.lower()) for k in keywords)
    return F.coalesce(F.lower(text).rlike(rf"(?U)(?<!\w)(?:{alternatives})(?!\w)"), F.lit(False)) if alternatives else F.lit(False)


def keyword_matches(text: Column, keywords: Iterable[str]) -> Column:
    """How many different keywords stand in the text as whole words."""
    out = F.lit(0)
    for k in keywords:
        out = out + has_keyword(text, [k]).cast("int")
    return out


def without_stop_words(query: Column, *languages: str) -> Column:
    """The query without stop words, or itself if nothing else is in it."""
    stop = F.array(*[F.lit(w) for w in stop_words(*languages)])
    kept = F.filter(words(query), lambda w: ~F.array_contains(stop, F.regexp_replace(F.lower(w), r"(?U)^[^\w]+|[^\w]+$", "")))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(query)


def clean_query(query: str, *languages: str) -> tuple[str, list[str]]:
    """A single query without stop words, and those taken off."""
    stop = set(stop_words(*languages))
    bare = lambda w: re.sub(r"^\W+|\W+$", "", w.lower())
    kept = [w for w in query.split() if bare(w) not in stop]
    return (" ".join(kept), [w for w in query.split() if bare(w) in stop]) if kept else (query, [])


def clean_html(html: Column) -> Column:
    """Text of a catalogue comment: tags off, the common entities read, white space collapsed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(out, _WS, " "))


def normalize_title(title: Column) -> Column:
    """Lower case, without leading articles and punctuation."""
    out = F.lower(F.coalesce(title, F.lit("")))
    for a in ARTICLES:
        out = F.regexp_replace(out, f"^{a}", "")
    return strip(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s]", ""), _WS, " "))


def first_year(date: Column) -> Column:
    """The year a date text begins with, or else the first four digits that stand alone."""
    return F.coalesce(F.substring(date, 1, 4).try_cast("int"), F.nullif(F.regexp_extract(date, r"\b(\d{4})\b", 1), F.lit("")).try_cast("int"))


def year_key(year: Column) -> Column:
    return F.coalesce(year.try_cast("int"), F.lit(0))


def key_values(text: Column) -> Column:
    """Map of the `Key: Value` lines of a free text; of equal keys the last wins."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), strip), lambda x: x.rlike(r"^[^:]+:\s*.+$"))
    pairs = F.transform(lines, lambda x: F.struct(F.replace(F.lower(F.trim(F.regexp_extract(x, "^([^:]+):", 1))), F.lit(" "), F.lit("_")).alias("key"), strip(F.regexp_extract(x, r"^[^:]+:\s*(.+)$", 1)).alias("value")))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(pairs, lambda q, j: (q["key"] == p["key"]) & (j > i))) == 0)
    return F.map_from_entries(last)


def escape_xml(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def json_string(text: Column) -> Column:
    """A JSON string literal, as Python's json writes it with non-ASCII characters left alone."""
    return F.regexp_replace(F.to_json(F.array(F.coalesce(text, F.lit("")))), r"^\[|\]$", "")


def json_strings(items: Column) -> Column:
    """A JSON list of strings with ", " between them."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, json_string), ", "), F.lit("]"))


def metadata_hash(author: Column, comments: Column, publisher: Column, tags: Column, title: Column) -> Column:
    """md5 of the canonical JSON of a book's fields; the order of tags doesn't count."""
    body = F.concat(F.lit('{"author": '), json_string(author), F.lit(', "comments": '), json_string(comments), F.lit(', "publisher": '), json_string(publisher), F.lit(', "tags": '), json_strings(F.array_sort(tags)), F.lit(', "title": '), json_string(title), F.lit("}"))
    return F.md5(body.cast("binary"))


def item_hash(abstract: Column, authors: Column, date: Column, tags: Column, title: Column) -> Column:
    """md5 of the canonical JSON of a reference item; the order of authors and tags doesn't count."""
    body = F.concat(F.lit('{"abstract": '), json_string(abstract), F.lit(', "authors": '), json_strings(F.array_sort(authors)), F.lit(', "date": '), json_string(date), F.lit(', "tags": '), json_strings(F.array_sort(tags)), F.lit(', "title": '), json_string(title), F.lit("}"))
    return F.md5(body.cast("binary"))


def annotation_line(text: Column, note: Column, kind: Column) -> Column:
    return F.concat_ws("|", F.coalesce(text, F.lit("")), F.coalesce(note, F.lit("")), F.coalesce(kind, F.lit("")))


def annotation_text(highlight: Column, note: Column) -> Column:
    """Searchable text of an annotation; empty if there is nothing in it."""
    h, n = strip(F.coalesce(highlight, F.lit(""))), strip(F.coalesce(note, F.lit("")))
    return F.when((h != "") & (n != ""), F.concat(F.lit("[ANNOTATION] "), h, F.lit(" | Note: "), n)).when(h != "", F.concat(F.lit("[ANNOTATION] "), h)).when(n != "", F.concat(F.lit("[ANNOTATION_NOTE] "), n)).otherwise("")


def cite_key(first_author: Column, year: Column, title: Column) -> Column:
    """Last word of the first author, year or NODATE, and the letters and digits of the title's first 20 characters."""
    last = F.coalesce(F.nullif(F.element_at(F.split(F.trim(first_author), _WS), -1), F.lit("")), F.lit("Unknown"))
    return F.concat(last, F.coalesce(year.cast("string"), F.lit("NODATE")), F.regexp_replace(F.substring(title, 1, 20), r"(?U)[^\p{Alnum}]", ""))


def highlight_terms(text: Column, terms: Iterable[str]) -> Column:
    """Each term in bold, longest first, in either case."""
    out = text
    for t in sorted(terms, key=lambda x: (-len(x), x)):
        out = F.regexp_replace(out, f"(?iu)({_quoted(t)})", "**$1**")
    return out


def occurrences(text: Column, phrase: str) -> Column:
    """How often a phrase occurs, without overlap, in either case and with any white space."""
    norm = F.regexp_replace(F.lower(text), _WS, " ")
    p = re.sub(r"\s+", " ", phrase.lower()).strip()
    return F.floor((F.length(norm) - F.length(F.replace(norm, F.lit(p), F.lit("")))) / F.lit(max(len(p), 1))).cast("long")


def snippet(text: Column, query: str, around: int = 200) -> Column:
    """The stretch around the phrase, else around the first of its words, else the beginning."""
    low, q = F.lower(text), query.lower()
    tokens = re.findall(r"[\w'-]+", q)
    phrase = F.locate(q, low)
    flexible = "(?U)" + r"\s+".join(_quoted(p) for p in q.split(" "))
    loose = F.regexp_instr(low, F.lit(flexible))
    found = [F.nullif(F.locate(t, low), F.lit(0)) for t in tokens] or [F.lit(None).cast("int")]
    first = F.least(*found) if len(found) > 1 else found[0]
    at = F.when(phrase > 0, phrase).when(loose > 0, loose).otherwise(first) - 1
    begin, end = F.greatest(at - around, F.lit(0)), F.least(at + around, F.length(text))
    cut = F.concat(F.when(begin > 0, "...").otherwise(""), text.substr(begin + 1, end - begin), F.when(end < F.length(text), "...").otherwise(""))
    head = F.concat(F.substring(text, 1, 300), F.when(F.length(text) > 300, "...").otherwise(""))
    return F.when(at.isNull(), head).otherwise(cut)


def section_type_of_title(title: Column) -> Column:
    return F.when(has_keyword(title, BACK_MATTER), "back_matter").when(has_keyword(title, FRONT_MATTER), "front_matter")


def _lists_pages(line: Column) -> Column:
    """Whether a number follows a number after a comma or semicolon."""
    parts = F.transform(F.split(F.replace(line, F.lit(";"), F.lit(",")), ","), strip)
    number = lambda c: c.between("0", "9")
    seams = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.coalesce(F.exists(seams, lambda i: number(F.right(F.get(parts, i - 1), F.lit(1))) & number(F.substring(F.get(parts, i), 1, 1))), F.lit(False))


def looks_like_index(page: Column) -> Column:
    """Many short lines with page references."""
    lines = F.filter(F.transform(F.split(page, "\n"), strip), lambda x: x != "")
    n = F.size(lines)
    refs = F.size(F.filter(lines, _lists_pages))
    short = F.size(F.filter(lines, lambda x: F.length(x) < 80))
    return (n >= 10) & (refs > n * 0.5) & (short > n * 0.7)


def is_roman(text: Column) -> Column:
    return (F.length(text) > 0) & text.rlike("(?i)^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")


def roman_value(text: Column) -> Column:
    """Value of a Roman numeral: a letter counts negative before a greater one."""
    values = F.create_map(*[x for c, v in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in (F.lit(c), F.lit(v))])
    chars = F.transform(F.filter(F.split(F.upper(text), ""), lambda c: c != ""), lambda c: F.coalesce(values[c], F.lit(0)))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda acc, v: F.struct((acc["sum"] + F.when(v < acc["last"], -v).otherwise(v)).alias("sum"), v.alias("last"))
    return F.aggregate(F.reverse(chars), zero, step, lambda acc: acc["sum"])


def slug(text: Column, longest: int = 50) -> Column:
    """A name that file systems take; umlauts are spelt out."""
    out = F.lower(F.trim(text))
    for char, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(char), F.lit(plain))
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(out, 1, longest), "-+$", ""), F.lit("")), F.lit("untitled"))


def estimated_tokens(text: Column) -> Column:
    """Words times 1.3."""
    return word_count(text) * F.lit(1.3)


def quarter_tokens(text: Column) -> Column:
    """Characters over 4."""
    return F.floor(F.length(text) / 4).cast("long")


def ends_open(text: Column) -> Column:
    """Whether a chunk stops within a sentence: no end mark, and over 20 words in its last paragraph."""
    t = F.regexp_replace(text, r"(?U)\s+$", "")
    last = F.element_at(F.split(t, "\n\n"), -1)
    return (F.length(t) > 0) & ~t.rlike("[" + re.escape(SENTENCE_ENDS) + "]$") & (word_count(last) > 20)


def _among(words: Iterable[str]):
    return lambda w: w.isin(*words)


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is worked out once for a row, however often fn names it."""
    return F.transform(F.array(value), fn)[0]


def _stop_word_counts(text: Column, languages: Iterable[str]) -> Column:
    """How many of the text's words are stop words of each language: a list in the languages' order. The text is cut into words once."""
    lists = [STOP_WORDS[x] for x in languages]
    known = F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), _among(sorted({w for own in lists for w in own})))
    return _once(known, lambda t: F.array(*[F.size(F.filter(t, _among(own))) for own in lists]))


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda s, n: s + n)


def detect_language(text: Column, least: int = 50, share: float = 0.9) -> Column:
    """Language by a vote of stop words, null for short texts or votes under `share`."""
    languages = ("en", "de", "fr", "es")
    best = lambda c: F.array_max(F.array(*[F.struct(c[i].alias("n"), F.lit(x).alias("lang")) for i, x in enumerate(languages)]))
    found = lambda c: F.when((_sum(c) > 0) & (best(c)["n"] >= _sum(c) * share), best(c)["lang"])
    return F.when(F.length(text) >= least, _once(_stop_word_counts(text, languages), found))


def language_votes(text: Column) -> Column:
    """Languages with their share of the vote, greatest first."""
    def shares(counts: Column) -> Column:
        total = F.greatest(_sum(counts), F.lit(1))
        return F.array(*[F.struct((counts[i] / total).alias("share"), F.lit(x).alias("lang")) for i, x in enumerate(STOP_WORDS)])

    return F.slice(F.sort_array(_once(_stop_word_counts(text, STOP_WORDS), shares), asc=False), 1, 3)


def toc_marker_reason(highlight: Column, note: Column, pos_frac: Column, spine_index: Column, least: int = 20, first_percent: float = 5.0) -> Column:
    """Why an annotation is noise; null if it isn't."""
    h, n = strip(F.coalesce(highlight, F.lit(""))), strip(F.coalesce(note, F.lit("")))
    return (
        F.when((F.length(h) < least) & (n == ""), "too_short")
        .when((F.length(h) < 50) & has_keyword(F.concat_ws(" ", h, n), TOC_MARKERS), "toc_markers")
        .when(pos_frac.try_cast("double") * 100 < first_percent, "first_percent")
        .when(spine_index == 0, "toc_markers")
    )


def selection(text: Column, count: Column) -> Column:
    """Sorted indices that a selection such as "0,3,5-10" or "all" names, within count."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    ranges = F.transform(parts, lambda p: F.when(p.contains("-"), F.sequence(F.split(p, "-", 2)[0].cast("int"), F.split(p, "-", 2)[1].cast("int"))).otherwise(F.array(F.split(p, "-", 2)[0].try_cast("int"))))
    every = F.sequence(F.lit(0), count - 1)
    picked = F.array_sort(F.array_distinct(F.filter(F.flatten(ranges), lambda i: (i >= 0) & (i < count))))
    return F.when(F.lower(F.trim(text)) == "all", F.when(count > 0, every).otherwise(F.array().cast("array<int>"))).otherwise(picked)


def url_decoded(text: Column) -> Column:
    """Percent escapes read; a percent sign that begins none stays."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))
