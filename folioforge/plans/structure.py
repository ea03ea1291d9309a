"""Queries of chunking, page structure, HTML, vectors, sources and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.words import BACK_MATTER, FRONT_MATTER
from ..operators import chunking as ck
from ..operators import html, vectors
from ..operators import retrieval as ret
from ..sources import chats, clippings, notes, prepared
from .registry import query
from .retrieval import _vector_sql, query_vector
from .streams import shared_folder

CHUNK = "text string, char_start int, char_end int"


def _paras():
    """Texts with a blank line for each line feed: the tables have none."""
    return F.regexp_replace("text", "\n", "\n\n")


@query("chk1_paragraph_chunks")
def _(t):
    own = t.documents.select(F.col("doc_id").alias("id"), _paras().alias("text"))
    return ck.explode_chunks(own, ck.paragraph_chunks, CHUNK + ", window_text string")


@query("chk2_word_pieces")
def _(t):
    limits = ck.Limits()
    return ck.explode_chunks(t.documents.select(F.col("doc_id").alias("id"), "text"), lambda x: [{"text": p} for p in ck.split_words(x or "", limits)], "text string")


@query("chk3_hierarchy")
def _(t):
    def run(text: str) -> list[dict]:
        return ck.hierarchy([{"text": c["text"], "chunk_index": i, "section": i // 5} for i, c in enumerate(ck.paragraph_chunks(text))], "b")

    return ck.explode_chunks(t.documents.select(F.col("doc_id").alias("id"), _paras().alias("text")), run, "parent_id string, chunk_type string, text string").withColumnRenamed("id", "doc_id")


@query("chk4_plain_windows", "SELECT id, CAST(pos // 800 AS INT) AS chunk_index, substr(text, pos + 1, 1000) AS text FROM (SELECT doc_id AS id, text, unnest(range(0, length(text), 800)) AS pos FROM documents WHERE length(text) > 0)")
def _(t):
    return ck.plain_windows(t.documents.select(F.col("doc_id").alias("id"), "text"), 1000, 200)


@query("chk4_snapped_windows")
def _(t):
    return ck.explode_chunks(t.documents.select(F.col("doc_id").alias("id"), "text"), lambda x: ck.window_chunks(x, 1000, 200, 100), CHUNK)


@query("chk5_semantic_chunks")
def _(t):
    return ck.explode_chunks(t.documents.select(F.col("doc_id").alias("id"), _paras().alias("text")), ck.semantic_chunks, CHUNK)


_MARKED = "list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN length(x) % 5 = 0 THEN repeat('#', CAST(length(x) % 6 + 1 AS INT)) || ' ' || x ELSE x END)"


@query("chk6_heading_sections", f"""SELECT id, CAST(s - least_s AS INT) AS section, CAST(length(regexp_extract(body, '^(#{{1,6}})\\s', 1)) AS INT) AS level, body FROM (SELECT id, s, 0 AS least_s, string_agg(line || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i) AS body FROM
 (SELECT *, sum(CASE WHEN regexp_matches(line || chr(10), '^#{{1,6}}\\s') AND i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS s FROM (SELECT id, n, unnest(range(1, n + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id AS id, {_MARKED} AS l, len({_MARKED}) AS n FROM documents))) GROUP BY id, s) WHERE trim(body) <> ''""")
def _(t):
    """Whole texts in which every line of a length that five divides is a heading."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) % 5 == 0, F.concat(F.repeat(F.lit("#"), (F.length(x) % 6 + 1).cast("int")), F.lit(" "), x)).otherwise(x))
    return ck.heading_sections(t.documents.select(F.col("doc_id").alias("id"), F.array_join(lines, "\n").alias("text")))


@query("chk7_dialogue_turns", "SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS chunk_index, upper(role[1]) || role[2:] AS speaker, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations")
def _(t):
    """Whole conversations as Markdown, cut into turns again."""
    made = notes.render(t.conversations, F.lit("2024-05-01"), "chat", F.lit("x"))
    return ck.explode_chunks(made.select(F.col("conv_id").alias("id"), F.col("body").alias("text")), lambda x: [{"speaker": a, "text": b} for a, b in ck.dialogue_turns(x)], "speaker string, text string")


_EX = """SELECT conv_id, exchange_id, coalesce(string_agg(CASE WHEN role = 'user' THEN text END, chr(10) || chr(10) ORDER BY turn), '') AS prompt, coalesce(string_agg(CASE WHEN role <> 'user' THEN text END, chr(10) || chr(10) ORDER BY turn), '') AS reply FROM
 (SELECT *, CAST(coalesce(sum(CASE WHEN role <> 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS exchange_id FROM conversations WHERE role <> 'system') GROUP BY conv_id, exchange_id"""


@query("chk8_exchanges", _EX)
def _(t):
    return ck.group_exchanges(t.conversations)


@query("chk9_dialogue_chunks")
def _(t):
    ex = ck.group_exchanges(t.conversations).select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("exchange_id").cast("string")).alias("id"), F.concat(F.lit("**User:** "), "prompt", F.lit("\n\n**Assistant:** "), "reply").alias("text"))
    return ck.explode_chunks(ex, lambda x: ck.dialogue_chunks(ck.dialogue_turns(x)), "text string, exchange int, part int")


@query("chk10_comment_chunks")
def _(t):
    return ck.explode_chunks(t.pages.select(F.col("page_id").alias("id"), "html"), lambda x: [c | {"chunk_id": c["id"]} for c in ck.comment_chunks(x, "b")], "chunk_id string, text string, section_title string", column="html")


@query("chk11_annotation_chunks", "SELECT book_id || '_annotation_' || CAST(i AS STRING) AS id, book_id, text, CAST(-(i + 10) AS INT) AS chunk_index FROM (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY id) - 1 AS i, CASE WHEN regexp_replace(highlight, '^\\s+|\\s+$', '', 'g') <> '' AND regexp_replace(note, '^\\s+|\\s+$', '', 'g') <> '' THEN '[ANNOTATION] ' || regexp_replace(highlight, '^\\s+|\\s+$', '', 'g') || ' | Note: ' || regexp_replace(note, '^\\s+|\\s+$', '', 'g') WHEN regexp_replace(highlight, '^\\s+|\\s+$', '', 'g') <> '' THEN '[ANNOTATION] ' || regexp_replace(highlight, '^\\s+|\\s+$', '', 'g') WHEN regexp_replace(note, '^\\s+|\\s+$', '', 'g') <> '' THEN '[ANNOTATION_NOTE] ' || regexp_replace(note, '^\\s+|\\s+$', '', 'g') ELSE '' END AS text FROM annotations) WHERE text <> ''")
def _(t):
    return ck.annotation_chunks(t.annotations)


@query("chk12_metadata_stub", "SELECT id, concat_ws(chr(10), 'Title: ' || title, CASE WHEN id % 2 = 0 THEN 'Author: ' || publisher END, 'Publisher: ' || publisher, 'Year: ' || CAST(year(pubdate) AS STRING), 'Tags: ' || tag) AS text FROM books")
def _(t):
    author = F.when(F.col("id") % 2 == 0, F.col("publisher")).otherwise("")
    return t.books.select("id", ck.metadata_stub(F.col("title"), author, F.col("publisher"), F.year("pubdate"), F.col("tag"), F.lit(None)).alias("text"))


@query("chk13_chunk_rows", "SELECT c.book_id || '_chunk_' || CAST(c.id AS STRING) AS id, c.book_id, m.n AS book_chunks, c.tags FROM chunks c JOIN (SELECT book_id, count(*) AS n FROM chunks GROUP BY book_id) m ON m.book_id = c.book_id")
def _(t):
    meta = t.chunks.groupBy("book_id").agg(F.count(F.lit(1)).alias("book_chunks"))
    return t.chunks.join(meta, "book_id").select(F.concat("book_id", F.lit("_chunk_"), F.col("id").cast("string")).alias("id"), "book_id", "book_chunks", "tags")


@query("chk14_page_chunks")
def _(t):
    return ck.explode_chunks(t.documents.select(F.col("doc_id").alias("id"), "text"), lambda x: ck.page_chunks(list(enumerate((x or "").split("\n"), 1))), "text string, page int")


@query("chk15_toc_ranges", "SELECT p.book, p.page, arg_max(e.title, e.page) AS title FROM (SELECT book_id AS book, page_number AS page, id FROM chunks) p LEFT JOIN (SELECT DISTINCT book_id AS book, CAST(page_number // 50 * 50 + 1 AS INT) AS page, 'Part ' || CAST(page_number // 50 AS STRING) AS title FROM chunks) e ON e.book = p.book AND e.page <= p.page GROUP BY p.book, p.page, p.id")
def _(t):
    part = F.floor(F.col("page_number") / 50)
    toc = t.chunks.select(F.col("book_id").alias("book"), (part * 50 + 1).cast("int").alias("page"), F.concat(F.lit("Part "), part.cast("string")).alias("title")).distinct()
    return ck.toc_ranges(toc, t.chunks.select(F.col("book_id").alias("book"), F.col("page_number").alias("page"))).select("book", "page", "title")


_HEAD = "CASE id % 5 WHEN 0 THEN concat(language, ' Notes, ', book_id) WHEN 1 THEN concat('Vorwort ', book_id) WHEN 2 THEN concat('Banknotes ', language) ELSE book_id END"
_PAGE = "CASE id % 4 WHEN 0 THEN concat('x', {nl}, {roman}, {nl}, text) WHEN 1 THEN array_to_string(list_transform(string_split(repeat('Name, 12; 14-' || page_label || {nl}, 12), {nl}), lambda x: x), {nl}) ELSE text END"


def _any_of(words) -> str:
    return "regexp_matches(lower(title), '(^|[^\\p{L}\\p{N}_])(" + "|".join(words) + ")([^\\p{L}\\p{N}_]|$)')"


_IS_ROMAN = "length(head) > 0 AND regexp_full_match(upper(head), 'M?M?M?(CM|CD|D?C?C?C?)(XC|XL|L?X?X?X?)(IX|IV|V?I?I?I?)')"


@query("chk16_section_type", f"""SELECT id, CASE WHEN {_any_of(BACK_MATTER)} THEN 'back_matter' WHEN {_any_of(FRONT_MATTER)} THEN 'front_matter' WHEN len(l) >= 10 AND refs > len(l) * 0.5::DOUBLE AND short > len(l) * 0.7::DOUBLE THEN 'back_matter' WHEN page_number <= greatest(3, 300 * 0.05::DOUBLE) AND {_IS_ROMAN} THEN 'front_matter' ELSE 'main_content' END AS kind FROM
 (SELECT *, len(list_filter(l, lambda x: regexp_matches(x, '[0-9]\\s*[,;]\\s*[0-9]'))) AS refs, len(list_filter(l, lambda x: length(x) < 80)) AS short, regexp_extract(substr(page, 1, 100), '(?m)^\\s*([ivxlcIVXLC]{{1,8}})\\s*$', 1) AS head FROM
 (SELECT *, list_filter(list_transform(string_split(page, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM (SELECT id, page_number, {_HEAD} AS title, {_PAGE.format(nl="chr(10)", roman="concat(' ', CASE id % 3 WHEN 0 THEN 'xiv' WHEN 1 THEN 'iiii' ELSE 'VII' END, ' ')")} AS page FROM chunks)))""")
def _(t):
    roman = F.when(F.col("id") % 3 == 0, " xiv ").when(F.col("id") % 3 == 1, " iiii ").otherwise(" VII ")
    listed = F.repeat(F.concat(F.lit("Name, 12; 14-"), "page_label", F.lit("\n")), 12)
    page = F.when(F.col("id") % 4 == 0, F.concat(F.lit("x\n"), roman, F.lit("\n"), "text")).when(F.col("id") % 4 == 1, listed).otherwise(F.col("text"))
    return t.chunks.select("id", ck.section_type(F.expr(_HEAD), F.col("page_number"), page, F.lit(300)).alias("kind"))


_PAGES = "(SELECT source AS book, doc_id AS page, concat(CASE doc_id % 3 WHEN 0 THEN 'The Title of the Book ' WHEN 1 THEN 'Title of the Book ' ELSE 'Tne Title of the Book ' END, CAST(doc_id AS STRING), chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('Chapter ', lang, chr(10)) ELSE '' END, replace(text, '. ', concat('.', chr(10))), chr(10), lang, ' press edition, page ', CAST(doc_id AS STRING)) AS text FROM documents)"
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_LINES = f"(SELECT book, page, list_filter(list_transform(string_split({_TRIM.format('text')}, chr(10)), lambda x, i: {{'i': i - 1, 'line': x}}), lambda x: {_TRIM.format('x.line')} <> '') AS l FROM {_PAGES})"
_EDGES = f"(SELECT book, page, x.place AS place, x.i AS i, {_TRIM.format("regexp_replace(regexp_replace(lower(x.line), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')")} AS norm FROM (SELECT book, page, unnest(list_concat(list_transform(l[1:3], lambda x: {{'place': 'header', 'i': x.i, 'line': x.line}}), list_transform(l[greatest(len(l) - 2, 1):], lambda x: {{'place': 'footer', 'i': x.i, 'line': x.line}}))) AS x FROM {_LINES}))"
_LED = f"""e AS {_EDGES}, n AS (SELECT book, place, norm, count(DISTINCT page) AS n FROM e WHERE length(norm) > 5 GROUP BY ALL),
 lead AS (SELECT x.book, x.place, x.norm, arg_min(y.norm, (-y.n, y.norm)) AS line FROM n x JOIN n y ON y.book = x.book AND y.place = x.place AND (CASE WHEN abs(length(x.norm) - length(y.norm)) > floor(greatest(length(x.norm), length(y.norm)) * 0.15::DOUBLE + 1e-6) THEN false ELSE levenshtein(x.norm, y.norm) <= floor(greatest(length(x.norm), length(y.norm)) * 0.15::DOUBLE + 1e-6) END OR (y.n >= 3 AND contains(x.norm, y.norm))) GROUP BY ALL),
 led AS (SELECT e.*, line FROM e JOIN lead ON lead.book = e.book AND lead.place = e.place AND lead.norm = e.norm),
 led0 AS (SELECT book, place, line, count(DISTINCT page) AS pages FROM led GROUP BY ALL),
 total AS (SELECT book, count(DISTINCT page) AS all_pages FROM {_PAGES} GROUP BY book), runs AS (SELECT led0.* FROM led0 JOIN total ON total.book = led0.book WHERE pages >= CASE place WHEN 'header' THEN 3 ELSE greatest(10, floor(all_pages / 20::DOUBLE)) END)"""


def _pages(t):
    said = F.expr(_PAGES.split(", doc_id AS page, ")[1].split(" AS text FROM")[0].replace("chr(10)", "'\n'"))
    return t.documents.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), said.alias("text"))


@query("chk17_running_lines", f"WITH {_LED} SELECT * FROM runs")
def _(t):
    return ck.running_lines(_pages(t))


@query("chk17_without_running_lines", f"WITH {_LED}, gone AS (SELECT DISTINCT led.book, led.page, led.i FROM led JOIN runs ON runs.book = led.book AND runs.place = led.place AND runs.line = led.line) SELECT book, page, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT EXISTS (SELECT 1 FROM gone g WHERE g.book = z.book AND g.page = z.page AND g.i = z.i)), '') AS text FROM (SELECT book, page, i - 1 AS i, l[i] AS line FROM (SELECT book, page, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT book, page, string_split({_TRIM.format('text')}, chr(10)) AS l FROM {_PAGES}))) z GROUP BY book, page")
def _(t):
    return ck.without_running_lines(_pages(t))


@query("chk18_page_labels")
def _(t):
    def run(said: str) -> list[dict]:
        return [{"label": x} for x in ck.page_labels([None if x == "-" else x for x in said.split(",")])]

    said = F.concat_ws(",", F.lit("ii,3,4"), F.col("doc_id").cast("string"), F.lit("-,7,8"))
    return ck.explode_chunks(t.documents.select(F.col("doc_id").alias("id"), said.alias("text")), run, "label string")


@query("chk19_page_numbers", "SELECT doc_id AS id, 'a' || chr(10) || lang AS text FROM documents")
def _(t):
    said = F.concat(F.lit("a\n - "), (F.col("doc_id") % 1000).cast("string"), F.lit(" -\n"), "lang", F.lit(""))
    return t.documents.select(F.col("doc_id").alias("id"), ck.strip_page_numbers(said).alias("text"))


@query("chk19_paragraph_breaks", f"""SELECT id, 0 AS chunk_index, array_to_string(list_transform(l, lambda x, i: CASE WHEN {_TRIM.format('x')} <> '' AND i < len(l) AND {_TRIM.format('l[i + 1]')} <> '' AND ((length(x) < usual * 0.75::DOUBLE AND regexp_matches(x, '[.!?:»"”]\\s*$')) OR regexp_matches(l[i + 1], '^\\s\\s+\\S')) THEN x || chr(10) ELSE x END), chr(10)) AS text FROM
 (SELECT *, coalesce(n[CAST(floor(len(n) * 0.8::DOUBLE) AS INT) + 1], 0) AS usual FROM (SELECT *, list_sort(list_transform(list_filter(l, lambda x: {_TRIM.format('x')} <> ''), lambda x: length(x))) AS n FROM (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM documents)))""")
def _(t):
    return ck.explode_chunks(t.documents.select(F.col("doc_id").alias("id"), "text"), lambda x: [{"text": ck.paragraph_breaks(x)}], "text string")


_NUMBERED = "concat(CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(doc_id AS STRING) WHEN 2 THEN concat(CAST(doc_id % 30 AS STRING), '.', CAST(n_chars AS STRING)) ELSE concat(CAST(n_chars % 7 AS STRING), '.', CAST(doc_id % 9 AS STRING), '.', CAST(n_chars % 100 AS STRING), '.') END, CASE doc_id % 3 WHEN 0 THEN ' ' ELSE '' END, text)"


@query("chk20_section_numbers", f"SELECT id, regexp_extract(title, '^([0-9]+(?:\\.[0-9]+)*)', 1) AS number FROM (SELECT doc_id AS id, {_NUMBERED} AS title FROM documents)")
def _(t):
    from ..sources.books import section_number

    return t.documents.select(F.col("doc_id").alias("id"), section_number(F.expr(_NUMBERED)).alias("number"))


@query("chk21_html_extract")
def _(t):
    return html.extract(t.pages)


@query("chk21_html_title", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '(?i)<h[1-6][ >]')) AS INT) AS n FROM pages")
def _(t):
    return t.pages.select("page_id", F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit("(?i)<h[1-6][ >]"), F.lit(0))).alias("n"))


_FILE = "concat(CASE doc_id % 3 WHEN 0 THEN {bom} ELSE '' END, CASE doc_id % 4 WHEN 1 THEN concat('---', {nl}, 'title: ', lang, {nl}, '---', {nl}) ELSE '' END, replace(text, {lf}, CASE doc_id % 5 WHEN 0 THEN {cr} WHEN 1 THEN {nl} ELSE {lf} END))"


@query("chk22_text_files", "SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents")
def _(t):
    """Files with marks, front matter and line ends of several kinds come back as the plain texts."""
    from ..sources.books import clean_text_file

    said = F.expr(_FILE.format(bom="'﻿'", nl="'\r\n'", lf="'\n'", cr="'\r'"))
    return t.documents.select("doc_id", clean_text_file(said).alias("text"))


_SPOKEN = "CASE doc_id % 4 WHEN 0 THEN concat(lang, ': ', {nl}, text) WHEN 1 THEN concat(text, {nl}, '**', source, '**: ', lang) WHEN 2 THEN concat('**[', upper(lang), ']**', {nl}, text) ELSE text END"


@query("chk25_chunker_choice", f"""SELECT doc_id, CASE WHEN n_chars % 2 = 0 AND len(list_filter(string_split({_SPOKEN.format(nl="chr(10)")}, chr(10)), lambda x: (starts_with(x, '**') AND (contains(substr(x, 3), '**:') OR contains(x, ':**') OR (starts_with(x, '**[') AND ends_with(x, ']**')))) OR (NOT starts_with(x, '**') AND length(rtrim(x)) <= 32 AND regexp_full_match(rtrim(x), '[[:alpha:]][[:alnum:] ]*:')))) > 0 THEN 'dialogue' ELSE 'semantic' END AS chunker FROM documents""")
def _(t):
    strategy = F.when(F.col("n_chars") % 2 == 0, "dialogue").otherwise("plain")
    return t.documents.select("doc_id", ck.choose_chunker(strategy, F.expr(_SPOKEN.format(nl="'\n'"))).alias("chunker"))


@query("scl2_strip_html")
def _(t):
    return ck.explode_chunks(t.pages.select(F.col("page_id").alias("id"), "html"), lambda x: [{"text": html.text_of(x)}], "text string", column="html")


@query("scl4_accent_folding", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(strip_accents(lower(text)), '\\s+'), lambda x: x <> ''), ' ') AS text FROM documents")
def _(t):
    from ..functions.fold import fold

    return t.documents.select("doc_id", fold("text").alias("text"))


@query("scl10_rich_tags", "SELECT doc_id, text || ' ' || lang || ' ' || text AS text FROM documents")
def _(t):
    """Whole texts around a card, and within a tag that stands alone."""
    said = F.concat("text", F.lit(" <grok:render type=\"x\">\n"), "source", F.lit("</grok:render>"), "lang", F.lit("<x:br/> </xai:b>"), "text")
    return t.documents.select("doc_id", chats.clean_rich_tags(said).alias("text"))


# --- vectors

@query("emb1_embed_texts")
def _(t):
    return vectors.embed_texts(t.chunks.select("id", "text"))


@query("ret20_ivf_lists")
def _(t):
    v = t.chunk_vectors
    return vectors.IVF.fit(v, v.count()).assign(v).select("id", "list_id")


@query("ret20_ivf_search", _vector_sql())
def _(t):
    """By lists, exactly: every list that can hold one of the nearest is searched."""
    v = t.chunk_vectors
    ivf = vectors.IVF.fit(v, v.count())
    return ivf.search(ivf.assign(v), query_vector(t), 10)


def _found(index, now, queries, k=10):
    """One row: how many queries there were, and whether WANTED_RECALL of the true k nearest were found."""
    hits = total = 0
    for q in queries:
        want = {r["id"] for r in ret.vector_search(now, q, k).collect()}
        hits, total = hits + len(want & {r["id"] for r in index(q, k).collect()}), total + len(want)
    return now.sparkSession.createDataFrame([(len(queries), hits >= WANTED_RECALL * total)], "queries long, reached boolean")


WANTED_RECALL, PROBED = 0.9, 6


@query("ret20_ivfpq_search", f"SELECT {PROBED} AS queries, true AS reached")
def _(t):
    """By a stored index of product codes, opened anew; candidates are fetched late and scored exactly. Recall at 10 against brute force."""
    path = shared_folder(t)
    vectors.VectorIndex.build(t.chunk_vectors, path)
    queries = [[float(x) for x in r["embedding"]] for r in t.embeddings.orderBy(F.xxhash64("vec_id")).limit(PROBED).collect()]
    return _found(vectors.VectorIndex.open(t.spark, path), t.chunk_vectors, queries)


@query("ret21_vector_index_upkeep", f"SELECT {PROBED} AS queries, true AS reached")
def _(t):
    """As ret20_ivfpq_search, after vectors were added, changed and deleted; the truth is what is there now."""
    path, v = shared_folder(t), t.chunk_vectors
    index = vectors.VectorIndex.build(v.filter("id % 97 <> 1").withColumn("vector", F.when(F.col("id") % 97 == 2, F.transform("vector", lambda x: -x)).otherwise(F.col("vector"))), path)
    index.add(v.filter("id % 97 IN (1, 2)"))
    index.delete(v.filter("id % 97 = 3").select("id"))
    queries = [[float(x) for x in r["embedding"]] for r in t.embeddings.orderBy(F.xxhash64("vec_id")).limit(PROBED).collect()]
    return _found(vectors.VectorIndex.open(t.spark, path), v.filter("id % 97 <> 3"), queries)


@query("ret21_incremental_assignment")
def _(t):
    """New rows go to the lists that older rows made."""
    v = t.chunk_vectors
    return vectors.IVF.fit(v.filter("id % 2 = 0"), v.count()).assign(v).groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))


@query("emb4_embed_what_is_missing", "SELECT id FROM chunks WHERE chunk_type <> 'parent'")
def _(t):
    done = t.chunks.filter("chunk_type = 'parent'").select("id")
    return vectors.embed_texts(t.chunks.join(done, "id", "left_anti").select("id", "text")).select("id")


# --- sources and notes

_DE_MONTHS = "'Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember'"


@query("src12_clippings", f"""SELECT doc_id, 'The ' || source || ' (vol. ' || CAST(doc_id % 5 AS STRING) || ')' AS book_title, 'A. ' || lang AS book_author, CASE WHEN doc_id % 2 = 0 THEN 'highlight' ELSE 'note' END AS type, CASE WHEN doc_id % 2 = 1 THEN CAST(doc_id % 400 AS INT) END AS page, 'loc:' || CAST(n_chars AS STRING) || '-' || CAST(n_chars + 20 AS STRING) AS location, strftime(TIMESTAMP '2023-01-01 03:04:05' + to_hours(CAST(doc_id * 13 AS INT)), '%Y-%m-%d %H:%M:%S') AS created_at,
 array_to_string(list_filter(string_split({_TRIM.format('text')}, chr(10)), lambda x: {_TRIM.format('x')} <> ''), chr(10)) AS text FROM documents""")
def _(t):
    """Whole texts in clippings of either language, at times that depend on the row."""
    when = F.expr("timestamp'2023-01-01 03:04:05' + make_interval(0, 0, 0, 0, cast(doc_id * 13 as int))")
    month = F.expr(f"array({_DE_MONTHS})[month({'timestamp' + chr(39) + '2023-01-01 03:04:05' + chr(39)} + make_interval(0, 0, 0, 0, cast(doc_id * 13 as int))) - 1]")
    place = F.concat("n_chars", F.lit("-"), F.col("n_chars") + 20)
    german = F.concat(F.lit("- Ihre Markierung bei Position "), place, F.lit(" | Hinzugefügt am Montag, "), F.dayofmonth(when), F.lit(". "), month, F.lit(" "), F.date_format(when, "yyyy H:mm:ss"))
    english = F.concat(F.lit("- Your Note on page "), F.col("doc_id") % 400, F.lit(" | Location "), place, F.lit(" | Added on Sunday, "), F.date_format(when, "MMMM d, yyyy h:mm:ss a"))
    said = F.concat(F.lit("The "), "source", F.lit(" (vol. "), F.col("doc_id") % 5, F.lit(") (A. "), "lang", F.lit(")\n"), F.when(F.col("doc_id") % 2 == 0, german).otherwise(english), F.lit("\n\n"), "text", F.lit("\n==========\n"))
    return clippings.parse(t.documents.select("doc_id", said.alias("content")), "doc_id").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("src15_prepared_files", "SELECT concat(source, lang) AS file, count(*) + CASE WHEN count(*) % 3 = 0 THEN 1 ELSE 0 END AS expected, count(*) AS found, count(*) % 3 <> 0 AS whole FROM documents GROUP BY 1")
def _(t):
    """Files of whole texts, a third of them cut: their headers promise a row more."""
    name = F.concat("source", "lang").alias("file")
    lines = t.documents.select(name, F.to_json(F.struct("text", F.col("doc_id").alias("chunk_index"))).alias("value"))
    n = F.count(F.lit(1))
    heads = t.documents.groupBy(name).agg((n + F.when(n % 3 == 0, 1).otherwise(0)).alias("n")).select("file", F.to_json(F.struct(F.lit(True).alias("_header"), F.col("n").alias("chunk_count"))).alias("value"))
    return prepared.completeness(lines.union(heads))


@query("src8_note_links", "SELECT doc_id, ['Other', 'Third'] AS links, ['de', 'tag-1'] AS tags FROM documents", lists=("links", "tags"))
def _(t):
    said = F.concat(F.lit("# Head\nSee [[Other|the other]] and [[Third]], [[Other]] "), F.lit("#de and #tag-1.\n"))
    return notes.links_and_tags(t.documents.select("doc_id", said.alias("text")), "doc_id")


@query("snk12_vault_notes", "SELECT conv_id, '2024-05-01_chat_' || 'conversation-' || CAST(conv_id AS STRING) || '.md' AS name, md5(string_agg('**' || upper(role[1]) || role[2:] || ':** ' || text, chr(10) || chr(10) ORDER BY turn)) AS body_md5 FROM conversations GROUP BY conv_id")
def _(t):
    made = notes.render(t.conversations, F.lit("2024-05-01"), "chat", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")))
    return made.select("conv_id", "name", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("snk12_slug", "SELECT doc_id, coalesce(nullif(rtrim(substr(trim(regexp_replace(replace(replace(replace(replace(lower(trim(t)), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 50), '-'), ''), 'untitled') AS slug FROM (SELECT doc_id, text AS t FROM documents)")
def _(t):
    return t.documents.select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("snk11_markdown_results", f"""SELECT h.rank, '## ' || CAST(h.rank AS STRING) || '. ' || c.book_id || chr(10) || chr(10) || '> ' || replace(substr(c.text, 1, 500), chr(10), chr(10) || '> ') || chr(10) || chr(10) || array_to_string(list_transform(list_filter(string_split(c.tags, ', '), lambda x: x <> ''), lambda x: '#' || regexp_replace(x, '[^\\p{{L}}\\p{{N}}_/-]+', '-', 'g')), ' ') || chr(10) AS markdown FROM ({_vector_sql(k=20)}) h JOIN chunks c ON c.id = h.id""")
def _(t):
    found = ret.vector_search(t.chunk_vectors, query_vector(t), 20).join(t.chunks, "id")
    return notes.markdown_results(found)


@query("src14_tree_chat", "SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS said FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def _(t):
    """Conversations rebuilt from nodes that name their parent, following the last child."""
    nodes = t.conversations.select("conv_id", F.col("turn").alias("node"), (F.col("turn") - 1).alias("parent"), "role", "text")
    return chats.flatten_tree(nodes).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "text"))), lambda x: x["text"]), "|").alias("said"))
