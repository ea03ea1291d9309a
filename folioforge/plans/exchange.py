"""Queries of chat notes, files of a folder, sections of pages, fused lists and instructions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalogue as cat
from ..operators import filters as flt
from ..operators import retrieval as ret
from ..sources import annotations as ann
from ..sources import books, chat_notes, folders
from .registry import query

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_SLUG = "coalesce(nullif(rtrim(substr(trim(regexp_replace(replace(replace(replace(replace(lower(trim({})), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 50), '-'), ''), 'untitled')"
_AT = "TIMESTAMP '2023-01-01 03:04:05' + to_hours(CAST({} * 13 AS INT))"
_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _when(column: str):
    return F.expr(f"timestamp'2023-01-01 03:04:05' + make_interval(0, 0, 0, 0, cast({column} * 13 as int))")


def _about(t):
    """Every second conversation has a title of its own, two of three a time."""
    rows = t.conversations.select("conv_id").distinct()
    return rows.select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('A "talk" no. '), "conv_id")).alias("title"), F.when(F.col("conv_id") % 3 > 0, _when("conv_id")).alias("created"), F.when(F.col("conv_id") % 5 > 0, _when("(conv_id + 9)")).alias("updated"))


_FIRST = f"regexp_replace({_STRIP.format(f'string_split({_STRIP.format("asked")}, chr(10))[1]')}, '\\s+', ' ', 'g')"
_ABOUT = f"""(SELECT *, coalesce(CASE WHEN conv_id % 2 = 0 THEN 'A "talk" no. ' || CAST(conv_id AS STRING) END, CASE WHEN length(line) <= 60 THEN line WHEN contains(substr(line, 1, 60), ' ') THEN regexp_replace(substr(line, 1, 60), ' [^ ]*$', '') ELSE substr(line, 1, 60) END, 'Untitled') AS title,
 CASE WHEN conv_id % 3 > 0 THEN {_AT.format('conv_id')} END AS created, CASE WHEN conv_id % 5 > 0 THEN {_AT.format('(conv_id + 9)')} END AS updated FROM
 (SELECT *, {_FIRST} AS line FROM (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '**User:**' ELSE '**Grok:**' END || chr(10) || {_STRIP.format('text')}, chr(10) || chr(10) ORDER BY turn) AS body, string_agg('<section class="turn ' || role || '"><h2>' || CASE WHEN role = 'user' THEN 'You' ELSE 'Grok' END || '</h2><div>' || {{html}} || '</div></section>', chr(10) || '<hr>' || chr(10) ORDER BY turn) AS blocks, count(*) AS message_count, arg_min(text, turn) FILTER (role = 'user') AS asked
 FROM conversations WHERE role <> 'system' AND {_STRIP.format('text')} <> '' GROUP BY conv_id)))"""


@query("src30_platform_notes", f"""SELECT conv_id, coalesce(strftime(created, '%Y-%m'), 'undated') AS folder, coalesce(strftime(created, '%Y-%m-%d'), 'unknown') || '_grok_' || {_SLUG.format('title')} || '.md' AS name,
 '---' || chr(10) || 'title: "' || replace(title, '"', '''') || '"' || chr(10) || 'authors: [Grok]' || chr(10) || 'tags: [chat-protokoll, KI-generiert]' || chr(10) || 'type: chat' || chr(10) || 'source_llm: grok' || chr(10) || 'source_platform: grok.com' || chr(10) || 'created: ' || coalesce(strftime(created, '%Y-%m-%d'), 'unknown') || chr(10) || coalesce('modified: ' || strftime(updated, '%Y-%m-%d') || chr(10), '') || 'message_count: ' || CAST(message_count AS STRING) || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || body || chr(10) AS markdown FROM {_ABOUT.format(html="''")}""")
def _(t):
    """Whole conversations as notes of a platform."""
    return chat_notes.to_notes(t.conversations, "grok", _about(t))


@query("src30_platform_pages", f"""SELECT conv_id, title, md5('<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>' || {_ESCAPED.format('title')} || '</title></head><body>' || chr(10) || '<h1>' || {_ESCAPED.format('title')} || '</h1>' || chr(10) || '<p>Grok, ' || coalesce(strftime(created, '%Y-%m-%d'), 'unknown date') || '</p>' || chr(10) || blocks || chr(10) || '</body></html>' || chr(10)) AS html_md5 FROM
 {_ABOUT.format(html=f"CASE turn % 3 WHEN 0 THEN {_ESCAPED.format('text')} WHEN 1 THEN 'See <code>x &lt; y</code>: <pre><code class=\"language-sql\">' || regexp_replace({_ESCAPED.format('text')}, '\\s+$', '') || '</code></pre> then' ELSE {_ESCAPED.format('text')} || '```' || {_ESCAPED.format('text')} END")}""")
def _(t):
    """Whole conversations as pages; a third of the turns stand in a fence, a third have one that isn't closed."""
    said = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("See `x < y`: ```sql\n"), "text", F.lit("\n``` then"))).otherwise(F.concat("text", F.lit("```"), "text"))
    asked = t.conversations.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("asked"))
    about = _about(t).join(asked, "conv_id", "left").withColumn("title", F.coalesce("title", chat_notes.short_title(F.col("asked"))))
    made = chat_notes.to_pages(t.conversations.withColumn("text", said), "grok", about)
    return made.select("conv_id", "title", F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query("src30_local_times", f"SELECT doc_id, strftime({_AT.format('doc_id')}, '%Y-%m-%d %H:%M:%S') AS ts FROM documents")
def _(t):
    """Times that stand before whole texts, in German or English."""
    when = _when("doc_id")
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.date_format(when, "dd.MM.yyyy, HH:mm:ss"), F.lit(" MEZ"))).otherwise(F.date_format(when, "MMM d, yyyy, h:mm:ss a"))
    return t.documents.select("doc_id", F.date_format(chat_notes.local_time(F.concat(said, F.lit(" "), "text")), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("src31_notebook_dialogues", f"SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN '**User:**' ELSE '**Gemini:**' END || chr(10) || '**' || role || '** & more' || chr(10) || chr(10) || array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), chr(10) || chr(10)), chr(10) || chr(10) ORDER BY turn)) AS markdown_md5 FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def _(t):
    """Whole conversations written as a notebook's saved chats, read back as dialogues."""
    paras = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), T.escape_xml(T.strip(x)), F.lit("</p>"))), "\n")
    line = F.concat(F.when(F.col("role") == "user", "USER: ").otherwise("MODEL: "), F.lit("<p><b>"), "role", F.lit("</b> &amp; more</p>\n"), paras)
    files = t.conversations.filter("role <> 'system'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("value"))
    return files.select("conv_id", F.md5(chat_notes.notebook_markdown(F.col("value")).cast("binary")).alias("markdown_md5"))


@query("chk20_heading_sections", f"""SELECT id, CAST(dense_rank() OVER (PARTITION BY id ORDER BY s) - 1 AS INT) AS section, max(h) AS heading, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text FROM
 (SELECT *, count(h) OVER (PARTITION BY id ORDER BY i) AS s FROM (SELECT id, i, p, CASE WHEN length(p) % 7 = 0 AND {_STRIP.format('p')} <> '' THEN {_STRIP.format('p')} END AS h FROM (SELECT doc_id AS id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS p FROM documents))) GROUP BY id, s""")
def _(t):
    """Whole texts whose lines are paragraphs, and every line of a length that seven divides a heading."""
    lines = F.split("text", "\n")
    heads = F.filter(lines, lambda x: (F.length(x) % 7 == 0) & (T.strip(x) != ""))
    rows = t.documents.select(F.col("doc_id").alias("id"), F.array_join(lines, "\n\n").alias("text"), heads.alias("headings"))
    return books.split_by_headings(rows)


_CLEAN = "trim(regexp_replace(replace(replace({}, chr(160), ' '), chr(10), ' '), '\\s+', ' ', 'g'))"


@query("chk20_anchor_sections", f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INT) AS section, heading, text FROM (
 SELECT doc_id AS id, 0 AS k, NULL AS heading, {_CLEAN.format('lang')} AS text FROM documents UNION ALL SELECT doc_id, 1, 'First ' || source, {_CLEAN.format("source || ' ' || text")} FROM documents UNION ALL SELECT doc_id, 2, 'Second', {_CLEAN.format("lang || ' ' || text")} FROM documents) WHERE text <> ''""")
def _(t):
    """Whole texts twice in pages with two anchors, one of them named by a second entry too, and a third that isn't there."""
    said = T.escape_xml(F.col("text"))
    said = F.replace(said, F.lit("&#x27;"), F.lit("&#39;"))
    html = F.concat(F.lit("<p>"), "lang", F.lit("</p><h2 class='x' id='one'>"), "source", F.lit("</h2> <p>"), said, F.lit('</p><div><h3 id="two">'), "lang", F.lit("</h3> "), said, F.lit("</div>"))
    entry = lambda title, anchor: F.struct(title.alias("title"), F.lit(anchor).alias("anchor"))
    anchors = F.array(entry(F.lit("Second"), "two"), entry(F.lit("Gone"), "three"), entry(F.concat(F.lit("First "), "source"), "one"), entry(F.lit("Again"), "two"))
    return books.split_by_anchors(t.documents.select(F.col("doc_id").alias("id"), html.alias("html"), anchors.alias("anchors")))


_PATH = "concat('lib/', p_brand, '/', CAST(p_partkey AS STRING), '.', CASE p_size % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'EPUB' WHEN 2 THEN 'mobi' WHEN 3 THEN 'azw3' WHEN 4 THEN 'txt' WHEN 5 THEN 'opf' WHEN 6 THEN 'jpg' ELSE 'rtf' END)"
_ORDER = "list_position([" + ", ".join(f"'{x}'" for x in books.PREFERENCE) + "], lower(regexp_extract(path, '[^.]+$')))"


@query("src24_primary_files", f"SELECT folder, arg_min(path, (o, path)) AS path, list_sort(list_distinct(list(lower(regexp_extract(path, '[^.]+$'))))) AS formats FROM (SELECT *, {_ORDER} AS o, regexp_extract(path, '^(.*)/', 1) AS folder FROM (SELECT {_PATH} AS path FROM part WHERE p_partkey % 3 > 0 OR p_size % 8 > 1)) WHERE o > 0 GROUP BY folder", lists=("formats",))
def _(t):
    """The file of the most preferred format in each folder; covers and package files aren't books."""
    return books.primary_files(t.part.filter("p_partkey % 3 > 0 OR p_size % 8 > 1").select(F.expr(_PATH).alias("path")))


@query("src10_book_formats", f"SELECT folder, format, count(*) AS n, min(o) AS place FROM (SELECT regexp_extract(path, '^(.*)/', 1) AS folder, lower(regexp_extract(path, '[^.]+$')) AS format, {_ORDER} AS o FROM (SELECT {_PATH} AS path FROM part)) WHERE o > 0 GROUP BY 1, 2")
def _(t):
    """Formats of each folder with their place in the order of preference."""
    order = F.array_position(F.array(*[F.lit(x) for x in books.PREFERENCE]), books.extension(F.col("path")))
    rows = t.part.select(F.expr(_PATH).alias("path"))
    return rows.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder"), books.extension(F.col("path")).alias("format"), order.alias("place")).filter("place > 0").groupBy("folder", "format").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))


@query("src17_detected_formats", "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'rtf' WHEN 2 THEN 'html' WHEN 3 THEN 'djvu' WHEN 4 THEN 'md' WHEN 5 THEN 'mobi' ELSE 'epub' END AS format FROM documents")
def _(t):
    """Whole texts behind the first bytes of several formats, under names that mislead."""
    start = F.expr("CASE doc_id % 7 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN '{\\\\rtf1 ' WHEN 2 THEN '  <!DOCTYPE HTML><html>' WHEN 3 THEN 'AT&TFORM' WHEN 4 THEN '%PDF- ' WHEN 5 THEN concat(repeat('x', 60), 'BOOKMOBI') ELSE 'PK\x03\x04mimetypeapplication/epub+zip' END")
    path = F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 4, ".md").otherwise(".bin"))
    return t.documents.select("doc_id", books.detect_format(path, F.concat(start, "text").cast("binary")).alias("format"))


@query("src6_excluded_paths", "SELECT p_partkey, regexp_full_match(CAST(p_partkey AS STRING) || '.txt', '.*[0-9]7\\.txt') OR regexp_full_match(lower(p_name), '[a-m].*') AS excluded FROM part")
def _(t):
    """Paths that shell patterns leave out: by the whole path or the last part, in either case."""
    path = F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".txt"))
    return t.part.select("p_partkey", folders.excluded(path, ("*[0-9]7.TXT", "[A-M]*/*")).alias("excluded"))


@query("jon10_fused_lists", "SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(coalesce(1.0::DOUBLE / (60 + a.r1), 0) + coalesce(1.0::DOUBLE / (60 + b.r2), 0), 6) AS score FROM (SELECT id, row_number() OVER (ORDER BY length(text) DESC, id) AS r1 FROM chunks WHERE text IS NOT NULL QUALIFY r1 <= 300) a FULL JOIN (SELECT id, row_number() OVER (ORDER BY page_number DESC, id) AS r2 FROM chunks QUALIFY r2 <= 300) b USING (id)) QUALIFY rank <= 400")
def _(t):
    """Two ranked lists, fused by a full outer join: longest chunks and last pages."""
    a = ret.ranked(t.chunks.filter("text IS NOT NULL").select("id", F.length("text").alias("score")), 300)
    return ret.fuse(a, ret.ranked(t.chunks.select("id", F.col("page_number").alias("score")), 300), 400)


@query("srt2_rescored", "SELECT id, row_number() OVER (ORDER BY page_number DESC, id) AS rank FROM (SELECT id, page_number FROM chunks WHERE text IS NOT NULL ORDER BY length(text) DESC, id LIMIT 200)")
def _(t):
    """The best by one score, ranked anew by another; ties by id."""
    best = ret.ranked(t.chunks.filter("text IS NOT NULL").select("id", "page_number", F.length("text").alias("score")), 200)
    return ret.rerank_by(best, "page_number").select("id", "rank")


@query("scl7_annotation_fields", "SELECT doc_id AS item, CASE doc_id % 8 WHEN 1 THEN 'highlight' WHEN 2 THEN 'note' WHEN 3 THEN 'image' WHEN 4 THEN 'ink' WHEN 5 THEN 'underline' WHEN 6 THEN 'text' ELSE 'highlight' END AS type, text, lang AS note, CAST(CASE WHEN doc_id % 3 = 0 THEN n_chars % 1000 ELSE doc_id % 500 + 1 END AS INT) AS page FROM documents")
def _(t):
    """Kinds by their codes; the page from the label, else from the sort index, which counts from zero."""
    rows = t.documents.select(
        F.col("doc_id").alias("item"), (F.col("doc_id") % 8).cast("int").alias("type"), "text", F.col("lang").alias("comment"),
        F.when(F.col("doc_id") % 3 == 0, (F.col("n_chars") % 1000).cast("string")).when(F.col("doc_id") % 3 == 1, "xii").alias("page_label"),
        F.concat(F.lpad((F.col("doc_id") % 500).cast("string"), 5, "0"), F.lit("|001234|00100")).alias("sort_index"),
    )
    return ann.catalogue_annotations(rows, t.documents.select(F.col("doc_id").alias("item"), F.lit("").alias("note")).filter("item < 0"))


@query("dup5_tag_instructions", "SELECT id, lower(tag) AS key, 'calibredb set_metadata ' || CAST(id AS STRING) || ' --field tags:+duplicate' AS command FROM (SELECT *, row_number() OVER (PARTITION BY lower(tag) ORDER BY id) AS k FROM books) WHERE k > 1")
def _(t):
    """A command for every later book of those that share a key."""
    return cat.tag_instructions(t.books, F.lower("tag"))


@query("flt2_resolved_ids", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source || CAST(doc_id AS STRING) END AS book_id, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS number, CASE WHEN doc_id % 3 > 0 THEN source ELSE '00' END || CAST(doc_id AS STRING) AS name FROM documents")
def _(t):
    """Names of digits only are numbers."""
    name = F.concat(F.when(F.col("doc_id") % 3 > 0, F.col("source")).otherwise("00"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", flt.resolved_book_ids(name).alias("r")).select("doc_id", "r.*")
