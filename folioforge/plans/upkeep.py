"""Queries of repair jobs, readers' records and the remaining sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalogue as cat
from ..operators import repair
from ..operators.tables import shared_root
from ..sources import annotations as ann
from ..sources import prepared, readers
from .lifecycle import _mhash, _mhash_sql
from .registry import query


@query("src13_note_footers", "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, CASE WHEN doc_id % 4 <> 0 THEN 'Title ' || source END AS title, CASE WHEN doc_id % 4 <> 0 THEN 'One, ' || upper(lang) || ' & Two, B' END AS author FROM documents")
def _(t):
    """Whole texts as notes, most with a footer."""
    foot = F.concat(F.lit("\n\nOne, "), F.upper("lang"), F.lit("; Two, B. Title "), "source", F.when(F.col("doc_id") % 3 == 0, " (German Edition)").otherwise(""), F.lit(" (S. "), F.col("doc_id") % 700, F.lit("). Verlag. Kindle-Version. "))
    own = t.documents.select("doc_id", F.concat("text", F.when(F.col("doc_id") % 4 == 0, "").otherwise(foot)).alias("t"))
    f = readers.footer_fields(F.col("t"))
    return own.select("doc_id", readers.strip_note_footer(F.col("t")).alias("text"), f["title"].alias("title"), f["author"].alias("author"))


@query("src19_custom_fields", "SELECT id AS book, title AS shelf, tag AS note FROM books")
def _(t):
    shelf = t.books.select(F.col("id").alias("book"), F.col("title").alias("value"))
    note = t.books.select(F.col("id").alias("book"), F.concat(F.lit("<p>"), "tag", F.lit("</p>")).alias("value"))
    f = cat.custom_fields({"shelf": ("text", shelf), "note": ("comments", note)})
    return f.select("book", F.col("fields")["shelf"].alias("shelf"), F.col("fields")["note"].alias("note"))


@query("src21_catalogue_before_file", "SELECT id, CASE WHEN id % 3 = 0 THEN 'file title' ELSE title END AS title, CASE WHEN id % 4 = 0 THEN 'file' END AS isbn_source FROM books")
def _(t):
    own = t.books.select("id", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("title")).alias("title"), F.lit("").alias("author"), F.lit(None).cast("string").alias("isbn"))
    files = t.books.select("id", F.lit("file title").alias("title"), F.lit("x").alias("author"), F.when(F.col("id") % 4 == 0, "978").alias("isbn"))
    return cat.choose_identity(own, files).select("id", "title", "isbn_source")


_MODE = "CASE id % 6 WHEN 2 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE CAST(id % 2 AS INT) END"
_AT = "CASE id % 6 WHEN 4 THEN concat('attachments:', title, '.pdf') WHEN 5 THEN concat('/abs/', publisher, '/', title, '.pdf') ELSE concat('storage:', title, '.pdf') END"
_KIND = "CASE rating WHEN 2 THEN 'application/epub+zip' WHEN 4 THEN 'text/html' WHEN 6 THEN 'image/png' ELSE 'application/pdf' END"
_THERE = "(SELECT concat('/st/k', CAST(id AS STRING), '/', title, '.pdf') AS path FROM books WHERE series <> '7' UNION ALL SELECT concat('/abs/', publisher, '/', title, '.pdf') FROM books WHERE length(title) % 2 = 0)"


@query("src22_attachments", f"""SELECT item, CASE WHEN ok THEN at_path END AS path, CASE WHEN ok THEN format END AS format, CASE WHEN NOT ok THEN CASE WHEN mode = 3 THEN 'web link without a local copy' WHEN mode = 2 AND starts_with(said, 'attachments:') THEN 'base directory isn''t configured' WHEN NOT there THEN 'file is missing' ELSE 'format isn''t supported' END END AS reason FROM
 (SELECT *, coalesce(there AND format IS NOT NULL AND at_path IS NOT NULL, false) AS ok FROM (SELECT *, coalesce(at_path IN (SELECT path FROM {_THERE}), false) AS there, CASE kind WHEN 'application/pdf' THEN 'pdf' WHEN 'application/epub+zip' THEN 'epub' WHEN 'text/html' THEN 'html' END AS format FROM
 (SELECT id AS item, {_MODE} AS mode, {_AT} AS said, {_KIND} AS kind, CASE WHEN id % 6 IN (0, 1, 3) THEN concat('/st/k', CAST(id AS STRING), '/', title, '.pdf') WHEN id % 6 = 5 THEN concat('/abs/', publisher, '/', title, '.pdf') END AS at_path FROM books)))""")
def _(t):
    rows = t.books.select(F.col("id").alias("item"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.expr(_MODE).alias("link_mode"), F.expr(_AT).alias("path"), F.expr(_KIND).alias("content_type"))
    files = t.sql(_THERE[1:-1]).distinct()
    return readers.attachments(rows, files, "/st").select("item", "path", "format", "reason")


@query("src28_catalogue_annotations", "SELECT id AS item, CASE id % 3 WHEN 0 THEN 'highlight' WHEN 1 THEN 'note' ELSE 'underline' END AS type, title AS text, CAST(id % 90 + 1 AS INT) AS page FROM books UNION ALL SELECT id, 'note', publisher, NULL FROM books WHERE id % 2 = 0")
def _(t):
    a = t.books.select(F.col("id").alias("item"), F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 2).otherwise(5).alias("type"), F.col("title").alias("text"), F.lit("").alias("comment"), F.lit(None).cast("string").alias("page_label"), F.concat(F.lpad((F.col("id") % 90).cast("string"), 5, "0"), F.lit("|000|0")).alias("sort_index"))
    n = t.books.filter("id % 2 = 0").select(F.col("id").alias("item"), F.concat(F.lit("<p>"), "publisher", F.lit("</p>")).alias("note"))
    return ann.catalogue_annotations(a, n).select("item", "type", "text", "page")


@query("src29_combined_annotations", "SELECT id, 'viewer' AS source FROM annotations WHERE kind = 'highlight' UNION ALL SELECT id, 'pdf' FROM annotations WHERE kind = 'note' OR trim(note) <> ''")
def _(t):
    own = t.annotations.select("id", F.col("kind").alias("type"), F.col("note").alias("notes"))
    return ann.combine(ann.highlights(own), ann.noted(own)).select("id", "source")


@query("agg19_annotated_books", "SELECT sha256(book_id) AS hash, count(*) AS n FROM annotations GROUP BY 1 ORDER BY n DESC, hash")
def _(t):
    return ann.annotated_books(t.annotations.select(ann.path_hash(F.col("book_id")).alias("hash")))


@query("snk8_prepared_lines", "SELECT book_id AS file, count(*) AS expected, count(*) AS found, true AS whole FROM chunks GROUP BY book_id")
def _(t):
    own = t.chunks.select("book_id", F.to_json(F.struct("id", "text", "chunk_index")).alias("value"))
    head = t.chunks.groupBy("book_id").agg(F.count(F.lit(1)).alias("n")).select("book_id", F.to_json(F.struct(F.lit(True).alias("_header"), F.col("n").alias("chunk_count"))).alias("value"))
    return prepared.completeness(own.union(head).select(F.col("book_id").alias("file"), "value"))


@query("snk16_patched_comments", "SELECT id AS value, book_id FROM (SELECT CAST(id AS STRING) AS id, book_id FROM chunks WHERE NOT (chunk_type = 'calibre_comment' AND book_id IN ('src1', 'src2')) UNION ALL SELECT DISTINCT 'new', book_id FROM chunks WHERE book_id IN ('src1', 'src2'))")
def _(t):
    lines = t.chunks.select(F.col("book_id").alias("file"), "book_id", F.col("id").cast("string").alias("value"), "chunk_type")
    new = t.spark.createDataFrame([("src1", "new"), ("src2", "new")], "book_id string, value string")
    return prepared.patch_comments(lines, new).select("value", "book_id")


@query("snk17_remaining_books", "SELECT DISTINCT book_id FROM chunks WHERE book_id NOT IN (SELECT book_id FROM chunks WHERE id % 97 = 0)")
def _(t):
    return repair.remaining(t.chunks.select("book_id").distinct(), t.chunks.filter("id % 97 = 0"))


_SPELT = "CASE id % 4 WHEN 0 THEN concat(title, ' zz') WHEN 1 THEN upper(title) WHEN 2 THEN concat('The ', title, '!') ELSE replace(title, 'e', '') END"
_PLAIN = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query("snk18_unmatched_annotations", f"SELECT id FROM books WHERE regexp_replace({_PLAIN.format(_SPELT)}, '^the ', '') NOT IN (SELECT {_PLAIN.format('title')} FROM books)")
def _(t):
    entries = t.books.select(F.col("id").alias("entry"), F.expr(_SPELT).alias("title"), F.lit("").alias("author"), F.lit(None).cast("string").alias("asin"))
    found = cat.match_books(entries, t.books.select("id", "title", F.lit("x").alias("author"), F.lit("none").alias("asin")))
    return found.filter("book IS NULL").select(F.col("entry").alias("id"))


@query("qlt10_hash_backfill", "SELECT id, CASE WHEN metadata_hash = 'h0' THEN 'new ' || book_id ELSE metadata_hash END AS metadata_hash FROM chunks")
def _(t):
    own = t.chunks.select("id", "book_id", F.when(F.col("metadata_hash") == "h0", "").otherwise(F.col("metadata_hash")).alias("metadata_hash"))
    return repair.backfill_hashes(own, own.select("book_id", F.concat(F.lit("new "), "book_id").alias("metadata_hash")).distinct()).select("id", "metadata_hash")


@query("qlt10_refreshed_comments", "SELECT id, book_id FROM chunks WHERE NOT (chunk_type = 'calibre_comment' AND book_id = 'src1') UNION ALL SELECT -1, 'src1'")
def _(t):
    new = t.spark.createDataFrame([(-1, "src1")], "id long, book_id string")
    return repair.refresh_comments(t.chunks.select("id", "book_id", "chunk_type"), new).select("id", "book_id")


@query("qlt10_unstable_hashes", f"SELECT * FROM (SELECT id AS book_id, {_mhash_sql('title')} AS metadata_hash, {_mhash_sql("(CASE WHEN length(title) % 3 = 0 THEN replace(title, ' ', '  ') ELSE title END)")} AS again FROM books) WHERE metadata_hash <> again")
def _(t):
    """Hashes of the same books, once with tags in another order, which doesn't count, and some titles spaced wider, which does."""
    one = t.books.select(F.col("id").alias("book_id"), _mhash(F.col("title")).alias("metadata_hash"))
    wide = F.when(F.length("title") % 3 == 0, F.replace("title", F.lit(" "), F.lit("  "))).otherwise(F.col("title"))
    two = t.books.select(F.col("id").alias("book_id"), T.metadata_hash(F.col("publisher"), F.col("title"), F.col("publisher"), F.array("format", "tag"), wide).alias("metadata_hash"))
    return repair.unstable_hashes(one, two)


@query("qlt11_admission", "SELECT book_id AS book, avg(CASE WHEN page_label <> '' THEN 1 ELSE 0 END) AS share, count(*) AS pages, avg(CASE WHEN page_label <> '' THEN 1 ELSE 0 END) >= 0.75 AS admitted FROM chunks GROUP BY book_id")
def _(t):
    return repair.admission(t.chunks.select(F.col("book_id").alias("book"), "page_number", (F.col("page_label") != "").alias("present")), 0.75).drop("reasons")


# whole texts with note markers and bodies at their ends: some without a partner, some bodies before their markers
_NOTED = """SELECT book_id AS book, id AS k, CASE id % 7 WHEN 0 THEN text || ' [^' || (id % 50) || ']' WHEN 3 THEN text || chr(10) || '[^' || (id % 50) || ']: a note' WHEN 5 THEN text || ' [^' || (id % 11) || '] and [^x' || id || ']' || chr(10) || ' [^' || (id % 11) || ']: its note' ELSE text END AS text FROM chunks"""
_PLACES = f"""(SELECT book, k, unnest(list_distinct(regexp_extract_all(text, '\\[\\^([^\\]\\s]+)\\](?:[^:]|$)', 1))) AS note, 'marker' AS kind FROM ({_NOTED}) UNION ALL SELECT book, k, unnest(list_distinct(regexp_extract_all(text, '(?m)^[ \\t]*\\[\\^([^\\]\\s]+)\\]:', 1))), 'body' FROM ({_NOTED}))"""
_LOST = f"SELECT book, note, k, CASE kind WHEN 'marker' THEN 'unresolved' ELSE 'orphaned' END AS reason FROM {_PLACES} p WHERE NOT EXISTS (SELECT 1 FROM {_PLACES} o WHERE o.book = p.book AND o.note = p.note AND o.kind <> p.kind AND CASE WHEN p.kind = 'marker' THEN o.k >= p.k ELSE o.k <= p.k END)"


@query("qlt11_unmatched_notes", _LOST)
def _(t):
    """Markers without a later body and bodies without an earlier marker, in whole texts."""
    return repair.unmatched_notes(t.sql(_NOTED.replace("chr(10)", "'\\n'")))


@query("qlt11_admission_by_notes", f"""SELECT c.book, share, pages, definitions, unresolved, orphaned, share >= 0.7 AND unresolved = 0 AND orphaned = 0 AS admitted FROM (SELECT book_id AS book, avg(CASE WHEN page_label <> '' THEN 1 ELSE 0 END) AS share, count(*) AS pages FROM chunks GROUP BY 1) c
 LEFT JOIN (SELECT book, count(*) AS definitions FROM {_PLACES} WHERE kind = 'body' GROUP BY 1) d ON d.book = c.book LEFT JOIN (SELECT book, count(*) FILTER (reason = 'unresolved') AS unresolved, count(*) FILTER (reason = 'orphaned') AS orphaned FROM ({_LOST}) GROUP BY 1) l ON l.book = c.book""")
def _(t):
    pages = t.chunks.select(F.col("book_id").alias("book"), "page_number", (F.col("page_label") != "").alias("present"))
    return repair.admission(pages, 0.7, t.sql(_NOTED.replace("chr(10)", "'\\n'"))).drop("reasons")


@query("snk17_ledger", "SELECT id AS key, CASE WHEN tag LIKE '%TIN' THEN 'failed' ELSE 'done' END AS status, CASE WHEN tag LIKE '%TIN' THEN 0 ELSE length(title) END AS rows FROM books")
def _(t):
    """All books in batches; books of one kind fail halfway and are rows of the ledger. A second run finds nothing left to do."""
    path = f"{shared_root(t.spark)}/drive-{uuid.uuid4().hex}"

    def work(rows):
        letters = rows.select("id", "tag", F.posexplode(F.split("title", "")).alias("k", "letter"))
        return letters.select("id", "k", "letter", F.when(F.col("tag").endswith("TIN") & (F.col("k") == 2), F.lit("unreadable")).alias("error"))

    queue, half = t.books.select("id", "title", "tag"), t.books.count() // 3 + 1
    repair.drive(queue, "id", work, path, half)
    said = repair.drive(queue, "id", work, path, half)
    rows = repair.driven_rows(t.spark, path).groupBy(F.col("id").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("made"))
    return said.join(rows, "key", "left").select(F.col("key").cast("long").alias("key"), "status", F.coalesce("made", F.lit(0)).alias("rows"))


@query("qlt12_toc_report", "SELECT e.book_id, e.title, e.page, coalesce(a.n, 0) AS by_title, coalesce(b.n, 0) AS by_page FROM (SELECT DISTINCT book_id, section_type AS title, CAST(id % 20 AS INT) AS page FROM chunks) e LEFT JOIN (SELECT book_id, section_type, count(*) AS n FROM chunks GROUP BY 1, 2) a ON a.book_id = e.book_id AND a.section_type = e.title LEFT JOIN (SELECT book_id, page_number, count(*) AS n FROM chunks GROUP BY 1, 2) b ON b.book_id = e.book_id AND b.page_number = e.page")
def _(t):
    toc = t.chunks.select("book_id", F.col("section_type").alias("title"), (F.col("id") % 20).cast("int").alias("page")).distinct()
    return repair.toc_report(toc, t.chunks.withColumnRenamed("section_type", "section_title"))


@query("chk23_spans", "SELECT book_id AS book, id AS k, coalesce(sum(length(text) + 2) OVER (PARTITION BY book_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, (coalesce(sum(length(text) + 2) OVER (PARTITION BY book_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text))::BIGINT AS char_end FROM chunks")
def _(t):
    return repair.spans(t.chunks.select(F.col("book_id").alias("book"), F.col("id").alias("k"), "text"))


@query("wdg8_resume", "SELECT id FROM books WHERE id % 3 <> 0")
def _(t):
    return repair.remaining(t.books.select("id"), t.books.filter("id % 3 = 0").select("id"), "id")
