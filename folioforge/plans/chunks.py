"""Queries of the chunk store, its statistics and its audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.words import STOP_WORDS
from ..operators import chunkstore as cs
from .registry import query

_CONTENT = "chunk_type IN ('content', 'child')"
_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query("src1_chunk_projection", "SELECT id, book_id, chunk_type FROM chunks WHERE page_number <= 50")
def _(t):
    return t.chunks.filter("page_number <= 50").select("id", "book_id", "chunk_type")


@query("src2_by_book", "SELECT id, chunk_index FROM chunks WHERE book_id = 'src5'")
def _(t):
    return t.chunks.filter("book_id = 'src5'").select("id", "chunk_index")


@query("src2_by_id", "SELECT id, md5(text) AS md5 FROM chunks WHERE id = 42")
def _(t):
    return t.chunks.filter("id = 42").select("id", F.md5(F.col("text").cast("binary")).alias("md5"))


@query("snk1_upsert", "SELECT id, text FROM (SELECT id, text FROM chunks WHERE id NOT IN (SELECT id + 5 FROM chunks WHERE chunk_type = 'child') UNION ALL SELECT id + 5, replace(text, 'e', 'E') FROM chunks WHERE chunk_type = 'child')")
def _(t):
    new = t.chunks.filter("chunk_type = 'child'").select((F.col("id") + 5).alias("id"), F.replace("text", F.lit("e"), F.lit("E")).alias("text"))
    return cs.upsert(t.chunks.select("id", "text"), new)


@query("snk3_delete_except_annotations", "SELECT id, book_id FROM chunks WHERE NOT (book_id = 'src1' AND chunk_type <> 'annotation')")
def _(t):
    return cs.without(t.chunks, (F.col("book_id") == "src1") & (F.col("chunk_type") != "annotation")).select("id", "book_id")


@query("snk3_deleted_counts", "SELECT book_id, count(*) AS removed FROM chunks WHERE chunk_type = 'exchange' GROUP BY book_id")
def _(t):
    gone = F.col("chunk_type") == "exchange"
    before, after = (d.groupBy("book_id").agg(F.count(F.lit(1)).alias(n)) for d, n in ((t.chunks, "b"), (cs.without(t.chunks, gone), "a")))
    return before.join(after, "book_id", "left").select("book_id", (F.col("b") - F.coalesce("a", F.lit(0))).alias("removed")).filter("removed > 0")


@query("snk4_update_metadata", "SELECT id, CASE WHEN book_id = 'src2' THEN 'xx' ELSE language END AS language FROM chunks")
def _(t):
    return cs.update_metadata(t.chunks, "src2", {"language": "xx", "unknown": 1}).select("id", "language")


@query("snk5_pending_external", "SELECT id, CASE WHEN book_id = 'src2' THEN 1 ELSE 0 END AS pending_external FROM chunks")
def _(t):
    return cs.update_metadata(cs.with_defaults(t.chunks.select("id", "book_id", "text")), "src2", {"pending_external": 1}).select("id", "pending_external")


@query("snk6_defaults", "SELECT id, '' AS region, coalesce(page_label, '') AS page_label FROM chunks")
def _(t):
    return cs.with_defaults(t.chunks).select("id", "region", "page_label")


@query("snk2_processed_rows", "SELECT concat('An_Author_A_Title_7_chunk_', CAST(doc_id AS STRING)) AS id, 'An_Author_A_Title_7' AS book_id, doc_id AS chunk_index FROM documents")
def _(t):
    return cs.processed_rows(t.documents.select(F.col("doc_id").alias("index"), "text"), "An Author", "A Title", "7").select("id", "book_id", "chunk_index")


@query("snk7_replace_book", "SELECT id, chunk_type FROM chunks WHERE book_id <> 'src4' OR chunk_type = 'annotation' UNION ALL SELECT -id, 'content' FROM chunks WHERE book_id = 'src4' AND chunk_type = 'parent'")
def _(t):
    new = t.chunks.filter("book_id = 'src4' AND chunk_type = 'parent'").select((-F.col("id")).alias("id"), "book_id", F.lit("content").alias("chunk_type"))
    return cs.replace_book(t.chunks.select("id", "book_id", "chunk_type"), "src4", new).select("id", "chunk_type")


@query("snk9_backup_of_orphans", "SELECT id, book_id FROM chunks WHERE book_id IN ('src7', 'src8')")
def _(t):
    gone = t.spark.createDataFrame([("src7",), ("src8",)], "book_id string")
    return t.chunks.join(gone, "book_id", "left_semi").select("id", "book_id")


@query("snk14_import_annotations", "SELECT 'src1_kindle_' || CAST(i AS STRING) AS id, CASE WHEN highlight <> '' AND note <> '' THEN '[ANNOTATION] ' || highlight || ' | Note: ' || note WHEN highlight <> '' THEN '[ANNOTATION] ' || highlight ELSE '[ANNOTATION_NOTE] ' || note END AS text FROM (SELECT regexp_replace(highlight, '^\\s+|\\s+$', '', 'g') AS highlight, regexp_replace(note, '^\\s+|\\s+$', '', 'g') AS note, row_number() OVER (ORDER BY id) - 1 AS i FROM annotations WHERE book_id = 'src1') WHERE highlight <> '' OR note <> ''")
def _(t):
    own = t.annotations.filter("book_id = 'src1'").select("book_id", F.lit("kindle").alias("source"), "highlight", "note", F.col("id").alias("created"))
    old = t.chunks.select(F.col("id").cast("string").alias("id"), "book_id", "text", "chunk_type", "chunk_index", F.lit("kindle").alias("annotation_source"))
    return cs.import_annotations(old, own).filter("id LIKE 'src1_kindle%'").select("id", "text")


@query("snk15_queue_union", "SELECT id FROM (SELECT id FROM chunks WHERE chunk_type = 'parent' UNION SELECT id + 1 FROM chunks WHERE chunk_type = 'child') ORDER BY id")
def _(t):
    return t.chunks.filter("chunk_type = 'parent'").select("id").union(t.chunks.filter("chunk_type = 'child'").select(F.col("id") + 1)).distinct().orderBy("id")


@query("agg7_indexed_books", "SELECT book_id, arg_min(language, id) AS language, arg_min(tags, id) AS tags, count(*) AS n, max(indexed_at) AS indexed_at FROM chunks GROUP BY book_id")
def _(t):
    return cs.indexed_books(t.chunks)


@query("agg8_index_stats", "SELECT 'chunk_type' AS what, chunk_type AS value, count(*) AS n, count(DISTINCT book_id) AS books FROM chunks GROUP BY chunk_type UNION ALL SELECT 'language', language, count(*), count(DISTINCT book_id) FROM chunks GROUP BY language UNION ALL SELECT 'section_type', section_type, count(*), count(DISTINCT book_id) FROM chunks GROUP BY section_type UNION ALL SELECT 'total', NULL, count(*), count(DISTINCT book_id) FROM chunks")
def _(t):
    return cs.index_stats(t.chunks)


@query("agg10_book_state", f"SELECT book_id, count(*) AS total, count(*) FILTER ({_CONTENT}) AS content_count, bool_or({_CONTENT}) AS has_content, coalesce(arg_min(metadata_hash, id) FILTER ({_CONTENT}), arg_min(metadata_hash, id) FILTER (chunk_type = 'calibre_comment'), '') AS metadata_hash, coalesce(max(nullif(annotation_hash, '')), '') AS annotation_hash FROM chunks GROUP BY book_id")
def _(t):
    return cs.book_state(t.chunks)


@query("agg11_book_hashes", "SELECT book_id, coalesce(arg_max(metadata_hash, id) FILTER (chunk_type IN ('calibre_comment', 'parent', 'child')), arg_min(metadata_hash, id)) AS metadata_hash, bool_or(chunk_type IN ('content', 'child', 'parent')) AS has_content FROM chunks GROUP BY book_id")
def _(t):
    return cs.book_hashes(t.chunks)


_BY_LANG = "(SELECT concat(language, book_id, CAST(id % 40 AS STRING)) AS book_id, chunk_type FROM chunks)"


def _finer(t):
    """Books of fewer chunks, so that some lack some kinds."""
    return t.chunks.withColumn("book_id", F.concat("language", "book_id", (F.col("id") % 40).cast("string")))


@query("agg12_flat_books", f"SELECT book_id FROM {_BY_LANG} GROUP BY book_id HAVING bool_or(chunk_type = 'content') AND NOT bool_or(chunk_type IN ('parent', 'child'))")
def _(t):
    return cs.flat_books(_finer(t))


@query("agg13_stub_only", f"SELECT book_id FROM {_BY_LANG} GROUP BY book_id HAVING bool_or(chunk_type = 'phase1_metadata') AND bool_and(chunk_type IN ('phase1_metadata', 'calibre_comment'))")
def _(t):
    return cs.stub_only_books(_finer(t))


@query("flt15_to_index", f"SELECT DISTINCT book_id FROM {_BY_LANG} WHERE book_id NOT IN (SELECT concat(language, book_id, CAST(id % 40 AS STRING)) FROM chunks WHERE chunk_type IN ('content', 'child', 'parent') AND indexed_at >= '2024-02-01')")
def _(t):
    return cs.to_index(_finer(t).select("book_id").distinct(), _finer(t), "2024-02-01")


_DUPED = "(SELECT id, chunk_type, text, indexed_at FROM chunks UNION ALL SELECT id, chunk_type, upper(text), '2025-01-01' FROM chunks WHERE chunk_type = 'child' UNION ALL SELECT id, chunk_type, text, '2023-01-01' FROM chunks WHERE chunk_type = 'parent')"


def _duped(t):
    own = t.chunks.select("id", "chunk_type", "text", "indexed_at")
    return own.union(own.filter("chunk_type = 'child'").select("id", "chunk_type", F.upper("text"), F.lit("2025-01-01"))).union(own.filter("chunk_type = 'parent'").select("id", "chunk_type", "text", F.lit("2023-01-01")))


@query("dup1_duplicate_ids", f"SELECT chunk_type, id, count(*) AS n, count(DISTINCT md5(text)) AS texts FROM {_DUPED} GROUP BY chunk_type, id HAVING count(*) > 1")
def _(t):
    return cs.duplicate_ids(_duped(t))


@query("dup2_newest_only", f"SELECT id, chunk_type, indexed_at FROM (SELECT *, row_number() OVER (PARTITION BY chunk_type, id ORDER BY indexed_at DESC, md5(text)) AS n FROM {_DUPED}) WHERE n = 1")
def _(t):
    return cs.newest_only(_duped(t)).select("id", "chunk_type", "indexed_at")


@query("dup3_stale_rows", "SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN fresh THEN ts END) OVER (PARTITION BY user_id) AS last FROM (SELECT *, lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 900000000 AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))) WHERE ts < last")
def _(t):
    return cs.stale_rows(t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts").select("event_id", "user_id")


_OPEN = "(regexp_replace(text, '\\s+$', '') <> '' AND NOT regexp_matches(regexp_replace(text, '\\s+$', ''), '[.!?;:''\"»)]$') AND len(list_filter(regexp_split_to_array(string_split(regexp_replace(text, '\\s+$', ''), chr(10) || chr(10))[-1], '\\s+'), lambda x: x <> '')) > 20)"


@query("qlt1_chunk_quality", f"""SELECT book_id, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - tr * 30 - mb * 25 - least(cv, 1.0) * 10 - sr * 15 + CASE WHEN hp THEN 5 ELSE 0 END)), 1) AS score, chunk_count, content_chunks, round(tr, 3) AS truncation_rate, round(mb, 3) AS misplaced_back_rate, round(cv, 3) AS cv, round(sr, 3) AS short_rate, hp AS has_pages FROM
 (SELECT book_id, count(*) AS chunk_count, greatest(count(*) FILTER (c), 1) AS content_chunks, count(*) FILTER (c AND {_OPEN}) / greatest(count(*) FILTER (c), 1)::DOUBLE AS tr, CASE WHEN count(*) FILTER (c) > 0 THEN count(*) FILTER (chunk_type <> 'parent' AND section_type = 'back_matter' AND chunk_index < mx * 0.9::DOUBLE) / greatest(count(*) FILTER (c), 1)::DOUBLE ELSE 0 END AS mb,
 CASE WHEN count(*) FILTER (c) = 0 THEN 1.0 ELSE coalesce(stddev_samp(w) FILTER (c) / nullif(avg(w) FILTER (c), 0), 0) END AS cv, count(*) FILTER (c AND w < 50) / greatest(count(*) FILTER (c), 1)::DOUBLE AS sr, bool_or(c AND (page_number > 0 OR page_label <> '')) AS hp
 FROM (SELECT *, {_CONTENT} AS c, {_WORDS} AS w, max(CASE WHEN chunk_type <> 'parent' THEN chunk_index END) OVER (PARTITION BY book_id) AS mx FROM chunks) GROUP BY book_id)""")
def _(t):
    return cs.quality_score(t.chunks)


@query("qlt2_best_format", "SELECT title AS book, coalesce(arg_max(format, score * 10 - CASE format WHEN 'PDF' THEN 1 WHEN 'EPUB' THEN 2 ELSE 3 END), arg_min(format, CASE format WHEN 'PDF' THEN 1 WHEN 'EPUB' THEN 2 ELSE 3 END)) AS format FROM (SELECT title, format, CASE WHEN length(title) % 2 = 0 THEN rating END AS score FROM books) GROUP BY title")
def _(t):
    return cs.best_format(t.books.select(F.col("title").alias("book"), "format", F.when(F.length("title") % 2 == 0, F.col("rating")).alias("score")))


@query("qlt3_needs_ocr", f"SELECT book_id, CASE WHEN pages BETWEEN 1 AND 5 THEN false WHEN n = 0 THEN true ELSE pages >= 3 AND words > 0 AND words / pages::DOUBLE < 150 AND n / pages::DOUBLE < 0.4 END AS needs_ocr FROM (SELECT concat(book_id, CAST(id % 40 AS STRING)) AS book_id, count(*) AS n, sum({_WORDS}) AS words, max(page_number) AS pages FROM chunks GROUP BY 1)")
def _(t):
    g = t.chunks.groupBy(F.concat("book_id", (F.col("id") % 40).cast("string")).alias("book_id")).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(T.word_count(F.col("text"))).alias("total_words"), F.max("page_number").alias("total_pages"))
    return cs.needs_ocr(g.withColumns({"format": F.lit("pdf"), "pages_with_text": F.col("n_chunks")})).select("book_id", "needs_ocr")


@query("qlt4_scanned_books", f"SELECT b.book_id, coalesce(words, 0) AS words, round(coalesce(words, 0) / greatest(coalesce(pages, 0), 1)::DOUBLE, 3) AS words_per_page FROM (SELECT DISTINCT concat(language, book_id) AS book_id, language AS tags FROM chunks WHERE language <> 'es') b LEFT JOIN (SELECT concat(language, book_id) AS book_id, sum({_WORDS})::BIGINT AS words, count(DISTINCT page_number) AS pages FROM chunks WHERE {_CONTENT} GROUP BY 1) s ON s.book_id = b.book_id WHERE coalesce(words, 0) = 0 OR coalesce(words, 0) / greatest(coalesce(pages, 0), 1)::DOUBLE < 350")
def _(t):
    own = t.chunks.withColumn("book_id", F.concat("language", "book_id"))
    return cs.scanned_books(own, own.select("book_id", F.col("language").alias("tags")).distinct(), 350, ["es"]).select("book_id", "words", "words_per_page")


@query("qlt5_missing_labels", "SELECT book_id, avg(CASE WHEN page_label = '' OR page_label = CAST(page_number AS STRING) THEN 1 ELSE 0 END) AS share, count(*) AS n FROM (SELECT concat(book_id, CAST(id % 4 AS STRING)) AS book_id, page_label, page_number FROM chunks) GROUP BY book_id HAVING share > 0.9")
def _(t):
    return cs.missing_labels(t.chunks.withColumn("book_id", F.concat("book_id", (F.col("id") % 4).cast("string"))))


@query("qlt6_inspection", f"SELECT book_id, count(*) AS n, min(w) AS least, max(w) AS most, median(w) AS median, round(avg(w), 6) AS mean, round(coalesce(stddev_samp(w), 0), 4) AS stdev, round(100 * avg(CASE WHEN page_label <> '' THEN 1 ELSE 0 END), 2) AS labels_pct, round(100 * avg(CASE WHEN parent_id IS NOT NULL THEN 1 ELSE 0 END), 2) AS parents_pct FROM (SELECT *, {_WORDS} AS w FROM chunks) GROUP BY book_id")
def _(t):
    return cs.inspect(t.chunks)


@query("qlt6_boundaries", f"SELECT id, substr(text, 1, 40) AS head, right(text, 40) AS tail, {_OPEN} AS open FROM chunks")
def _(t):
    return cs.boundaries(t.chunks)


_TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


@query("qlt7_text_coverage", f"""SELECT book, page, round(len(list_filter(w, lambda x: contains(hay, x))) / len(w)::DOUBLE, 4) AS share, len(list_filter(w, lambda x: contains(hay, x))) / len(w)::DOUBLE >= 0.5 AS present FROM
 (SELECT id AS book, page_number AS page, hay, list_transform(range(0, greatest(len(t) // 8 - 1, 0) + 1), lambda i: array_to_string(t[i * 8 + 1:i * 8 + 8], ' ')) AS w FROM (SELECT id, page_number, {_TOKENS.format('text')} AS t, array_to_string({_TOKENS.format('substr(text, 1, length(text) // 2)')}, ' ') AS hay FROM chunks))""")
def _(t):
    pages = t.chunks.select(F.col("id").alias("book"), F.col("page_number").alias("page"), "text")
    return cs.text_coverage(pages, t.chunks.select(F.col("id").alias("book"), F.expr("substr(text, 1, length(text) div 2)").alias("text")))


@query("qlt8_rename_tag", "SELECT id, array_to_string(list_transform(string_split(tags, ','), lambda x: CASE WHEN trim(x) = 'de' THEN 'german' ELSE trim(x) END), ', ') AS tags FROM chunks")
def _(t):
    return t.chunks.select("id", cs.rename_tag(F.col("tags"), "de", "german").alias("tags"))


@query("qlt9_delete_tagged", "SELECT id FROM chunks WHERE book_id NOT IN (SELECT book_id FROM chunks WHERE contains(tags, 'src3'))")
def _(t):
    tagged = t.chunks.filter(F.col("tags").contains("src3")).select("book_id").distinct()
    return t.chunks.join(tagged, "book_id", "left_anti").select("id")


def _vote(lang: str) -> str:
    own = ", ".join(f"'{w}'" for w in STOP_WORDS[lang])
    return f"len(list_filter(t, lambda x: list_contains([{own}], x)))"


_SAID = f"(SELECT *, {_TOKENS.format('text')} AS t FROM documents)"


@query("lng1_language_votes", f"""SELECT doc_id, lang, CASE WHEN length(text) >= 50 AND total > 0 AND best >= total * 0.5::DOUBLE THEN CASE best WHEN fr THEN 'fr' WHEN es THEN 'es' WHEN en THEN 'en' ELSE 'de' END END AS found FROM
 (SELECT *, en + de + fr + es AS total, greatest(en, de, fr, es) AS best FROM (SELECT doc_id, lang, text, {", ".join(f"{_vote(x)} AS {x}" for x in ("en", "de", "fr", "es"))} FROM {_SAID}))""")
def _(t):
    return t.documents.select("doc_id", "lang", T.detect_language(F.col("text"), share=0.5).alias("found"))


@query("lng2_language_candidates", f"""SELECT doc_id, place, lang, round(n / greatest(total, 1)::DOUBLE, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang DESC) - 1 AS place, sum(n) OVER (PARTITION BY doc_id) AS total FROM
 ({" UNION ALL ".join(f"SELECT doc_id, '{x}' AS lang, {_vote(x)} AS n FROM {_SAID}" for x in STOP_WORDS)})) WHERE place < 3""")
def _(t):
    votes = t.documents.select("doc_id", F.posexplode(T.language_votes(F.col("text"))).alias("place", "v"))
    return votes.select("doc_id", F.col("place").cast("long").alias("place"), "v.lang", F.round("v.share", 6).alias("share"))
