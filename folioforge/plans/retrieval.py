"""Queries of the retrieval operators and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters as flt
from ..operators import retrieval as ret
from .registry import ORACLES, query
from .streams import shared_folder
from .views import Tables

QUERY, PHRASE, KEYWORDS = "tion ing stand", "of the", ("the", "tion", "nation")
_TERMS = ret.query_terms(QUERY)


def query_vector(t: Tables) -> list[float]:
    """The vector of embedding 0: one row."""
    row = t.embeddings.filter("vec_id = 0").select("embedding").first()
    return list(row[0])


def _bm25_sql(where: str = "true", k: int = 10, terms=_TERMS) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END)::DOUBLE AS df{i}" for i in range(len(terms)))
    parts = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1.0::DOUBLE + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / av)) ELSE 0.0 END" for i in range(len(terms)))
    return f"""SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(0.0::DOUBLE + {parts}, 6) AS score FROM
 (SELECT *, len(t) AS dl, {tf} FROM (SELECT *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM chunks)) p,
 (SELECT count(*)::DOUBLE AS n, avg(dl) AS av, {df} FROM (SELECT len(t) AS dl, {tf} FROM (SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM chunks))) s WHERE {where})
 WHERE score > 0 ORDER BY score DESC, id LIMIT {k}"""


_Q0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


def _vector_sql(where: str = "true", k: int = 10) -> str:
    return f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT v.id, round(list_cosine_similarity(CAST(vector AS DOUBLE[]), {_Q0}), 6) AS score FROM chunk_vectors v JOIN chunks c ON c.id = v.id WHERE {where}) ORDER BY score DESC, id LIMIT {k}"


def _hybrid_sql(where: str = "true", k: int = 10) -> str:
    return f"""SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT coalesce(a.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 6) AS score
 FROM ({_vector_sql(where, k)}) a FULL JOIN ({_bm25_sql(where, k)}) b ON a.id = b.id) ORDER BY score DESC, id LIMIT {k}"""


@query("ret1_vector_search", _vector_sql())
def _(t):
    return ret.vector_search(t.chunk_vectors, query_vector(t), 10)


@query("ret2_keyword_bm25", _bm25_sql())
def _(t):
    return ret.ranked(ret.bm25(t.chunks, QUERY), 10)


@query("ret2_postings", """SELECT term, id, count(*) AS tf, max(dl)::INT AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM chunks)) GROUP BY term, id""")
def _(t):
    return ret.postings(t.chunks)


@query("ret2_stored_index", _bm25_sql())
def _(t):
    """The same search by a stored index of postings: built in the shared folder, then only the query's terms are read."""
    return ret.TextIndex.build(t.chunks, shared_folder(t)).top(QUERY, 10)


@query("ret21_text_index_upkeep", _bm25_sql().replace("FROM chunks)", "FROM (SELECT * FROM chunks WHERE id % 97 <> 3))"))
def _(t):
    """An index that was built of what was there, some of it in other words and some of it not yet; then new, changed and deleted chunks come in, and
    it is opened anew. The result is that of a scan of what there is now."""
    path = shared_folder(t)
    before = t.chunks.filter("id % 97 <> 1").withColumn("text", F.when(F.col("id") % 97 == 2, F.reverse("text")).otherwise(F.col("text")))
    index = ret.TextIndex.build(before, path)
    index.add(t.chunks.filter("id % 97 IN (1, 2)"))
    index.drop(t.chunks.filter("id % 97 = 3").select("id"))
    return ret.TextIndex.open(t.spark, path).top(QUERY, 10)


@query("ret3_hybrid_search", _hybrid_sql())
def _(t):
    """Vector and keyword lists fused by reciprocal ranks."""
    return ret.hybrid(t.chunks, t.chunk_vectors, QUERY, query_vector(t), 10)


_CONTENT = "section_type IN ('main_content', '') AND chunk_type IN ('content', 'child')"
_BOOSTED = f"""SELECT h.id, c.book_id, c.text, c.tags, c.chunk_type, round(h.score * CASE WHEN chunk_type = 'calibre_comment' THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN list_has_any(string_split(lower(tags), ', '), ['tion', 'ing', 'stand']) THEN 1.15::DOUBLE ELSE 1 END, 6) AS score
 FROM ({_hybrid_sql(_CONTENT, 50)}) h JOIN chunks c ON c.id = h.id"""


@query("ret4_search", f"""SELECT id, book_id, score, row_number() OVER (ORDER BY r, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY r, id) AS n FROM
 (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({_BOOSTED})) WHERE length(text) >= 100) WHERE n <= 2 ORDER BY r, id LIMIT 10""")
def _(t):
    found = ret.search(t.chunks, t.chunk_vectors, QUERY, query_vector(t), 10, where=flt.chunk_filter(section="main", chunk_type="content"))
    return found.select("id", "book_id", "score", "rank")


@query("ret3_hybrid_stored", _hybrid_sql())
def _(t):
    """As ret3_hybrid_search, the words' list read from a stored index: the same rows."""
    return ret.hybrid(t.chunks, t.chunk_vectors, QUERY, query_vector(t), 10, index=ret.TextIndex.build(t.chunks, shared_folder(t)))


@query("ret4_search_stored")
def _(t):
    """As ret4_search by a stored index, with its filters: they reach the index as the ids that may be found."""
    index = ret.TextIndex.build(t.chunks, shared_folder(t))
    found = ret.search(t.chunks, t.chunk_vectors, QUERY, query_vector(t), 10, where=flt.chunk_filter(section="main", chunk_type="content"), index=index)
    return found.select("id", "book_id", "score", "rank")


ORACLES["ret4_search_stored"] = ORACLES["ret4_search"]


_NORM = "regexp_replace(lower(text), '\\s+', ' ', 'g')"


@query("ret5_exact_phrase", f"""SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank, least(score / 10, 1.0) AS similarity FROM (SELECT id, CAST(floor((length({_NORM}) - length(replace({_NORM}, '{PHRASE}', ''))) / {len(PHRASE)}) AS DOUBLE) AS score FROM chunks) WHERE score > 0 ORDER BY score DESC, id LIMIT 10""")
def _(t):
    return ret.exact_phrase(t.chunks, PHRASE, 10)


@query("ret6_hybrid_boosts", f"""SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT h.id, round(h.score * CASE WHEN chunk_type = 'calibre_comment' THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN list_has_any(string_split(lower(tags), ', '), ['en', 'tion']) THEN 1.15::DOUBLE ELSE 1 END, 6) AS score FROM ({_vector_sql(k=40)}) h JOIN chunks c ON c.id = h.id)""")
def _(t):
    found = ret.vector_search(t.chunk_vectors, query_vector(t), 40)
    return ret.boost(found.join(t.chunks.select("id", "chunk_type", "tags"), "id"), "en tion").select("id", "score", "rank")


@query("ret7_diversify", f"""SELECT id, book_id, row_number() OVER (ORDER BY r, id) AS rank FROM (SELECT h.id, book_id, h.rank AS r, row_number() OVER (PARTITION BY book_id ORDER BY h.rank, h.id) AS n FROM ({_vector_sql(k=100)}) h JOIN chunks c ON c.id = h.id) WHERE n <= 2 ORDER BY r, id LIMIT 20""")
def _(t):
    found = ret.vector_search(t.chunk_vectors, query_vector(t), 100)
    return ret.diversify(found.join(t.chunks.select("id", "book_id"), "id"), 2, 20).select("id", "book_id", "rank")


_SHARE = "round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')), ['tion', 'ing', 'stand'])) / 3.0::DOUBLE, 6)"


@query("ret8_rerank", f"SELECT id, rerank_score, row_number() OVER (ORDER BY rerank_score DESC, r, id) AS rank FROM (SELECT h.id, h.rank AS r, {_SHARE} AS rerank_score FROM ({_vector_sql(k=30)}) h JOIN chunks c ON c.id = h.id) ORDER BY rerank_score DESC, r, id LIMIT 10")
def _(t):
    found = ret.vector_search(t.chunk_vectors, query_vector(t), 30).join(t.chunks.select("id", "text"), "id")
    return ret.rerank(found, QUERY, 10).select("id", "rerank_score", "rank")


_FOUND30 = f"""(SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT h.id, c.book_id, c.text, c.parent_id, c.page_label, c.page_number, round(h.score * CASE WHEN chunk_type = 'calibre_comment' THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN list_has_any(string_split(lower(tags), ', '), ['tion', 'ing', 'stand']) THEN 1.15::DOUBLE ELSE 1 END, 6) AS score FROM ({{}}) h JOIN chunks c ON c.id = h.id))"""


@query("ret9_service_search", f"""SELECT id, book_id, rerank_score, row_number() OVER (ORDER BY r2, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY r2, id) AS n FROM (SELECT *, row_number() OVER (ORDER BY rerank_score DESC, r, id) AS r2 FROM
 (SELECT id, book_id, r, {_SHARE} AS rerank_score FROM {_FOUND30.format(_hybrid_sql("true", 30))} WHERE length(text) >= 100) ORDER BY rerank_score DESC, r, id LIMIT 30)) WHERE n <= 2 ORDER BY r2, id LIMIT 10""")
def _(t):
    return ret.service_search(t.chunks, t.chunk_vectors, QUERY, query_vector(t)).select("id", "book_id", "rerank_score", "rank")


def _kw(word: str) -> str:
    return f"CASE WHEN regexp_matches(lower(concat_ws(' ', text, tags)), '(^|[^\\p{{L}}\\p{{N}}_]){word}([^\\p{{L}}\\p{{N}}_]|$)') THEN 1 ELSE 0 END"


_MATCHES = " + ".join(_kw(k) for k in KEYWORDS)


@query("ret10_interest_boost", f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT h.id, round(h.score * (1 + 0.15::DOUBLE * ({_MATCHES})), 6) AS score FROM ({_vector_sql(k=50)}) h JOIN chunks c ON c.id = h.id)")
def _(t):
    found = ret.vector_search(t.chunk_vectors, query_vector(t), 50).join(t.chunks.select("id", "text", "tags"), "id")
    return ret.interest_boost(found, KEYWORDS).select("id", "score", "rank")


_PER_LANG = " UNION ALL ".join(f"SELECT *, '{x}' AS source FROM ({_vector_sql(f"language = '{x}'", 10)})" for x in ("de", "en", "es", "fr"))


def _per_language(t, k=10):
    own = [ret.vector_search(t.chunk_vectors.join(t.chunks.filter(F.col("language") == x).select("id"), "id", "left_semi"), query_vector(t), k).withColumn("source", F.lit(x)) for x in ("de", "en", "es", "fr")]
    return own[0].unionByName(own[1]).unionByName(own[2]).unionByName(own[3])


@query("ret12_merge_sources_rrf", f"SELECT id, source, row_number() OVER (ORDER BY m DESC, source, rank, id) AS rank FROM (SELECT *, 1.0::DOUBLE / (60 + rank) AS m FROM ({_PER_LANG})) ORDER BY m DESC, source, rank, id LIMIT 12")
def _(t):
    return ret.merge_sources(_per_language(t), 12).select("id", "source", "rank")


@query("ret12_merge_sources_rerank", f"SELECT id, source, row_number() OVER (ORDER BY score DESC, source, rank, id) AS rank FROM ({_PER_LANG}) ORDER BY score DESC, source, rank, id LIMIT 12")
def _(t):
    return ret.merge_sources(_per_language(t).withColumn("rerank_score", F.col("score")), 12).select("id", "source", "rank")


@query("ret13_multi_source_counts", f"SELECT source, count(*) AS n, max(score) AS best FROM ({_PER_LANG}) GROUP BY source")
def _(t):
    return _per_language(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


@query("ret14_search_annotations_and_comments", f"SELECT id, score, row_number() OVER (ORDER BY r, id) AS rank FROM (SELECT h.id, h.score, h.rank AS r, row_number() OVER (PARTITION BY book_id ORDER BY h.rank, h.id) AS n FROM ({_vector_sql("chunk_type IN ('annotation', 'calibre_comment')", 150)}) h JOIN chunks c ON c.id = h.id WHERE length(text) >= 100) WHERE n <= 5 ORDER BY r, id LIMIT 30")
def _(t):
    return ret.search(t.chunks, t.chunk_vectors, QUERY, query_vector(t), 30, "semantic", flt.chunk_filter(chunk_type="annotations_and_comments"), per_book=5).select("id", "score", "rank")


@query("ret15_search_annotation_text", "SELECT id, highlight, note FROM annotations WHERE contains(lower(concat_ws(' ', highlight, note)), 'the')")
def _(t):
    return ret.search_text(t.annotations, "The").select("id", "highlight", "note")


@query("ret16_expand_context", "SELECT a.id, md5(coalesce(nullif(p.text, ''), a.text)) AS context_md5 FROM chunks a LEFT JOIN chunks p ON p.id = a.parent_id")
def _(t):
    return ret.expand_context(t.chunks, t.chunks).select("id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


_AT = "CASE WHEN instr(lower(text), 'ing than') > 0 THEN instr(lower(text), 'ing than') WHEN length(regexp_extract(lower(text), '^((?:.|\\n)*?)ing\\s+than')) > 0 THEN length(regexp_extract(lower(text), '^((?:.|\\n)*?)ing\\s+than', 1)) + 1 ELSE least(nullif(instr(lower(text), 'ing'), 0), nullif(instr(lower(text), 'than'), 0)) END - 1"


@query("ret17_snippet", f"""SELECT id, CASE WHEN a IS NULL THEN substr(text, 1, 300) || CASE WHEN length(text) > 300 THEN '...' ELSE '' END
 ELSE CASE WHEN a > 200 THEN '...' ELSE '' END || substr(text, greatest(a - 200, 0) + 1, least(a + 200, length(text)) - greatest(a - 200, 0)) || CASE WHEN a + 200 < length(text) THEN '...' ELSE '' END END AS snippet FROM (SELECT id, text, {_AT} AS a FROM chunks)""")
def _(t):
    return t.chunks.select("id", T.snippet(F.col("text"), "ing than").alias("snippet"))


@query("ret18_prompt_rows", "SELECT id, '<document index=\"' || CAST(id AS STRING) || '\">' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || '</document>' AS document, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS tokens FROM chunks")
def _(t):
    body = F.concat(F.lit('<document index="'), F.col("id").cast("string"), F.lit('">'), T.escape_xml(F.col("text")), F.lit("</document>"))
    return t.chunks.select("id", body.alias("document"), T.word_count(F.col("text")).alias("tokens"))


def _esc(x: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{char}', '{entity}')"
    return x


@query("ret18_prompt", f"""SELECT '<documents>' || chr(10) || string_agg('<document index="' || CAST(rank AS STRING) || '" title="' || {_esc("book_id")} || '" page="' || {_esc("coalesce(nullif(page_label, ''), CAST(nullif(page_number, 0) AS STRING), '')")} || '">' || {_esc("context")} || '</document>', chr(10) ORDER BY rank) || chr(10) || '</documents>' || chr(10) || chr(10) || 'What is said?' AS prompt,
 CAST(sum(len(list_filter(regexp_split_to_array(context, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS tokens FROM (SELECT f.*, coalesce(nullif(p.text, ''), f.text) AS context FROM (SELECT *, row_number() OVER (ORDER BY r, id) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY r, id) AS n FROM {_FOUND30.format(_hybrid_sql("true", 25))} WHERE length(text) >= 100) WHERE n <= 2 ORDER BY r, id LIMIT 5) f LEFT JOIN chunks p ON p.id = f.parent_id)""")
def _(t):
    """The whole prompt of a search: a row."""
    found = ret.search(t.chunks, t.chunk_vectors, QUERY, query_vector(t), 5)
    return ret.prompt(flt.with_citation(ret.expand_context(found, t.chunks)), "What is said?")


@query("ret19_highlight_terms", "SELECT id, regexp_replace(regexp_replace(text, '(that)', '**\\1**', 'gi'), '(of)', '**\\1**', 'gi') AS marked FROM chunks")
def _(t):
    return t.chunks.select("id", T.highlight_terms(F.col("text"), ["of", "that"]).alias("marked"))


@query("ret22_score_kinds", "SELECT 'semantic' AS score_type, count(*) AS n, round(sum(score), 4) AS total FROM (" + _vector_sql() + ") UNION ALL SELECT 'keyword', count(*), round(sum(score), 4) FROM (" + _bm25_sql() + ")")
def _(t):
    own = ret.vector_search(t.chunk_vectors, query_vector(t), 10).withColumn("score_type", F.lit("semantic")).unionByName(ret.ranked(ret.bm25(t.chunks, QUERY), 10).withColumn("score_type", F.lit("keyword")))
    return own.groupBy("score_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


# --- filters

_FILTERS = {
    "flt1_book": (dict(book_id="src3"), "book_id = 'src3'"),
    "flt1_section_main": (dict(section="main"), "section_type IN ('main_content', '')"),
    "flt1_chunk_type_content": (dict(chunk_type="content"), "chunk_type IN ('content', 'child')"),
    "flt1_annotations_and_comments": (dict(chunk_type="annotations_and_comments"), "chunk_type IN ('annotation', 'calibre_comment')"),
    "flt1_conjunction": (dict(section="main", chunk_type="content", language="en"), _CONTENT + " AND language = 'en'"),
}
for _name, (_args, _where) in _FILTERS.items():
    query(_name, f"SELECT id, book_id, section_type, chunk_type, language FROM chunks WHERE {_where}")(lambda t, a=_args: t.chunks.filter(flt.chunk_filter(**a)).select("id", "book_id", "section_type", "chunk_type", "language"))


@query("flt1_source_id", "SELECT id, source_id, calibre_id FROM (SELECT id, CAST(id % 50 AS STRING) AS source_id, id % 60 AS calibre_id FROM chunks) WHERE source_id = '7' OR calibre_id = 7")
def _(t):
    own = t.chunks.select("id", (F.col("id") % 50).cast("string").alias("source_id"), (F.col("id") % 60).alias("calibre_id"))
    return own.filter(flt.chunk_filter(source_id="7"))


@query("flt4_tag_filter_all", "SELECT id, tags FROM chunks WHERE list_contains(list_transform(string_split(tags, ','), lambda x: lower(trim(x))), 'en') AND list_contains(list_transform(string_split(tags, ','), lambda x: lower(trim(x))), 'src2')")
def _(t):
    return t.chunks.filter(flt.has_all_tags(F.col("tags"), ["EN ", "Src2"])).select("id", "tags")


@query("flt5_min_chunk_length", "SELECT id, length(text)::INT AS n FROM chunks WHERE length(text) >= 100")
def _(t):
    return t.chunks.filter(flt.long_enough(F.col("text"))).select("id", F.length("text").alias("n"))


@query("flt6_min_similarity", f"SELECT id, score AS similarity FROM ({_vector_sql(k=100)}) WHERE score >= 0.2")
def _(t):
    return flt.min_similarity(ret.vector_search(t.chunk_vectors, query_vector(t), 100).withColumn("similarity", F.col("score")), 0.2, "semantic").select("id", "similarity")


@query("flt7_min_rerank", "SELECT id, rerank_score FROM (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 10 AS DOUBLE) / 10 END AS rerank_score FROM chunks) WHERE rerank_score IS NULL OR rerank_score >= 0.5")
def _(t):
    score = F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 10).cast("double") / 10)
    return flt.min_rerank(t.chunks.select("id", score.alias("rerank_score")), 0.5)


@query("flt8_keyword_word_boundary", "SELECT id FROM chunks WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(tion|über)([^\\p{L}\\p{N}_]|$)')")
def _(t):
    return t.chunks.filter(T.has_keyword(F.col("text"), ["Tion", "über"])).select("id")


def _toc_sql() -> str:
    from ..functions.words import TOC_MARKERS

    keys = "|".join(TOC_MARKERS)
    own = "(SELECT id, pos_frac, spine_index, regexp_replace(highlight, '^\\s+|\\s+$', '', 'g') AS h, regexp_replace(note, '^\\s+|\\s+$', '', 'g') AS n FROM annotations)"
    return f"SELECT id, CASE WHEN length(h) < 20 AND n = '' THEN 'too_short' WHEN length(h) < 50 AND regexp_matches(lower(h || ' ' || n), '(^|[^\\p{{L}}\\p{{N}}_])({keys})([^\\p{{L}}\\p{{N}}_]|$)') THEN 'toc_markers' WHEN pos_frac * 100 < 5.0 THEN 'first_percent' WHEN spine_index = 0 THEN 'toc_markers' END AS reason FROM {own}"


@query("flt9_annotation_noise", _toc_sql())
def _(t):
    return t.annotations.select("id", T.toc_marker_reason(F.col("highlight"), F.col("note"), F.col("pos_frac"), F.col("spine_index")).alias("reason"))


@query("flt9_annotation_noise_counts", f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM ({_toc_sql()}) GROUP BY 1")
def _(t):
    reason = T.toc_marker_reason(F.col("highlight"), F.col("note"), F.col("pos_frac"), F.col("spine_index"))
    return t.annotations.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("flt10_excluded_tags", "SELECT id FROM chunks WHERE NOT list_has_any(list_transform(string_split(tags, ','), lambda x: lower(trim(x))), ['de', 'src1'])")
def _(t):
    return t.chunks.filter(~flt.has_any_tag(F.col("tags"), ["DE", "src1"])).select("id")


@query("flt11_priority", "SELECT id, contains(lower(title), 'a') AND contains(lower(title), 'red') OR contains(lower(title), 'blue') OR lower(tag) = 'promo' AS priority FROM (SELECT id, title, tag FROM books)")
def _(t):
    title = F.col("title")
    own = flt.priority_match(title, F.lit(""), F.col("tag"), titles=["blue"], exact_tags=["promo"])
    return t.books.select("id", (own | (flt.priority_match(title, F.lit(""), F.lit(""), titles=["a"]) & flt.priority_match(title, F.lit(""), F.lit(""), titles=["red"]))).alias("priority"))


@query("flt12_rating", "SELECT id, rating FROM books WHERE rating >= 6")
def _(t):
    return t.books.filter(flt.rating_filter(F.col("rating"), least=3)).select("id", "rating")


@query("flt12_unrated", "SELECT id FROM books WHERE rating IS NULL OR rating = 0")
def _(t):
    return t.books.filter(flt.rating_filter(F.col("rating"), exact=0)).select("id")


@query("flt13_author_fragment_not_tag", "SELECT id FROM books b WHERE EXISTS (SELECT 1 FROM books_authors l JOIN authors a ON a.id = l.author WHERE l.book = b.id AND a.name LIKE '%1%') AND NOT EXISTS (SELECT 1 FROM books c WHERE c.id = b.id AND c.tag LIKE '%A%')")
def _(t):
    named = t.books_authors.join(t.authors.filter(F.col("name").contains("1")), F.col("author") == F.col("id")).select("book")
    return t.books.select("id").join(named, F.col("id") == F.col("book"), "left_semi").join(t.books.filter(F.col("tag").contains("A")).select(F.col("id").alias("x")), F.col("id") == F.col("x"), "left_anti")


@query("flt14_stop_words", """SELECT id, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE q END AS clean FROM (SELECT id, q, list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '' AND NOT list_contains(['a','an','and','are','as','at','be','by','for','from','has','he','in','is','it','its','of','on','that','the','to','was','will','with','or','but','not','this','these'],
 regexp_replace(lower(w), '^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$', '', 'g'))) AS k FROM (SELECT id, regexp_replace(text, '\\s+', ' ', 'g') AS q FROM chunks))""")
def _(t):
    q = F.regexp_replace("text", r"\s+", " ")
    return t.chunks.select("id", T.without_stop_words(q, "en").alias("clean"))


@query("flt16_citation", "SELECT id, coalesce(nullif(page_label, ''), CAST(nullif(page_number, 0) AS STRING)) AS citation, nullif(page_label, '') IS NULL AND page_number <> 0 AS is_page FROM chunks")
def _(t):
    return flt.with_citation(t.chunks).select("id", "citation", "is_page")


@query("flt17_selection", "SELECT id, list_sort(list_distinct(list_filter(flatten([[0, 3], range((id % 7)::INT, (id % 7)::INT + 4), [15]]), lambda i: i >= 0 AND i < id % 20))) AS picked FROM chunks", lists=("picked",))
def _(t):
    a = (F.col("id") % 7).cast("int")
    said = F.concat(F.lit("0,3, "), a.cast("string"), F.lit("-"), (a + 3).cast("string"), F.lit(",15,"))
    return t.chunks.select("id", F.transform(T.selection(said, (F.col("id") % 20).cast("int")), lambda i: i.cast("long")).alias("picked"))
