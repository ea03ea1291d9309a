"""Queries of catalogue scans, analytics, joins, bibliography and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalogue as cat
from .registry import query

# shared parts of the checks
_NAMES = "(SELECT l.book, list(a.name ORDER BY a.id) AS authors FROM books_authors l JOIN authors a ON a.id = l.author GROUP BY l.book)"
_FULL = f"(SELECT b.id, b.title, coalesce(n.authors, []::VARCHAR[]) AS authors, year(pubdate) AS year, b.publisher, CASE WHEN b.id % 4 = 0 THEN concat('97831', CAST(b.id % 50 AS STRING)) END AS isbn, [b.tag] AS tags, [b.format] AS formats FROM books b LEFT JOIN {_NAMES} n ON n.book = b.id)"


def full_books(t):
    names = cat.ordered_names(t.books_authors, t.authors, "book", "author", "authors")
    b = cat.with_lists(t.books, {"authors": names})
    isbn = F.when(F.col("id") % 4 == 0, F.concat(F.lit("97831"), (F.col("id") % 50).cast("string")))
    return b.select("id", "title", "authors", F.year("pubdate").alias("year"), "publisher", isbn.alias("isbn"), F.array("tag").alias("tags"), F.array("format").alias("formats"))


@query("src3_catalogue_scan", f"SELECT id, title, array_to_string(authors, ' & ') AS author, publisher, isbn FROM {_FULL} WHERE list_contains(tags, tags[1])")
def _(t):
    return full_books(t).select("id", "title", F.array_join("authors", " & ").alias("author"), "publisher", "isbn")


@query("src3_tag_filter", f"SELECT id, title FROM {_FULL} WHERE list_contains(tags, (SELECT max(tag) FROM books))")
def _(t):
    tag = t.books.agg(F.max("tag")).first()[0]
    own = t.books.select(F.col("id").alias("book"), F.array("tag").alias("tags"))
    return cat.list_documents(t.books.select("id", "title"), {"tags": own}, tag=tag).select("id", "title")


@query("src4_attribute_pivot", "SELECT id AS item, title, publisher AS place, format AS kind FROM books")
def _(t):
    long = t.books.selectExpr("id AS item", "stack(3, 'title', title, 'place', publisher, 'kind', format) AS (field, value)")
    return cat.pivot_attributes(long, ["title", "place", "kind"])


@query("src5_collection_subtree", "WITH RECURSIVE tree AS (SELECT p_partkey AS id, concat('c', CAST(p_partkey AS STRING)) AS name, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part), t(id) AS (SELECT id FROM tree WHERE name = 'c3' UNION ALL SELECT c.id FROM tree c JOIN t ON c.parent = t.id) SELECT DISTINCT id FROM t")
def _(t):
    tree = t.sql("SELECT p_partkey AS id, concat('c', CAST(p_partkey AS STRING)) AS name, CASE WHEN p_partkey > 1 THEN p_partkey div 2 END AS parent FROM part")
    return cat.subtree(t.spark, tree, "c3")


@query("src20_brief_listing", f"SELECT id, title, array_to_string(authors, ' & ') AS author, array_to_string(string_split(concat('Lib/', title, '/', CAST(id AS STRING), '/x.epub'), '/')[1:2], '/') AS folder FROM {_FULL}")
def _(t):
    path = F.concat(F.lit("Lib/"), "title", F.lit("/"), F.col("id").cast("string"), F.lit("/x.epub"))
    return full_books(t).select("id", "title", F.array_join("authors", " & ").alias("author"), F.substring_index(path, "/", 2).alias("folder"))


@query("src23_creators_with_fallback", f"SELECT id, CASE WHEN len(authors) > 0 THEN authors ELSE [publisher] END AS creators FROM {_FULL}", lists=("creators",))
def _(t):
    return full_books(t).select("id", F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.array("publisher")).alias("creators"))


# --- joins

@query("jon1_links", "SELECT b.id, b.title, a.name FROM books b JOIN books_authors l ON l.book = b.id JOIN authors a ON a.id = l.author")
def _(t):
    return t.books.join(t.books_authors, F.col("id") == F.col("book")).select("id", "title", "author").join(t.authors.select(F.col("id").alias("author"), "name"), "author").select("id", "title", "name")


@query("jon2_left_enrichment", "SELECT b.id, coalesce(b.rating, 0) AS rating, coalesce(n.n, 0) AS n_authors FROM books b LEFT JOIN (SELECT book, count(*) AS n FROM books_authors GROUP BY book) n ON n.book = b.id")
def _(t):
    n = t.books_authors.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    return t.books.join(n, F.col("id") == F.col("book"), "left").select("id", F.coalesce("rating", F.lit(0)).alias("rating"), F.coalesce("n", F.lit(0)).cast("long").alias("n_authors"))


_IDENT = "(SELECT id AS book, 'isbn' AS type, concat(publisher, title) AS val FROM books)"


@query("jon3_identifier_pairs", f"SELECT a.book AS book1, b.book AS book2, a.type, a.val FROM {_IDENT} a JOIN {_IDENT} b ON a.type = b.type AND a.val = b.val AND a.book < b.book")
def _(t):
    return cat.duplicate_pairs(t.books.select(F.col("id").alias("book"), F.lit("isbn").alias("type"), F.concat("publisher", "title").alias("val")))


@query("jon4_semi", "SELECT id, title FROM books b WHERE EXISTS (SELECT 1 FROM books_authors l WHERE l.book = b.id)")
def _(t):
    return t.books.join(t.books_authors, F.col("id") == F.col("book"), "left_semi").select("id", "title")


@query("jon5_anti", "SELECT id, title FROM books b WHERE NOT EXISTS (SELECT 1 FROM books_authors l WHERE l.book = b.id)")
def _(t):
    return t.books.join(t.books_authors, F.col("id") == F.col("book"), "left_anti").select("id", "title")


@query("jon6_merge_stats", "SELECT m.book_id, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT book_id FROM chunks) m LEFT JOIN (SELECT book_id, count(*) AS n FROM chunks WHERE chunk_type = 'annotation' GROUP BY book_id) s ON s.book_id = m.book_id")
def _(t):
    n = t.chunks.filter("chunk_type = 'annotation'").groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    return t.chunks.select("book_id").distinct().join(n, "book_id", "left").select("book_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("jon7_parent_lookup", "SELECT a.id, p.id AS parent, p.chunk_type AS parent_type FROM chunks a JOIN chunks p ON p.id = a.parent_id")
def _(t):
    p = t.chunks.select(F.col("id").alias("parent"), F.col("chunk_type").alias("parent_type"))
    return t.chunks.join(p, F.col("parent_id") == F.col("parent")).select("id", "parent", "parent_type")


_NORMT = "trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


_ENTRIES = "(SELECT id, CASE id % 3 WHEN 0 THEN upper(title) WHEN 1 THEN concat('The ', title) ELSE concat(title, ' ', CAST(id AS STRING)) END AS title FROM books)"


@query("jon8_match_by_title", f"SELECT e.id AS entry, m.id AS book, CASE WHEN m.id IS NOT NULL THEN 'title' END AS how FROM (SELECT id, regexp_replace({_NORMT}, '^the ', '') AS k FROM {_ENTRIES}) e LEFT JOIN (SELECT {_NORMT} AS k, min(id) AS id FROM books GROUP BY 1) m ON m.k = e.k")
def _(t):
    title = F.when(F.col("id") % 3 == 0, F.upper("title")).when(F.col("id") % 3 == 1, F.concat(F.lit("The "), "title")).otherwise(F.concat("title", F.lit(" "), F.col("id").cast("string")))
    entries = t.books.select(F.col("id").alias("entry"), title.alias("title"), F.lit("").alias("author"), F.lit(None).cast("string").alias("asin"))
    return cat.match_books(entries, t.books.select("id", "title", F.lit("x").alias("author"), F.lit("none").alias("asin")))


# titles misspelt in several ways, some with an edition and some with accents; authors left out, misspelt, accented or turned round
_MISSPELT = "CASE length(title) % 5 WHEN 0 THEN concat(title, 's') WHEN 1 THEN concat(substr(title, 1, 3), substr(title, 5)) WHEN 2 THEN replace(title, 'e', 'a') WHEN 3 THEN concat(title, ' (Kindle Edition)') ELSE replace(title, 'o', 'ó') END"
_WRITER = "concat(substr(md5(CAST(id % 700 AS STRING)), 1, 7), ' ', substr(md5(CAST(id % 700 AS STRING)), 9, 9))"
_SAID_BY = f"CASE id % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' WHEN 2 THEN concat(substr(md5(CAST(id % 700 AS STRING)), 9, 9), ', ', substr(md5(CAST(id % 700 AS STRING)), 1, 7)) WHEN 3 THEN replace({_WRITER}, 'e', 'é') ELSE substr({_WRITER}, 2) END"
_MATCH_KEY = lambda c: f"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_IN_ORDER = lambda c: f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"


def _common(x: str, y: str) -> str:
    """SQL: the length of the longest common subsequence, a bit for each place of x."""
    bit = lambda k: f"CAST(pow(2, {k}) AS HUGEINT)"
    places = f"list_transform(string_split({y}, ''), lambda c: CAST(list_sum(list_transform(range(1, length({x}) + 1), lambda k: CASE WHEN {x}[k] = c THEN {bit('k - 1')} ELSE 0 END)) AS HUGEINT))"
    every = f"({bit(f'length({x})')} - 1)"
    return f"(length({x}) - bit_count(list_reduce(list_prepend({every}, {places}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {every})))"


def _ratio(x: str, y: str) -> str:
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0 WHEN {x} = {y} THEN 100 ELSE 200.0::DOUBLE * {_common(x, y)} / (length({x}) + length({y})) END"


@query("jon8_fuzzy_match", f"""WITH e AS (SELECT entry, x, xa, {_IN_ORDER('x')} AS xs, {_IN_ORDER('xa')} AS xas FROM (SELECT title AS entry, {_MATCH_KEY(f"regexp_replace({_MISSPELT}, '\\s*\\([\\w\\s]+edition\\)\\s*$', '', 'i')")} AS x, {_MATCH_KEY(_SAID_BY)} AS xa FROM (SELECT title, min(id) AS id FROM books GROUP BY title))),
 b AS (SELECT id, y, ya, {_IN_ORDER('y')} AS ys, {_IN_ORDER('ya')} AS yas FROM (SELECT id, {_MATCH_KEY('title')} AS y, {_MATCH_KEY(_WRITER)} AS ya FROM (SELECT title, min(id) AS id FROM books GROUP BY title))),
 p AS (SELECT * FROM e, b WHERE levenshtein(xs, ys) <= 0.2 * (length(xs) + length(ys)) OR (xas <> '' AND levenshtein(xas, yas) <= 0.2 * (length(xas) + length(yas)))),
 r AS (SELECT entry, id, x = y AND (contains(xa, ya) OR contains(ya, xa)) AS exact, xa = '' OR ya = '' AS alone, {_ratio('xs', 'ys')} AS t, {_ratio('xas', 'yas')} AS a FROM p),
 s AS (SELECT entry, id, exact, CASE WHEN exact THEN 100.0::DOUBLE WHEN alone THEN t ELSE t * 0.7::DOUBLE + a * 0.3::DOUBLE END AS score FROM r)
 SELECT entry, id AS book, round(score, 4) AS score, CASE WHEN exact THEN 'exact' ELSE 'fuzzy' END AS how FROM s WHERE score >= 80 - 1e-9 QUALIFY row_number() OVER (PARTITION BY entry ORDER BY exact DESC, round(score, 4) DESC, id) = 1""")
def _(t):
    """Each title, misspelt, against the books of all titles. In the check, no pair is left out by more than a bound on edits that any
    ratio of 80 keeps: insertions and deletions are edits."""
    titles = t.books.groupBy("title").agg(F.min("id").alias("id"))
    entries = titles.select(F.col("title").alias("entry"), F.expr(_MISSPELT).alias("title"), F.expr(_SAID_BY).alias("author"))
    return cat.fuzzy_match(entries, titles.select("id", "title", F.expr(_WRITER).alias("author")))


_PATHS = "(SELECT concat(CASE id % 3 WHEN 0 THEN '/a/b/' WHEN 1 THEN '/a/' ELSE '/c/' END, CAST(id AS STRING)) AS path FROM books)"


@query("jon9_longest_prefix", f"SELECT path, CASE WHEN starts_with(path, '/a/b/') THEN 'two' WHEN starts_with(path, '/a/') THEN 'one' END AS source FROM {_PATHS}")
def _(t):
    at = F.when(F.col("id") % 3 == 0, "/a/b/").when(F.col("id") % 3 == 1, "/a/").otherwise("/c/")
    roots = t.spark.createDataFrame([("one", "/a/"), ("two", "/a/b/")], "source string, root string")
    return cat.prefix_match(t.books.select(F.concat(at, F.col("id").cast("string")).alias("path")), roots)


# --- aggregations

@query("agg1_authors", "SELECT a.id, a.name, count(DISTINCT l.book) AS n FROM books_authors l JOIN authors a ON a.id = l.author GROUP BY a.id, a.name")
def _(t):
    return cat.count_by(t.books_authors, t.authors, "author")


for _name, _col in (("publishers", "publisher"), ("tags", "tag"), ("series", "series"), ("formats", "format")):
    query(f"agg1_{_name}" if _name != "formats" else "agg4_formats", f"SELECT {_col} AS name, count(*) AS n FROM books GROUP BY {_col}")(lambda t, c=_col: t.books.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")))


@query("agg1_languages", "SELECT language AS name, count(*) AS n FROM chunks GROUP BY language")
def _(t):
    return t.chunks.groupBy(F.col("language").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("agg2_ratings", "SELECT rating / 2.0::DOUBLE AS stars, count(*) AS n FROM books WHERE rating IS NOT NULL GROUP BY 1")
def _(t):
    return cat.rating_histogram(t.books)


@query("agg3_years", "SELECT strftime(pubdate, '%Y') AS year, count(*) AS n FROM books WHERE pubdate IS NOT NULL GROUP BY 1")
def _(t):
    return cat.year_histogram(t.books)


@query("agg5_missing_metadata", "SELECT id, title, missing FROM (SELECT b.id, b.title, concat_ws(',', CASE WHEN NOT EXISTS (SELECT 1 FROM books_authors l WHERE l.book = b.id) THEN 'author' END, CASE WHEN rating IS NULL THEN 'rating' END, CASE WHEN pubdate IS NULL THEN 'date' END) AS missing FROM books b) WHERE missing <> ''")
def _(t):
    has = lambda c: t.books.filter(F.col(c).isNotNull()).select(F.col("id").alias("book"))
    return cat.missing_metadata(t.books, {"author": t.books_authors, "rating": has("rating"), "date": has("pubdate")})


@query("agg6_book_details", f"SELECT id, title, authors, tags, formats, isbn FROM {_FULL}", lists=("authors", "tags", "formats"))
def _(t):
    return full_books(t).select("id", "title", "authors", "tags", "formats", "isbn")


@query("flt19_book_by_id", f"SELECT id, title, authors FROM {_FULL} WHERE id = 7", lists=("authors",))
def _(t):
    return full_books(t).filter("id = 7").select("id", "title", "authors")


@query("agg9_tag_list", "SELECT tag, count(*) AS n FROM books GROUP BY tag HAVING count(*) >= 3 ORDER BY n DESC, tag LIMIT 20")
def _(t):
    return cat.tag_counts(t.books.select("id", "tag"), 3, 20)


@query("agg14_books_by_author", "SELECT id, title, year(pubdate) AS year FROM books b WHERE EXISTS (SELECT 1 FROM books_authors l JOIN authors a ON a.id = l.author WHERE l.book = b.id AND contains(lower(a.name), '0001')) AND year(pubdate) >= 1993 ORDER BY title, id")
def _(t):
    return cat.books_by_author(t.books, t.books_authors, t.authors, "0001", year_from=1993).select("id", "title", "year")


@query("agg15_bibliography_selection", f"SELECT id, title, year FROM {_FULL} WHERE year BETWEEN 1992 AND 1993")
def _(t):
    return full_books(t).filter("year BETWEEN 1992 AND 1993").select("id", "title", "year")


@query("agg18_available_tags", "SELECT DISTINCT trim(x) AS tag FROM (SELECT unnest(string_split(tags, ',')) AS x FROM chunks)")
def _(t):
    return t.chunks.select(F.explode(F.split("tags", ",")).alias("x")).select(F.trim("x").alias("tag")).distinct()


@query("agg20_priority_tag_reach", "SELECT w.tag, count(b.id) AS n FROM (SELECT unnest(['en', 'de', 'nowhere']) AS tag) w LEFT JOIN (SELECT id, language AS tag FROM chunks) b ON b.tag = w.tag GROUP BY w.tag")
def _(t):
    wanted = t.spark.createDataFrame([("en",), ("de",), ("nowhere",)], "tag string")
    n = t.chunks.groupBy(F.col("language").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(n, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("agg21_unindexable_summary", "SELECT reason, count(*) AS n, min(title) AS example FROM (SELECT title, CASE WHEN pubdate IS NULL THEN 'no date' WHEN rating IS NULL THEN 'no rating' END AS reason FROM books) WHERE reason IS NOT NULL GROUP BY reason")
def _(t):
    reason = F.when(F.col("pubdate").isNull(), "no date").when(F.col("rating").isNull(), "no rating")
    return t.books.select("title", reason.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("example"))


# --- duplicates

@query("dup4_isbn", f"SELECT isbn AS key, list(id ORDER BY id) AS ids FROM {_FULL} WHERE isbn IS NOT NULL GROUP BY isbn HAVING count(*) > 1", lists=("ids",))
def _(t):
    return cat.duplicates(full_books(t), F.col("isbn"))


@query("dup4_exact_title", "SELECT lower(title) AS key, list(id ORDER BY id) AS ids FROM books GROUP BY 1 HAVING count(*) > 1", lists=("ids",))
def _(t):
    return cat.duplicates(t.books, F.lower("title"))


@query("dup4_title_author", f"SELECT concat({_NORMT}, '|', array_to_string(list_sort(list_transform(authors, lambda a: lower(a))), ';')) AS key, list(id ORDER BY id) AS ids FROM {_FULL} GROUP BY 1 HAVING count(*) > 1", lists=("ids",))
def _(t):
    return cat.duplicates(full_books(t), cat.title_author_key(F.col("title"), F.col("authors")))


@query("dup4_tagged_duplicates", "SELECT id, title FROM books WHERE lower(tag) = lower((SELECT min(tag) FROM books))")
def _(t):
    return t.books.filter(F.lower("tag") == t.books.agg(F.min("tag")).first()[0].lower()).select("id", "title")


@query("snk13_duplicate_report", "SELECT key, b.id, coalesce(a.n, 0) AS n_authors FROM (SELECT lower(title) AS key, unnest(list(id)) AS id FROM books GROUP BY 1 HAVING count(*) > 1) b LEFT JOIN (SELECT book, count(*) AS n FROM books_authors GROUP BY book) a ON a.book = b.id")
def _(t):
    d = cat.duplicates(t.books, F.lower("title")).select("key", F.explode("ids").alias("id"))
    n = t.books_authors.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    return d.join(n, F.col("id") == F.col("book"), "left").select("key", "id", F.coalesce("n", F.lit(0)).cast("long").alias("n_authors"))


# --- bibliography

_IF = lambda h, c, z: f"CASE WHEN {c} IS NOT NULL AND CAST({c} AS STRING) <> '' THEN '{h}' || CAST({c} AS STRING) || '{z}' ELSE '' END"
_EACH = lambda h, xs: f"array_to_string(list_transform({xs}, lambda a: '{h}' || a || chr(10)), '')"
_NL = "' || chr(10) || '"
_BIB = {
    "bibtex": f"'@book{{' || coalesce(nullif(string_split(authors[1], ' ')[-1], ''), 'Unknown') || coalesce(CAST(year AS STRING), 'NODATE') || regexp_replace(substr(title, 1, 20), '[^\\p{{L}}\\p{{N}}]', '', 'g') || ',{_NL}  title = {{' || title || '}},{_NL}' || {_IF('  author = {', "array_to_string(authors, ' and ')", '},' + _NL)} || {_IF('  year = {', 'year', '},' + _NL)} || {_IF('  publisher = {', 'publisher', '},' + _NL)} || {_IF('  isbn = {', 'isbn', '},' + _NL)} || {_IF('  keywords = {', "array_to_string(tags, ', ')", '},' + _NL)} || '}}'",
    "ris": f"'TY  - BOOK{_NL}TI  - ' || title || chr(10) || {_EACH('AU  - ', 'authors')} || {_IF('PY  - ', 'year', _NL)} || {_IF('PB  - ', 'publisher', _NL)} || {_IF('SN  - ', 'isbn', _NL)} || {_EACH('KW  - ', 'tags')} || 'ER  - '",
    "endnote": f"'%0 Book{_NL}%T ' || title || chr(10) || {_EACH('%A ', 'authors')} || {_IF('%D ', 'year', _NL)} || {_IF('%I ', 'publisher', _NL)} || {_IF('%@ ', 'isbn', _NL)} || {_EACH('%K ', 'tags')}",
    "csv": "concat_ws(',', CAST(id AS STRING), title, array_to_string(authors, '; '), coalesce(CAST(year AS STRING), ''), coalesce(publisher, ''), coalesce(isbn, ''), array_to_string(tags, '; '), array_to_string(formats, '; '))",
}
for _kind, _sql in _BIB.items():
    query(f"snk10_{_kind}", f"SELECT id, {_sql} AS entry FROM {_FULL}")(lambda t, k=_kind: cat.bibliography(full_books(t), k))


@query("snk10_json", f"SELECT id, '{{{{\"id\":' || CAST(id AS STRING) || ',\"title\":' || to_json(title) || ',\"authors\":' || to_json(authors) || coalesce(',\"year\":' || CAST(year AS STRING), '') || coalesce(',\"publisher\":' || to_json(publisher), '') || coalesce(',\"isbn\":' || to_json(isbn), '') || ',\"tags\":' || to_json(tags) || ',\"formats\":' || to_json(formats) || '}}}}' AS entry FROM {_FULL}".replace("{{", "{").replace("}}", "}"))
def _(t):
    return cat.bibliography(full_books(t), "json")


@query("snk10_one_text", f"SELECT string_agg({_BIB['ris']}, chr(10) || chr(10) ORDER BY id) AS text FROM {_FULL}  WHERE year = 1995")
def _(t):
    return cat.one_text(cat.bibliography(full_books(t).filter("year = 1995"), "ris"))


# --- sorts

@query("srt1_rating_tiers", "SELECT id, row_number() OVER (ORDER BY CASE WHEN rating = 10 THEN 0 WHEN rating = 8 THEN 1 WHEN rating IS NULL OR rating = 0 THEN 2 ELSE 3 END, publisher, title, id) AS place FROM books")
def _(t):
    from pyspark.sql.window import Window as W

    own = t.books.withColumn("author", F.col("publisher"))
    # sorted by ranges; a partition's places begin after those of the partitions before it, of which there are few
    ordered = own.orderBy(*cat.rank_orders(own)).select("id", F.monotonically_increasing_id().alias("m"))
    ordered = ordered.select("id", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("at"))
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return ordered.join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("at") + 1).alias("place"))


@query("srt3_padded_ids", "SELECT id, lpad(CAST(id AS STRING), 20, '0') AS key FROM books ORDER BY key")
def _(t):
    return t.books.select("id", F.lpad(F.col("id").cast("string"), 20, "0").alias("key")).orderBy("key")


@query("srt4_year_key", "SELECT id, coalesce(try_cast(CASE WHEN id % 5 = 0 THEN 'n.d.' ELSE strftime(pubdate, '%Y') END AS INT), 0) AS year FROM books")
def _(t):
    return t.books.select("id", T.year_key(F.when(F.col("id") % 5 == 0, "n.d.").otherwise(F.date_format("pubdate", "yyyy"))).alias("year"))


@query("lim1_skip_and_limit", "SELECT id FROM books ORDER BY id LIMIT 20 OFFSET 40")
def _(t):
    return t.books.select("id").orderBy("id").offset(40).limit(20)


@query("win1_top_per_group", "SELECT id, publisher FROM (SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY title, id) AS n FROM books) WHERE n <= 2")
def _(t):
    return cat.top_by_group(t.books, "publisher", [F.col("title"), F.col("id")], 2).select("id", "publisher")


@query("set1_algebra", "SELECT 'union' AS op, count(*) AS n FROM (SELECT id FROM books WHERE id % 2 = 0 UNION SELECT id FROM books WHERE id % 3 = 0) UNION ALL SELECT 'minus', count(*) FROM (SELECT id FROM books WHERE id % 2 = 0 EXCEPT SELECT id FROM books WHERE id % 3 = 0) UNION ALL SELECT 'both', count(*) FROM (SELECT id FROM books WHERE id % 2 = 0 INTERSECT SELECT id FROM books WHERE id % 3 = 0)")
def _(t):
    a, b = (t.books.filter(f"id % {k} = 0").select("id") for k in (2, 3))
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return n(a.union(b).distinct(), "union").union(n(a.subtract(b), "minus")).union(n(a.intersect(b), "both"))


# --- scalar functions

@query("scl1_clean_html", """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\\s+', ' ', 'g')) AS text FROM pages""")
def _(t):
    return t.pages.select("page_id", T.clean_html(F.col("html")).alias("text"))


@query("scl3_normalize_title", f"SELECT id, {_NORMT} AS key FROM (SELECT id, regexp_replace(CASE id % 3 WHEN 0 THEN 'the ' WHEN 1 THEN 'der ' ELSE '' END || lower(title), '^(the |der )', '') AS title FROM books)")
def _(t):
    title = F.concat(F.when(F.col("id") % 3 == 0, "The ").when(F.col("id") % 3 == 1, "Der ").otherwise(""), "title")
    return t.books.select("id", T.normalize_title(title).alias("key"))


@query("scl5_year", "SELECT id, CASE WHEN id % 2 = 0 THEN year(pubdate)::INT ELSE CASE WHEN pubdate IS NOT NULL THEN year(pubdate)::INT END END AS year FROM books")
def _(t):
    y = F.date_format("pubdate", "yyyy")
    said = F.when(F.col("id") % 2 == 0, F.date_format("pubdate", "yyyy-MM-dd")).otherwise(F.concat(F.lit("c. "), y, F.lit(", repr.")))
    return t.books.select("id", T.first_year(said).alias("year"))


@query("scl6_key_values", "SELECT id, title AS a_key, CAST(id AS STRING) AS other FROM books")
def _(t):
    said = F.concat(F.lit("A Key:  old\nnoise\nA Key: "), "title", F.lit("\nother:"), F.col("id").cast("string"))
    kv = T.key_values(said)
    return t.books.select("id", kv["a_key"].alias("a_key"), kv["other"].alias("other"))


@query("scl9_token_estimates", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 1.3::DOUBLE AS by_words, length(text) // 4 AS by_chars FROM documents")
def _(t):
    return t.documents.select("doc_id", T.estimated_tokens(F.col("text")).alias("by_words"), T.quarter_tokens(F.col("text")).alias("by_chars"))


@query("scl11_cite_key", f"SELECT id, coalesce(nullif(string_split(authors[1], ' ')[-1], ''), 'Unknown') || coalesce(CAST(year AS STRING), 'NODATE') || regexp_replace(substr(title, 1, 20), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key FROM {_FULL}")
def _(t):
    return full_books(t).select("id", T.cite_key(F.get("authors", 0), F.col("year"), F.col("title")).alias("key"))


@query("scl12_escape_xml", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def _(t):
    return t.pages.select("page_id", T.escape_xml(F.col("html")).alias("escaped"))


_NUMERAL = "concat(CASE WHEN id % 11 = 0 THEN 'm' ELSE '' END, {tens}, {ones}, CASE WHEN id % 7 = 0 THEN 'II' WHEN id % 13 = 0 THEN title ELSE '' END)"
_TENS, _ONES = "'', 'X', 'XX', 'XXX', 'XL', 'L', 'lx', 'LXX', 'LXXX', 'XC'", "'', 'I', 'II', 'III', 'IV', 'V', 'vi', 'VII', 'VIII', 'IX'"


@query("scl14_roman", f"""SELECT id, said, length(said) > 0 AND regexp_full_match(upper(said), 'M?M?M?(CM|CD|D?C?C?C?)(XC|XL|L?X?X?X?)(IX|IV|V?I?I?I?)') AS roman, CAST(coalesce(list_sum(list_transform(v, lambda x, i: CASE WHEN i < len(v) AND x < v[i + 1] THEN -x ELSE x END)), 0) AS INT) AS value FROM
 (SELECT id, said, list_transform(string_split(upper(said), ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END) AS v FROM (SELECT id, {_NUMERAL.format(tens=f"([{_TENS}])[id % 100 // 10 + 1]", ones=f"([{_ONES}])[id % 10 + 1]")} AS said FROM books))""")
def _(t):
    said = F.expr(_NUMERAL.format(tens=f"array({_TENS})[cast(id % 100 div 10 as int)]", ones=f"array({_ONES})[cast(id % 10 as int)]"))
    return t.books.select("id", said.alias("said")).select("id", "said", T.is_roman(F.col("said")).alias("roman"), T.roman_value(F.col("said")).alias("value"))


@query("scl8_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, epoch_us(ts) // 1000 AS ms FROM events")
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(ts, "yyyy-MM").alias("month"), F.unix_millis(ts).alias("ms"))


@query("agg16_library_analysis", """SELECT 'author' AS part, a.name AS value, count(DISTINCT l.book) AS n FROM books_authors l JOIN authors a ON a.id = l.author GROUP BY a.name UNION ALL SELECT 'publisher', publisher, count(*) FROM books GROUP BY publisher UNION ALL SELECT 'tag', tag, count(*) FROM books GROUP BY tag
 UNION ALL SELECT 'format', format, count(*) FROM books GROUP BY format UNION ALL SELECT 'stars', CAST(rating / 2.0::DOUBLE AS STRING), count(*) FROM books WHERE rating IS NOT NULL GROUP BY rating UNION ALL SELECT 'year', strftime(pubdate, '%Y'), count(*) FROM books WHERE pubdate IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'missing', concat_ws(',', CASE WHEN rating IS NULL THEN 'rating' END, CASE WHEN pubdate IS NULL THEN 'year' END), count(*) FROM books WHERE rating IS NULL OR pubdate IS NULL GROUP BY 2""")
def _(t):
    n = lambda c: t.books.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    authors = cat.count_by(t.books_authors, t.authors, "author").groupBy("name").agg(F.sum("n").alias("n"))
    missing = cat.missing_metadata(t.books, {"rating": t.books.filter("rating IS NOT NULL").select(F.col("id").alias("book")), "year": t.books.filter("pubdate IS NOT NULL").select(F.col("id").alias("book"))})
    return cat.analysis({"author": authors, "publisher": n("publisher"), "tag": n("tag"), "format": n("format"), "stars": cat.rating_histogram(t.books), "year": cat.year_histogram(t.books), "missing": missing.groupBy("missing").agg(F.count(F.lit(1)).alias("n"))})


@query("src20_by_path", "SELECT p.path, b.id FROM (SELECT concat(publisher, '/', title, ' (', CAST(id AS STRING), ')/file.', lower(format)) AS path FROM books UNION ALL SELECT concat('Nowhere/', title) FROM books) p LEFT JOIN (SELECT id, concat(publisher, '/', title, ' (', CAST(id AS STRING), ')') AS folder FROM books) b ON b.folder = array_to_string(string_split(p.path, '/')[1:2], '/')")
def _(t):
    own = t.books.select("id", F.concat("publisher", F.lit("/"), "title", F.lit(" ("), F.col("id").cast("string"), F.lit(")")).alias("path"))
    files = t.books.select(F.concat("publisher", F.lit("/"), "title", F.lit(" ("), F.col("id").cast("string"), F.lit(")/file."), F.lower("format")).alias("path"))
    return cat.by_path(own, files.union(t.books.select(F.concat(F.lit("Nowhere/"), "title"))))


@query("scl13_messages", "SELECT doc_id, CASE lang WHEN 'de' THEN 'Zu ''{query}'' wurde nichts gefunden.' WHEN 'fr' THEN 'Rien n''a été trouvé pour « {query} ».' ELSE 'Nothing was found for ''{query}''.' END AS said, CASE lang WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' ELSE 'eng' END AS ocr FROM documents")
def _(t):
    from ..functions import messages

    return t.documents.select("doc_id", messages.said("no_results", F.col("lang")).alias("said"), messages.ocr_code(F.col("lang")).alias("ocr"))
