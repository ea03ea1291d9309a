"""Queries of hashing, scans, maintenance and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lifecycle as life
from .registry import query

_MHASH = "md5('{\"author\": ' || to_json(publisher) || ', \"comments\": ' || to_json(title) || ', \"publisher\": ' || to_json(publisher) || ', \"tags\": [' || array_to_string(list_transform(list_sort([tag, format]), lambda x: to_json(x)::VARCHAR), ', ') || '], \"title\": ' || to_json({t}) || '}')"


def _mhash_sql(title: str) -> str:
    return _MHASH.replace("{t}", title)


def _mhash(title):
    return T.metadata_hash(F.col("publisher"), F.col("title"), F.col("publisher"), F.array("tag", "format"), title)


@query("hsh1_metadata_hash", f"SELECT id, {_mhash_sql('title')} AS hash FROM books")
def _(t):
    return t.books.select("id", _mhash(F.col("title")).alias("hash"))


@query("hsh2_item_hash", "SELECT id, md5('{\"abstract\": ' || to_json(title) || ', \"authors\": [' || array_to_string(list_transform(list_sort([publisher, title]), lambda x: to_json(x)::VARCHAR), ', ') || '], \"date\": ' || to_json(series) || ', \"tags\": [' || to_json(tag) || '], \"title\": ' || to_json(title) || '}') AS hash FROM books")
def _(t):
    return t.books.select("id", T.item_hash(F.col("title"), F.array("publisher", "title"), F.col("series"), F.array("tag"), F.col("title")).alias("hash"))


@query("hsh3_annotation_hash", "SELECT book_id, md5(string_agg(line, chr(10) ORDER BY line)) AS hash FROM (SELECT book_id, concat(highlight, '|', note, '|', kind) AS line FROM annotations) GROUP BY book_id")
def _(t):
    line = T.annotation_line(F.col("highlight"), F.col("note"), F.col("kind"))
    return t.annotations.groupBy("book_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary")).alias("hash"))


@query("hsh4_file_hash", "SELECT page_id, sha256(html) AS sha256, md5(concat(CAST(page_id AS STRING), ':', CAST(strlen(html) AS STRING))) AS signature FROM pages")
def _(t):
    sig = F.concat_ws(":", F.col("page_id").cast("string"), F.octet_length("html").cast("string"))
    return t.pages.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.md5(sig.cast("binary")).alias("signature"))


_CAT = f"(SELECT id, {_mhash_sql('title')} AS metadata_hash, CASE WHEN id % 5 = 0 THEN 'x' ELSE '' END AS annotation_hash FROM books)"
_STORED = f"(SELECT id, CASE WHEN id % 11 = 0 THEN '' ELSE {_mhash_sql("(CASE WHEN id % 17 = 0 THEN title || ' (old)' ELSE title END)")} END AS metadata_hash, CASE WHEN id % 10 = 0 THEN 'x' ELSE '' END AS annotation_hash FROM books WHERE id % 23 <> 0)"
_FLAGS = f"SELECT c.id, s.id IS NULL AS is_new, coalesce(s.metadata_hash <> '' AND s.metadata_hash <> c.metadata_hash, false) AS metadata_changed, s.id IS NOT NULL AND c.annotation_hash <> coalesce(s.annotation_hash, '') AS annotations_changed, s.id IS NOT NULL AND c.id % 7 = 0 AS fulltext_pending FROM {_CAT} c LEFT JOIN {_STORED} s ON s.id = c.id"


def _scan(t):
    cat = t.books.select("id", _mhash(F.col("title")).alias("metadata_hash"), F.when(F.col("id") % 5 == 0, "x").otherwise("").alias("annotation_hash"))
    old = F.when(F.col("id") % 17 == 0, F.concat("title", F.lit(" (old)"))).otherwise(F.col("title"))
    stored = t.books.filter("id % 23 <> 0").select("id", F.when(F.col("id") % 11 == 0, "").otherwise(_mhash(old)).alias("metadata_hash"), F.when(F.col("id") % 10 == 0, "x").otherwise("").alias("annotation_hash"))
    return life.classify(cat, stored, t.books.filter("id % 7 = 0").select("id"))


@query("wdg1_scan_classification", f"SELECT *, NOT (is_new OR metadata_changed OR annotations_changed OR fulltext_pending) AS unchanged FROM ({_FLAGS})")
def _(t):
    return _scan(t)


@query("wdg1_scan_counts", f"SELECT count(*) FILTER (is_new) AS is_new, count(*) FILTER (metadata_changed) AS metadata_changed, count(*) FILTER (annotations_changed) AS annotations_changed, count(*) FILTER (fulltext_pending) AS fulltext_pending, count(*) FILTER (NOT (is_new OR metadata_changed OR annotations_changed OR fulltext_pending)) AS unchanged FROM ({_FLAGS})")
def _(t):
    return life.scan_counts(_scan(t))


_SIGNED = "SELECT id, CAST(id * 7 AS STRING) AS signature, CASE WHEN id % 3 = 0 THEN false ELSE id % 4 = 0 END AS changed, id % 3 = 0 AS seeded FROM books"


@query("wdg2_attachment_signatures", _SIGNED)
def _(t):
    items = t.books.select("id", (F.col("id") * 7).cast("string").alias("signature"))
    cache = t.books.filter("id % 3 <> 0").select("id", F.when(F.col("id") % 4 == 0, "old").otherwise((F.col("id") * 7).cast("string")).alias("signature"))
    return life.seeded_signatures(items, cache)


@query("wdg7_annotation_signatures", _SIGNED)
def _(t):
    items = t.books.select("id", (F.col("id") * 7).cast("string").alias("signature"))
    cache = t.books.filter("id % 3 <> 0").select("id", F.when(F.col("id") % 4 == 0, "old").otherwise(F.expr("cast(id * 7 as string)")).alias("signature"))
    return life.seeded_signatures(items, cache)


@query("wdg3_index_order", "SELECT id, CASE WHEN contains(lower(title), 'red') THEN 0 ELSE 1 END AS group_no, CASE WHEN coalesce(rating, 0) >= 10 THEN 0 WHEN coalesce(rating, 0) >= 8 THEN 1 ELSE 2 END AS tier FROM books ORDER BY group_no, tier, id DESC LIMIT 200")
def _(t):
    return life.index_order(t.books, F.lower("title").contains("red"), 200).select("id", "group_no", "tier")


@query("wdg4_orphans", "SELECT DISTINCT book_id AS id FROM chunks WHERE book_id NOT IN ('src1', 'src2', 'src3')")
def _(t):
    known = t.spark.createDataFrame([("src1",), ("src2",), ("src3",)], "id string")
    return life.orphans(t.chunks.select(F.col("book_id").alias("id")).distinct(), known)


@query("wdg4_orphan_bound", "SELECT o AS orphans, n AS indexed, o / n::DOUBLE AS share, NOT (o / n::DOUBLE > 0.02 AND o > 25) AS allowed FROM (SELECT count(*) FILTER (id % 40 = 0) AS o, count(*) AS n FROM books)")
def _(t):
    return life.orphan_bound(t.books.select("id"), t.books.filter("id % 40 <> 0").select("id"))


@query("wdg4_orphans_removed", "SELECT book_id, count(*) AS n FROM chunks WHERE book_id <> 'src9' GROUP BY book_id")
def _(t):
    known = t.chunks.filter("book_id <> 'src9'").select(F.col("book_id").alias("id")).distinct()
    return life.remove_orphans(t.chunks, known).groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))


@query("wdg5_catchup_nomination", "SELECT id, 'marked' AS how FROM books WHERE id % 50 = 0 UNION ALL SELECT id, 'derived' FROM books WHERE format = 'PDF' AND rating IS NULL AND id % 50 <> 0")
def _(t):
    return life.catchup(t.books.filter("id % 50 = 0"), t.books.filter("format = 'PDF'"), t.books.filter("rating IS NOT NULL"))


@query("wdg5_catchup_bound", "SELECT n AS derived, n <= 100 AS allowed FROM (SELECT count(*) AS n FROM books WHERE format = 'PDF' AND rating IS NULL AND id % 50 <> 0)")
def _(t):
    return life.catchup_bound(life.catchup(t.books.filter("id % 50 = 0"), t.books.filter("format = 'PDF'"), t.books.filter("rating IS NOT NULL")))


@query("wdg6_smart_update", "SELECT id, CASE WHEN book_id = 'src6' AND chunk_type = 'calibre_comment' THEN 'new comment' ELSE text END AS text FROM chunks")
def _(t):
    """Only the comment rows of a changed book are rewritten."""
    from ..operators import chunkstore as cs

    own = t.chunks.select("id", "book_id", "chunk_type", "text")
    new = own.filter("book_id = 'src6' AND chunk_type = 'calibre_comment'").withColumn("text", F.lit("new comment"))
    return cs.upsert(own, new).select("id", "text")


@query("wdg9_same_period", "SELECT event_id, CAST(ts AS DATE) = DATE '2024-01-10' AS daily, isoyear(ts) = 2024 AND week(ts) = 2 AS weekly FROM events")
def _(t):
    ts, day = F.col("ts").cast("timestamp"), F.lit("2024-01-10").cast("timestamp")
    return t.events.select("event_id", life.same_period(ts, day, "daily").alias("daily"), life.same_period(ts, day, "weekly").alias("weekly"))


@query("wdg12_log_stats", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    log = F.concat(F.lit("started\n{bad\n"), "props", F.lit("\ndone"))
    return t.events.select("event_id", life.report_tool_output(log, "k long")["k"].alias("k"))


@query("ses1_sessions", "SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM events)")
def _(t):
    rows = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return life.sessions(rows, "user_id", "ts", "event_id").select("event_id", "session")


_HIST = "(SELECT event_type AS source, value, ts, CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS exit_code, event_id % 13 = 0 AS skipped, event_id % 100 AS waiting, event_id % 4 AS taken FROM events)"


def _history(t):
    e = F.col("event_id")
    return t.events.select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("timestamp"), F.when(e % 9 == 0, 1).otherwise(0).alias("exit_code"), (e % 13 == 0).alias("skipped"), (e % 100).alias("waiting"), (e % 4).alias("taken"))


@query("agg17_run_rollup", f"SELECT source, count(*) AS entries, count(*) FILTER (NOT skipped AND exit_code = 0) AS successes, count(*) FILTER (NOT skipped AND exit_code <> 0) AS failures, count(*) FILTER (skipped) AS skips, CAST(sum(taken) AS BIGINT) AS taken, max(waiting) AS waiting, strftime(max(ts) FILTER (NOT skipped), '%Y-%m-%d %H') AS last_run FROM {_HIST} GROUP BY source")
def _(t):
    return life.run_rollup(_history(t), ["waiting"], ["taken"]).withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd HH"))


@query("agg17_standstills", f"SELECT source, max(waiting) AS waiting FROM {_HIST} GROUP BY source HAVING max(waiting) > 0")
def _(t):
    return life.standstills(life.run_rollup(_history(t).withColumn("taken", F.lit(0)), ["waiting"], ["taken"]), "waiting", "taken")
