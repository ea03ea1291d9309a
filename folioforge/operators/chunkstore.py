"""The chunk table as files: upserts, deletes, metadata updates, index statistics, audits.

Stored tables are versions that a pointer names (`tables`): a failed job leaves the old table whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from . import filters as flt
from . import tables

GUARDED = ("text", "vector", "pipeline_version", "producer_version")
PIPELINE_VERSION = "2"
#: Columns that older tables may lack, with the value they get.
DEFAULTS: dict[str, str] = {
    "page_label": "''", "section_type": "''", "parent_id": "''", "region": "''", "label_source": "''", "producer_version": "''", "annotation_hash": "''", "metadata_hash": "''", "source_id": "''", "pending_external": "0", "window_text": "''", "pipeline_version": "''",
}


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(tables.read(spark, path))


def with_defaults(chunks: DataFrame) -> DataFrame:
    """Missing columns added, nulls in known ones replaced."""
    out = chunks
    for name, value in DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.expr(value)) if name in chunks.columns else F.expr(value))
    return out


def swap_in(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """df in place of the stored table: a reader sees the old table or the new one."""
    tables.publish(df, path, partition_by)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of old whose key isn't in new, and all rows of new; new rows carry this pipeline's version."""
    if "pipeline_version" in old.columns:
        new = new.withColumn("pipeline_version", F.lit(PIPELINE_VERSION))
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(chunks: DataFrame, condition: Column) -> DataFrame:
    """What a delete leaves; rows for which the condition is null stay."""
    return chunks.filter(~F.coalesce(condition, F.lit(False)))


def update_metadata(chunks: DataFrame, book_id: str, updates: Mapping[str, object]) -> DataFrame:
    """A book's rows with new values; unknown columns are dropped, guarded ones refused."""
    if bad := [c for c in updates if c in GUARDED]:
        raise ValueError(f"not metadata: {bad}")
    own = {c: F.when(F.col("book_id") == book_id, F.lit(v).cast(chunks.schema[c].dataType)).otherwise(F.col(c)) for c, v in updates.items() if c in chunks.columns}
    return chunks.withColumns(own) if own else chunks


def replace_book(chunks: DataFrame, book_id: str, new: DataFrame, drop_annotations: bool = False) -> DataFrame:
    """A book's rows replaced by newly computed ones; annotations stay unless they were extracted anew."""
    gone = F.col("book_id") == book_id
    if not drop_annotations:
        gone = gone & (F.col("chunk_type") != flt.ANNOTATION)
    return without(chunks, gone).unionByName(new, allowMissingColumns=True)


def processed_rows(docs: DataFrame, author: str, title: str, doc_id: str) -> DataFrame:
    """Chunk rows of processed texts (index, text): ids are <author>_<title>_<id>_chunk_<index>."""
    book = F.concat_ws("_", *[F.regexp_replace(F.lit(x), r"\s+", "_") for x in (author, title, doc_id)])
    return docs.select(F.concat(book, F.lit("_chunk_"), F.col("index").cast("string")).alias("id"), book.alias("book_id"), "text", F.col("index").alias("chunk_index"))


def indexed_books(chunks: DataFrame) -> DataFrame:
    """A row for each book: its first title and language by chunk index, chunks, last time of indexing."""
    first = F.struct("chunk_index", "id")
    return chunks.groupBy("book_id").agg(F.min_by("language", first).alias("language"), F.min_by("tags", first).alias("tags"), F.count(F.lit(1)).alias("n"), F.max("indexed_at").alias("indexed_at"))


def index_stats(chunks: DataFrame) -> DataFrame:
    """Counts by each of several columns in one pass: rows of (what, value, n); and the totals."""
    g = chunks.groupingSets([["chunk_type"], ["language"], ["section_type"], []], "chunk_type", "language", "section_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("book_id").alias("books"), F.grouping_id().alias("g"))
    what = F.when(F.col("g") == 3, "chunk_type").when(F.col("g") == 5, "language").when(F.col("g") == 6, "section_type").otherwise("total")
    return g.select(what.alias("what"), F.coalesce("chunk_type", "language", "section_type").alias("value"), "n", "books")


def book_state(chunks: DataFrame) -> DataFrame:
    """What is stored of each book: counts, hashes, whether it has content."""
    content = F.col("chunk_type").isin(flt.CONTENT, flt.CHILD)
    first = F.struct("chunk_index", "id")
    pick = lambda c, where: F.min_by(F.when(where, F.col(c)), F.when(where, first))
    some = F.col("metadata_hash") != ""
    return chunks.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(content).alias("content_count"), F.bool_or(content).alias("has_content"),
        F.coalesce(pick("metadata_hash", content & some), pick("metadata_hash", (F.col("chunk_type") == flt.COMMENT) & some), F.lit("")).alias("metadata_hash"),
        F.coalesce(F.max(F.nullif("annotation_hash", F.lit(""))), F.lit("")).alias("annotation_hash"),
    )


def book_hashes(chunks: DataFrame) -> DataFrame:
    """The hash of each book: the last of its comment, parent and child rows, else the first of all."""
    order = F.struct("chunk_index", "id")
    late = F.col("chunk_type").isin(flt.COMMENT, flt.PARENT, flt.CHILD) & (F.col("metadata_hash") != "")
    return chunks.groupBy("book_id").agg(F.coalesce(F.max_by(F.when(late, F.col("metadata_hash")), F.when(late, order)), F.min_by("metadata_hash", order)).alias("metadata_hash"), F.bool_or(F.col("chunk_type").isin(flt.CONTENT, flt.CHILD, flt.PARENT)).alias("has_content"))


def flat_books(chunks: DataFrame) -> DataFrame:
    """Books with flat content and no hierarchy."""
    g = chunks.groupBy("book_id").agg(F.bool_or(F.col("chunk_type") == flt.CONTENT).alias("flat"), F.bool_or(F.col("chunk_type").isin(flt.PARENT, flt.CHILD)).alias("deep"))
    return g.filter("flat AND NOT deep").select("book_id")


def stub_only_books(chunks: DataFrame) -> DataFrame:
    """Books of which nothing but a metadata stub (and perhaps comments) is stored."""
    g = chunks.groupBy("book_id").agg(F.array_sort(F.collect_set("chunk_type")).alias("types"))
    return g.filter(F.array_contains("types", flt.STUB) & (F.size(F.array_except("types", F.array(F.lit(flt.STUB), F.lit(flt.COMMENT)))) == 0)).select("book_id")


def to_index(books: DataFrame, chunks: DataFrame, before: str | None = None, content_only: bool = True) -> DataFrame:
    """Books that still have to be indexed: not stored yet, or stored before a date."""
    done = chunks.filter(F.col("chunk_type").isin(flt.CONTENT, flt.CHILD, flt.PARENT)) if content_only else chunks
    if before:
        done = done.filter(F.col("indexed_at") >= before)
    return books.join(done.select("book_id").distinct(), "book_id", "left_anti")


# --- audits

def duplicate_ids(chunks: DataFrame, key: Sequence[str] = ("chunk_type", "id")) -> DataFrame:
    return chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("texts")).filter("n > 1")


def newest_only(chunks: DataFrame, key: Sequence[str] = ("chunk_type", "id")) -> DataFrame:
    """Of rows with one key the newest; ties by text's hash, so the choice is stable."""
    w = W.partitionBy(*key).orderBy(F.desc("indexed_at"), F.md5(F.col("text").cast("binary")))
    return chunks.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def stale_rows(rows: DataFrame, book: str, ts: str, gap_minutes: int = 15) -> DataFrame:
    """Rows of a book older than the start of its newest run; runs are split by gaps longer than that."""
    w = W.partitionBy(book).orderBy(ts)
    new_run = F.lag(ts).over(w).isNull() | (F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w)) > gap_minutes * 60_000_000)
    starts = rows.withColumn("__s", F.when(new_run, F.col(ts))).withColumn("__last", F.max("__s").over(W.partitionBy(book)))
    return starts.filter(F.col(ts) < F.col("__last")).drop("__s", "__last")


def quality_score(chunks: DataFrame) -> DataFrame:
    """A 0 to 100 score of each book's chunks and what it is made of."""
    content = F.col("chunk_type").isin(flt.CONTENT, flt.CHILD)
    words = T.word_count(F.col("text"))
    own = chunks.withColumns({"__c": content, "__w": F.when(content, words), "__np": F.col("chunk_type") != flt.PARENT})
    last = own.groupBy("book_id").agg(F.max(F.when(F.col("__np"), F.col("chunk_index"))).alias("__max"))
    own = own.join(last, "book_id")
    total = F.greatest(F.count_if("__c"), F.lit(1))
    early = F.count_if(F.col("__np") & (F.col("section_type") == "back_matter") & (F.col("chunk_index") < F.col("__max") * F.lit(0.9)))
    g = own.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.count_if("__c").alias("__n"), total.alias("content_chunks"), (F.count_if(F.col("__c") & T.ends_open(F.col("text"))) / total).alias("truncation_rate"),
        F.when(F.count_if("__c") > 0, early / total).otherwise(0.0).alias("misplaced_back_rate"), F.when(F.count_if("__c") == 0, 1.0).otherwise(F.coalesce(F.stddev_samp("__w") / F.nullif(F.avg("__w"), F.lit(0.0)), F.lit(0.0))).alias("cv"),
        (F.count_if(F.col("__c") & (F.col("__w") < 50)) / total).alias("short_rate"), F.bool_or(F.col("__c") & ((F.coalesce("page_number", F.lit(0)) > 0) | (F.coalesce("page_label", F.lit("")) != ""))).alias("has_pages"),
    )
    raw = 100.0 - F.col("truncation_rate") * 30 - F.col("misplaced_back_rate") * 25 - F.least("cv", F.lit(1.0)) * 10 - F.col("short_rate") * 15 + F.when(F.col("has_pages"), 5).otherwise(0)
    third = lambda c: F.round(c, 3).alias(c)
    return g.select("book_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1).alias("score"), "chunk_count", "content_chunks", third("truncation_rate"), third("misplaced_back_rate"), third("cv"), third("short_rate"), "has_pages")


FORMAT_ORDER = ("PDF", "EPUB", "MOBI", "AZW3", "TXT")


def best_format(scored: DataFrame) -> DataFrame:
    """book and its best format by score; without scores, by a fixed preference."""
    order = F.array_position(F.array(*[F.lit(f) for f in FORMAT_ORDER]), F.col("format"))
    order = F.when(order == 0, len(FORMAT_ORDER) + 1).otherwise(order)
    return scored.groupBy("book").agg(F.coalesce(F.max_by("format", F.when(F.col("score").isNotNull(), F.struct("score", -order))), F.min_by("format", F.struct(order, "format"))).alias("format"))


def needs_ocr(books: DataFrame, least_pages: int = 6) -> DataFrame:
    """books (format, total_pages, total_words, n_chunks, pages_with_text) with whether the scan lacks text."""
    p, w = F.col("total_pages"), F.col("total_words")
    thin = (p >= 3) & (w > 0) & (w / p < 150) & (F.col("pages_with_text") / p < 0.4)
    return books.withColumn("needs_ocr", F.when(F.lower("format") != "pdf", False).when((p > 0) & (p < least_pages), False).when(F.col("n_chunks") == 0, True).otherwise(F.coalesce(thin, F.lit(False))))


def scanned_books(chunks: DataFrame, books: DataFrame, least: float, excluded: Sequence[str] = ()) -> DataFrame:
    """Books with few words a page or no content at all, least first."""
    s = chunks.filter(F.col("chunk_type").isin(flt.CONTENT, flt.CHILD)).groupBy("book_id").agg(F.sum(T.word_count(F.col("text"))).alias("words"), F.countDistinct("page_number").alias("pages"))
    j = books.filter(~flt.has_any_tag(F.col("tags"), excluded)).join(s, "book_id", "left").fillna(0, ["words", "pages"])
    rate = F.round(F.col("words") / F.greatest(F.col("pages"), F.lit(1)), 3)
    return j.withColumn("words_per_page", rate).filter((F.col("words") == 0) | (F.col("words_per_page") < least))


def missing_labels(chunks: DataFrame, share: float = 0.9) -> DataFrame:
    """Books where over that share of rows has no label of its own."""
    bare = (F.coalesce("page_label", F.lit("")) == "") | (F.col("page_label") == F.col("page_number").cast("string"))
    g = chunks.groupBy("book_id").agg(F.avg(bare.cast("int")).alias("share"), F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("share") > share)


def inspect(chunks: DataFrame) -> DataFrame:
    """Word statistics and field coverage of each book's chunks."""
    w = T.word_count(F.col("text"))
    pct = lambda c: F.round(100 * F.avg((F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int")), 2)
    return chunks.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.min(w).alias("least"), F.max(w).alias("most"), F.median(w).alias("median"), F.round(F.avg(w), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(w), F.lit(0.0)), 4).alias("stdev"), pct("page_label").alias("labels_pct"), pct("parent_id").alias("parents_pct"))


def boundaries(chunks: DataFrame, n: int = 40) -> DataFrame:
    return chunks.select("id", F.substring("text", 1, n).alias("head"), F.col("text").substr(F.greatest(F.length("text") - n + 1, F.lit(1)), F.lit(n)).alias("tail"), T.ends_open(F.col("text")).alias("open"))


def text_coverage(source: DataFrame, prepared: DataFrame, words: int = 8, least: float = 0.5) -> DataFrame:
    """book and page of source pages (book, page, text) with the share of their windows of words that stand in the prepared text (book, text)."""
    toks = F.filter(F.split(F.lower("text"), r"(?U)[^\w]+"), lambda x: x != "")
    flat = prepared.select("book", F.array_join(toks, " ").alias("hay"))
    parts = source.select("book", "page", toks.alias("t")).withColumn("w", F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("t") / words).cast("int") - 1, F.lit(0))), lambda i: F.array_join(F.slice("t", i * words + 1, words), " ")))
    j = parts.join(flat, "book").withColumn("share", F.size(F.filter("w", lambda x: F.col("hay").contains(x))) / F.size("w"))
    return j.select("book", "page", F.round("share", 4).alias("share"), (F.col("share") >= least).alias("present"))


def rename_tag(tags: Column, old: str, new: str) -> Column:
    """A comma-separated list with one name replaced; the new name stands once."""
    t = F.transform(F.filter(F.transform(F.split(tags, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.when(x == old, F.lit(new)).otherwise(x))
    return F.array_join(F.array_distinct(t), ", ")


def import_annotations(chunks: DataFrame, matched: DataFrame) -> DataFrame:
    """chunks with the matched annotations (book_id, source, highlight, note, created) in place of earlier ones of the same book and source."""
    old = chunks.join(matched.select("book_id", F.col("source").alias("annotation_source")).distinct(), ["book_id", "annotation_source"], "left_anti")
    idx = F.row_number().over(W.partitionBy("book_id").orderBy("created", "highlight", "note")) - 1
    rows = matched.withColumn("__i", idx).withColumn("text", T.annotation_text(F.col("highlight"), F.col("note"))).filter("text <> ''")
    new = rows.select(F.concat("book_id", F.lit("_"), "source", F.lit("_"), F.col("__i").cast("string")).alias("id"), "book_id", "text", F.lit(flt.ANNOTATION).alias("chunk_type"), (-1000 - F.col("__i")).cast("long").alias("chunk_index"), F.col("source").alias("annotation_source"))
    return old.unionByName(new, allowMissingColumns=True)
