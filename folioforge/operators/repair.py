"""Repair jobs over a stored index, and reports that compare it with its sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filters as flt
from . import tables


def backfill_hashes(chunks: DataFrame, catalogue: DataFrame) -> DataFrame:
    """chunks with the catalogue's (book_id, metadata_hash) where they have none."""
    c = catalogue.select("book_id", F.col("metadata_hash").alias("__h"))
    out = chunks.join(c, "book_id", "left")
    return out.withColumn("metadata_hash", F.when(F.coalesce("metadata_hash", F.lit("")) == "", F.coalesce("__h", F.lit(""))).otherwise(F.col("metadata_hash"))).drop("__h")


def unstable_hashes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Books whose hash differs between two computations from the same source."""
    b = second.select("book_id", F.col("metadata_hash").alias("again"))
    return first.join(b, "book_id").filter(~F.col("metadata_hash").eqNullSafe(F.col("again"))).select("book_id", "metadata_hash", "again")


def refresh_comments(chunks: DataFrame, comments: DataFrame) -> DataFrame:
    """chunks with the comment rows of the books in `comments` replaced by those; other books keep theirs."""
    books = comments.select("book_id").distinct().withColumn("__new", F.lit(True))
    kept = chunks.join(books, "book_id", "left").filter((F.col("chunk_type") != flt.COMMENT) | F.col("__new").isNull()).drop("__new")
    return kept.unionByName(comments.withColumn("chunk_type", F.lit(flt.COMMENT)), allowMissingColumns=True)


def toc_report(toc: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each outline entry (book_id, title, page): chunks of its title and chunks of its page."""
    by_title = chunks.groupBy("book_id", F.col("section_title").alias("title")).agg(F.count(F.lit(1)).alias("by_title"))
    by_page = chunks.groupBy("book_id", F.col("page_number").alias("page")).agg(F.count(F.lit(1)).alias("by_page"))
    out = toc.join(by_title, ["book_id", "title"], "left").join(by_page, ["book_id", "page"], "left")
    return out.fillna(0, ["by_title", "by_page"]).select("book_id", "title", "page", "by_title", "by_page")


#: A note's number in a text, and at the head of its body.
MARKER, BODY = r"\[\^([^\]\s]+)\](?!:)", r"(?m)^[ \t]*\[\^([^\]\s]+)\]:"


def note_places(parts: DataFrame) -> DataFrame:
    """book, note, k, kind of the note markers and the note bodies in the parts (book, k, text) of volumes; one row for each note and part.

    A marker is `[^n]` in a text, a body begins a line with `[^n]:`.
    """
    found = lambda pattern, kind: parts.select("book", "k", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("note"), F.lit(kind).alias("kind"))
    return found(MARKER, "marker").union(found(BODY, "body")).select("book", "note", "k", "kind")


def unmatched_notes(parts: DataFrame) -> DataFrame:
    """book, note, k and reason of what doesn't fit: markers without a body in their part or a later one of the volume (`unresolved`), and
    bodies without a marker in their part or an earlier one (`orphaned`).

    Numbers may begin anew within a volume, so a marker is matched with the next body of its number. That body stands at or after
    the marker just if the number's last body does, and likewise its first marker: so each side only meets one row for each number, not
    all rows of a number that every part has.
    """
    places = note_places(parts)
    ends = places.groupBy("book", "note").agg(F.max(F.when(F.col("kind") == "body", F.col("k"))).alias("last_body"), F.min(F.when(F.col("kind") == "marker", F.col("k"))).alias("first_marker"))
    both = places.join(ends, ["book", "note"])
    lacks = F.when((F.col("kind") == "marker") & (F.col("last_body").isNull() | (F.col("last_body") < F.col("k"))), "unresolved").when((F.col("kind") == "body") & (F.col("first_marker").isNull() | (F.col("first_marker") > F.col("k"))), "orphaned")
    return both.withColumn("reason", lacks).filter("reason IS NOT NULL").select("book", "note", "k", "reason")


#: Least share of pages whose text is there, least share of pages whose number is attested, and the share of the text that may cite as another page, below which it must stay.
LEAST_COVERAGE, LEAST_ATTESTED, MOST_INHERITED = 0.95, 0.5, 0.5


def admission(coverage: DataFrame, least_share: float = LEAST_COVERAGE, parts: DataFrame | None = None, profile: DataFrame | None = None, least_attested: float = LEAST_ATTESTED, most_inherited: float = MOST_INHERITED) -> DataFrame:
    """Whether a prepared volume may enter, and what is against it.

    coverage (book, page, present) gives the share of its pages whose text is there. With parts (book, k, text): how many notes have a
    body, and no note may lack one or its marker. With a profile (book, certain, attested, inherited): there are at least as many bodies as
    notes that the preparation was certain of, enough pages have an attested number, and little of the text cites as another page;
    what the profile doesn't say is unknown, and unknown isn't admitted.
    """
    g = coverage.groupBy("book").agg(F.avg(F.col("present").cast("int")).alias("share"), F.count(F.lit(1)).alias("pages"))
    reasons = [F.when(F.coalesce(F.col("share"), F.lit(0.0)) < least_share, F.concat(F.lit("coverage "), F.round(F.coalesce("share", F.lit(0.0)), 4).cast("string")))]
    if parts is not None:
        bodies = note_places(parts).filter("kind = 'body'").groupBy("book").agg(F.count(F.lit(1)).alias("definitions"))
        lost = unmatched_notes(parts).groupBy("book").agg(F.count_if(F.col("reason") == "unresolved").alias("unresolved"), F.count_if(F.col("reason") == "orphaned").alias("orphaned"))
        g = g.join(bodies, "book", "left").join(lost, "book", "left").fillna(0, ["definitions", "unresolved", "orphaned"])
        reasons += [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {c} notes"))) for c in ("unresolved", "orphaned")]
    if profile is not None:
        g = g.join(profile.select("book", "certain", "attested", "inherited"), "book", "left")
        if parts is not None:
            reasons.append(F.when(F.col("definitions") < F.col("certain"), F.concat(F.col("definitions").cast("string"), F.lit(" definitions of "), F.col("certain").cast("string"))))
        reasons += [
            F.when(F.col("attested").isNull(), "attested share unknown").when(F.col("attested") < least_attested, F.concat(F.lit("attested "), F.col("attested").cast("string"))),
            F.when(F.col("inherited").isNull(), "inherited share unknown").when(F.col("inherited") >= most_inherited, F.concat(F.lit("inherited "), F.col("inherited").cast("string"))),
        ]
    out = g.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return out.withColumn("admitted", F.size("reasons") == 0)


def remaining(queue: DataFrame, done: DataFrame, key: str = "book_id") -> DataFrame:
    """What a run that was cut off still has to do."""
    return queue.join(done.select(key).distinct(), key, "left_anti")


LEDGER = "batch long, key string, status string, error string, rows long"


def drive(queue: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, size: int = 1000, error: str = "error") -> DataFrame:
    """Does `work` on the keys of a queue in batches of about `size`, each once, and returns the ledger (LEDGER).

    work makes rows (key, ..., error) of a batch's queue rows; a key with a row whose `error` is set has failed: its rows are left out,
    and the failure is a row of the ledger. A batch's rows and its part of the ledger are folders of the batch's number, written over if
    the batch is done again; the ledger's comes last and says that the batch is done. So a run that is cut off and repeated does what is
    left, and each key's rows are there once. Keys that failed are tried again only if the caller puts them into another ledger's queue.
    Keys that are new in the queue get batches of their own.
    """
    spark = queue.sparkSession
    done = ledger(spark, path)
    todo = queue.withColumn("__key", F.col(key).cast("string")).join(done.select(F.col("key").alias("__key")), "__key", "left_anti")
    keys = tables.settle(todo.select("__key").filter("__key IS NOT NULL").distinct())
    first, n = 1 + (done.agg(F.max("batch")).first()[0] or 0), keys.count()
    batches = -(-n // size)
    keys = keys.withColumn("__batch", F.pmod(F.xxhash64("__key"), F.lit(max(batches, 1))))
    for k in range(batches):
        own = tables.settle(keys.filter(F.col("__batch") == k).select("__key"))
        made = tables.settle(work(todo.join(own, "__key", "left_semi").drop("__key")).withColumn("__key", F.col(key).cast("string")))
        failed = made.filter(F.col(error).isNotNull()).groupBy("__key").agg(F.min(error).alias("error"))
        good = made.join(failed, "__key", "left_anti")
        counts = good.groupBy("__key").agg(F.count(F.lit(1)).alias("rows"))
        good.drop("__key", error).write.mode("overwrite").parquet(f"{path}/rows/batch={first + k}")
        said = own.join(failed, "__key", "left").join(counts, "__key", "left")
        said = said.select(F.col("__key").alias("key"), F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
        said.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={first + k}")  # `size` rows
    return ledger(spark, path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """What has been done so far: batch, key, status (done or failed), error, rows."""
    if not tables.exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger").select("batch", "key", "status", "error", "rows")


def driven_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the batches that are done, with `batch`."""
    done = ledger(spark, path).select("batch").distinct()
    return spark.read.parquet(f"{path}/rows").join(F.broadcast(done), "batch", "left_semi")  # a row for each batch


def split_errors(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows, and failed ones: one bad book doesn't fail the job."""
    return rows.filter(F.col(error).isNull()).drop(error), rows.filter(F.col(error).isNotNull())


def spans(parts: DataFrame) -> DataFrame:
    """book, k, char_start, char_end of parts (book, k, text) that are joined by blank lines in order of k."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("book").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0))
    return parts.select("book", "k", start.alias("char_start"), (start + F.length("text")).alias("char_end"))
