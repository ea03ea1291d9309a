"""Prepared documents: JSON lines, a header line first, then a line for each chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "_header boolean, calibre_id long, book_id string, chunk_count long, prepared_at string"
ROW = "_header boolean, id string, text string, chunk_index int, chunk_type string, section_title string, page_number int, parent_id string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def completeness(lines: DataFrame) -> DataFrame:
    """file, rows its header promises, rows found, and whether the file is whole."""
    head = F.from_json("value", HEADER)
    g = lines.select("file", head.alias("h")).groupBy("file").agg(F.max(F.when(F.col("h._header"), F.col("h.chunk_count"))).alias("expected"), F.count_if(~F.coalesce(F.col("h._header"), F.lit(False))).alias("found"))
    return g.withColumn("whole", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)))


def rows(lines: DataFrame) -> DataFrame:
    """Chunk rows of the files that are whole."""
    good = completeness(lines).filter("whole").select("file")
    r = F.from_json("value", ROW)
    return lines.join(good, "file", "left_semi").select("file", r.alias("r")).filter("r._header IS NULL OR NOT r._header").select("file", "r.*").drop("_header")


def write(chunks: DataFrame, book: str, path: str) -> None:
    """A file group for each book; the committer makes each write atomic. The header carries the row count."""
    n = chunks.groupBy(book).agg(F.count(F.lit(1)).alias("__n"))
    head = n.select(F.col(book).alias("__b"), F.lit(0).alias("__k"), F.to_json(F.struct(F.lit(True).alias("_header"), F.col(book).alias("book_id"), F.col("__n").alias("chunk_count"))).alias("value"))
    body = chunks.select(F.col(book).alias("__b"), F.lit(1).alias("__k"), F.to_json(F.struct(*[c for c in chunks.columns])).alias("value"))
    head.union(body).repartition("__b").sortWithinPartitions("__b", "__k").select("__b", "value").write.mode("overwrite").partitionBy("__b").text(path)


def patch_comments(lines: DataFrame, comments: DataFrame) -> DataFrame:
    """lines (file, book_id, value, chunk_type) with comment rows replaced by those of comments (book_id, value) for the books it has."""
    books = comments.select("book_id").distinct()
    kept = lines.join(books.withColumn("__new", F.lit(True)), "book_id", "left").filter("chunk_type <> 'calibre_comment' OR __new IS NULL").drop("__new")
    files = lines.select("file", "book_id").distinct()
    return kept.unionByName(files.join(comments, "book_id").withColumn("chunk_type", F.lit("calibre_comment")).select(kept.columns))
