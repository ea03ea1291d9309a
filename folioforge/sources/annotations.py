"""Annotations from viewer side files and attribute-value catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

_ITEM = "type string, highlighted_text string, notes string, timestamp string, spine_index int, pos_frac double, cfi string"
_LIST, _BOX = f"array<struct<{_ITEM.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')}>>", "annotations"
#: Kinds of the attribute-value catalogue. Fixed values.
KINDS = {1: "highlight", 2: "note", 3: "image", 4: "ink", 5: "underline", 6: "text"}


def path_hash(path: Column) -> Column:
    """The name of a book's side file."""
    return F.sha2(path.cast("binary"), 256)


def read_viewer(spark: SparkSession, path: str) -> DataFrame:
    """hash (the file's name), k and fields of the annotations in viewer files: a list, or a list in a box."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("hash"), "value")
    listed = F.coalesce(F.when(F.trim("value").startswith("["), F.from_json("value", _LIST)), F.from_json(F.get_json_object("value", "$.annotations"), _LIST))
    return raw.select("hash", F.posexplode(listed).alias("k", "a")).select("hash", "k", "a.*")


def highlights(rows: DataFrame) -> DataFrame:
    return rows.filter("type = 'highlight'")


def noted(rows: DataFrame) -> DataFrame:
    """Notes, and anything that has one."""
    return rows.filter((F.col("type") == "note") | (F.coalesce(F.trim("notes"), F.lit("")) != ""))


def bookmarks(rows: DataFrame) -> DataFrame:
    return rows.filter("type = 'bookmark'")


def combine(viewer: DataFrame, embedded: DataFrame) -> DataFrame:
    return viewer.withColumn("source", F.lit("viewer")).unionByName(embedded.withColumn("source", F.lit("pdf")), allowMissingColumns=True)


def by_book(rows: DataFrame, books: DataFrame) -> DataFrame:
    """rows with the book (id, path) whose path's hash names their file."""
    return rows.join(books.select(F.col("id").alias("book_id"), path_hash(F.col("path")).alias("hash")), "hash")


def annotated_books(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "hash")


def catalogue_annotations(annotations: DataFrame, notes: DataFrame) -> DataFrame:
    """item, type, text, note, page: annotations with text or comment, and item notes as plain text."""
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    some = annotations.filter((F.coalesce("text", F.lit("")) != "") | (F.coalesce("comment", F.lit("")) != ""))
    page = F.coalesce(F.col("page_label").try_cast("int"), F.regexp_extract("sort_index", r"^(\d+)", 1).try_cast("int") + 1)
    a = some.select("item", F.coalesce(kinds[F.col("type")], F.lit("highlight")).alias("type"), "text", F.col("comment").alias("note"), page.alias("page"))
    n = notes.select("item", F.lit("note").alias("type"), T.clean_html(F.col("note")).alias("text"), F.lit("").alias("note"), F.lit(None).cast("int").alias("page"))
    return a.unionByName(n.filter("text <> ''"))


def split_footer(text: Column) -> Column:
    """A note without the footer line that names its book."""
    return F.regexp_replace(text, r"(?s)\n+\s*[-–—]\s*[^\n]+\([^\n()]+\)\s*$", "")
