"""Folders of documents with metadata from sidecars, file names or folder names."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import books

SUPPORTED = (*books.PREFERENCE, "txtz")
IGNORED = (".git", ".obsidian", ".trash", "node_modules", "__pycache__")
SIDECAR = "title string, authors array<string>, tags array<string>, comments string, language string, year int, publisher string, timestamps struct<created_at:string, modified_at:string>"
MARKERS = (("metadata.db", "calibre"), ("zotero.sqlite", "zotero"), (".obsidian", "obsidian"))


def adapter_of(path: str) -> str:
    """The kind of library at a local path, by its marker file."""
    return next((kind for name, kind in MARKERS if os.path.exists(os.path.join(path, name))), "folder")


def excluded(rel: Column, patterns: Iterable[str]) -> Column:
    """Whether a path, or its last part, matches one of some shell patterns, in either case."""
    out = F.lit(False)
    base = F.regexp_extract(rel, r"([^/]*)$", 1)
    for p in patterns:
        rx = "(?is)" + re.sub(r"\(\?s:(.*)\)\\[zZ]$", r"^\1$", fnmatch.translate(p.lower()))
        out = out | F.lower(rel).rlike(rx) | F.lower(base).rlike(rx)
    return out


def relative(path: Column, root: str) -> Column:
    bare = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    return F.replace(F.regexp_replace(path, "^file:/*", "/"), F.lit(bare), F.lit(""))


def scan(spark: SparkSession, root: str, exclude: Iterable[str] = (), modified_after: str | None = None) -> DataFrame:
    """id, rel, format, modified, size, title, authors, tags and year of the supported files below root."""
    files = books.read_files(spark, root, modified_after).withColumn("rel", relative(F.col("path"), root))
    ignored = F.lit(False)
    for d in IGNORED:
        ignored = ignored | F.concat(F.lit("/"), "rel").contains(f"/{d}/")
    docs = files.filter(~ignored & books.extension(F.col("rel")).isin(*SUPPORTED) & ~excluded(F.col("rel"), exclude)).drop("content", "path")
    stem = F.regexp_replace("rel", r"\.[^./]+$", "")
    side = files.filter("rel LIKE '%.json'").select(F.regexp_replace("rel", r"(\.[A-Za-z0-9]+)?\.json$", "").alias("__stem"), F.from_json(F.decode("content", "UTF-8"), SIDECAR).alias("s"))
    name = F.regexp_extract(stem, r"([^/]*)$", 1)
    dated, numbered = r"^(\d{4})-\d{2}-\d{2}_[^_]+_(.+)$", r"^\d+_([^_]+)_(.+)$"
    spaced = lambda c: F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))
    folder = F.nullif(F.regexp_extract("rel", r"([^/]+)/[^/]+$", 1), F.lit(""))
    title = F.when(name.rlike(dated), spaced(F.regexp_extract(name, dated, 2))).when(name.rlike(numbered), spaced(F.regexp_extract(name, numbered, 2))).otherwise(name)
    author = F.when(name.rlike(numbered), F.array(F.initcap(F.regexp_extract(name, numbered, 1))))
    j = docs.join(side, stem == F.col("__stem"), "left")
    return j.select(
        F.concat(F.lit("folder:"), F.substring(F.sha2(F.col("rel").cast("binary"), 256), 1, 12)).alias("id"), "rel", books.extension(F.col("rel")).alias("format"), "modified", "size",
        F.coalesce("s.title", title).alias("title"), F.coalesce(F.col("s.authors"), author, F.array().cast("array<string>")).alias("authors"), F.coalesce(F.col("s.tags"), F.when(folder.isNotNull(), F.array(folder)), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.col("s.year"), F.nullif(F.regexp_extract(name, dated, 1), F.lit("")).cast("int")).alias("year"),
    )
