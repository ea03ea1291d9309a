"""Book files: format detection, text files, EPUB, embedded metadata."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: File extensions in order of preference.
PREFERENCE = ("pdf", "epub", "mobi", "azw3", "djvu", "txt", "md", "html", "htm", "docx", "rtf")


def read_files(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """path, modified, size, content of all files below a folder; content is only read where it is used."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    return r.load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def detect_format(path: Column, content: Column) -> Column:
    """By extension where that decides, else by first bytes; archives by what is in them."""
    ext = extension(path)
    head = lambda n: F.substring(content, 1, n)
    is_bytes = lambda h: head(len(h) // 2) == F.unhex(F.lit(h))
    start = F.decode(head(200), "ISO-8859-1")
    zipped = is_bytes("504B0304")
    return (
        F.when(ext.isin("md", "txt", "txtz"), ext)
        .when(is_bytes("25504446"), "pdf")
        .when(zipped & start.contains("application/epub+zip"), "epub")
        .when(zipped & start.contains("word/"), "docx")
        .when(zipped, F.when(ext.isin("epub", "docx"), ext).otherwise("zip"))
        .when(F.decode(F.substring(content, 61, 8), "ISO-8859-1") == "BOOKMOBI", "mobi")
        .when(is_bytes("41542654"), "djvu")
        .when(is_bytes("7B5C727466"), "rtf")
        .when(F.lower(start).rlike(r"(?s)^\s*(<!doctype html|<html)"), "html")
        .otherwise(F.nullif(ext, F.lit("")))
    )


def primary_files(files: DataFrame) -> DataFrame:
    """folder and the file of its most preferred format."""
    order = F.array_position(F.array(*[F.lit(x) for x in PREFERENCE]), extension(F.col("path")))
    rows = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), "path", order.alias("o")).filter("o > 0")
    return rows.groupBy("folder").agg(F.min_by("path", F.struct("o", "path")).alias("path"), F.array_sort(F.collect_set(extension(F.col("path")))).alias("formats"))


def clean_text_file(text: Column) -> Column:
    """Without byte order mark and front matter, with plain line ends."""
    plain = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return F.regexp_replace(plain, r"(?s)^---\n.*?\n---\n?", "")


def decode_text(content: bytes | None) -> str:
    """UTF-8, else UTF-16 by its mark, else the Western single-byte code."""
    raw = content or b""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def section_number(title: Column) -> Column:
    return F.regexp_extract(title, r"^(\d+(?:\.\d+)*)", 1)


def split_by_headings(rows: DataFrame) -> DataFrame:
    """id, section, heading and text of texts (id, text, headings), cut before each paragraph that is one of their headings.

    White space within a paragraph doesn't matter. What comes before the first heading is a section without one; a text
    without headings is one section. Each text is cut in its row, in one pass.
    """
    flat = lambda x: T.strip(F.regexp_replace(x, r"(?U)\s+", " "))
    paras = F.split(F.coalesce("text", F.lit("")), "\n\n")
    known = F.transform(F.coalesce("headings", F.array().cast("array<string>")), flat)
    cut = rows.select("id", paras.alias("p"), known.alias("h"))
    starts = F.filter(F.transform("p", lambda x, i: F.when(F.array_contains("h", flat(x)), i)), lambda x: x.isNotNull())
    cut = cut.withColumn("s", starts)
    # a section from each start to the next; one from 0 if no heading stands there
    cut = cut.withColumn("s", F.when((F.size("s") > 0) & (F.get("s", 0) == 0), F.col("s")).otherwise(F.concat(F.array(F.lit(0)), "s")))
    end = lambda i: F.coalesce(F.get("s", i + 1), F.size("p"))
    parts = F.transform("s", lambda a, i: F.struct(F.when(F.array_contains("h", flat(F.get("p", a))), T.strip(F.get("p", a))).alias("heading"), F.array_join(F.slice("p", a + 1, end(i) - a), "\n\n").alias("text")))
    return cut.select("id", F.posexplode(parts).alias("section", "x")).select("id", "section", "x.heading", "x.text")


def split_by_anchors(rows: DataFrame) -> DataFrame:
    """id, section, heading and text of pages (id, html, anchors: array of title and anchor), cut at the elements with these ids.

    Anchors that the page doesn't have are left out; of several at one place the first names the section. What comes before the
    first is a section without heading; sections without text are left out. Text is that of `clean_html`.
    """
    def at(a: Column) -> Column:
        """How many characters stand before the tag that has the id."""
        found = F.greatest(*[F.position(F.concat(F.lit(f" id={q}"), a["anchor"], F.lit(q)), F.col("html")) for q in "\"'"])
        before = F.col("html").substr(F.lit(1), found)
        return F.when(found > 0, F.greatest(F.length(before) - F.length(F.substring_index(before, "<", -1)) - 1, F.lit(0)))

    held = F.filter(F.transform("anchors", lambda a, i: F.struct(at(a).alias("at"), i.alias("i"), a["title"].alias("title"))), lambda c: c["at"].isNotNull())
    cut = rows.select("id", F.coalesce("html", F.lit("")).alias("html"), "anchors").select("id", "html", F.array_sort(F.coalesce(held, F.array().cast("array<struct<at:int,i:int,title:string>>"))).alias("c"))
    cut = cut.withColumn("c", F.filter("c", lambda c, i: (i == 0) | (F.get("c", i - 1)["at"] != c["at"])))
    start = F.array(F.struct(F.lit(0).alias("at"), F.lit(-1).alias("i"), F.lit(None).cast("string").alias("title")))
    cut = cut.withColumn("c", F.concat(start, "c"))
    end = lambda i: F.coalesce(F.get("c", i + 1)["at"], F.length("html"))
    parts = F.transform("c", lambda c, i: F.struct(c["title"].alias("heading"), T.clean_html(F.col("html").substr(c["at"] + 1, end(i) - c["at"])).alias("text")))
    return cut.select("id", F.posexplode(F.filter(parts, lambda x: x["text"] != "")).alias("section", "x")).select("id", "section", "x.heading", "x.text")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def read_epub(content: bytes) -> tuple[dict[str, str], list[dict]]:
    """Metadata and chapters (title, text) in reading order, with section titles from the outline."""
    from ..operators.html import read

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf_path = next(e.attrib["full-path"] for e in box.iter() if _local(e.tag) == "rootfile")
        opf, base = ElementTree.fromstring(z.read(opf_path)), posixpath.dirname(opf_path)
        meta: dict[str, str] = {}
        for e in opf.iter():
            name = _local(e.tag)
            if name in ("title", "creator", "publisher", "language", "date") and e.text:
                meta.setdefault(name, e.text.strip())
            if name == "identifier" and e.text and (m := re.search(r"(?:97[89][- ]?)?(?:\d[- ]?){9}[\dXx]", e.text)):
                meta.setdefault("isbn", re.sub("[- ]", "", m[0]))
        files = {e.attrib["id"]: e.attrib for e in opf.iter() if _local(e.tag) == "item"}
        names = set(z.namelist())
        toc: dict[str, str] = {}
        for item in files.values():
            p = posixpath.normpath(posixpath.join(base, item["href"]))
            if item.get("media-type") == "application/x-dtbncx+xml" and p in names:
                for point in (e for e in ElementTree.fromstring(z.read(p)).iter() if _local(e.tag) == "navPoint"):
                    src = next(e.attrib["src"] for e in point.iter() if _local(e.tag) == "content")
                    label = next((e.text or "" for e in point.iter() if _local(e.tag) == "text"), "")
                    toc.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(p), src.partition("#")[0])), label.strip())
        chapters, title = [], ""
        for ref in (e.attrib["idref"] for e in opf.iter() if _local(e.tag) == "itemref"):
            p = posixpath.normpath(posixpath.join(base, files[ref]["href"])) if ref in files else ""
            if p in names:
                title = toc.get(p, title)
                chapters.append({"title": title, "text": read(z.read(p).decode("utf-8", "replace"))[2]})
    return meta, chapters


def epub_chapters(files: DataFrame) -> DataFrame:
    """path, chapter, title, text of EPUB files; a file that can't be read gives one row with its error."""

    def run(batches):
        import pyarrow as pa

        names = ["path", "chapter", "title", "text", "error"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            out = []
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out += [(path, k, c["title"], c["text"], None) for k, c in enumerate(read_epub(raw)[1])]
                except Exception as e:  # noqa: BLE001  a bad file is a row, not a failed job
                    out.append((path, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(5)], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, chapter int, title string, text string, error string")
