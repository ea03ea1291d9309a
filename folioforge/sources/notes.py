"""Markdown notes: reading front matter, links and tags; writing conversations and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

FRONT_MATTER = r"(?s)^﻿?---\r?\n(.*?)\r?\n---\r?\n?"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def front_matter(text: Column) -> Column:
    return F.regexp_extract(text, FRONT_MATTER, 1)


def body(text: Column) -> Column:
    return F.regexp_replace(text, FRONT_MATTER, "")


def links_and_tags(notes: DataFrame, key: str) -> DataFrame:
    """key, targets of wikilinks, and inline tags, each once in order of first use."""
    b = body(F.col("text"))
    links = F.array_distinct(F.transform(F.regexp_extract_all(b, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda x: F.trim(x)))
    tags = F.array_distinct(F.regexp_extract_all(b, F.lit(r"(?U)(?<![\w#/&])#([\p{L}_][\w/-]*)"), F.lit(1)))
    return notes.select(key, links.alias("links"), tags.alias("tags"))


def preview(text: Column, longest: int = 300) -> Column:
    """The first paragraph that is no heading."""
    parts = F.filter(F.transform(F.split(body(text), r"\n\s*\n"), T.strip), lambda p: (p != "") & ~p.startswith("#"))
    return F.substring(F.get(parts, 0), 1, longest)


def parse(notes: DataFrame) -> DataFrame:
    """file, front (map of its YAML's fields), links, tags, preview; YAML is read in Arrow batches."""

    def run(batches):
        import pyarrow as pa
        import yaml

        for b in batches:
            fields = []
            for said in b.column(1).to_pylist():
                try:
                    got = yaml.safe_load(said or "") or {}
                except yaml.YAMLError:
                    got = {}
                got = got if isinstance(got, dict) else {}
                fields.append([(str(k), ", ".join(map(str, v)) if isinstance(v, list) else str(v)) for k, v in got.items() if v is not None])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fields, pa.map_(pa.string(), pa.string()))], names=["file", "front"])

    front = notes.select("file", front_matter(F.col("text")).alias("y")).mapInArrow(run, "file string, front map<string,string>")
    rest = links_and_tags(notes, "file").join(notes.select("file", preview(F.col("text")).alias("preview")), "file")
    return front.join(rest, "file")


def render(turns: DataFrame, day: Column, platform: str, title: Column) -> DataFrame:
    """conv_id, name and body of a note for each conversation of turns (conv_id, turn, role, text)."""
    said = F.concat(F.lit("**"), F.initcap("role"), F.lit(":** "), F.col("text"))
    rows = turns.select("conv_id", "turn", said.alias("said"), F.concat(day, F.lit(f"_{platform}_"), T.slug(title), F.lit(".md")).alias("name"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "said"))), lambda x: x["said"]), "\n\n")
    return rows.groupBy("conv_id").agg(F.first("name").alias("name"), body.alias("body"))


def with_front_matter(rendered: DataFrame, title: Column, day: Column, platform: str) -> DataFrame:
    head = F.concat(F.lit("---\ntitle: "), T.json_string(title), F.lit("\ndate: "), day, F.lit(f"\nplatform: {platform}\nchunking_strategy: dialogue\n---\n\n# "), title, F.lit("\n\n"))
    return rendered.withColumn("body", F.concat(head, "body", F.lit("\n")))


def month_folder(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("undated"))


def markdown_results(results: DataFrame) -> DataFrame:
    """rank and a Markdown section of each search result."""
    tags = F.array_join(F.transform(F.filter(F.split("tags", ", "), lambda x: x != ""), lambda x: F.concat(F.lit("#"), F.regexp_replace(x, r"(?U)[^\w/-]+", "-"))), " ")
    md = F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), F.col("book_id").cast("string"), F.lit("\n\n> "), F.regexp_replace(F.substring("text", 1, 500), "\n", "\n> "), F.lit("\n\n"), tags, F.lit("\n"))
    return results.select("rank", md.alias("markdown"))
