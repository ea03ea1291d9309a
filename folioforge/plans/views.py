"""A document library's tables as views over the driver's tables, one SQL text for Spark and DuckDB."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "chunks": """SELECT doc_id AS id, source AS book_id, doc_id AS chunk_index, text, lang AS language, CAST(doc_id % 300 + 1 AS INT) AS page_number,
 CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN CAST(doc_id % 300 + 1 AS STRING) ELSE CAST(doc_id % 300 + 13 AS STRING) END AS page_label,
 CASE doc_id % 10 WHEN 0 THEN 'calibre_comment' WHEN 1 THEN 'annotation' WHEN 2 THEN 'child' WHEN 3 THEN 'parent' WHEN 4 THEN 'phase1_metadata' WHEN 5 THEN 'exchange' ELSE 'content' END AS chunk_type,
 CASE doc_id % 7 WHEN 0 THEN 'front_matter' WHEN 1 THEN 'back_matter' WHEN 2 THEN '' ELSE 'main_content' END AS section_type,
 CASE WHEN doc_id % 10 = 2 THEN doc_id + 1 END AS parent_id, concat(lang, ', ', source) AS tags,
 CAST(date '2024-01-01' + CAST(doc_id % 97 AS INT) AS STRING) AS indexed_at, concat('h', CAST(doc_id % 5 AS STRING)) AS metadata_hash,
 CASE WHEN doc_id % 10 = 1 THEN concat('a', CAST(doc_id % 3 AS STRING)) ELSE '' END AS annotation_hash FROM documents""",
    "chunk_vectors": """SELECT d.doc_id AS id, e.embedding AS vector FROM documents d CROSS JOIN (SELECT count(*) AS n FROM embeddings) m JOIN embeddings e ON e.vec_id = d.doc_id % m.n""",
    "books_authors": """SELECT DISTINCT l_partkey AS book, l_suppkey AS author FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R'""",
    "books": """SELECT p_partkey AS id, p_name AS title, p_brand AS publisher, p_type AS tag, CASE WHEN p_size % 6 = 0 THEN NULL ELSE CAST(p_size % 6 * 2 AS INT) END AS rating,
 CASE p_partkey % 3 WHEN 0 THEN 'PDF' WHEN 1 THEN 'EPUB' ELSE 'MOBI' END AS format, CAST(p_size AS STRING) AS series, o.pubdate
 FROM part LEFT JOIN (SELECT l_partkey, min(o_orderdate) AS pubdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey) o ON l_partkey = p_partkey""",
    "authors": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "annotations": """SELECT doc_id AS id, source AS book_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN lang WHEN doc_id % 11 = 0 THEN concat('Chapter ', source) ELSE text END AS highlight,
 CASE WHEN doc_id % 3 = 0 THEN concat(source, ' says ', text) ELSE '' END AS note, CASE doc_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'highlight' ELSE 'bookmark' END AS kind,
 CAST(doc_id % 100 AS DOUBLE) / 100 AS pos_frac, CAST(doc_id % 8 AS INT) AS spine_index FROM documents""",
    "turns": "SELECT conv_id, turn, role, text FROM conversations",
}
#: Views that a view reads.
_NEEDS = {name: [v for v in VIEWS if v != name and re.search(rf"\b(?:FROM|JOIN) {v}\b", sql)] for name, sql in VIEWS.items()}


class Tables:
    """The base tables and views of a folder, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            else:
                self._made[name] = self.sql(VIEWS[name])
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """A query over tables and views, bound to this folder."""
        used = {n for n in (*BASE, *VIEWS) if re.search(rf"\b(?:FROM|JOIN) {n}\b", text)}
        bound = re.sub(r"\b(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 {\2}", text) if used else text
        return self.spark.sql(bound, **{n: getattr(self, n) for n in used})

    @cached_property
    def name(self) -> str:
        return self.dir


def oracle(body: str) -> str:
    """DuckDB SQL: the views that the body reads, as common table expressions, and the body."""
    ctes: list[str] = []

    def add(name: str) -> None:
        if name not in ctes:
            for v in _NEEDS[name]:
                add(v)
            ctes.append(name)

    for v in VIEWS:
        if re.search(rf"\b{v}\b", body):
            add(v)
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in ctes)
    if not head:
        return body
    body = body.strip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
