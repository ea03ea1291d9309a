"""Predicates over chunk tables and catalogues; all of them Columns that Catalyst can push down."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMENT, ANNOTATION, CONTENT, CHILD, PARENT, STUB, EXCHANGE = "calibre_comment", "annotation", "content", "child", "parent", "phase1_metadata", "exchange"
MIN_CHUNK_CHARS = 100


def resolve_book_id(value: str | int) -> tuple[str | None, int | None, str]:
    """A digit string names a number: (None, number, text); else (text, None, text)."""
    s = str(value)
    return (None, int(s), s) if s.isdigit() else (s, None, s)


def resolved_book_ids(value: Column) -> Column:
    """resolve_book_id for a column: a struct of text, number and name. Digits beyond a long's range stay a text."""
    number = F.when(value.rlike("^[0-9]+$"), value.try_cast("long"))
    return F.struct(F.when(number.isNull(), value).alias("book_id"), number.alias("number"), value.alias("name"))


def chunk_filter(book_id: str | None = None, source_id: str | None = None, calibre_id: int | None = None, section: str | None = None, chunk_type: str | None = None, language: str | None = None) -> Column:
    """Conjunction of the given conditions; virtual names stand for several stored values, and languages may be a list with commas."""
    parts: list[Column] = []
    if book_id is not None:
        parts.append(F.col("book_id") == book_id)
    if source_id is not None:
        own = F.col("source_id") == source_id
        parts.append(own | (F.col("calibre_id") == int(source_id)) if source_id.isdigit() else own)
    elif calibre_id is not None:
        parts.append(F.col("calibre_id") == calibre_id)
    if section:
        parts.append(F.col("section_type").isin("main_content", "") if section == "main" else F.col("section_type") == section)
    if chunk_type:
        both = {"content": (CONTENT, CHILD), "annotations_and_comments": (ANNOTATION, COMMENT)}.get(chunk_type, (chunk_type,))
        parts.append(F.col("chunk_type").isin(*both))
    if language:
        parts.append(F.col("language").isin(*[x.strip() for x in language.split(",")]) if "," in language else F.col("language") == language)
    return reduce(and_, parts, F.lit(True))


def tag_list(tags: Column) -> Column:
    """Lower-cased, trimmed names of a comma-separated list."""
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")


def has_all_tags(tags: Column, wanted: Iterable[str]) -> Column:
    own = [w.strip().lower() for w in wanted if w.strip()]
    return F.size(F.array_except(F.array(*[F.lit(w) for w in own]), tag_list(tags))) == 0 if own else F.lit(True)


def has_any_tag(tags: Column, unwanted: Iterable[str]) -> Column:
    own = [w.strip().lower() for w in unwanted]
    return F.arrays_overlap(tag_list(tags), F.array(*[F.lit(w) for w in own])) if own else F.lit(False)


def long_enough(text: Column, least: int = MIN_CHUNK_CHARS) -> Column:
    return F.length(text) >= least


def min_similarity(df: DataFrame, least: float, mode: str) -> DataFrame:
    """Rows of at least that similarity; only vector scores are comparable."""
    return df.filter(F.col("similarity") >= least) if mode == "semantic" and least > 0 else df


def min_rerank(df: DataFrame, least: float) -> DataFrame:
    """Rows whose rerank score reaches the bound; rows without one stay."""
    return df.filter(F.col("rerank_score").isNull() | (F.col("rerank_score") >= least))


def rating_filter(rating: Column, least: int | None = None, exact: int | None = None) -> Column:
    """Stars; a stored rating is two a star, and null is 0 stars."""
    if exact is not None:
        return rating.isNull() | (rating == 0) if exact == 0 else rating == exact * 2
    return rating >= least * 2 if least else F.lit(True)


def priority_match(title: Column, author: Column, tags: Column, titles: Iterable[str] = (), authors: Iterable[str] = (), exact_tags: Iterable[str] = ()) -> Column:
    """Whether a book is of a named author or title (fragments), or has a named tag (exactly)."""
    frag = lambda c, xs: reduce(lambda a, x: a | F.coalesce(F.lower(c).contains(x.lower()), F.lit(False)), xs, F.lit(False))
    return frag(title, titles) | frag(author, authors) | has_any_tag(tags, exact_tags)


def with_citation(df: DataFrame) -> DataFrame:
    """citation (label before page), is_page, and a warning for labels that were inferred."""
    label, page = F.nullif(F.col("page_label"), F.lit("")), F.nullif(F.col("page_number"), F.lit(0))
    source = F.coalesce(F.col("label_source"), F.lit("")) if "label_source" in df.columns else F.lit("")
    inferred = label.isNotNull() & (source != "") & ~source.isin("printed", "link", "toc", "catalogue")
    return df.withColumns({"citation": F.coalesce(label, page.cast("string")), "is_page": label.isNull() & page.isNotNull(), "warning": F.when(inferred, "page label inferred, not printed")})
