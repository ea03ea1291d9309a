"""What a user calls: a library of chunk and catalogue tables, with search, listings, exports and scans.

Methods return DataFrames; nothing is collected but the single row of a prompt.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import catalogue as cat
from .operators import chunkstore as cs
from .operators import filters as flt
from .operators import lifecycle as life
from .operators import retrieval as ret
from .operators.vectors import Embed, VectorIndex, hashed_embedder
from .sources import annotations as ann

SYSTEM_PROMPT = "Answer from the documents given. Cite each claim by title and page; say so where a page is inferred. Where the documents don't answer, say that."
DUPLICATE_TAG = "duplicate"


@dataclass
class Library:
    chunks: DataFrame
    vectors: DataFrame | None = None
    books: DataFrame | None = None
    annotations: DataFrame | None = None
    #: Stored indexes; without them tables are scanned.
    vector_index: VectorIndex | None = None
    text_index: ret.TextIndex | None = None
    embed: Embed = field(default_factory=hashed_embedder)
    languages: Sequence[str] = ()
    interests: Sequence[str] = ()
    name: str = "library"

    def search(self, query: str, k: int = 10, mode: str = "hybrid", language: str | None = None, book_id: str | None = None, phrase: bool = False, tags: Sequence[str] = (), section: str | None = "main", chunk_type: str | None = "content", per_book: int = 2, least_similarity: float = 0.0) -> DataFrame:
        """Ranked chunks with citations."""
        where = flt.chunk_filter(book_id=book_id, section=section, chunk_type=chunk_type, language=language)
        vector = list(map(float, self.embed([T.clean_query(query, *self.languages)[0]])[0])) if self.vectors is not None else None
        found = ret.search(self.chunks, self.vector_index or self.vectors, query, vector, k, mode, where, tags, per_book, least_similarity, self.languages, phrase, self.text_index)
        return flt.with_citation(ret.interest_boost(found, self.interests) if self.interests else found)

    def build_indexes(self, path: str) -> None:
        """Builds and stores both indexes; searches use them from then on."""
        if self.vectors is not None:
            self.vector_index = VectorIndex.build(self.vectors, f"{path}/vectors")
        self.text_index = ret.TextIndex.build(self.chunks, f"{path}/text")

    def open_indexes(self, path: str) -> None:
        """Takes up indexes that were stored before, in this session or another."""
        if self.vectors is not None:
            self.vector_index = VectorIndex.open(self.vectors.sparkSession, f"{path}/vectors")
        self.text_index = ret.TextIndex.open(self.chunks.sparkSession, f"{path}/text")

    def update_indexes(self, chunks: DataFrame | None = None, vectors: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """New and changed rows come into the stored indexes, ids that are gone leave them; what is stored isn't rewritten."""
        for index, rows, leave in ((self.text_index, chunks, "drop"), (self.vector_index, vectors, "delete")):
            if index is not None and rows is not None:
                index.add(rows)
            if index is not None and gone is not None:
                getattr(index, leave)(gone.select("id"))

    def merge_indexes(self) -> None:
        """The periodic job that puts the indexes' batches together."""
        for index in (self.text_index, self.vector_index):
            if index is not None:
                index.merge()

    def search_with_citations(self, query: str, **kw) -> tuple[str, DataFrame]:
        """The prompt with its documents, and the rows it was made of."""
        rows = ret.expand_context(self.search(query, **kw), self.chunks)
        first = ret.prompt(rows, query).first()
        return f"{SYSTEM_PROMPT}\n\n{first['prompt']}", rows

    def search_annotations(self, query: str, k: int = 30, per_book: int = 5) -> DataFrame:
        return self.search(query, k, "semantic" if self.vectors is not None else "keyword", section=None, chunk_type="annotations_and_comments", per_book=per_book)

    def status(self) -> DataFrame:
        return cs.index_stats(self.chunks)

    def book_list(self) -> DataFrame:
        return cs.indexed_books(self.chunks)

    def chunk(self, chunk_id) -> DataFrame:
        return self.chunks.filter(F.col("id") == chunk_id)

    def book_details(self, book_id) -> DataFrame:
        return self.books.filter(F.col("id") == book_id)

    def tags(self, least: int = 1, most: int | None = None) -> DataFrame:
        return cat.tag_counts(self.chunks.select("id", F.explode(flt.tag_list(F.col("tags"))).alias("tag")), least, most)

    def duplicates(self, method: str = "title_author") -> DataFrame:
        keys = {"isbn": lambda: F.col("isbn"), "exact_title": lambda: F.lower("title"), "title_author": lambda: cat.title_author_key(F.col("title"), F.col("authors"))}
        if method not in keys:
            raise ValueError(f"no such method: {method}")
        return cat.duplicates(self.books, keys[method]())

    def duplicate_tag_instructions(self) -> DataFrame:
        """The commands that tag every later book of those with the same title and authors."""
        return cat.tag_instructions(self.books, cat.title_author_key(F.col("title"), F.col("authors")), DUPLICATE_TAG)

    def duplicate_tag_instruction(self, book_id) -> str:
        return f"calibredb set_metadata {book_id} --field tags:+{DUPLICATE_TAG}"

    def bibliography(self, kind: str = "bibtex", author: str | None = None, tag: str | None = None, year_from: int | None = None, year_to: int | None = None, limit: int | None = None) -> DataFrame:
        out = self.books
        if author:
            out = out.filter(F.exists("authors", lambda a: F.lower(a).contains(author.lower())))
        if tag:
            out = out.filter(F.exists("tags", lambda x: F.lower(x).contains(tag.lower())))
        if year_from is not None:
            out = out.filter(F.col("year") >= year_from)
        if year_to is not None:
            out = out.filter(F.col("year") <= year_to)
        return cat.bibliography(out.orderBy("id").limit(limit) if limit else out, kind)

    def book_annotations(self, file_hash: str, kinds: Sequence[str] = (), drop_noise: bool = True) -> DataFrame:
        rows = self.annotations.filter(F.col("hash") == file_hash)
        if kinds:
            rows = rows.filter(F.col("type").isin(*kinds))
        reason = T.toc_marker_reason(F.col("highlighted_text"), F.col("notes"), F.col("pos_frac"), F.col("spine_index"))
        return rows.filter(reason.isNull()) if drop_noise else rows

    def annotated_books(self) -> DataFrame:
        return ann.annotated_books(self.annotations)

    def annotation_hash(self, file_hash: str) -> DataFrame:
        line = T.annotation_line(F.col("highlighted_text"), F.col("notes"), F.col("type"))
        return self.annotations.filter(F.col("hash") == file_hash).agg(F.coalesce(F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary")), F.lit("")).alias("annotation_hash"))

    def set_interests(self, words: Sequence[str]) -> None:
        self.interests = list(words)

    def scan(self, catalogue: DataFrame, stored: DataFrame, stub_only: DataFrame | None = None) -> DataFrame:
        return life.classify(catalogue, stored, stub_only)


def resolve(libraries: Mapping[str, Library], source: str | None = None, default: str | None = None) -> Library:
    """The library named, or the default, or the only one."""
    key = source or default or (next(iter(libraries)) if len(libraries) == 1 else None)
    if key not in libraries:
        raise KeyError(f"no source {key!r}; there are {sorted(libraries)}")
    return libraries[key]


def search_all(libraries: Mapping[str, Library], query: str, k: int = 10, **kw) -> DataFrame:
    """One ranking over several libraries; each gives 2k candidates."""
    parts = [lib.search(query, 2 * k, **kw).withColumn("source", F.lit(name)) for name, lib in sorted(libraries.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return ret.merge_sources(out, k)
