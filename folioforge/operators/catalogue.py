"""Catalogue scans and analytics over normalised and attribute-value catalogues."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import lru_cache, reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions.fold import fold
from . import tables


def ordered_names(links: DataFrame, names: DataFrame, book: str, link: str, alias: str) -> DataFrame:
    """book and a list of names in link order."""
    joined = links.select(F.col(book).alias("book"), F.col(link).alias("__id")).join(names.select(F.col("id").alias("__id"), "name"), "__id")
    return joined.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("__id", "name"))), lambda x: x["name"]).alias(alias))


def with_lists(books: DataFrame, relations: Mapping[str, DataFrame], defaults: bool = True) -> DataFrame:
    """books with a list column of each relation (book, list); books without one get an empty list."""
    out = books
    for alias, rel in relations.items():
        out = out.join(rel.withColumnRenamed("book", "__book"), out["id"] == F.col("__book"), "left").drop("__book")
        if defaults:
            out = out.withColumn(alias, F.coalesce(F.col(alias), F.array().cast("array<string>")))
    return out


def list_documents(books: DataFrame, relations: Mapping[str, DataFrame], tag: str | None = None, exclude_tag: str | None = None) -> DataFrame:
    """All books with their lists; only those with a tag, without those with another."""
    out = with_lists(books, relations)
    if tag is not None:
        out = out.filter(F.array_contains("tags", tag))
    return out.filter(~F.array_contains("tags", exclude_tag)) if exclude_tag is not None else out


def subtree(spark, tree: DataFrame, root: str) -> DataFrame:
    """Ids of the collection of that name and all below it; tree has id, name, parent."""
    return spark.sql("WITH RECURSIVE t(id) AS (SELECT id FROM {tree} WHERE name = {root} UNION ALL SELECT c.id FROM {tree} c JOIN t ON c.parent = t.id) SELECT DISTINCT id FROM t", tree=tree, root=root)


def pivot_attributes(values: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Item rows of an attribute-value table (item, field, value)."""
    return values.groupBy("item").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def count_by(links: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """id, name and number of books, by id: two authors of one name stay two."""
    n = links.groupBy(F.col(key).alias("id")).agg(F.countDistinct("book").alias("n"))
    return n.join(names.select("id", "name"), "id")


def rating_histogram(books: DataFrame) -> DataFrame:
    return books.filter(F.col("rating").isNotNull()).groupBy((F.col("rating") / 2.0).alias("stars")).agg(F.count(F.lit(1)).alias("n"))


def year_histogram(books: DataFrame) -> DataFrame:
    return books.filter(F.col("pubdate").isNotNull()).groupBy(F.date_format("pubdate", "yyyy").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def missing_metadata(books: DataFrame, present: Mapping[str, DataFrame]) -> DataFrame:
    """Books that lack something, with the list of what; `present` has the books (book) that have each."""
    out = books
    for name, rel in present.items():
        out = out.join(rel.select(F.col("book").alias("__b"), F.lit(True).alias(f"__{name}")).distinct(), out["id"] == F.col("__b"), "left").drop("__b")
    lacks = F.array_compact(F.array(*[F.when(F.col(f"__{n}").isNull(), F.lit(n)) for n in present]))
    return out.select("id", "title", F.array_join(lacks, ",").alias("missing")).filter("missing <> ''")


def analysis(parts: Mapping[str, DataFrame]) -> DataFrame:
    """A whole library's counts in one table: part, value, n of each part (its value in the first column, its count in `n`)."""
    rows = [df.select(F.lit(name).alias("part"), F.col(df.columns[0]).cast("string").alias("value"), F.col("n").cast("long").alias("n")) for name, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def by_path(books: DataFrame, paths: DataFrame) -> DataFrame:
    """path and id of the books whose folder (the first two parts of its path) a file's path begins with."""
    folder = lambda c: F.substring_index(F.col(c), "/", 2)
    own = books.select("id", folder("path").alias("folder"))
    return paths.select("path", folder("path").alias("folder")).join(own, "folder", "left").select("path", "id")


def books_by_author(books: DataFrame, links: DataFrame, authors: DataFrame, author: str, tag: str | None = None, year_from: int | None = None, year_to: int | None = None, sort_by: str = "title") -> DataFrame:
    """Books of authors whose name holds a fragment, in either case, within tags and years; sorted."""
    named = links.join(authors.filter(F.lower("name").contains(author.lower())).select(F.col("id").alias("author")), "author").select("book")
    out = books.withColumn("year", F.year("pubdate")).join(named, F.col("id") == F.col("book"), "left_semi")
    if tag:
        out = out.filter(F.lower("tag").contains(tag.lower()))
    if year_from is not None:
        out = out.filter(F.col("year") >= year_from)
    if year_to is not None:
        out = out.filter(F.col("year") <= year_to)
    return out.orderBy(*(["title", "id"] if sort_by == "title" else ["year", "title", "id"]))


def duplicates(books: DataFrame, key: Column) -> DataFrame:
    """key and the sorted ids of the books that share it; a null or empty key is shared by none."""
    k = books.select("id", key.alias("key")).filter("key IS NOT NULL AND key <> ''")
    return k.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)


def tag_instructions(books: DataFrame, key: Column, tag: str = "duplicate") -> DataFrame:
    """id, key and the command that tags each book but the first of those that share a key; books are counted, not gathered."""
    keyed = books.select("id", key.alias("key")).filter("key IS NOT NULL AND key <> ''")
    first = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = keyed.join(first, "key").filter("id <> first")
    return later.select("id", "key", F.concat(F.lit("calibredb set_metadata "), F.col("id").cast("string"), F.lit(f" --field tags:+{tag}")).alias("command"))


#: Books of a block, about: a task holds the pairs of two blocks at most.
BLOCK = 200


def duplicate_pairs(identifiers: DataFrame) -> DataFrame:
    """Pairs of books that share an identifier's type and value, the lesser first.

    The books of an identifier are dealt into blocks of about BLOCK; each block meets itself and each other one in a unit of its
    own, and units are dealt over all tasks, however many books share the identifier.
    """
    spark = identifiers.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    key, unit = ["type", "val"], ["type", "val", "__low", "__high"]
    own = identifiers.filter("type IS NOT NULL AND val IS NOT NULL AND book IS NOT NULL")
    large = own.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("__n")).filter("__n > 1")
    dealt = own.join(large, key, "left").select(*key, "book", F.coalesce("__n", F.lit(1)).alias("__n")).withColumn("__side", F.pmod(F.xxhash64("book"), "__n"))
    blocks = dealt.groupBy(*key, "__n", "__side").agg(F.collect_list("book").alias("__books"))
    each = blocks.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    sides = each.select(*key, F.least("__side", "__other").alias("__low"), F.greatest("__side", "__other").alias("__high"), "__books")
    # the number is given, since units are few bytes and many pairs: partitions aren't to be merged by their bytes
    met = sides.repartition(parts, "val", "__low", "__high").groupBy(*unit).agg(F.min("__books").alias("__xs"), F.max("__books").alias("__ys"), F.count(F.lit(1)).alias("__sides"))
    both = met.filter("__low = __high OR __sides = 2").select(*unit, F.explode("__xs").alias("__x"), "__ys").select(*unit, "__x", F.explode("__ys").alias("__y"))
    # books of two blocks differ, so either may be the lesser; in a block each pair comes both ways
    return both.filter("__low < __high OR __x < __y").select(F.least("__x", "__y").alias("book1"), F.greatest("__x", "__y").alias("book2"), *key)


def title_author_key(title: Column, authors: Column) -> Column:
    return F.concat_ws("|", T.normalize_title(title), F.array_join(F.array_sort(F.transform(authors, lambda a: F.lower(a))), ";"))


def prefix_match(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path and the source of its longest root; roots has source and root. A path's prefixes of the lengths that roots have are matched by an equi-join."""
    lengths = [r[0] for r in roots.select(F.length("root")).distinct().collect()]  # no more than a path has characters
    own = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]) if lengths else F.array().cast("array<string>")
    cut = paths.select("path", F.explode_outer(F.array_compact(own)).alias("root")).join(roots, "root", "left")
    return cut.groupBy("path").agg(F.max_by("source", F.when(F.col("source").isNotNull(), F.struct(F.length("root"), "source"))).alias("source"))


def match_books(entries: DataFrame, books: DataFrame) -> DataFrame:
    """Entries (entry, title, author, asin) with the book they are of: by asin, else by normalised title with the author's name.

    Of several books the least id wins. Equi-joins only, and on either side a row for each different title and author, however many
    entries and books have them; `fuzzy_match` handles what is left.
    """
    none = F.lit(None).cast(books.schema["id"].dataType)
    by_asin = entries.filter("asin IS NOT NULL").join(books.filter("asin IS NOT NULL").groupBy("asin").agg(F.min("id").alias("__a")), "asin")
    keyed = entries.select("entry", T.normalize_title(F.col("title")).alias("__t"), F.coalesce(F.lower("author"), F.lit("")).alias("__author"))
    titles = books.groupBy(T.normalize_title(F.col("title")).alias("__t"), F.lower("author").alias("__bauthor")).agg(F.min("id").alias("__bid"))
    ok = (F.col("__author") == "") | F.col("__bauthor").contains(F.col("__author")) | F.col("__author").contains(F.col("__bauthor"))
    by_title = keyed.select("__t", "__author").distinct().join(titles, "__t").filter(ok).groupBy("__t", "__author").agg(F.min("__bid").alias("__b"))
    both = keyed.join(by_title, ["__t", "__author"], "left").select("entry", none.alias("__a"), "__b").unionByName(by_asin.select("entry", "__a", none.alias("__b")))
    best = both.groupBy("entry").agg(F.min("__a").alias("__a"), F.min("__b").alias("__b"))
    return best.select("entry", F.coalesce("__a", "__b").alias("book"), F.when(F.col("__a").isNotNull(), "asin").when(F.col("__b").isNotNull(), "title").alias("how"))


def token_sort(text: Column) -> Column:
    return F.array_join(F.array_sort(T.words(T.normalize_title(text))), " ")


#: Different q-grams whose counts are sent to all tasks; those of more are joined by a shuffle.
MOST_GRAMS = 200_000


def _sharing_rare_grams(x: DataFrame, y: DataFrame, by: Sequence[str], q: int, lost: Callable[[Column], Column], near: Column) -> DataFrame:
    """by, __x, __x_grams, __y, __y_grams of pairs that have one of their rarest padded q-grams in common, and are `near`.

    lost(length): how many of its different q-grams a text of that length can lack in a text that it is close to. The rarest
    q-gram that both have is then, in any one order, among the first lost + 1 of either: only those are joined.
    """
    by = list(by)

    def grams(df: DataFrame, key: str) -> DataFrame:
        chars = F.split(F.concat(F.lit("^" * (q - 1)), F.col(key), F.lit("$" * (q - 1))), "")
        # each list is made once for a text, so that time is linear in its length
        shifted = F.arrays_zip(*[F.slice(chars, F.lit(k + 1), F.greatest(F.length(key) + q - 1, F.lit(1))).alias(f"c{k}") for k in range(q)])
        cut = F.transform(shifted, lambda z: F.concat_ws("", *[z[f"c{k}"] for k in range(q)]))
        return df.select(*by, key, F.array_distinct(cut).alias(f"{key}_grams"))

    gx, gy = grams(x, "__x"), grams(y, "__y")
    counts = gx.select(F.explode("__x_grams").alias("__g")).union(gy.select(F.explode("__y_grams"))).groupBy("__g").agg(F.count(F.lit(1)).alias("__c"))
    if counts.count() <= MOST_GRAMS:
        counts = F.broadcast(counts)

    def rarest(df: DataFrame, key: str) -> DataFrame:
        ordered = df.select(*by, key, F.explode(f"{key}_grams").alias("__g")).join(counts, "__g").groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct("__c", "__g"))).alias("__gs"))
        return ordered.select(*by, key, F.explode(F.transform(F.slice("__gs", F.lit(1), lost(F.length(key)) + 1), lambda s: s["__g"])).alias("__g"))

    pairs = rarest(gx, "__x").join(rarest(gy, "__y"), [*by, "__g"]).filter(near).select(*by, "__x", "__y").distinct()
    return pairs.join(gx, [*by, "__x"]).join(gy, [*by, "__y"])



def _most_edits(n: int, share: float) -> int:
    return int(n * share + 1e-6)


#: Segments meet by the stretch of so many characters in which they stand.
APART = 16


@lru_cache(maxsize=10_000)
def _segment_places(n: int, share: float) -> tuple[tuple[int, list[int], list[int]], ...]:
    """Lengths of the segments of texts that a text of n characters can be close to, and not longer than, where in it they may stand, and in which stretches."""
    found: dict[int, set[int]] = {}
    for m in range(n, int((n + 1) / (1 - share)) + 2):
        most = _most_edits(m, share)
        if (less := m - n) <= most:
            size = m // (most + 1)
            for i in range(most + 1):
                low, high = i * size - min(i, less + most - i), i * size + min(i, most - i - less)
                found.setdefault(size, set()).update(range(max(low, 0), min(high, n - size) + 1))
    return tuple((size, sorted(at), [a // APART for a in sorted(at)]) for size, at in found.items() if at)


@lru_cache(maxsize=10_000)
def _segments(m: int, share: float) -> tuple[tuple[int, list[int], list[int]], ...]:
    """The length of the segments of a text of m characters, where they stand, and each stretch of APART characters where they may stand in a text that is close."""
    most = _most_edits(m, share)
    size = m // (most + 1)
    places = [(i * size, k) for i in range(most + 1) for k in range(max(i * size - i, 0) // APART, (i * size + min(i, most - i)) // APART + 1)]
    return ((size, [at for at, _ in places], [k for _, k in places]),)


#: Rows that are handed on at a time.
KEYS = 200_000
#: Texts longer than this are paired by their lengths and letters: any other text has some segment of theirs.
LONG = 256
#: Counts of a text's trigrams, those that long texts meet with, and texts of a block that meet another one at a time.
TRIGRAMS, BINS, MET = 4093, 2048, 128
#: First characters that are sent to all tasks; more of them are joined by a shuffle.
MOST_HEADS = 200_000
#: A text is looked for by all its characters if they are fewer than twice `head`, else by the first `head` * 2**k, k being DOUBLED at most.
DOUBLED = 5
#: Bits that say which first characters there are, to all tasks: 16 for each of them, up to so many; and bytes of them in a row.
MOST_BITS, SLICE = 1 << 26, 1 << 16
#: Characters whose substrings are hashed at a time.
CHARS = 1 << 16


def _chars(text):
    import numpy as np

    return np.frombuffer(text.as_py().encode("utf-32-le"), dtype="<u4").astype(np.uint64)


def _keys(texts: DataFrame, of: Callable[[int], Iterable[tuple[int, Sequence[int], Sequence[int]]]]) -> DataFrame:
    """__k, __id, __at, __n of substrings of texts (__id, __b, __t): a hash of the substring, of __b and of a stretch, where it stands, and the text's length.

    of(n): lengths, places and stretches of the substrings to take from a text of n characters.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def batch(parts: list):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["__k", "__id", "__at", "__n"])

        parts, held = [], 0
        for b in batches:
            for own, seed, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                chars = _chars(text)
                for length, where, stretches in of(len(chars)):
                    at = np.array(where, dtype=np.int64)
                    key = np.array(stretches, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64((seed ^ length * 0x9E3779B97F4A7C15) % 2**64)
                    for k in range(length):  # wraps at 64 bits
                        key = (key ^ chars[at + k]) * np.uint64(0x100000001B3)
                        key ^= key >> np.uint64(29)
                    key = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)  # the half that is best mixed: keys are most of what is shuffled
                    parts.append((key, np.full(len(at), own, dtype=np.int64), at.astype(np.int32), np.full(len(at), len(chars), dtype=np.int32)))
                    held += len(at)
                    if held >= KEYS:
                        yield batch(parts)
                        parts, held = [], 0
        if parts:
            yield batch(parts)

    return texts.select("__id", "__b", "__t").mapInArrow(run, "__k int, __id long, __at int, __n int")


def _trigram_numbers(chars, bins: int):
    """The trigrams of a text's characters, as numbers below `bins`."""
    x = chars.astype("<i8")
    return ((x[:-2] * 1009 + x[1:-1]) * 1013 + x[2:]) % bins


def _blocks(texts: DataFrame) -> DataFrame:
    """__b, __c, __ids, __ns, __counts: blocks of about `MET` of the texts (__id, __b, __c, __t) of equal __b and __c, with the lengths and the counts of
    the trigrams of each."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, MET):
                b = batch.slice(k, MET)
                chars = [_chars(x) for x in b.column(3)]
                # a count that is cut off makes texts more alike, so none is lost
                counts = [np.minimum(np.bincount(_trigram_numbers(c, BINS), minlength=BINS), 255).astype(np.uint8).tobytes() for c in chars]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(c) for c in chars], pa.int32()), pa.array(counts, pa.binary())], names=["__id", "__b", "__c", "__n", "__counts"])

    def block(table):
        import pyarrow as pa

        one = table.slice(0, 1)
        lists = [pa.array([table.column(c).to_pylist()], t) for c, t in (("__id", pa.list_(pa.int64())), ("__n", pa.list_(pa.int32())))]
        return pa.table([one.column("__b"), one.column("__c"), *lists, pa.array([b"".join(table.column("__counts").to_pylist())], pa.binary())], names=["__b", "__c", "__ids", "__ns", "__counts"])

    dealt = texts.join(texts.groupBy("__b", "__c").agg(F.ceil(F.count(F.lit(1)) / MET).alias("__blocks")), ["__b", "__c"]).withColumn("__block", F.pmod(F.xxhash64("__id"), "__blocks"))
    counted = dealt.select("__id", "__b", "__c", "__t", "__block").repartition("__b", "__c", "__block").select("__id", "__b", "__c", "__t").mapInArrow(run, "__id long, __b long, __c int, __n int, __counts binary")
    blocks = F.ceil(F.count(F.lit(1)).over(W.partitionBy("__b", "__c")) / MET)
    return counted.withColumn("__block", F.pmod(F.xxhash64("__id"), blocks)).groupBy("__b", "__c", "__block").applyInArrow(block, "__b long, __c int, __ids array<long>, __ns array<int>, __counts binary")


def _long_pairs(longer: DataFrame, shorter: DataFrame, share: float) -> DataFrame:
    """__l and __s of texts of equal __b, the first longer than `LONG`, that are close.

    An edit changes the length by one at most, and takes away three trigrams at most and brings three. Texts meet by classes of their lengths,
    in blocks, as counts of their trigrams: texts themselves are compared for those pairs alone that these leave.
    """
    kind = lambda n: F.floor(F.log(n) * (1 / -math.log1p(-share))).cast("int")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                l_ids, l_ns, s_ids, s_ns = (np.array(batch.column(c)[k].as_py()) for c in (0, 1, 3, 4))
                l_counts, s_counts = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint8).reshape(-1, BINS) for c in (2, 5))
                found = []
                for at, n in enumerate(l_ns.tolist()):
                    most = _most_edits(n, share)
                    near = np.flatnonzero((s_ns <= n) & (n - s_ns <= most))
                    own = s_counts[near]
                    apart = (np.maximum(own, l_counts[at]) - np.minimum(own, l_counts[at])).sum(axis=1, dtype=np.int32)
                    near = near[apart + (n - s_ns[near]) <= 6 * most]
                    found.append((np.full(len(near), l_ids[at]), s_ids[near]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)], names=["__l", "__s"])

    a = longer.filter(F.length("__t") > LONG).select("__id", "__b", "__t", kind(F.length("__t")).alias("__c"))
    longest = (F.length("__t") + 1) / (1 - share) + 1
    b = shorter.filter(F.length("__t") > int(LONG * (1 - share) - 2)).select("__id", "__b", "__t", F.explode(F.sequence(kind(F.length("__t")), kind(longest))).alias("__c"))
    names = ["__ids", "__ns", "__counts"]
    x, y = (_blocks(d).select("__b", "__c", *[F.col(n).alias(f"{side}{n}") for n in names]) for side, d in (("l", a), ("s", b)))
    # some tasks' worth of blocks at least: what comes of a block is not told by its size
    met = x.join(y.repartition(y.sparkSession.sparkContext.defaultParallelism * 2, "__b", "__c", "s__ids"), ["__b", "__c"])
    ids = met.select("l__ids", "l__ns", "l__counts", "s__ids", "s__ns", "s__counts").mapInArrow(run, "__l long, __s long").distinct()
    text = lambda d, i, t: d.select(F.col("__id").alias(i), F.col("__t").alias(t))
    return ids.join(text(longer, "__l", "__lt"), "__l").join(text(shorter, "__s", "__st"), "__s").filter(within_edits("__lt", "__st", share)).select("__l", "__s")


def _windows(chars, seeds, head: int):
    """Hashes of the substrings that begin at each of the characters, by length: `head` to less than twice that, then `head` * 2**k. The last ones go
    beyond the end."""
    import numpy as np

    def step(x, y):  # wraps at 64 bits
        z = (x ^ y) * np.uint64(0x100000001B3)
        return z ^ (z >> np.uint64(29))

    ahead = lambda x, k: np.concatenate((x[k:], np.zeros(min(k, len(x)), x.dtype)))
    h = seeds ^ np.uint64(head * 0x9E3779B97F4A7C15 % 2**64)
    for k in range(2 * head - 1):
        h = step(h, ahead(chars, k))
        if k + 1 == head:
            doubled = h
        if k + 1 >= head:
            yield k + 1, h
    for k in range(DOUBLED):
        doubled = step(doubled * np.uint64(0x9E3779B97F4A7C15), ahead(doubled, head << k))
        yield head << (k + 1), doubled


def _head_keys(texts: DataFrame, head: int, inside=None) -> DataFrame:
    """__k, __id, __n: a hash of what each of texts (__id, __b, __t) is looked for by; or, if bits (a broadcast) say which there are, all of those
    inside it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def keys(ids: list[int], seeds: list[int], chars: list):
            n = np.array([len(c) for c in chars])
            of = np.repeat(np.arange(len(n)), n)
            ends, at, found = np.cumsum(n)[of], np.arange(len(of)), []
            for length, h in _windows(np.concatenate(chars), np.array([x % 2**64 for x in seeds], np.uint64)[of], head):
                h = (h >> np.uint64(32)).astype(np.uint32)
                if inside is None:  # the longest there is, where a text begins
                    longest = n >= length if length == head << DOUBLED else (n == length) if length < 2 * head else (n >= length) & (n < 2 * length)
                    where = (ends - n[of])[np.cumsum(n)[longest] - 1]
                else:
                    bits, last = inside.value, h & np.uint32(8 * len(inside.value) - 1)
                    where = np.flatnonzero((bits[last >> np.uint32(3)] >> (last & np.uint32(7)).astype(np.uint8)) & 1)
                    where = where[at[where] + length <= ends[where]]
                found.append(of[where].astype(np.int64) << 32 | h[where])
            found = np.unique(np.concatenate(found))
            own = found >> 32
            return pa.RecordBatch.from_arrays([pa.array((found & 0xFFFFFFFF).astype(np.uint32).view(np.int32)), pa.array(np.array(ids, np.int64)[own]), pa.array(n[own].astype(np.int32))], names=["__k", "__id", "__n"])

        ids, seeds, chars, held = [], [], [], 0
        for b in batches:
            for own, seed, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                c = _chars(text)
                if len(c) < head:
                    continue
                ids.append(own)
                seeds.append(seed)
                chars.append(c)
                held += len(c)
                if held >= CHARS:
                    yield keys(ids, seeds, chars)
                    ids, seeds, chars, held = [], [], [], 0
        if ids:
            yield keys(ids, seeds, chars)

    return texts.select("__id", "__b", "__t").mapInArrow(run, "__k int, __id long, __n int")


def _bits_of(keys: DataFrame, n: int):
    """Bits that n keys (__k) set, by their last bits: MOST_BITS / 8 bytes at most."""
    import numpy as np

    size = min(max(1 << (16 * n).bit_length(), 8 * SLICE), MOST_BITS) // 8

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.zeros(size, np.uint8)
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint32) & np.uint32(8 * size - 1)
            np.bitwise_or.at(bits, at >> np.uint32(3), np.uint8(1) << (at & np.uint32(7)).astype(np.uint8))
        for k in range(0, size, SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits[k : k + SLICE].tobytes()], pa.binary())], names=["at", "bits"])

    def both(table):
        import numpy as np
        import pyarrow as pa

        out = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits")])
        return pa.table([table.column("at")[:1], pa.array([out.tobytes()], pa.binary())], names=["at", "bits"])

    out = np.zeros(size, np.uint8)
    for at, bits in keys.select("__k").mapInArrow(run, "at int, bits binary").groupBy("at").applyInArrow(both, "at int, bits binary").collect():
        out[at : at + SLICE] = np.frombuffer(bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out)


def sharing_segments(longer: DataFrame, shorter: DataFrame, share: float, within: DataFrame | None = None, head: int = 1) -> DataFrame:
    """Pairs of ids, __l and __s, of texts (__id, __b, __t) that may be close, the first as long at least, and have equal __b; `edits` is true.

    A text that is `most` edits at most away from a text of m characters has one of any most + 1 parts of it unchanged, the i-th
    (from 0) with i edits at most before it and most - i behind it: else these would be more in all. So m characters are cut into
    that many segments of equal length, and a segment is looked for among the substrings of the other text that are moved by no more. Texts
    beyond `LONG` characters have too many segments for that (`_long_pairs`).
    Also, with `edits` false, pairs whose first, of `within`, may be within the second: all have `head` characters at least, and
    that text, or the first half of it at least up to some length, is looked for (`_heads`); bits say to all tasks what there is to find. Hashes are
    compared, so that some pairs are not what they seem.
    """
    brief = lambda df: df.filter(F.length("__t") <= LONG) if share else df
    every = _keys(brief(shorter), lambda n: _segment_places(n, share))
    a, b = _keys(brief(longer), lambda m: _segments(m, share)).select("__k", F.col("__id").alias("__l"), F.col("__at").alias("__la"), F.col("__n").alias("__ln")), every.select("__k", F.col("__id").alias("__s"), "__at", "__n")
    most = F.floor(F.col("__ln") * share + 1e-6).cast("int")
    before, moved = F.floor(F.col("__la") / F.floor(F.col("__ln") / (most + 1))).cast("int"), F.col("__la") - F.col("__at")
    less = F.col("__ln") - F.col("__n")
    near = less.between(0, most) & (F.abs(moved) <= before) & (F.abs(less - moved) <= most - before)
    found = a.join(b, "__k").filter(near).select("__l", "__s").distinct()
    found = (found.unionByName(_long_pairs(longer, shorter, share).distinct()) if share else found).withColumn("edits", F.lit(True))
    if within is None:
        return found
    heads, n = _head_keys(within, head).select("__k", F.col("__id").alias("__l"), F.col("__n").alias("__ln")), within.count()
    if not n:
        return found
    grams = _head_keys(shorter, head, _bits_of(heads, n)).select("__k", F.col("__id").alias("__s"), "__n")
    return found.unionByName(grams.join(F.broadcast(heads) if n <= MOST_HEADS else heads, "__k").filter("__n > __ln").select("__l", "__s", F.lit(False).alias("edits")))


def edits_at_most(x: str, y: str, most: int) -> bool:
    """Whether x becomes y by `most` edits: a column of distances at a time, as differences in the bits of whole numbers."""
    if abs(len(x) - len(y)) > most or not x or not y:
        return max(len(x), len(y)) <= most
    places: dict[str, int] = {}
    for k, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << k
    every, last = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, edits = every, 0, len(x)
    for rest, c in zip(range(len(y) - 1, -1, -1), y, strict=True):
        hit = places.get(c, 0)
        level = (((hit & up) + up) ^ up) | hit
        right, left = (down | ~(level | up)) & every, up & level
        edits += bool(right & last) - bool(left & last)
        if edits - rest > most:  # each character that is left takes one off at best
            return False
        right, hit = right << 1 | 1, hit | down
        up, down = (left << 1 | ~(hit | right)) & every, right & hit & every
    return True


@lru_cache(maxsize=512)
def _trigrams(text: str):
    import numpy as np

    x = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return np.bincount(_trigram_numbers(x, TRIGRAMS), minlength=TRIGRAMS).astype(np.int32)


def _too_far(x: str, y: str, most: int) -> bool:
    """Whether a text has more trigrams that the other lacks than `most` edits take away: 3 each."""
    import numpy as np

    return int(np.abs(_trigrams(x) - _trigrams(y)).sum()) + abs(len(x) - len(y)) > 6 * most


def within_edits(a: Column | str, b: Column | str, share: float) -> Column:
    """Whether two texts are at most `share` edits to a character of the longer away from each other. Texts of many thousand characters
    are mostly told apart within their first quarter, which Spark's levenshtein doesn't do."""
    def close(x: str, y: str) -> bool:
        most = _most_edits(max(len(x), len(y), 1), share)
        return x == y or not (min(len(x), len(y)) > LONG and _too_far(x, y, most)) and edits_at_most(x, y, most)

    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([close(x, y) for x, y in zip(xs, ys, strict=True)], dtype="bool")

    return F.pandas_udf(run, "boolean")(a, b)


def close_lines(longer: str, other: str, share: float) -> Column:
    """within_edits where the first text is as long at least, for pairs that `sharing_segments` found: it has compared those of long texts."""
    most = f"CAST(floor(length({longer}) * {share!r}D + 1e-6D) AS INT)"
    return (F.length(longer) > LONG) | F.expr(f"levenshtein({longer}, {other}, {most}) >= 0")


def with_text_ids(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """df stored with __id, a number of each row, __b, a hash of its columns `by`, and __t, its text."""
    return tables.settle(df.withColumns({"__id": F.monotonically_increasing_id(), "__b": F.xxhash64(*by) if by else F.lit(0).cast("long"), "__t": F.col(text)}))


def close_titles(x: DataFrame, y: DataFrame, share: float, by: Sequence[str] = ()) -> DataFrame:
    """All pairs of an __x and a __y with at most `share` edits to a character of the longer, and equal values in the columns `by`.

    Both frames hold distinct texts for each value of `by`. Only pairs that share a segment are compared (`sharing_segments`).
    """
    if not 0 <= share < 1:
        raise ValueError(f"not a share of edits: {share}")
    by = list(by)
    x, y = with_text_ids(x.select(*by, "__x"), "__x", by), with_text_ids(y.select(*by, "__y"), "__y", by)
    filled = lambda df: df.filter("__t <> ''")
    ids = sharing_segments(filled(x), filled(y), share).select(F.col("__l").alias("__i"), F.col("__s").alias("__j")).union(sharing_segments(filled(y), filled(x), share).select("__s", "__l")).distinct()
    left, right = x.select(F.col("__id").alias("__i"), *by, "__x"), y.select(F.col("__id").alias("__j"), *[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], "__y")
    same = reduce(and_, [F.col(c) == F.col(f"__by{k}") for k, c in enumerate(by)], F.lit(True))
    found = ids.join(left, "__i").join(right, "__j").filter(same & within_edits("__x", "__y", share)).select(*by, "__x", "__y")
    nothing = x.filter("__t = ''").join(y.filter("__t = ''").select(*by, "__y"), by) if by else x.filter("__t = ''").crossJoin(y.filter("__t = ''").select("__y"))
    return found.unionByName(nothing.select(*by, "__x", "__y"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """100 times twice the longest common subsequence of two texts, to a character of both. Spark has no expression for it."""

    def common(x: str, y: str) -> int:
        places: dict[str, int] = {}
        for k, c in enumerate(x):
            places[c] = places.get(c, 0) | 1 << k
        every = open_ = (1 << len(x)) - 1  # a bit is cleared where the subsequence grows
        for c in y:
            hit = open_ & places.get(c, 0)
            open_ = ((open_ + hit) | (open_ - hit)) & every
        return len(x) - open_.bit_count()

    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([200.0 * common(x, y) / (len(x) + len(y)) if x and y else 0.0 for x, y in zip(xs, ys, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def close_by_ratio(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """All pairs of an __x and a __y, both distinct and not empty, whose `ratio` is `least` or more, which must be above 200 / 3; with it.

    Of texts of m and n characters, such pairs have a common subsequence of L >= least / 200 * (m + n). Each of the m - L
    characters that only the first has takes two of its padded bigrams away, and each of the n - L that only the second has parts
    two characters and takes one: 2 m + n - 3 L of its m + 1 at most. That is most where the second is within the first, with
    n = m * r / (2 - r) for r = least / 100: 4 m (1 - r) / (2 - r), which is fewer than m + 1, so a bigram is shared.
    """
    r = least / 100
    if not 2 / 3 < r <= 1:
        raise ValueError(f"no bound on pairs of ratio {least}")
    m, n = F.length("__x"), F.length("__y")
    near = F.least(m, n) * (2 - r) >= F.greatest(m, n) * r - 1e-6
    both = _sharing_rare_grams(x, y, (), 2, lambda k: F.floor(k * (4 * (1 - r) / (2 - r)) + 1e-6).cast("int"), near)
    shared, common = F.size(F.array_intersect("__x_grams", "__y_grams")), F.ceil((m + n) * (r / 2) - 1e-6)
    enough = (shared >= F.size("__x_grams") - (2 * m + n - 3 * common)) & (shared >= F.size("__y_grams") - (2 * n + m - 3 * common))
    return both.filter(enough).select("__x", "__y", ratio("__x", "__y").alias("ratio")).filter(F.col("ratio") >= least - 1e-9)


def match_key(text: Column) -> Column:
    """Lower case without accents, punctuation as blanks, blanks collapsed."""
    return T.strip(F.regexp_replace(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def without_edition(title: Column) -> Column:
    """The title without a last parenthesis that names an edition."""
    return F.regexp_replace(title, r"(?iU)\s*\([\w\s]+edition\)\s*$", "")


def _sorted_words(key: str) -> Column:
    return F.array_join(F.array_sort(F.split(key, " ")), " ")


TITLE_SHARE = 0.7


def fuzzy_match(entries: DataFrame, books: DataFrame, least: float = 80.0) -> DataFrame:
    """entry, book, score and how of the best of all books (id, title, author) for entries (entry, title, author); of equal ones the least id.

    Titles and authors are compared without case, accents and punctuation, entries' titles also without the name of an edition, and
    words are sorted. Equal titles whose authors contain one another, or lack, are `exact`, with a score of 100. Else the score is 0.7
    of the titles' ratio and 0.3 of the authors', and the titles' alone where either has no author. A weighted mean that reaches
    `least` has a part that does: so close titles and close authors give all candidates (`close_by_ratio`), whatever the other part.
    """
    def keyed(df: DataFrame, title: Column, name: str) -> DataFrame:
        own = df.withColumn(f"__{name}", match_key(title)).withColumn(f"__{name}a", match_key(F.col("author")))
        return own.filter(F.col(f"__{name}") != "").withColumn(f"__{name}s", _sorted_words(f"__{name}")).withColumn(f"__{name}as", _sorted_words(f"__{name}a"))

    e = keyed(entries, without_edition(F.coalesce("title", F.lit(""))), "x").select("entry", "__x", "__xa", "__xs", "__xas")
    b = keyed(books, F.col("title"), "y").groupBy("__y", "__ya", "__ys", "__yas").agg(F.min("id").alias("book"))
    e, b = tables.settle(e), tables.settle(b)
    values = lambda df, c, to: df.select(F.col(c).alias(to)).filter(F.col(to) != "").distinct()
    titles = tables.settle(close_by_ratio(values(e, "__xs", "__x"), values(b, "__ys", "__y"), least).select(F.col("__x").alias("__xs"), F.col("__y").alias("__ys")))
    authors = tables.settle(close_by_ratio(values(e, "__xas", "__x"), values(b, "__yas", "__y"), least).select(F.col("__x").alias("__xas"), F.col("__y").alias("__yas")))
    pairs = e.join(titles, "__xs").join(b, "__ys").unionByName(e.join(authors, "__xas").join(b, "__yas")).distinct()
    exact = (F.col("__x") == F.col("__y")) & (F.col("__ya").contains(F.col("__xa")) | F.col("__xa").contains(F.col("__ya")))
    alone = (F.col("__xa") == "") | (F.col("__ya") == "")
    title, author = F.col("__t"), F.col("__a")
    scored = pairs.withColumn("__t", ratio("__xs", "__ys")).withColumn("__a", ratio("__xas", "__yas"))
    scored = scored.select("entry", "book", exact.alias("exact"), F.when(exact, 100.0).when(alone, title).otherwise(title * TITLE_SHARE + author * (1 - TITLE_SHARE)).alias("score")).filter(F.col("score") >= least - 1e-9)
    best = scored.groupBy("entry").agg(F.max_by(F.struct("book", "exact", "score"), F.struct("exact", F.round("score", 4), -F.col("book"))).alias("b"))
    return best.select("entry", "b.book", F.round("b.score", 4).alias("score"), F.when(F.col("b.exact"), "exact").otherwise("fuzzy").alias("how"))


# --- bibliography

def bibliography(books: DataFrame, kind: str) -> DataFrame:
    """id and entry: a book in BibTeX, RIS, EndNote, CSV or JSON. Columns: id, title, authors, year, publisher, isbn, tags, formats."""
    line = lambda head, c, tail: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(head), c.cast("string"), F.lit(tail))).otherwise("")
    each = lambda head, xs: F.array_join(F.transform(xs, lambda a: F.concat(F.lit(head), a, F.lit("\n"))), "")
    title, authors, year, publisher, isbn, tags = (F.col(c) for c in ("title", "authors", "year", "publisher", "isbn", "tags"))
    if kind == "bibtex":
        key = T.cite_key(F.get(authors, 0), F.nullif(year, F.lit(0)), title)
        entry = F.concat(F.lit("@book{"), key, F.lit(",\n  title = {"), title, F.lit("},\n"), line("  author = {", F.array_join(authors, " and "), "},\n"), line("  year = {", F.nullif(year, F.lit(0)), "},\n"), line("  publisher = {", publisher, "},\n"), line("  isbn = {", isbn, "},\n"), line("  keywords = {", F.array_join(tags, ", "), "},\n"), F.lit("}"))
    elif kind == "ris":
        entry = F.concat(F.lit("TY  - BOOK\nTI  - "), title, F.lit("\n"), each("AU  - ", authors), line("PY  - ", F.nullif(year, F.lit(0)), "\n"), line("PB  - ", publisher, "\n"), line("SN  - ", isbn, "\n"), each("KW  - ", tags), F.lit("ER  - "))
    elif kind == "endnote":
        entry = F.concat(F.lit("%0 Book\n%T "), title, F.lit("\n"), each("%A ", authors), line("%D ", F.nullif(year, F.lit(0)), "\n"), line("%I ", publisher, "\n"), line("%@ ", isbn, "\n"), each("%K ", tags))
    elif kind == "csv":
        quoted = lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
        fields = [F.col("id").cast("string"), title, F.array_join(authors, "; "), F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("")), F.coalesce(publisher, F.lit("")), F.coalesce(isbn, F.lit("")), F.array_join(tags, "; "), F.array_join(F.col("formats"), "; ")]
        entry = F.concat_ws(",", *[quoted(f) for f in fields])
    elif kind == "json":
        entry = F.to_json(F.struct("id", "title", "authors", "year", "publisher", "isbn", "tags", "formats"))
    else:
        raise ValueError(f"no such format: {kind}")
    return books.select("id", entry.alias("entry"))


def one_text(entries: DataFrame, between: str = "\n\n") -> DataFrame:
    """One row: all entries by id. For selections that a person exports."""
    return entries.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "entry"))), lambda x: x["entry"]), between).alias("text"))


def tag_counts(tags: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """tag and n of (id, tag) rows, by n and then by name."""
    out = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "tag")
    return out.limit(most) if most else out


def custom_fields(columns: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """book and a map label -> value of one table (book, value) for each custom column; comments are cleaned of HTML."""
    parts = [df.select("book", F.lit(label).alias("label"), (T.clean_html(F.col("value")) if kind == "comments" else F.col("value").cast("string")).alias("value")) for label, (kind, df) in columns.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("book").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "value")))).alias("fields"))


def choose_identity(catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """Catalogue values first, those embedded in the file where it has none; isbn_source says which."""
    f = files.select(F.col("id").alias("__f"), *[F.col(c).alias(f"__{c}") for c in ("title", "author", "isbn")])
    j = catalogue.join(f, catalogue["id"] == F.col("__f"), "left")
    pick = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}"))
    source = F.when(F.nullif(F.col("isbn"), F.lit("")).isNotNull(), "catalogue").when(F.col("__isbn").isNotNull(), "file")
    return j.select("id", pick("title").alias("title"), pick("author").alias("author"), pick("isbn").alias("isbn"), source.alias("isbn_source"))


def rank_orders(books: DataFrame) -> Sequence[Column]:
    """Rating tiers first (5, 4, none, the rest), then author and title."""
    tier = F.when(F.col("rating") == 10, 0).when(F.col("rating") == 8, 1).when(F.col("rating").isNull() | (F.col("rating") == 0), 2).otherwise(3)
    return [tier, F.col("author"), F.col("title"), F.col("id")]


def top_by_group(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
