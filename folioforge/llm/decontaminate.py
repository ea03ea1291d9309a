"""Benchmark decontamination by suffix arrays (operator 3).

Each block of whole documents is a shard with a word-level suffix array, built by prefix
doubling (several ranks packed into a 64-bit key for each round). Every suffix of every
benchmark item is found by binary search, which gives its longest verbatim match and a place;
the suffixes whose match covers a window then give the range of all places of that window.
A suffix with a word near its start that the shard lacks ends its match there; only the rest is searched.
No text is shuffled. The benchmark is read in blocks of at most `ITEM_BYTES`, a task holding one at a time, and
`SENT_BYTES` of blocks are broadcast at once; a larger benchmark means more passes over the documents.

Words are compared as 64-bit hashes in the arrays, and every hit is then confirmed on its bytes.
Null or empty texts have no words and hit nothing; items without words have no windows; items
whose id is null mark words but aren't listed; equal items are each listed. An empty table gives no
rows, an empty benchmark contaminates none. Rows are judged one by one, also where doc_ids are null or
repeated. Columns other than doc_id and text are not read; `remove_contaminated` keeps them whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts

WINDOW = 13
SHARD_BYTES = 4 << 20
#: The same where rows are carried along with all their columns, beside the suffix array.
ROWS_SHARD_BYTES = 1 << 20
#: Text of a block of items, and of all blocks that are broadcast at a time.
ITEM_BYTES, SENT_BYTES = 16 << 20, 256 << 20


class SuffixArray:
    """Suffixes of a shard's word sequence in order of their first `depth` words at least."""

    def __init__(self, words: np.ndarray, first: np.ndarray, depth: int):
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        n_docs = len(first) - 1
        # a separator, 0, follows each document; words count from 1
        self.seq = np.zeros(len(words) + n_docs + 1, np.int64)
        doc = np.repeat(np.arange(n_docs), np.diff(first))
        self.place = np.arange(len(words)) + doc  # of each word in seq
        self.seq[self.place] = ids + 1
        self.word = np.full(len(self.seq), -1, np.int64)
        self.word[self.place] = np.arange(len(words))
        self.order = self._sorted(depth)

    def _sorted(self, depth: int) -> np.ndarray:
        rank, reach, n = self.seq, 1, len(self.seq)
        while True:
            bits = max(1, int(rank.max()).bit_length())
            each = max(2, 63 // bits)
            key = rank.copy()
            for j in range(1, each):
                key <<= bits
                key[: max(0, n - j * reach)] |= rank[min(n, j * reach) :]
            order = np.argsort(key)
            sorted_key = key[order]
            new = np.zeros(n, np.int64)
            new[1:] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
            rank = np.empty(n, np.int64)
            rank[order] = new
            reach *= each
            if reach >= depth or new[-1] == n - 1:
                return order

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words; those the shard lacks get one that matches nothing."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), max(len(self.vocabulary) - 1, 0))
        if not len(self.vocabulary):
            return np.full(len(words), 1, np.int64)
        return np.where(self.vocabulary[at] == words, at + 1, len(self.vocabulary) + 1)

    def _common(self, p: np.ndarray, text: np.ndarray, q: np.ndarray, cap: np.ndarray) -> np.ndarray:
        n, live, j = np.zeros(len(p), np.int64), np.arange(len(p)), 0
        while len(live):
            live = live[j < cap[live]]
            live = live[self.seq[p[live] + j] == text[q[live] + j]]
            n[live] += 1
            j += 1
        return n

    def bound(self, text: np.ndarray, q: np.ndarray, cap: np.ndarray, upper: bool) -> np.ndarray:
        """First place in the order at or above (upper: above) the cap words of text from q."""
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(self.order))
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) // 2
            p, qs, c = self.order[mid], q[live], cap[live]
            n = self._common(p, text, qs, c)
            right = np.where(n == c, upper, self.seq[np.minimum(p + n, len(self.seq) - 1)] < text[qs + n])
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
        return lo

    def longest(self, text: np.ndarray, q: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest match of each suffix of text, and the word where one such match stands."""
        at = self.bound(text, q, cap, upper=False)
        best, where = np.zeros(len(q), np.int64), np.full(len(q), -1, np.int64)
        for shift in (-1, 0):
            near = at + shift
            ok = (near >= 0) & (near < len(self.order))
            p = self.order[near[ok]]
            n = self._common(p, text, q[ok], cap[ok])
            better = n > best[ok]
            best[np.flatnonzero(ok)[better]] = n[better]
            where[np.flatnonzero(ok)[better]] = self.word[p[better]]
        return best, where


class Items:
    """A block of benchmark items: their words, one sequence with an end mark after each item."""

    def __init__(self, ids: list, texts: list[bytes | None]):
        data, off = ts.join_texts(texts)
        w = ts.Words(data, off, ts.ALNUM, fold=True)
        self.ids, self.hashes = ids, w.hashes()
        self.bytes = [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
        self.item = w.doc()
        self.left = w.first[1:][self.item] - np.arange(len(self.item)) if len(self.item) else np.zeros(0, np.int64)
        size = w.counts[self.item] if len(self.item) else np.zeros(0, np.int64)
        self.need = np.minimum(size, WINDOW)
        self.is_window = self.left >= self.need
        self.place = np.arange(len(self.item)) + self.item
        self.depth = int(w.counts.max(initial=1))
        self.size = len(data)

    def text(self, sa: SuffixArray) -> np.ndarray:
        out = np.full(len(self.hashes) + len(self.ids) + 1, len(sa.vocabulary) + 2, np.int64)
        out[self.place] = sa.lookup(self.hashes)
        return out

    def reach(self, sa: SuffixArray) -> np.ndarray:
        """For each word: how many words from it on the shard's texts have, somewhere. No match is longer."""
        n = len(self.hashes)
        lacks = sa.lookup(self.hashes) > len(sa.vocabulary)
        stop = np.minimum.accumulate(np.where(lacks, np.arange(n), n)[::-1])[::-1]
        return np.minimum(stop - np.arange(n), self.left)


def item_blocks(benchmark: DataFrame, limit: int = ITEM_BYTES) -> Iterator[Items]:
    """The benchmark in blocks of bounded size; the driver holds one at a time."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string").cast("binary")).toLocalIterator():
        t = bytes(row[1]) if row[1] is not None else None
        if ids and held + len(t or b"") > limit:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(t)
        held += len(t or b"")
    if ids:
        yield Items(ids, texts)


class Shard:
    """Whole documents and their suffix array."""

    def __init__(self, texts: list[bytes | None], depth: int):
        data, off = ts.join_texts(texts)
        self.w = ts.Words(data, off, ts.ALNUM, fold=True)
        self.hashes = self.w.hashes()
        self.sa = SuffixArray(self.hashes, self.w.first, depth)
        self.doc = self.w.doc()
        self.hit = np.zeros(len(self.hashes), bool)
        self.items: dict[int, set[str]] = defaultdict(set)

    def longest(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        return self.sa.longest(items.text(self.sa), items.place, items.left)

    def mark(self, items: Items) -> None:
        if not len(items.hashes) or not len(self.hashes):
            return
        text, sa = items.text(self.sa), self.sa
        q = np.flatnonzero(items.is_window & (items.reach(sa) >= items.need))
        best, _ = sa.longest(text, items.place[q], items.left[q])
        q = q[best >= items.need[q]]
        if not len(q):
            return
        lo = sa.bound(text, items.place[q], items.need[q], upper=False)
        hi = sa.bound(text, items.place[q], items.need[q], upper=True)
        windows: dict[tuple[int, int], list[int]] = defaultdict(list)  # equal windows have equal ranges
        for k, a, n in zip(q, lo, items.need[q], strict=True):
            windows[(int(a), int(n))].append(int(k))
        ends = {(int(a), int(n)): int(b) for a, b, n in zip(lo, hi, items.need[q], strict=True)}
        for (a, n), owners in windows.items():
            at = sa.word[sa.order[a : ends[(a, n)]]]
            want = items.bytes[owners[0] : owners[0] + n]
            at = at[self._same_bytes(at, want)]
            for j in range(n):
                self.hit[at + j] = True
            names = {items.ids[items.item[k]] for k in owners} - {None}
            for d in np.unique(self.doc[at]):
                self.items[int(d)] |= names

    def _same_bytes(self, at: np.ndarray, want: list[bytes]) -> np.ndarray:
        w, ok = self.w, np.ones(len(at), bool)
        for j, word in enumerate(want):
            s, e = w.starts[at + j], w.ends[at + j]
            ok &= e - s == len(word)
            for i, byte in enumerate(word):
                ok &= w.data[np.minimum(s + i, len(w.data) - 1)] == byte
        return ok


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def sent_blocks(benchmark: DataFrame) -> Iterator[tuple[int, list[Broadcast]]]:
    """Broadcasts of some blocks of the benchmark, SENT_BYTES at most or one block, and the longest item's words."""
    sc, depth, sent, held = benchmark.sparkSession.sparkContext, 1, [], 0
    for items in item_blocks(benchmark):
        if sent and held + items.size > SENT_BYTES:
            yield depth, sent
            depth, sent, held = 1, [], 0
        depth, held = max(depth, items.depth), held + items.size
        sent.append(sc.broadcast(items))
    yield depth, sent


def _marked(texts: list[bytes | None], depth: int, sent: list[Broadcast]) -> Shard:
    shard = Shard(texts, depth)
    for b in sent:
        shard.mark(b.value)
        if len(sent) > 1:  # hold one block of the benchmark at a time
            del b._value
    return shard


def _is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """REPORT for each row of docs."""
    passes = sent_blocks(benchmark)
    first, more = next(passes), next(passes, None)
    if more is not None:
        return _scan_in_passes(docs, chain((first, more), passes))
    depth, sent = first

    def block(part, texts):
        shard = _marked(texts, depth, sent)
        n_hit = ts.seg_sum(shard.hit, shard.w.first)
        names = [sorted(shard.items.get(d, ())) for d in range(len(texts))]
        return {
            "doc_id": part.column(0), "n_words": shard.w.counts, "n_hit": n_hit, "n_items": np.array([len(x) for x in names], np.int64),
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], "contaminated": _is_contaminated(n_hit, shard.w.counts),
        }

    return ts.map_blocks(docs, block, REPORT, SHARD_BYTES)


def _scan_in_passes(docs: DataFrame, passes: Iterator[tuple[int, list[Broadcast]]]) -> DataFrame:
    """As `scan`: each pass leaves, for each row, the words it hit and the items; the passes' finds are then united."""
    # a written table has rows that can be numbered
    rows = ts.settle(docs.select(F.monotonically_increasing_id().alias("doc_id"), F.struct(F.col("doc_id").cast("long").alias("id")).alias("own"), F.col("text").cast("string").alias("text")))
    found = None
    for depth, sent in passes:

        def block(part, texts, depth=depth, sent=sent):
            shard = _marked(texts, depth, sent)
            at = [np.flatnonzero(shard.hit[a:b]) for a, b in zip(shard.w.first[:-1], shard.w.first[1:], strict=True)]
            names = [sorted(shard.items.get(d, ())) for d in range(len(texts))]
            return {"doc_id": part.column(0), "n_words": shard.w.counts, "hit": pa.array(at, pa.list_(pa.int64())), "items": pa.array(names, pa.list_(pa.string()))}

        part = ts.settle(ts.map_blocks(rows, block, "doc_id long, n_words long, hit array<long>, items array<string>", SHARD_BYTES))
        found = part if found is None else found.unionByName(part)
        for b in sent:
            b.destroy()
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  a list for each pass
    one = found.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.size(every("hit")).cast("long").alias("n_hit"), every("items").alias("items"))
    said = one.join(rows.select("doc_id", "own.id"), "doc_id").select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return said.withColumn("contaminated", _is_contaminated(F.col("n_hit"), F.col("n_words")))


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW) -> DataFrame:
    """For each item and word of it where a match of `least` words starts: the longest match in all documents, and one place of it."""
    found = None
    for depth, sent in sent_blocks(benchmark):
        part = ts.settle(_longest(docs, depth, sent, least))
        found = part if found is None else found.unionByName(part)
        for b in sent:
            b.destroy()
    best = F.max_by(F.struct("n_words", "doc_id", "doc_word"), F.struct("n_words", -F.col("doc_id"), -F.col("doc_word")))
    return found.groupBy("item_id", "item_word").agg(best.alias("b")).select("item_id", "item_word", "b.*")


def _longest(docs: DataFrame, depth: int, sent: list[Broadcast], least: int) -> DataFrame:
    def block(part, texts):
        shard, out = Shard(texts, depth), defaultdict(list)
        ids = part.column(0).to_pylist()
        for b in sent:
            items = b.value
            n, at = shard.longest(items)
            for k in np.flatnonzero(n >= least):
                d = int(shard.doc[at[k]])
                for c, v in (("item_id", items.ids[items.item[k]]), ("item_word", int(k - np.searchsorted(items.item, items.item[k]))), ("n_words", int(n[k])), ("doc_id", ids[d]), ("doc_word", int(at[k] - shard.w.first[d]))):
                    out[c].append(v)
        kinds = {"item_id": pa.string(), "item_word": pa.int64(), "n_words": pa.int64(), "doc_id": pa.int64(), "doc_word": pa.int64()}
        return {c: pa.array(out[c], kind) for c, kind in kinds.items()}

    return ts.map_blocks(docs, block, "item_id string, item_word long, n_words long, doc_id long, doc_word long", SHARD_BYTES)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns, each judged by itself where it is read."""
    passes = sent_blocks(benchmark)
    (depth, sent), more = next(passes), next(passes, None)
    if more is None:

        def clean(texts):
            shard = _marked(texts, depth, sent)
            return ~_is_contaminated(ts.seg_sum(shard.hit, shard.w.first), shard.w.counts)

        return ts.keep_rows(docs, clean, ROWS_SHARD_BYTES)
    # a benchmark of several passes: rows are numbered in a written table
    number, rest = ts.free_name(docs, "number"), docs.columns
    rows = ts.settle(docs.withColumn(number, F.monotonically_increasing_id()))
    found = _scan_in_passes(rows.select(F.col(number).alias("doc_id"), "text"), chain(((depth, sent), more), passes))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("bad"))
    return rows.alias("d").join(bad.alias("b"), F.col(f"d.{number}") == F.col("b.bad"), "left_anti").select(*ts.quoted(rest))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(ts.table(spark, sf_dir, "documents"), ts.table(spark, sf_dir, "benchmark"))
