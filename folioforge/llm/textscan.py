"""Vectorised scanning of blocks of whole texts, shared by the operators of this subpackage.

A block is some documents' UTF-8 bytes joined by line feeds, so no word crosses a document.
Word classes here only separate at ASCII bytes; every byte of a longer UTF-8 sequence is a
word byte, so byte tables are exact.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes held and scanned at a time; a longer document is a block of its own.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 4096

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` of lower-cased text, and its upper-case letters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: `[^\x20\x09-\x0D]`
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[9:14] = NON_SPACE[32] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def join_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each followed by a line feed; and the n + 1 offsets."""
    parts = [t or b"" for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return np.frombuffer(b"\n".join([*parts, b""]), np.uint8), offsets


class Hasher:
    """Hashes of any spans of a buffer, in constant time each."""

    def __init__(self, data: np.ndarray):
        pw, self._inv = _grow(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=self._sum[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._sum[ends] - self._sum[starts]) * self._inv[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


class Words:
    """The words of a block: starts and ends of each, and `first[d]`, the first word of document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool):
        self.data = _FOLD[data] if fold else data
        self.mask = table[data]
        edge = np.flatnonzero(self.mask[1:] != self.mask[:-1]) + 1
        if len(self.mask) and self.mask[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]  # a block ends with a line feed
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return Hasher(self.data)(self.starts, self.ends)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every window of `width` words within a document and the n + 1 offsets.

    A document of fewer words, but not none, has one: its whole sequence.
    """
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    offsets = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=offsets[1:])
    at = np.repeat(first[:-1] - offsets[:-1], made) + np.arange(offsets[-1])
    length = np.repeat(np.minimum(counts, width), made)
    out = length.astype(np.uint64)
    for j in range(width):
        inside = length > j
        step = out * np.uint64(0xD6E8FEB86659FD93) + h[np.minimum(at + j, max(len(h) - 1, 0))] if len(h) else out
        out = np.where(inside, mix(step), out)
    return out, offsets


def seg_sum(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment, empty ones 0."""
    c = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def in_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch of about `limit` text bytes and at most BLOCK_ROWS rows each, with their texts."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    begin = held = 0
    for k, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if (held and held + (n or 0) > limit) or k - begin >= BLOCK_ROWS:
            yield batch.slice(begin, k - begin), texts.slice(begin, k - begin).to_pylist()
            begin, held = k, 0
        held += n or 0
    if batch.num_rows > begin:
        yield batch.slice(begin), texts.slice(begin).to_pylist()


def give_back() -> None:
    """Hands what this worker has freed back to the system: a worker outlives its task, and others need the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def plain_names(names: list[str]) -> dict[str, str]:
    """Other names for those that Spark would read as paths or quotes."""
    taken, out = {n.lower() for n in names}, {}
    for k, n in enumerate(n for n in dict.fromkeys(names) if "." in n or "`" in n):
        own = f"column{k}"
        while own in taken:
            own += "_"
        taken.add(own)
        out[n] = own
    return out


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns of these very names, whatever stands in them."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def map_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow, after which the worker is slim again. Columns may have any names; fn sees those with dots and quotes under others."""
    given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        yield from fn(batches)
        give_back()

    if not (other := plain_names([*df.columns, *given.names])):
        return df.mapInArrow(run, given)
    inside = T.StructType([T.StructField(other.get(f.name, f.name), f.dataType, f.nullable) for f in given.fields])
    return df.toDF(*[other.get(c, c) for c in df.columns]).mapInArrow(run, inside).toDF(*given.names)


def map_blocks(docs: DataFrame, fn: Callable[[pa.RecordBatch, list[bytes | None]], dict], schema: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """Rows that fn makes of each block of (doc_id, text); other columns are not read.

    fn gets the slice and its texts and returns a column of each name in `schema`.
    """
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in in_blocks(batch, "text", limit):
                cols = fn(part, texts)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in (cols[n] for n in names)], names=names)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def keep_rows(docs: DataFrame, fn: Callable[[list[bytes | None]], np.ndarray], limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, for whose text fn says true; no column is looked up but `text`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in in_blocks(batch, "text", limit):
                yield part.filter(pa.array(fn(texts), pa.bool_()))

    return map_batches(docs, run, docs.schema)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores as long as df has a column of it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> None:
    """Makes the folder that spark.checkpoint.dir names the session's checkpoint folder.

    Where none is named, a temporary one serves a session that runs on this machine alone, as in tests;
    on a cluster that is refused, since executors don't share it.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="folioforge-"))


def settled(df: DataFrame, rows_each: int = 100_000) -> tuple[DataFrame, int]:
    """A checkpoint of df in about as many files as its rows fill, and its rows; partitions are only ever joined.

    The rows are made once, at df's own parallelism, and held on the executors' disks until the
    checkpoint is written from there; an executor that is lost meanwhile only means making its share again.
    """
    shared_dir(df.sparkSession)
    kept = df.persist(StorageLevel.DISK_ONLY)
    n = kept.count()
    out = kept.coalesce(max(1, -(-n // rows_each))).checkpoint()
    kept.unpersist()
    return out, n


def settle(df: DataFrame, rows_each: int = 100_000) -> DataFrame:
    return settled(df, rows_each)[0]


#: A key is hot if it holds more rows than this and than one in HOT_SHARE of all: there are fewer than HOT_SHARE such keys.
HOT_ROWS, HOT_SHARE = 256, 10_000


def hot(rows: int) -> Column:
    """Whether a key with `rows_of_key` of a table's `rows` is hot."""
    return F.col("rows_of_key") > F.lit(max(HOT_ROWS, rows // HOT_SHARE))


def spread_join(left: DataFrame, counted: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """left, of `rows` rows, joined with counted, which has one row for each of left's keys and in `rows_of_key` how many rows of left have it.

    Rows of a hot key stay where they are: the fewer than HOT_SHARE rows of counted that they need are broadcast. All
    others meet by a shuffle, in which no key has more than a HOT_SHARE-th of the rows.
    """
    is_hot = hot(rows)
    few, many = counted.filter(is_hot).drop("rows_of_key"), counted.filter(~is_hot).drop("rows_of_key")
    cold = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(many, keys)
    return cold.unionByName(left.join(F.broadcast(few), keys))
