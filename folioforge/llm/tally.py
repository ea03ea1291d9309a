"""Counting the words of whole texts: added up within a task before anything is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts

#: Rows that a task holds before it adds up equal keys, and sums that it holds before it hands them on.
HELD, SUMS = 1 << 20, 1 << 19


def spelled(w: ts.Words) -> pa.Array:
    """The words of a block as Arrow strings, without a step for each word."""
    offsets = np.zeros(len(w.starts) + 1, np.int32)
    np.cumsum(w.ends - w.starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.string(), len(w.starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(w.data[w.mask]))])


def codes_of(w: ts.Words) -> tuple[np.ndarray, pa.Array]:
    """A number for each word of a block, and the words that the numbers stand for."""
    coded = spelled(w).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def group_numbers(columns: list[pa.Array]) -> tuple[np.ndarray, list[tuple]]:
    """A number for each row of the columns, equal for equal rows, and the rows they stand for."""
    seen: dict[tuple, int] = {}
    rows = zip(*(c.to_pylist() for c in columns), strict=True)
    return np.array([seen.setdefault(r, len(seen)) for r in rows], np.int64), list(seen)


def tally(docs: DataFrame, by: list[str], block: Callable[[list[pa.Array], list[bytes | None]], pa.Table], sums: list[str], word: str) -> DataFrame:
    """(by..., word, sums...) of blocks of docs (by..., text), equal keys added up in each task.

    A key can come from a task more than once, so the caller adds up again.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*by, word)] + [T.StructField(c, T.LongType()) for c in sums])
    keys = [*by, word]

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([(c, "sum") for c in sums]).rename_columns([*keys, *sums])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part, texts in ts.in_blocks(batch, "text"):
                held.append(block([part.column(k) for k in range(len(by))], texts))
                n += held[-1].num_rows
                if n >= HELD:
                    held = [added(held)]
                    n = held[0].num_rows
                    if n >= SUMS:
                        yield from held[0].combine_chunks().to_batches(max_chunksize=1 << 16)
                        held, n = [], 0
        if held:
            yield from added(held).combine_chunks().to_batches(max_chunksize=1 << 16)

    return ts.map_batches(docs.select(*by, F.col("text").cast("string").alias("text")), run, schema)
