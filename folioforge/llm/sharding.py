"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (operator 8).

The law is `rows`: shard sizes differ by one at most. How many rows each partition sends to each
cell (a piece of a shard) is drawn first: the matrix of counts with the partitions' sizes as row
sums and the cells' exact sizes as column sums, from the multivariate hypergeometric law (counts
always add up exactly; the law is met as far as double arithmetic goes). Each partition then deals its
rows by a random permutation of its row of the matrix, the rows are exchanged, and each cell is permuted
again by random keys. Cells bound what one task sorts, whatever the shard's size. All draws depend on (seed, partition) only, and the partitions are those
of a checkpoint, so recomputing a lost task deals the same rows to the same places.

Null texts have size 1 and the checksum of no bytes. Repeated rows are dealt out one by one, so a
large group of equal texts spreads over all shards; a null doc_id is dealt like any other. Of equal random
keys in a cell the row that came first stands first. Empty tables give no rows. Other columns are kept by
`shuffle` if asked for; names that clash with its own are refused.
"""

from __future__ import annotations

from math import exp, lgamma

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import textscan as ts

SHARDS, SEED = 16, 20_240_229
#: Rows that one task permutes, at most; the matrix has a column for each cell.
CELL_ROWS = 1 << 20


def cell_sizes(rows: int, shards: int, cell_rows: int = CELL_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each cell, its shard, and its first slot."""
    sizes, shard, first = [], [], []
    for s in range(shards):
        n = rows // shards + (s < rows % shards)
        pieces = max(1, -(-n // cell_rows))
        each = [n // pieces + (k < n % pieces) for k in range(pieces)]
        sizes += each
        shard += [s] * pieces
        first += list(np.cumsum([0, *each[:-1]]))
    return np.array(sizes, np.int64), np.array(shard, np.int64), np.array(first, np.int64)


def _hypergeometric(rng: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
    """Counts of n draws without replacement; exact for any size by splitting the colours in halves."""
    total = int(colors.sum())
    if total < 10**9 or len(colors) == 1:
        return rng.multivariate_hypergeometric(colors, n, method="marginals") if len(colors) > 1 else np.array([n])
    half = len(colors) // 2
    left = _one(rng, int(colors[:half].sum()), int(colors[half:].sum()), n)
    return np.concatenate((_hypergeometric(rng, colors[:half], left), _hypergeometric(rng, colors[half:], n - left)))


def _one(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw; numpy's sampler ends at 10**9, beyond it by inverse transform."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    # inverse transform from the mode outwards, in exact ratios of neighbouring probabilities
    mode = (n + 1) * (good + 1) // (good + bad + 2)
    log_p = lgamma(good + 1) - lgamma(mode + 1) - lgamma(good - mode + 1) + lgamma(bad + 1) - lgamma(n - mode + 1) - lgamma(bad - n + mode + 1) - lgamma(good + bad + 1) + lgamma(n + 1) + lgamma(good + bad - n + 1)
    p_mode, u = exp(log_p), rng.random()
    up, down, p_up, p_down = mode, mode, p_mode, p_mode
    u -= p_mode
    while u > 0 and (p_up > 0 or p_down > 0):
        p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
        up += 1
        u -= p_up
        if u <= 0:
            return up
        p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
        down -= 1
        u -= p_down
        if u <= 0:
            return down
    return mode  # what rounding left of u, beyond every count that has a probability


def matrix_row(upto: np.ndarray, cells: np.ndarray, seed: int, p: int) -> np.ndarray:
    """Rows that partition p sends to each cell.

    `upto` has the rows before each partition, and their total. Ranges of partitions are halved down
    to p, and each half's counts are drawn given its parent's; so every task draws its own row of one
    and the same matrix, and no machine holds the others.
    """
    low, high, own = 0, len(upto) - 1, cells
    while high - low > 1:
        mid = (low + high) // 2
        left = _hypergeometric(np.random.default_rng([seed, low, high]), own, int(upto[mid] - upto[low]))
        low, high, own = (low, mid, left) if p < mid else (mid, high, own - left)
    return own


def shuffle(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """rows with shard and slot (from 0, gapless in each shard): a uniform permutation cut into shards of exact size."""
    if clash := {"shard", "slot", "__cell", "__first", "__key", "__row"} & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} are taken")
    ts.shared_dir(rows.sparkSession)
    fixed = rows.checkpoint()
    counts = {r[0]: r[1] for r in fixed.groupBy(F.spark_partition_id()).count().collect()}
    sizes = [counts.get(p, 0) for p in range(max(counts, default=-1) + 1)]
    cells, shard, first = cell_sizes(sum(sizes), shards, cell_rows)
    upto = np.cumsum([0, *sizes])
    own_fields = [T.StructField("shard", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("__cell", "__first", "__key", "__row"))]
    schema = T.StructType([*fixed.schema.fields, *own_fields])

    def deal(batches):
        p, at = TaskContext.get().partitionId(), 0
        own = matrix_row(upto, cells, seed, p) if p < len(upto) - 1 else np.zeros(len(cells), np.int64)
        rng = np.random.default_rng([seed, p])
        to = rng.permutation(np.repeat(np.arange(len(own), dtype=np.int32), own))
        for batch in batches:
            n = batch.num_rows
            cell = to[at : at + n].astype(np.int64)
            made = [shard[cell].astype(np.int32), cell, first[cell], rng.integers(-(2**63), 2**63 - 1, n), np.arange(at, at + n) + (p << 40)]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names=schema.names)

    rank = F.row_number().over(W.partitionBy("__cell").orderBy("__key", "__row")) - 1
    return ts.map_batches(fixed, deal, schema).withColumn("slot", (rank + F.col("__first")).cast("long")).select(*fixed.columns, "shard", "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ts.table(spark, sf_dir, "documents")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    return shuffle(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
