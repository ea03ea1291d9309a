"""Near-duplicates by min-max hashing (operator 4).

Of each hash permutation both the least and the greatest value over a document's shingles are
kept, so half the permutations give a signature of the same length, of lower variance since the
two are anticorrelated. BANDS bands of two permutations (four values) give candidates: at a
similarity of 0.8 a pair shares a band with probability 1 - (1 - 0.8**4)**24 = 0.999997.

Steps, each a table: (1) texts become a set size, a fingerprint of the whole set, band keys and a
parity sketch; (2) documents of equal sets are one class from then on, whatever their number; (3)
in rounds, each class is compared, on full sets, with one class of another component that it shares
a bucket with, and links make components; so a large group of copies costs a few comparisons for
each member, not for each pair; (4) buckets whose members are still in different components are
finished exactly: each member outside the bucket's largest component meets the members of other
components, in blocks of BLOCK by BLOCK; (5) components again. No bucket is capped. Before any
comparison, pairs whose sizes or parity sketches rule a link out are left out: the bits in which two
sketches differ are never more than the elements in which the sets do, so that filter is exact.

Every join on something that many rows may share (a bucket, a head, a fingerprint, a hub of links)
is a `spread_join`: rows of hot keys stay where they are. Comparisons stream: the rows of one class's
partners are dealt out in salted groups, each headed by that class's text, and a task holds one set at
a time beside the head's.

Null and empty texts have empty sets: linked with nothing, each its own component, kept. Rows that
share a doc_id are one document with several texts: linked with one another. A null doc_id links with
nothing and is kept. Of equal sets, the least doc_id stands for all. An empty table gives no rows.
Columns other than doc_id and text are not read; `keep_one` keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .components import connected_components

PERMUTATIONS, PER_BAND, SEED = 48, 2, 0x5EED
BANDS = PERMUTATIONS // PER_BAND
#: 64-bit columns of a parity sketch, and rounds of single comparisons before buckets are finished.
SKETCH, ROUNDS = 16, 2
#: Partners that one task compares with a head, and members of an open bucket in a side of a block.
GROUP, BLOCK = 256, 1024
#: Rows of a few numbers, of a sketch, and of a text in a file of a checkpoint.
NARROW, WIDE, TEXTS = 1_000_000, 25_000, 10_000


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def sets_of(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another; and the n + 1 offsets."""
    data, off = ts.join_texts(texts)
    w = ts.Words(data, off, ts.NON_SPACE, fold=True)
    h, offsets = ts.shingles(w.hashes(), w.first, width)
    parts = [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), out


def signature(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(document, 2 * PERMUTATIONS): least and greatest value of each permutation; documents without shingles are left out."""
    at = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(at), 2 * PERMUTATIONS), np.uint64)
    if len(at):
        for k, (a, c) in enumerate(zip(*_coefficients(), strict=True)):
            v = (h ^ c) * a
            out[:, 2 * k] = np.minimum.reduceat(v, at)
            out[:, 2 * k + 1] = np.maximum.reduceat(v, at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(document, BANDS): a key of each band's values, different bands' keys being unrelated."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sig), b + 1, np.uint64)
        for j in range(2 * PER_BAND):
            key = ts.mix(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, 2 * PER_BAND * b + j])
        out[:, b] = key
    return out


def parities(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(document, SKETCH): for each of 64 * SKETCH bins whether an odd number of elements falls in it."""
    n, bins = len(off) - 1, 64 * SKETCH
    at = np.repeat(np.arange(n), np.diff(off)) * bins + (ts.mix(h + np.uint64(0xABCDEF)) % np.uint64(bins)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bins) & 1).astype(np.uint8).reshape(n, bins)
    return np.packbits(odd, axis=1).view(np.int64)


_BITS = [f"p{k}" for k in range(SKETCH)]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (fingerprint of the set), bands, and the parity sketch."""

    def block(part, texts):
        h, off = sets_of(texts, width)
        n = np.diff(off)
        keys = band_keys(signature(h, off)).astype(np.int64).ravel()
        ends = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
        total = lambda x: (lambda c: c[off[1:]] - c[off[:-1]])(np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))).view(np.int64)
        bits = parities(h, off)
        return {"doc_id": part.column(0), "n": n, "s1": total(ts.mix(h + np.uint64(0x1234567))), "s2": total(ts.mix(h ^ np.uint64(0x9E3779B97F4A7C15))), "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))} | {c: np.ascontiguousarray(bits[:, k]) for k, c in enumerate(_BITS)}

    return ts.map_blocks(docs, block, "doc_id long, n long, s1 long, s2 long, bands array<long>, " + ", ".join(f"{c} long" for c in _BITS))


def possible(a: str, b: str, num: int, den: int) -> str:
    """SQL: sizes and sketches of rows a and b leave room for a link.

    A link means that at most (den - num) / (den + num) of both sizes' sum differ.
    """
    differ = " + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in _BITS)
    return f"{den} * least({a}.n, {b}.n) >= {num} * greatest({a}.n, {b}.n) AND {den + num} * ({differ}) <= {den - num} * ({a}.n + {b}.n)"


def packed(docs: DataFrame) -> DataFrame:
    """id, z (the text, compressed) and size: what is shuffled is about two thirds of the rows' own compression."""

    def block(part, texts):
        raw = [t or b"" for t in texts]
        return {"id": part.column(0), "z": pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in raw], pa.binary()), "size": np.array([len(t) for t in raw], np.int64)}

    return ts.map_blocks(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL"), block, "id long, z binary, size long")


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about BLOCK_BYTES of text with their texts."""
    sizes = batch.column(batch.schema.get_field_index("size")).to_pylist()
    z = batch.column(batch.schema.get_field_index("z"))
    begin = held = 0
    for k, n in enumerate([*sizes, None]):
        if k > begin and (n is None or held + n > ts.BLOCK_BYTES):
            yield batch.slice(begin, k - begin), [pa.decompress(z[i].as_buffer(), m, codec="zstd", asbytes=True) if (m := sizes[i]) else b"" for i in range(begin, k)]
            begin, held = k, 0
        held += n or 0


def confirm(texts: DataFrame, pairs: DataFrame, n_pairs: int, width: int, num: int, den: int) -> DataFrame:
    """The pairs (x, head) whose full sets have den * intersection >= num * union."""
    heads_of = pairs.groupBy("head").agg(F.count(F.lit(1)).alias("rows_of_key")).withColumn("salts", F.ceil(F.col("rows_of_key") / GROUP))
    salted = ts.spread_join(pairs, heads_of, ["head"], n_pairs).select("x", "head", F.pmod(F.xxhash64("x"), F.col("salts")).alias("salt"))
    heads = salted.select("head", "salt").distinct().select(F.col("head").alias("id"), "head", "salt", F.lit(0).alias("role"))
    wanted = heads.union(salted.select(F.col("x").alias("id"), "head", "salt", F.lit(1).alias("role")))
    rows = wanted.join(texts, "id").repartition(F.col("head"), F.col("salt")).sortWithinPartitions("head", "salt", "role")

    def compare(batches):
        head, group, own = None, None, []
        for batch in batches:
            xs, ys = [], []
            for part, raw in unpacked(batch):
                h, off = sets_of(raw, width)
                ids, hs, salt, role = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("id", "head", "salt", "role"))
                for k in range(part.num_rows):
                    mine = h[off[k] : off[k + 1]]
                    if (hs[k], salt[k]) != group:
                        head, group, own = hs[k], (hs[k], salt[k]), []
                    if role[k] == 0:
                        own.append(mine.copy())
                    elif any(_close(mine, s, num, den) for s in own):
                        xs.append(ids[k])
                        ys.append(head)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["a", "b"])

    return ts.map_batches(rows, compare, "a long, b long")


def _close(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or den * small < num * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def open_buckets(members: DataFrame, reps: DataFrame, turn: int) -> tuple[DataFrame, int]:
    """Members (key, rep) of the buckets that hold more than one component, with their component, the bucket's `size` and one
    member of it, `head`, that differs from turn to turn, with its component `other`; and how many rows that is."""
    label = members.join(reps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    label, n = ts.settled(label, NARROW)
    lead = F.min_by(F.struct(F.col("rep").alias("head"), F.col("component").alias("other")), F.struct(F.xxhash64("rep", F.lit(turn)), "rep"))
    buckets = label.groupBy("key").agg(F.count(F.lit(1)).alias("rows_of_key"), F.min("component").alias("c0"), F.max("component").alias("c1"), lead.alias("l"))
    buckets = ts.settle(buckets.select("key", "rows_of_key", F.col("rows_of_key").alias("size"), (F.col("c0") < F.col("c1")).alias("open"), "l.head", "l.other"), NARROW)
    return ts.settled(ts.spread_join(label, buckets, ["key"], n).filter("open").drop("open"), NARROW)


def crossing_pairs(opened: DataFrame, n: int, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(x, head) of all members of different components of a bucket (opened, of n rows) that a link is possible between.

    One of a pair is outside the bucket's largest component. A member of so many pairs that it is hot becomes the head of
    those with members that aren't.
    """
    by_part = opened.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = by_part.groupBy("key").agg(F.sum("k").alias("rows_of_key"), F.max_by("component", F.struct("k", "component")).alias("largest"))
    own = ts.spread_join(opened.drop("head", "other"), largest, ["key"], n).join(sets, "rep")
    own = ts.settle(own.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("row", F.pmod(F.xxhash64("rep"), F.col("blocks"))), 4 * WIDE)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    minor = own.filter("component <> largest").withColumn("col", every)
    others = own.withColumnRenamed("row", "col").withColumn("row", every)
    condition = "a.key = b.key AND a.row = b.row AND a.col = b.col AND a.component <> b.component AND (a.rep < b.rep OR b.component = a.largest) AND "
    pairs = minor.alias("a").join(others.alias("b"), F.expr(condition + possible("a", "b", num, den))).select(F.col("b.rep").alias("x"), F.col("a.rep").alias("head"))
    pairs, n_pairs = ts.settled(pairs.distinct(), NARROW)
    busy = pairs.select(F.explode(F.array("x", "head")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("rows_of_key")).filter(ts.hot(n_pairs))
    is_busy = lambda c, mark: F.broadcast(busy.select(F.col("id").alias(c), F.lit(True).alias(mark)))
    marked = pairs.join(is_busy("x", "bx"), "x", "left").join(is_busy("head", "bh"), "head", "left")
    turned = F.col("bx").isNotNull() & F.col("bh").isNull()
    return marked.select(F.when(turned, F.col("head")).otherwise(F.col("x")).alias("x"), F.when(turned, F.col("x")).otherwise(F.col("head")).alias("head"))


def _links(reps: DataFrame) -> DataFrame:
    return reps.select(F.col("node").alias("a"), F.col("component").alias("b"))


def components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; the component is null where doc_id is."""
    spark = docs.sparkSession
    sk, n_rows = ts.settled(sketches(docs, width), WIDE)
    narrow = sk.select("doc_id", "n", "s1", "s2")
    known = sk.filter("doc_id IS NOT NULL AND n > 0")
    classes = known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows_of_key"), F.first("bands").alias("bands"), *[F.first(c).alias(c) for c in _BITS])
    classes, n_classes = ts.settled(classes, WIDE)
    exploded = classes.select("rep", F.explode("bands").alias("key"))
    buckets = exploded.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("most"), F.count(F.lit(1)).alias("rows_of_key")).filter("head < most").drop("most")
    opened, n_open = ts.settled(ts.spread_join(exploded, ts.settle(buckets, NARROW), ["key"], BANDS * n_classes), NARROW)
    candidates = opened.select(F.col("rep").alias("id")).distinct()
    sets = ts.settle(classes.select("rep", "n", *_BITS).join(candidates.withColumnRenamed("id", "rep"), "rep", "left_semi"), 4 * WIDE)
    texts = ts.settle(packed(docs).join(candidates, "id", "left_semi"), TEXTS)
    reps = spark.createDataFrame([], "node long, component long")
    for turn in range(1, ROUNDS + 1):
        pairs, n_pairs = ts.settled(opened.filter("rep <> head" if turn == 1 else "component <> other").select(F.col("rep").alias("x"), "head").distinct(), NARROW)
        if not n_pairs:
            break
        of_head = pairs.groupBy("head").agg(F.count(F.lit(1)).alias("rows_of_key")).join(sets.select(F.col("rep").alias("head"), F.struct("n", *_BITS).alias("b")), "head")
        fit = ts.spread_join(pairs, of_head, ["head"], n_pairs).join(sets.select(F.col("rep").alias("x"), F.struct("n", *_BITS).alias("a")), "x").filter(possible("a", "b", num, den))
        nearest = F.struct(F.expr(" + ".join(f"bit_count(a.{c} ^ b.{c})" for c in _BITS)), "head")
        one, n_one = ts.settled(fit.groupBy("x").agg((F.min("head") if turn == 1 else F.min_by("head", nearest)).alias("head")), NARROW)
        if n_one:
            reps = connected_components(_links(reps).union(confirm(texts, one, n_one, width, num, den)))
        opened, n_open = open_buckets(opened.select("key", "rep"), reps, turn)  # a bucket that is done stays done
        if not n_one:
            break
    if n_open:  # what is still open is finished exactly
        rest, n_rest = ts.settled(crossing_pairs(opened, n_open, sets, num, den), NARROW)
        if n_rest:
            reps = connected_components(_links(reps).union(confirm(texts, rest, n_rest, width, num, den)))
    # documents: their class's component; a doc_id with several texts ties its classes together
    of_class = classes.select("n", "s1", "s2", "rows_of_key", "rep")
    several = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id")
    if not several.isEmpty():
        members = ts.spread_join(known.select("doc_id", "n", "s1", "s2"), of_class, ["n", "s1", "s2"], n_rows)
        reps = connected_components(_links(reps).union(members.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
        by_doc = narrow.join(reps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        found = by_doc.select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    else:
        of_class = of_class.join(reps.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", "rows_of_key", F.coalesce("component", "rep").alias("component"))
        linked = ts.spread_join(narrow.filter("doc_id IS NOT NULL AND n > 0"), of_class, ["n", "s1", "s2"], n_rows)
        found = linked.select("doc_id", "n", "component").unionByName(narrow.filter("doc_id IS NULL OR n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def with_verdict(found: DataFrame) -> DataFrame:
    return found.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


#: Ids of documents to drop that are broadcast at most; of more, rows meet them by a shuffle.
MOST_SENT = 1 << 20


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs of the least doc_id of each group of near-duplicates, with all their columns.

    Of rows that share a doc_id all are kept or none, but for exact repeats of a row, of which one stays (rows without a
    doc_id too). Rows repeat each other if all their columns read the same as JSON, so columns may be of any type. Rows
    without a doc_id are joined with nothing.
    """
    gone, n = ts.settled(with_verdict(components(docs, width, num, den)).filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), NARROW)
    gone = (F.broadcast(gone) if n <= MOST_SENT else gone).alias("g")
    own = docs.filter("doc_id IS NOT NULL").alias("d").join(gone, F.col("d.doc_id") == F.col("g.gone"), "left_anti")
    kept = own.union(docs.filter("doc_id IS NULL"))
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    if repeated.isEmpty():
        return kept
    row = ts.free_name(docs, "row_digest")
    return kept.withColumn(row, F.sha2(F.to_json(F.struct(*ts.quoted(docs.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)).dropDuplicates([row]).drop(row)


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdict(components(ts.table(spark, sf_dir, "documents"), width=2)).select("doc_id", "n_shingles", "component_id", "kept")
