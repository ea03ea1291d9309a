"""Toxicity by subword-bag embeddings under a linear softmax (operator 5).

A word is the bag of its own hashed embedding and those of its character n-grams (of UTF-8 bytes,
with word bounds); a passage of PASSAGE words averages its bags, and a linear softmax over the
average gives its logit. Embeddings and softmax are trained jointly in numpy: first with whole
documents as one bag, then with each document judged by its worst passage, so that a few words in
a long text count. A misspelling shares n-grams, hence vectors, with the word it bends. Since the
softmax is linear, scoring adds a number for each n-gram.

Only labelled rows outside the held-out third train it, at most PER_CLASS documents of each label
and TRAIN_BYTES of text, in an order given by a hash of doc_id; a text that doesn't fit in what is left
of its label's bytes is passed over. Every whole text is scored; empty and null ones have no passage
and get the score of the bias alone; of passages that score alike the first counts. Without labels of
both kinds the model is all zeros and each score 0.5. Repeated rows get equal scores, and rows without a
doc_id are scored too; a repeated label of a document counts once, the greatest; labels that are null
are left out. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts

BUCKET_BITS, DIM, GRAMS, PASSAGE = 17, 8, (3, 4, 5), 4
PER_CLASS, TRAIN_BYTES = 1500, 8 << 20
THRESHOLD = 0.7
_P = np.uint64(0x9E3779B97F4A7C15)


class Bags:
    """Words of a block and the buckets of their n-grams."""

    def __init__(self, texts: list[bytes | None]):
        data, off = ts.join_texts(texts)
        w = ts.Words(np.concatenate((np.array([10], np.uint8), data)), off + 1, ts.ALNUM, fold=True)
        self.w, self.first = w, w.first
        self.h = w.hashes()
        length = w.ends - w.starts
        self.n_grams = [np.maximum(length + 3 - n, 0) for n in GRAMS]
        self.size = 1 + sum(self.n_grams)

    def whole(self) -> np.ndarray:
        return (self.h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    def grams(self):
        """For each n: buckets by position, where the window begins at the byte before its word's byte."""
        w = self.w
        b = np.where(w.mask, w.data, np.uint8(32)).astype(np.uint64) + np.uint64(1)
        h, p = b.copy(), np.uint64(1)
        for n in range(2, max(GRAMS) + 1):
            p = np.uint64(int(p) * int(_P) % 2**64)
            h = h[: len(b) - n + 1] + b[n - 1 :] * p
            if n in GRAMS:
                yield n, (((h + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    def logits(self, table: np.ndarray) -> np.ndarray:
        """Sum over each word's bag of the buckets' numbers."""
        out = table[self.whole()].astype(np.float64)
        for (_, buckets), count in zip(self.grams(), self.n_grams, strict=True):
            c = np.zeros(len(buckets) + 1)
            np.cumsum(table[buckets], out=c[1:])
            at = self.w.starts - 1
            out += np.where(count > 0, c[np.minimum(at + count, len(buckets))] - c[np.minimum(at, len(buckets))], 0.0)
        return out

    def bag(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the bags of some words, one after another, and where each begins."""
        size = self.size[words]
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        out = np.empty(size.sum(), np.int64)
        out[begin] = self.whole()[words]
        fill = begin + 1
        for (_, buckets), count in zip(self.grams(), self.n_grams, strict=True):
            c = count[words]
            k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            out[np.repeat(fill, c) + k] = buckets[np.repeat(self.w.starts[words] - 1, c) + k]
            fill = fill + c
        return out, begin


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end word of every passage, and the n + 1 offsets by document."""
    counts = np.diff(first)
    made = np.where(counts >= PASSAGE, counts - PASSAGE + 1, (counts > 0).astype(np.int64))
    off = np.concatenate(([0], np.cumsum(made)))
    a = np.repeat(first[:-1] - off[:-1], made) + np.arange(off[-1])
    return a, np.minimum(a + PASSAGE, np.repeat(first[1:], made)), off


class Model:
    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table.astype(np.float32), bias

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Probability that a text is toxic: of its worst passage."""
        bags = Bags(texts)
        out = np.full(len(texts), self.bias)
        if len(bags.h):
            s, n = np.concatenate(([0.0], np.cumsum(bags.logits(self.table)))), np.concatenate(([0], np.cumsum(bags.size)))
            a, b, off = passages(bags.first)
            v = (s[b] - s[a]) / (n[b] - n[a])
            some = np.diff(off) > 0
            out[some] += np.maximum.reduceat(v, off[:-1][some])
        return 1 / (1 + np.exp(-out))


def fit(texts: list[bytes | None], labels: np.ndarray, bag_rounds: int = 40, passage_rounds: int = 110, seed: int = 11) -> Model:
    """Joint full-batch training of embeddings and softmax (Adam)."""
    bags = Bags(texts)
    y = labels.astype(float)
    some = np.diff(bags.first) > 0
    if not some.any() or len(np.unique(y[some])) < 2:
        return Model(np.zeros(1 << BUCKET_BITS), 0.0)
    _, pick, word = np.unique(bags.h, return_index=True, return_inverse=True)
    # n-grams of each different word once: a text of the vocabulary is much shorter than the texts
    w = bags.w
    vocabulary = Bags([b"\n".join(w.data[a:b].tobytes() for a, b in zip(w.starts[pick], w.ends[pick], strict=True))])
    sub, begin = vocabulary.bag(np.arange(len(pick)))
    sub, word = sub.astype(np.int32), word.astype(np.int32)
    sub_word = np.repeat(np.arange(len(pick), dtype=np.int32), vocabulary.size)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)  # of the classes
    soft[:, 1] = rng.normal(0, 0.1, DIM)
    weight = np.where(y > 0, 0.5 / max(1, (y[some] > 0).sum()), 0.5 / max(1, (y[some] == 0).sum())) * some
    size = np.concatenate(([0], np.cumsum(bags.size)))
    a, b, off = passages(bags.first)
    first = bags.first
    del bags, vocabulary, w
    starts, live = off[:-1][some], np.flatnonzero(some)
    adam = [(np.zeros_like(x), np.zeros_like(x)) for x in (emb, soft, bias)]
    for step in range(bag_rounds + passage_rounds):
        w = soft[:, 1] - soft[:, 0]
        per_word = np.add.reduceat((emb @ w)[sub], begin)
        s = np.concatenate(([0.0], np.cumsum(per_word[word], dtype=np.float64)))
        if step < bag_rounds:
            lo, hi = first[:-1][some], first[1:][some]
        else:
            v = (s[b] - s[a]) / (size[b] - size[a])
            top = np.maximum.reduceat(v, starts)
            worst = np.flatnonzero(v == np.repeat(top, np.diff(off)[some]))
            k = worst[np.searchsorted(worst, starts)]  # the first of equals
            lo, hi = a[k], b[k]
        n = size[hi] - size[lo]
        z = (s[hi] - s[lo]) / n + (bias[1] - bias[0])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = weight[live] * (p - y[live])
        line = np.zeros(len(word) + 1)
        np.add.at(line, lo, g / n)
        np.add.at(line, hi, -g / n)
        per_unique = np.bincount(word, weights=np.cumsum(line)[:-1], minlength=len(pick))
        gz = np.bincount(sub, weights=per_unique[sub_word], minlength=1 << BUCKET_BITS).astype(np.float32)
        gw, gb = emb.T @ gz, np.float32(g.sum())
        grads = [np.outer(gz, w).astype(np.float32) + np.float32(1e-7) * emb, np.stack((-gw, gw), axis=1) + np.float32(1e-5) * soft, np.array([-gb, gb], np.float32)]
        for x, gr, (m, q) in zip((emb, soft, bias), grads, adam, strict=True):
            m += np.float32(0.1) * (gr - m)
            q += np.float32(0.01) * (gr * gr - q)
            x -= np.float32(0.05) * (m / (1 - 0.9 ** (step + 1))).astype(np.float32) / (np.sqrt(q / (1 - 0.99 ** (step + 1))) + np.float32(1e-6)).astype(np.float32)
    return Model(emb @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of the id's text leaves this remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, per_class: int, byte_limit: int) -> tuple[list[bytes], np.ndarray]:
    """A bounded sample of labelled texts: (texts, labels). A text that doesn't fit in what is left of its label's bytes is passed over.

    What is chosen is decided on ids and sizes; only the chosen texts, byte_limit in all, are then read and sent. Of several
    texts of a doc_id the shortest, and of those the one of the least hash, stands for it.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts, part))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id")
    # at most per_class ids of each label: a bounded table
    picked = [own.filter(F.col("y") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    sized = rows.join(sample, "doc_id").select("doc_id", "y", F.struct(F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash")).alias("which"))
    found = sized.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("which").alias("which")).select("doc_id", "y", "which.*").orderBy(order, "doc_id").collect()
    room, chosen = [byte_limit // 2, byte_limit // 2], []
    for r in found:
        if r["size"] <= room[r["y"]]:
            room[r["y"]] -= r["size"]
            chosen.append((r["doc_id"], r["hash"], r["y"]))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, hash long, y int"))
    texts = rows.withColumn("hash", F.xxhash64("text")).join(wanted, ["doc_id", "hash"]).select("doc_id", F.col("text").cast("binary")).dropDuplicates(["doc_id"]).collect()
    by_id = {k: bytes(t) for k, t in texts}
    chosen = [(by_id[k], y) for k, _, y in chosen]
    return [t for t, _ in chosen], np.array([y for _, y in chosen], np.int64)


SCHEMA = "doc_id long, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    def block(part, texts):
        return {"doc_id": part.column(0), "score": model.score(texts)}

    return ts.map_blocks(docs, block, SCHEMA)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ts.table(spark, sf_dir, "documents")
    model = fit(*training_rows(docs, ts.table(spark, sf_dir, "labels"), "toxic", 3, 1, PER_CLASS, TRAIN_BYTES))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
