"""Quality rules with adaptive thresholds (operator 10).

A rule bounds one measure of a text from above or below. Its cutoff lies beyond the quartiles of that
measure among documents of the same language and source: upper quartile + SPREAD x range, or lower
quartile - SPREAD x range, where the range is the one between the quartiles (or GUARD, where most
documents share a value and there is hardly a range). Quartiles are read from mergeable quantile
sketches of all documents. A sketch counts values in bins of bounded relative width (exact below
2**SUB_BITS); two sketches merge by adding counts, so the result does not depend on how rows were
dealt out. Groups of fewer than `min_group` documents borrow the sketch of their language, or of
everything, which are sums of the groups' sketches. The thresholds, a row per group, are joined back
and filter the documents.

Null text counts as empty. A null language or source is a group of its own. A value that equals its
cutoff passes. Repeated rows each count and each get a verdict, and so does a row without a doc_id. An
empty table gives no rows. `keep_good` judges and keeps each row with all its columns, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import textscan as ts

#: Measures: whole-number rates, per 100,000 but for word_length (characters in 1,000 words).
RATES = ("mark_rate", "word_length", "upper_rate", "dup_line_rate", "repeat_rate")
#: (measure, side): beyond the upper or the lower quartile.
RULES = (("mark_rate", "high"), ("word_length", "high"), ("word_length", "low"), ("upper_rate", "high"), ("dup_line_rate", "high"), ("repeat_rate", "high"))
SUB_BITS = 8
LOWER, UPPER, SPREAD, MIN_GROUP = 0.25, 0.75, 8, 50
#: Groups whose thresholds are broadcast; those of more groups are joined by a shuffle.
MOST_SENT = 50_000
#: The least range that is believed, in each measure's units.
GUARD = {"mark_rate": 100, "word_length": 100, "upper_rate": 500, "dup_line_rate": 5_000, "repeat_rate": 5_000}

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_pipes", "n_marks")
_METRIC_FIELDS = ", ".join(f"{m} long" for m in METRICS)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII in words that is neither letter nor digit
_MARK = ts.NON_SPACE & ~ts.ALNUM


def repeated(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: whether its value occurs elsewhere in the document, and whether earlier."""
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    same = np.zeros(len(h), bool)
    same[1:] = (hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])  # lexsort is stable: the first of a run is the earliest
    again = same.copy()
    again[:-1] |= same[1:]
    some, earlier = np.zeros(len(h), bool), np.zeros(len(h), bool)
    some[order], earlier[order] = again, same
    return some, earlier


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The columns METRICS of each text."""
    data, off = ts.join_texts(texts)
    w = ts.Words(data, off, ts.NON_SPACE, fold=False)
    hasher = ts.Hasher(data)
    h = hasher(w.starts, w.ends)
    # words in 3-word windows that occur twice or more
    full = w.counts >= 3
    n_win = np.where(full, w.counts - 2, 0)
    at = np.repeat(w.first[:-1] - (np.cumsum(n_win) - n_win), n_win) + np.arange(n_win.sum())
    hit = np.zeros(len(h) + 1, np.int64)
    if len(at):
        k1, k2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
        win = ts.mix(ts.mix(h[at] * k1 + h[at + 1]) * k2 + h[at + 2])
        some, _ = repeated(win, np.repeat(np.arange(len(texts)), n_win))
        np.add.at(hit, at[some], 1)
        np.add.at(hit, np.minimum(at[some] + 3, len(h)), -1)
    covered = np.cumsum(hit)[:-1] > 0
    # lines, without the one that ends each document's line feed
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    line_words = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
    starts, ends = starts[line_words > 0], ends[line_words > 0]
    line_doc = np.searchsorted(off, starts, side="right") - 1
    _, earlier = repeated(hasher(starts, ends), line_doc)
    n = len(texts)
    count = lambda m: ts.seg_sum(m, off)
    return {
        "n_words": w.counts, "word_chars": count(w.mask & ((data & 0xC0) != 0x80)), "n_symbols": count(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_doc[earlier], minlength=n), "n_repeat_words": ts.seg_sum(covered, w.first),
        "n_lines": np.bincount(line_doc, minlength=n), "n_upper": count(_UPPER[data]), "n_letters": count(_LETTER[data]), "n_pipes": count(data == 124), "n_marks": count(_MARK[data]),
    }


def bin_of(v: Column) -> Column:
    """Bin of a whole number: itself below 2**SUB_BITS, else its leading SUB_BITS bits and their place."""
    shift = F.greatest(F.length(F.bin(v)) - F.lit(SUB_BITS), F.lit(0))
    return shift.cast("long") * F.lit(1 << SUB_BITS) + F.call_function("shiftright", v, shift)


def bin_value(b: Column) -> Column:
    """The least number of a bin."""
    shift = F.floor(b / F.lit(1 << SUB_BITS)).cast("int")
    return F.call_function("shiftleft", b - shift.cast("long") * F.lit(1 << SUB_BITS), shift)


def rates() -> dict[str, Column]:
    """RATES of measured rows."""
    rate = lambda part, whole, scale=100_000: F.floor(F.lit(scale) * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("long")
    return {"mark_rate": rate("n_marks", "word_chars"), "word_length": rate("word_chars", "n_words", 1_000), "upper_rate": rate("n_upper", "n_letters"), "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words")}


def sketches(rated: DataFrame) -> DataFrame:
    """A row for each language, source, measure and bin with its count."""
    long = rated.select("lang", "source", F.posexplode(F.array(*RATES)).alias("rate", "v"))
    return long.groupBy("lang", "source", "rate", bin_of(F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups: counts of equal bins added."""
    return sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """The lower and upper quartile by group and measure, as the least value of their bins, and the group's size."""
    w = W.partitionBy(*keys, "rate")
    ranked = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * F.lit(q), F.col("bin")))
    found = ranked.groupBy(*keys, "rate").agg(at(LOWER).alias("low"), at(UPPER).alias("high"), F.first("total").alias("size"))
    return found.select(*keys, "rate", F.struct(bin_value(F.col("low")).cast("long").alias("low"), bin_value(F.col("high")).cast("long").alias("high"), "size").alias("q"))


def thresholds(rated: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """A row for each language and source: cut, an array of the cutoffs in the order of RULES."""
    fine = sketches(rated)
    own = quantiles(fine, "lang", "source").alias("f")
    of_lang, of_all = quantiles(merge(fine, "lang"), "lang").alias("l"), quantiles(merge(fine)).alias("a")
    t = own.join(of_lang, F.expr("f.rate = l.rate AND f.lang <=> l.lang")).join(of_all, F.expr("f.rate = a.rate"))
    q = F.when(F.col("f.q.size") >= min_group, F.col("f.q")).when(F.col("l.q.size") >= min_group, F.col("l.q")).otherwise(F.col("a.q"))
    g = t.groupBy("f.lang", "f.source").agg(*[F.max(F.when(F.col("f.rate") == k, q)).alias(r) for k, r in enumerate(RATES)])
    spread = lambda r: F.lit(SPREAD) * F.greatest(F.col(f"{r}.high") - F.col(f"{r}.low"), F.lit(GUARD[r]))
    return g.select("lang", "source", F.array(*[F.col(f"{r}.high") + spread(r) if side == "high" else F.col(f"{r}.low") - spread(r) for r, side in RULES]).alias("cut"))


def _sized(cut: DataFrame, groups: int) -> DataFrame:
    return F.broadcast(cut) if groups <= MOST_SENT else cut


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def _broken() -> Column:
    """Names of the rules that a row with rates and cut breaks."""
    over = lambda k, r, side: F.col(r) > F.get("cut", F.lit(k)) if side == "high" else F.col(r) < F.get("cut", F.lit(k))
    return F.array_compact(F.array(*[F.when(over(k, r, side), F.lit(f"{r}_{side}")) for k, (r, side) in enumerate(RULES)]))


def _metrics_of(texts: list[bytes | None]) -> list[pa.Array]:
    m = measure(texts)
    return [pa.array(m[n].astype(np.int64)) for n in METRICS]


def rated_rows(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, METRICS and RATES of every row of docs."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    schema = T.StructType.fromDDL(f"doc_id long, lang string, source string, {_METRIC_FIELDS}")

    def run(batches):
        for batch in batches:
            for part, texts in ts.in_blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *_metrics_of(texts)], names=schema.names)

    return ts.map_batches(plain, run, schema).withColumns(rates())


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, metrics, base_failed, kept, and the adaptive rules that are broken, for every row of docs (doc_id, text, lang, source)."""
    rated = ts.settle(rated_rows(docs))  # the texts are scanned once; what follows reads the narrow metrics
    joined = rated.alias("d").join(_sized(*ts.settled(thresholds(rated))).alias("c"), F.expr("d.lang <=> c.lang AND d.source <=> c.source"), "left")
    return joined.select("d.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _base_failed().alias("base_failed"), (~_base_failed() & (F.size(_broken()) == 0)).alias("kept"), F.array_join(_broken(), ",").alias("rules"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns.

    Texts are measured twice, once for the thresholds and once where each row is judged: so every row is
    judged by itself, also where doc_ids are null or repeated, and no text is shuffled.
    """
    cut, groups = ts.settled(thresholds(ts.settle(rated_rows(docs))))
    names = [ts.free_name(docs, n) for n in ("metrics", "cut")]
    with_cut = docs.alias("d").join(_sized(cut.withColumnRenamed("cut", names[1]), groups).alias("c"), F.expr("CAST(d.lang AS STRING) <=> c.lang AND CAST(d.source AS STRING) <=> c.source"), "left").select("d.*", f"c.{names[1]}")
    metrics = T.StructType.fromDDL(_METRIC_FIELDS)

    def run(batches):
        for batch in batches:
            for part, texts in ts.in_blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(_metrics_of(texts), names=list(METRICS))], names=[*part.schema.names, names[0]])

    measured = ts.map_batches(with_cut, run, T.StructType([*with_cut.schema.fields, T.StructField(names[0], metrics)]))
    rows = measured.select(F.struct(*ts.quoted(docs.columns)).alias("row"), f"{names[0]}.*", F.col(names[1]).alias("cut"))
    return rows.withColumns(rates()).filter(~_base_failed() & (F.size(_broken()) == 0)).select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(ts.table(spark, sf_dir, "documents"))
