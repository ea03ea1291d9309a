"""Source divergence audit by inclusion-exclusion over supports (operator 11).

The divergence of two sources of a language is a sum over all terms that the language keeps, but most
of its summands are alike: a term that only one of the two holds costs what its count says, a term that
neither holds costs a constant. So (1) the histogram of each group's prices, set against the other
source's price of an absent term, gives the one-sided sums without a term in sight; (2) a sparse join
of postings, the pairs of sources that share a term, takes the one-sided costs of shared terms back and
adds their true ones; (3) what is left, the terms of neither, is counted and costs the constant. Nothing
is ever made for a term and a source that doesn't hold it.

Texts are read once and give counts by language, source and term, added up in each task before they are
shuffled. Everything behind it is a table of those counts. Postings meet by language and term, so a
source with a third of all rows has a row for each of its terms there, and counts in the histogram
before it meets other sources. A result row for each two sources of a language is the contract's.

All numbers are whole: a price is at most 10**9 + 1, so squares of differences fit 64 bits, and the
product under a price is taken in decimals.

Null text, lang and source count as ''. A group whose documents have no terms, or none that are kept,
has a support of none. A language that keeps no term gives divergences of 0 and no terms. Repeated rows
count each. Ties in value are broken by item. An empty table gives no rows. Columns other than lang,
source and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import textscan as ts
from .tally import codes_of, group_numbers, tally

MIN_DOCS, SCALE, TOP_TERMS = 10, 10**9, 10
#: Groups whose few numbers are broadcast; those of more are joined by a shuffle.
MOST_SENT = 50_000
NARROW = 500_000

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); a key may have several rows."""

    def block(groups: list[pa.Array], texts: list[bytes | None]) -> pa.Table:
        w = ts.Words(*ts.join_texts(texts), _LETTERS, fold=True)
        code, terms = codes_of(w)
        k = max(len(terms), 1)
        group, names = group_numbers(groups)
        key, n = np.unique(np.repeat(group, w.counts) * k + code, return_counts=True)
        once = np.unique(w.doc() * k + code)
        _, holding = np.unique(group[once // k] * k + once % k, return_counts=True)
        of = pa.array(key // k)
        columns = [pa.array([r[c] for r in names], pa.string()).take(of) for c in range(len(groups))]
        return pa.table([*columns, terms.take(pa.array(key % k)), pa.array(n), pa.array(holding)], names=["lang", "source", "term", "n", "docs"])

    return tally(docs, ["lang", "source"], block, ["n", "docs"], "term")


def price(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 2) / total), exactly."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) div CAST({total} AS DECIMAL(20,0))").cast("long")


def cost(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_SENT else df


def postings(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """lang, source, term, n, p (price) of kept terms, with lang_n and the lang's price q; the groups
    (lang, source, v, support, zero: the price of a term they don't hold), and how many groups."""
    counts = term_counts(docs).repartition("lang", "term")  # the sums by source and by language both find their rows together
    by_source = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = W.partitionBy("lang", "term")
    by_source = by_source.withColumns({"holding": F.sum("docs").over(whole), "lang_n": F.sum("n").over(whole), "first": F.col("source") == F.min("source").over(whole)})
    kept = ts.settle(by_source.filter(F.col("holding") >= MIN_DOCS).select("lang", "source", "term", "n", "lang_n", "first"), NARROW)

    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("support"))
    first = F.col("first")
    lang = kept.groupBy("lang").agg(F.count_if(first).alias("v"), F.sum(F.when(first, F.col("lang_n"))).alias("lang_words"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(lang, "lang", "left").fillna(0, ["words", "support", "v", "lang_words"])
    totals = {"total": F.greatest(F.col("words") + 2 * F.col("v"), F.lit(1)), "lang_total": F.greatest(F.col("lang_words") + 2 * F.col("v"), F.lit(1))}
    groups, n_groups = ts.settled(groups.withColumns(totals).withColumn("zero", price("0", "total")).select("lang", "source", "v", "support", "zero", "total", "lang_total"), NARROW)
    priced = kept.join(_sized(groups.select("lang", "source", "total", "lang_total", "zero"), n_groups), ["lang", "source"])
    priced = priced.select("lang", "source", "term", "zero", price("n", "total").alias("p"), price("lang_n", "lang_total").alias("q"))
    return ts.settle(priced, NARROW), groups.select("lang", "source", "v", "support", "zero"), n_groups


def pair_values(posted: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """lang, source, item, value for each two sources of a language, in both directions."""
    # one-sided: each group's terms against every price that another source has for an absent term
    histogram = posted.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    zeros = groups.select("lang", F.col("zero").alias("z")).distinct()
    sided = histogram.join(_sized(zeros, n_groups), "lang").groupBy("lang", "source", "z").agg(F.sum(F.expr(f"k * {cost('p', 'z')}")).alias("one"))
    sided = ts.settle(sided, NARROW)

    # shared terms: their true cost in place of the two one-sided ones
    a, b = posted.alias("a"), posted.alias("b")
    shared = a.join(b, F.expr("a.lang = b.lang AND a.term = b.term AND a.source < b.source"))
    mended = f"{cost('a.p', 'b.p')} - {cost('a.p', 'b.zero')} - {cost('a.zero', 'b.p')}"
    shared = shared.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("x"), F.col("b.source").alias("y")).agg(F.sum(F.expr(mended)).alias("mended"), F.count(F.lit(1)).alias("both"))

    side = lambda name: groups.select("lang", F.col("source").alias(name), F.col("support").alias(f"{name}_n"), F.col("zero").alias(f"{name}_z"), "v")
    pairs = side("x").join(_sized(side("y").drop("v"), n_groups), "lang").filter("x < y")
    one = lambda own, other: sided.select("lang", F.col("source").alias(own), F.col("z").alias(f"{other}_z"), F.col("one").alias(f"{own}_one"))
    pairs = pairs.join(shared, ["lang", "x", "y"], "left").join(one("x", "y"), ["lang", "x", "y_z"], "left").join(one("y", "x"), ["lang", "y", "x_z"], "left").fillna(0, ["mended", "both", "x_one", "y_one"])
    value = F.expr(f"x_one + y_one + mended + (v - x_n - y_n + both) * {cost('x_z', 'y_z')}")
    both_ways = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    return pairs.select("lang", value.alias("value"), both_ways.alias("s")).select("lang", "s.source", "s.item", "value")


def term_values(posted: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms that a group holds above its language's share."""
    return posted.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(cost("p", "q")).alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    posted, groups, n_groups = postings(docs)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank.alias("rank"))
    return ranked(pair_values(posted, groups, n_groups), "pair").union(ranked(term_values(posted), "term").filter(F.col("rank") <= TOP_TERMS))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(ts.table(spark, sf_dir, "documents"))
