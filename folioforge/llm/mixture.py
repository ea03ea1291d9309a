"""Mixing sources to target weights by hash-threshold histograms (operator 12).

Each source has a budget of words. A document's place in its source is a hash, and the mix takes the
documents below a threshold, the same ones for every smaller threshold: budgets are nested, so a source
that is to be repeated is taken whole and then once more up to a threshold. Thresholds are found without
sorting a document: words are summed by source and hash bucket, the bucket in which the running sum
passes the budget is the only one whose documents are looked at again, by the next bits of their hash,
until it holds a single hash. Of the documents of that hash, as a rule one, the mix takes the share that
is left of the budget, rounded down: so a source's words meet its target but for a word, or a word for
each of several rows of one hash.

Targets are shares of the budget by weight; a source whose share is above the most it may give stops
there, and what is left is shared out again among the others until none is above. A round needs two sums
over the table of sources, whose order (for the weights) comes from sorting ranges of it, so that also a
table of very many sources never meets in one task.

Null text has no words. Null sources are one source, the last. The hash is of doc_id and text, so rows
without a doc_id differ by their texts; exact repeats share their fate, each in part at the boundary.
A source without words has a target of 0. An empty table gives no rows. Reruns agree, whatever the
partitions: nothing depends on the order of rows. Columns other than doc_id, source and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import textscan as ts

WEIGHTS = (5, 2, 1)
#: The mix has SHARE_NUM / SHARE_DEN of all words and takes no document more than MOST times.
SHARE_NUM, SHARE_DEN, MOST = 3, 2, 2
#: Bits of a hash, and those that a histogram looks at, at a time.
BITS, STEP = 60, 12
NARROW = 500_000


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the source), size and h of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)), 1, BITS // 4), 16, 10).cast("long")
    # a null source sorts behind all others: their keys begin with 0x01
    key = F.coalesce(F.concat(F.lit("\x01"), F.col("source").cast("string")), F.lit("\x02"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), h.alias("h"))


def in_order(df: DataFrame, column: str) -> DataFrame:
    """df with `place`, its rows' number from 0 by the column; ranges of rows are sorted, never all in one task."""
    ts.shared_dir(df.sparkSession)
    ranged = df.repartitionByRange(F.col(column)).sortWithinPartitions(column).withColumn("place", F.monotonically_increasing_id()).checkpoint()
    part = F.call_function("shiftright", F.col("place"), F.lit(33))
    counts = sorted((r[0], r[1]) for r in ranged.groupBy(part).count().collect())  # a row for each range
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    start = df.sparkSession.createDataFrame(offsets, "part long, before long")
    return ranged.withColumn("part", part).join(F.broadcast(start), "part").withColumn("place", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "before")


def weight_of(place: Column, weights: tuple[int, ...]) -> Column:
    return F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (key, size, ...) with target: shares of SHARE_NUM / SHARE_DEN of all sizes by weight, none above MOST times its size."""
    src = ts.settle(in_order(sources, "key").withColumn("weight", weight_of(F.col("place"), weights)).drop("place"), NARROW)
    total, all_weights = src.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    num, den = SHARE_NUM * total, SHARE_DEN * all_weights  # a source's share is weight * num / den
    above = F.lit(False)
    while True:
        # shares only grow from round to round, so a source that has stopped stays so
        above = F.expr(f"CAST(weight AS DECIMAL(20,0)) * {num} > CAST({MOST} * size AS DECIMAL(20,0)) * {den}")
        stopped, left = src.agg(F.coalesce(F.sum(F.when(above, F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        new = (SHARE_NUM * total - SHARE_DEN * MOST * stopped, SHARE_DEN * left)
        if new == (num, den) or not left:
            break
        num, den = new
    share = (F.col("weight") * F.lit(num)).cast("double") / F.lit(float(den))
    return src.withColumn("target", F.when(above, (MOST * F.col("size")).cast("double")).otherwise(share))


def thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """sources (key, rows_of_key, size, budget) with full (times that a source is taken whole) and, unless nothing is
    left to take, the hash `at` below which documents are taken once more, and that hash's `share` of `tie` words."""
    src = sources.withColumn("full", F.expr("CASE WHEN size > 0 THEN budget div size ELSE 0 END")).withColumn("rest", F.col("budget") - F.col("full") * F.col("size"))
    src = ts.settle(src, NARROW)
    todo = ts.settle(src.filter("rest > 0").select("key", "rows_of_key", "rest"), NARROW)
    inside, n_inside = ts.settled(ts.spread_join(rows.filter("size > 0"), todo.drop("rest"), ["key"], rows.count()), NARROW)
    found = None
    for shift in range(BITS - STEP, -1, -STEP):
        buckets = inside.groupBy("key", F.call_function("shiftright", F.col("h"), F.lit(shift)).alias("bucket"))
        summed = buckets.agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows_of_key"), F.min("h").alias("low"), F.max("h").alias("high"))
        upto = F.sum("words").over(W.partitionBy("key").orderBy("bucket"))  # at most 2**STEP rows of a source
        passed = summed.withColumn("upto", upto).join(todo.select("key", "rest"), "key").filter("upto > rest AND upto - words <= rest")
        edge = ts.settle(passed.select("key", "bucket", "rows_of_key", "words", "low", "high", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")), NARROW)
        done = edge.filter("low = high").select("key", F.col("low").alias("at"), F.col("rest").alias("share"), F.col("words").alias("tie"))
        found = done if found is None else found.union(done)
        todo = edge.filter("low < high")
        if not shift or todo.isEmpty():
            break
        bucketed = inside.withColumn("bucket", F.call_function("shiftright", F.col("h"), F.lit(shift)))
        inside, n_inside = ts.settled(ts.spread_join(bucketed, todo.select("key", "bucket", "rows_of_key"), ["key", "bucket"], n_inside).drop("bucket"), NARROW)
    return src.join(found, "key", "left")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, text, source)."""
    rows, n_rows = ts.settled(measured(docs), NARROW)  # texts are read once
    sources = rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows_of_key"))
    aimed = targets(sources, weights).withColumn("budget", F.floor("target"))
    plan = thresholds(rows, aimed).select("key", "rows_of_key", F.col("size").alias("source_size"), "target", "full", "at", "share", "tie")
    once_more = F.expr("CASE WHEN h < at THEN size WHEN h = at THEN CAST(size AS DECIMAL(19,0)) * CAST(share AS DECIMAL(19,0)) div CAST(tie AS DECIMAL(19,0)) ELSE 0 END")
    planned = ts.spread_join(rows, ts.settle(plan, NARROW), ["key"], n_rows)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + once_more).cast("long").alias("taken"))


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(ts.table(spark, sf_dir, "documents"))
