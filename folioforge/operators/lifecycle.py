"""Incremental maintenance: what changed, what to do first, what may be deleted."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


ORPHAN_SHARE, ORPHAN_COUNT, CATCHUP_COUNT = 0.02, 25, 100


def classify(catalogue: DataFrame, stored: DataFrame, stub_only: DataFrame | None = None) -> DataFrame:
    """Flags of every catalogue book against the stored hashes.

    catalogue: id, metadata_hash, annotation_hash; stored: the same. A book that isn't stored is new. An
    empty stored metadata hash means that it isn't known, so it is no change; annotations count either way.
    """
    s = stored.select(F.col("id").alias("__sid"), F.col("metadata_hash").alias("__m"), F.col("annotation_hash").alias("__a"))
    j = catalogue.join(s, F.col("id") == F.col("__sid"), "left")
    if stub_only is not None:
        j = j.join(stub_only.select(F.col("id").alias("__stub")), F.col("id") == F.col("__stub"), "left")
    known = F.col("__sid").isNotNull()
    empty = F.lit("")
    meta = known & (F.coalesce("__m", empty) != "") & (F.col("metadata_hash") != F.col("__m"))
    annot = known & (F.coalesce("annotation_hash", empty) != F.coalesce("__a", empty))
    pending = known & F.col("__stub").isNotNull() if stub_only is not None else F.lit(False)
    return j.select("id", (~known).alias("is_new"), F.coalesce(meta, F.lit(False)).alias("metadata_changed"), F.coalesce(annot, F.lit(False)).alias("annotations_changed"), pending.alias("fulltext_pending")).withColumn(
        "unchanged", ~(F.col("is_new") | F.col("metadata_changed") | F.col("annotations_changed") | F.col("fulltext_pending"))
    )


def scan_counts(flags: DataFrame) -> DataFrame:
    names = ("is_new", "metadata_changed", "annotations_changed", "fulltext_pending", "unchanged")
    return flags.agg(*[F.count_if(n).alias(n) for n in names])


def seeded_signatures(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items (id, signature) with whether their attachment changed: an item without a cached signature is seeded, not changed."""
    c = cache.select(F.col("id").alias("__c"), F.col("signature").alias("__sig"))
    return items.join(c, F.col("id") == F.col("__c"), "left").select("id", "signature", F.coalesce(F.col("__sig") != F.col("signature"), F.lit(False)).alias("changed"), F.col("__sig").isNull().alias("seeded"))


def index_order(books: DataFrame, priority: Column, limit: int | None = None) -> DataFrame:
    """Named books first, then five stars, four stars and the rest, newest id first."""
    tier = F.when(F.coalesce("rating", F.lit(0)) >= 10, 0).when(F.coalesce("rating", F.lit(0)) >= 8, 1).otherwise(2)
    keyed = books.withColumns({"group_no": F.when(priority, 0).otherwise(1), "tier": tier})
    out = keyed.orderBy("group_no", "tier", F.desc("id"))
    return out.limit(limit) if limit else out


def orphans(stored: DataFrame, catalogue: DataFrame) -> DataFrame:
    return stored.join(catalogue.select("id"), "id", "left_anti")


def orphan_bound(stored: DataFrame, catalogue: DataFrame, allow_large: bool = False, partial: bool = False) -> DataFrame:
    """One row: how many orphans, their share, and whether they may be deleted.

    Refused for a partial scan, for an empty catalogue, and where both the share and the count are large.
    """
    n = orphans(stored, catalogue).agg(F.count(F.lit(1)).alias("orphans"))
    total = stored.agg(F.count(F.lit(1)).alias("indexed"))
    there = catalogue.agg(F.count(F.lit(1)).alias("catalogue"))
    row = n.crossJoin(total).crossJoin(there).withColumn("share", F.when(F.col("indexed") > 0, F.col("orphans") / F.col("indexed")).otherwise(0.0))  # three single rows
    large = (F.col("share") > ORPHAN_SHARE) & (F.col("orphans") > ORPHAN_COUNT)
    return row.select("orphans", "indexed", "share", (F.lit(not partial) & (F.col("catalogue") > 0) & (F.lit(allow_large) | ~large)).alias("allowed"))


def remove_orphans(chunks: DataFrame, catalogue: DataFrame, key: str = "book_id", allow_large: bool = False, partial: bool = False) -> DataFrame:
    """chunks without orphans, or all of them where the bound refuses."""
    stored = chunks.select(F.col(key).alias("id")).distinct()
    known = catalogue.select("id")
    gone = orphans(stored, known).crossJoin(F.broadcast(orphan_bound(stored, known, allow_large, partial).select("allowed"))).filter("allowed").select(F.col("id").alias("__gone"))
    return chunks.join(gone, F.col(key) == F.col("__gone"), "left_anti")


def catchup(marked: DataFrame, flat: DataFrame, hierarchical: DataFrame) -> DataFrame:
    """Books to embed elsewhere: the marked ones, and flat ones without a hierarchy; how says which."""
    derived = flat.select("id").distinct().join(hierarchical.select("id"), "id", "left_anti").join(marked.select("id"), "id", "left_anti")
    return marked.select("id", F.lit("marked").alias("how")).distinct().union(derived.select("id", F.lit("derived").alias("how")))


def catchup_bound(nominated: DataFrame) -> DataFrame:
    return nominated.agg(F.count_if(F.col("how") == "derived").alias("derived")).withColumn("allowed", F.col("derived") <= CATCHUP_COUNT)


def sessions(rows: DataFrame, key: str, ts: str, order: str, gap_minutes: int = 30) -> DataFrame:
    """rows with the number of their session: a gap strictly longer starts one; rows without a time come last and join the current one."""
    t = F.unix_micros(F.col(ts))
    w = W.partitionBy(key).orderBy(F.col(ts).asc_nulls_last(), order)
    return rows.withColumn("session", F.sum((F.coalesce(t - F.lag(t).over(w), F.lit(0)) > gap_minutes * 60_000_000).cast("long")).over(w))


def run_rollup(history: DataFrame, queues: Iterable[str], flows: Iterable[str]) -> DataFrame:
    """Runs of each source (skipped, exit_code, timestamp): counts, the sum of flows, the greatest queues, the last run."""
    ran = ~F.coalesce("skipped", F.lit(False))
    return history.groupBy("source").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(ran & (F.col("exit_code") == 0)).alias("successes"), F.count_if(ran & (F.col("exit_code") != 0)).alias("failures"), F.count_if(~ran).alias("skips"),
        *[F.sum(c).alias(c) for c in flows], *[F.max(c).alias(c) for c in queues], F.max(F.when(ran, F.col("timestamp"))).alias("last_run"),
    )


def standstills(rollup: DataFrame, queue: str, flow: str) -> DataFrame:
    """Sources that had something waiting and took in nothing."""
    return rollup.filter((F.col(queue) > 0) & (F.coalesce(flow, F.lit(0)) == 0)).select("source", queue)


def should_skip(marker: date | None, frequency: str, today: date) -> bool:
    """Whether a daily or weekly routine has already run: same day, or same ISO week."""
    if marker is None:
        return False
    return marker == today if frequency == "daily" else marker.isocalendar()[:2] == today.isocalendar()[:2]


def same_period(a: Column, b: Column, frequency: str) -> Column:
    """should_skip as a Column."""
    iso = lambda c: F.struct(F.extract(F.lit("YEAROFWEEK"), c), F.weekofyear(c))
    return F.to_date(a) == F.to_date(b) if frequency == "daily" else iso(F.to_date(a)) == iso(F.to_date(b))


def execution_plan(vram_gb: float | None, mode: str = "balanced") -> dict[str, object]:
    """Batch size and device class by memory; Spark's own settings take the place of the rest."""
    kind = "cpu" if not vram_gb else "small" if vram_gb < 8 else "medium" if vram_gb < 16 else "large"
    batch = {"cpu": 4, "small": 8, "medium": 32, "large": 64}[kind]
    return {"class": kind, "batch": max(1, batch // 2) if mode == "light" else batch, "device": "cpu" if kind == "cpu" else "cuda", "hierarchical": mode != "light"}


def report_tool_output(text: Column, schema: str) -> Column:
    """The last line of a log that is a JSON object, read by a schema."""
    return F.from_json(F.element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike(r"^\{.*\}$")), -1), schema)


def interests(local: dict | None, master: dict | None) -> list[str]:
    """Keywords of the layered configuration: a local list replaces the master's."""
    own = (local or {}).get("research_interests")
    return list(own if own is not None else (master or {}).get("research_interests", []))


