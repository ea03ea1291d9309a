"""Queries that run a stream over what is there and read what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.tables import shared_root
from ..sources.changes import watch_changes
from ..streaming import incremental as inc
from .registry import query


def shared_folder(t) -> str:
    """A new folder below the one that all machines share."""
    return f"{shared_root(t.spark)}/stream-{uuid.uuid4().hex}"


def _events(t):
    schema = t.events.schema
    return inc.watch(t.spark, t.dir, schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("strm_tumbling_counts", "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    """Daily counts; the watermark's own end closes no window, so what is open is added in batch form."""
    out = shared_folder(t)
    schema = "start timestamp, event_type string, n long"
    q = inc.tumbling(_events(t), "ts", "1 day", "event_type").writeStream.outputMode("update").option("checkpointLocation", out + "/c").foreachBatch(lambda b, k: b.write.mode("append").parquet(f"{out}/t/batch={k}")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = t.spark.read.schema(schema + ", batch int").parquet(out + "/t")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("strm_session_windows", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s")
def _(t):
    """Sessions in batch form: the same function runs on a stream (see the tests)."""
    return inc.session_windows(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


@query("strm_strict_runs", "SELECT CAST(user_id AS VARCHAR) AS key, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS end, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s")
def _(t):
    """Runs of each user as a stream: one more event, long after all others, moves the watermark on, so that the last runs end as well."""
    out = shared_folder(t)
    end = t.events.agg((F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    end.select(F.lit("-").alias("user_id"), "ts").write.parquet(out + "/end")
    events = _events(t).select(F.col("user_id").cast("string").alias("user_id"), "ts").unionByName(inc.watch(t.spark, out + "/end", "user_id string, ts timestamp"))
    inc.run_to_files(inc.strict_runs(events, "user_id", "ts"), out + "/t", out + "/c")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return t.spark.read.schema(inc.RUNS).parquet(out + "/t").select("key", stamp("start"), stamp("end"), "n")


@query("src7_changed_since_stream", "SELECT lang, CASE WHEN lang = (SELECT min(lang) FROM documents) THEN 2 ELSE 1 END AS changes, count(*) AS documents FROM documents GROUP BY lang")
def _(t):
    """A file of each language's documents; one changes after the first run. The second run, from the checkpoint, sees that one alone."""
    out = shared_folder(t)
    docs = t.documents.select("lang", "doc_id")
    docs.repartition("lang").write.partitionBy("lang").parquet(out + "/files")
    run = lambda: inc.run_to_files(watch_changes(t.spark, out + "/files", suffixes=(".parquet",)), out + "/t", out + "/c")
    run()
    least = docs.agg(F.min("lang")).first()[0]
    docs.filter(F.col("lang") == least).drop("lang").coalesce(1).write.mode("overwrite").parquet(f"{out}/files/lang={least}")
    run()
    seen = t.spark.read.parquet(out + "/t").groupBy(F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang")).agg(F.count(F.lit(1)).alias("changes"))
    return seen.join(t.spark.read.parquet(out + "/files").groupBy("lang").agg(F.count(F.lit(1)).alias("documents")), "lang")
