"""Structured Streaming: new files to chunks, sessions with late data, duplicates within a watermark."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import chunkstore as cs
from ..operators import tables


def watch(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet", files_at_once: int = 1000, pattern: str = "*") -> DataFrame:
    """A stream of the rows of new files in a folder."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", pattern).load(path)


def ingest(docs: DataFrame, make_chunks: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, once: bool = True, buckets: int = 64):
    """Chunks of new documents, upserted into a stored table in buckets, batch by batch; `tables.read_buckets` reads it.

    A batch reads and writes the buckets that its rows fall into. Run again, it writes the same rows: the upsert is by id.
    """

    def write(batch: DataFrame, _: int) -> None:
        tables.change_buckets(make_chunks(batch), table, cs.upsert, buckets=buckets)

    w = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()


def session_windows(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """key, start, end and n of sessions: a gap longer than `gap` ends one. Rows later than the watermark are dropped, rows without a time too."""
    s = events.withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def newest_once(rows: DataFrame, ts: str, *keys: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


RUNS = "key string, start timestamp, end timestamp, n long"


def strict_runs(events: DataFrame, key: str, ts: str, gap_minutes: int = 30, late: str = "1 day") -> DataFrame:
    """key, start, end and n of each key's runs, which a gap of more than gap_minutes parts; each comes once it has ended.

    A run has ended when the watermark (`late` behind the latest event) is past its gap: no row that still counts can then join
    it. A timer on that moment ends a key's last run too, and a key without open runs has no state. State holds the runs
    that are open, so rows may come in any order, also rows that join two runs. Rows later than the watermark are dropped, rows
    without a time too.
    """
    gap = gap_minutes * 60_000_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        runs = json.loads(state.get[0]) if state.exists else []
        now = state.getCurrentWatermarkMs() * 1000
        for b in [] if state.hasTimedOut else batches:
            t = b[ts].dropna().to_numpy("datetime64[us]").astype("int64")
            runs += [[int(x), int(x), 1] for x in t if x >= now]
        joined: list[list[int]] = []
        for start, end, n in sorted(runs):
            if joined and start - joined[-1][1] <= gap:
                joined[-1][1:] = [max(joined[-1][1], end), joined[-1][2] + n]
            else:
                joined.append([start, end, n])
        ended = [r for r in joined if r[1] + gap < now]
        if left := joined[len(ended) :]:
            state.update((json.dumps(left),))
            state.setTimeoutTimestamp(max((left[0][1] + gap) // 1000 + 1, now // 1000 + 1))
        elif state.exists:
            state.remove()
        time = lambda c: pd.to_datetime([r[c] for r in ended], unit="us")
        yield pd.DataFrame({"key": [str(k[0])] * len(ended), "start": time(0), "end": time(1), "n": [r[2] for r in ended]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    kept = events.filter(F.col(key).isNotNull()).withWatermark(ts, late)
    return kept.groupBy(key).applyInPandasWithState(step, RUNS, "runs string", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now and ends."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
