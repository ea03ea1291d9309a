"""Rows of a stored index in batches: what changes is written beside what is there, and what is gone is named.

A change writes the rows it brings, by list or bucket, and the keys whose older rows it takes away (`gone`); nothing that is
stored is read or rewritten. A reader takes rows of the parts it needs and leaves out those that a later batch took away, by
an anti join; `merge` writes what is left as one batch, from time to time. Which batches count is a row of a table of its own
(`tables`), so a change is there as a whole or not at all; one that was cut off is written over by the next. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

#: Rows of a part in a file, and keys that are broadcast at most.
FILE_ROWS, MOST_SENT = 200_000, 500_000
STATE = "batches array<long>, gone array<long>, sizes array<long>, merges array<long>, last long"


@dataclass
class State:
    """Batches with rows, batches that take rows away and how many keys, batches that are merges of all before, and the last one."""

    batches: list[int]
    gone: list[int]
    sizes: list[int]
    merges: list[int]
    last: int

    def upto(self, last: int | None) -> tuple[list[int], list[int], int]:
        """What counts as of a batch: batches with rows, batches that take away, and the keys of these."""
        end = self.last if last is None else last
        begin = max([m for m in self.merges if m <= end], default=0)
        gone = [(k, n) for k, n in zip(self.gone, self.sizes, strict=True) if begin < k <= end]
        return [k for k in self.batches if begin <= k <= end], [k for k, _ in gone], sum(n for _, n in gone)


class Segments:
    """Rows with a key and a part (a column of whole numbers that folders are made of).

    Tables that belong together share batch numbers: `batch` says which one a change is, and `upto` how far another has come.
    """

    def __init__(self, spark: SparkSession, path: str, part: str, key: str = "id", order: Sequence[str] = ()):
        self.spark, self.path, self.part, self.key, self.order = spark, path, part, key, list(order) or [key]
        self._seen: tuple[str, State] | None = None

    def state(self) -> State:
        at = tables.current(self.spark, f"{self.path}/state")
        if at is None:
            return State([], [], [], [], 0)
        if self._seen is None or self._seen[0] != at:
            self._seen = at, State(**self.spark.read.parquet(at).first().asDict())
        return self._seen[1]

    def _publish(self, s: State, retain: float) -> None:
        tables.publish(self.spark.createDataFrame([(s.batches, s.gone, s.sizes, s.merges, s.last)], STATE), f"{self.path}/state", (), retain)

    def _write(self, rows: DataFrame, batch: int) -> bool:
        """rows as a batch; the rows of a large part are dealt over several tasks and files."""
        rows = tables.settle(rows)
        sizes = rows.groupBy(self.part).agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("__files"))  # a row for each part
        dealt = rows.join(F.broadcast(sizes), self.part).withColumn("__file", F.pmod(F.xxhash64(self.key), F.col("__files")))
        dealt = dealt.repartition(self.part, "__file").sortWithinPartitions(self.part, *self.order).drop("__file", "__files")
        dealt.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy(self.part).parquet(f"{self.path}/rows/batch={batch}")
        return not rows.isEmpty()

    def put(self, rows: DataFrame, batch: int) -> bool:
        """rows as a batch that doesn't count yet; each part's rows are dealt over few tasks already. Whether there were any."""
        at = f"{self.path}/rows/batch={batch}"
        rows.sortWithinPartitions(self.part, *self.order).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy(self.part).parquet(at)
        return tables.has_parts(self.spark, at, self.part)

    def batch(self, batch: int) -> DataFrame:
        """The rows of one batch, whether it counts or not."""
        at = f"{self.path}/rows/batch={batch}"
        return self.spark.read.option("basePath", at).parquet(at)

    def change(self, rows: DataFrame | None, gone: DataFrame | None = None, retain: float = tables.RETAIN, batch: int | None = None, whole: bool = False, dealt: bool = False, written: bool = False) -> None:
        """rows come in; older rows of the keys in `gone` are no longer there, or none if the rows are the whole table.

        dealt: the rows are as `put` wants them; written: rows of this batch were put there before.
        """
        s = self.state()
        batch = batch or s.last + 1
        has = written or (rows is not None and (self.put if dealt else self._write)(rows, batch))
        n = 0
        if gone is not None:
            gone = tables.settle(gone.select(self.key).distinct())
            if n := gone.count():
                gone.write.mode("overwrite").parquet(f"{self.path}/gone/batch={batch}")
        # a batch of this number that never came to count is written over
        earlier = [(k, m) for k, m in zip(s.gone, s.sizes, strict=True) if k < batch]
        self._publish(State([k for k in s.batches if k < batch] + [batch] * has, [k for k, _ in earlier] + [batch] * bool(n), [m for _, m in earlier] + [n] * bool(n), [m for m in s.merges if m < batch] + [batch] * whole, batch), retain)

    def stored(self, upto: int | None = None) -> DataFrame | None:
        """All rows of the batches that count, with `batch`; filters on part and key reach the scan."""
        batches = self.state().upto(upto)[0]
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/batch={k}" for k in batches]) if batches else None

    def gone(self) -> DataFrame | None:
        """key and gone_at, the last batch that took its rows away; marked for broadcast if the keys are few."""
        _, batches, n = self.state().upto(None)
        if not batches:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/gone").parquet(*[f"{self.path}/gone/batch={k}" for k in batches])
        last = rows.groupBy(self.key).agg(F.max("batch").alias("gone_at"))
        return F.broadcast(last) if n <= MOST_SENT else last

    def without_gone(self, rows: DataFrame) -> DataFrame:
        """Rows with key and batch that no later batch took away."""
        if (gone := self.gone()) is None:
            return rows
        return rows.alias("r").join(gone.alias("g"), (F.col(f"r.{self.key}") == F.col(f"g.{self.key}")) & (F.col("r.batch") < F.col("g.gone_at")), "left_anti")

    def live(self) -> DataFrame | None:
        rows = self.stored()
        return self.without_gone(rows) if rows is not None else None

    def merge(self, make: Callable[[DataFrame], DataFrame] | None = None, retain: float = tables.RETAIN, batch: int | None = None) -> None:
        """What is left, as one batch; `make` puts the rows together anew. What the merge before this one replaced goes once `retain` seconds have passed."""
        s, live = self.state(), self.live()
        batch = batch or s.last + 1
        has = live is not None and self._write((make or (lambda d: d.drop("batch")))(live), batch)
        begin = max([m for m in s.merges if m < batch], default=0)
        gone = [(k, n) for k, n in zip(s.gone, s.sizes, strict=True) if begin < k < batch]
        self._publish(State([k for k in s.batches if begin <= k < batch] + [batch] * has, [k for k, _ in gone], [n for _, n in gone], [m for m in (begin,) if m] + [batch], batch), retain)
        for kind, old in (("rows", s.batches), ("gone", s.gone)):
            tables.drop_old(self.spark, f"{self.path}/{kind}", [f"batch={k}" for k in old if k < begin], retain)
