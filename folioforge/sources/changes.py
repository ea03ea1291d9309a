"""Files of a folder as a stream of changes: each file that is new or changed comes once, in order of time and path."""

from __future__ import annotations

import datetime
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

#: Files that one task looks at.
FILES = 2_000


class _Paths(InputPartition):
    def __init__(self, paths: list[tuple[str, int, int]]):
        self.paths = paths


def local(path: str) -> str:
    """The path on a file system that all machines have mounted."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path) and not path.startswith("file:"):
        raise ValueError(f"not a mounted folder: {path}")
    return re.sub(r"^file:/*", "/", path)


class _Changes(DataSourceStreamReader):
    """The offset is the last change's time (ns) and path, so a restart goes on behind it. A file that changes while a batch is made has a
    later time, and so is left to the next batch; a batch that is repeated has the files that haven't changed since."""

    def __init__(self, options: dict[str, str]):
        self.root, self.suffixes = local(options["path"]), tuple(x.lower() for x in options.get("suffixes", "").split(",") if x)
        since = options.get("since", "")
        self.since = int(datetime.datetime.fromisoformat(since).timestamp() * 1e9) if since else -1

    def _found(self, after: tuple[int, str], upto: tuple[int, str] | None) -> Iterator[tuple[str, int, int]]:
        for at, folders, names in os.walk(self.root):
            folders[:] = [f for f in folders if f[0] not in "._"]
            for name in names:
                if name[0] in "._" or not name.lower().endswith(self.suffixes or ""):
                    continue
                path = os.path.join(at, name)
                try:
                    s = os.stat(path)
                except FileNotFoundError:
                    continue  # it went meanwhile
                if after < (s.st_mtime_ns, path) and (upto is None or (s.st_mtime_ns, path) <= upto):
                    yield path, s.st_mtime_ns, s.st_size

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": self.since, "path": "\uffff" if self.since >= 0 else ""}

    def latestOffset(self) -> dict:  # noqa: N802
        first = self.initialOffset()
        last = max(((t, p) for p, t, _ in self._found((first["time"], first["path"]), None)), default=(first["time"], first["path"]))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = sorted(self._found((start["time"], start["path"]), (end["time"], end["path"])), key=lambda x: (x[1], x[0]))
        return [_Paths(found[k : k + FILES]) for k in range(0, len(found), FILES)]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        for path, t, size in partition.paths:
            yield path, datetime.datetime.fromtimestamp(t / 1e9, datetime.timezone.utc).replace(tzinfo=None), size

    def commit(self, end: dict) -> None:
        pass


class ChangesSource(DataSource):
    """spark.readStream.format("folder_changes"): path, modified and size of files below a mounted folder as they change."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> StructType:
        return StructType([StructField("path", StringType()), StructField("modified", TimestampType()), StructField("size", LongType())])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Changes(self.options)


def watch_changes(spark: SparkSession, path: str, since: str | None = None, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """A stream of (path, modified, size) of files that were changed after an ISO time, or of all, each time that they change."""
    spark.dataSource.register(ChangesSource)
    r = spark.readStream.format("folder_changes").option("path", path)
    if since:
        r = r.option("since", since)
    return (r.option("suffixes", ",".join(suffixes)) if suffixes else r).load()
