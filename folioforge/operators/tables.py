"""Stored tables in versions: a pointer file names the one that counts, and is replaced in one step.

A writer fills a new version's folder and then renames the pointer over the old one, which file systems do
atomically; a reader sees the old version or the new one, at any moment and after any crash. Versions
that are older than the retention stay for readers that still use them and then go. One writer at a time.
"""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"
#: Seconds that superseded versions are kept.
RETAIN = 2 * 24 * 3600


def shared_root(spark: SparkSession) -> str:
    """The folder that all machines share; a temporary one only where the session runs on this machine alone."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="folioforge-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """A checkpoint of what is used several times: made once, with a short lineage."""
    sc = df.sparkSession.sparkContext
    root = shared_root(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return df.checkpoint()


class _Files:
    """The Hadoop file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, p: str, text: str) -> None:
        """The file's new contents, by a rename over it."""
        draft = f"{p}.{uuid.uuid4().hex}"
        own = self.fs.makeQualified(self.path(p)).toUri()
        if own.getScheme() == "file":  # the local file system's own rename over a file isn't one step
            at = own.getPath()
            with open(f"{at}.draft", "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(f"{at}.draft", at)
            return
        stream = self.fs.create(self.path(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        overwrite = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        overwrite[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(own, self.conf).rename(self.path(draft), self.path(p), overwrite)

    def folders(self, p: str) -> list[tuple[str, int]]:
        """Names and times (ms) of the folders below one."""
        found = self.fs.listStatus(self.path(p)) if self.exists(p) else []
        return [(s.getPath().getName(), s.getModificationTime()) for s in found if s.isDirectory()]

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def move(self, a: str, b: str) -> None:
        self.fs.mkdirs(self.path(b).getParent())
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"cannot move {a} to {b}")


def exists(spark: SparkSession, path: str) -> bool:
    return _Files(spark, path).exists(path)


def has_parts(spark: SparkSession, path: str, part: str) -> bool:
    """Whether a folder has folders of a partition column: rows were written."""
    return any(name.startswith(f"{part}=") for name, _ in _Files(spark, path).folders(path))


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that counts; none if there is no table."""
    files = _Files(spark, path)
    pointer = f"{path}/{POINTER}"
    return f"{path}/{files.read(pointer).strip()}" if files.exists(pointer) else None


def read(spark: SparkSession, path: str) -> DataFrame:
    if (at := current(spark, path)) is None:
        raise FileNotFoundError(path)
    return spark.read.option("mergeSchema", "true").parquet(at)


def _point(files: _Files, path: str, version: str, retain: float) -> None:
    files.replace(f"{path}/{POINTER}", version)
    old = time.time() - retain
    for name, changed in files.folders(path):
        if name.startswith("v-") and name != version and changed / 1000 < old:
            files.delete(f"{path}/{name}")


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = (), retain: float = RETAIN) -> None:
    """df as the new version of the table; superseded versions older than `retain` seconds go."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{version}")
    _point(_Files(df.sparkSession, path), path, version, retain)


def drop_old(spark: SparkSession, path: str, names: Sequence[str], retain: float) -> None:
    """Deletes the named folders below a path that were last changed more than `retain` seconds ago."""
    files, old = _Files(spark, path), time.time() - retain
    for name, changed in files.folders(path):
        if name in names and changed / 1000 < old:
            files.delete(f"{path}/{name}")


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame | None:
    """The rows of a table in buckets, or of some of its buckets; None if there are none."""
    names = [n for n, _ in _Files(spark, path).folders(path) if n.startswith("b-")] if only is None else [f"b-{k}" for k in only]
    found = [at for n in names if (at := current(spark, f"{path}/{n}"))]
    return spark.read.option("mergeSchema", "true").parquet(*found) if found else None


def change_buckets(new: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], key: str = "id", buckets: int = 64, retain: float = RETAIN) -> None:
    """new merged into a table in buckets by a key's hash: only buckets that new has rows of are read and written.

    Each bucket changes in one step; a run that is cut off between buckets is repeated with the same rows.
    """
    spark = new.sparkSession
    new = new.persist()
    touched = sorted(r[0] for r in new.select(bucket_of(key, buckets)).distinct().collect())  # `buckets` at most
    old = read_buckets(spark, path, touched)
    out = merge(old, new) if old is not None else new
    files, version = _Files(spark, path), f"v-{uuid.uuid4().hex}"
    draft = f"{path}/_draft-{version}"
    out.withColumn("__bucket", bucket_of(key, buckets)).write.partitionBy("__bucket").parquet(draft)
    new.unpersist()
    for k in touched:
        own = f"{path}/b-{k}"
        if files.exists(f"{draft}/__bucket={k}"):
            files.move(f"{draft}/__bucket={k}", f"{own}/{version}")
            _point(files, own, version, retain)
    files.delete(draft)
