"""Cutting lineage through tables in the shared folder of the cluster.

Loops write each round as a table under ``spark.checkpoint.dir`` and read it
back, so a lost executor costs the current round only. The folder is read from
the session. Where the session names none, a temporary folder serves a local
master only; on a cluster that is refused, as executors don't share their disks.

A table is deleted as soon as nothing reads it (``Scratch.drop``). What a returned
DataFrame still reads stays until ``release`` or the end of the program.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_ROOTS: dict[str, SparkSession] = {}

#: A side is broadcast only if its counted rows are at most so many; rows of scratch tables are narrow.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, or a temporary one of a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


class Scratch:
    """Tables of one job in the shared folder, removed when no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        if not _ROOTS:
            atexit.register(release)
        _ROOTS[self.root] = spark

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def cut(self, df: DataFrame, name: str = "t", **measures: Column) -> DataFrame:
        """Write ``df`` and return the table read back: same rows, no lineage.

        ``rows`` tells how many, ``measured`` what the aggregates ``measures`` came to on the way.
        """
        p, seen = self.path(name), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in measures.items())).write.parquet(p)
        out = self.spark.read.schema(df.schema).parquet(p)
        out._pathloom_path, out._pathloom_seen = p, dict(seen.get)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by ``cut`` that nothing reads any more."""
        for t in tables:
            if p := getattr(t, "_pathloom_path", None):
                remove(self.spark, p)


def rows(table: DataFrame) -> int:
    """Rows of a table made by ``cut``, counted while it was written."""
    return table._pathloom_seen.get("n") or 0


def measured(table: DataFrame) -> dict:
    """Aggregates taken while a table of ``cut`` was written."""
    return table._pathloom_seen


def sized(table: DataFrame) -> DataFrame:
    """A table of ``cut`` as a join side: broadcast if its counted rows are few, else never."""
    return F.broadcast(table) if rows(table) <= BROADCAST_ROWS else table.hint("merge")


def shared_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path of the shared folder, and the path in it."""
    local = urlparse(path).scheme in ("", "file")
    return (pafs.LocalFileSystem(), urlparse(path).path) if local else pafs.FileSystem.from_uri(path)


def read_shared(path: str, **options) -> pa.Table:
    """A table of ``cut``, whose size the caller has checked, as a task reads it from the shared folder."""
    fs, p = shared_fs(path)
    return pq.read_table(p, filesystem=fs, **options)


def write_shared(path: str, table: pa.Table) -> None:
    """A file of the shared folder as a task writes it; ``read_shared`` reads it."""
    fs, p = shared_fs(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    pq.write_table(table, p, filesystem=fs)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``build()`` cuts, made once a program for each ``key`` and again if it is gone."""
    key = (spark.sparkContext.applicationId, *key)
    if key in _KEPT:
        fs, p = _file_system(spark, _KEPT[key]._pathloom_path)
        if fs.exists(p):
            return _KEPT[key]
    _KEPT[key] = build()
    return _KEPT[key]


_OBJECTS: dict[tuple, object] = {}


def kept_object(spark: SparkSession, key: tuple, build: Callable[[], object]):
    """What ``build()`` makes, once a program for each ``key`` and again if its folder ``path`` is gone."""
    key = (spark.sparkContext.applicationId, *key)
    made = _OBJECTS.get(key)
    if made is not None:
        fs, p = _file_system(spark, made.path)
        if fs.exists(p):
            return made
    _OBJECTS[key] = build()
    return _OBJECTS[key]


def release() -> None:
    """Delete all scratch tables of this program; for callers that are done with what was returned so far."""
    for root in list(_ROOTS):
        spark = _ROOTS.pop(root)
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            remove(spark, root)
        elif root.startswith("file:"):
            import shutil

            shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)
