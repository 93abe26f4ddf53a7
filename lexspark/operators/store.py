"""Tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is still to be deleted: paths with their file system, which outlives a session that is stopped.
_MADE: dict[str, tuple] = {}
#: The paths made in the innermost scratch().
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of its own in local mode, else an error."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (conf.get("spark.master", "") or "").startswith("local") or "cluster" in conf.get("spark.master", ""):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lexspark-")  # one machine
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is still there when the driver ends is deleted."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _MADE[path] = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
    if (own := _SCOPE.get()) is not None:
        own.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _MADE.pop(path, None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose tables go at its end, but for what it stores with the function that it is given."""
    own: list[str] = []
    kept: list[str] = []
    token = _SCOPE.set(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        before = len(own)
        out = stored(df, name)
        kept.append(own.pop(before))
        return out

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        for path in own:
            if path in _MADE:
                remove(spark, path)
        if (outer := _SCOPE.get()) is not None:
            outer.extend(kept)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors cost nothing."""
    return _stored(df, name, {})


def compact(df: DataFrame, name: str) -> DataFrame:
    """stored() in zstd, for large tables."""
    return _stored(df, name, {"compression": "zstd"})


def _stored(df: DataFrame, name: str, options: dict[str, str]) -> DataFrame:
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a stored table up to which sent() sends it to all tasks.
MOST_SENT = 1_000_000
_ROWS: dict[str, int] = {}


def sent(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """A stored table of up to most rows for a broadcast join; one with more is joined by a shuffle, with the same result."""
    files = df.inputFiles()
    path = files[0].rsplit("/", 1)[0] if files else ""
    if path not in _ROWS:
        _ROWS[path] = df.count() if files else 0
    return F.broadcast(df) if _ROWS[path] <= most else df


#: Hashes up to which hashed() sends them to all tasks, at some 25 bytes each.
MOST_HASHES = 8_000_000


def hashed(rows: DataFrame, cols: list[Column], keys: DataFrame) -> DataFrame:
    """The rows of which the hash of cols is that of one of keys(_h), and a few others that a join must sort out: all, if keys are too many to send.

    So that a join with a table too large to be sent shuffles what it joins and not all rows.
    """
    keys = stored(keys.distinct(), "hashes")
    if keys.count() > MOST_HASHES:
        return rows
    return rows.withColumn("_h", F.xxhash64(*cols)).join(F.broadcast(keys), "_h", "left_semi").drop("_h")


def drop_stored(df: DataFrame) -> None:
    """Deletes what stored() wrote for df."""
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, d)
        _MADE.pop(d.removeprefix("file://"), None)


@atexit.register
def _leave_nothing() -> None:
    for fs, at in _MADE.values():
        with contextlib.suppress(Exception):  # the JVM may have ended; there is nobody to tell
            fs.delete(at, True)
