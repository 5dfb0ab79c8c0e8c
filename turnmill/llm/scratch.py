"""Intermediate tables that outlive a lost executor.

``materialise`` writes a DataFrame as Parquet under the shared folder named by
``spark.checkpoint.dir`` and reads it back, which cuts lineage.  Where that
setting is missing, a local session takes a folder of this process; a session
on a cluster gets an error, as no folder of one machine is seen by the others.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, str] = {}
_lock = threading.Lock()
_notes = threading.local()
_writing: dict[int, list] = {}  # by session: how many writes are under way, and the setting before the first


def shared_dir(spark: SparkSession) -> str:
    """The scratch root of this application inside the shared folder."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        base = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError(f"set {_SETTING} to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="turnmill-")
        _made[app] = f"{base.rstrip('/')}/turnmill-{app}"
        atexit.register(_remove, spark, _made[app])
    return _made[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for noted in getattr(_notes, "lists", ()):
        noted.append(path)
    return path


@contextmanager
def noting_paths() -> Iterator[list[str]]:
    """The paths that this thread takes inside the block, and no other's."""
    _notes.lists = [*getattr(_notes, "lists", ()), []]
    try:
        yield _notes.lists[-1]
    finally:
        _notes.lists = _notes.lists[:-1]


@contextmanager
def _files_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files are removed as soon as a write has ended; the session's own setting comes back after the last one."""
    with _lock:
        state = _writing.setdefault(id(spark), [0, spark.conf.get(_CLEANUP, "false")])
        state[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(_CLEANUP, state[1])
                del _writing[id(spark)]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table.

    The shuffle files of the write are removed as soon as it has ended, as
    nothing reads them again, so an operator's disk use is that of its largest
    step and not the sum of all.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _files_removed(spark):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def free(table: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    _remove(table.sparkSession, table._scratch_path)


def free_all(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone when the process ends
        pass
