"""Cutting lineage, and the shared folder in which that and scratch tables lie."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list = []


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where that is unset: a temporary folder if all runs in this process, as in tests; on a cluster an
    error, because each machine would write to its own disk. The session's settings stay as they are."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "base" not in _OWN:
        _OWN["base"] = tempfile.mkdtemp(prefix="lodeworks-")
    return _OWN["base"]


def folder(spark: SparkSession, name: str = "table") -> str:
    """A new path below shared(); nothing is there yet. What is written there stays as long as this process, for later reads of lazy results, or until clear()."""
    own = f"{shared(spark)}/lodeworks/{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    _MADE.append((path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path))
    return f"{own}/{name}"


@atexit.register
def clear() -> None:
    """Deletes all that folder() gave out in this process. A long-lived session calls it between jobs."""
    for fs, path in _MADE:
        with contextlib.suppress(Exception):  # the JVM may be gone
            fs.delete(path, True)
    _MADE.clear()
    for path in _OWN.values():
        shutil.rmtree(path, ignore_errors=True)
    _OWN.clear()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint."""
    df.sparkSession.sparkContext.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()
