"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='quarry-')}"


_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a temporary one, but only if driver and tasks are
    one process: on a cluster no other machine would see it.

    The folder goes at the end of the ``scope`` it was made in, or when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = _own_folder()
    path = f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    atexit.register(remove, spark, path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables made inside; what is needed later must be written to a folder made outside."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:
        return
    try:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already
        return


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write and read again: lineage ends here, and no lost executor takes rows with it."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
