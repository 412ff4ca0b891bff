"""The folder that the driver and all executors share, for what is written and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import SparkSession

_own: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local master (as in tests) gets one of its own, removed at the end; elsewhere nothing is written: a folder of one machine would lose rows."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="nearfield-"))
            atexit.register(shutil.rmtree, _own[0], True)
        where = f"file://{_own[0]}"
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, below one folder for each application."""
    path = f"{shared_dir(spark)}/nearfield/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"
    scope = _scope.get()
    if scope is not None:
        scope.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_all(spark: SparkSession) -> None:
    """Removes all that this application has written to the shared folder; results that are still read from there fail then."""
    remove(spark, f"{shared_dir(spark)}/nearfield/{spark.sparkContext.applicationId}")


@contextmanager
def written() -> Iterator[list[str]]:
    """The paths that are given out within, for the caller to remove when they are no longer read."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(token)
