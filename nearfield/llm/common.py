"""What the operators of this package share: tables, shared storage, digests."""

from __future__ import annotations

import ctypes
import hashlib
import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nearfield.shared import new_path, shared_dir

Batches = Iterator[pa.RecordBatch]
#: Bytes that a writer gathers before it writes them: with as many writers as tasks, and texts in the rows, this is memory.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the input folder, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _model_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/nearfield/models/{name}"


def kept_model(spark: SparkSession, name: str) -> dict[str, np.ndarray] | None:
    """The arrays of a model that an application has left in the shared folder, or None."""
    try:
        row = spark.read.schema("model binary").parquet(_model_path(spark, name)).first()
    except AnalysisException:  # no such path
        return None
    return dict(np.load(io.BytesIO(bytes(row["model"])), allow_pickle=False)) if row else None


def keep_model(spark: SparkSession, name: str, model: dict[str, np.ndarray]) -> None:
    """Leaves a model of bounded size in the shared folder, for later applications too."""
    made = io.BytesIO()
    np.savez(made, **model)
    spark.createDataFrame([(bytearray(made.getvalue()),)], "model binary").coalesce(1).write.mode("append").parquet(_model_path(spark, name))


def aside(df: DataFrame, taken: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """df, in which columns whose names are taken (whatever their case) have others, and the columns under their own names again."""
    names = {t.lower() for t in taken}
    prefix = "own_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    new = {c: prefix + c if c.lower() in names else c for c in df.columns}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.withColumnsRenamed({c: n for c, n in new.items() if c != n}), [quoted(n).alias(c) for c, n in new.items()]


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, after which the worker, which later tasks use again, gives the memory it has freed back to the system."""

    def then(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return then


def hex_digest(text: str) -> str:
    """SHA-256 as lower-case hex digits."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
