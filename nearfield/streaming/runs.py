"""A table replayed as a stream, and the answers gathered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from nearfield.config import Query
from nearfield.shared import new_path
from nearfield.streaming.adaptive import Control
from nearfield.streaming.detect import replay


def _as_files(spark, points: DataFrame, at: str, files: int) -> DataFrame:
    """The points as a stream of a few files, later files holding later points."""
    bounds = points.stat.approxQuantile("a", [i / files for i in range(1, files)], 0.01) if files > 1 else []
    part = sum((F.when(F.col("a") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    points.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(f"{at}/in")
    return spark.readStream.schema("id long, value array<double>, a long, part int").option("maxFilesPerTrigger", 1000).parquet(f"{at}/in").drop("part")


def replay_table(spark, points: DataFrame, queries: Sequence[Query], files: int = 4, kind: str = "euclidean", dims: int | None = None, control: Control | None = None) -> DataFrame:
    """Writes the points as a few files, streams them, and returns all answers."""
    at = new_path(spark, "stream")
    stream = _as_files(spark, points, at, files)
    replay(spark, stream, queries, lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), at, kind=kind, dims=dims, control=control)
    return spark.read.schema("window_end long, W long, S long, R double, k int, id long").parquet(f"{at}/out")
