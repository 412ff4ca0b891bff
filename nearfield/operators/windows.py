"""Sliding windows by whole slides: a window [end - W, end) is evaluated at every multiple of its S."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from nearfield.config import Query


def ends_between(first: Column, last: Column, W: int, S: int) -> Column:
    """Ends of the windows that hold both of two times (first <= last)."""
    low = (F.floor(last / S) + 1) * S
    high = F.floor(first / S) * S + W
    return F.when(low <= high, F.sequence(low, high, F.lit(S).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def assign_windows(points: DataFrame, W: int, S: int) -> DataFrame:
    """A row for each window of each point."""
    return points.withColumn("window_end", F.explode(ends_between(F.col("a"), F.col("a"), W, S)))


def new_slide(members: DataFrame, S: int) -> DataFrame:
    """Of rows with window_end, the points that have come since the last window."""
    return members.where(F.col("a") >= F.col("window_end") - S)


def expired_slide(members: DataFrame, W: int, S: int) -> DataFrame:
    """Of rows with window_end, the points that the next window no longer holds."""
    return members.where(F.col("a") < F.col("window_end") - W + S).select("window_end", "id")


def reportable(flag: Column, countdown: Column, window_end: Column) -> Column:
    """Whether this copy of a point is the one that reports it: owners when the countdown is over, old owners until then."""
    return ((flag == 1) & (countdown >= window_end)) | ((flag == 0) & (countdown < window_end))


def slide_counts(members: DataFrame, S: int) -> DataFrame:
    """How many owners and replicas each window's newest slide brought."""
    new = F.col("a") >= F.col("window_end") - S
    return members.groupBy("window_end").agg(F.count_if(new & (F.col("flag") == 0)).alias("owners"), F.count_if(new & (F.col("flag") == 1)).alias("replicas"))


def queries_frame(spark, queries: Sequence[Query]) -> DataFrame:
    """The queries as rows; as many as the caller has written down."""
    return spark.createDataFrame([(q.W, q.S, float(q.R), q.k) for q in queries], "W long, S long, R double, k int")
