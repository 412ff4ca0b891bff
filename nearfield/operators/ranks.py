"""Ranks over a whole table without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def ranked(rows: DataFrame, column: str, tie: str | None = None) -> DataFrame:
    """rows with rank, from 0, in the order of column: rows are dealt out by ranges, ranked within them, and shifted by the ranges before."""
    order = [column] + ([tie] if tie else [])
    dealt = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    sizes = dealt.groupBy("__part").count()
    # as many rows as there are ranges
    before = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn("rank", F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def at_rank(rows: DataFrame, column: str, rank: int) -> DataFrame:
    """The value at a rank, from 0, one row; none if there are not so many."""
    tally = rows.groupBy(column).agg(F.count("*").alias("__c"))
    placed = ranked_sum(tally, column, "__c")
    return placed.where((F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank)).select(column)


def ranked_sum(rows: DataFrame, column: str, weight: str) -> DataFrame:
    """rows with __upto: the sum of weights in the order of column, this row included."""
    dealt = rows.repartitionByRange(column).withColumn("__part", F.spark_partition_id())
    sizes = dealt.groupBy("__part").agg(F.sum(weight).alias("__w"))
    before = sizes.select("__part", (F.sum("__w").over(Window.orderBy("__part")) - F.col("__w")).alias("__before"))
    own = F.sum(weight).over(Window.partitionBy("__part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn("__upto", F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")
