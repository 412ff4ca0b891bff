"""Distances between vectors, as Columns that stay in generated code; of many dimensions, on Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: User metrics by name: functions of two array columns.
METRICS: dict[str, Callable[[Column, Column], Column]] = {}


def euclidean(x: Column, y: Column, dims: int | None = None) -> Column:
    """Over the common prefix of two vectors. With dims known the sum is written out, from left to right."""
    if dims:
        return F.sqrt(sum(((x[i] - y[i]) * (x[i] - y[i]) for i in range(1, dims)), (x[0] - y[0]) * (x[0] - y[0])))
    n = F.least(F.size(x), F.size(y))
    parts = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))


def jaccard(x: Column, y: Column) -> Column:
    """One less the share of common values, of vectors as sets; two empty sets are alike."""
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(x, y)) / union)


def distance(x: Column, y: Column, kind: str = "euclidean", dims: int | None = None) -> Column:
    """The named distance."""
    if kind == "euclidean":
        return euclidean(x, y, dims if dims and dims <= WRITTEN_OUT else None)
    if kind == "jaccard":
        return jaccard(x, y)
    if kind in METRICS:
        return METRICS[kind](x, y)
    raise ValueError(f"unknown distance {kind!r}")


#: Up to so many dimensions a distance is written out in generated code; beyond, it is computed on Arrow batches.
WRITTEN_OUT = 8


def with_distance(rows: DataFrame, x: str, y: str, kind: str, dims: int | None, within: float | None = None) -> DataFrame:
    """rows without x and y, with d, their distance, in its place; within: only those no farther apart."""
    kept = [c for c in rows.columns if c not in (x, y)]
    if kind != "euclidean" or not dims or dims <= WRITTEN_OUT:
        d = distance(F.col(x), F.col(y), kind, dims)
        return (rows if within is None else rows.where(d <= within)).select(*kept, d.alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (b.column(c).flatten().to_numpy().reshape(-1, dims) for c in (x, y))
            total = np.zeros(b.num_rows)
            for i in range(dims):  # from left to right, as in generated code
                gap = left[:, i] - right[:, i]
                total += gap * gap
            d = np.sqrt(total)
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(d)], names=[*kept, "d"])
            yield out if within is None else out.filter(pa.array(d <= within))

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField("d", T.DoubleType())]))


def layer(d: Column, radii: Sequence[float]) -> Column:
    """Number, from 0, of the smallest radius that reaches d; null if none does."""
    out = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(radii))):
        out = F.when(d <= r, i).otherwise(out)
    return out


def gcd_of(values: Sequence[int]) -> int:
    """Greatest common divisor of them all."""
    return math.gcd(*values)


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def slide_start(a: Column, slide: int, start: Column | int = 0) -> Column:
    """Where the slide of a time begins, counted from start."""
    start = F.lit(start) if isinstance(start, int) else start
    return start + F.floor((a - start) / slide) * slide


def vector_hash(x: Column) -> Column:
    """Of the coordinates alone."""
    return F.xxhash64(x)


def contains(x: Column, value: float) -> Column:
    """Whether a vector holds a value."""
    return F.array_contains(x, F.lit(float(value)))
