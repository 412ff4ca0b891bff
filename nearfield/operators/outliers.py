"""Detection: one histogram of neighbours answers every query on windows, slides, radii and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from nearfield.config import Query, checked, step_of
from nearfield.operators import ranges
from nearfield.operators.neighbors import cell_of, histogram, neighbor_pairs
from nearfield.operators.windows import assign_windows, ends_between

ANSWER = ["window_end", "W", "S", "R", "k", "id"]


def radii_of(queries: Sequence[Query]) -> list[float]:
    return sorted({q.R for q in queries})


def neighbor_histogram(points: DataFrame, queries: Sequence[Query], kind: str = "euclidean", dims: int | None = None, left: DataFrame | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Up to the largest radius and window."""
    R, W, step = max(q.R for q in queries), max(q.W for q in queries), step_of(queries)
    if ranges.suits(kind, dims, R) and not within and W // step <= ranges.MOST_SLIDES:
        return ranges.histogram(points, radii_of(queries), W, step, left)
    return histogram(neighbor_pairs(points, R, W, step, kind, dims, left, within), radii_of(queries), within)


#: Slides of a window from which on counts are summed by steps up and down instead of once for each window.
LONG = 8


def window_counts(points: DataFrame, hist: DataFrame, queries: Sequence[Query], within: Sequence[str] = (), long: int = LONG) -> DataFrame:
    """window_end, W, S, id, n0..: neighbours within each radius, of every point in every window it is in; points without any included.

    In short windows a row of the histogram is repeated for each window that holds both slides, and summed. In long ones, where that would be a row for each slide of the window, it is a step up at the first such window and a step down behind the last, and a running sum over a point's own steps gives the counts."""
    step, radii = step_of(queries), radii_of(queries)
    sl = F.floor(F.col("a") / step)
    first, last = F.least("sl", "nsl") * step, F.greatest("sl", "nsl") * step
    out = None
    spaces = sorted({(q.W, q.S) for q in queries})
    layers = [F.sum(F.when(F.col("layer") <= i, F.col("c")).otherwise(0)).alias(f"n{i}") for i in range(len(radii))]
    short = [(W, S) for W, S in spaces if W // step <= long]
    if short:
        alone = points.select(*within, "id", sl.alias("sl"), sl.alias("nsl"), F.lit(None).cast("int").alias("layer"), F.lit(0).cast("long").alias("c"))
        rows = hist.select(*within, "id", "sl", "nsl", "layer", "c").unionByName(alone)
        ends = [F.struct(F.lit(W).cast("long").alias("W"), F.lit(S).cast("long").alias("S"), ends_between(first, last, W, S).alias("ends")) for W, S in short]
        dealt = rows.select(*within, "id", "layer", "c", F.explode(F.array(*ends)).alias("w")).select(*within, "id", "layer", "c", "w.W", "w.S", F.explode("w.ends").alias("window_end"))
        out = dealt.groupBy("window_end", "W", "S", *within, "id").agg(*layers)
    for W, S in spaces:
        if (W, S) in short:
            continue
        up, down = (F.floor(last / S) + 1) * S, F.floor(first / S) * S + W + S
        steps = F.explode(F.array(F.struct(up.alias("e"), F.col("c").alias("c")), F.struct(down.alias("e"), (-F.col("c")).alias("c"))))
        moves = hist.where(up < down).select(*within, "id", "layer", steps.alias("m")).select(*within, "id", "layer", "m.c", F.col("m.e").alias("window_end"), F.lit(False).alias("own"))
        asked = points.select(*within, "id", F.lit(None).cast("int").alias("layer"), F.lit(0).cast("long").alias("c"), F.explode(ends_between(F.col("a"), F.col("a"), W, S)).alias("window_end"), F.lit(True).alias("own"))
        frame = Window.partitionBy(*within, "id").orderBy("window_end").rangeBetween(Window.unboundedPreceding, 0)
        sums = [F.sum(F.when(F.col("layer") <= i, F.col("c")).otherwise(0)).over(frame).alias(f"n{i}") for i in range(len(radii))]
        counts = moves.unionByName(asked).select("window_end", F.lit(W).cast("long").alias("W"), F.lit(S).cast("long").alias("S"), *within, "id", "own", *sums).where("own").drop("own")
        out = counts if out is None else out.unionByName(counts)
    return out


def _asked(counts: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """counts with a row for each query on the window: R, k, n."""
    radii = radii_of(queries)
    options = [F.struct(F.lit(q.W).cast("long").alias("qW"), F.lit(q.S).cast("long").alias("qS"), F.lit(float(q.R)).alias("R"), F.lit(q.k).alias("k"), F.col(f"n{radii.index(q.R)}").alias("n")) for q in queries]
    return counts.withColumn("q", F.explode(F.array(*options))).select("window_end", "W", "S", "id", "q.*").where("W = qW and S = qS").drop("qW", "qS")


def outliers_of(counts: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """window_end, W, S, R, k, id, of the points with fewer than k neighbours."""
    return _asked(counts, queries).where(F.col("n") < F.col("k")).select(*ANSWER)


def _tightest(queries: Sequence[Query]) -> Query:
    """The smallest radius and window with the largest count: dense for it is dense for all."""
    return Query(min(q.W for q in queries), step_of(queries), min(q.R for q in queries), max(q.k for q in queries))


def prunable(queries: Sequence[Query], kind: str, dims: int | None) -> bool:
    return kind == "euclidean" and bool(dims) and dims <= 3 and min(q.R for q in queries) > 0


def doubtful(points: DataFrame, queries: Sequence[Query], dims: int, by_slide: bool, within: Sequence[str] = (), asked: DataFrame | None = None) -> DataFrame:
    """The points with a window in which their cell is not dense: only their neighbours need counting, as all in a dense cell are inliers. by_slide: cells are counted once a slide, and slides summed up to windows. within: columns that part the points. asked: those that are asked for, if not all."""
    q = _tightest(queries)
    asked = points if asked is None else asked
    cells = [cell_of(i, q.R, dims).alias(f"c{i}") for i in range(dims)]
    names = [*within, *(f"c{i}" for i in range(dims))]
    if by_slide:
        sl = F.floor(F.col("a") / q.S)
        slides = points.select(sl.alias("sl"), *within, *cells).groupBy("sl", *names).agg(F.count("*").alias("c"))
        ends = slides.withColumn("window_end", F.explode(ends_between(F.col("sl") * q.S, F.col("sl") * q.S, q.W, q.S)))
        full = ends.groupBy("window_end", *names).agg(F.sum("c").alias("c"))
    else:
        full = assign_windows(points, q.W, q.S).select("window_end", *within, *cells).groupBy("window_end", *names).agg(F.count("*").alias("c"))
    members = assign_windows(asked, q.W, q.S).select("window_end", "id", *within, *cells)
    open_ = members.join(full.where(F.col("c") > q.k).select("window_end", *names), ["window_end", *names], "left_anti").select(*within, "id").distinct()
    return asked.join(open_, [*within, "id"], "left_semi")


def detect(points: DataFrame, queries: Sequence[Query], kind: str = "euclidean", dims: int | None = None, prune: bool = True) -> DataFrame:
    """The outliers of all queries. prune: points that stand in dense cells in all their windows are not joined."""
    queries = checked(queries)
    left = doubtful(points, queries, dims, True) if prune and prunable(queries, kind, dims) else None
    return outliers_of(window_counts(points if left is None else left, neighbor_histogram(points, queries, kind, dims, left), queries), queries)


def tally(found: DataFrame, points: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """window_end, W, S, R, k, n_outliers, of the outliers found and of every window that holds a point, zeros included."""
    counts = found.groupBy("window_end", "W", "S", "R", "k").agg(F.count("*").alias("n_outliers"))
    step = step_of(queries)
    slides = points.select((F.floor(F.col("a") / step) * step).alias("a")).distinct()
    options = [F.struct(F.lit(q.W).cast("long").alias("W"), F.lit(q.S).cast("long").alias("S"), F.lit(float(q.R)).alias("R"), F.lit(q.k).alias("k"), ends_between(F.col("a"), F.col("a"), q.W, q.S).alias("ends")) for q in queries]
    none = slides.select(F.explode(F.array(*options)).alias("q")).select(F.explode("q.ends").alias("window_end"), "q.W", "q.S", "q.R", "q.k", F.lit(0).cast("long").alias("n_outliers"))
    return counts.unionByName(none).groupBy("window_end", "W", "S", "R", "k").agg(F.sum("n_outliers").alias("n_outliers"))


def report(points: DataFrame, queries: Sequence[Query], kind: str = "euclidean", dims: int | None = None) -> DataFrame:
    """Counts of the outliers of all queries, zeros included."""
    queries = checked(queries)
    return tally(detect(points, queries, kind, dims), points, queries)
