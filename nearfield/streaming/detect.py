"""Detection on streams: a window's result is a function of the window's content alone, emitted once."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nearfield.config import Query, checked, step_of
from nearfield.operators.outliers import detect, tally
from nearfield.operators.partition import Partitioner, route
from nearfield.streaming.adaptive import Control, detect_adaptive

OUT = "window_end long, W long, S long, R double, k int, n_outliers long, ids array<long>"
STATE = "points binary, done long"


def _distances(x: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    if kind == "jaccard":
        left, right = [set(v) for v in x], [set(v) for v in y]
        return np.array([[1 - len(a & b) / len(a | b) if a | b else 0.0 for b in right] for a in left]).reshape(len(x), len(y))
    return np.sqrt(sum((x[:, None, i] - y[None, :, i]) ** 2 for i in range(x.shape[1])))


class SlideCounts:
    """The points of the windows still open, and of each the number of neighbours by slide and radius. A point that comes is compared once with those held, in blocks of rows; a window's counts are sums over its slides."""

    def __init__(self, queries: Sequence[Query], kind: str, held: tuple | None = None):
        self.queries, self.kind = queries, kind
        self.step, self.span, self.radii = step_of(queries), max(q.W for q in queries), sorted({q.R for q in queries})
        self.base, self.ids, self.values, self.times, self.flags, self.counts = held or (0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0, len(self.radii)), np.int32))

    def state(self) -> tuple:
        return self.base, self.ids, self.values, self.times, self.flags, self.counts

    def add(self, ids: np.ndarray, values: np.ndarray, times: np.ndarray, flags: np.ndarray, block: int = 512) -> None:
        old, new = len(self.ids), len(ids)
        self.ids, self.times, self.flags = (np.concatenate(x) for x in ((self.ids, ids), (self.times, times), (self.flags, flags)))
        self.values = np.concatenate((self.values, values)) if old else values
        slides = self.times // self.step
        base, width = int(slides.min()), int(slides.max() - slides.min()) + 1
        counts = np.zeros((old + new, width, len(self.radii)), np.int32)
        shift = self.base - base  # of the columns there were, those that still matter
        take = np.arange(self.counts.shape[1])
        take = take[(take + shift >= 0) & (take + shift < width)]
        counts[:old, take + shift] = self.counts[:, take]
        self.base, self.counts = base, counts
        near_in_time = self.span // self.step
        by_slide = np.zeros((old + new, width), np.float32)
        by_slide[np.arange(old + new), slides - base] = 1
        for at in range(old, old + new, block):
            rows = slice(at, min(at + block, old + new))
            d = _distances(self.values[rows], self.values, self.kind)
            d[np.arange(d.shape[0]), np.arange(rows.start, rows.stop)] = np.inf
            d[np.abs(slides[rows, None] - slides[None, :]) >= near_in_time] = np.inf
            for i, r in enumerate(self.radii):
                near = (d <= r).astype(np.float32)
                counts[rows, :, i] = (near @ by_slide).astype(np.int32)
                counts[:old, :, i] += (near[:, :old].T @ by_slide[rows]).astype(np.int32)

    def results(self, end: int) -> list[tuple]:
        """(window_end, W, S, R, k, count, ids) of the queries due at an end, if any owner is in the window."""
        out = []
        for W in sorted({q.W for q in self.queries if end % q.S == 0}):
            inside = (self.times >= end - W) & (self.times < end)
            own = inside & (self.flags == 0)
            if own.any():
                low, high = max((end - W) // self.step - self.base, 0), end // self.step - self.base
                within = self.counts[own, low:high].sum(1)
                for q in (q for q in self.queries if q.W == W and end % q.S == 0):
                    bad = np.sort(self.ids[own][within[:, self.radii.index(q.R)] < q.k])
                    out.append((end, q.W, q.S, q.R, q.k, len(bad), bad.tolist()))
        return out

    def expire(self, done: int) -> bool:
        """Lets go what no window after done holds; returns whether anything is left."""
        keep = self.times >= done - self.span + self.step
        self.ids, self.values, self.times, self.flags, self.counts = (x[keep] for x in (self.ids, self.values, self.times, self.flags, self.counts))
        if keep.any():
            first = int((self.times // self.step).min())
            self.base, self.counts = first, self.counts[:, first - self.base :]
        return bool(keep.any())


def detect_stream(points: DataFrame, queries: Sequence[Query], partitioner: Partitioner, lateness: str, kind: str = "euclidean", per_ms: int = 1) -> DataFrame:
    """Results by partition of a stream with id, value, a, ts (ts: the event time, of the same moments as a, which counts per_ms to a millisecond). State is one window of points a partition with their counts by slide; a window is emitted when the watermark passes its end."""
    queries = checked(queries)
    radius, step = max(q.R for q in queries), step_of(queries)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = (pickle.loads(state.get[0]), state.get[1]) if state.exists else (None, None)
        own = SlideCounts(queries, kind, held)
        for b in batches:
            if len(b):
                own.add(b["id"].to_numpy(), np.array(b["value"].tolist(), float), b["a"].to_numpy(), b["flag"].to_numpy())
        if not len(own.ids):
            return
        mark = state.getCurrentWatermarkMs() * per_ms
        if done is None:
            done = int(own.times.min()) // step * step
        out = []
        while done + step <= mark:
            done += step
            out += own.results(done)
        if own.expire(done):
            state.update((pickle.dumps(own.state()), done))
            # a partition without new points is called when the watermark passes the next end
            state.setTimeoutTimestamp(max(-(-(done + step) // per_ms), state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["window_end", "W", "S", "R", "k", "n_outliers", "ids"])

    routed = route(points.withWatermark("ts", lateness), partitioner, radius)
    return routed.groupBy("part").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _progress(spark: SparkSession, path: str) -> dict[str, int | None]:
    """The last window that was answered and the latest time seen, as the last batch left them."""
    try:
        row = spark.read.schema("number long, done long, seen long").parquet(path).agg(F.max("done").alias("done"), F.max("seen").alias("seen")).first()
    except AnalysisException:  # the first start
        return {"done": None, "seen": None}
    return {"done": row["done"], "seen": row["seen"]}


def replay(spark: SparkSession, stream: DataFrame, queries: Sequence[Query], sink: Callable[[DataFrame, int], None], checkpoint: str, late: int = 0, kind: str = "euclidean", dims: int | None = None, control: Control | None = None, costs: Callable[[list[str], int], None] | None = None, last: bool = True, counts: bool = False) -> None:
    """Runs a stream of points to its end by micro-batches: points are appended to a store in slides; each window whose end the data has passed by the lateness is detected from the store, by the same plan as in batch, and handed to the sink once, with a number. How far it has come is written beside the points after each batch, so a restart goes on from there; a batch that is run again writes its points and its answers over the old ones. control: detect by partitions, and let the costs move their thresholds; the sink's number is then the end of a stretch of windows, and costs gets its cost lines. counts: the sink gets the number of outliers of each window, zeros included, instead of the outliers."""
    queries = checked(queries, "single" if control else None)
    step, span = step_of(queries), max(q.W for q in queries)
    store = f"{checkpoint}/points"
    progress = _progress(spark, f"{checkpoint}/progress")

    def batch(df: DataFrame, number: int) -> None:
        # few files a slide; a hot slide is split
        df.withColumn("slide", F.floor(F.col("a") / step)).hint("rebalance", "slide").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("slide").parquet(f"{store}/batch={number}")
        bounds = df.agg(F.min("a").alias("low"), F.max("a").alias("high")).first()
        if bounds["low"] is None:
            return
        progress["seen"] = max(progress["seen"] if progress["seen"] is not None else bounds["high"], bounds["high"])
        if progress["done"] is None:
            progress["done"] = bounds["low"] // step * step
        flush((progress["seen"] - late) // step * step, number)
        spark.createDataFrame([(number, progress["done"], progress["seen"])], "number long, done long, seen long").coalesce(1).write.mode("append").parquet(f"{checkpoint}/progress")

    def flush(ready: int, number: int) -> None:
        low = progress["done"]
        if low is None or ready <= low:
            return
        points = spark.read.schema("id long, value array<double>, a long, slide long, batch long").parquet(store).where((F.col("slide") >= (low + step - span) // step) & (F.col("slide") < ready // step)).select("id", "value", "a")

        def put(found: DataFrame, held: DataFrame, low: int, high: int, number: int) -> None:
            rows = tally(found, held, queries) if counts else found
            sink(rows.where((F.col("window_end") > low) & (F.col("window_end") <= high)), number)

        if control is not None:
            began = {"at": low}

            def stretch(found: DataFrame, held: DataFrame, to: int) -> None:
                put(found, held, began["at"], to, to)
                began["at"] = to

            detect_adaptive(points, queries[0], control, low, ready, stretch, kind, dims, costs)
        else:
            put(detect(points, queries, kind, dims), points, low, ready, number)
        progress["done"] = ready

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    if last and progress["seen"] is not None:  # the windows still open end with the stream
        flush((progress["seen"] // step + span // step) * step, -1)
