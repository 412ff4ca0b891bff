"""Adaptation: policies on the history of costs, the clock of phases, the loop that moves a tree's thresholds."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from nearfield.operators.partition import Tree

SIMILARITY = 5.0


def complete(costs: DataFrame, partitions: list[int]) -> DataFrame:
    """part, window_end, cost with every partition in every window; missing ones cost nothing."""
    spark = costs.sparkSession
    every = spark.createDataFrame([(p,) for p in partitions], "part int")
    ends = costs.select("window_end").distinct()
    grid = ends.withColumn("part", F.explode(F.array(*(F.lit(p) for p in partitions)))) if partitions else ends.join(every)
    return grid.join(costs, ["part", "window_end"], "left").select("part", "window_end", F.coalesce("cost", F.lit(0)).alias("cost"))


def policy_naive(costs: DataFrame, upper: float = 130.0) -> DataFrame:
    """window_end, over: the costliest partition (the smallest number of equal ones) of each window, if it costs upper per cent of the mean."""
    by = costs.groupBy("window_end").agg(F.min(F.struct((-F.col("cost")).alias("minus"), "part")).alias("top"), F.avg("cost").alias("mean"))
    return by.where((-F.col("top.minus")) * 100 / F.col("mean") >= upper).select("window_end", F.col("top.part").alias("over"))


def policy_advanced(costs: DataFrame, upper: float = 130.0, lower: float = 30.0, similarity: float = SIMILARITY, queue: int = 5) -> DataFrame:
    """window_end, part, load ('over' or 'under'): partitions beyond a bound whose last queue costs are all within similarity points of the present one, in per cent of the present mean."""
    mean = costs.groupBy("window_end").agg(F.avg("cost").alias("mean"))
    by = Window.partitionBy("part").orderBy("window_end").rowsBetween(-(queue - 1), 0)
    past = costs.withColumn("past", F.collect_list("cost").over(by)).join(mean, "window_end").where("mean > 0")
    share = F.col("cost") * 100 / F.col("mean")
    steady = (F.size("past") == queue) & F.forall("past", lambda c: F.abs(c * 100 / F.col("mean") - share) <= similarity)
    load = F.when(share >= upper, "over").when(share < lower, "under")
    return past.where(steady).select("window_end", "part", load.alias("load")).where("load is not null")


@dataclass
class AdaptiveRouter:
    """The control loop, on the driver: it holds a queue of costs for each partition, no rows. A decision takes effect after a buffer; then two routings overlap for a window; no new one is made meanwhile. version: how many trees have come into force. A static policy observes and never decides; it takes any partitioner."""

    tree: Tree
    window: int
    radius: float
    policy: str = "naive"
    adapt_range: float = 1.0
    queue: int = 5
    over: float = 130.0
    under: float = 30.0
    buffer_period: int = 1
    history: dict[int, deque] = field(default_factory=dict)
    pending: Tree | None = None
    buffer_at: int = 0
    stable_at: int = 0
    adaptations: int = 0
    version: int = 0

    def decide(self) -> tuple[list[int], list[int]]:
        """Overloaded and underloaded partitions now."""
        if self.policy == "static":
            return [], []
        last = {p: h[-1] for p, h in self.history.items()}
        mean = sum(last.values()) / len(last) if last else 0
        if not mean:
            return [], []
        if self.policy == "naive":
            top = min(last, key=lambda p: (-last[p], p))
            return ([top], []) if last[top] * 100 / mean >= self.over else ([], [])
        steady = {p for p, h in self.history.items() if len(h) == self.queue and all(abs(c - last[p]) * 100 / mean <= SIMILARITY for c in h)}
        return sorted(p for p in steady if last[p] * 100 / mean >= self.over), sorted(p for p in steady if last[p] * 100 / mean < self.under)

    def observe(self, window_end: int, costs: dict[int, float]) -> tuple[int, list[int], list[int]] | None:
        """Takes a window's costs; returns a decision (effective at, over, under) if one is made."""
        for p in self.tree.partitions():
            self.history.setdefault(p, deque(maxlen=self.queue)).append(costs.get(p, 0.0))
        if self.pending is not None:
            if window_end >= self.stable_at:
                self.tree, self.pending, self.version = self.pending, None, self.version + 1
                self.history.clear()
            return None
        over, under = self.decide()
        if not over and not under:
            return None
        moved = self.tree.adapt(over, under, self.adapt_range * self.radius, self.radius)
        if moved == self.tree:
            return None
        self.pending, self.adaptations = moved, self.adaptations + 1
        self.buffer_at = window_end + self.buffer_period * self.window
        self.stable_at = self.buffer_at + self.window
        return self.buffer_at, over, under
