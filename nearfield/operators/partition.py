"""Space partitioning with replicas: every point has one owner and a copy wherever a neighbour of its may be owned."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from nearfield.config import Query
from nearfield.functions.distance import distance
from nearfield.operators.outliers import doubtful, neighbor_histogram, prunable, window_counts
from nearfield.operators.ranks import at_rank
from nearfield.operators.windows import reportable


class Partitioner(Protocol):
    """What the routing needs."""

    def route(self, radius: float) -> Column: ...

    def partitions(self) -> list[int]: ...


# --- grid ------------------------------------------------------------------------------------------------------------


def grid_cuts(sample: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """dim, place, cut: of each dimension, the elements at y * (n div cuts) of its sorted sample, for 0 < y < cuts."""
    n = sample.count()
    out = None
    for dim, parts in enumerate(cuts):
        values = sample.select(F.col("value")[dim].alias("cut"))
        for y in range(1, parts):
            row = at_rank(values, "cut", y * (n // parts)).select(F.lit(dim).alias("dim"), F.lit(y).alias("place"), "cut")
            out = row if out is None else out.unionByName(row)
    return out if out is not None else sample.sparkSession.createDataFrame([], "dim int, place int, cut double")


@dataclass(frozen=True)
class Grid:
    """Cut points of each dimension, in order; a dimension with none is not cut."""

    cuts: tuple[tuple[float, ...], ...]

    @classmethod
    def build(cls, sample: DataFrame, cuts: Sequence[int]) -> Grid:
        rows = grid_cuts(sample, cuts).collect()  # the number of cuts the caller has asked for
        return cls(tuple(tuple(sorted(r["cut"] for r in rows if r["dim"] == d)) for d in range(len(cuts))))

    def _cell(self, x: Column, dim: int) -> Column:
        """The number of cuts below x: a point on a cut belongs to the lower cell."""
        return sum((F.when(x > c, 1).otherwise(0) for c in self.cuts[dim]), F.lit(0))

    def route(self, radius: float) -> Column:
        """array<struct<part,flag>>: the owner and all cells that the ball's box touches. Cells are numbered in mixed radix."""
        value = F.col("value")
        owner, parts = F.lit(0), F.array(F.lit(0))
        for d, cuts in enumerate(self.cuts):
            base = len(cuts) + 1
            owner = owner * base + self._cell(value[d], d)
            # the low end counts a cut that it stands on, as a neighbour may stand there too
            low, high = self._cell(value[d] - radius * (1 + 1e-9) - 1e-12, d), self._cell(value[d] + radius * (1 + 1e-9) + 1e-12, d)
            parts = F.flatten(F.transform(F.sequence(low, high), _add(parts, base)))
        return F.transform(parts, lambda p: F.struct(p.alias("part"), F.when(p == owner, 0).otherwise(1).alias("flag")))

    def partitions(self) -> list[int]:
        return list(range(int(np.prod([len(c) + 1 for c in self.cuts]))))

    def adapt(self, *_: object) -> Grid:
        raise NotImplementedError("a grid does not adapt")


def _add(parts: Column, base: int) -> Callable[[Column], Column]:
    return lambda c: F.transform(parts, lambda p: p * base + c)


# --- vantage-point tree ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    threshold: float
    point: tuple[float, ...]


def vector_distance(x: Sequence[float], y: Sequence[float], kind: str) -> float:
    if kind == "jaccard":
        a, b = set(x), set(y)
        return 1 - len(a & b) / len(a | b) if a | b else 0.0
    n = min(len(x), len(y))
    return float(np.sqrt(sum((p - q) ** 2 for p, q in zip(x[:n], y[:n], strict=True))))


@dataclass(frozen=True)
class Tree:
    """Nodes by (height, number from 1); node n's children are 2n-1, the closer, and 2n. The children of the last height are the partitions."""

    nodes: dict[tuple[int, int], Node]
    height: int
    kind: str = "euclidean"

    @classmethod
    def build(cls, sample: Sequence[Sequence[float]], height: int, radius: float, kind: str = "euclidean", seed: int = 1) -> Tree:
        """On the driver, of a bounded sample. The threshold is the median distance, no less than the radius."""
        g = np.random.default_rng(seed)
        nodes: dict[tuple[int, int], Node] = {}
        groups = {1: [tuple(map(float, p)) for p in sample]}
        for h in range(height):
            below = {}
            for number, points in groups.items():
                if len(points) < 2:
                    raise ValueError("the sample is too small for this height")
                vantage = points[int(g.integers(len(points)))]
                d = np.array([vector_distance(p, vantage, kind) for p in points])
                median = float(np.partition(d, len(d) // 2)[len(d) // 2])
                nodes[h, number] = Node(max(median, radius), vantage)
                below[2 * number - 1] = [p for p, x in zip(points, d, strict=True) if x <= median] or points
                below[2 * number] = [p for p, x in zip(points, d, strict=True) if x > median] or points
            groups = below
        return cls(nodes, height, kind)

    def partitions(self) -> list[int]:
        return list(range(1, 2**self.height + 1))

    def route(self, radius: float) -> Column:
        """array<struct<part,flag>>. A copy goes wherever the ball may reach; the owner's path is one of those."""
        value = F.col("value")

        def below(h: int, number: int, owned: Column | None) -> Column:
            """Partitions under a node; owned: whether the owner's path has come here."""
            if h == self.height:
                return F.array(F.struct(F.lit(number).alias("part"), F.when(owned, 0).otherwise(1).alias("flag")))
            node = self.nodes[h, number]
            d = distance(value, F.array(*(F.lit(x) for x in node.point)), self.kind, len(node.point) if self.kind == "euclidean" else None)
            reach = radius * (1 + 1e-9) + 1e-12
            none = F.array().cast("array<struct<part:int,flag:int>>")
            closer = F.when(d <= node.threshold + reach, below(h + 1, 2 * number - 1, owned & (d <= node.threshold))).otherwise(none)
            farther = F.when(d > node.threshold - reach, below(h + 1, 2 * number, owned & (d > node.threshold))).otherwise(none)
            return F.concat(closer, farther)

        return below(0, 1, F.lit(True))

    def adapt(self, over: Sequence[int], under: Sequence[int], step: float, floor: float) -> Tree:
        """Moves thresholds: an overloaded child's region shrinks by a step, an underloaded one's grows; if both children of a node are so, its closer one is changed and the node itself counts for its parent. No threshold falls to the floor."""
        nodes = dict(self.nodes)
        loads = {p: 1 for p in over} | {p: -1 for p in under if p not in set(over)}
        for h in range(self.height - 1, -1, -1):
            above: dict[int, int] = {}
            for number in sorted({(p + 1) // 2 for p in loads}):
                closer, farther = loads.get(2 * number - 1, 0), loads.get(2 * number, 0)
                node = nodes[h, number]
                if closer and closer == farther:
                    if h == 0:
                        continue
                    move, above[number] = -closer, closer
                elif closer and farther:
                    move = -closer  # one gives to the other; a single step serves both
                else:
                    move = farther - closer
                changed = node.threshold + move * step
                if changed > floor:
                    nodes[h, number] = replace(node, threshold=changed)
            loads = above
        return replace(self, nodes=nodes)


# --- routing -----------------------------------------------------------------------------------------------------------


def route(points: DataFrame, partitioner: Partitioner, radius: float) -> DataFrame:
    """points with part and flag: 0 in the owner's row, 1 in those of replicas."""
    return points.withColumn("r", F.explode(partitioner.route(radius))).select(*points.columns, "r.part", "r.flag")


def route_transition(points: DataFrame, old: Partitioner, new: Partitioner, radius: float, start: int, end: int) -> DataFrame:
    """points with part, flag and countdown, while one routing gives way to the other. Before start the old one routes, from end on the new; between them both do: the new owner takes over in windows past end, until then the old one reports."""
    a = F.col("a")
    early = route(points.where(a < start), old, radius).withColumn("countdown", F.lit(-1).cast("long"))
    late = route(points.where(a >= end), new, radius).withColumn("countdown", F.lit(-1).cast("long"))
    # a generator of one row: either routing is computed once, however often it is read
    mid = points.where((a >= start) & (a < end)).withColumn("b", F.explode(F.array(F.struct(old.route(radius).alias("o"), new.route(radius).alias("n")))))
    parts = lambda r: F.transform(r, lambda s: s["part"])
    owner = lambda r: F.element_at(F.filter(r, lambda s: s["flag"] == 0), 1)["part"]
    both = mid.select(*points.columns, owner(F.col("b.o")).alias("was"), owner(F.col("b.n")).alias("will"), F.explode(F.array_union(parts(F.col("b.o")), parts(F.col("b.n")))).alias("part"))
    was, will, part = F.col("was"), F.col("will"), F.col("part")
    flag = F.when(part == will, 0).otherwise(1)
    countdown = F.when(was == will, F.lit(-1)).when((part == will) | (part == was), F.lit(end)).otherwise(F.lit(-1)).cast("long")
    moved = both.select(*points.columns, part.alias("part"), flag.alias("flag"), countdown.alias("countdown"))
    return early.unionByName(moved).unionByName(late)


def partitioned_outliers(routed: DataFrame, W: int, S: int, R: float, k: int, kind: str = "euclidean", dims: int | None = None) -> DataFrame:
    """window_end, id of the outliers, each found within its owner's partition alone. routed: id, value, a, part, flag[, countdown]."""
    countdown = F.col("countdown") if "countdown" in routed.columns else F.lit(-1).cast("long")
    copies = routed.withColumn("countdown", countdown)
    # a copy that only ever serves as a neighbour needs no counts
    left = copies.where((F.col("flag") == 0) | (F.col("countdown") >= 0))
    query = [Query(W, S, R, k)]
    if prunable(query, kind, dims):
        left = doubtful(copies, query, dims, True, ["part"], left)
    counts = window_counts(left, neighbor_histogram(copies, query, kind, dims, left, ["part"]), query, ["part"]).where(F.col("n0") < k)
    if "countdown" not in routed.columns:  # the owners alone were counted, and they report
        return counts.select("window_end", "id")
    told = left.select("id", "part", "flag", "countdown")
    return counts.join(told, ["id", "part"]).where(reportable(F.col("flag"), F.col("countdown"), F.col("window_end"))).select("window_end", "id")
