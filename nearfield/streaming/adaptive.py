"""Detection by partitions whose thresholds move: what is measured of each window decides how later points are routed.

The control loop stands on the driver. Windows are answered in stretches no longer than the buffer, as a decision made at
a window takes effect a buffer later at the soonest: within a stretch the routing is known beforehand. The router holds
the trees and their version; each stretch's plan carries the trees of the moment, so no worker keeps a routing of its own.
Costs go out as lines and come back as lines, of which only those newer than all before count, so that a stretch that is
run again decides nothing twice. The answer never depends on the routing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame, functions as F

from nearfield.config import Query
from nearfield.operators.partition import partitioned_outliers, route, route_transition
from nearfield.operators.reports import partition_cost
from nearfield.operators.windows import assign_windows
from nearfield.plans.adapt import AdaptiveRouter
from nearfield.sources.points import feedback

#: Costs of a partition: the points it owns, the milliseconds spent on it, the product of both.
OWNERS, TIME, PRODUCT = 1, 2, 3


@dataclass
class Metrics:
    """Counters and gauges of a job."""

    slides: int = 0
    owners: int = 0
    replicas: int = 0
    total_ms: float = 0.0
    adaptations: int = 0

    @property
    def average_ms(self) -> float:
        """Time for a slide."""
        return self.total_ms / self.slides if self.slides else 0.0

    def add(self, slides: Iterable, ms: float) -> None:
        """slides: rows with owners and replicas, one for each window."""
        for row in slides:
            self.slides, self.owners, self.replicas = self.slides + 1, self.owners + row["owners"], self.replicas + row["replicas"]
        self.total_ms += ms

    def line(self) -> str:
        return f"metrics slides={self.slides}i,owners={self.owners}i,replicas={self.replicas}i,total_ms={self.total_ms:.0f},average_ms={self.average_ms:.1f},adaptations={self.adaptations}i"


@dataclass
class Control:
    """The loop's state: the router, how far costs have been heeded, what was decided and measured."""

    router: AdaptiveRouter
    cost_kind: int = OWNERS
    heeded: int = -(1 << 62)
    decisions: list[tuple[int, list[int], list[int]]] = field(default_factory=list)
    metrics: Metrics = field(default_factory=Metrics)

    def routed(self, points: DataFrame) -> DataFrame:
        """By the tree in force; while one gives way to another, by both."""
        r = self.router
        if r.pending is None:
            return route(points, r.tree, r.radius)
        return route_transition(points, r.tree, r.pending, r.radius, r.buffer_at, r.stable_at)

    def heed(self, lines: Iterable[str]) -> list[str]:
        """Takes cost lines; what is decided is kept. Returns the lines that were new."""
        fresh, self.heeded = feedback(sorted(lines, key=lambda x: int(x.split(";", 1)[0])), self.heeded)
        for line in fresh:
            end, *rest = line.split(";")
            costs = {int(p): float(c) for p, c in zip(rest[::2], rest[1::2], strict=True)}
            if self.cost_kind != OWNERS:
                costs = self._timed(costs)
            made = self.router.observe(int(end), costs)
            if made:
                self.decisions.append(made)
        self.metrics.adaptations = self.router.adaptations
        return fresh

    def _timed(self, owners: dict[int, float]) -> dict[int, float]:
        """Milliseconds of a window by partition, or their product with the owners. Partitions share tasks, so the measured time for a slide is shared out by the pairs that each compares, the square of what it holds."""
        pairs = sum(c * c for c in owners.values()) or 1.0
        ms = {p: self.metrics.average_ms * c * c / pairs for p, c in owners.items()}
        return ms if self.cost_kind == TIME else {p: ms[p] * c for p, c in owners.items()}


def detect_adaptive(points: DataFrame, q: Query, control: Control, low: int, ready: int, sink: Callable[[DataFrame, DataFrame, int], None], kind: str = "euclidean", dims: int | None = None, costs: Callable[[list[str], int], None] | None = None) -> None:
    """The windows with low < end <= ready. sink gets each stretch's outliers (window_end, W, S, R, k, id), the points they were found among and the end of the stretch; costs gets its cost lines."""
    stretch, at = max(control.router.buffer_period * q.W // q.S, 1) * q.S, low
    while at < ready:
        to = min(ready, at + stretch)
        held = points.where((F.col("a") >= at + q.S - q.W) & (F.col("a") < to))
        routed, due = control.routed(held), F.col("window_end").between(at + q.S, to)
        began = time.monotonic()
        found = partitioned_outliers(routed, q.W, q.S, q.R, q.k, kind, dims).where(due)
        sink(found.selectExpr("window_end", f"{q.W}L as W", f"{q.S}L as S", f"cast({q.R} as double) as R", f"{q.k} as k", "id"), held, to)
        ms = (time.monotonic() - began) * 1000
        members = assign_windows(routed, q.W, q.S).where(due)
        # a row for each partition and window of the stretch, on the driver
        rows = sorted(partition_cost(members, q.S).collect(), key=lambda r: (r["window_end"], r["part"]))
        by_end = {end: list(own) for end, own in groupby(rows, key=lambda r: r["window_end"])}
        control.metrics.add([{"owners": sum(r["owners"] for r in own), "replicas": sum(r["replicas"] for r in own)} for own in by_end.values()], ms)
        lines = [";".join([str(end), *(f"{r['part']};{r['cost']}" for r in own)]) for end, own in by_end.items()]
        if costs is not None:
            costs(lines, to)
        control.heed(lines)
        at = to
