"""Parameters of a job: queries, partitioning, adaptation; checked in every space."""

from __future__ import annotations

import argparse
import itertools
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from nearfield.functions.distance import gcd_of

SPACES = {"single": ("advanced", "cod", "slicing", "pmcod", "pmcod_net"), "rk": ("amcod_rk", "sop_rk", "psod_rk", "pmcsky_rk"), "rkws": ("sop_rkws", "psod_rkws", "pmcsky_rkws")}
ALGORITHMS = {name: space for space, names in SPACES.items() for name in names}


@dataclass(frozen=True, order=True)
class Query:
    """Report points with fewer than k neighbours within R, in windows of W every S."""

    W: int
    S: int
    R: float
    k: int


def query_product(W: Sequence[int], S: Sequence[int], R: Sequence[float], k: Sequence[int]) -> list[Query]:
    """All combinations."""
    return [Query(*q) for q in itertools.product(W, S, R, k)]


def checked(queries: Sequence[Query], space: str | None = None) -> list[Query]:
    """The queries without repetition, or ValueError."""
    out = sorted(set(queries))
    if not out:
        raise ValueError("no query")
    if any(q.W <= 0 or q.S <= 0 or q.k < 1 or q.R < 0 for q in out):
        raise ValueError("W and S must be positive, k at least 1, R not negative")
    if max(q.S for q in out) > min(q.W for q in out):
        raise ValueError("every slide must fit into every window")
    if any(q.W % q.S for q in out) or any(w % s for w in {q.W for q in out} for s in {q.S for q in out}):
        raise ValueError("every window must be a multiple of every slide")
    if space == "single" and len(out) > 1:
        raise ValueError("the single space takes one query")
    if space == "rk" and len({(q.W, q.S) for q in out}) > 1:
        raise ValueError("the rk space takes one window and one slide")
    return out


def step_of(queries: Sequence[Query]) -> int:
    """The slide all queries share."""
    return gcd_of([q.S for q in queries])


@dataclass(frozen=True)
class JobConfig:
    algorithm: str
    W: tuple[int, ...]
    S: tuple[int, ...]
    k: tuple[int, ...]
    R: tuple[float, ...]
    policy: str = "static"
    partitioning: str = "grid"
    partitions: tuple[int, ...] = (4,)
    sample_size: int = 10_000
    distance: str = "euclidean"
    adapt_range: float = 1.0
    adapt_queue: int = 5
    adapt_over: float = 130.0
    adapt_under: float = 30.0
    adapt_cost: int = 1
    buffer_period: int = 1
    dataset: str = ""
    source: str = "file"
    servers: str = ""
    topic: str = "points"
    debug: bool = False
    queries: tuple[Query, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}")
        if self.policy not in ("static", "naive", "advanced") or self.partitioning not in ("grid", "tree"):
            raise ValueError("policy is static, naive or advanced; partitioning is grid or tree")
        if self.policy != "static" and (self.partitioning != "tree" or ALGORITHMS[self.algorithm] != "single"):
            raise ValueError("only a tree can adapt, and for one query")
        if self.source not in ("file", "stream", "json", "queue") or (self.source == "queue" and not self.servers):
            raise ValueError("source is file, stream, json or queue; a queue needs servers")
        if min(self.sample_size, self.adapt_queue, self.buffer_period, *self.partitions) < 1 or self.adapt_cost not in (1, 2, 3):
            raise ValueError("sizes are at least 1, adapt_cost is 1, 2 or 3")
        object.__setattr__(self, "queries", tuple(checked(query_product(self.W, self.S, self.R, self.k), ALGORITHMS[self.algorithm])))


def _list(kind):
    return lambda text: tuple(kind(x) for x in text.split(";") if x)


def parse_args(args: Sequence[str]) -> JobConfig:
    """Command-line parameters; lists are separated by semicolons."""
    p = argparse.ArgumentParser(prog="nearfield")
    p.add_argument("--algorithm", required=True)
    for name, kind in (("W", int), ("S", int), ("k", int), ("R", float)):
        p.add_argument(f"--{name}", type=_list(kind), required=True)
    p.add_argument("--partitions", type=_list(int), default=(4,))
    for name, kind, default in (("policy", str, "static"), ("partitioning", str, "grid"), ("sample_size", int, 10_000), ("distance", str, "euclidean"), ("adapt_range", float, 1.0), ("adapt_queue", int, 5), ("adapt_over", float, 130.0), ("adapt_under", float, 30.0), ("adapt_cost", int, 1), ("buffer_period", int, 1), ("dataset", str, ""), ("source", str, "file"), ("servers", str, ""), ("topic", str, "points")):
        p.add_argument(f"--{name}", type=kind, default=default)
    p.add_argument("--debug", action="store_true")
    return JobConfig(**vars(p.parse_args(args)))


def required_env(key: str) -> str:
    """An environment variable that must be there."""
    if key not in os.environ:
        raise KeyError(f"environment variable {key} is not set")
    return os.environ[key]
