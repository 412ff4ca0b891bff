"""Command line: a detection job over $JOB_INPUT/<dataset>, or `generate KIND N PATH`, or `generate-stream KIND SERVERS TOPIC FOLDER`.

    python -m nearfield --algorithm pmcod --W 10000 --S 500 --k 50 --R 0.45 --dataset STK

`--source file` reads input.txt once; `stream` takes input.txt and files beside it that come later as a stream, `json` does so with
files of JSON lines, and `queue` reads a message queue. A policy other than static makes a stream of a file too: the
tree's thresholds move with the costs of the partitions. Counts go to $JOB_OUTPUT/<dataset>, zeros included; a run that
is repeated writes over them. Adaptive jobs also write costs, the newest costs, adaptations and metrics beside them.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from nearfield.config import ALGORITHMS, JobConfig, parse_args, required_env
from nearfield.operators import partition
from nearfield.operators.outliers import tally
from nearfield.operators.reports import adaptation_lines, count_lines, latest, parse_cost_lines, to_queue
from nearfield.plans.adapt import AdaptiveRouter
from nearfield.plans.strategies import detect_with
from nearfield.sources import points as src
from nearfield.streaming.adaptive import Control
from nearfield.streaming.detect import replay

DECISION = "effective_at long, over array<int>, under array<int>"


def tree_of(job: JobConfig, sample: DataFrame) -> partition.Tree:
    """From the head of the points, sample_size rows."""
    return partition.Tree.build([r["value"] for r in src.sample_head(sample, job.sample_size).collect()], job.partitions[0], job.R[0], job.distance)


def answer(job: JobConfig, points: DataFrame, dims: int) -> DataFrame:
    """The outliers of a job. A single query with more than one partition is answered by partitions; the others share one histogram."""
    space_dims = dims if job.distance == "euclidean" else None
    parts = job.partitions[0] if job.partitioning == "tree" else max(job.partitions)
    if ALGORITHMS[job.algorithm] != "single" or parts <= 1:
        return detect_with(job.algorithm, points, job.queries, job.distance, space_dims)
    (q,) = job.queries
    own = tree_of(job, points) if job.partitioning == "tree" else partition.Grid.build(src.sample_head(points, job.sample_size), (list(job.partitions) * dims)[:dims])
    found = partition.partitioned_outliers(partition.route(points, own, q.R), q.W, q.S, q.R, q.k, job.distance, space_dims)
    return found.selectExpr("window_end", f"{q.W}L as W", f"{q.S}L as S", f"cast({q.R} as double) as R", f"{q.k} as k", "id")


def _put(lines: DataFrame, path: str, debug: bool) -> None:
    """To a folder, over what a run before has left there; or, for debugging, to the console."""
    if debug:
        for row in lines.toLocalIterator():
            print(row["line"])
    else:
        lines.write.mode("overwrite").text(path)


def run_batch(spark: SparkSession, job: JobConfig, folder: str, out: str) -> None:
    points = src.read_text_points(spark, f"{folder}/input.txt")
    head = points.first()
    found = answer(job, points, len(head["value"])) if head else None
    counts = tally(found, points, job.queries) if head else spark.createDataFrame([], "window_end long, W long, S long, R double, k int, n_outliers long")
    _put(count_lines(counts), out, job.debug)


def run_stream(spark: SparkSession, job: JobConfig, folder: str, out: str) -> Control | None:
    """The job as a stream, to its present end; what it keeps to go on from there stands in <out>-state."""
    if job.source == "queue":
        stream, head = src.stream_kafka_points(spark, job.servers, job.topic), src.parse_text(spark.read.text(f"{folder}/sample.txt"))
    elif job.source == "json":
        stream, head = src.stream_json_points(spark, folder), src.parse_json(spark.read.text(folder))
    else:
        stream, head = src.stream_text_points(spark, folder), src.read_text_points(spark, folder)
    first = head.first()
    dims = len(first["value"]) if first and job.distance == "euclidean" else None
    control = None
    if job.policy != "static":
        (q,) = job.queries
        router = AdaptiveRouter(tree_of(job, head), q.W, q.R, job.policy, job.adapt_range, job.adapt_queue, job.adapt_over, job.adapt_under, job.buffer_period)
        control = Control(router, job.adapt_cost)

    def costs(lines: list[str], number: int) -> None:
        rows = spark.createDataFrame([(x,) for x in lines], "line string")
        _put(rows, f"{out}-costs/stretch={number}", job.debug)
        if not job.debug:
            latest(parse_cost_lines(rows)).write.mode("overwrite").parquet(f"{out}-latest")

    replay(spark, stream, job.queries, lambda df, n: _put(count_lines(df), f"{out}/batch={n}", job.debug), f"{out}-state", kind=job.distance, dims=dims, control=control, costs=costs if control else None, counts=True)
    if control:
        _put(adaptation_lines(spark.createDataFrame(control.decisions, DECISION)), f"{out}-adaptations", job.debug)
        _put(spark.createDataFrame([(control.metrics.line(),)], "line string"), f"{out}-metrics", job.debug)
    return control


def main(args: Sequence[str]) -> None:
    spark = SparkSession.builder.appName("nearfield").getOrCreate()
    if args[:1] == ["generate"]:
        kind, n, path = args[1], int(args[2]), args[3]
        src.to_json(src.generated(spark, kind, n)).write.text(path)
        return
    if args[:1] == ["generate-stream"]:
        kind, servers, topic, folder = args[1:5]
        to_queue(src.to_json(src.stream_generated(spark, kind)), servers, topic, folder).awaitTermination()
        return
    job = parse_args(args)
    folder, out = f"{required_env('JOB_INPUT')}/{job.dataset}", f"{required_env('JOB_OUTPUT')}/{job.dataset}"
    if job.source == "file" and job.policy == "static":
        run_batch(spark, job, folder, out)
    else:
        run_stream(spark, job, folder, out)


if __name__ == "__main__":
    main(sys.argv[1:])
