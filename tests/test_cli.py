"""The command line and a restarted stream."""

import pytest

from nearfield.__main__ import main
from nearfield.config import Query
from nearfield.operators.outliers import detect, report
from nearfield.sources.points import POINT
from nearfield.streaming.detect import replay


@pytest.mark.parametrize("more", [["--partitions", "3"], ["--partitioning", "tree", "--partitions", "2"], ["--partitions", "1"]])
def test_job(spark, tmp_path, monkeypatch, more):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "input.txt").write_text("\n".join(f"{i}&{(i * 7 % 10) / 2}" for i in range(40)))
    monkeypatch.setenv("JOB_INPUT", str(tmp_path))
    monkeypatch.setenv("JOB_OUTPUT", str(tmp_path / "out"))
    main(["--algorithm", "pmcod", "--W", "20", "--S", "10", "--k", "2", "--R", "0.3", "--dataset", "d", *more])
    points = spark.createDataFrame([(i, [(i * 7 % 10) / 2], i) for i in range(40)], POINT)
    want = detect(points, [Query(20, 10, 0.3, 2)], dims=1).groupBy("window_end").count().collect()
    got = [r["value"].split(";") for r in spark.read.text(str(tmp_path / "out" / "d")).collect()]
    assert sorted((int(x[0]), int(x[-1])) for x in got) == sorted((r["window_end"], r["count"]) for r in want)


def test_generate(spark, tmp_path):
    main(["generate", "tao", "25", str(tmp_path / "g")])
    assert spark.read.json(str(tmp_path / "g")).count() == 25


def test_a_restart_goes_on(spark, tmp_path):
    q, seen = Query(20, 5, 0.4, 2), []
    points = spark.createDataFrame([(i, [float(i % 5) / 2], i) for i in range(80)], POINT)
    sink = lambda df, n: seen.extend((r["window_end"], r["id"]) for r in df.collect())
    for half in (points.where("id < 40"), points.where("id >= 40")):
        half.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(POINT).parquet(str(tmp_path / "in"))
        replay(spark, stream, [q], sink, str(tmp_path / "cp"), dims=1, last=half.first()["id"] >= 40)
    assert len(seen) == len(set(seen))
    assert set(seen) == {(r["window_end"], r["id"]) for r in detect(points, [q], dims=1).collect()}


def lines_of(spark, path):
    return sorted(r["value"] for r in spark.read.option("recursiveFileLookup", True).text(str(path)).collect())


def drifting(n):
    """Points that move from one side to the other: the tree's costs turn over."""
    return [(i, [(i * 7 % 10) / 2 + (9.0 if i > n // 2 else 0.0)], i) for i in range(n)]


@pytest.mark.parametrize(("runs", "more"), [(2, ["--policy", "naive", "--adapt_over", "101", "--buffer_period", "2"]), (1, ["--policy", "advanced", "--adapt_over", "101", "--adapt_under", "99", "--adapt_queue", "2", "--adapt_cost", "3", "--buffer_period", "2"]), (1, [])])
def test_stream_job(spark, tmp_path, monkeypatch, runs, more):
    """Counts with zeros of every window, whatever the policy; a run that is repeated writes the same over them."""
    (tmp_path / "d").mkdir()
    rows = drifting(80)
    (tmp_path / "d" / "input.txt").write_text("\n".join(f"{i}&{v[0]}" for i, v, _ in rows))
    monkeypatch.setenv("JOB_INPUT", str(tmp_path))
    args = ["--algorithm", "pmcod", "--W", "20", "--S", "10", "--k", "2", "--R", "0.3", "--dataset", "d", "--partitioning", "tree", "--partitions", "2", "--source", "stream", *more]
    want = sorted(f"{r['window_end']};20;10;0.3;2;{r['n_outliers']}" for r in report(spark.createDataFrame(rows, POINT), [Query(20, 10, 0.3, 2)], dims=1).collect())
    decided = []
    for run in ("one", "two")[:runs]:
        monkeypatch.setenv("JOB_OUTPUT", str(tmp_path / run))
        main(args)
        assert lines_of(spark, tmp_path / run / "d") == want
        if more:
            decided.append(lines_of(spark, tmp_path / run / "d-adaptations"))
    if more:
        assert all(x == decided[0] for x in decided)
        assert len(lines_of(spark, tmp_path / "one" / "d-costs")) == len(want)
        assert spark.read.parquet(str(tmp_path / "one" / "d-latest")).count() > 0
        (metrics,) = lines_of(spark, tmp_path / "one" / "d-metrics")
        assert f"slides={len(want)}i,owners=80i" in metrics
    if "naive" in more:
        assert lines_of(spark, tmp_path / "one" / "d-adaptations")


def test_batch_job_writes_zeros_and_over(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "input.txt").write_text("\n".join(f"{i}&1.0" for i in range(40)))
    monkeypatch.setenv("JOB_INPUT", str(tmp_path))
    monkeypatch.setenv("JOB_OUTPUT", str(tmp_path / "out"))
    args = ["--algorithm", "pmcod", "--W", "20", "--S", "10", "--k", "2", "--R", "0.3", "--dataset", "d", "--partitions", "1"]
    for _ in range(2):
        main(args)
        assert lines_of(spark, tmp_path / "out" / "d") == [f"{e};20;10;0.3;2;0" for e in (10, 20, 30, 40, 50)]
    main([*args, "--debug"])
    assert sorted(x for x in capsys.readouterr().out.split() if ";" in x) == [f"{e};20;10;0.3;2;0" for e in (10, 20, 30, 40, 50)]
    (tmp_path / "d" / "input.txt").write_text("")
    main(args)
    assert lines_of(spark, tmp_path / "out" / "d") == []


def test_control_heeds_new_lines_once():
    from nearfield.operators.partition import Tree
    from nearfield.plans.adapt import AdaptiveRouter
    from nearfield.streaming.adaptive import PRODUCT, TIME, Control

    tree = Tree.build([[float(x)] for x in range(64)], 2, 0.5)
    control = Control(AdaptiveRouter(tree, window=10, radius=0.5))
    assert control.heed(["20;1;9;2;1", "10;1;100;2;10;3;10;4;10"]) == ["10;1;100;2;10;3;10;4;10", "20;1;9;2;1"]
    assert control.heed(["20;1;9;2;1", "10;1;1"]) == []
    assert control.decisions == [(20, [1], [])]
    assert control.metrics.adaptations == 1
    assert control.heed(["30;1;9;2;1"])
    assert control.router.version == 1
    for kind, want in ((TIME, {1: 90.0, 2: 10.0}), (PRODUCT, {1: 270.0, 2: 10.0})):
        timed = Control(AdaptiveRouter(tree, window=10, radius=0.5), kind)
        timed.metrics.add([{"owners": 4, "replicas": 1}], 100.0)
        assert timed._timed({1: 3.0, 2: 1.0}) == pytest.approx(want)
    assert "slides=1i,owners=4i,replicas=1i,total_ms=100" in timed.metrics.line()


def test_shared_folder(spark, tmp_path):
    """Refused on a cluster without one; what an application writes stands below one folder."""
    from types import SimpleNamespace

    from nearfield import shared

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(cluster)
    assert shared.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file:///")
    with shared.written() as paths:
        at = shared.new_path(spark, "x")
        spark.range(3).write.parquet(at)
    assert paths == [at]
    assert spark.sparkContext.applicationId in at
    shared.remove(spark, at)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(at)
