"""Parsing, generators, parameters, lines and streams."""

import pytest
from pyspark.sql import functions as F

from nearfield.config import JobConfig, Query, checked, parse_args, required_env
from nearfield.functions import distance as dist
from nearfield.operators import partition, ranks, reports
from nearfield.operators.outliers import detect
from nearfield.sources import points as src


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_distances(spark):
    assert one(spark, dist.euclidean(arr(0, 3), arr(4, 0))) == 5
    assert one(spark, dist.euclidean(arr(0, 3), arr(4, 0), 2)) == 5
    assert one(spark, dist.euclidean(arr(1, 2, 9), arr(1, 2))) == 0
    assert one(spark, dist.jaccard(arr(1, 1, 2), arr(1, 2, 3))) == pytest.approx(1 / 3)
    assert [one(spark, dist.layer(F.lit(d), [1.0, 2.0])) for d in (1.0, 1.5, 2.5)] == [0, 1, None]
    assert one(spark, dist.slide_start(F.lit(17), 5)) == 15
    assert one(spark, dist.is_power_of_two(F.lit(64)))
    with pytest.raises(ValueError, match="unknown"):
        dist.distance(arr(1), arr(1), "nope")


def test_text_and_json(spark):
    lines = spark.createDataFrame([("7&1.25,3.5",)], "value string")
    assert tuple(src.parse_text(lines).first()) == (7, [1.25, 3.5], 7)
    lines = spark.createDataFrame([('{"id":"7","timestamp":"1600000000000","value":[1.25,3.5]}',)], "value string")
    p = src.parse_json(lines)
    assert tuple(p.first()) == (7, [1.25, 3.5], 1600000000000)
    assert src.parse_json(src.to_json(p)).first() == p.first()


def test_generators_hold_their_ranges(spark):
    stk = src.generated(spark, "stk", 5000, seed=3)
    assert stk.where("value[0] < 0 or value[0] > 9930 or size(value) <> 1").count() == 0
    share = stk.where("value[0] >= 80 and value[0] < 120").count() / 5000
    assert abs(share - 0.65) < 0.03
    assert src.generated(spark, "tao", 500).where("size(value) <> 3").count() == 0
    assert stk.orderBy("id").collect() == src.generated(spark, "stk", 5000, seed=3).orderBy("id").collect()


def test_feedback_is_monotone():
    assert src.feedback(["5;1;2", "4;1;2", "6;1;9"], 4) == (["5;1;2", "6;1;9"], 6)


@pytest.mark.parametrize("bad", [[], [Query(10, 3, 1.0, 1)], [Query(5, 10, 1.0, 1)], [Query(10, 5, 1.0, 0)], [Query(10, 5, -1.0, 1)]])
def test_bad_queries(bad):
    with pytest.raises(ValueError):
        checked(bad)


def test_spaces():
    with pytest.raises(ValueError):
        checked([Query(10, 5, 1.0, 1), Query(10, 5, 1.0, 2)], "single")
    with pytest.raises(ValueError):
        checked([Query(10, 5, 1.0, 1), Query(20, 5, 1.0, 1)], "rk")
    job = parse_args(["--algorithm", "sop_rk", "--W", "20", "--S", "5", "--k", "2;3", "--R", "0.5;1.5", "--partitions", "3;2"])
    assert len(job.queries) == 4
    assert job.partitions == (3, 2)
    with pytest.raises(ValueError, match="tree"):
        JobConfig("pmcod", (10,), (5,), (1,), (1.0,), policy="naive")


def test_environment(monkeypatch):
    monkeypatch.setenv("SOME_KEY", "x")
    assert required_env("SOME_KEY") == "x"
    monkeypatch.delenv("SOME_KEY")
    with pytest.raises(KeyError):
        required_env("SOME_KEY")


def test_lines(spark):
    costs = spark.createDataFrame([(0, 10, 4), (1, 10, 6), (0, 20, 5)], "part int, window_end long, cost long")
    lines = reports.cost_lines(costs)
    assert {r["line"] for r in lines.collect()} == {"10;0;4;1;6", "20;0;5"}
    assert {tuple(r) for r in reports.parse_cost_lines(lines.select("line")).collect()} == {(10, 0, 4.0), (10, 1, 6.0), (20, 0, 5.0)}
    assert [tuple(r) for r in reports.latest(costs).collect()] == [(0, 5)]
    found = spark.createDataFrame([(10, 5, 5, 1.0, 2, 7), (10, 5, 5, 1.0, 2, 3)], "window_end long, W long, S long, R double, k int, id long")
    ids = reports.report_ids(found)
    assert ids.first()["ids"] == "3,7"
    assert reports.line_protocol(ids).first()["line"] == 'outliers,W=5,S=5,k=2,R=1.0 Outliers=2i,IDs="3,7" 10'
    moved = spark.createDataFrame([(30, [1, 2], [])], "effective_at long, over array<int>, under array<int>")
    assert reports.adaptation_lines(moved).first()["line"] == 'adaptations Overload="1;2",Underload="-" 30'
    assert reports.report_counts(spark.createDataFrame([(1, 2, 2, 1.0, 1, 3), (1, 2, 2, 1.0, 1, 4)], "window_end long, W long, S long, R double, k int, n_outliers long")).first()["n_outliers"] == 7


def test_ranks(spark):
    rows = spark.createDataFrame([(x,) for x in (5, 3, 3, 9, 1, 7)], "v long")
    assert sorted((r["rank"], r["v"]) for r in ranks.ranked(rows, "v").collect()) == [(0, 1), (1, 3), (2, 3), (3, 5), (4, 7), (5, 9)]
    assert [ranks.at_rank(rows, "v", k).first()["v"] for k in (0, 1, 2, 5)] == [1, 3, 3, 9]
    assert ranks.at_rank(rows, "v", 6).count() == 0


def test_state_operator_gives_the_batch_answer(spark, tmp_path):
    """Through the state store: a stream of files, a batch each, with a last late file that moves the watermark on."""
    from nearfield.streaming.detect import detect_stream

    q = Query(20_000, 5_000, 0.4, 2)
    rows = [(i, [float(i % 7) / 2], 1000 * i + 1000) for i in range(60)]
    p = spark.createDataFrame(rows, src.POINT)
    for k in range(4):
        p.where(f"id >= {15 * k} and id < {15 * (k + 1)}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    spark.createDataFrame([(1000, [0.0], 500_000)], src.POINT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.POINT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("a"))
    grid = partition.Grid(((1.0, 2.0),))
    query = detect_stream(stream, [q], grid, "0 seconds").writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["window_end"], i) for r in spark.table("found").collect() for i in r["ids"] if r["window_end"] <= 60_000}
    want = {(r["window_end"], r["id"]) for r in detect(p, [q], dims=1).collect() if r["window_end"] <= 60_000}
    assert got == want
    assert got
