"""Small cases by hand, strategies and partitionings against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.config import ALGORITHMS, Query, query_product
from nearfield.operators import neighbors, outliers, partition
from nearfield.plans import strategies
from nearfield.plans.adapt import AdaptiveRouter, policy_naive
from nearfield.sources.points import POINT


def frame(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in v], a) for i, v, a in points], POINT)


def brute(points, q, kind="euclidean"):
    out = set()
    ends = {e for _, _, a in points for e in range((a // q.S + 1) * q.S, a // q.S * q.S + q.W + 1, q.S)}
    for e in ends:
        inside = [(i, v) for i, v, a in points if e - q.W <= a < e]
        for i, v in inside:
            if sum(partition.vector_distance(v, w, kind) <= q.R for j, w in inside if j != i) < q.k:
                out.add((e, i))
    return out


def found(df, q=None):
    rows = df.collect()
    return {(r["window_end"], r["id"]) for r in rows if q is None or (r["W"], r["S"], r["R"], r["k"]) == (q.W, q.S, q.R, q.k)}


SIX = [(1, [0.0], 0), (2, [0.5], 1), (3, [1.0], 2), (4, [9.0], 3), (5, [0.4], 6), (6, [9.5], 12)]


def test_by_hand(spark):
    q = Query(10, 5, 1.0, 2)
    assert found(outliers.detect(frame(spark, SIX), [q], dims=1)) == {(5, 4), (10, 4), (15, 5), (15, 6), (20, 6)}
    counts = {r["window_end"]: r["n_outliers"] for r in outliers.report(frame(spark, SIX), [q], dims=1).collect()}
    assert counts == {5: 1, 10: 1, 15: 2, 20: 1}


def test_windows_without_outliers_are_reported(spark):
    same = [(i, [1.0], 0) for i in range(4)]
    assert [r["n_outliers"] for r in outliers.report(frame(spark, same), [Query(10, 5, 1.0, 3)], dims=1).collect()] == [0, 0]


@pytest.mark.parametrize(
    ("points", "q"),
    [
        (SIX, Query(10, 5, 1.0, 1)),
        ([(1, [3.0], 7)], Query(10, 5, 1.0, 1)),
        ([(i, [2.0], i) for i in range(6)] + [(9, [3.0], 2)], Query(4, 2, 0.0, 2)),
        ([(i, [float(i % 3)], 5) for i in range(9)], Query(10, 10, 0.5, 3)),
        ([(1, [0.0], 0), (2, [0.0], 100)], Query(10, 5, 1.0, 1)),
        ([(1, [-0.5], 1), (2, [0.5], 1), (3, [-1.5], 1)], Query(2, 1, 1.0, 1)),
    ],
)
def test_edges(spark, points, q):
    assert found(outliers.detect(frame(spark, points), [q], dims=1)) == brute(points, q)


def spread(seed, n, dims, times=60, values=12):
    r = random.Random(seed)
    return [(i, [round(r.random() * values, 1) for _ in range(dims)], r.randrange(times)) for i in range(n)]


@pytest.mark.parametrize("name", sorted(ALGORITHMS))
@pytest.mark.parametrize(("dims", "kind"), [(1, "euclidean"), (2, "euclidean"), (2, "jaccard")])
def test_strategies_agree(spark, name, dims, kind):
    points = spread(dims, 90, dims) if kind == "euclidean" else [(i, [v // 3 for v in x], a) for i, x, a in spread(7, 60, 4)]
    radii = [0.65, 1.55] if kind == "euclidean" else [0.41, 0.71]
    queries = {"single": [Query(20, 5, radii[1], 3)], "rk": query_product([20], [5], radii, [2, 4]), "rkws": query_product([20, 40], [5, 10], radii, [2, 4])}[ALGORITHMS[name]]
    answer = strategies.detect_with(name, frame(spark, points), queries, kind, dims if kind == "euclidean" else None).cache()
    for q in queries:
        assert found(answer, q) == brute(points, q, kind)


@pytest.mark.parametrize("cuts", [[1, 1], [3, 2], [12, 9]])  # also cells narrower than the radius
def test_grid_gives_the_global_answer(spark, cuts):
    points, q = spread(3, 80, 2), Query(20, 5, 1.55, 3)
    p = frame(spark, points)
    grid = partition.Grid.build(p, cuts)
    routed = partition.route(p, grid, q.R)
    assert {r["part"] for r in routed.collect()} <= set(grid.partitions())
    assert routed.where("flag = 0").groupBy("id").count().where("count <> 1").count() == 0
    assert found(partition.partitioned_outliers(routed, q.W, q.S, q.R, q.k, dims=2)) == brute(points, q)


@pytest.mark.parametrize(("height", "kind"), [(1, "euclidean"), (3, "euclidean"), (2, "jaccard")])
def test_tree_gives_the_global_answer(spark, height, kind):
    points = spread(4, 80, 2) if kind == "euclidean" else [(i, [v // 3 for v in x], a) for i, x, a in spread(7, 50, 4)]
    q = Query(20, 5, 1.55 if kind == "euclidean" else 0.41, 3)
    p = frame(spark, points)
    tree = partition.Tree.build([v for _, v, _ in points], height, q.R, kind)
    assert found(partition.partitioned_outliers(partition.route(p, tree, q.R), q.W, q.S, q.R, q.k, kind, 2 if kind == "euclidean" else None)) == brute(points, q, kind)


def test_moving_thresholds_leave_the_answer(spark):
    points, q = spread(5, 120, 2, times=100), Query(20, 5, 1.55, 3)
    p = frame(spark, points)
    old = partition.Tree.build([v for _, v, _ in points], 2, q.R)
    new = old.adapt([1], [4], 1.0, q.R)
    assert new != old
    routed = partition.route_transition(p, old, new, q.R, 30, 60)
    assert found(partition.partitioned_outliers(routed, q.W, q.S, q.R, q.k, dims=2)) == brute(points, q)


def test_tree_is_seeded_and_refuses_small_samples():
    sample = [[float(x)] for x in range(40)]
    assert partition.Tree.build(sample, 3, 0.5) == partition.Tree.build(sample, 3, 0.5)
    with pytest.raises(ValueError, match="too small"):
        partition.Tree.build([[1.0]], 2, 0.5)
    with pytest.raises(NotImplementedError):
        partition.Grid(((1.0,),)).adapt()


def test_adapt_keeps_thresholds_above_the_floor():
    tree = partition.Tree({(0, 1): partition.Node(5.0, (0.0,)), (1, 1): partition.Node(2.0, (0.0,)), (1, 2): partition.Node(2.0, (9.0,))}, 2)
    assert tree.adapt([1], [], 1.0, 0.5).nodes[1, 1].threshold == 1.0
    assert tree.adapt([1], [], 1.0, 1.0).nodes[1, 1].threshold == 2.0
    both = tree.adapt([1, 2], [], 1.0, 0.5)
    assert both.nodes[1, 1].threshold == 1.0
    assert both.nodes[0, 1].threshold == 4.0
    assert tree.adapt([], [3], 1.0, 0.5).nodes[1, 2].threshold == 3.0
    assert tree.adapt([1], [2], 1.0, 0.5).nodes[1, 1].threshold == 1.0


def test_naive_policy(spark):
    costs = spark.createDataFrame([(0, 1, 10), (1, 1, 10), (2, 1, 40), (0, 2, 10), (1, 2, 10), (2, 2, 11)], "part int, window_end long, cost long")
    assert [tuple(r) for r in policy_naive(costs).collect()] == [(1, 2)]


def test_router_waits_for_a_pending_change():
    tree = partition.Tree.build([[float(x)] for x in range(64)], 2, 0.5)
    r = AdaptiveRouter(tree, window=10, radius=0.5)
    costs = {1: 100.0, 2: 10.0, 3: 10.0, 4: 10.0}
    assert r.observe(10, costs) == (20, [1], [])
    assert r.observe(15, costs) is None
    assert r.tree == tree
    assert r.observe(30, costs) is None
    assert r.tree != tree
    assert r.adaptations == 1
    steady = AdaptiveRouter(tree, window=10, radius=0.5, policy="advanced", queue=3)
    assert [steady.observe(e, costs) for e in (1, 2)] == [None, None]
    assert steady.observe(3, costs)[1] == [1]


def test_no_nested_loops_in_the_plan(spark):
    plan = outliers.detect(frame(spark, SIX), [Query(10, 5, 1.0, 2)], dims=1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan
    assert "Python" not in plan


def test_skybands_by_hand(spark):
    pairs = spark.createDataFrame([(0, 10, n, t, d) for n, t, d in ((1, 1, 0.5), (2, 2, 0.9), (3, 3, 0.4), (4, 4, 0.7))], "id long, a long, nid long, na long, d double")
    assert {(r["nid"], r["dominators"]) for r in neighbors.k_skyband(pairs, 1).collect()} == {(1, 1), (3, 0), (4, 0)}
    assert {r["nid"] for r in neighbors.recent_k(pairs, 2).collect()} == {3, 4}
    assert {r["nid"] for r in neighbors.layered_skyband(pairs, [0.6, 1.0], 2).collect()} == {1, 3, 4}
    assert neighbors.status_change(pairs, 3, 100).first()["changes_at"] == 102
    assert neighbors.random_sample(pairs.select(F.col("nid").alias("id")), 2).count() == 2


@pytest.mark.parametrize("kind", ["euclidean", "jaccard"])
def test_long_windows(spark, kind):
    """Steps up and down give the counts of repeated rows, for several spaces at once."""
    points = spread(9, 70, 2, times=90) if kind == "euclidean" else [(i, [v // 3 for v in x], a) for i, x, a in spread(9, 40, 4, times=90)]
    queries = query_product([60, 20], [2, 10], [0.65, 1.55] if kind == "euclidean" else [0.41, 0.71], [2, 4])
    answer = outliers.detect(frame(spark, points), queries, kind, 2 if kind == "euclidean" else None).cache()
    for q in queries:
        assert found(answer, q) == brute(points, q, kind)


def test_skyband_by_brute_force(spark):
    r = random.Random(4)
    rows = [(i, 99, n, r.randrange(20), r.randrange(12) / 4) for i in range(15) for n in range(40)]
    pairs = spark.createDataFrame(rows, "id long, a long, nid long, na long, d double")
    later = lambda x, y: (y[3], y[2]) > (x[3], x[2])
    for k in (0, 1, 3):
        want = {(x[0], x[2]): n for x in rows if (n := sum(x[0] == y[0] and later(x, y) and y[4] <= x[4] for y in rows)) <= k}
        assert {(x["id"], x["nid"]): x["dominators"] for x in neighbors.k_skyband(pairs, k).collect()} == want


def test_nearest_in_blocks_and_cells(spark):
    points = spread(6, 120, 2)
    p = frame(spark, points)
    q = p.where("id % 4 = 0")
    d = partition.vector_distance
    for most in (None, 1.5):
        want = {}
        for i, v, _ in points:
            if i % 4 == 0:
                near = sorted((d(v, w, "euclidean"), j) for j, w, _ in points if j != i and (most is None or d(v, w, "euclidean") <= most))
                want |= {(i, j): rank for rank, (_, j) in enumerate(near[:3], 1)}
        for block in (7, 1000):
            assert {(x["id"], x["nid"]): x["rank"] for x in neighbors.knn(q, p, 3, dims=2, max_distance=most, block=block).collect()} == want
    best = {}
    for i, v, _ in points:
        near = sorted((d(v, w, "euclidean"), j) for j, w, _ in points if j % 4 == 0)
        if near[0][0] <= 0.75:
            best[i] = near[0][1]
    assert {x["id"]: x["mc_id"] for x in neighbors.nearest_cluster(p, q, 1.5, 2).collect()} == best
    sets = frame(spark, [(i, [float(x) for x in range(i % 5)], i % 7) for i in range(30)])
    many = [Query(10, 1, 1.0, 2), Query(10, 1, 2.0, 2)]
    grid = partition.Grid(((3.0, 6.0), ()))
    plans = [neighbors.knn(q, p, 3, dims=2, max_distance=1.5), neighbors.nearest_cluster(p, q, 1.5, 2), neighbors.radius_lookup(q, p, 1.0, 2), outliers.detect(sets, [Query(10, 5, 0.4, 2)], "jaccard"), outliers.detect(p, many, dims=2), partition.partitioned_outliers(partition.route(p, grid, 1.0), 10, 5, 1.0, 2, dims=2), neighbors.k_skyband(neighbors.neighbor_pairs(p, 1.0, 10, 5, dims=2), 2)]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan
        assert "Cartesian" not in plan


@pytest.mark.parametrize("kind", ["euclidean", "jaccard"])
def test_counts_by_slide(kind):
    """Points in any order and in batches of any size, windows answered as soon as their points are there, expired ones let go."""
    from nearfield.streaming.detect import SlideCounts

    r = random.Random(3)
    points = spread(12, 150, 2, times=100) if kind == "euclidean" else [(i, [v // 3 for v in x], a) for i, x, a in spread(7, 60, 4, times=100)]
    queries = query_product([20, 40], [5, 10], [0.65, 1.55] if kind == "euclidean" else [0.41, 0.71], [2, 4])
    state, got, left = None, set(), list(points)
    r.shuffle(left)
    for end in range(5, 145, 5):
        own = SlideCounts(queries, kind, state)
        now = [p for p in left if p[2] < end or (p[2] < end + 20 and r.random() < 0.3)]
        left = [p for p in left if p not in now]
        while now:
            batch, now = now[:7], now[7:]
            own.add(*(np.array([p[i] for p in batch]) for i in range(3)), np.zeros(len(batch), int), block=4)
        got |= {(W, S, R, k, e, i) for e, W, S, R, k, _, ids in own.results(end) for i in ids}
        own.expire(end)
        state = own.state()
    assert len(state[1]) == 0
    assert got == {(q.W, q.S, q.R, q.k, e, i) for q in queries for e, i in brute(points, q, kind)}


def test_sampled_median(spark):
    p = frame(spark, spread(2, 200, 1))
    whole = neighbors.median_threshold(p, [3.0]).first()["threshold"]
    assert neighbors.median_threshold(p, [3.0], sample=200).first()["threshold"] == whole
    assert abs(neighbors.median_threshold(p, [3.0], sample=100).first()["threshold"] - whole) < 2


def test_pairs_in_partitions_are_pruned(spark):
    """A dense cell's points are no left side of the join within their partition either."""
    from nearfield.operators.outliers import doubtful

    p = frame(spark, [(i, [0.01 * i], 1) for i in range(40)] + [(100, [5.0], 1)])
    routed = partition.route(p, partition.Grid(((2.0,),)), 1.0)
    assert [r["id"] for r in doubtful(routed, [Query(10, 5, 1.0, 3)], 1, True, ["part"], routed.where("flag = 0")).collect()] == [100]
