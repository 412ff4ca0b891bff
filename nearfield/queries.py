"""Registered queries of the engine, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearfield.config import ALGORITHMS, Query, query_product, step_of
from nearfield.functions import distance
from nearfield.operators import neighbors, outliers, partition, ranges, reports, windows
from nearfield.plans import adapt, strategies
from nearfield.sources import points as src
from nearfield.streaming.adaptive import Control, detect_adaptive

HOUR = 3_600_000_000
W1, S1, R1, K1 = 24 * HOUR, 6 * HOUR, 2.005, 5
SINGLE = [Query(W1, S1, R1, K1)]
RK = query_product([W1], [S1], [2.005, 5.005], [3, 5])
RKWS = query_product([W1, 12 * HOUR], [S1, 12 * HOUR], [2.005, 5.005], [3, 5])
RADII = [0.505, 1.005, 2.005]
DAY = 24 * HOUR

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None, name: str | None = None) -> Callable[[Run], Run]:
    def put(f: Run) -> Run:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


# --- shared pieces of SQL ------------------------------------------------------------------------------------------

P = "p AS (SELECT event_id AS id, value AS x, epoch_us(ts) AS a FROM events)"


def _members(W: int, S: int, p: str = "p") -> str:
    return f"SELECT *, unnest(generate_series((a//{S}+1)*{S}, (a//{S})*{S}+{W}, {S})) AS we FROM {p}"


def brute_force(W: int, S: int, R: float, k: int, p: str = P, d: str = "sqrt(pow(l.x-r.x,2))") -> str:
    """window_end, id of the outliers, by joining all members of a window."""
    return f"""WITH {p}, w AS ({_members(W, S)}),
n AS (SELECT l.we, l.id, count(r.id) AS n FROM w l LEFT JOIN w r ON l.we = r.we AND l.id <> r.id AND {d} <= {R} GROUP BY 1, 2)
SELECT we AS window_end, id FROM n WHERE n < {k}"""


def answers(queries: list[Query]) -> str:
    """All queries, one after the other."""
    parts = [f"SELECT window_end, {q.W}::BIGINT AS W, {q.S}::BIGINT AS S, {q.R}::DOUBLE AS R, {q.k}::INTEGER AS k, id FROM ({brute_force(q.W, q.S, q.R, q.k)})" for q in queries]
    return "\nUNION ALL\n".join(parts)


def tallies(queries: list[Query]) -> str:
    """Counts of outliers of every query and window, zeros included."""
    parts = [f"""SELECT we AS window_end, {q.W}::BIGINT AS W, {q.S}::BIGINT AS S, {q.R}::DOUBLE AS R, {q.k}::INTEGER AS k, count(*) FILTER (n < {q.k}) AS n_outliers
FROM (WITH {P}, w AS ({_members(q.W, q.S)}) SELECT l.we, l.id, count(r.id) AS n FROM w l LEFT JOIN w r ON l.we = r.we AND l.id <> r.id AND sqrt(pow(l.x-r.x,2)) <= {q.R} GROUP BY 1, 2) GROUP BY we""" for q in queries]
    return "\nUNION ALL\n".join(parts)


#: Ordered pairs within the radius whose slides are less than a window apart.
PAIRS = f"{P}, s AS (SELECT *, a//{S1} AS sl FROM p), pairs AS (SELECT l.id, l.a, l.sl, r.id AS nid, r.a AS na, r.sl AS nsl, sqrt(pow(l.x-r.x,2)) AS d FROM s l JOIN s r ON l.id <> r.id AND abs(l.sl-r.sl) < {W1 // S1} AND sqrt(pow(l.x-r.x,2)) <= {R1})"
LAYER = f"CASE WHEN d <= {RADII[0]} THEN 0 WHEN d <= {RADII[1]} THEN 1 ELSE 2 END"


# --- detection -------------------------------------------------------------------------------------------------------


@registered(answers(SINGLE))
def outliers_single(spark, sf_dir):
    """One query."""
    return outliers.detect(src.events(spark, sf_dir), SINGLE, dims=1)


@registered(answers(RK))
def outliers_rk(spark, sf_dir):
    """Several radii and counts from one histogram."""
    return outliers.detect(src.events(spark, sf_dir), RK, dims=1)


@registered(answers(RKWS))
def outliers_rkws(spark, sf_dir):
    """Several radii, counts, windows and slides from one histogram."""
    return outliers.detect(src.events(spark, sf_dir), RKWS, dims=1)


@registered(tallies(RK))
def outliers_report_counts(spark, sf_dir):
    return outliers.report(src.events(spark, sf_dir), RK, dims=1)


@registered(f"SELECT window_end, W, S, R, k, count(*) AS n_outliers, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM ({answers(SINGLE)}) GROUP BY ALL")
def outliers_report_ids(spark, sf_dir):
    return reports.report_ids(outliers_single(spark, sf_dir))


@registered(f"SELECT 'outliers,W=' || W || ',S=' || S || ',k=' || k || ',R=' || R || ' Outliers=' || n_outliers || 'i ' || window_end AS line FROM ({tallies(RK)})")
def report_lines(spark, sf_dir):
    """Counts as lines of a time series."""
    return reports.line_protocol(outliers_report_counts(spark, sf_dir))


@registered(f"SELECT 'outliers,W=' || W || ',S=' || S || ',k=' || k || ',R=' || R || ' Outliers=' || count(*) || 'i,IDs=\"' || string_agg(id::VARCHAR, ',' ORDER BY id) || '\" ' || window_end AS line FROM ({answers(SINGLE)}) GROUP BY window_end, W, S, R, k")
def report_lines_ids(spark, sf_dir):
    """Lines of a time series with the ids as a field."""
    return reports.line_protocol(outliers_report_ids(spark, sf_dir))


@registered(f"SELECT concat_ws(';', window_end, W, S, R, k, n_outliers) AS line FROM ({tallies(SINGLE)})")
def report_text(spark, sf_dir):
    """Counts as text lines."""
    return reports.count_lines(outliers.report(src.events(spark, sf_dir), SINGLE, dims=1))


@registered(brute_force(W1, HOUR, R1, K1))
def outliers_long(spark, sf_dir):
    """Windows of many slides: counts go up and down by steps."""
    return outliers.detect(src.events(spark, sf_dir), [Query(W1, HOUR, R1, K1)], dims=1).select("window_end", "id")


def _strategy(name: str, queries: list[Query]) -> None:
    @registered(answers(queries), f"strategy_{name}")
    def run(spark, sf_dir):
        return strategies.detect_with(name, src.events(spark, sf_dir), queries, dims=1)


for _name, _space in ALGORITHMS.items():
    _strategy(_name, {"single": SINGLE, "rk": RK, "rkws": RKWS}[_space])

_SETS = "o AS (SELECT o_orderkey AS id, o_orderkey AS a, list_distinct(list((l_suppkey % 12)::DOUBLE)) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey), p AS (SELECT * FROM o)"


@registered(brute_force(200, 50, 0.4, 3, _SETS, "(1 - len(list_intersect(l.v, r.v)) / len(list_distinct(list_concat(l.v, r.v))))"))
def jaccard_outliers(spark, sf_dir):
    """Sets of suppliers by order; slides alone carry the join."""
    return outliers.detect(src.order_sets(spark, sf_dir), [Query(200, 50, 0.4, 3)], "jaccard").select("window_end", "id")


_VECTORS = "p AS (SELECT vec_id AS id, vec_id AS a, embedding::DOUBLE[] AS v FROM embeddings)"


@registered(brute_force(100, 25, 1.3, 5, _VECTORS, "sqrt(list_sum(list_transform(list_zip(l.v, r.v), lambda t: pow(t[1]-t[2], 2))))"))
def vector_outliers(spark, sf_dir):
    """Vectors of 64 dimensions; the first two make cells."""
    return outliers.detect(src.embeddings(spark, sf_dir), [Query(100, 25, 1.3, 5)], dims=64).select("window_end", "id")


_LINES = "p AS (SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_quantity::DOUBLE AS x, 100*l_discount AS y, 100*l_tax AS z, epoch_us(l_shipdate) AS a FROM lineitem)"


@registered(brute_force(28 * DAY, 7 * DAY, 3.5, 4, _LINES, "sqrt(pow(l.x-r.x,2)+pow(l.y-r.y,2)+pow(l.z-r.z,2))"))
def multi_dim_outliers_whole(spark, sf_dir):
    """Three dimensions with many equal times, over the whole table."""
    return outliers.detect(src.line_points(spark, sf_dir), [Query(28 * DAY, 7 * DAY, 3.5, 4)], dims=3).select("window_end", "id")


# --- neighbours ------------------------------------------------------------------------------------------------------


@registered(f"WITH {PAIRS} SELECT id, nid FROM pairs")
def neighbor_pairs(spark, sf_dir):
    return ranges.pairs(src.events(spark, sf_dir), R1, W1, S1)


@registered(f"WITH {PAIRS} SELECT id, count(*) AS n FROM pairs GROUP BY id")
def neighbor_count(spark, sf_dir):
    return ranges.counts(src.events(spark, sf_dir), R1, W1, S1)


@registered(f"WITH {PAIRS} SELECT id, count(*) FILTER (na >= a) AS n_after, count(*) FILTER (na < a) AS n_before FROM pairs GROUP BY id")
def neighbor_split_count(spark, sf_dir):
    return ranges.split_counts(src.events(spark, sf_dir), R1, W1, S1)


@registered(f"WITH {PAIRS} SELECT id FROM pairs GROUP BY id HAVING count(*) FILTER (na >= a) >= {K1}")
def safe_inliers(spark, sf_dir):
    return ranges.split_counts(src.events(spark, sf_dir), R1, W1, S1).where(F.col("n_after") >= K1).select("id")


@registered(f"WITH {PAIRS} SELECT id, nsl, count(*) AS c FROM pairs GROUP BY id, nsl")
def slide_histogram(spark, sf_dir):
    return ranges.histogram(src.events(spark, sf_dir), [R1], W1, S1).select("id", "nsl", "c")


@registered(f"WITH {PAIRS}, h AS (SELECT id, {LAYER} AS layer, count(*) AS c FROM pairs GROUP BY 1, 2) SELECT id, layer, (sum(c) OVER (PARTITION BY id ORDER BY layer))::BIGINT AS n FROM h")
def layer_histogram(spark, sf_dir):
    return ranges.layer_counts(src.events(spark, sf_dir), RADII, W1, S1)


@registered(f"WITH {PAIRS} SELECT id, nid, rank FROM (SELECT id, nid, row_number() OVER (PARTITION BY id ORDER BY na DESC, nid DESC)::INTEGER AS rank FROM pairs WHERE na < a) WHERE rank <= {K1}")
def recent_k_neighbors(spark, sf_dir):
    return ranges.recent_k(src.events(spark, sf_dir), R1, W1, S1, K1)


@registered(f"WITH {PAIRS} SELECT id, layer, nid, rank FROM (SELECT *, row_number() OVER (PARTITION BY id, layer ORDER BY na DESC, nid DESC)::INTEGER AS rank FROM (SELECT *, {LAYER} AS layer FROM pairs)) WHERE rank <= {K1}")
def layer_recent_k(spark, sf_dir):
    return ranges.layer_recent_k(src.events(spark, sf_dir), RADII, W1, S1, K1)


@registered(f"""WITH {PAIRS} SELECT l.id, l.nid, count(r.nid) AS dominators FROM pairs l LEFT JOIN pairs r ON l.id = r.id AND r.d <= l.d AND (r.na > l.na OR (r.na = l.na AND r.nid > l.nid))
GROUP BY 1, 2 HAVING count(r.nid) <= {K1}""")
def k_skyband(spark, sf_dir):
    return ranges.k_skyband(src.events(spark, sf_dir), R1, W1, S1, K1)


@registered(f"""WITH {PAIRS}, y AS (SELECT *, {LAYER} AS layer FROM pairs) SELECT l.id, l.nid, l.layer, count(r.nid) AS later FROM y l LEFT JOIN y r ON l.id = r.id AND r.layer <= l.layer AND (r.na > l.na OR (r.na = l.na AND r.nid > l.nid))
GROUP BY 1, 2, 3 HAVING count(r.nid) < {K1}""")
def layered_skyband(spark, sf_dir):
    return ranges.layered_skyband(src.events(spark, sf_dir), RADII, W1, S1, K1)


@registered(f"WITH {PAIRS} SELECT id, na + {W1} AS changes_at FROM (SELECT id, na, row_number() OVER (PARTITION BY id ORDER BY na DESC, nid DESC) AS r FROM pairs) WHERE r = {K1}")
def status_change_time(spark, sf_dir):
    return ranges.status_change(src.events(spark, sf_dir), R1, W1, S1, K1)


@registered(f"WITH {P}, w AS ({_members(W1, S1)}) SELECT we AS window_end, floor(x / ({R1} * (1 - 1e-9)))::BIGINT AS cell, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) > {K1}")
def dense_cells(spark, sf_dir):
    members = windows.assign_windows(src.events(spark, sf_dir), W1, S1)
    return neighbors.dense_cells(members, R1, K1, 1).select("window_end", F.col("cell")[0].alias("cell"), "n")


@registered("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
m AS (SELECT q.vec_id AS id, e.vec_id AS nid, sqrt(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.v), lambda t: pow(t[1]-t[2], 2)))) AS d FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
SELECT id, nid, rank FROM (SELECT id, nid, row_number() OVER (PARTITION BY id ORDER BY d, nid)::INTEGER AS rank FROM m) WHERE rank <= 10""")
def knn(spark, sf_dir):
    """The ten nearest of every hundredth vector."""
    p = src.embeddings(spark, sf_dir)
    return neighbors.knn(p.where("id % 100 = 0"), p, 10, dims=64).select("id", "nid", "rank")


@registered(f"""WITH {P}, m AS (SELECT l.id, r.id AS nid, sqrt(pow(l.x-r.x,2)) AS d FROM p l JOIN p r ON l.id % 100 = 0 AND l.id <> r.id AND sqrt(pow(l.x-r.x,2)) <= 0.505)
SELECT id, nid, rank FROM (SELECT id, nid, row_number() OVER (PARTITION BY id ORDER BY d, nid)::INTEGER AS rank FROM m) WHERE rank <= 5""")
def knn_within(spark, sf_dir):
    """The five nearest of every hundredth point, no farther than a bound: by cells."""
    p = src.events(spark, sf_dir)
    return neighbors.knn(p.where("id % 100 = 0"), p, 5, dims=1, max_distance=0.505).select("id", "nid", "rank")


@registered(f"WITH {P} SELECT l.id, r.id AS nid FROM p l JOIN p r ON l.id % 100 = 0 AND l.id <> r.id AND sqrt(pow(l.x-r.x,2)) <= 0.505")
def radius_lookup(spark, sf_dir):
    """All points near every hundredth one, whatever their times."""
    p = src.events(spark, sf_dir)
    return neighbors.radius_lookup(p.where("id % 100 = 0"), p, 0.505, 1)


@registered(f"""WITH {P}, m AS (SELECT p.id, c.id AS mc_id, sqrt(pow(p.x-c.x,2)) AS d FROM p JOIN p c ON c.id % 100 = 0 AND sqrt(pow(p.x-c.x,2)) <= 1.5 * {R1})
SELECT id, mc_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, mc_id) AS r FROM m) WHERE r = 1 AND d <= {R1} / 2""")
def nearest_cluster(spark, sf_dir):
    p = src.events(spark, sf_dir)
    return neighbors.nearest_cluster(p, p.where("id % 100 = 0"), R1, 1).select("id", "mc_id")


@registered(f"WITH {P}, d AS (SELECT sqrt(pow(x-50.0,2)) AS d FROM p) SELECT d AS threshold FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM d) WHERE r = n // 2")
def median_threshold(spark, sf_dir):
    return neighbors.median_threshold(src.events(spark, sf_dir), [50.0])


@registered(f"WITH {P}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM p), i AS (SELECT (i * (SELECT count(*) FROM p)) // 100 AS place FROM range(100) t(i)) SELECT id FROM r WHERE r.r IN (SELECT place FROM i)")
def stride_sample(spark, sf_dir):
    """A hundred points at even places."""
    return neighbors.stride_sample(src.events(spark, sf_dir), 100)


@registered("SELECT event_id AS id FROM events ORDER BY md5('1-' || event_id), event_id LIMIT 100")
def random_sample(spark, sf_dir):
    """A hundred points by a seeded hash."""
    return neighbors.random_sample(src.events(spark, sf_dir), 100).select("id")


# --- functions ---------------------------------------------------------------------------------------------------------


@registered("SELECT event_id AS id, event_id > 0 AND event_id & (event_id - 1) = 0 AS power FROM events")
def power_of_two(spark, sf_dir):
    return src.events(spark, sf_dir).select("id", distance.is_power_of_two(F.col("id")).alias("power"))


@registered(f"WITH {P} SELECT id, {HOUR} + (a - {HOUR}) // {S1} * {S1} AS slide FROM p")
def slide_of_arrival(spark, sf_dir):
    """Where the slide of each arrival begins, counted from a start."""
    return src.events(spark, sf_dir).select("id", distance.slide_start(F.col("a"), S1, HOUR).alias("slide"))


@registered("SELECT count(*) AS n_points, count(DISTINCT value) AS n_hashes FROM events")
def vector_hash(spark, sf_dir):
    """Equal coordinates have one hash, others others."""
    return src.events(spark, sf_dir).agg(F.count("*").alias("n_points"), F.count_distinct(distance.vector_hash(F.col("value"))).alias("n_hashes"))


@registered(f"WITH {_SETS} SELECT id, list_contains(v, 3.0) AS found FROM p")
def contains_value(spark, sf_dir):
    return src.order_sets(spark, sf_dir).select("id", distance.contains(F.col("value"), 3.0).alias("found"))


@registered(f"SELECT gcd({S1}, {12 * HOUR})::BIGINT AS step")
def shared_step(spark, sf_dir):
    """The slide that all queries share."""
    return spark.createDataFrame([(step_of(RKWS),)], "step long")


# --- windows -----------------------------------------------------------------------------------------------------------


@registered(f"WITH {P}, w AS ({_members(W1, S1)}) SELECT id, we AS window_end FROM w")
def window_assign(spark, sf_dir):
    return windows.assign_windows(src.events(spark, sf_dir), W1, S1).select("id", "window_end")


@registered(f"WITH {P}, w AS ({_members(W1, S1)}) SELECT id, we AS window_end FROM w WHERE a >= we - {S1}")
def new_slide(spark, sf_dir):
    return windows.new_slide(windows.assign_windows(src.events(spark, sf_dir), W1, S1), S1).select("id", "window_end")


@registered(f"WITH {P}, w AS ({_members(W1, S1)}) SELECT id, we AS window_end FROM w WHERE a < we - {W1} + {S1}")
def expired_slide(spark, sf_dir):
    return windows.expired_slide(windows.assign_windows(src.events(spark, sf_dir), W1, S1), W1, S1)


_COPIES = f"SELECT *, (id % 3 = 0)::INTEGER AS flag, CASE WHEN id % 2 = 0 THEN we ELSE we - {S1} END AS countdown"


@registered(f"WITH {P}, w AS ({_members(W1, S1)}), c AS ({_COPIES} FROM w) SELECT id, we AS window_end FROM c WHERE (flag = 1 AND countdown >= we) OR (flag = 0 AND countdown < we)")
def reportable(spark, sf_dir):
    m = windows.assign_windows(src.events(spark, sf_dir), W1, S1)
    flag, countdown = (F.col("id") % 3 == 0).cast("int"), F.when(F.col("id") % 2 == 0, F.col("window_end")).otherwise(F.col("window_end") - S1)
    return m.where(windows.reportable(flag, countdown, F.col("window_end"))).select("id", "window_end")


@registered(f"WITH {P}, w AS ({_members(W1, S1)}), c AS ({_COPIES} FROM w) SELECT we AS window_end, count(*) FILTER (a >= we - {S1} AND flag = 0) AS owners, count(*) FILTER (a >= we - {S1} AND flag = 1) AS replicas FROM c GROUP BY we")
def slide_counts(spark, sf_dir):
    m = windows.assign_windows(src.events(spark, sf_dir), W1, S1).withColumn("flag", (F.col("id") % 3 == 0).cast("int"))
    return windows.slide_counts(m, S1)


@registered("SELECT W, S, R, k FROM (SELECT unnest([86400000000::BIGINT, 43200000000::BIGINT]) AS W), (SELECT unnest([21600000000::BIGINT, 43200000000::BIGINT]) AS S), (SELECT unnest([2.005::DOUBLE, 5.005::DOUBLE]) AS R), (SELECT unnest([3, 5]) AS k)")
def query_product_rows(spark, sf_dir):
    return windows.queries_frame(spark, RKWS)


# --- partitioning ------------------------------------------------------------------------------------------------------

CUTS = 4
_CUTS = f"cuts AS (SELECT y, x AS cut FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r, count(*) OVER () AS n FROM p), range(1, {CUTS}) t(y) WHERE r = y * (n // {CUTS}))"
_ROUTED = f"cells AS (SELECT p.*, (SELECT count(*) FROM cuts WHERE cut < x) AS own, (SELECT count(*) FROM cuts WHERE cut < x - {R1}) AS lo, (SELECT count(*) FROM cuts WHERE cut < x + {R1}) AS hi FROM p), routed AS (SELECT id, x, a, own, unnest(range(lo, hi + 1)) AS part FROM cells)"


def _grid(spark, sf_dir) -> partition.Grid:
    return partition.Grid.build(src.events(spark, sf_dir), [CUTS])


def _tree(spark, sf_dir, height: int = 2) -> partition.Tree:
    sample = src.sample_head(src.events(spark, sf_dir), 2000).collect()  # 2000 points at most
    return partition.Tree.build([r["value"] for r in sample], height, R1)


@registered(f"WITH {P}, {_CUTS} SELECT y::INTEGER AS place, cut FROM cuts")
def grid_cuts(spark, sf_dir):
    return partition.grid_cuts(src.events(spark, sf_dir), [CUTS]).select("place", "cut")


@registered(f"WITH {P}, {_CUTS}, {_ROUTED} SELECT id, part::INTEGER AS part, (part <> own)::INTEGER AS flag FROM routed")
def grid_route(spark, sf_dir):
    return partition.route(src.events(spark, sf_dir), _grid(spark, sf_dir), R1).select("id", "part", "flag")


@registered(f"SELECT i::INTEGER AS part FROM range({CUTS}) t(i)")
def grid_partitions(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in _grid(spark, sf_dir).partitions()], "part int")


@registered(brute_force(W1, S1, R1, K1))
def partitioned_outliers_grid(spark, sf_dir):
    """Each partition on its own gives the global answer."""
    routed = partition.route(src.events(spark, sf_dir), _grid(spark, sf_dir), R1)
    return partition.partitioned_outliers(routed, W1, S1, R1, K1, dims=1)


@registered(brute_force(W1, S1, R1, K1))
def partitioned_outliers_tree(spark, sf_dir):
    routed = partition.route(src.events(spark, sf_dir), _tree(spark, sf_dir), R1)
    return partition.partitioned_outliers(routed, W1, S1, R1, K1, dims=1)


@registered(f"WITH {P} SELECT id, 1::BIGINT AS owners FROM p")
def vptree_route(spark, sf_dir):
    """Every point has one owner."""
    routed = partition.route(src.events(spark, sf_dir), _tree(spark, sf_dir, 3), R1)
    return routed.groupBy("id").agg(F.count_if(F.col("flag") == 0).alias("owners"))


@registered("SELECT i::INTEGER AS part FROM range(1, 9) t(i)")
def vptree_partitions(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in _tree(spark, sf_dir, 3).partitions()], "part int")


@registered(brute_force(W1, S1, R1, K1))
def adaptive_outliers(spark, sf_dir):
    """Thresholds move in mid-stream, and the answer stays."""
    p, old = src.events(spark, sf_dir), _tree(spark, sf_dir)
    new = old.adapt([1], [4], 2 * R1, R1)
    start = p.agg(F.min("a")).first()[0] // S1 * S1 + 5 * DAY
    routed = partition.route_transition(p, old, new, R1, start, start + 2 * W1)
    return partition.partitioned_outliers(routed, W1, S1, R1, K1, dims=1)


_COSTS = f"WITH {P}, {_CUTS}, {_ROUTED}, w AS ({_members(W1, S1, 'routed')}), costs AS (SELECT part::INTEGER AS part, we AS window_end, count(*) FILTER (part = own) AS cost FROM w GROUP BY 1, 2)"


@registered(f"{_COSTS} SELECT * FROM costs")
def partition_cost(spark, sf_dir):
    routed = partition.route(src.events(spark, sf_dir), _grid(spark, sf_dir), R1)
    return reports.partition_cost(windows.assign_windows(routed, W1, S1))


@registered(f"{_COSTS} SELECT window_end, window_end || ';' || string_agg(part || ';' || cost, ';' ORDER BY part) AS line FROM costs GROUP BY window_end")
def cost_lines(spark, sf_dir):
    return reports.cost_lines(partition_cost(spark, sf_dir))


@registered(f"{_COSTS} SELECT part, cost FROM costs WHERE window_end = (SELECT max(window_end) FROM costs)")
def latest_costs(spark, sf_dir):
    """What a store with one key holds at the end."""
    return reports.latest(partition_cost(spark, sf_dir))


_FULL = f"{_COSTS}, f AS (SELECT e.window_end, i::INTEGER AS part, coalesce(cost, 0) AS cost FROM (SELECT DISTINCT window_end FROM costs) e CROSS JOIN range({CUTS}) t(i) LEFT JOIN costs c ON c.window_end = e.window_end AND c.part = i), m AS (SELECT window_end, avg(cost) AS mean FROM f GROUP BY 1)"


def _full_costs(spark, sf_dir) -> DataFrame:
    return adapt.complete(partition_cost(spark, sf_dir), list(range(CUTS)))


@registered(f"{_FULL} SELECT window_end, part AS over FROM (SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY cost DESC, part) AS r FROM f) JOIN m USING (window_end) WHERE r = 1 AND cost * 100 / mean >= 105")
def policy_naive(spark, sf_dir):
    return adapt.policy_naive(_full_costs(spark, sf_dir), 105.0)


_ADVANCED = f"""{_FULL}, h AS (SELECT *, list(cost) OVER (PARTITION BY part ORDER BY window_end ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS past FROM f)
SELECT window_end, part, CASE WHEN cost * 100 / mean >= 102 THEN 'over' ELSE 'under' END AS load FROM h JOIN m USING (window_end)
WHERE mean > 0 AND len(past) = 3 AND len(list_filter(past, lambda c: abs(c * 100 / mean - cost * 100 / mean) <= 5.0)) = 3 AND (cost * 100 / mean >= 102 OR cost * 100 / mean < 98)"""


@registered(_ADVANCED)
def policy_advanced(spark, sf_dir):
    return adapt.policy_advanced(_full_costs(spark, sf_dir), 102.0, 98.0, queue=3)


@registered(f"""SELECT 'adaptations Overload="' || coalesce(string_agg(part::VARCHAR, ';' ORDER BY part) FILTER (load = 'over'), '-') || '",Underload="' || coalesce(string_agg(part::VARCHAR, ';' ORDER BY part) FILTER (load = 'under'), '-') || '" ' || (window_end + {W1}) AS line FROM ({_ADVANCED}) GROUP BY window_end""")
def adaptation_report(spark, sf_dir):
    """Decisions as points of a time series."""
    of = lambda load: F.array_sort(F.collect_list(F.when(F.col("load") == load, F.col("part"))))
    by = policy_advanced(spark, sf_dir).groupBy("window_end").agg(of("over").alias("over"), of("under").alias("under"))
    return reports.adaptation_lines(by.select((F.col("window_end") + W1).alias("effective_at"), "over", "under"))


# --- sources -----------------------------------------------------------------------------------------------------------


@registered(f"WITH {P} SELECT id, x, id AS a FROM p")
def parse_text_points(spark, sf_dir):
    """Points written as text and parsed again."""
    return src.parse_text(src.to_text(src.events(spark, sf_dir))).select("id", F.col("value")[0].alias("x"), "a")


@registered(f"WITH {P} SELECT id, x, a FROM p")
def parse_json_points(spark, sf_dir):
    """Points written as JSON and parsed again."""
    return src.parse_json(src.to_json(src.events(spark, sf_dir))).select("id", F.col("value")[0].alias("x"), "a")


@registered("SELECT event_id AS id FROM events ORDER BY event_id LIMIT 100")
def sample_reader(spark, sf_dir):
    """The head of a table: what partitioners are built from."""
    return src.sample_head(src.events(spark, sf_dir), 100).select("id")


def _generated(kind: str, n: int) -> str:
    """The mixtures of a generator, with seed 1."""
    picked = lambda salt: f"('0x' || substr(md5(i || '-{salt}'), 1, 7))::BIGINT / 268435456.0::DOUBLE"
    columns = []
    for d, (name, parts) in enumerate(zip("xyz", src.GENERATORS[kind], strict=False)):
        total, upto, cases = sum(w for *_, w in parts), 0.0, ""
        for base, width, weight in parts:
            upto += weight / total
            cases += f" WHEN {picked(1000 + 2 * d)} < {upto}::DOUBLE THEN {base}::DOUBLE + {picked(1001 + 2 * d)} * {width}::DOUBLE"
        base, width, _ = parts[-1]
        columns.append(f"round(CASE{cases} ELSE {base}::DOUBLE + {picked(1001 + 2 * d)} * {width}::DOUBLE END, 2) + 0.0::DOUBLE AS {name}")
    return f"SELECT i AS id, {', '.join(columns)}, i AS a FROM range({n}) t(i)"


@registered(_generated("stk", 10_000))
def generator_stk(spark, sf_dir):
    return src.generated(spark, "stk", 10_000).select("id", F.col("value")[0].alias("x"), "a")


@registered(_generated("tao", 10_000))
def generator_tao(spark, sf_dir):
    return src.generated(spark, "tao", 10_000).select("id", *(F.col("value")[i].alias(c) for i, c in enumerate("xyz")), "a")


@registered(brute_force(W1, S1, R1, K1))
def stream_outliers(spark, sf_dir):
    """The whole table replayed as a stream of files, detected by micro-batches."""
    from nearfield.streaming.runs import replay_table

    return replay_table(spark, src.events(spark, sf_dir), SINGLE, dims=1).select("window_end", "id")


def _control(partitioner, policy: str, buffer_period: int) -> Control:
    return Control(adapt.AdaptiveRouter(partitioner, W1, R1, policy, over=105.0, buffer_period=buffer_period))


def _controlled(spark, sf_dir, control: Control) -> None:
    """The costs of the whole table in stretches of windows; the answers are not asked for."""
    p = src.events(spark, sf_dir)
    low, high = p.agg(F.min("a"), F.max("a")).first()
    detect_adaptive(p, SINGLE[0], control, low // S1 * S1, (high // S1 + W1 // S1) * S1, lambda *_: None, dims=1)


@registered(brute_force(W1, S1, R1, K1))
def adaptive_stream_outliers(spark, sf_dir):
    """A stream by partitions whose thresholds move with their costs: the answer stays."""
    from nearfield.streaming.runs import replay_table

    return replay_table(spark, src.events(spark, sf_dir), SINGLE, dims=1, control=_control(_tree(spark, sf_dir), "naive", 5)).select("window_end", "id")


@registered()
def adaptations(spark, sf_dir):
    """What the naive policy decides over the whole table."""
    control = _control(_tree(spark, sf_dir), "naive", 5)
    _controlled(spark, sf_dir, control)
    return reports.adaptation_lines(spark.createDataFrame(control.decisions, "effective_at long, over array<int>, under array<int>"))


@registered(f"WITH {P}, {_CUTS}, {_ROUTED}, w AS ({_members(W1, S1, 'routed')}) SELECT count(DISTINCT we) AS slides, count(*) FILTER (a >= we - {S1} AND part = own) AS owners, count(*) FILTER (a >= we - {S1} AND part <> own) AS replicas, 0::BIGINT AS adaptations FROM w")
def stream_metrics(spark, sf_dir):
    """The counters of a job on a grid."""
    control = _control(_grid(spark, sf_dir), "static", 10)
    _controlled(spark, sf_dir, control)
    m = control.metrics
    return spark.createDataFrame([(m.slides, m.owners, m.replicas, m.adaptations)], "slides long, owners long, replicas long, adaptations long")
