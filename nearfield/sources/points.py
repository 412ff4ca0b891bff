"""Points (id, value array<double>, a: time in whole units) from files, streams and tables; generators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

POINT = "id long, value array<double>, a long"
JSON_POINT = "id string, timestamp string, value array<double>"
DAY_US = 86_400_000_000


def parse_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """`id&v1,v2,...`; the time is the id."""
    parts = F.split(F.col(column), "&")
    return lines.select(parts[0].cast("long").alias("id"), F.transform(F.split(parts[1], ","), lambda v: v.cast("double")).alias("value"), parts[0].cast("long").alias("a"))


def parse_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Objects with id and timestamp as quoted numbers, and a list of values."""
    return lines.select(F.from_json(column, JSON_POINT).alias("j")).select(F.col("j.id").cast("long").alias("id"), F.col("j.value").alias("value"), F.col("j.timestamp").cast("long").alias("a"))


def read_text_points(spark: SparkSession, path: str) -> DataFrame:
    return parse_text(spark.read.text(path))


def stream_text_points(spark: SparkSession, path: str) -> DataFrame:
    return parse_text(spark.readStream.text(path))


def stream_json_points(spark: SparkSession, path: str) -> DataFrame:
    """Files of JSON lines, through the parser that the message queue uses too."""
    return parse_json(spark.readStream.text(path))


def stream_kafka_points(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Needs the connector's jar on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return parse_json(raw.select(F.col("value").cast("string").alias("value")))


def to_text(points: DataFrame) -> DataFrame:
    return points.select(F.concat(F.col("id").cast("string"), F.lit("&"), F.array_join(F.col("value").cast("array<string>"), ",")).alias("value"))


def to_json(points: DataFrame) -> DataFrame:
    return points.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.col("a").cast("string").alias("timestamp"), "value")).alias("value"))


def sample_head(points: DataFrame, n: int = 10_000) -> DataFrame:
    """The first n points by id: what partitioners are built from."""
    return points.orderBy("id").limit(n)


def feedback(rows: Sequence[str], last: int) -> tuple[list[str], int]:
    """Of cost lines (`time;key;cost;...`) those newer than all before them, and the newest time."""
    out = []
    for row in rows:
        t = int(row.split(";", 1)[0])
        if t > last:
            out.append(row)
            last = t
    return out, last


# --- tables as points ------------------------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.array("value").alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("a"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("value"), F.col("vec_id").alias("a"))


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three dimensions of lineitem. The key is not unique, so a row's place in the whole order makes the id."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    days = li.select(a.alias("a"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array(F.col("l_quantity").cast("double"), 100 * F.col("l_discount"), 100 * F.col("l_tax")).alias("value"))
    return numbered(days, "a", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("id", "value", "a")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Row numbers over (group, order), without one task that holds all rows: numbers within groups, after the rows of earlier groups."""
    from pyspark.sql import Window

    sizes = rows.groupBy(group).count()
    # as many rows as there are groups
    before = sizes.select(F.col(group), (F.sum("count").over(Window.orderBy(group)) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("own", own).join(before, group).withColumn("id", (F.col("before") + F.col("own")).cast("long")).drop("own", "before")


def order_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of an order, modulo 12, as a set."""
    li, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    sets = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set((F.col("l_suppkey") % 12).cast("double"))).alias("value"))
    return o.join(sets, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), "value", F.col("o_orderkey").alias("a"))


# --- generators ------------------------------------------------------------------------------------------------------

#: Fixed values: (base, width, weight) of the parts of a dimension's mixture; weights are normalised.
STK = [[(0, 50, 0.10), (50, 30, 0.15), (80, 20, 0.325), (100, 20, 0.325), (120, 80, 0.0995), (200, 9730, 0.0005)]]
TAO = [
    [(-10, 7, 0.0005), (-3, 2, 0.20), (-1, 2, 0.40), (1, 19, 0.20), (20, 20, 0.10), (40, 36, 0.0995)],
    [(-10, 70, 0.0005), (60, 15, 0.15), (75, 15, 0.60), (90, 9, 0.20), (99, 3, 0.4995)],
    [(-10, 32, 0.0005), (22, 3, 0.20), (25, 2, 0.25), (27, 2, 0.40), (29, 2, 0.1495)],
]
GENERATORS = {"stk": STK, "tao": TAO}


def mixture(parts: Sequence[tuple[float, float, float]], pick: Column, within: Column) -> Column:
    """A value of the mixture, two decimals: pick chooses the part, within the place in it."""
    total, upto, out = sum(w for *_, w in parts), 0.0, F.lit(None).cast("double")
    branches = []
    for base, width, weight in parts:
        upto += weight / total
        branches.append((upto, F.lit(float(base)) + within * width))
    for upto, value in reversed(branches):
        out = value if upto == branches[-1][0] else F.when(pick < upto, value).otherwise(out)
    return F.round(out, 2)


def _uniform(id_: Column, salt: int) -> Column:
    """In [0, 1), from the id and a salt, so that a row is the same on any cluster."""
    digits = F.substring(F.md5(F.concat(id_.cast("string"), F.lit(f"-{salt}"))), 1, 7)
    return F.conv(digits, 16, 10).cast("long") / float(1 << 28)


def generate(ids: DataFrame, kind: str, seed: int = 1, start: int = 0) -> DataFrame:
    """Points for a column id; one unit of time each."""
    dims = GENERATORS[kind]
    values = [mixture(parts, _uniform(F.col("id"), 1000 * seed + 2 * d), _uniform(F.col("id"), 1000 * seed + 2 * d + 1)) for d, parts in enumerate(dims)]
    return ids.select(F.col("id"), F.array(*values).alias("value"), (F.col("id") + start).alias("a"))


def generated(spark: SparkSession, kind: str, n: int, seed: int = 1) -> DataFrame:
    return generate(spark.range(n), kind, seed)


def stream_generated(spark: SparkSession, kind: str, per_second: int = 1000, seed: int = 1) -> DataFrame:
    """An endless stream, one point a millisecond by default."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return generate(rate.select(F.col("value").alias("id")), kind, seed)
