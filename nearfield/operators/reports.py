"""Shapes of results and their sinks: counts, id lists, time-series lines, cost lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nearfield.operators.windows import reportable

QUERY = ["window_end", "W", "S", "R", "k"]


def report_counts(partial: DataFrame) -> DataFrame:
    """Counts of the partitions (window_end, W, S, R, k, n_outliers), summed."""
    return partial.groupBy(*QUERY).agg(F.sum("n_outliers").alias("n_outliers"))


def count_lines(counts: DataFrame) -> DataFrame:
    """A text line a result: `window_end;W;S;R;k;count`."""
    return counts.select(F.concat_ws(";", *(F.col(c).cast("string") for c in [*QUERY, "n_outliers"])).alias("line"))


def report_ids(outliers: DataFrame) -> DataFrame:
    """Outliers with the list of their ids, in order, as text; as long as the answer is."""
    return outliers.groupBy(*QUERY).agg(F.count("*").alias("n_outliers"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("ids"))


def line_protocol(reports: DataFrame, measurement: str = "outliers") -> DataFrame:
    """Points of a time series as text: tags W, S, k, R; fields Outliers and, if there, IDs; the window's end as the time."""
    tags = F.concat(*(F.concat(F.lit(f",{t}="), F.col(t).cast("string")) for t in ("W", "S", "k", "R")))
    fields = F.concat(F.lit("Outliers="), F.col("n_outliers").cast("string"), F.lit("i"))
    if "ids" in reports.columns:
        fields = F.concat(fields, F.lit(',IDs="'), F.col("ids"), F.lit('"'))
    return reports.select(F.concat(F.lit(measurement), tags, F.lit(" "), fields, F.lit(" "), F.col("window_end").cast("string")).alias("line"))


def adaptation_lines(decisions: DataFrame) -> DataFrame:
    """(effective_at, over array, under array) as points of a time series; '-' for none."""
    text = lambda c: F.when(F.size(c) == 0, "-").otherwise(F.array_join(F.col(c).cast("array<string>"), ";"))
    return decisions.select(F.concat(F.lit('adaptations Overload="'), text("over"), F.lit('",Underload="'), text("under"), F.lit('" '), F.col("effective_at").cast("string")).alias("line"))


def partition_cost(members: DataFrame, S: int | None = None) -> DataFrame:
    """part, window_end, cost: the owners in each partition and window; while routings overlap, those that report. members: part, flag, window_end[, countdown]. S: also owners and replicas that the newest slide of that length has brought."""
    own = reportable(F.col("flag"), F.col("countdown"), F.col("window_end")) if "countdown" in members.columns else F.col("flag") == 0
    new = F.lit(False) if S is None else F.col("a") >= F.col("window_end") - S
    more = [] if S is None else [F.count_if(new & (F.col("flag") == 0)).alias("owners"), F.count_if(new & (F.col("flag") == 1)).alias("replicas")]
    return members.groupBy("part", "window_end").agg(F.count_if(own).alias("cost"), *more)


def cost_lines(costs: DataFrame) -> DataFrame:
    """window_end and `window_end;part;cost;part;cost...` by part: as long as there are partitions."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("part", "cost"))), lambda p: F.concat_ws(";", p["part"].cast("string"), p["cost"].cast("string")))
    return costs.groupBy("window_end").agg(pairs.alias("p")).select("window_end", F.concat_ws(";", F.col("window_end").cast("string"), F.array_join("p", ";")).alias("line"))


def parse_cost_lines(lines: DataFrame) -> DataFrame:
    """The inverse of cost_lines: window_end, part, cost."""
    parts = F.split("line", ";")
    entries = F.transform(F.sequence(F.lit(1), F.floor((F.size(parts) - 1) / 2).cast("int")), lambda i: F.struct(F.get(parts, 2 * i - 1).cast("int").alias("part"), F.get(parts, 2 * i).cast("double").alias("cost")))
    return lines.select(parts[0].cast("long").alias("window_end"), F.explode(entries).alias("e")).select("window_end", "e.part", "e.cost")


def latest(costs: DataFrame) -> DataFrame:
    """part, cost of the newest window: what a key-value store with one key would hold."""
    newest = costs.agg(F.max("window_end").alias("window_end"))
    return costs.join(F.broadcast(newest), "window_end").select("part", "cost")  # one row


def to_queue(lines: DataFrame, servers: str, topic: str, checkpoint: str | None = None):
    """Lines (one text column) to a message queue, in batch or, with a checkpoint folder, as a stream. Needs the connector's jar."""
    values = lines.select(F.col(lines.columns[0]).alias("value"))
    if checkpoint is None:
        return values.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    return values.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def to_console(lines: DataFrame):
    """A stream of lines to the console."""
    return lines.writeStream.format("console").option("truncate", False).start()


def keep_latest(stream: DataFrame, path: str, checkpoint: str):
    """A stream of costs, of which the newest window's are kept in a folder: each batch that has any replaces them."""

    def put(df: DataFrame, number: int) -> None:
        newest = latest(df)
        if newest.limit(1).count():
            newest.write.mode("overwrite").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
