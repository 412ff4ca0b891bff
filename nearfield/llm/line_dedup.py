"""Line dedup by distinct-site spread, in DataFrame functions alone.

A line is boilerplate if it stands on at least MIN_SITES sites. Each line's hash gets a HyperLogLog sketch of the sites
it is seen on; sketches merge by aggregation, before the shuffle and after, so a line that stands everywhere costs a row a
task. Estimates far from the limit decide alone; lines whose estimate is within NEAR of it (the sketch's error, five
times over) get an exact count of distinct sites, from their own rows only. Of a boilerplate line the first occurrence
stays, by the smallest document id, then the first place in it, so that a text that was copied from site to site is
kept once; all others go.

Defined cases: a null text has no lines and stays null; a null source is a site of its own; lines without a word are
never boilerplate and stay; spaces at a line's ends do not tell lines apart; an emptied document stays, with the empty
text; repeated rows with the same id and text are one document to the rule of the first occurrence, and are cut alike;
rows without an id are cut as others are, but never hold the first occurrence if any row with an id has the line; extra
columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nearfield.llm.common import aside, stored

MIN_SITES = 3
#: Precision of sketches (2**LG_K places) and the relative width of the band that is counted exactly.
LG_K = 8
NEAR = 5 * 1.04 / 2 ** (LG_K / 2)
#: Rows of hashes and places that are broadcast, some 100 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Names of columns that stand beside those of documents on the way.
INNER = ("__k1", "__k2", "__places")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _site(site: str) -> Column:
    return F.concat(F.lit("s"), F.coalesce(F.col(site).cast("string"), F.lit("")), F.when(F.col(site).isNull(), "0").otherwise("1"))


def _key() -> tuple[Column, ...]:
    """Of a document's row: two hashes, so that equal rows share a key and others do not."""
    return F.xxhash64("doc_id", "text").alias("__k1"), F.hash("text", "doc_id").alias("__k2")


def line_rows(docs: DataFrame, site: str = "source") -> DataFrame:
    """A row for each line with a word: its 128-bit hash in two halves, site, document and place."""
    hashes = F.transform(lines(F.col("text")), lambda x: F.when(F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")), F.trim(x)))
    rows = docs.where("text is not null").select("doc_id", *_key(), _site(site).alias("site"), F.posexplode(hashes).alias("place", "line"))
    return rows.where("line is not null").select("doc_id", "__k1", "__k2", "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def small(df: DataFrame) -> DataFrame:
    """A stored DataFrame, marked for broadcast if its rows are counted as few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, first: the lines on at least min_sites sites, and where each is met first. rows: of line_rows, stored."""
    # lines on fewer rows than sites are asked for, or with one site alone, need no sketch
    tally = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.xxhash64("site")).alias("a"), F.max(F.xxhash64("site")).alias("z"))
    several = small(stored(tally.where((F.col("n") >= min_sites) & ((F.col("a") != F.col("z")) | F.lit(min_sites <= 1))).select("h1", "h2"), "several"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "__k1", "__k2", "place")).alias("first")  # without an id last
    spread = rows.join(several, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), first)
    low, high = min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1
    guess = spread.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low)
    found = stored(guess.withColumn("near", F.col("sites") <= high), "sketched")
    near = small(stored(found.where("near").select("h1", "h2"), "near"))
    exact = rows.select("h1", "h2", "site").join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_sites).select("h1", "h2")
    return found.where("not near").select("h1", "h2", "first").unionByName(found.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first"))


def cuts(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """__k1, __k2, __places: the lines that each document loses."""
    rows = stored(line_rows(docs, site), "rows")
    gone = small(stored(boilerplate(rows, min_sites), "boilerplate"))
    own = (F.col("__k1") == F.col("first.__k1")) & (F.col("__k2") == F.col("first.__k2")) & (F.col("place") == F.col("first.place"))
    return rows.join(gone, ["h1", "h2"]).where(~own).groupBy("__k1", "__k2").agg(F.collect_set("place").alias("__places"))


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with the lines cut, and __lines, __cut: how many lines there were and went (columns named so are replaced)."""
    docs, own = aside(docs.drop("__lines", "__cut"), INNER)
    lost = small(stored(cuts(docs, site, min_sites), "cuts"))
    keyed = docs.select("*", *_key()).join(lost, ["__k1", "__k2"], "left").drop("__k1", "__k2")
    n = F.size(lines(F.col("text")))
    places = F.array_except(F.sequence(F.lit(0), n - 1), "__places")
    kept = F.transform(F.array(lines(F.col("text"))), lambda own: F.array_join(F.transform(places, lambda i: F.get(own, i)), "\n"))[0]
    some = F.col("__places").isNotNull()
    out = keyed.withColumn("__lines", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long")).withColumn("__cut", F.coalesce(F.size("__places"), F.lit(0)).cast("long"))
    out = out.withColumn("text", F.when(some, kept).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*own, "__lines", "__cut")
