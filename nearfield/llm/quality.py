"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Fixed base rules reject outright. Beside them stand measured rules: a feature (share of symbols, of repeated lines, ...)
beyond a cutoff rejects. Cutoffs are chosen by stratum (the language) on labelled documents, of which half, by a hash of
the id, makes proposals and the other half is the holdout that judges them. A proposal is a set of cutoffs, one for each
rule: the strictest of a fixed grid that rejects some bad documents and of the good ones no more than a share; the
shares of LEVELS, in turn, make proposals from lax to strict. Of n good documents of the holdout, x are rejected by any
rule of a proposal: the exact binomial tail P(X <= x | n, alpha) must not exceed delta divided by the number of strata
(Bonferroni). Within a stratum the proposals are tested from lax to strict until one fails, which needs no further
correction (fixed-sequence testing). So with probability 1 - delta, in every stratum, all rules together falsely reject
at most alpha of the good documents that the base lets through. The last proposal that passes is used; with none, the
stratum has no measured rules.

Defined cases: a null or empty text has no words and fails the base; a null language is a stratum of its own; a stratum
with too few good labels has no measured rules; without labels only the base rules hold; labelled ids that occur twice
count as often as their rows; repeated rows are judged each on its own; extra columns are ignored by `measured`, except
that those named like its outputs are replaced, and kept by `keep_good`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from nearfield.llm.common import aside, stored

MIN_WORDS, MAX_REPEAT, REPEAT_WINDOW = 20, 30, 8
#: Highest false rejection of all measured rules together in a stratum, and the chance of exceeding it anywhere.
ALPHA, DELTA = 0.02, 0.05
#: False rejection by each rule that a proposal allows on its own half of the labels.
LEVELS = (0.0, 0.0005, 0.001, 0.002)
#: Rules: a feature is rejected from its cutoff upwards. Grids from lax to strict.
GRIDS = {
    "symbol_share": [0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02],
    "dup_line_share": [0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2],
    "repeat_share": [0.25, 0.2, 0.15, 0.1, 0.07],
    "long_words": [40.0, 30.0, 20.0, 15.0, 12.0],
    "short_words": [0.6, 0.5, 0.45, 0.4],
    "bar_share": [0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05],
    "digit_share": [0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
}
#: Strata whose cutoffs are broadcast; more are joined by a shuffle.
BROADCAST_STRATA = 50_000
_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column) -> Column:
    """A hash of each window of REPEAT_WINDOW words."""
    w = REPEAT_WINDOW
    return F.when(F.size(words) < w, F.array().cast("array<bigint>")).otherwise(
        let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - w), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(w)))))
    )


def _covered(windows: Column) -> Column:
    """Words that lie in windows found twice or more. Equal windows stand side by side once sorted; the places that have an equal neighbour, sorted again, cover REPEAT_WINDOW words each, less what the next one covers too."""
    w = REPEAT_WINDOW

    def repeated(s: Column) -> Column:
        twin = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(w), F.coalesce(F.get(p, i + 1) - x, F.lit(w))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(let(placed, repeated), total))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column `__quality` of counts and shares. Only the text is read."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, _SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(_windows(w), _covered).alias("n_repeat_words"),
            F.greatest(F.size(lines), F.lit(1)).alias("n_lines"),
            F.size(F.filter(w, lambda x: F.length(x) <= 2)).alias("n_short"),
            F.length(F.regexp_replace(t, r"[^|]+", "")).alias("n_bars"),
            F.length(F.regexp_replace(t, r"[^0-9]+", "")).alias("n_digits"),
        )

    n, chars = F.greatest(F.col("__quality.n_words"), F.lit(1)), F.greatest(F.col("__quality.word_chars"), F.lit(1))
    q = lambda c: F.col(f"__quality.{c}")
    shares = {
        "symbol_share": q("n_symbols") / chars,
        "dup_line_share": q("n_dup_lines") / q("n_lines"),
        "repeat_share": q("n_repeat_words") / n,
        "long_words": chars / n,
        "short_words": q("n_short") / n,
        "bar_share": q("n_bars") / n,
        "digit_share": q("n_digits") / chars,
    }
    failed = (q("n_words") < MIN_WORDS) | (100 * q("n_repeat_words") > MAX_REPEAT * q("n_words"))
    # a generator of one row: the optimiser neither copies the counts into each use nor moves a filter on them below
    counted = docs.select("*", F.explode(F.array(let(words, of))).alias("__quality"))
    return counted.withColumn("__quality", F.col("__quality").withField("base_failed", failed).withField("shares", F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), v.cast("double"))))))


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(X <= x) of n trials of chance p, summed exactly from its terms' logarithms; from the mean upwards, where it is about a half or more, simply 1."""
    odds, first = math.log(p / (1 - p)), n * math.log1p(-p)

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double") / i) + odds
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    start = F.struct(first.alias("term"), F.exp(first).alias("total"))
    terms = F.when(x >= 1, F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<bigint>"))
    return F.when(x >= n * p, F.lit(1.0)).otherwise(F.aggregate(terms, start, step, lambda acc: acc["total"]))


def labelled(counted: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """stratum, quality, shares, holdout of the labelled documents that pass the base (its own verdict is not the measured rules' doing). counted: of features. Labels grow with the documents: both are shuffled, but not the texts."""
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passed = counted.where("doc_id is not null and not __quality.base_failed").select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), F.col("__quality.shares").alias("shares")).join(picked, "doc_id")
    return passed.select("stratum", "quality", "shares", F.substring(F.md5(F.col("doc_id").cast("string")), 32, 1).isin(*"13579bdf").alias("holdout"))


def _by_stratum(df: DataFrame, strata: DataFrame) -> DataFrame:
    """strata: stored, a row each; many are joined by a shuffle."""
    return df.join(F.broadcast(strata) if strata.count() <= BROADCAST_STRATA else strata, "stratum")


def _beyond(shares: Column, cuts: Column) -> Column:
    """Whether any share reaches its cutoff. cuts: of rule and cutoff."""
    return F.exists(cuts, lambda e: F.element_at(shares, e["rule"]) >= e["cutoff"])


def proposals_that_pass(counted: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cuts (of rule and cutoff): the strictest proposal that passes in each stratum, on all labelled documents."""
    known = stored(labelled(counted, labels, stratum), "labelled")
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    grid = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff")) for rule, cuts in GRIDS.items() for c in cuts))
    tested = known.where("not holdout").select("stratum", "quality", "shares", F.explode(grid).alias("g"))
    over = F.element_at("shares", F.col("g.rule")) >= F.col("g.cutoff")
    counts = tested.groupBy("stratum", "g.rule", "g.cutoff").agg(F.count_if(good).alias("n"), F.count_if(good & over).alias("x"), F.count_if(bad & over).alias("bad"))
    level = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.lit(share).alias("share")) for i, share in enumerate(LEVELS)))).alias("l")
    able = counts.where("bad > 0").select("*", level).where(F.col("x") <= F.col("l.share") * F.col("n"))
    strictest = able.groupBy("stratum", "l.level", "rule").agg(F.min("cutoff").alias("cutoff")).groupBy("stratum", "level").agg(F.sort_array(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    proposals = stored(strictest.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("level", "cuts"))).alias("proposals")), "proposals")
    tests = max(1, known.where("holdout").select("stratum").distinct().count())
    tried = _by_stratum(known.where("holdout"), proposals).select("stratum", "quality", "shares", F.explode("proposals").alias("p"))
    judged = tried.select("stratum", "quality", F.col("p.level").alias("level"), _beyond(F.col("shares"), F.col("p.cuts")).alias("out"))
    tallies = judged.groupBy("stratum", "level").agg(F.count_if(good).alias("n"), F.count_if(good & F.col("out")).alias("x"))
    verdicts = tallies.withColumn("safe", binomial_tail(F.col("x"), F.col("n"), alpha) <= delta / tests)
    fails = F.coalesce(F.min(F.when(~F.col("safe"), F.col("level"))), F.lit(len(LEVELS)))
    last = verdicts.groupBy("stratum").agg(fails.alias("fails"), F.collect_list("level").alias("levels")).select("stratum", F.array_max(F.filter("levels", lambda x: x < F.col("fails"))).alias("level"))
    chosen = last.where("level is not null").join(proposals, "stratum")
    return chosen.select("stratum", F.filter("proposals", lambda p: p["level"] == F.col("level"))[0]["cuts"].alias("cuts"))


def cutoffs(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: those in use."""
    return proposals_that_pass(features(docs), labels, stratum, alpha, delta).select("stratum", F.explode("cuts").alias("c")).select("stratum", "c.rule", "c.cutoff")


def measured(docs: DataFrame, labels: DataFrame, stratum: str = "lang", with_text: bool = True) -> DataFrame:
    """docs with the struct column `__quality` (counts, base_failed) and the boolean column `__kept`. The features of a text are computed once and stored, with_text or without, for the cutoffs and the verdicts."""
    counted = features(docs.drop("__quality", "__kept", "__cuts", "__stratum"))
    counted = stored(counted if with_text else counted.drop("text"), "features")
    chosen = stored(proposals_that_pass(counted, labels, stratum).select(F.col("stratum").alias("__stratum"), F.col("cuts").alias("__cuts")), "cutoffs")
    few = chosen.count() <= BROADCAST_STRATA
    judged = counted.join(F.broadcast(chosen) if few else chosen, F.coalesce(F.col(stratum), F.lit("")) == F.col("__stratum"), "left")
    kept = ~F.col("__quality.base_failed") & ~F.coalesce(_beyond(F.col("__quality.shares"), F.col("__cuts")), F.lit(False))
    return judged.withColumn("__kept", kept).drop("__cuts", "__stratum")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    renamed, own = aside(docs, ("__quality", "__kept", "__cuts", "__stratum"))
    return measured(renamed, labels).where("__kept").select(*own)
