"""Secret scans in DataFrame functions alone: exact patterns, and sliding-window entropy over candidate strings.

Patterns give the base spans. Candidates are runs of token characters of at least WINDOW. A window slides over a run
with the sum of c*log2(c) over the counts of its characters kept up to date: one character enters, one leaves, and only
their two counts change, so a step costs the same wherever it is. Runs are cut into pieces that overlap by a window, each
begun afresh, so time and memory are linear in a run of any length; sums are of integers, so a window's value does not
depend on how it was reached. The class of each window (hex, letters and digits, base64) sets its threshold. Windows
above it are merged to spans. Runs on the allow-list (identifiers of the UUID form, words, paths, numbers, placeholders)
are suppressed; so are spans that meet a base span.

Places are code points. A place comes from the lengths of the pieces between matches, so the text is scanned once for
the pieces and once for the matches, and only texts with a match are cut at all.

Defined cases: a null or empty text has no spans; repeated rows are judged each on its own; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns; the base spans are matches of these that are long enough.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Whole runs: at least 4+16 and 24 characters, which drops the same matches as a later test of their length.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
WINDOW = 20
#: Possessive and bounded by a look-behind, so that a long run is read once.
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
#: Bits a character: 20 random hex digits have about 3.4 on average, 20 random characters of base64 about 4.1. A window of digits and hex letters, both, is hex; one of digits and letters, both, alnum; one without letters a number, which is never high; any other is base64.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
#: A word of a path's part: one case or capitals within it, then few digits if any. Keys mix cases and digits otherwise. Possessive, so that long runs need no stack.
_WORD = r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})++|[A-Z]?[a-z]+|[A-Z]+)"
_PIECE = rf"(?:{_WORD}[0-9]{{0,4}}|[0-9]{{1,8}})"
_PART = rf"[_-]*{_PIECE}(?:[_-]+{_PIECE})*+[_-]*"
#: Allow-list: what looks like a candidate but is no secret.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^[A-Za-z]+$",  # a word
    r"^[0-9_=/+-]+$",  # numbers, rules
    rf"^/?[_-]*{_WORD}(?:[_-]+{_WORD})*+[_-]*(?:/{_PART})++/?$",  # a path
    r"^[A-Za-z]+(?:[_-][A-Za-z]+)*[_-]?[0-9]{0,4}$",  # a name in parts
    rf"^{_PART}$",  # the same with numbers between
    r"(?i)^(?=.{1,200}$).*(?:example|placeholder|xxxx|your[_-]?key|changeme)",  # in long random runs such a word stands by chance
)
#: Of the pieces in which runs are cut, of the parts in which sums run, and of one bit in whole numbers.
PIECE, PART, BIT = 64, 256, 1 << 20


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's argument is bound, not written out again."""
    return F.transform(F.array(value), body)[0]


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,text:string>>"


def running(values: Column, join=lambda a, b: a + b, start: int = 0) -> Column:
    """Sums (or another associative join) of an array of bigint up to each place. An array that grows is copied at each step, so parts are joined on their own and then moved by what stands before them."""
    none, zero = F.array().cast("array<bigint>"), F.lit(start).cast("long")

    def up(a: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return let(join(acc["at"], x), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))

        return F.aggregate(a, F.struct(zero.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def moved(parts: Column) -> Column:
        before = F.concat(F.array(zero), up(F.transform(parts, lambda p: F.element_at(p, -1))))
        return let(before, lambda z: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: join(F.get(z, i), x)))))

    def joined(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / PART).cast("int")), lambda i: up(F.slice(a, i * PART + 1, PART)))
        return F.when(F.size(a) <= PART, up(a)).otherwise(let(parts, moved))

    return let(values, lambda a: F.when(F.size(a) == 0, none).otherwise(joined(a)))


def located(text: Column, pattern: str, kind: str) -> Column:
    """Matches of a pattern as (kind, start, end, text)."""
    none = F.array().cast(_SPAN)
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)

    def places(m: Column, p: Column) -> Column:
        ends = running(F.zip_with(m, F.slice(p, 1, F.size(m)), lambda x, gap: F.length(x).cast("long") + F.length(gap)))
        return F.zip_with(m, ends, lambda x, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(x)).alias("start"), e.alias("end"), x.alias("text")))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(matches, lambda m: places(m, pieces))).otherwise(none)


def base_spans(text: Column) -> Column:
    """Those of the three patterns, by start, then kind as listed."""
    assign = F.filter(located(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN_VALUE, 1)) >= 6)
    return F.concat(assign, located(text, ACCESS, "access"), located(text, HEX, "hex"))


def _pieces(run: Column) -> Column:
    return F.regexp_extract_all(run, F.lit(f".{{1,{PIECE}}}"), F.lit(0))


def _limit(kinds: Column, window: int) -> Column:
    """By class, the highest sum of c*log2(c) of a window that is high. kinds: d, h, l, o for its digits, hex letters, other letters, others."""
    has = lambda x: F.instr(kinds, x) > 0
    limit = _limits(window)
    words = ~has("d") | has("o")
    return F.when(~has("h") & ~has("l"), F.lit(-1)).when(words, limit["base64"]).when(has("l"), limit["alnum"]).otherwise(limit["hex"])


def _limits(window: int) -> dict[str, int]:
    return {k: math.floor(BIT * window * (math.log2(window) - t)) for k, t in THRESHOLDS.items()}


_FROM = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/=_-"
_KINDS = "d" * 10 + "h" * 12 + "l" * 40 + "o" * 5


def high_windows(run: Column, threshold: Column | None = None, window: int = WINDOW) -> Column:
    """First positions (from 0) of the windows of a run whose entropy reaches the threshold; without one, that of their class."""
    bits = [0, 0, *(round(BIT * math.log2(c)) for c in range(2, window + 1))]
    each = F.array(*map(F.lit, bits))  # BIT * log2(c)
    all_ = F.array(*(F.lit(c * x) for c, x in enumerate(bits)))  # BIT * c * log2(c)
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    own = None if threshold is None else F.floor(BIT * window * (F.lit(math.log2(window)) - threshold)).cast("long")

    def of(piece: Column, at: Column) -> Column:
        """Of a piece with the next one's first characters."""
        kinds = F.translate(piece, _FROM, _KINDS)

        def slide(kinds: Column) -> Column:
            seen = lambda k: F.substring(piece, k + 1, F.lit(window))
            limits = _limits(window).values()

            def high(s: Column, k: Column) -> Column:
                """The class is looked up only where it matters; numbers never reach the lowest limit."""
                return s <= own if own is not None else (s <= min(limits)) | ((s <= max(limits)) & (s <= _limit(F.substring(kinds, k + 1, F.lit(window)), window)))

            first = F.aggregate(F.split(seen(F.lit(0)), "", -1), F.lit(0).cast("long"), lambda s, c: s + F.when(c == "", 0).otherwise(F.get(each, count(seen(F.lit(0)), c))))
            none = F.array().cast("array<bigint>")
            begin = let(first, lambda s: F.struct(s.alias("s"), F.when(high(s, F.lit(0)), F.array(at)).otherwise(none).alias("out")))

            def move(acc: Column, k: Column) -> Column:
                """The window that begins at k: character k-1 leaves, character k+window-1 enters."""
                leaves, enters = F.substring(piece, k, F.lit(1)), F.substring(piece, k + window, F.lit(1))
                a, b = count(seen(k - 1), leaves), count(F.substring(piece, k + 1, F.lit(window - 1)), enters)
                next_ = acc["s"] + let(a, lambda n: F.get(all_, n - 1) - F.get(all_, n)) + let(b, lambda n: F.get(all_, n + 1) - F.get(all_, n))
                return let(next_, lambda s: F.struct(s.alias("s"), F.when(high(s, k), F.concat(acc["out"], F.array(at + k))).otherwise(acc["out"]).alias("out")))

            last = F.length(piece) - window
            steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
            return F.when(last >= 0, F.aggregate(steps, begin, move, lambda acc: acc["out"])).otherwise(none)

        return let(kinds, slide)

    whole = lambda p, i: F.concat(p[i], F.coalesce(F.substring(F.get(p, i + 1), 1, window - 1), F.lit("")))
    return let(_pieces(run), lambda p: F.flatten(F.transform(F.transform(p, lambda _, i: F.struct(whole(p, i).alias("t"), (i.cast("long") * PIECE).alias("at"))), lambda x: of(x["t"], x["at"]))))


def entropy_spans(text: Column, window: int = WINDOW) -> Column:
    """Merged high-entropy windows of the candidate runs that the allow-list lets through."""
    runs = located(text, CANDIDATE, "entropy")
    suppressed = lambda s: F.regexp_like(s, F.lit("|".join(f"(?:{p})" for p in ALLOWED)))
    digits = lambda s: s.rlike("[0-9]")
    wanted = F.filter(runs, lambda r: digits(r["text"]) & ~suppressed(r["text"]))

    def of(r: Column) -> Column:
        # a start that follows another within the window belongs to the same span
        def spans(h: Column) -> Column:
            firsts = F.filter(h, lambda x, i: (i == 0) | (x - F.get(h, i - 1) > window))
            lasts = F.filter(h, lambda x, i: (i == F.size(h) - 1) | (F.get(h, i + 1) - x > window))
            return let(_pieces(r["text"]), lambda p: F.zip_with(firsts, lasts, lambda s, e: F.struct(r["kind"].alias("kind"), (r["start"] + s).alias("start"), (r["start"] + e + window).alias("end"), part(p, s, e + window).alias("text"))))

        return let(high_windows(r["text"], window=window), spans)

    def part(p: Column, s: Column, e: Column) -> Column:
        """Characters s to e of a run, from the pieces that hold them."""
        first, last = F.floor(s / PIECE).cast("int"), F.floor((e - 1) / PIECE).cast("int")
        return F.substring(F.concat_ws("", F.slice(p, first + 1, last - first + 1)), (s - first * PIECE + 1).cast("int"), (e - s).cast("int"))

    return F.flatten(F.transform(wanted, of))


def ordered(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))


def apart(base: Column, more: Column) -> Column:
    """The spans of more that meet none of base, by start: with all spans in order, the furthest end before a span and the next start after it tell."""
    far = (1 << 62) - 1
    mark = lambda c, own: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), s.alias("span")))

    def judged(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda x: F.when(x["own"], x["end"]).otherwise(F.lit(-1).cast("long"))), F.greatest, -1)
        nexts = F.reverse(running(F.reverse(F.transform(all_, lambda x: F.when(x["own"], x["start"]).otherwise(F.lit(far)))), F.least, far))
        met = let(ends, lambda e: let(nexts, lambda n: F.transform(all_, lambda x, i: F.struct((x["own"] | (F.get(e, i) > x["start"]) | (F.get(n, i) < x["end"])).alias("met"), x["span"].alias("span")))))
        return F.transform(F.filter(met, lambda x: ~x["met"]), lambda x: x["span"])

    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(let(F.sort_array(F.concat(mark(base, True), mark(more, False))), judged))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end, text)."""
    own = F.coalesce(F.col(text), F.lit(""))
    found = docs.select("doc_id", base_spans(own).alias("base"), entropy_spans(own).alias("more"))
    return found.select("doc_id", ordered(F.col("base")).alias("base"), ordered(F.concat("base", apart(F.col("base"), F.col("more")))).alias("spans"))
