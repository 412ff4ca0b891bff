"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of rows of one table, at the hashes of the word, of its first four and five letters and
of its last four, so that unseen compounds share what their parts have taught. Filters one, two and three words wide run
over the whole text; the maximum of each over the text goes into a logistic layer. Training by Adam begins on the driver,
on a bounded number of labelled rows (PER_LABEL of either label, LEARN_WORDS words in all, the first by a hash of their
ids). Where these are not all, the rest is learnt from too: rows are dealt by a hash of their ids to learners of about
LEARNER_ROWS, each goes on from the first weights over its whole texts, and what they change is averaged. A quarter of the
rows is kept from the weights; a temperature and bias, then a threshold for each language, are chosen on all of it.
Languages, sources and ids are never inputs of a score.

Defined cases: a null or empty text is scored as one of padding alone; a language without rows of both labels has the
general threshold; with no labelled rows of both labels at all every score is 0; repeated rows are scored each on
its own; extra columns are ignored.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearfield.llm.common import released, stored

#: Labelled rows learnt from, of either label, and words of these together: the bounds of what reaches the driver, at 16 bytes a word.
PER_LABEL, LEARN_WORDS = 1500, 6_000_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 14, 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, SEED = 8, 16, 0.01, 5
#: Rows of a learner, about; the rate it begins with; parts that its changes are summed in; steps of a logit that calibration tells apart, up to MOST.
LEARNER_ROWS, LATER_RATE, PARTS, STEPS, MOST = 3000, 0.005, 16, 200, 50
THRESHOLD = 0.7
#: Words of a learning text are shown in slices of this many, or of more if EPOCHS slices would not cover it: all of them in turn.
SLICE = 4000
_WORD = re.compile(r"[^\W\d_]+")
_GAP = max(WIDTHS) - 1


def hashes(word: str) -> tuple[int, int, int, int]:
    """Rows of the table; row 0 is padding."""
    h = lambda s: 1 + zlib.crc32(s.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
    return h("w" + word), h("4" + word[:4]), h("5" + word[:5]), h("e" + word[-4:])


class _Ids(dict):
    """Word to its number in a table of hashes that grows as words are met."""

    def __init__(self) -> None:
        super().__init__()
        self.rows = [(0, 0, 0, 0)]

    def __missing__(self, word: str) -> int:
        self.rows.append(hashes(word))
        self[word] = n = len(self.rows) - 1
        return n


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Classifier:
    table: np.ndarray  # [buckets, dim]
    filters: dict[int, np.ndarray]  # width: [width, dim, filters]
    bias: dict[int, np.ndarray]
    weights: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    usable: bool = True

    @classmethod
    def new(cls, seed: int = SEED) -> Classifier:
        g = np.random.default_rng(seed)
        f = lambda *s: g.standard_normal(s).astype(np.float32)
        table = f(BUCKETS, DIM) * 0.1
        table[0] = 0
        return cls(table, {w: f(w, DIM, FILTERS) / np.float32(np.sqrt(w * DIM)) for w in WIDTHS}, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, f(len(WIDTHS) * FILTERS) * 0.1, 0.0)

    def pooled(self, numbers: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Maxima of all filters for texts laid end to end with padding (number 0) between them."""
        parts = []
        flat = {(w, k): None for w in WIDTHS for k in range(w)}
        own = self.table[rows].sum(1)
        for w, k in flat:
            flat[w, k] = own @ self.filters[w][k]
        for w in WIDTHS:
            n = len(numbers) - w + 1
            act = flat[w, 0][numbers[:n]]
            for k in range(1, w):
                act += flat[w, k][numbers[k : n + k]]
            parts.append(np.maximum(np.maximum.reduceat(act, starts) + self.bias[w], 0))
        return np.concatenate(parts, 1)

    def scores(self, texts: list[str | None], ids: _Ids) -> np.ndarray:
        if not self.usable:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-(self.scale * self.logits(texts, ids).astype(float) + self.shift)))

    def logits(self, texts: list[str | None], ids: _Ids) -> np.ndarray:
        numbers, starts = _laid_out([[*map(ids.__getitem__, words(t))] for t in texts])
        used, numbers = np.unique(numbers, return_inverse=True)
        return self.pooled(numbers, starts, np.array(ids.rows, np.int32)[used]) @ self.weights + self.offset


def _laid_out(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """One array, with padding before, between and after texts: wide enough that no filter meets two texts."""
    gap, out, starts = [0] * _GAP, [], []
    for t in texts:
        starts.append(len(out))
        out += gap + t + gap
    out += gap
    return np.array(out, np.int64), np.array(starts, np.int64)


class _Steps:
    """Steps of Adam on a model; rows of the table in use are moved by their gradient's direction."""

    def __init__(self, model: Classifier) -> None:
        self.model, self.done = model, 0
        self.moments = {n: [0.0, 0.0] for n in [*(("filters", w) for w in WIDTHS), *(("bias", w) for w in WIDTHS), "weights", "offset"]}

    def take(self, texts: list[np.ndarray], toxic: np.ndarray, balance: np.ndarray, pace: float) -> np.ndarray:
        """The rows of the table that it has moved."""
        model = self.model
        self.done += 1
        grads, used, table_grad = _gradient(model, texts, toxic, balance)
        for name, grad in grads.items():
            m = self.moments[name]
            m[0], m[1] = 0.9 * m[0] + 0.1 * grad, 0.99 * m[1] + 0.01 * grad * grad
            change = pace * (m[0] / (1 - 0.9**self.done)) / (np.sqrt(m[1] / (1 - 0.99**self.done)) + 1e-8)
            if name in ("weights", "offset"):
                setattr(model, name, getattr(model, name) - change)
            else:
                getattr(model, name[0])[name[1]] = (getattr(model, name[0])[name[1]] - change).astype(np.float32)
        size = np.sqrt((table_grad**2).sum(1, keepdims=True)) + 1e-8
        model.table[used] -= (4 * pace * table_grad / np.maximum(size, size.mean())).astype(np.float32)
        return used


def fit(texts: list[np.ndarray], toxic: np.ndarray, langs: list[str | None], seed: int = SEED) -> Classifier:
    """texts: hashes [words, 4] of each. A quarter is kept for the calibration."""
    model = Classifier.new(seed)
    if len(set(toxic.tolist())) < 2:
        model.usable = False
        return model
    g = np.random.default_rng(seed)
    deal = g.permutation(len(texts))
    held, learn = deal[::4], np.setdiff1d(deal, deal[::4])
    if len(set(toxic[held].tolist())) < 2 or len(set(toxic[learn].tolist())) < 2:
        held = learn = deal
    balance = np.where(toxic == 1, 0.5 / max(1e-9, (toxic[learn] == 1).mean()), 0.5 / max(1e-9, (toxic[learn] == 0).mean())).astype(np.float32)
    steps, total = _Steps(model), EPOCHS * -(-len(learn) // BATCH)
    for epoch in range(EPOCHS):
        order = g.permutation(learn)
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            steps.take([_slice(texts[k], epoch) for k in pick], toxic[pick], balance[pick], RATE * (1 - (steps.done + 1) / (total + 1)))
    model.weights, model.offset = model.weights.astype(np.float32), float(model.offset)
    _calibrate(model, [texts[k] for k in held], toxic[held], [langs[k] for k in held])
    return model


def _slice(text: np.ndarray, epoch: int) -> np.ndarray:
    size = max(SLICE, -(-len(text) // EPOCHS))
    parts = max(1, -(-len(text) // size))
    return text[epoch % parts * size :][:size]


def _numbered(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of hashes, each once, and texts of their numbers laid end to end."""
    rows, numbers = np.unique(np.concatenate([np.zeros((1, 4), np.int32), *texts]), axis=0, return_inverse=True)
    numbers = numbers.ravel()
    laid, at = [], 1
    for t in texts:
        laid.append(numbers[at : at + len(t)].tolist())
        at += len(t)
    return rows, *_laid_out(laid)


def _gradient(model: Classifier, texts: list[np.ndarray], toxic: np.ndarray, balance: np.ndarray):
    """Of the balanced logistic loss: of the layers, and of the rows of the table in use."""
    rows, numbers, starts = _numbered(texts)
    own = model.table[rows].sum(1)
    ends = [*starts[1:], len(numbers)]
    pooled, where = [], {}
    for w in WIDTHS:
        n = len(numbers) - w + 1
        act = sum(own[numbers[k : n + k]] @ model.filters[w][k] for k in range(w))
        best = np.stack([s + act[s : min(e, n)].argmax(0) for s, e in zip(starts, ends, strict=True)])
        where[w] = best
        pooled.append(act[best, np.arange(FILTERS)] + model.bias[w])
    raw = np.concatenate(pooled, 1)
    h = np.maximum(raw, 0)
    p = 1 / (1 + np.exp(-(h @ model.weights + model.offset)))
    dz = ((p - toxic) * balance / len(texts)).astype(np.float32)
    grads = {"weights": h.T @ dz + 1e-4 * model.weights, "offset": dz.sum()}
    dh = dz[:, None] * model.weights * (raw > 0)
    d_own = np.zeros_like(own)
    for i, w in enumerate(WIDTHS):
        d = dh[:, i * FILTERS : (i + 1) * FILTERS]
        grads["bias", w] = d.sum(0)
        grad = np.zeros_like(model.filters[w])
        for k in range(w):
            at = numbers[where[w] + k]  # [texts, filters]
            grad[k] = np.einsum("tfd,tf->df", own[at], d)
            np.add.at(d_own, at, d[:, :, None] * model.filters[w][k].T[None])
        grads["filters", w] = grad
    d_own[0] = 0
    touched = np.flatnonzero(np.abs(d_own).sum(1))
    used, back = np.unique(rows[touched].ravel(), return_inverse=True)
    table_grad = np.zeros((len(used), DIM), np.float32)
    np.add.at(table_grad, back, np.repeat(d_own[touched], 4, 0))
    return grads, used, table_grad


def _calibrate(model: Classifier, texts: list[np.ndarray], toxic: np.ndarray, langs: list[str | None]) -> None:
    """Scale and shift by logistic regression, so that 0.7 means what it says; then thresholds by language."""
    z = np.empty(len(texts))
    for at in range(0, len(texts), 200):
        rows, numbers, starts = _numbered(texts[at : at + 200])
        z[at : at + 200] = model.pooled(numbers, starts, rows) @ model.weights + model.offset
    _settle(model, z, toxic, langs, np.ones(len(z)))


def _settle(model: Classifier, z: np.ndarray, toxic: np.ndarray, langs: list[str | None], times: np.ndarray) -> None:
    """times: how many rows each of them stands for."""
    n1 = max(1, int((times * toxic).sum()))
    goal = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (times.sum() - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = times * (p * (1 - p) + 1e-9)
        grad = np.array([(times * (p - goal) * z).sum() + 1e-3 * a, (times * (p - goal)).sum()])
        hess = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum()]])
        move = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    model.scale, model.shift = (float(a), float(b)) if a > 0 else (1.0, 0.0)
    p = 1 / (1 + np.exp(-(model.scale * z + model.shift)))
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        by = np.argsort(p[own])
        y, s, t = toxic[own][by], p[own][by], times[own][by]
        if 0 < (t * y).sum() < t.sum():
            cuts = np.unique(np.r_[s, THRESHOLD])
            above = lambda w: np.append(np.cumsum(w[::-1])[::-1], 0)[np.searchsorted(s, cuts, "left")]
            f1 = 2 * above(t * y) / np.maximum(1, above(t) + (t * y).sum())
            best = [c for c, f in zip(cuts, f1, strict=True) if f >= max(f1) - 1e-12]
            model.thresholds[lang] = float(min(best, key=lambda c: abs(c - THRESHOLD)))


def learning_rows(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, toxic, turn, lang, hashes of the words: of per_label labelled documents of either label at most, the first by a hash of their ids, none of them held out."""
    own = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out("doc_id"))
    pick = [own.where(F.col("toxic") == t).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(per_label) for t in (0, 1)]
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id")  # per_label rows of three numbers at most, twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for b in batches:
            out = [np.array([ids.rows[ids[w]] for w in words(t)], np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("turn"), b.column("lang"), pa.array(out, pa.binary())], names=["doc_id", "toxic", "turn", "lang", "words"])

    return rows.mapInArrow(released(run), "doc_id long, toxic int, turn long, lang string, words binary")


def held_out(doc_id: str):
    """The rows no label is learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, words_in_all: int = LEARN_WORDS, learner_rows: int = LEARNER_ROWS) -> Classifier:
    """From all labelled rows that are not held out. On the driver, of a bounded number of rows and words: the labels take turns, by the hash of their ids, and a text that would pass the bound is left to the learners, as are all other rows."""
    rows = stored(learning_rows(docs, labels, per_label), "learning")
    sizes = sorted(rows.select("turn", "toxic", "doc_id", (F.octet_length("words") / 16).cast("long").alias("n")).collect())  # per_label rows, twice
    left, ids = words_in_all, set()
    for _, _, doc_id, n in sizes:
        if n <= left:
            ids.add(doc_id)
            left -= n
    taken = docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "doc_id long")
    got = sorted(rows.join(F.broadcast(taken), "doc_id", "left_semi").toLocalIterator(), key=lambda r: (r["doc_id"], r["toxic"], r["words"]))
    model = fit([np.frombuffer(r["words"], np.int32).reshape(-1, 4) for r in got], np.array([r["toxic"] for r in got], int), [r["lang"] for r in got])
    tally = dict(_labelled(labels).groupBy("toxic").count().collect())  # two rows
    if model.usable and (max(tally.values()) > per_label or len(got) < len(sizes)):
        _learn_on(model, docs, labels, taken, tally, learner_rows)
    return model


def _labelled(labels: DataFrame) -> DataFrame:
    """doc_id, toxic, of every label that may be learnt from, each once."""
    own = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    return own.where(~held_out("doc_id")).distinct()


def _learn_on(model: Classifier, docs: DataFrame, labels: DataFrame, taken: DataFrame, tally: dict[int, int], learner_rows: int) -> None:
    """Goes on from the model over all labelled rows: a quarter of those it has not seen calibrates, all others are learnt from."""
    spark, n = docs.sparkSession, sum(tally.values())
    seen = F.broadcast(taken.select("doc_id", F.lit(True).alias("seen")))  # the ids of the first rows
    calibrates = (F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(4)) == 0) & F.col("seen").isNull()
    learner = F.pmod(F.xxhash64(F.lit("learner"), "doc_id"), F.lit(-(-n // learner_rows)))
    texts = docs.select("doc_id", "text", "lang").where(~held_out("doc_id")).join(_labelled(labels).hint("merge"), "doc_id").join(seen, "doc_id", "left")
    rows = stored(texts.select("doc_id", "toxic", "lang", "text", F.when(~calibrates, learner).alias("learner")), "labelled")
    first, balance = spark.sparkContext.broadcast(model), np.array([0.5 * n / max(1, tally.get(t, 0)) for t in (0, 1)], np.float32)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, held = None, _Ids(), []

        def step() -> None:
            texts, toxic = [np.array([ids.rows[ids[w]] for w in words(t)], np.int32).reshape(-1, 4) for t, _ in held], np.array([y for _, y in held], int)
            moved[steps.take(texts, toxic, balance[toxic], LATER_RATE * max(0.1, 1 - steps.done * BATCH / learner_rows))] = True
            held.clear()

        def changes() -> pa.RecordBatch:
            if held:
                step()
            total = (_packed(steps.model, moved) - _packed(first.value, np.zeros(BUCKETS, bool))) * size
            parts = [x.astype(np.float32).tobytes() for x in np.array_split(total, PARTS)]
            return pa.RecordBatch.from_arrays([pa.array([own] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int32()), pa.array([size] * PARTS, pa.int64()), pa.array(parts, pa.binary())], names=["learner", "part", "size", "total"])

        for b in batches:
            for who, y, text in zip(*(b.column(c) for c in ("learner", "toxic", "text")), strict=True):
                if who.as_py() != own:
                    if own is not None:
                        yield changes()
                    own, size, steps, moved = who.as_py(), 0, _Steps(copy.deepcopy(first.value)), np.zeros(BUCKETS, bool)
                if len(ids) > 300_000 and not held:
                    ids = _Ids()
                held.append((text.as_py(), y.as_py()))
                size += 1
                if len(held) == BATCH:
                    step()
        if own is not None:
            yield changes()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for part, size, total in zip(*(b.column(c).to_pylist() for c in ("part", "size", "total")), strict=True):
                own = sums.setdefault(part, [0, 0.0])
                own[0], own[1] = own[0] + size, own[1] + np.frombuffer(total, np.float32).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].tobytes() for x in sums.values()], pa.binary())], names=["part", "size", "total"])

    # a learner's rows in one order, so that it learns the same again; the learners' changes are summed in order too
    dealt = rows.where("learner is not null").repartition("learner").sortWithinPartitions("learner", F.xxhash64("doc_id"), "doc_id", "toxic", "text")
    changed = dealt.select("learner", "toxic", "text").mapInArrow(released(learn), "learner long, part int, size long, total binary")
    summed = stored(changed, "changes").repartition(PARTS, "part").sortWithinPartitions("part", "learner").mapInArrow(add, "part int, size long, total binary")
    parts = sorted(summed.collect())  # PARTS rows, the size of a model
    _change(model, np.concatenate([np.frombuffer(r["total"]) for r in parts]), parts[0]["size"])
    settled = spark.sparkContext.broadcast(model)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            for b in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                if len(ids) > 300_000:
                    ids = _Ids()
                z = settled.value.logits(b.column("text").to_pylist(), ids)
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), pa.array(np.rint(np.clip(z, -MOST, MOST) * STEPS).astype(np.int64))], names=["lang", "toxic", "z"])

    kept = rows.where("learner is null").select("lang", "toxic", "text").mapInArrow(released(logits), "lang string, toxic int, z long")
    got = kept.groupBy("lang", "toxic", "z").count().orderBy("lang", "toxic", "z").collect()  # 2 * STEPS * MOST values of z of a language and label at most
    if len({r["toxic"] for r in got}) == 2:
        model.thresholds = {}
        _settle(model, np.array([r["z"] / STEPS for r in got]), np.array([r["toxic"] for r in got]), [r["lang"] for r in got], np.array([r["count"] for r in got], float))


def _layers(model: Classifier) -> np.ndarray:
    return np.concatenate([np.ravel(x) for x in (*(model.filters[w] for w in WIDTHS), *(model.bias[w] for w in WIDTHS), model.weights, model.offset)]).astype(float)


def _packed(model: Classifier, moved: np.ndarray) -> np.ndarray:
    return np.concatenate([model.table.ravel().astype(float), moved.astype(float), _layers(model)])


def _change(model: Classifier, total: np.ndarray, size: int) -> None:
    """Adds the mean of what the learners have changed, weighted by their rows; of a row of the table, the mean of those that have moved it."""
    cells = BUCKETS * DIM
    table, moved, layers = total[:cells].reshape(BUCKETS, DIM), total[cells : cells + BUCKETS], _layers(model) + total[cells + BUCKETS :] / size
    model.table = (model.table + table / np.maximum(1, moved)[:, None]).astype(np.float32)
    at = 0
    for group in (model.filters, model.bias):
        for w in WIDTHS:
            n = group[w].size
            group[w], at = layers[at : at + n].reshape(group[w].shape).astype(np.float32), at + n
    model.weights, model.offset = layers[at:-1].astype(np.float32), float(layers[-1])


def score_toxicity(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score, and flagged: whether it reaches the threshold of the document's language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # under 1 MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = _Ids(), shared.value
        for batch in batches:
            for b in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                if len(ids) > 300_000:
                    ids = _Ids()
                p = own.scores(b.column("text").to_pylist(), ids)
                cuts = np.array([own.thresholds.get(x, THRESHOLD) for x in b.column("lang").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array(p >= cuts)], names=["doc_id", "score", "flagged"])

    return docs.select("doc_id", "text", "lang").mapInArrow(released(run), "doc_id long, score double, flagged boolean")
