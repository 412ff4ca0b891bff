"""SentencePiece encoding and decoding with the N best segmentations.

The lattice of a text has a node between any two characters and an edge for each piece that fits. A forward Viterbi pass
gives each node the score of its best path from the start. Used as a heuristic it is exact, so a backward A-star search
from the end meets complete segmentations in the order of their scores, and never opens a path that is not a part of one
of the N best (but for ties).

No piece of the vocabulary joins letters with digits, or anything with a space but at its head. Where two characters
stand side by side in no piece, every path goes through the node between them; there the lattice is cut into segments,
and a segment that was met before is not searched again. The search over a text is the same search over its segments:
the forward scores of segments are exact, and only the N-1 segments with the cheapest second choices can differ from the
best in the N best.

Scores are log-probabilities: a unigram model's own; those of a model of merges (which has ranks alone) by Zipf's law
from the rank. A character that is no piece is written as the pieces of its UTF-8 bytes. The meta symbol stands for a
space; where a text has the symbol itself, its bytes are used, so decoding gives back every text exactly.

Defined cases: a null text gives null ids; the empty text gives no pieces, and one segmentation of score 0; ties go to
the segmentation that the search meets first, which is always the same; repeated rows are encoded each on its own; extra
columns are kept by `encode`, but for those named like its outputs, which are replaced.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from nearfield.llm.common import released

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
META = "▁"
#: Segments up to this length are searched side by side; longer ones alone.
SHORT = 40
#: Segments remembered by a task, at most.
MOST = 250_000


def _grain(score: float) -> float:
    """To multiples of 2**-16: sums of such numbers are exact in any order, so equal scores compare as equal."""
    return round(score * 65536) / 65536


class Vocabulary:
    """Pieces with a space for the meta symbol, their scores, and the ids of bytes."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_at: list[int], plain: list[bool], merges: bool):
        n = len(pieces)
        if merges:
            total = sum(1 / (r + 2) for r in range(n))
            score_of = lambda s: -math.log((min(-s, n) + 2) * total)
        else:
            score_of = float
        self.text = [p.replace(META, " ") for p in pieces]
        self.score = [_grain(score_of(s)) if plain[k] else 0.0 for k, s in enumerate(scores)]
        self.ids = {self.text[k]: k for k in range(n) if plain[k]}
        self.bytes_at = bytes_at
        least = min((self.score[k] for k in range(n) if plain[k]), default=0.0)
        self.byte_score = least - 1.0
        self.raw = [t.encode() for t in self.text]
        for b, k in enumerate(bytes_at):
            self.raw[k] = bytes([b])
        self.longest = max(map(len, self.ids), default=1)
        self.pattern = self._pattern()
        self._index()

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        pieces = [p.id_to_piece(k) for k in range(n)]
        plain = [not (p.is_byte(k) or p.is_control(k) or p.is_unknown(k) or p.is_unused(k)) for k in range(n)]
        bytes_at = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = [p.get_score(k) for k in range(n)]
        merges = all(s == int(s) for s, own in zip(scores, plain, strict=True) if own)  # ranks are whole numbers
        return cls(pieces, scores, bytes_at, plain, merges)

    def _pattern(self) -> re.Pattern:
        """Cuts a text where no piece goes across. Characters that stand before another kind in some piece count as signs."""
        kind = lambda c: " " if c == " " else "d" if re.match(r"\d", c) else "l" if re.match(r"[^\W_]", c) else "o"
        odd: set[str] = set()
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                if kind(a) + kind(b) not in ("ll", " l", "oo", " o", "  "):
                    odd |= {a, b} - {" "}
        more = re.escape("".join(sorted(odd)))
        return re.compile(rf" *[^\W\d_{more}]+| *(?:[^\w ]|[_{more}])+| +|\d")

    def _index(self) -> None:
        """The pieces as a trie in sorted arrays: child of (node, character), piece at a node."""
        children: list[dict[str, int]] = [{}]
        at = [-1]
        for text, k in self.ids.items():
            node = 0
            for c in text:
                node = children[node].setdefault(c, len(children))
                if node == len(children):
                    children.append({})
                    at.append(-1)
            at[node] = k
        edges = sorted(((node << 21) + ord(c), child) for node, kids in enumerate(children) for c, child in kids.items())
        self.edge_key = np.array([k for k, _ in edges], np.int64)
        self.edge_to = np.array([c for _, c in edges], np.int32)
        self.piece_at = np.array(at, np.int32)
        self.scores = np.array(self.score)

    def cost_of_char(self, c: str) -> float:
        return self.byte_score * len(c.encode("utf-8", "surrogatepass"))

    # --- one segment -----------------------------------------------------------------------------------------------

    def lattice(self, s: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end, the edges into it: (start, score, ids)."""
        into: list[list] = [[] for _ in range(len(s) + 1)]
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + self.longest) + 1):
                k = self.ids.get(s[i:j])
                if k is not None:
                    into[j].append((i, self.score[k], (k,)))
            if s[i] not in self.ids:
                into[i + 1].append((i, self.cost_of_char(s[i]), tuple(self.bytes_at[b] for b in s[i].encode("utf-8", "surrogatepass"))))
        return into

    def n_best(self, s: str, n: int = N_BEST) -> list[tuple[float, tuple[int, ...]]]:
        """(score, ids) of the n best segmentations of a segment or a text, best first."""
        into = self.lattice(s)
        best = [0.0] + [-math.inf] * len(s)
        for j in range(1, len(s) + 1):
            best[j] = max(best[i] + w for i, w, _ in into[j])
        out, count = [], 0
        # score of the whole, node, order, score of the part behind the node, the part; of equal scores the one nearest to the start goes on
        agenda = [(-best[-1], len(s), 0, 0.0, None)]
        while agenda and len(out) < n:
            _, node, _, behind, part = heapq.heappop(agenda)
            if node == 0:
                ids: list[int] = []
                while part:
                    ids += part[0]
                    part = part[1]
                out.append((behind, tuple(ids)))
                continue
            for i, w, ids in into[node]:
                count += 1
                heapq.heappush(agenda, (-(best[i] + w + behind), i, count, w + behind, (ids, part)))
        return out

    # --- many segments side by side ----------------------------------------------------------------------------------

    def best_and_loss(self, segments: list[str]) -> list[tuple[float, float, tuple[int, ...]]]:
        """(score, loss of the second best or infinity, ids) of short segments."""
        total, loss, flat, count = self.best_arrays(segments)
        ends = np.cumsum(count)
        return [(float(t), float(x), tuple(flat[e - c : e].tolist())) for t, x, c, e in zip(total, loss, count, ends, strict=True)]

    def best_arrays(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores, losses of the second best (or infinity), ids end to end and their numbers: the same Viterbi passes, forward and backward, on all segments at once."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        n, steps = len(segments), int(size.max())
        chars = np.frombuffer("".join([s.ljust(steps, "\0") for s in segments]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, steps).astype(np.int64)
        alpha = np.full((n, steps + 1), -np.inf)
        alpha[:, 0] = 0
        back = np.zeros((n, steps + 1), np.int64)
        edges: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(steps):
            rows = np.flatnonzero(size > i)
            node = np.zeros(len(rows), np.int64)
            single = np.zeros(n, bool)
            alive = rows
            for j in range(i + 1, steps + 1):
                inside = size[alive] >= j
                alive, node = alive[inside], node[inside]
                if not len(alive):
                    break
                key = (node << 21) + chars[alive, j - 1]
                at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
                found = self.edge_key[at] == key
                alive, node = alive[found], self.edge_to[at[found]].astype(np.int64)
                piece = self.piece_at[node]
                full = piece >= 0
                own, piece = alive[full], piece[full]
                if len(own):
                    if j == i + 1:
                        single[own] = True
                    self._enter(alpha, back, edges, i, j, own, self.scores[piece], piece)
            other = rows[~single[rows]]
            if len(other):
                points = chars[other, i]
                width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
                self._enter(alpha, back, edges, i, i + 1, other, self.byte_score * width, -points - 1)
        beta = np.full((n, steps + 1), -np.inf)
        beta[np.arange(n), size] = 0
        for i, j, own, w, _ in reversed(edges):
            beta[own, i] = np.maximum(beta[own, i], w + beta[own, j])
        total = alpha[np.arange(n), size]
        # the best path, from the end
        taken = np.zeros((n, steps + 1), np.int64)
        node = size.copy()
        moving = np.flatnonzero(node > 0)
        while len(moving):
            e = back[moving, node[moving]]
            taken[moving, node[moving]] = e
            node[moving] = (e >> 32) & 0xFF
            moving = moving[node[moving] > 0]
        loss = np.full(n, np.inf)
        for i, j, own, w, code in edges:
            off = taken[own, j] != _coded(i, code)
            own, w = own[off], w[off]
            loss[own] = np.minimum(loss[own], total[own] - (alpha[own, i] + w + beta[own, j]))
        # row by row, ends in order: the ids of the paths, one after the other
        row, end = np.nonzero(taken)
        flat = (taken[row, end] & 0xFFFFFFFF) - (1 << 31)
        spelt = np.flatnonzero(flat < 0)
        if len(spelt):  # characters that are no pieces, as bytes
            raw = [[self.bytes_at[b] for b in chr(-c - 1).encode("utf-8", "surrogatepass")] for c in flat[spelt].tolist()]
            times = np.ones(len(flat), np.int64)
            times[spelt] = [len(x) for x in raw]
            own = np.repeat(flat < 0, times)
            flat, row = np.repeat(flat, times), np.repeat(row, times)
            flat[own] = [b for x in raw for b in x]
        return total, np.maximum(loss, 0.0), flat.astype(np.int32), np.bincount(row, minlength=n)

    @staticmethod
    def _enter(alpha, back, edges, i: int, j: int, own: np.ndarray, w: np.ndarray, code: np.ndarray) -> None:
        edges.append((i, j, own, w, code))
        reach = alpha[own, i] + w
        better = reach > alpha[own, j]
        alpha[own[better], j] = reach[better]
        back[own[better], j] = _coded(i, code[better])


def _coded(i: int, code: np.ndarray) -> np.ndarray:
    """An edge's start and piece (or character, as a negative number) in one number."""
    return (i << 32) + code.astype(np.int64) + (1 << 31)


class Encoder:
    """A vocabulary with the segments met so far."""

    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST):
        self.v, self.n = vocabulary, n
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.few: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, new: list[str]) -> None:
        """Searches segments that are not known yet."""
        short, long = sorted((s for s in new if len(s) <= SHORT), key=len), [s for s in new if len(s) > SHORT]
        parts = [self.v.best_arrays(short[at : at + 4000]) for at in range(0, len(short), 4000)]
        for s in long:
            two = self.v.n_best(s, 2)
            loss = two[0][0] - two[1][0] if len(two) > 1 else math.inf
            parts.append((np.array([two[0][0]]), np.array([loss]), np.array(two[0][1], np.int32), np.array([len(two[0][1])])))
        self.known.update(zip([*short, *long], range(len(self.known), len(self.known) + len(new)), strict=True))
        score, loss, flat, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.score, self.loss, self.flat = np.concatenate([self.score, score]), np.concatenate([self.loss, loss]), np.concatenate([self.flat, flat])

    def segments(self, text: str) -> list[str]:
        return self.v.pattern.findall(" " + text) if text else []

    def alternatives(self, parts: list[str], numbers: np.ndarray) -> list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]:
        """The n best of a text: (score less than the best's, changes), a change being (place in the best's ids, ids replaced, ids instead)."""
        loss = self.loss[numbers]
        able = np.flatnonzero(np.isfinite(loss))
        if len(able) > self.n - 1:
            # of equal losses the first in the text
            limit = np.partition(loss[able], self.n - 2)[self.n - 2] if self.n > 1 else -1
            able = able[loss[able] <= limit]
            able = np.sort(able[np.argsort(loss[able], kind="stable")][: self.n - 1])
        places = np.cumsum(self.count[numbers]) - self.count[numbers]
        choices = []
        for k in able.tolist():
            if parts[k] not in self.few:
                self.few[parts[k]] = self.v.n_best(parts[k], self.n)
            choices.append(self.few[parts[k]])
        # backward over the chosen segments; what lies before costs nothing more at best
        out, count = [], 0
        agenda: list[tuple[float, int, int, tuple[int, ...]]] = [(0.0, len(choices), 0, ())]
        while agenda and len(out) < self.n:
            lost, k, _, picks = heapq.heappop(agenda)
            if k == 0:
                changes = [(int(places[able[i]]), len(choices[i][0][1]), choices[i][p][1]) for i, p in enumerate(picks) if p]
                out.append((lost, changes))
                continue
            for p, (score, _) in enumerate(choices[k - 1]):
                count += 1
                heapq.heappush(agenda, (lost + choices[k - 1][0][0] - score, k - 1, count, (p, *picks)))
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, list] | None]:
        """(score, ids, alternatives) of each text."""
        if len(self.known) > MOST:
            self.clear()
        parts = [self.segments(t) if t is not None else [] for t in texts]
        new = set(chain.from_iterable(parts)).difference(self.known)
        if new:
            self.learn(list(new))
        out: list = []
        for t, own in zip(texts, parts, strict=True):
            if t is None:
                out.append(None)
                continue
            numbers = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
            counts = self.count[numbers]
            shift = np.repeat(self.start[numbers] - (np.cumsum(counts) - counts), counts)
            ids = self.flat[shift + np.arange(len(shift))]
            score = float(self.score[numbers].sum())
            out.append((score, ids, [(score - lost, changes) for lost, changes in self.alternatives(own, numbers)]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        return b"".join(map(self.v.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def changed(ids: list[int], changes: list[tuple[int, int, tuple[int, ...]]]) -> list[int]:
    """The ids of one of the n best, from those of the best and the changes."""
    out, at = [], 0
    for place, cut, instead in changes:
        out += [*ids[at:place], *instead]
        at = place + cut
    return out + list(ids[at:])


OUTPUTS = ("ids", "score", "n_best", "exact")
_CHANGE = pa.struct([("at", pa.int32()), ("cut", pa.int32()), ("ids", pa.list_(pa.int32()))])
_N_BEST = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(_CHANGE))]))
_FIELDS = "ids array<int>, score double, n_best array<struct<score:double,changes:array<struct<at:int,cut:int,ids:array<int>>>>>, exact boolean"


def encode(docs: DataFrame, vocabulary: Vocabulary, n: int = N_BEST) -> DataFrame:
    """docs with ids (of the best segmentation), score, n_best (scores, and how each differs from the best), exact (whether decoding gives the text back)."""
    kept = [f for f in docs.schema.fields if f.name not in OUTPUTS]
    names = [f.name for f in kept]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary's size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, n)
        for batch in batches:
            for b in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                texts = b.column("text").to_pylist()
                made = encoder.encode(texts)
                flat = [m[1] if m else np.zeros(0, np.int32) for m in made]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in flat]))).astype(np.int32)
                missing = pa.array([m is None for m in made])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32()), mask=missing)
                best = pa.array([None if m is None else [{"score": s, "changes": [{"at": p, "cut": c, "ids": i} for p, c, i in ch]} for s, ch in m[2]] for m in made], _N_BEST)
                exact = pa.array([None if m is None else encoder.decode(m[1]) == t for m, t in zip(made, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), ids, pa.array([m and m[0] for m in made], pa.float64()), best, exact], names=[*names, *OUTPUTS])

    return docs.select(*names).mapInArrow(released(run), T.StructType([*kept, *T.StructType.fromDDL(_FIELDS).fields]))


def decode(encoded: DataFrame, vocabulary: Vocabulary, column: str = "ids") -> DataFrame:
    """encoded with the column decoded, the text of the ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [f for f in encoded.schema.fields if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            texts = [None if x.as_py() is None else encoder.decode(x.values.to_numpy()) for x in b.column(column)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), "decoded"])

    return encoded.mapInArrow(released(run), T.StructType([*kept, T.StructField("decoded", T.StringType())]))
