"""Benchmark decontamination with a generalised suffix automaton of the benchmark's items.

Documents stream by, a word at a time, through the automaton of all items; it tracks the longest match that ends at
each word. Where the match reaches a window (13 words, or the whole of a shorter item), the window's words are hit.
The items are read in blocks of bounded size, an automaton each. Whatever their number, a task has one worker, which
holds one automaton at a time: it takes rows up to CHUNK bytes of text, sends them through every block in turn, and goes
on. So memory on an executor does not grow with the benchmark, and no row is shuffled; time grows with the number of
blocks. What a state must know of its ancestors is stored with it, so a word costs the same however an item repeats itself.

Defined cases: a null or empty text has no words and is never contaminated; repeated rows are judged each on its own;
an empty benchmark hits nothing; items without words are ignored; extra columns pass through, except those named like
an output, which are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from nearfield.llm.common import Batches, aside, released

WINDOW = 13
#: Words of an automaton: about 150 MB in an executor's Python worker.
BLOCK_WORDS = 200_000
#: Bytes of text that are held while the blocks take turns; with one block, batches pass as they come.
CHUNK = 32 << 20
#: Shares of a document's words: 1/20 makes it contaminated; where over half is hit, nothing of it is worth keeping.
COVERAGE, DROP_COVERAGE = 1 / 20, 1 / 2

_WORD_BYTE = [c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)]
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else _WORD_BYTE[c] for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8: A-Z in lower case, cut at every ASCII character but digits and letters."""
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Of several sequences of words. A state stands for the substrings that end at the same places."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, set[str]] = {}  # of the states of windows
        self.whole: dict[int, list[tuple[int, str]]] = {}  # items shorter than a window, by the state of their text
        self.least = window
        number = self.vocabulary
        coded = [(name, [number.setdefault(w, len(number)) for w in words]) for name, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self._climb()
        for name, ids in coded:
            self._mark(name, ids)
        self._climb_whole()

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The part of state q whose strings are one longer than p's."""
        half = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = half
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = half
            p = self.link[p]
        return half

    def _extend(self, p: int, c: int) -> int:
        q = self.step[p].get(c)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        new = self._new(self.length[p] + 1, {}, 0)
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _by_length(self) -> list[int]:
        """States, ancestors first."""
        return np.argsort(self.length, kind="stable").tolist()

    def _climb(self) -> None:
        """window_of: of each state, its ancestor (or itself) that holds the last words of a window, 0 if its strings are shorter."""
        self.window_of = [0] * len(self.length)
        for u in self._by_length():
            if self.length[u] >= self.window:
                self.window_of[u] = self.window_of[self.link[u]] or u

    def _climb_whole(self) -> None:
        """whole_of: of each state, its nearest ancestor (or itself) at which a short item ends, 0 if there is none."""
        self.whole_of = [0] * len(self.length) if self.whole else []
        if self.whole:
            for u in self._by_length()[1:]:
                self.whole_of[u] = u if u in self.whole else self.whole_of[self.link[u]]

    def _mark(self, name: str, ids: list[int]) -> None:
        """Names the item at the states of its windows."""
        v = 0
        for c in ids:
            v = self.step[v][c]
            u = self.window_of[v]
            if u:
                self.items.setdefault(u, set()).add(name)
        if len(ids) < self.window:
            self.whole.setdefault(v, []).append((len(ids), name))
            self.least = min(self.least, len(ids))

    def match(self, ids: list[int], offset: int, hit: np.ndarray, found: set[str]) -> int:
        """Streams words through the automaton; marks those in windows, adds the windows' items; returns the longest match."""
        v = length = longest = 0
        w, step, link, lengths, seen = self.window, self.step, self.link, self.length, set()
        for i, c in enumerate(ids, offset):
            while v and c not in step[v]:
                v = link[v]
                length = lengths[v]
            if c in step[v]:
                v = step[v][c]
                length += 1
            longest = max(longest, length)
            if length >= w:
                hit[i - w + 1 : i + 1] = True
                u = self.window_of[v]
                if u not in seen:
                    seen.add(u)
                    found |= self.items[u]
            if self.whole_of:
                u = self.whole_of[v]
                while u:
                    for n, name in self.whole[u]:
                        if n <= length:
                            hit[i - n + 1 : i + 1] = True
                            found.add(name)
                    u = self.whole_of[link[u]]
        return longest

    def scan(self, words: list[bytes], hit: np.ndarray, found: set[str]) -> int:
        """As match, over all words of a text; stretches of known words too short for a window are skipped."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        unknown = np.flatnonzero(ids < 0)
        starts = np.concatenate(([0], unknown + 1))
        ends = np.concatenate((unknown, [len(ids)]))
        longest = 0
        for k in np.flatnonzero(ends - starts >= self.least):
            longest = max(longest, self.match(ids[starts[k] : ends[k]].tolist(), int(starts[k]), hit, found))
        return longest


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items (item_id, text) in blocks of at most block_words words; longer items in parts that overlap, so that no window is cut."""
    block: list[tuple[str, bytes]] = []
    room = block_words
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where("text is not null").sort("i", "text")
    for row in rows.toLocalIterator():
        words = words_of(row["text"].encode())
        step = max(1, block_words - window + 1)
        for k in range(0, max(1, len(words) - window + 1), step):
            part = words[k : k + block_words]
            if part and len(part) > room:
                yield block
                block, room = [], block_words
            if part:
                block.append((str(row["i"]), b" ".join(part)))
                room -= len(part)
    yield block


_built: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, items: Broadcast, window: int) -> SuffixAutomaton:
    """Of a block's items. One is kept at a time, for the tasks to come; the block's text is let go, as it can be read again."""
    if key not in _built:
        _built.clear()
        _built[key] = SuffixAutomaton([(name, text.split()) for name, text in items.value], window)
        if getattr(items, "_path", None):
            items.__dict__.pop("_value", None)
    return _built[key]


FOUND = ["n_words", "n_hit", "longest", "item_ids", "hits"]
_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit, longest (match, in words), item_ids (sorted strings) and hits (runs of hit words, by number, end exclusive)."""
    return _passes(docs, benchmark, window, block_words)


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, then: Callable[[Batches], Batches] | None = None, result: T.StructType | None = None) -> DataFrame:
    """One pass, in which every block takes its turn; its batches go to then, in the same worker, which makes the result's columns of them."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in FOUND]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("longest", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hits", _RUNS)])
    names = [f.name for f in kept]
    context = docs.sparkSession.sparkContext
    blocks = [(hashlib.sha256(repr((items, window)).encode()).hexdigest(), context.broadcast(items)) for items in item_blocks(benchmark, block_words, window)]
    run = _turns(blocks, window, names)
    return docs.select(*(f"`{n}`" for n in names)).mapInArrow(released(_chain(run, then) if then else run), result or schema)


def _chain(run: Callable[[Batches], Batches], then: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    return lambda batches: then(run(batches))


def _chunks(batches: Batches, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about size bytes."""
    chunk, held = [], 0
    for b in batches:
        chunk.append(b)
        held += b.nbytes
        if held >= size:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def _turns(blocks: list[tuple[str, Broadcast]], window: int, names: list[str]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for chunk in _chunks(batches, CHUNK if len(blocks) > 1 else 0):
            rows = [[None, set(), 0] for b in chunk for _ in range(b.num_rows)]  # hit words, items, longest match
            for key, items in blocks:
                automaton, at = _automaton(key, items, window), iter(rows)
                for b in chunk:
                    for text in b.column("text").cast(pa.binary()):
                        row, words = next(at), words_of(text.as_py() or b"")
                        if row[0] is None:
                            row[0] = np.zeros(len(words), bool)
                        row[2] = max(row[2], automaton.scan(words, row[0], row[1]))
            at = iter(rows)
            for b in chunk:
                yield _found(b, [next(at) for _ in range(b.num_rows)], names)

    return run


def _found(b: pa.RecordBatch, rows: list, names: list[str]) -> pa.RecordBatch:
    made = []
    for hit, found, longest in rows:
        runs = []
        if found:
            edge = np.flatnonzero(np.diff(hit, prepend=False, append=False)).tolist()
            runs = [{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2], strict=True)]
        made.append((len(hit), int(hit.sum()) if found else 0, longest, sorted(found), runs))
    columns = list(zip(*made, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), _RUNS_ARROW)
    return pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names=[*names, *FOUND])


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """Whether a document counts as contaminated: at least a twentieth of its words is hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def without_runs(text: str, runs: list[dict]) -> str:
    """text without the words of the runs and what stands between them."""
    spans = [m.span() for m in _WORD.finditer(text)]
    parts, at = [], 0
    for run in runs:
        parts.append(text[at : spans[run["start"]][0]])
        at = spans[run["end"] - 1][1]
    return "".join(parts) + text[at:]


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, in which contaminated documents lose the hit spans (once: what only meets across a cut is not looked for); those with over half of their words hit go. Others are left as they are, as are columns named like an output. n_chars, if there, is brought up to date."""
    columns = docs.columns
    renamed, _ = aside(docs, FOUND)
    own = dict(zip(columns, renamed.columns, strict=True))

    def cut(batches: Batches) -> Batches:
        for b in batches:
            n_hit, n_words = (b.column(c).to_numpy() for c in ("n_hit", "n_words"))
            dirty = (n_hit > 0) & (n_hit * 20 >= n_words)
            stays = ~(dirty & (n_hit > DROP_COVERAGE * n_words))
            b, dirty = b.filter(pa.array(stays)), dirty[stays]
            arrays = {n: b.column(own[n]) for n in columns}
            if dirty.any():
                text, mask = arrays["text"], pa.array(dirty)
                texts = [without_runs(text[k].as_py(), b.column("hits")[k].as_py()) for k in np.flatnonzero(dirty).tolist()]
                arrays["text"] = pc.replace_with_mask(text, mask, pa.array(texts, text.type))
                if "n_chars" in arrays:
                    arrays["n_chars"] = pc.replace_with_mask(arrays["n_chars"], mask, pa.array([len(t) for t in texts], arrays["n_chars"].type))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=columns)

    return _passes(renamed, benchmark, window, block_words, cut, docs.schema)
