"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions beside them.

The patterns give the base spans. The tagger adds spans that the patterns miss: phone numbers without a plus, card and
network numbers in other groupings, addresses written as "name (at) host (dot) org". It is trained in numpy, by its
gradient, from labelled spans of two kinds: SENTENCES invented ones, which a seeded generator makes and which hold the
forms that no pattern knows, and at most EXAMPLES windows of the corpus for each kind of span, and as many round other
digits, with the patterns' spans as labels. The windows are the first by a hash of their text and come from two thirds of
the documents; the last third (crc32 of doc_id, modulo 3, is 1) is never learnt from. Trained weights are kept in
the shared folder under a hash of what they were learnt from, so that the same input trains once.

Only stretches round a trigger are tagged: a digit, an @ or a bracketed "at"; a span without one is no personal data of
these kinds. Each stretch is cut into overlapping windows; the windows' scores are merged, nearer to a window's centre
weighing more, and one Viterbi decoding of the whole stretch reconciles them. A tagged span counts if it is plausible:
a card number passes Luhn, a network number has four parts, and so on.

Defined cases: a null or empty text has no spans; spans of one kind do not overlap, and those of the tagger overlap no
base span; repeated rows are judged each on its own; without documents the invented sentences alone are learnt from;
extra columns are ignored by `find_pii`.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from nearfield.llm.common import keep_model, kept_model, released, stored

KINDS = ("email", "ip", "card", "phone")

# --- base patterns ---------------------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"([0-9]++)(?:\.([0-9]++)\.([0-9]++)\.([0-9]++))?+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: a local part cannot hold one, so the leftmost start is where the run before it begins."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if m[2] and all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.groups())):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", *m.span()))
    return ordered(found)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# --- labelled spans for training -------------------------------------------------------------------------------------

SENTENCES, SEED, HIDDEN, EMBED, EPOCHS, BATCH = 2000, 11, 20, 12, 9, 64
#: Windows of the corpus of each kind that reach the driver at most, and of a text in the sample.
EXAMPLES, OF_TEXT = 200, 3
WINDOW, STRIDE, CONTEXT = 96, 48, 24
_LETTERS = "etaoinshrdlucmfwypvbgkjqxz"


def _word(r: random.Random, plain: bool = False) -> str:
    w = "".join(r.choice(_LETTERS if plain or r.random() < 0.95 else "éèüöäñíóçß") for _ in range(r.randint(1 + plain, 11)))
    return w.capitalize() if r.random() < 0.12 else w


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random) -> str:
    body = r.choice("3456") + _digits(r, r.choice((14, 14, 14, 13)))
    full = next(body + d for d in "0123456789" if luhn(body + d))
    gap = r.choice(("", " ", "-", ".", "  "))
    return gap.join(full[k : k + 4] for k in range(0, len(full), 4))


def _phone(r: random.Random) -> str:
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice((f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{r.randint(10, 99)} {a} {b}{c}", f"0{a}/{b}{c}", f"+{r.randint(1, 99)} {a} {b} {c}"))


def _ip(r: random.Random) -> str:
    return r.choice((".", ".", ".", "[.]", "(.)", " . ")).join(str(r.randint(1, 255)) for _ in range(4))


def _email(r: random.Random) -> str:
    name = r.choice((".", "_", "")).join(_word(r, True).lower() for _ in range(r.randint(1, 2))) + (_digits(r, 2) if r.random() < 0.4 else "")
    at, dot = r.choice((("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), (" @ ", " . "), (" [at] ", ".")))
    return name + at + dot.join([_word(r, True).lower() + (_digits(r, 1) if r.random() < 0.3 else ""), *([_word(r, True).lower()] if r.random() < 0.5 else []), r.choice(("com", "org", "net", "de", "fr", "io"))])


def _innocent(r: random.Random) -> str:
    """What has digits or brackets but is no personal data."""
    return r.choice(
        (
            lambda: str(r.randint(0, 99999)), lambda: f"{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
            lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02}", lambda: f"{r.randint(1, 999)},{_digits(r, 3)}", lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((18, 32, 40)))),
            lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), lambda: f"@{_word(r)}", lambda: f"{_word(r)}{r.randint(0, 99)}", lambda: f"${r.randint(1, 9999)}.{_digits(r, 2)}", lambda: _digits(r, r.choice((8, 9, 11, 12, 16, 20))) + _word(r), lambda: f"{r.randint(1, 99)}%", lambda: f"({r.randint(1, 99)})",
            lambda: f'password={"".join(r.choice("0123456789abcdef") for _ in range(18))}', lambda: f"#{r.randint(1, 99999)}", lambda: f"{r.randint(1, 99)}/{r.randint(1, 99)}/{r.randint(1990, 2030)}", lambda: " ".join(str(r.randint(0, 99)) for _ in range(r.randint(2, 8))),
        )
    )()


def labelled_sentences(n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Invented sentences with the spans of the personal data set into them."""
    r, out, make = random.Random(seed), [], {"email": _email, "ip": _ip, "card": _card, "phone": _phone}
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(_word(r) for _ in range(r.randint(1, 4))) + r.choice((" ", " ", " ", ". ", ", ", ": ", "\n"))
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                value = make[kind](r)
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + r.choice((" ", " ", ". ", ", ", "\n"))
            else:
                text += _innocent(r) + r.choice((" ", ". ", ", "))
        text += " ".join(_word(r) for _ in range(r.randint(1, 4)))
        end = min([WINDOW, *(s for _, s, e in spans if s < WINDOW < e)])  # no span is cut
        out.append((text[:end], [(k, s, e) for k, s, e in spans if e <= end]))
    return out


_TRIGGER = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]")


def windows_of(text: str) -> Iterator[tuple[str, str, list[tuple[str, int, int]]]]:
    """(kind, window, spans in it) round base spans, and round a trigger outside of any ("none"). Windows with spans that overlap, or that would cut one, are left out."""
    base = base_spans(text)
    tally: dict[str, int] = {}
    others = [m.span() for m in _TRIGGER.finditer(text) if all(m.end() <= s or e <= m.start() for _, s, e in base)][:OF_TEXT] if len(base) < 100 else []
    for kind, s, e in [*base, *(("none", *span) for span in others)]:
        tally[kind] = tally.get(kind, 0) + 1
        before = (s * 7 + e) % max(1, WINDOW - (e - s))  # where in its window the span stands
        low = max(0, s - before)
        high = min(len(text), low + WINDOW)
        spans = [x for x in base if x[1] < high and low < x[2]]
        whole = all(low <= x[1] and x[2] <= high for x in spans) and all(x[2] <= y[1] for x, y in zip(spans, spans[1:], strict=False))
        if tally[kind] <= OF_TEXT and whole:
            yield kind, text[low:high], [(k, x - low, y - low) for k, x, y in spans]


# --- tagger ----------------------------------------------------------------------------------------------------------

_PLAIN = 128
_TAGS = 1 + len(KINDS)


def codes(text: str) -> np.ndarray:
    """A number for each character: ASCII, other letters, others; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(points < _PLAIN, np.maximum(points, 1), np.where(points < 0x2000, _PLAIN, _PLAIN + 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, an LSTM in either direction, a linear layer to tags, CRF transitions between them."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN, embed: int = EMBED):
        g = np.random.default_rng(seed)
        f = lambda *shape: (g.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"emb": f(_PLAIN + 2, embed) * 3, "out": f(2 * hidden, _TAGS), "bias": np.zeros(_TAGS, np.float32), "trans": np.zeros((_TAGS, _TAGS), np.float32), "start": np.zeros(_TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"{d}x": f(embed, 4 * hidden), f"{d}h": f(hidden, 4 * hidden), f"{d}b": np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)}
        self.p["emb"][0] = 0

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states [batch, time, hidden]; padding leaves the state as it is."""
        n, steps, _ = x.shape
        k = self.hidden
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out = np.zeros((n, steps, k), np.float32)
        fed = x @ self.p[f"{d}x"] + self.p[f"{d}b"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = fed[:, t] + h @ self.p[f"{d}h"]
            gates = _sigmoid(z[:, : 3 * k])
            i, g, o, u = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], np.tanh(z[:, 3 * k :])
            m = mask[:, t, None]
            new = g * c + i * u
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, i, g, o, u, th, h, c, m))
            h, c = np.where(m, o * th, h), np.where(m, new, c)
            out[:, t] = h
        return out

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores of tags [batch, time, tags] of padded windows."""
        x, mask = self.p["emb"][ids], ids > 0
        kept = {d: [] if keep is not None else None for d in "fb"}
        h = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], 2)
        if keep is not None:
            keep |= {"x": x, "mask": mask, "h": h, **kept}
        return h @ self.p["out"] + self.p["bias"]

    def _marginals(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of tags and pairs of tags, by the forward-backward algorithm; the pairs are summed over time."""
        n, steps, k = e.shape
        trans = self.p["trans"]
        a = np.zeros((steps, n, k))
        a[0] = e[:, 0] + self.p["start"]

        def add(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

        for t in range(1, steps):
            a[t] = np.where(mask[:, t, None], add(a[t - 1][:, :, None] + trans, 1) + e[:, t], a[t - 1])
        z = add(a[-1], 1)
        b = np.zeros((n, k))
        tags, pairs = np.zeros((n, steps, k)), np.zeros((k, k))
        for t in range(steps - 1, -1, -1):
            tags[:, t] = np.exp(a[t] + b - z[:, None]) * mask[:, t, None]
            if t:
                after = e[:, t] + b
                pairs += (np.exp(a[t - 1][:, :, None] + trans + after[:, None, :] - z[:, None, None]) * mask[:, t, None, None]).sum(0)
                b = np.where(mask[:, t, None], add(trans + after[:, None, :], 2), b)
        return tags, pairs, z

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of the labelled windows."""
        keep: dict = {}
        e = self.emissions(ids, keep)
        mask, n = keep["mask"], len(ids)
        marginal, pairs, _ = self._marginals(e.astype(float), mask)
        gold = np.eye(_TAGS)[tags] * mask[:, :, None]
        de = ((marginal - gold) / n).astype(np.float32)
        gold_pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
        grad = {"trans": ((pairs - gold_pairs) / n).astype(np.float32), "start": (marginal[:, 0] - gold[:, 0]).mean(0).astype(np.float32), "out": np.einsum("nth,ntk->hk", keep["h"], de), "bias": de.sum((0, 1))}
        dh = de @ self.p["out"].T
        dx = np.zeros_like(keep["x"])
        k = self.hidden
        for d, part in (("f", dh[:, :, :k]), ("b", dh[:, :, k:])):
            gh = np.zeros((n, k), np.float32)
            gc = np.zeros((n, k), np.float32)
            dz_all = np.zeros((n, ids.shape[1], 4 * k), np.float32)
            grad[f"{d}h"] = np.zeros_like(self.p[f"{d}h"])
            for t, i, g, o, u, th, h0, c0, m in reversed(keep[d]):
                gh = gh + part[:, t]
                here, past = np.where(m, gh, 0), np.where(m, 0, gh)
                c_in = np.where(m, gc, 0) + here * o * (1 - th * th)
                dz = np.concatenate([c_in * u * i * (1 - i), c_in * c0 * g * (1 - g), here * th * o * (1 - o), c_in * i * (1 - u * u)], 1)
                dz_all[:, t] = dz
                grad[f"{d}h"] += h0.T @ dz
                gh = past + dz @ self.p[f"{d}h"].T
                gc = np.where(m, 0, gc) + c_in * g
            grad[f"{d}x"] = np.einsum("nte,ntk->ek", keep["x"], dz_all)
            grad[f"{d}b"] = dz_all.sum((0, 1))
            dx += dz_all @ self.p[f"{d}x"].T
        grad["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grad["emb"], ids, dx)
        grad["emb"][0] = 0
        return grad

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> float:
        e = self.emissions(ids).astype(float)
        mask = ids > 0
        _, _, z = self._marginals(e, mask)
        n, steps = ids.shape
        rows = np.arange(n)[:, None]
        score = (e[rows, np.arange(steps), tags] * mask).sum(1) + self.p["start"][tags[:, 0]] + (self.p["trans"][tags[:, :-1], tags[:, 1:]] * mask[:, 1:]).sum(1)
        return float((z - score).mean())

    def fit(self, sentences: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS, rate: float = 0.02, seed: int = SEED) -> Tagger:
        """Adam over shuffled batches."""
        ids, tags = np.zeros((len(sentences), WINDOW), np.int64), np.zeros((len(sentences), WINDOW), np.int64)
        for k, (text, spans) in enumerate(sentences):
            ids[k, : len(text)] = codes(text)
            for kind, s, e in spans:
                tags[k, s:e] = 1 + KINDS.index(kind)
        order = np.random.default_rng(seed)
        first, second = ({name: np.zeros_like(v) for name, v in self.p.items()} for _ in range(2))
        step, total = 0, epochs * -(-len(ids) // BATCH)
        for _ in range(epochs):
            deal = order.permutation(len(ids))
            for k in range(0, len(ids), BATCH):
                step += 1
                grad = self.gradient(ids[deal[k : k + BATCH]], tags[deal[k : k + BATCH]])
                norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
                pace = rate * (1 - step / (total + 1))
                for name, v in grad.items():
                    v = v * min(1, 5 / (norm + 1e-9))
                    first[name] = 0.9 * first[name] + 0.1 * v
                    second[name] = 0.99 * second[name] + 0.01 * v * v
                    self.p[name] = (self.p[name] - pace * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best tags of one stretch."""
        trans, k = self.p["trans"], len(e)
        back = np.zeros((k, _TAGS), np.int64)
        best = e[0] + self.p["start"]
        for t in range(1, k):
            paths = best[:, None] + trans
            back[t] = paths.argmax(0)
            best = paths.max(0) + e[t]
        tags = np.zeros(k, np.int64)
        tags[-1] = best.argmax()
        for t in range(k - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


_WEIGHT = (1 - np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2) / WINDOW).astype(np.float32)


def stretches(text: str) -> list[tuple[int, int]]:
    """Round each trigger, merged where they meet."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        s, e = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def tag_stretches(tagger: Tagger, texts: list[str], batch: int = 512) -> list[np.ndarray]:
    """Tags of each stretch: windows that overlap by half, merged, decoded as one."""
    at = [(k, s) for k, text in enumerate(texts) for s in range(0, max(1, len(text) - STRIDE), STRIDE)]
    merged = [np.zeros((len(t), _TAGS), np.float32) for t in texts]
    weights = [np.zeros(len(t), np.float32) for t in texts]
    coded = [codes(t) for t in texts]
    for first in range(0, len(at), batch):
        part = at[first : first + batch]
        ids = np.zeros((len(part), WINDOW), np.int64)
        for row, (k, s) in enumerate(part):
            piece = coded[k][s : s + WINDOW]
            ids[row, : len(piece)] = piece
        e = tagger.emissions(ids)
        for row, (k, s) in enumerate(part):
            n = min(WINDOW, len(texts[k]) - s)
            merged[k][s : s + n] += e[row, :n] * _WEIGHT[:n, None]
            weights[k][s : s + n] += _WEIGHT[:n]
    return [tagger.viterbi(m / w[:, None]) for m, w in zip(merged, weights, strict=True)]


_EDGE = " \t\n\r.,;:!?\"'"


def plausible(kind: str, text: str) -> bool:
    """What a tagged span must hold at least."""
    digits = sum(c.isdigit() and c.isascii() for c in text)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+\s?(?:@|[(\[{]\s?at\s?[)\]}])\s?[\w-]+(?:\s?(?:\.|[(\[{]\s?dot\s?[)\]}])\s?[\w-]+)+", text, re.I))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= digits <= 19 and luhn(re.sub("[^0-9]", "", text)) and not re.search("[^0-9 .\t-]", text)
    return 9 <= digits <= 15 and not re.search(r"[^0-9 ()+./-]", text) and len(re.findall("[0-9]+", text)) >= 2


def tagged_spans(text: str, start: int, tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of the tags of a stretch that begins at start; their edges are moved out to whole numbers and words, then trimmed."""
    edges = (np.flatnonzero(np.diff(tags)) + 1).tolist()
    out = []
    for s, e in zip([0, *edges], [*edges, len(tags)], strict=True):
        if not tags[s]:
            continue
        s, e, kind = s + start, e + start, KINDS[tags[s] - 1]
        while s > 0 and text[s - 1].isalnum() and text[s].isalnum():
            s -= 1
        while e < len(text) and text[e].isalnum() and text[e - 1].isalnum():
            e += 1
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        if s < e and plausible(kind, text[s:e]):
            out.append((kind, s, e))
    return out


def without_overlaps(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of more that overlap none of base and none before them, in their order."""
    taken: list[tuple[int, int]] = []  # apart and in order
    for _, s, e in base:
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    out = []
    for span in more:
        k = bisect.bisect_left(taken, (span[2],))
        if k == 0 or taken[k - 1][1] <= span[1]:
            taken.insert(k, span[1:])
            out.append(span)
    return out


def spans_of_texts(texts: list[str | None], tagger: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t or "") for t in texts]
    places = [(k, s, e) for k, t in enumerate(texts) if t for s, e in stretches(t)]
    added: list[list] = [[] for _ in texts]
    for (k, s, _), tags in zip(places, tag_stretches(tagger, [texts[k][s:e] for k, s, e in places]), strict=True):
        if tags.any():
            added[k] += tagged_spans(texts[k], s, tags)
    return [(own, ordered([*own, *without_overlaps(own, more)])) for own, more in zip(base, added, strict=True)]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def held_out(doc_id: str = "doc_id") -> Column:
    """The documents no label is learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def corpus_examples(docs: DataFrame, text: str = "text", most: int = EXAMPLES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Windows of docs with their base spans, at most so many of each kind: the first by a hash of the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(kind, zlib.crc32(w.encode("utf-8", "surrogatepass")), w, joined(spans)) for t in b.column(text) if t.is_valid for kind, w, spans in windows_of(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["kind", "h", "window", "spans"])

    found = stored(docs.select(text).mapInArrow(released(run), "kind string, h long, window string, spans string").dropDuplicates(["h", "window"]), "windows")
    picked = [r for kind in (*KINDS, "none") for r in found.where(F.col("kind") == kind).orderBy("h", "window").limit(most).collect()]  # windows of WINDOW characters
    split = lambda line: [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in line.split(",") if x)]
    return [(r["window"], split(r["spans"])) for r in picked]


_trained: dict[str, Tagger] = {}


def trained(examples: Sequence[tuple[str, list[tuple[str, int, int]]]] = (), spark: SparkSession | None = None) -> Tagger:
    """The production tagger: always alike for the same examples, and trained once for them. spark: also look for its weights in the shared folder, and leave them there."""
    key = hashlib.sha256(repr((sorted(examples), SENTENCES, SEED, HIDDEN, EMBED, EPOCHS, BATCH, WINDOW)).encode("utf-8", "surrogatepass")).hexdigest()[:24]
    if key not in _trained:
        model = kept_model(spark, f"pii-{key}") if spark else None
        if model is None:
            model = Tagger().fit([*labelled_sentences(), *sorted(examples)]).p
            if spark:
                keep_model(spark, f"pii-{key}", model)
        _trained[key] = Tagger()
        _trained[key].p = model
    return _trained[key]


def find_pii(docs: DataFrame, text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end), in code points. tagger: if none is given, one is trained on docs."""
    tagger = tagger or trained(corpus_examples(docs.where(~held_out()), text), docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tagger.p)  # some 60 kB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger()
        tagger.p = shared.value
        for batch in batches:
            for b in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                found = spans_of_texts(b.column(text).to_pylist(), tagger)
                lists = [[[{"kind": k, "start": s, "end": e} for k, s, e in pair[i]] for pair in found] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lists[0], _SPANS), pa.array(lists[1], _SPANS)], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", text).mapInArrow(released(run), T.StructType([docs.schema["doc_id"], T.StructField("base", _SPANS_TYPE), T.StructField("spans", _SPANS_TYPE)]))
