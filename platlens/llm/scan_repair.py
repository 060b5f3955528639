"""Repair of text that came from scanned pages."""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .words import column, mix64

# What a glyph is taken for by character recognition, (right, seen).
CONFUSIONS = (
    ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("g", "9"), ("b", "8"), ("z", "2"), ("a", "@"), ("e", "c"), ("t", "f"), ("v", "y"),
    ("i", "í"), ("i", "l"), ("ã", "ä"), ("õ", "ö"), ("ç", "ɡ"), ("m", "rn"), ("rn", "m"), ("n", "ri"), ("u", "ii"), ("d", "cl"),
    ("in", "m"), ("ti", "ü"), ("h", "li"), ("w", "vv"), ("q", "g"),
)
#: Strokes that confused glyphs have in common; equal strokes are necessary for a confusion.
_STROKES = {
    "0": "o", "1": "i", "l": "i", "í": "i", "r": "i", "t": "i", "f": "i", "n": "ii", "u": "ii", "ü": "ii", "m": "iii", "d": "ci", "e": "c", "h": "ii",
    "5": "s", "9": "g", "ɡ": "ç", "q": "g", "8": "b", "2": "z", "@": "a", "ä": "ã", "ö": "õ", "y": "v", "w": "vv",
}
HYPHENS = "-‐‑­¬"
_TOKEN = re.compile(r"[^\W_]+(?:@[^\W_]+)*")
_COMPOUND = re.compile(r"[^\W\d_]+(?:[-‐‑][^\W\d_]+)+")
_LINE_HYPHEN = re.compile(rf"[{HYPHENS}]\n[^\S\n]*(?=[^\W_])")
_INNER_HYPHEN = re.compile(rf"[{HYPHENS}][^\S\n]+(?=[^\W_])")
_LAST_TOKEN = re.compile(r"[^\W_]+(?:@[^\W_]+)*$")
_LOOSE_HYPHEN = re.compile(rf"[{HYPHENS}]\s|[­¬]")
_SOFT = re.compile(r"([^\W\d_]+)[­¬]([^\W\d_]+)")
_NUMBER = re.compile(r"^[^\w\n]*(?:(?:p[áaà]g(?:ina)?|p|fls?|page|pg)\b\.?)?\s*[^\w\n.]*\s*(?:\d{1,4}(?:\s*/\s*\d{1,4})?|(?=[ivxl])(?:x{0,4}l?x{0,3}(?:ix|iv|v?i{0,3})))[^\w\n.]*$", re.I)
_EDGE_FIRST = re.compile(r"^\s*\d{1,4}\s+(?=\S)")
_EDGE_LAST = re.compile(r"\s+[|·•\-–—]\s*\d{1,4}\s*$")
_WORD = re.compile(r"[^\W_]+")
_STROKE_TABLE = str.maketrans(_STROKES)
#: Words on either side that count as context, vector length, negative samples of a pair, those that a mini-batch draws for all
#: its pairs, tokens whose pairs a task collects before it trains on them, and types after which it hands on what it has.
WINDOW, DIMENSIONS, NEGATIVES, SHARED, BUFFER, TYPES = 3, 16, 5, 16, 1_000_000, 500_000
#: Frequent words weigh as if they were left out with the usual probability: all above this share of all occurrences.
OFTEN = 1e-4
#: Lengths of the character n-grams that give rare forms a vector, and the table they are hashed to.
GRAMS, GRAM_TABLE = (3, 4, 5), 1 << 15
#: Words and compounds with so many occurrences are known, whatever the input: the dictionary grows with the vocabulary.
LEAST = 8
#: A word is taken for a misread one only if the right one is so many times as frequent.
RATIO = 15
#: A line form is a head line if it recurs within a document and so many of its lines (and this share) bear a page number.
NUMBERED, NUMBERED_SHARE = 2, 0.1
#: It is one, too, if at least this share of the documents with line feeds have it, and at least so many.
FORM_SHARE, LEAST_FORM = 0.008, 3


def strokes(word: str) -> str:
    low = word.lower()
    return (low if low.isascii() else unicodedata.normalize("NFKC", low)).translate(_STROKE_TABLE)


def _steps() -> dict[str, list[tuple[str, str, tuple[tuple[str, str], ...]]]]:
    """Glyph edits by the first letter of what is right: the fixed confusions, and each of them with one of the fixed ones
    applied to what it was taken for (d as cl as c1). A letter read as another plain one does not stack: the result would be
    any ordinary pair of letters."""
    all_steps = {(a, b): ((a, b),) for a, b in CONFUSIONS}
    stacked = [(c, d) for c, d in CONFUSIONS if not (len(c) == len(d) == 1 and "a" <= d <= "z")]
    for a, b in CONFUSIONS:
        for c, d in stacked:
            at = b.find(c)
            while at >= 0:
                all_steps.setdefault((a, b[:at] + d + b[at + len(c) :]), ((a, b), (c, d)))
                at = b.find(c, at + 1)
    out: dict[str, list] = {}
    for (a, b), edits in all_steps.items():
        if a != b:
            out.setdefault(a[0], []).append((a, b, edits))
    return out


_STEPS = _steps()
Edits = tuple[tuple[str, str], ...]


def glyph_edits(right: str, seen: str, costs: dict[tuple[str, str], float] | None = None, most: int = 5) -> tuple[float, Edits] | None:
    """The cheapest glyph edits that turn `right` into `seen` and their cost (one each without `costs`); None if there is
    no way of at most `most` edits."""
    seen = unicodedata.normalize("NFKC", seen) if not seen.isascii() else seen
    n, m = len(right), len(seen)
    best: list[dict[int, tuple[float, Edits]]] = [{} for _ in range(n + 1)]
    best[0][0] = (0.0, ())
    for i in range(n):
        c = right[i]
        for j, (cost, edits) in best[i].items():
            if j < m and seen[j] == c and cost < best[i + 1].get(j + 1, (1e9,))[0]:
                best[i + 1][j + 1] = (cost, edits)
            if len(edits) < most:
                for a, b, own in _STEPS.get(c, ()):
                    if right.startswith(a, i) and seen.startswith(b, j) and len(edits) + len(own) <= most:
                        total = cost + (len(own) if costs is None else sum(costs.get(e, 9.0) for e in own))
                        k = j + len(b)
                        if total < best[i + len(a)].get(k, (1e9,))[0]:
                            best[i + len(a)][k] = (total, edits + own)
    return best[n].get(m)


def explain(right: str, seen: str) -> int | None:
    """The least number of glyph edits that turn `right` into `seen`; None if there is no way."""
    found = glyph_edits(right, seen)
    return None if found is None else len(found[1])


def _tokens(text: str) -> list[str]:
    low = text.lower()
    found = _TOKEN.findall(low)
    if low.isascii() or unicodedata.is_normalized("NFKC", low):
        return found
    return [w if w.isascii() else unicodedata.normalize("NFKC", w) for w in found]


@lru_cache(10_000)
def _names(place: str) -> dict[str, str]:
    """The words of a place's name by their strokes, in order."""
    return {strokes(w): w for w in _WORD.findall(place.lower())}


@lru_cache(10_000)
def _place_strokes(place: str) -> tuple[str, ...]:
    return tuple(strokes(w) for w in _WORD.findall(place))


def _quick_tables() -> tuple[bytes, list[tuple[bytes, bytes]]]:
    """Strokes of the signs of one byte, and those signs that have several strokes with them."""
    one, several = bytearray(range(256)), []
    for i in range(256):
        low = chr(i).lower()
        low = low if len(low) == 1 and ord(low) < 256 else chr(i)
        to = _STROKES.get(low, low)
        if len(to) == 1 and ord(to) < 256:
            one[i] = ord(to)
        else:
            one[i] = ord(low)
            several.append((low.encode("latin-1"), to.encode("latin-1")))
    return bytes(one), sorted(set(several))


_ONE, _SEVERAL = _quick_tables()
_FAR = re.compile("[ﬀ-ﬆɡ]")


def _quick_strokes(text: str) -> bytes | None:
    """Strokes of a text in bytes, other signs than those of one byte alike; None where that could hide a confusion."""
    if not text.isascii() and _FAR.search(text):
        return None
    out = text.encode("latin-1", "replace").translate(_ONE)
    for sign, to in _SEVERAL:
        out = out.replace(sign, to)
    return out


@lru_cache(10_000)
def _place_bytes(place: str) -> bytes | None:
    words = _WORD.findall(place)
    return _quick_strokes(words[0]) if words else None


def named_lines(text: str, place: str | None) -> list[tuple[str, bool]]:
    """The lines of a text, and whether each may name the place, however misread."""
    lines = text.split("\n")
    if not place or not _place_strokes(place):
        return [(x, False) for x in lines]
    where, shapes = _place_bytes(place), _quick_strokes(text)
    if where is None or shapes is None:
        return [(x, True) for x in lines]
    if where not in shapes:
        return [(x, False) for x in lines]
    return [(x, where in y) for x, y in zip(lines, shapes.split(b"\n"))]


def head_form(line: str, place: str | None) -> str | None:
    """The form of a line that may be a page's head line: page numbers off, the document's place and other names and
    numbers as signs, the rest in strokes so that misread ones have the same form. None if it has no place in it."""
    if not place or not 4 <= len(line) <= 120 or line.rstrip()[-1:] in tuple(".!?;…,"):
        return None
    where = list(_place_strokes(place))
    if not where:
        return None
    core = _EDGE_LAST.sub("", _EDGE_FIRST.sub("", line.strip()))
    raw = _TOKEN.findall(core)
    signs = [strokes(w) for w in raw]
    k = len(where)
    at = next((i for i in range(len(signs) - k + 1) if signs[i : i + k] == where), None)
    if at is None or len(signs) > 14:
        return None
    marks = "".join(sorted(set(re.findall(r"[/|·–—()]", core))))
    caps = core.upper() == core
    out = []
    for i, (w, s) in enumerate(zip(raw, signs)):
        if at <= i < at + k:
            out += ["<place>"] if i == at else []
        elif w.isdigit():
            out.append("0")
        elif len(w) == 2 and w.isupper() and i == len(raw) - 1:
            out.append("<state>")
        elif w[:1].isupper() and i and not caps and i == at - 2:
            out.append("<name>")
        elif caps and i == at - 2 and i == 1:
            out.append("<name>")
        else:
            out.append(s)
    return " ".join(out) + marks


def _grams(word: str) -> list[int]:
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode()) % GRAM_TABLE for n in GRAMS for i in range(len(w) - n + 1)] or [zlib.crc32(w.encode()) % GRAM_TABLE]


#: Stands between texts, as a piece of its own.
_END = "\x00"


class SkipGrams:
    """Vectors of the dictionary's words (as words and as context) and of character n-grams, which give any form a vector."""

    def __init__(self, words: list[str], own: np.ndarray, context: np.ndarray) -> None:
        self.at = {w: i for i, w in enumerate(words)}
        self.own, self.context = own, context
        self.grams = np.zeros((GRAM_TABLE, own.shape[1]), dtype=np.float32)
        if not words:
            return
        lists = [_grams(w) for w in words]
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.fromiter((g for x in lists for g in x), dtype=np.int64, count=int(size.sum()))
        order = np.argsort(flat, kind="stable")
        row = np.repeat(np.arange(len(lists)), size)[order]
        flat = flat[order]
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        used = flat[starts]
        degree = np.diff(np.r_[starts, len(flat)]).astype(np.float32)[:, None]
        norm = np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
        wanted = own / norm
        word_starts = np.cumsum(size) - size
        unsorted = np.fromiter((g for x in lists for g in x), dtype=np.int64, count=int(size.sum()))
        for _ in range(10):  # n-grams so that the sum of a word's gives its vector: damped least squares
            left = wanted - np.add.reduceat(self.grams[unsorted], word_starts, axis=0)
            self.grams[used] += np.add.reduceat((left / size[:, None])[row], starts, axis=0) / degree
        self.own = wanted.astype(np.float32)

    def form(self, word: str) -> np.ndarray:
        v = self.grams[_grams(word)].sum(axis=0)
        return v / max(1e-9, float(np.linalg.norm(v)))

    def alike(self, form: str, word: str) -> float:
        i = self.at.get(word)
        return 0.0 if i is None else float(self.own[i] @ self.form(form))

    def fit(self, word: str, near: list[str]) -> float:
        """How well a word fits the words around it."""
        i, ids = self.at.get(word), [k for w in near if (k := self.at.get(w)) is not None]
        return 0.0 if i is None or not ids else float(self.own[i] @ self.context[ids].mean(axis=0))


def _add(m: np.ndarray, seen: np.ndarray, i: np.ndarray, step: np.ndarray, rate: float) -> None:
    """Adds gradient steps to rows of m, each row's rate falling with what it has seen."""
    order = np.argsort(i, kind="stable")
    i = i[order]
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    total, rows = np.add.reduceat(step[order], starts, axis=0), i[starts]
    seen[rows] += (total * total).mean(axis=1)
    m[rows] += rate * total / np.sqrt(seen[rows] + 1e-8)[:, None]


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def train_pairs(u: np.ndarray, v: np.ndarray, seen: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, w: np.ndarray, drawn: np.ndarray, rng: np.random.Generator, rate: float = 0.1, batch: int = 8192) -> None:
    """One pass of skip-gram with negative sampling over weighted pairs (word, context), in mini-batches; drawn are the
    cumulated chances of negatives. Changes u (words) and v (contexts)."""
    order = rng.permutation(len(x))
    for s in range(0, len(order), batch):
        i = order[s : s + batch]
        a, b, n = x[i], y[i], w[i]
        negatives = np.minimum(np.searchsorted(drawn, rng.random(SHARED)), len(drawn) - 1)
        ua, vb, vn = u[a], v[b], v[negatives]
        pull = ((1 - _squash((ua * vb).sum(axis=1))) * n)[:, None]
        push = -_squash(ua @ vn.T) * (n * (NEGATIVES / SHARED))[:, None]
        _add(u, seen[0], a, pull * vb + push @ vn, rate)
        _add(v, seen[1], np.r_[b, negatives], np.r_[pull * ua, push.T @ ua], rate)


class _Numbers(dict):
    """Numbers of values in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class _Trainer:
    """Counts and skip-gram vectors of the words of one task, in one reading of its texts. A word's first vector follows from
    its letters, so that all tasks start alike and their vectors can be averaged by word. Texts are taken as pieces between
    white space; what words a piece holds is looked up once for each different piece."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.pieces, self.at = _Numbers(), _Numbers()
        self.pieces[_END] = 0
        self.met = np.zeros(0, dtype=np.int64)
        self.flat, self.upto = [-1] * WINDOW, [0, WINDOW]
        self.held: list[list[int]] = []
        self.waiting = 0
        self.n = np.zeros(0, dtype=np.int64)
        self.u = self.v = np.zeros((0, DIMENSIONS), dtype=np.float32)
        self.seen = (np.zeros(0, dtype=np.float32), np.zeros(0, dtype=np.float32))

    def add(self, texts: list[str]) -> None:
        for i in range(0, len(texts), 1000):
            own = list(map(self.pieces.__getitem__, f" {_END} ".join(texts[i : i + 1000]).split()))
            self.held += [own, [0]]
            self.waiting += len(own)
            if self.waiting >= BUFFER:
                self.train()

    def compounds(self) -> Iterator[tuple[str, int]]:
        for piece, n in zip(self.pieces, self.met.tolist()):
            if n and any(h in piece for h in "-‐‑"):
                for c in _COMPOUND.findall(piece):
                    yield re.sub("[‐‑]", "-", c.lower()), n

    def _grow(self) -> None:
        old, size = len(self.n), len(self.at)
        more = size - old
        first = np.fromiter((zlib.crc32(w.encode()) for w in list(self.at)[old:]), dtype=np.uint64, count=more)
        bits = mix64(first[:, None] * np.uint64(DIMENSIONS) + np.arange(DIMENSIONS, dtype=np.uint64))
        fresh = ((bits >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - 0.5) / DIMENSIONS
        self.u = np.concatenate([self.u, fresh])
        self.v = np.concatenate([self.v, np.zeros((more, DIMENSIONS), dtype=np.float32)])
        self.n = np.r_[self.n, np.zeros(more, dtype=np.int64)]
        self.seen = tuple(np.r_[x, np.zeros(more, dtype=np.float32)] for x in self.seen)

    def train(self) -> None:
        for piece in list(self.pieces)[len(self.upto) - 1 :]:
            self.flat += map(self.at.__getitem__, _tokens(piece))
            self.upto.append(len(self.flat))
        self._grow()
        own = np.fromiter(chain.from_iterable(self.held), dtype=np.int64, count=sum(map(len, self.held)))
        self.held, self.waiting, size = [], 0, len(self.n)
        self.met = np.r_[self.met, np.zeros(len(self.pieces) - len(self.met), dtype=np.int64)] + np.bincount(own, minlength=len(self.pieces))
        flat, upto = np.array(self.flat, dtype=np.int64), np.array(self.upto, dtype=np.int64)
        length = (upto[1:] - upto[:-1])[own]
        a = flat[np.repeat(upto[own] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        self.n += np.bincount(a[a >= 0], minlength=size)
        pairs = []
        for d in range(1, WINDOW + 1):
            x, y = a[:-d], a[d:]
            ok = np.flatnonzero((x | y) >= 0)
            x, y = x[ok], y[ok]
            pairs.append(np.minimum(x, y) * size + np.maximum(x, y))
        pair, times = np.unique(np.concatenate(pairs), return_counts=True)
        x, y = pair // size, pair % size
        keep = np.minimum(1.0, np.sqrt(OFTEN * self.n.sum() / np.maximum(self.n, 1))).astype(np.float32)
        w = times.astype(np.float32) * keep[x] * keep[y]
        drawn = np.cumsum(self.n**0.75)
        train_pairs(self.u, self.v, self.seen, np.r_[x, y], np.r_[y, x], np.r_[w, w], drawn / drawn[-1], self.rng)

    def hand_on(self, compounds: Counter[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """(words, counts, vectors times counts), and a new start; adds the compounds met."""
        if self.held:
            self.train()
        for c, n in self.compounds():
            compounds[c] += n
        words = list(self.at)
        for k in range(0, len(words), 5000):
            n = self.n[k : k + 5000]
            yield words[k : k + 5000], n, np.c_[self.u[k : k + 5000], self.v[k : k + 5000]] * n[:, None].astype(np.float32)
        self.__init__(int(self.rng.integers(1 << 30)))


class ScanModel:
    """What is known of a collection: its dictionary with skip-gram vectors, its compounds, the forms of its head lines, and
    what each glyph edit costs. `alike` and `near` weigh the likeness of a form's vector and the fit to the words around."""

    def __init__(self, counts: dict[str, int], compounds: frozenset[str], forms: frozenset[str], grams: SkipGrams | None = None, alike: float = 2.0, near: float = 1.0) -> None:
        self.compounds, self.forms, self.grams, self.alike, self.near = compounds, forms, grams, alike, near
        self.costs: dict[tuple[str, str], float] = {}
        self.by_strokes: dict[str, list[tuple[int, str]]] = {}
        for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            self.by_strokes.setdefault(strokes(w), []).append((n, w))
        self.words: dict[str, int] = {}
        for own in self.by_strokes.values():
            for n, w in own:  # a frequent misreading is no word of the dictionary
                least = 2 if _SIGN.search(w) and not _SIGN.search(own[0][1]) else RATIO
                if not any(m >= least * n and explain(v, w) for m, v in own if v != w):
                    self.words[w] = n
        self.learn_costs({})

    def learn_costs(self, seen: dict[tuple[str, str], int]) -> None:
        """Costs of the glyph edits from how often each was met where a rare form has one frequent neighbour only."""
        total = sum(seen.values())
        self.costs = {e: float(np.log((total + len(CONFUSIONS)) / (seen.get(e, 0) + 1))) for e in CONFUSIONS}
        readings: dict[str, list[tuple[float, str]]] = {}
        for (a, b), cost in self.costs.items():
            if len(a) == 1 and _SIGN.fullmatch(b):
                readings.setdefault(b, []).append((cost, a))
        self.signs = str.maketrans({b: min(x)[1] for b, x in readings.items()})
        self._memo: dict[str, tuple[tuple[float, str], ...]] = {}

    def candidates(self, seen: str) -> tuple[tuple[float, str], ...]:
        """Frequent words that a form outside the dictionary may have been, with their scores: glyph edits are plausible and
        cheap, the word is frequent and its vector like that of the form."""
        got = self._memo.get(seen)
        if got is None:
            if len(self._memo) > 300_000:
                self._memo.clear()
            found = []
            if seen not in self.words and not seen.isdigit():
                for n, w in self.by_strokes.get(strokes(seen), ()):
                    if w in self.words and w != seen and (way := glyph_edits(w, seen, self.costs)) and way[1]:
                        found.append((float(np.log(n)) - way[0], w))
                if len(found) > 1 and self.grams is not None:
                    found = [(s + self.alike * self.grams.alike(seen, w), w) for s, w in found]
            got = self._memo[seen] = tuple(sorted(found, key=lambda x: (-x[0], x[1])))
        return got

    def best(self, seen: str, context: list[str]) -> str | None:
        """The candidate with the best score, the fit to the words around it added."""
        found = self.candidates(seen)
        if len(found) < 2 or self.grams is None or not context:
            return found[0][1] if found else None
        return max(found, key=lambda x: (x[0] + self.near * self.grams.fit(x[1], context), x[1]))[1]

    def edits(self, form: str, times: int) -> Iterator[tuple[tuple[str, str], int]]:
        """The glyph edits of a rare form that has one frequent neighbour only."""
        found = self.candidates(form)
        if len(found) == 1:
            for e in glyph_edits(found[0][1], form, self.costs)[1]:
                yield e, times


def _like(seen: str, right: str) -> str:
    """The right word in the case of the one seen."""
    if seen.isupper() and len(seen) > 1:
        return right.upper()
    return right[:1].upper() + right[1:] if seen[:1].isupper() else right


_SIGN = re.compile(r"[\d@]")
_LIGATURE = re.compile("[ﬀ-ﬆ]")
_FIGURE = re.compile(r"\d+\w{0,3}|\w{0,2}\d+|\d+h\d+|[a-z]{1,3}\d+")
_SIGN_INSIDE = re.compile(r"[^\W\d_](?:[0-9](?=[^\W\d_])|@)[^\W\d_]*")
_NO_NAME = re.compile(r"[a-z]?\d.*")


class Repair:
    """Repairs texts by a model. `kinds` of a result: hyphenation, misread, running_header, page_number."""

    def __init__(self, model: ScanModel) -> None:
        self.m = model
        self._right: set[str] = set()
        self._dull: dict[str, list[tuple[str, str]]] = {}

    def _known(self, word: str) -> bool:
        w = unicodedata.normalize("NFKC", word.lower())
        return w in self.m.words or bool(self.m.candidates(w))

    def _own_hyphen(self, a: str, b: str) -> bool:
        """Whether a hyphen between a and b is the word's own: the compound is known, or either part misread."""
        pair = f"{a.lower()}-{b.lower()}"
        if pair in self.m.compounds:
            return True
        x, y = (self.m.best(p.lower(), []) or p.lower() for p in (a, b))
        return f"{x}-{y}" in self.m.compounds

    def furniture(self, text: str, place: str | None) -> tuple[str, set[str], bool]:
        """The text without head lines and page numbers, which of them there were, and whether a head line was misread."""
        kinds: set[str] = set()
        misread = False
        kept = []
        for line, named in named_lines(text, place):
            if len(line) <= 60 and _NUMBER.match(line) and line.strip():
                kinds.add("page_number")
                continue
            form = head_form(line, place) if named else None
            if form is not None and form in self.m.forms:
                kinds.add("running_header")
                core = line.strip()
                if _EDGE_FIRST.match(core) or _EDGE_LAST.search(core):
                    kinds.add("page_number")
                misread |= self.misread_in(core, place)[1]
                continue
            kept.append(line)
        return ("\n".join(kept), kinds, misread) if kinds else (text, kinds, False)

    def hyphens(self, text: str) -> tuple[str, bool]:
        """Words cut at a line end, or where one was, put together."""
        found = False
        if not ("-" in text or "‐" in text or "‑" in text or "­" in text or "¬" in text) or not _LOOSE_HYPHEN.search(text):
            return text, False

        def line_end(a: str, b: str, _: str) -> str | None:
            if a[0].isdigit():
                return None
            if not b[0].isalpha() and not b[0].isdigit() or self._own_hyphen(a, b) or b[0].isupper() and not a.isupper():
                return "-"
            return ""

        def inner(a: str, b: str, hyphen: str) -> str | None:
            if b[0].isupper() and not a.isupper() or a.isdigit() or self._own_hyphen(a, b):
                return None
            if self._known(a + b) or hyphen in "­¬" or a[0].isupper() and a.lower() not in self.m.words and b.lower() not in self.m.words:
                return ""
            return None

        for pattern, decide in ((_LINE_HYPHEN, line_end), (_INNER_HYPHEN, inner)):
            out, at, free = [], 0, 0
            for m in pattern.finditer(text):
                a = _LAST_TOKEN.search(text, max(free, m.start() - 200), m.start())
                if a is None:
                    continue
                b = _TOKEN.match(text, m.end())
                put = decide(a.group(), b.group(), m.group()[0])
                free = b.end()
                if put is not None:
                    found = found or not put
                    out += [text[at : m.start()], put]
                    at = m.end()
            text = "".join(out) + text[at:]
        if "­" in text or "¬" in text:
            soft = _SOFT.sub(r"\1\2", text)
            found, text = found or soft != text, soft
        return text, found

    def _is_dull(self, w: str) -> bool:
        """Whether a form is right, or nothing can be said of it, wherever it stands."""
        if w in self.m.words or len(w) < 2 or w.isdigit():
            return True
        return not _SIGN.search(w) and not self.m.candidates(w)

    def misread_in(self, text: str, place: str | None = None) -> tuple[str, bool]:
        """The text with misread words put right, and whether there were any."""
        left = set(text.split()).difference(self._right)
        if not left:
            return text, False
        names = _names(place) if place else {}
        if len(self._dull) + len(self._right) > 500_000:
            self._dull.clear()
            self._right.clear()
        odd = False
        for piece in left:
            shapes = self._dull.get(piece)
            if shapes is None:
                words = [w for w in _tokens(piece) if w not in self.m.words]
                if not words and not _LIGATURE.search(piece):
                    self._right.add(piece)
                    continue
                if _LIGATURE.search(piece) or not all(map(self._is_dull, words)):
                    odd = True
                    break
                shapes = self._dull[piece] = [(strokes(w), w) for w in words]
            if names and any(names.get(shape, w) != w for shape, w in shapes):
                odd = True
                break
        if not odd:
            return text, False
        found = False
        known = self.m.words
        around: list[tuple[int, str]] = []
        out, at = [], 0
        for m in _TOKEN.finditer(text):
            raw = m.group()
            w = raw.lower()
            if w in known or len(w) < 2 or w.isdigit():
                continue
            right = None
            if not w.isascii():
                w = unicodedata.normalize("NFKC", w)
            if not raw.isascii() and _LIGATURE.search(raw):
                right = self.m.best(w, []) or w
            elif w in known:
                continue
            elif "@" in raw and re.match(r"\.\w", text[m.end() : m.end() + 2]):
                continue  # an address
            elif _SIGN.search(w) and _FIGURE.fullmatch(w) and not (len(w) > 2 and self.m.candidates(w)):
                continue
            else:
                own = names.get(strokes(w)) if names else None
                if own and own != w and explain(own, w):
                    right = own
                elif len(found_for := self.m.candidates(w)) > 1:
                    around = around or [(x.start(), x.group()) for x in _TOKEN.finditer(text.lower())]
                    k = bisect_left(around, (m.start(),))
                    right = self.m.best(w, [x for _, x in (*around[max(0, k - WINDOW) : k], *around[k + 1 : k + 1 + WINDOW])])
                else:
                    right = found_for[0][1] if found_for else None
                if right is None and _SIGN_INSIDE.search(w) and sum(map(str.isalpha, w)) >= 3 and not re.search(r"\d\d", w) and not _NO_NAME.fullmatch(w):
                    right = w.translate(self.m.signs)  # a name: no dictionary word, but signs within letters are none either
                    right = None if right == w else right
            if right is None or right == w and raw.lower() == w:
                continue
            found = True
            out.append(text[at : m.start()])
            out.append(_like(raw, right))
            at = m.end()
        return ("".join(out) + text[at:], True) if found else (text, False)

    def __call__(self, text: str, place: str | None) -> tuple[str, list[str]]:
        """(repaired text, kinds of noise found). The text is reflowed only if it had noise."""
        body, kinds, misread = self.furniture(text, place) if "\n" in text else (text, set(), False)
        body, cut = self.hyphens(body)
        body, wrong = self.misread_in(body, place)
        if cut:
            kinds.add("hyphenation")
        if misread or wrong:
            kinds.add("misread")
        if not kinds:
            return text, []
        paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", body)]
        return "\n\n".join(p for p in paragraphs if p), sorted(kinds)


_WORD_KIND, _COMPOUND_KIND, _FORM_KIND, _LINES_KIND = 0, 1, 2, 3
_SURVEY = pa.schema([("kind", pa.int8()), ("w", pa.string()), ("doc", pa.string()), ("n", pa.int64()), ("numbered", pa.int64()), ("v", pa.list_(pa.float32()))])


def _survey(rows: DataFrame, vectors: bool) -> DataFrame:
    """(kind, w, doc, n, numbered, v) in one pass over the texts: words with their counts and skip-gram vectors, compounds with
    their counts; forms of lines that name the document's place, by document, with how many of them bear a page number; and
    the documents with line feeds. Counted and trained in each task before anything is shuffled; vectors are averaged by how
    often each task met the word, those of words met once in a task count for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Trainer(TaskContext.get().partitionId())
        forms: dict[tuple[str | None, str], list[int]] = {}

        def batch(kind: list[int], w: list, doc: list | None, n, numbered=None, v=None) -> pa.RecordBatch:
            k = len(kind)
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(w, pa.string()), pa.nulls(k, pa.string()) if doc is None else pa.array(doc, pa.string()), pa.array(n, pa.int64()), pa.array([0] * k if numbered is None else numbered, pa.int64()), pa.nulls(k, _SURVEY.field("v").type) if v is None else v], schema=_SURVEY)

        def hand_on() -> Iterator[pa.RecordBatch]:
            compounds: Counter[str] = Counter()
            for w, n, v in words.hand_on(compounds):
                several = np.r_[0, np.cumsum((n > 1) * v.shape[1])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(several), pa.array(v[n > 1].ravel())) if vectors else None
                yield batch([_WORD_KIND] * len(w), w, None, n, v=lists)
            if compounds:
                yield batch([_COMPOUND_KIND] * len(compounds), list(compounds), None, list(compounds.values()))
            if forms:
                w, d = zip(*forms)
                n, numbered = zip(*forms.values())
                yield batch([_LINES_KIND if x is None else _FORM_KIND for x in w], list(w), list(d), list(n), list(numbered))
            forms.clear()

        for b in batches:
            texts = column(b, "t")
            words.add(texts)
            for d, t, p in zip(column(b, "doc"), texts, column(b, "place")):
                if "\n" in t and d is not None:
                    forms.setdefault((None, d), [0, 0])
                    for line, named in named_lines(t, p):
                        if named and (f := head_form(line, p)) is not None:
                            own = forms.setdefault((f, d), [0, 0])
                            own[0] += 1
                            core = line.strip()
                            own[1] += bool(_EDGE_FIRST.match(core) or _EDGE_LAST.search(core))
            if len(words.pieces) + len(forms) > TYPES:
                yield from hand_on()
        yield from hand_on()

    seen = rows.select(F.col("doc").cast("string").alias("doc"), "t", "place").mapInArrow(run, "kind tinyint, w string, doc string, n bigint, numbered bigint, v array<float>")
    some = F.size("v") > 0
    sums = [F.sum(F.when(some, F.get("v", F.lit(k)))).cast("float").alias(f"v{k}") for k in range(2 * DIMENSIONS)] if vectors else []
    merged = seen.groupBy("kind", "w", "doc").agg(F.sum("n").alias("n"), F.sum("numbered").alias("numbered"), F.sum(F.when(some, F.col("n"))).alias("trained"), *sums)
    return merged.withColumn("v", F.when((F.col("kind") == _WORD_KIND) & (F.col("n") >= LEAST) & (F.col("trained") > 0), F.array(*(F.col(f"v{k}") / F.col("trained") for k in range(len(sums)))).cast("array<float>"))).drop("trained", *(f"v{k}" for k in range(len(sums))))


def _rows(df: DataFrame, key: str, doc: str, text: str, place: str | None) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(doc).alias("doc"), F.col(text).alias("t"), (F.col(place) if place else F.lit(None)).cast("string").alias("place")).where("t is not null")


def fit(df: DataFrame, key: str = "chunk_id", doc: str = "doc_id", text: str = "chunk_text", place: str | None = "municipality_name", vectors: bool = True) -> ScanModel:
    """A model of all texts of df: every word and compound with LEAST occurrences (so it grows with the vocabulary), the line
    forms that name the place and recur within some document with page numbers or stand in many documents, skip-gram vectors,
    and costs of glyph edits learnt from all rarer forms that have one frequent neighbour. No bound of it moves with the size
    of the input."""
    rows = _rows(df, key, doc, text, place)
    survey = cut(_survey(rows, vectors))
    kept = survey.where((F.col("kind") <= _COMPOUND_KIND) & (F.col("n") >= LEAST)).select("kind", "w", "n", "v").orderBy("kind", "w").toArrow()
    of: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for kind, w, n in zip(*(kept.column(c).to_pylist() for c in ("kind", "w", "n"))):
        of[kind][w] = n
    trained = kept.filter(kept.column("v").is_valid())
    both = trained.column("v").combine_chunks().flatten().to_numpy().reshape(-1, 2 * DIMENSIONS) if trained.num_rows else np.zeros((0, 2 * DIMENSIONS), np.float32)
    grams = SkipGrams(trained.column("w").to_pylist(), both[:, :DIMENSIONS].copy(), both[:, DIMENSIONS:].copy()) if vectors else None
    lines = survey.where(F.col("kind") == _FORM_KIND).groupBy("w").agg(F.sum("n").alias("n"), F.sum("numbered").alias("numbered"), F.max("n").alias("in_one"), F.count("*").alias("docs"))
    paged = (F.col("in_one") > 1) & (F.col("numbered") >= NUMBERED) & (F.col("numbered") >= NUMBERED_SHARE * F.col("n"))
    widespread = F.col("docs") >= max(LEAST_FORM, FORM_SHARE * survey.where(F.col("kind") == _LINES_KIND).count())
    forms = lines.where(paged | widespread).select("w").toArrow()
    model = ScanModel(of[0], frozenset(of[1]), frozenset(forms.column("w").to_pylist()), grams)
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        for b in batches:
            for w, n in zip(column(b, "w"), column(b, "n")):
                for e, times in sent.value.edits(w, n):
                    seen[e] += times
        if seen:
            a, b = zip(*seen)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(list(seen.values()), pa.int64())], schema=schema)

    rare = survey.where((F.col("kind") == _WORD_KIND) & (F.col("n") < LEAST)).select("w", "n")
    met = rare.mapInArrow(edits, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    model.learn_costs({(r.a, r.b): r.n for r in met})
    return model


def repaired(df: DataFrame, model: ScanModel, key: str = "chunk_id", doc: str = "doc_id", text: str = "chunk_text", place: str | None = "municipality_name", with_text: bool = True) -> DataFrame:
    """One row per row of df with a text: key, text as continuous paragraphs, word_count that fits it, and kinds of noise found.

    Head lines and page numbers are taken out, words cut by a hyphen that is not their own are put together, and forms that are
    no frequent word are replaced by the frequent word that plausible glyph edits explain; of several the one with the cheapest
    edits, most occurrences, the vector most like that of the form (from its character n-grams) and the best fit to the words
    around. A text without noise stays as it is. Null texts are left out; empty ones have no kinds; without a place no head line
    can be told. An empty table gives no rows. Without with_text only key and kinds are handed on.
    """
    rows = _rows(df, key, doc, text, place).select("key", "t", "place")
    schema = rows.select("key", F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("kinds")).schema
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(sent.value)
        for b in batches:
            texts, kinds = [], []
            for t, p in zip(column(b, "t"), column(b, "place")):
                own, found = repair(t, p)
                texts.append(own if with_text else None)
                kinds.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["key", "text", "kinds"])

    done = rows.mapInArrow(run, schema)
    words = F.regexp_count("text", F.lit(r"[^\s\p{Z}\x1c-\x1f\x85]+")).cast("bigint")
    return done.select(F.col("key").alias(key), *([F.col("text").alias(text), words.alias("word_count")] if with_text else []), "kinds")
