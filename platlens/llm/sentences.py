"""Sentence boundaries in texts of any language and script."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .words import column, emit

# Marks that can end a sentence. The first group is ambiguous, the second is not.
WEAK = ".…․‥"
STRONG = "!?‼⁇⁈⁉‽。．｡！？؟۔।॥။៕។።፧᠃᠉։꓿꘎"
# Marks that close what a sentence opened, and pairs of quotation marks and brackets.
CLOSERS = "\"'”’»›」』）)]}】》〉〟"
PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "‹": "›", "《": "》", "(": ")", "（": "）", "[": "]"}
OPENERS = "\"'“‘«‹„「『（([{【《〈¿¡"

_CANDIDATE = re.compile(rf"[{re.escape(WEAK + STRONG)}]+(?:[{re.escape(CLOSERS)}*_]|[\s ](?=[»›”](?:\s|$)))*")
_NEXT = re.compile(r"\S+")
_ITEM = re.compile(r"[\s•●▪*·\-–—(\[§]*(?:\d{1,4}(?:\.\d{1,4})*|[^\W\d_]|[IVXLCivxlc]{1,6})[.)\]]*")
_BREAK = re.compile(r"\n[^\S\n]*\n\s*")
#: A token is looked at within so many characters of a stop; longer ones count as unknown.
REACH = 40


@dataclass
class Seen:
    """Counts of one type over the texts that the model is fitted on."""

    last: int = 0
    inside: int = 0


def _code(kind: str) -> int:
    """The 64-bit hash by which a type is looked up, the same as the JVM's."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(kind.encode("utf-8", "surrogatepass"), seed=42)
    return x - 2**64 if x >= 2**63 else x


class Odds:
    """Log odds of types in two sorted arrays, 16 bytes a type; a type that is not there has 0."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        self.codes, self.values, self.memo = codes, values, {}

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Odds) and np.array_equal(self.codes, other.codes) and np.array_equal(self.values, other.values)

    def __getitem__(self, kind: str) -> float:
        return self.get(kind)

    def __getstate__(self) -> tuple:
        return self.codes, self.values

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def get(self, kind: str, default: float = 0.0) -> float:
        got = self.memo.get(kind)
        if got is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            c = _code(kind)
            i = int(np.searchsorted(self.codes, c))
            got = self.memo[kind] = float(self.values[i]) if i < len(self.codes) and self.codes[i] == c else default
        return got


class TypeTable:
    """Counts of types in sorted arrays: their hash, how often last, how often inside, and whether they are short or have a
    stop inside."""

    def __init__(self, codes: np.ndarray, last: np.ndarray, inside: np.ndarray, short: np.ndarray) -> None:
        order = np.argsort(codes)
        self.codes, self.last, self.inside, self.short = (x[order] for x in (codes, last, inside, short))

    @classmethod
    def of(cls, counts: dict[str, Seen]) -> TypeTable:
        n = len(counts)
        codes = np.fromiter(map(_code, counts), dtype=np.int64, count=n)
        last, inside = (np.fromiter((getattr(s, k) for s in counts.values()), dtype=np.int64, count=n) for k in ("last", "inside"))
        return cls(codes, last, inside, np.fromiter((len(k) <= 4 or "." in k for k in counts), dtype=bool, count=n))

    def get(self, kind: str) -> Seen:
        c = _code(kind)
        i = int(np.searchsorted(self.codes, c))
        return Seen(int(self.last[i]), int(self.inside[i])) if i < len(self.codes) and self.codes[i] == c else Seen()

    def odds(self, base: float, longer: float) -> Odds:
        """Log odds of last against inside, over those of all types, of the types seen twice; longer types need more to tell."""
        some = self.last + self.inside > 1
        weight = np.where(self.short[some], 1.0, longer)
        values = np.log((self.last[some] + weight * base) / (self.inside[some] + weight * (1 - base))) - math.log(base / (1 - base))
        return Odds(self.codes[some], values)


def _no_odds() -> Odds:
    return Odds(np.zeros(0, dtype=np.int64), np.zeros(0))


@dataclass
class BoundaryModel:
    """A maximum-entropy classifier of candidate boundaries, with the type statistics that it reads."""

    ends: Odds = field(default_factory=_no_odds)
    starts: Odds = field(default_factory=_no_odds)
    weights: list[float] = field(default_factory=list)


FEATURES = (
    "bias", "ends", "ends_never", "starts", "starts_x_ends_low", "lower", "upper", "digit", "caseless", "opener", "strong", "exclaims",
    "ellipsis", "single", "inner_stop", "prev_digit", "short", "closed", "glued", "glued_initial", "nothing_before", "next_abbreviated",
)


def _kind(token: str) -> str:
    """A type: the token without digits or what surrounds it; case counts in short ones only (Inc. is not inc.)."""
    token = re.sub(r"\d", "0", token.strip("\"'“”‘’«»‹›„()[]{}「」『』（）*•-–—,;:¿¡"))
    return token if len(token) <= 5 and not (len(token) > 1 and token.isupper()) else token.lower()


def _first(token: str) -> str:
    """The type of a word that may begin a sentence; an initial is not the word of one letter."""
    word = token.lstrip(OPENERS)
    return word[:2] if len(word) > 1 and word[0].isalpha() and word[1] == "." else _kind(token.rstrip(WEAK + STRONG))


def _before(text: str, at: int) -> str:
    piece = text[max(0, at - REACH) : at]
    k = len(piece)
    while k and not piece[k - 1].isspace():
        k -= 1
    return piece[k:]


def _features(m: BoundaryModel, before: str, stop: str, closed: bool, glued: bool, after: str) -> list[float]:
    prev, nxt = _kind(before), after.lstrip(OPENERS)
    a = m.ends.get(prev, 0.0)
    s = m.starts.get(_first(after), 0.0)
    c = nxt[:1]
    strong = any(x in STRONG for x in stop)
    cased = c.isupper() or c.islower()
    letters = sum(x.isalpha() for x in prev)
    return [
        1.0,
        max(-4.0, min(0.5, a + 1.0)),
        float(a < -2.5),
        max(-0.7, min(3.0, s)),
        max(-3.0, min(3.0, s)) * (-2.5 <= a < -0.5),
        float(c.islower()),
        float(c.isupper()),
        float(c.isdigit()),
        float(c.isalpha() and not cased),
        float(nxt != after),
        float(strong and stop[0] not in "!?"),
        float(strong and stop[0] in "!?"),
        float("…" in stop or ".." in stop),
        float(letters == 1 and len(prev) == 1),
        float("." in prev),
        float(prev[-1:].isdigit()),
        float(1 < letters <= 3),
        float(closed),
        float(glued),
        float(glued and len(nxt) > 1 and nxt[0].isalpha() and nxt[1] == "."),
        float(not prev),
        float(nxt[-1:] == "." and len(nxt) > 2 and m.ends.get(_kind(nxt[:-1]), 0.0) < -2.5 and a >= -2.5),
    ]


def _score(m: BoundaryModel, x: list[float]) -> float:
    return sum(w * v for w, v in zip(m.weights, x))


def _possible(text: str, start: int, stop: str, end: int) -> bool:
    """Whether a stop with nothing after it but another character may end a sentence at all."""
    c = text[end]
    if stop[-1] in STRONG and stop[-1] not in "!?":
        return True
    if c in OPENERS:
        return True
    if not c.isalpha() or c.islower() or start == 0:
        return False
    p = text[start - 1]
    return p.islower() or p.isdigit() or p in CLOSERS or (p.isalpha() and not p.isupper()) or len(stop) > 1


def _quotations(text: str) -> list[tuple[int, int]]:
    """Spans of quotations and brackets that are opened and closed, in order of their start."""
    out: list[tuple[int, int]] = []
    n = len(text)
    for o, cs in PAIRS.items():
        i = text.find(o)
        ends = dict.fromkeys(cs, -1)
        while i >= 0 and ends:
            for c in list(ends):
                if ends[c] <= i and (ends.update({c: text.find(c, i + 1)}) or ends[c] < 0):
                    del ends[c]  # it does not occur any more
            if ends:
                out.append((i, min(ends.values())))
            i = text.find(o, i + 1)
    at = [i for i, c in enumerate(text) if c == '"']
    out += zip(at[::2], at[1::2])
    for o, c in (("‘", "’"), ("'", "'")):
        i = text.find(o)
        while i >= 0:
            if (i == 0 or text[i - 1].isspace() or text[i - 1] in OPENERS) and i + 1 < n and not text[i + 1].isspace():
                j = text.find(c, i + 1)
                while j >= 0 and (j + 1 < n and text[j + 1].isalnum() or text[j - 1].isspace()):
                    j = text.find(c, j + 1)
                if j < 0:
                    break  # nothing closes from here on
                out.append((i, j))
                i = j
            i = text.find(o, i + 1)
    return sorted(out)


def _runs_on(text: str, i: int, j: int) -> bool:
    """Whether the sentence round the quotation [i, j] goes on beyond its inner stops."""
    k = i - 1
    while k >= 0 and text[k].isspace():
        k -= 1
    opens = k < 0 or text[k] in WEAK + STRONG or text[k] in CLOSERS
    e = j - 1
    while e > i and text[e].isspace():
        e -= 1
    if not opens or text[e] not in WEAK + STRONG:
        return True
    k = j + 1
    while k < len(text) and (text[k].isspace() or text[k] in CLOSERS):
        k += 1
    return k < len(text) and (text[k].islower() or text[k] in ",;:")


class Splitter:
    """Sentence ends of texts by a fitted model; remembers the contexts already classified."""

    def __init__(self, model: BoundaryModel) -> None:
        self.model, self.memo = model, {}

    def _ends(self, before: str, stop: str, closed: bool, glued: bool, after: str) -> bool:
        key = (before, stop, closed, glued, after)
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[key] = _score(self.model, _features(self.model, before, stop, closed, glued, after)) > 0
        return got

    def ends(self, text: str) -> list[int]:
        """Offsets, in characters, at which the sentences of the text end."""
        if not any(c.isalnum() for c in text):
            return []
        total = len(text.rstrip())
        begins: list[int] | None = None
        reach: list[int] = []
        breaks = [m.start() for m in _BREAK.finditer(text)] if "\n" in text else []
        out: list[int] = []
        begun = 0
        for m in _CANDIDATE.finditer(text):
            i, e = m.span()
            if e >= total:
                break
            raw = m.group()
            stop = raw.rstrip(CLOSERS + "*_  \t\n")
            e = i + len(raw.rstrip())
            if not text[e].isspace():
                if not _possible(text, i, stop, e):
                    continue
                glued, after = True, text[e : e + REACH].split(None, 1)[0]
            else:
                nx = _NEXT.search(text, e)
                glued, after = False, nx.group()[:REACH] if nx else ""
            unit = text[begun:i]
            if _ITEM.fullmatch(unit.strip()) and len(raw) == 1:
                continue
            if not self._ends(_before(text, i), stop, len(raw) > len(stop), glued, after):
                continue
            if begins is None:  # where quotations begin that the sentence round them runs on behind, and how far they reach
                held = [(a, b) for a, b in _quotations(text) if _runs_on(text, a, b)]
                begins, reach = [a for a, _ in held], list(accumulate((b for _, b in held), max))
            k = bisect_left(begins, i)
            if k and reach[k - 1] >= e:
                continue
            if not any(c.isalnum() for c in unit):
                if out:
                    out[-1] = begun = e
                continue
            out.append(e)
            begun = e
        if breaks:
            marks = [len(text[:b].rstrip()) for b in breaks]
            out = sorted({*out, *(k for k in marks if k)})
            kept: list[int] = []
            for k in out:
                if any(c.isalnum() for c in text[kept[-1] if kept else 0 : k]):
                    kept.append(k)
                elif kept:
                    kept[-1] = k
            out = kept
        if out and not any(c.isalnum() for c in text[out[-1] :]):
            out[-1] = total
        elif not out or out[-1] < total:
            out.append(total)
        return out


@dataclass
class TypeCounts:
    """How often types stand before a full stop at the end of texts and inside them, and begin texts or stand inside."""

    stops: dict[str, Seen] = field(default_factory=dict)
    firsts: dict[str, Seen] = field(default_factory=dict)

    def add(self, t: str) -> list[tuple[str, str, bool, bool, str]]:
        """Counts the types of a stripped text that is not empty; gives its stops that have white space after them."""
        spots: list[tuple[str, str, bool, bool, str]] = []
        tokens = t.split()
        for k, w in enumerate(tokens):
            c = w.lstrip(OPENERS)
            if not c[:1].isupper():
                continue
            kind = _first(w)
            own = self.firsts.setdefault(kind, Seen())
            if k == 0:
                own.last += 1
            elif tokens[k - 1][-1].isalnum() and c == w:
                own.inside += 1
        for m in _CANDIDATE.finditer(t):
            i, e = m.start(), m.start() + len(m.group().rstrip())
            stop = m.group().rstrip(CLOSERS + "*_  \t\n")
            before = _before(t, i)
            own = self.stops.setdefault(_kind(before), Seen()) if stop == "." else Seen()
            if e >= len(t):
                own.last += 1
            elif t[e].isspace():
                own.inside += 1
                spots.append((before, stop, e - i > len(stop), False, (_NEXT.search(t, e) or [""])[0][:REACH]))
        return spots


Spot = tuple[str, str, bool, bool, str]


def fit(texts: Iterable[str] = (), steps: int = 40, ridge: float = 0.3, counts: tuple[TypeTable, TypeTable] | None = None, totals: tuple[int, int, int, int] | None = None, spots: dict[Spot, int] | None = None) -> BoundaryModel:
    """A model learnt from unlabelled texts.

    What is known for certain trains it: a stop before a lower-case word, a comma or within a number ends nothing;
    the type before a stop that is often seen within texts and never at their end is an abbreviation; an unambiguous
    mark, or a full stop after a type that does end texts, before a capitalised type that begins texts, is a boundary.
    The texts give the stops that train the weights, and the counts of types before stops and at beginnings; or both come
    from elsewhere, as `spots` with how often each was met, and as `counts`, which may leave out types seen once, with
    `totals` of all: stops last and inside, firsts last and inside.
    """
    own = TypeCounts()
    met = Counter(x for t in texts if t.strip() for x in own.add(t.strip()))
    spots = met if spots is None else spots
    stops, firsts = counts or (TypeTable.of(own.stops), TypeTable.of(own.firsts))
    last, inside, begin, within = totals or (int(getattr(d, k).sum()) for d in (stops, firsts) for k in ("last", "inside"))
    base = min(0.9, max(0.1, last / max(1, last + inside)))
    first = min(0.9, max(0.1, begin / max(1, begin + within)))
    m = BoundaryModel(stops.odds(base, 6.0), firsts.odds(first, 1.0))
    xs: list[list[float]] = []
    ys: list[float] = []
    n: list[float] = []
    for spot, times in spots.items():
        before, stop, _, _, after = spot
        x = _features(m, *spot)
        c, kind = after.lstrip(OPENERS)[:1], _kind(before)
        seen = stops.get(kind)
        y = None
        if c.islower() or after[:1] in ",;:":
            y = 0.0
        elif stop == "." and seen.last == 0 and seen.inside >= 8 and (len(kind) <= 5 or seen.inside >= 60):
            y = 0.0
        elif x[3] > 0.5 and c.isupper() and (stop != "." or seen.last >= 2 and x[1] > -1.5):
            y = 1.0
        elif stop[-1] in STRONG:
            y = 1.0
        if y is not None:
            xs.append(x)
            ys.append(y)
            n.append(math.sqrt(times))
    # Reliable cases that need no corpus: they keep a model of few texts sane.
    for x, y in ((dict(lower=1), 0), (dict(upper=1), 1), (dict(strong=1, caseless=1), 1), (dict(single=1, upper=1, ends=-1.0), 0), (dict(upper=1, exclaims=1), 1), (dict(upper=1, ellipsis=1), 1), (dict(lower=1, exclaims=1), 0), (dict(lower=1, ellipsis=1), 0), (dict(upper=1, inner_stop=1), 0), (dict(glued=1, upper=1), 1), (dict(glued=1, upper=1, glued_initial=1), 0), (dict(strong=1, glued=1, caseless=1), 1), (dict(caseless=1), 1), (dict(caseless=1, short=1, ends=-0.7), 0), (dict(caseless=1, single=1, ends=-0.5), 0), (dict(digit=1), 1), (dict(digit=1, short=1, ends=-1.0), 0), (dict(closed=1, upper=1), 1), (dict(opener=1), 1), (dict(opener=1, upper=1), 1), (dict(upper=1, ends=-4.0, ends_never=1), 0), (dict(digit=1, ends=-4.0, ends_never=1), 0), (dict(upper=1, ends_never=1, ends=-4.0, starts=3.0), 0), (dict(nothing_before=1, lower=1), 0), (dict(upper=1, ends=-1.5, next_abbreviated=1, starts=-1.0, starts_x_ends_low=-1.5), 1), (dict(closed=1, upper=1, starts=-1.0), 1), (dict(upper=1, starts=-1.0), 1), (dict(upper=1, inner_stop=1, next_abbreviated=1, starts=-1.0), 1), (dict(exclaims=1, strong=0, digit=1), 1)):
        xs.append([1.0 if f == "bias" else float(x.get(f, 0)) for f in FEATURES])
        ys.append(float(y))
        n.append(20.0)
    a, y, w = np.array(xs), np.array(ys), np.array(n)
    beta = np.zeros(a.shape[1])
    for _ in range(steps):  # Newton steps of penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (w * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ a + ridge * np.eye(a.shape[1])
        step = np.linalg.solve(h, a.T @ (w * (y - p)) - ridge * beta)
        beta += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    m.weights = beta.tolist()
    return m


def _counted(texts: DataFrame) -> DataFrame:
    """(what, w, last, inside) over the column t: the types before stops, those that begin texts, and the number of texts."""
    schema = pa.schema([("what", pa.string()), ("w", pa.string()), ("last", pa.int64()), ("inside", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hand_on(c: TypeCounts, n: int) -> pa.RecordBatch:
            rows = [(what, k, s.last, s.inside) for what, d in (("stop", c.stops), ("first", c.firsts)) for k, s in d.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, ("texts", "", n, 0)), schema)], schema=schema)

        c, n = TypeCounts(), 0
        for b in batches:
            for t in column(b, "t"):
                n += 1
                if t := t.strip():
                    c.add(t)
            if len(c.stops) + len(c.firsts) > 300_000:
                yield hand_on(c, n)
                c, n = TypeCounts(), 0
        yield hand_on(c, n)

    counted = texts.select("t").mapInArrow(run, "what string, w string, last bigint, inside bigint")
    return counted.groupBy("what", "w").agg(F.sum("last").alias("last"), F.sum("inside").alias("inside"))


def _spots(texts: DataFrame) -> DataFrame:
    """Every stop of the texts in the column t that white space follows, as _features takes it, and how often it was met."""
    schema = pa.schema([("before", pa.string()), ("stop", pa.string()), ("closed", pa.bool_()), ("glued", pa.bool_()), ("after", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for t in column(b, "t") if (own := t.strip()) for x in TypeCounts().add(own)]
            yield from emit(found, schema)

    return texts.mapInArrow(run, "before string, stop string, closed boolean, glued boolean, after string").groupBy(*schema.names).agg(F.count("*").alias("times"))


def fit_on(df: DataFrame, text: str = "chunk_text", sample: int = 40_000, most_spots: int = 400_000) -> BoundaryModel:
    """A model whose types are counted over all different texts without line feed, and whose weights are trained on the stops
    of the `sample` different ones that come first in hash order, at most `most_spots` different stops (documented bounds of
    the classifier).

    Every other step of this module covers all texts. Types seen twice come to the driver as hashes and counts, not as
    strings, and go to the tasks as 16 bytes each; they grow as the vocabulary.
    """
    t = df.select(F.col(text).alias("t")).where(F.col("t").isNotNull() & ~F.col("t").contains("\n")).withColumn("h", F.xxhash64("t"))
    counted = cut(_counted(t.select("t").distinct()))
    of = {r.what: r for r in counted.groupBy("what").agg(F.sum("last").alias("last"), F.sum("inside").alias("inside")).collect()}
    totals = tuple(of[w][k] if w in of else 0 for w in ("stop", "first") for k in ("last", "inside"))
    kept = counted.where((F.col("what") != "texts") & (F.col("last") + F.col("inside") > 1))
    short = (F.length("w") <= 4) | F.col("w").contains(".")
    coded = kept.select((F.col("what") == "stop").alias("stop"), F.xxhash64("w").alias("code"), "last", "inside", short.alias("short")).toArrow()
    is_stop, *columns = (coded.column(k).to_numpy() for k in ("stop", "code", "last", "inside", "short"))
    is_stop = is_stop.astype(bool)
    counts = tuple(TypeTable(*(c[side] for c in columns[:3]), columns[3][side].astype(bool)) for side in (is_stop, ~is_stop))
    n = of["texts"]["last"] if "texts" in of else 0
    if n > 4 * sample:  # only hashes so low that about three times the sample has them need be looked at and ordered
        t = t.where(F.col("h") < F.lit(int(-(2**63) + 2**64 * (3 * sample / n))).cast("bigint"))
    chosen = _spots(t.distinct().orderBy("h", "t").limit(sample).select("t"))
    spot = ["before", "stop", "closed", "glued", "after"]
    rows = chosen.orderBy(F.xxhash64(*spot), *spot).limit(most_spots).toArrow().to_pylist()
    spots = {tuple(r[k] for k in spot): r["times"] for r in sorted(rows, key=lambda r: tuple(r[k] for k in spot))}
    return fit(counts=counts, totals=totals, spots=spots)


def sentence_ends(df: DataFrame, model: BoundaryModel, key: list[str], text: str = "chunk_text") -> DataFrame:
    """For every row with a text: the key columns and `ends`, the offsets at which its sentences end.

    Offsets count characters (code points). A null text, and one without letter or digit, gives an empty list; an
    empty table no rows. A blank line ends a sentence, a single line break does not. Equal rows stay equal rows.
    """
    schema = df.select(*key).withColumn("ends", F.array().cast("array<bigint>")).schema
    sent = df.sparkSession.sparkContext.broadcast(model)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = Splitter(sent.value).ends
        for b in batches:
            found = pa.array([ends(t) if t else [] for t in column(b, "__text")], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(key))), found], names=[*key, "ends"])

    return df.select(*key, F.col(text).alias("__text")).mapInArrow(split, schema)


def sentences(df: DataFrame, model: BoundaryModel, key: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """One row per sentence: key, sentence_no from 0, start_char, end_char and sentence. Nulls as in sentence_ends."""
    ends = sentence_ends(df.select(F.col(key).alias("key"), F.col(text).alias("body")), model, ["key", "body"], "body")
    flat = ends.select("key", "body", F.array_distinct("ends").alias("e")).select("key", "body", "e", F.posexplode("e").alias("sentence_no", "end_char"))
    start = F.when(F.col("sentence_no") == 0, F.lit(0).cast("bigint")).otherwise(F.get(F.col("e"), F.col("sentence_no") - 1))
    raw = F.substring(F.col("body"), (start + 1).cast("int"), (F.col("end_char") - start).cast("int"))
    return flat.select(F.col("key").alias(key), "sentence_no", start.alias("start_char"), "end_char", F.regexp_replace(raw, r"^[\s ]+", "").alias("sentence"))
