"""Text statistics of every document, and whether it is running prose."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import column

#: Characters of a piece of a huge document, and the context that a piece sees on either side.
PIECE, CONTEXT = 65_536, 256
#: Partial counts that one task merges at a time.
FAN = 256
#: Common words that are sent to every task at most; more are an error.
MOST_COMMON = 100_000

# Marks that end a sentence, in scripts with and without spaces; what may follow them; signs that may stand before.
_SPACED, _UNSPACED = ".!?…‽؟۔।॥።", "。．｡！？။។"
_CLOSE = ")]\"”’»›」』"
_BEFORE = "%°ºª$" + _CLOSE
_STOP = re.compile(rf"[{_SPACED}]+[{re.escape(_CLOSE)}]*(?=\s|\Z)|[{_UNSPACED}]+[{re.escape(_CLOSE)}]*")
_CLOSED = re.compile(rf"[{_SPACED}{_UNSPACED}][{re.escape(_CLOSE)}]*[ \t]*(?=\n|\Z)")
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"^[^\S\n]*(?:[-*•●▪◦‣–—·☐☑✓]+|\[.?\]|\(?\w{1,3}[.)]|\d+(?:\.\d+)*[.)]?)[^\S\n]+", re.M)
_GAP = re.compile(r" {2,}(?=\S)")
_SPACELESS = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]")
_FOREIGN = re.compile(r"[ɐ-῿Ⰰ-\ud7ff豈-ﷻﹰ-ﻼ]")
_COMBINING = re.compile(r"[̀-ͯऀ-ःऺ-ॏॢॣঁ-ঃ়-্ૢ-ૣา-ฺ็-๎ါ-ှា-៓ً-ٰٟ]")
_ODD = re.compile("[ÃÂ\ufffd]|ï¿½")
_SEEN, _BLANK = "\x1f", "\x1e"
_DIGIT = re.compile(r"\d")
_BLANKS, _WIDE_BLANKS = " \n\t\r\v\f", "\x85\xa0\u2002\u2003\u2009\u2028\u202f\u3000"

COUNTS = ("words", "letters", "digits", "symbols", "lines", "lines_closed", "lines_marked", "common", "sentences", "inner_letters", "prose_letters")
#: What is known of a stretch between two ends: words, letters, common words, cells, marked lines, letters of scripts without
#: spaces, odd characters, letters of other scripts than Latin. All of it adds up.
FRAGMENT = 8
#: Lines of the stretch after the last end: what is known of the line it begins in (length, then a fragment), letters of the
#: whole lines behind that read as prose, what is known of the line it ends in, and whether those two lines differ.
Lines = tuple[list[int], int, list[int], bool]
_NO_LINE = [0] * (FRAGMENT + 1)
NO_LINES: Lines = (_NO_LINE, 0, _NO_LINE, False)


def is_sentence(f: list[int]) -> bool:
    """Whether a closed stretch reads as a sentence: long enough, of plausible words, not laid out in cells or items."""
    words, letters, common, cells, marked, spaceless, odd, foreign = f
    if spaceless * 2 > letters:
        return letters >= 5
    return 3 <= words <= 120 and letters * 2 >= 3 * words and cells <= 1 + words // 25 and marked <= 1 and odd * 20 <= letters and (foreign * 2 > letters or common * 9 >= words)


def loose(line: list[int]) -> int:
    """Letters of an unclosed line if it still reads as prose: long, of many common words, not enumerated; else 0."""
    length, *f = line
    return f[1] if length >= 40 and not f[4] and f[0] >= 9 and f[2] * 5 >= f[0] and f[3] <= 1 and f[6] * 20 <= f[1] else 0


def loose_letters(x: Lines) -> int:
    return loose(x[0]) + x[1] + (loose(x[2]) if x[3] else 0)


def _between(text: str, cut: int) -> int:
    """A cut moved behind what it would break: to the next end of a word before white space, if any is near, else to the
    end of the run of letters and digits."""
    if not 0 < cut < len(text):
        return cut
    near = text[cut - 1 : cut + CONTEXT]
    k = next((i for i in range(1, len(near)) if near[i].isspace() and not near[i - 1].isspace()), 0)
    if not k and (m := _WORD.match(near, 1)) and near[0].isalnum():
        k = m.end()
    return cut + max(k - 1, 0)


class Measure:
    """Partial counts of texts, for a given set of common words."""

    def __init__(self, common: frozenset[str]) -> None:
        self.common, self.alnum = common, 0

    def fragment(self, text: str, foreign: bool, odd: bool) -> list[int]:
        words = _WORD.findall(text)
        self.alnum += len("".join(words))
        other: list[str] = []
        spaceless = 0
        if foreign and _FOREIGN.search(text):  # other scripts may join letters with marks: their words end at white space
            words = [w for w in words if not _FOREIGN.search(w)]
            other = [w for w in text.split() if _FOREIGN.search(w)]
            spaceless = len(_SPACELESS.findall(text))
        known = sum(map(self.common.__contains__, words))
        more = sum(map(len, other))
        cells = text.count("\t") + text.count(";") + text.count("|") + (len(_GAP.findall(text)) if "  " in text else 0)
        return [len(words) + len(other), len("".join(words)) + more, known, cells, 0, spaceless, len(_ODD.findall(text)) if odd else 0, more]

    def lines(self, text: str, foreign: bool, odd: bool) -> Lines:
        """What is known of the lines of an unclosed stretch."""
        alnum, pieces = self.alnum, text.split("\n")
        first = self._line(pieces[0], foreign, odd)
        if len(pieces) == 1:
            out = (first, 0, _NO_LINE, False)
        else:
            inner = sum(loose(self._line(x, foreign, odd)) for x in pieces[1:-1] if len(x) >= 40)
            out = (first, inner, self._line(pieces[-1], foreign, odd), True)
        self.alnum = alnum
        return out

    def _line(self, line: str, foreign: bool, odd: bool) -> list[int]:
        f = self.fragment(line, foreign, odd)
        f[4] = line.count(_SEEN)
        return [len(line), *f]

    def __call__(self, text: str, lead: int = 0, size: int | None = None, last: bool = True) -> tuple[list[int], list[int], list[int], bool, Lines]:
        """Partial counts of text[lead : lead + size], with what lies round it as context only.

        Gives (counts, head, tail, closed, lines): head and tail are the fragments before the first and after the last end
        of a sentence (head alone if there is none, then closed is false); lines are those of the unclosed end. A cut
        within a word is moved, alike for both pieces.
        """
        stop = len(text) if size is None else min(len(text), lead + size)
        lead, stop = _between(text, lead), _between(text, stop)
        whole = not lead and stop == len(text)
        plain = text.isascii()
        foreign = not plain and _FOREIGN.search(text) is not None
        odd = not plain and any(c in text for c in ("Ã", "Â", "\ufffd", "ï¿½"))
        marks = [m for m in _MARK.finditer(text) if lead <= m.start() < stop]
        signed = _MARK.sub(lambda m: _BLANK * (len(m.group()) - 1) + _SEEN, text)  # also marks that begin before this piece
        clean = signed.lower()
        if len(clean) != len(text):  # lower-casing has lengthened a letter
            clean = "".join(c if len(c) == 1 else c[0] for c in map(str.lower, signed))
        own = text if whole else text[lead:stop]
        solid = len(own) - sum(map(own.count, _BLANKS if plain else _BLANKS + _WIDE_BLANKS))
        digits = sum(map(own.count, "0123456789")) if plain else len(_DIGIT.findall(own))
        closed_lines = [m for m in _CLOSED.finditer(text, max(0, lead - CONTEXT)) if lead <= m.end() < stop or (last and m.end() >= len(text))]
        lines = own.count("\n") + (1 if last else 0)
        words = common = sentences = inner = prose = 0
        head: list[int] | None = None
        at, self.alnum = lead, 0
        for m in _STOP.finditer(clean, lead):
            i, e = m.span()
            if i >= stop:
                break
            p = clean[i - 1] if i else " "
            if not (p.isalnum() or p in _BEFORE or not plain and _COMBINING.match(p)):
                continue
            f = self.fragment(clean[at:e], foreign, odd)
            f[4] = clean.count(_SEEN, at, e)
            at = e
            words += f[0]
            common += f[2]
            if head is None:
                head = f
            else:
                sentences += 1
                inner += f[1]
                if is_sentence(f):
                    prose += f[1]
        rest = clean[at:stop] if at < stop else ""
        tail = self.fragment(rest, foreign, odd)
        tail[4] = rest.count(_SEEN)
        words += tail[0] + sum(any(map(str.isalnum, m.group())) for m in marks)
        alnum = self.alnum + sum(sum(map(str.isalnum, m.group())) for m in marks)
        common += tail[2]
        letters = alnum - digits + (0 if plain else len(_COMBINING.findall(own)))
        counts = [words, letters, digits, max(0, solid - digits - letters), lines, len(closed_lines), len(marks), common, sentences, inner, prose]
        lines_of = self.lines(rest, foreign, odd) if not whole or len(rest) >= 40 else NO_LINES
        return (counts, tail, [0] * FRAGMENT, False, lines_of) if head is None else (counts, head, tail, True, lines_of)


def _join(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b)]


def _join_lines(a: Lines, b: Lines) -> Lines:
    if not a[3]:
        return _join(a[0], b[0]), b[1], b[2], b[3]
    if not b[3]:
        return a[0], a[1] + b[1], _join(a[2], b[0]), True
    return a[0], a[1] + loose(_join(a[2], b[0])) + b[1], b[2], True


def merge(a: tuple, b: tuple) -> tuple:
    """Partial counts of two neighbouring stretches of text; associative."""
    counts = _join(a[0], b[0])
    if not a[3] and not b[3]:
        return counts, _join(a[1], b[1]), a[2], False, _join_lines(a[4], b[4])
    if not a[3]:
        return counts, _join(a[1], b[1]), b[2], True, b[4]
    if not b[3]:
        return counts, a[1], _join(a[2], b[1]), True, _join_lines(a[4], b[4])
    f = _join(a[2], b[1])
    for name, more in (("sentences", 1), ("inner_letters", f[1]), ("prose_letters", f[1] if is_sentence(f) else 0)):
        counts[COUNTS.index(name)] += more
    return counts, a[1], b[2], True, b[4]


_STATS = pa.schema([
    ("words", pa.int64()), ("chars", pa.int64()), ("lines", pa.int64()), ("sentences", pa.int64()), ("mean_word_length", pa.float64()), ("symbol_ratio", pa.float64()), ("digit_ratio", pa.float64()),
    ("lines_closed_share", pa.float64()), ("lines_marked_share", pa.float64()), ("common_share", pa.float64()), ("prose_share", pa.float64()), ("is_prose", pa.bool_()),
])
_STATS_SQL = "words bigint, chars bigint, lines bigint, sentences bigint, mean_word_length double, symbol_ratio double, digit_ratio double, lines_closed_share double, lines_marked_share double, common_share double, prose_share double, is_prose boolean"


def statistics(part: tuple, chars: int, least: float) -> tuple:
    """Ratios and the rule's outcome from the counts of a whole document.

    The opening sentence is set aside. Of the rest, the share of letters that stand in sentences decides; an unclosed
    rest counts as prose only where its lines read so. A text of one sentence is prose if that is one.
    """
    counts, head, tail, closed, lines = part
    c = dict(zip(COUNTS, counts))
    opening = head[1]
    unclosed = loose_letters(lines)
    if not closed:  # no sentence ends: prose only if its lines are
        share = unclosed / opening if opening else 0.0
    else:
        rest = c["inner_letters"] + tail[1]
        if rest < 25:
            share = 1.0 if is_sentence(head) else 0.0
        else:
            share = (c["prose_letters"] + min(unclosed, tail[1])) / rest
    word_letters = c["letters"] + c["digits"]
    solid = max(1, word_letters + c["symbols"])
    return (
        c["words"], chars, c["lines"], c["sentences"] + closed, word_letters / max(1, c["words"]), c["symbols"] / solid, c["digits"] / solid,
        c["lines_closed"] / max(1, c["lines"]), c["lines_marked"] / max(1, c["lines"]), c["common"] / max(1, c["words"]), share, share >= least,
    )


def text_quality(df: DataFrame, common_words: DataFrame, doc: str = "doc_id", text: str = "text", least: float = 0.5, piece: int = PIECE) -> DataFrame:
    """One row per row of df: doc and the statistics of its text, whole documents of any length.

    A text of up to `piece` characters is measured where it is read. A longer one is cut into pieces that see CONTEXT
    characters of their neighbours, so that a word or stop at a cut counts once and as what it is; the unfinished
    stretch at either end of a piece is kept apart, and neighbouring pieces are merged, FAN at a time, as in a tree.
    (Words of more than CONTEXT letters at a cut count by what is seen of them.)

    is_prose says whether at least `least` of the letters after the opening sentence stand in sentences. A null, empty
    or blank text has zero counts, null ratios and null is_prose. Rows stay apart if doc repeats or is null, whatever the
    length of their texts. An empty table gives no rows. More than MOST_COMMON common words are an error.
    """
    listed = common_words.select(F.lower("word").alias("w")).where("w is not null").distinct().limit(MOST_COMMON + 1).collect()
    if len(listed) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    known = frozenset(r.w for r in listed)
    base = df.select(F.col(doc).alias("doc"), F.col(text).alias("t"))
    kind = base.schema["doc"].dataType.simpleString()
    doc_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if doc_type == pa.string():
        base, kind = base.withColumn("doc", F.col("doc").cast("string")), "string"
    schema = pa.schema([("doc", doc_type), *_STATS])
    measure = Measure(known)
    blank = (0,) * 4 + (None,) * 8

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(measure(t), len(t), least) if t and not t.isspace() else (blank if t is None else (0, len(t), *blank[2:])) for t in column(b, "t")]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x), type=f.type) for x, f in zip(zip(*rows), _STATS))], schema=schema)

    short = base.where(F.col("t").isNull() | (F.length("t") <= piece)).mapInArrow(whole, f"doc {kind}, {_STATS_SQL}")
    long = base.where(F.length("t") > piece).withColumn("id", F.concat(F.sha2("t", 256), F.when(F.col("doc").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("doc").cast("string")))))
    starts = F.sequence(F.lit(0), F.floor((F.length("t") - 1) / piece).cast("int"))
    cuts = long.select("doc", "id", "t", F.length("t").alias("n"), F.explode(starts).alias("i"))
    lead = F.least(F.col("i") * piece, F.lit(CONTEXT))
    pieces = cuts.select("doc", "id", "i", "n", lead.alias("lead"), F.substring(F.col("t"), (F.col("i") * piece - lead + 1).cast("int"), (lead + piece + CONTEXT).cast("int")).alias("p"))
    part = "doc {k}, id string, i int, n int, counts array<bigint>, head array<bigint>, tail array<bigint>, closed boolean, first array<bigint>, inner bigint, last array<bigint>, broken boolean".format(k=kind)
    part_schema = pa.schema([("doc", doc_type), ("id", pa.string()), ("i", pa.int32()), ("n", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("counts", "head", "tail")), ("closed", pa.bool_()), ("first", pa.list_(pa.int64())), ("inner", pa.int64()), ("last", pa.list_(pa.int64())), ("broken", pa.bool_())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*own[:4], *own[4]) for own in (measure(p, lead, piece, (i + 1) * piece >= n) for p, lead, i, n in zip(column(b, "p"), column(b, "lead"), column(b, "i"), column(b, "n")))]
            if rows:
                own = [pa.array(list(x), type=f.type) for x, f in zip(zip(*rows), list(part_schema)[4:])]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.int32()), b.column(3).cast(pa.int32()), *own], schema=part_schema)

    def merged(final: bool):
        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def give(k, held, copies):
                if final:
                    return pa.RecordBatch.from_pylist([dict(zip(schema.names, (k[0], *statistics(held, k[2], least))))] * copies, schema=schema)
                return pa.RecordBatch.from_pylist([dict(zip(part_schema.names, (k[0], k[1], k[3], k[2], *held[:4], *held[4])))] * copies, schema=part_schema)

            key, held, seen, first, copies = None, None, None, None, 0
            for b in batches:
                for r in b.to_pylist():
                    own = (r["counts"], r["head"], r["tail"], r["closed"], (r["first"], r["inner"], r["last"], r["broken"]))
                    k = (r["doc"], r["id"], r["n"], 0 if final else r["i"] // FAN)
                    if k != key:
                        if key is not None:
                            yield give(key, held, copies)
                        key, held, seen, first, copies = k, own, r["i"], r["i"], 1
                    elif r["i"] != seen:
                        held, seen = merge(held, own), r["i"]
                    elif seen == first:  # the same row again: its result is given so often
                        copies += 1
            if key is not None:
                yield give(key, held, copies)

        return fold

    measured = pieces.repartition("id", "i").mapInArrow(partial, part)
    first = measured.repartition("id", F.floor(F.col("i") / FAN)).sortWithinPartitions("id", "i").mapInArrow(merged(False), part)
    joined = first.repartition("id").sortWithinPartitions("id", "i").mapInArrow(merged(True), f"doc {kind}, {_STATS_SQL}")
    return short.unionByName(joined).withColumnRenamed("doc", doc)
