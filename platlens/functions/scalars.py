"""Scalar functions as column expressions; nulls stay null unless a docstring says otherwise."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of true.
TRUE = ("true", "1", "yes", "y", "x")


def recode(c: Column, mapping: Mapping, default=None) -> Column:
    """The mapped value of c, compared trimmed and lower-cased; `default` for other values, null for null."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.lit(default)))


def truthy(c: Column) -> Column:
    """Whether a text says yes; null and everything else is false."""
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE), F.lit(False))


def plain_code(c: Column) -> Column:
    """A code without the .0 that a spreadsheet gave it."""
    return F.regexp_replace(F.trim(c), r"\.0$", "")


def _folded_latin() -> tuple[str, str]:
    """The accented letters of Latin-1 and Latin Extended-A that decompose to a letter, and those letters."""
    pairs = [(chr(i), d[0]) for i in range(0xC0, 0x180) if len(d := unicodedata.normalize("NFD", chr(i))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    """Latin letters without their accents, inside code generation."""
    return F.translate(c, *_folded_latin())


def short_token(c: Column, acronyms: list[str], longest: int = 3) -> Column:
    """Tokens of up to `longest` letters that are no acronym become SHORT."""
    return F.when((F.length(c) <= longest) & ~c.isin(*acronyms), F.lit("SHORT")).otherwise(c)


def tex(c: Column) -> Column:
    """A text with what TeX takes for commands escaped."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\textbackslash "), r"([&%$#_{}])", r"\\$1")


def hms(seconds: Column) -> Column:
    """Whole seconds as h:mm:ss."""
    s = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def thousands(c: Column, decimals: int = 0) -> Column:
    return F.format_number(c, decimals)


def failure_class(error: Column) -> Column:
    """The kind of a failed call by what its message says; other for what is not known, null for no error."""
    low = F.lower(error)
    rules = (("timeout", ("timed out", "timeout")), ("rate", ("rate limit", "429")), ("parse", ("json", "parse")), ("length", ("length", "token")), ("refused", ("refus", "policy")))
    out = F.when(error.isNull(), F.lit(None).cast("string"))
    for name, signs in rules:
        out = out.when(reduce(lambda a, b: a | b, (low.contains(s) for s in signs)), name)
    return out.otherwise("other")


def keyword_list(c: Column, most: int) -> Column:
    """The first `most` entries of a list written with commas."""
    return F.slice(F.split(c, r",\s*"), 1, most)


def angle(x: Column, y: Column) -> Column:
    """The direction of (x, y) in radians, from 0 to a full turn."""
    a = F.atan2(y, x)
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def bessel_i0(x: Column, terms: int = 30) -> Column:
    """The modified Bessel function of order 0 by its power series; good to 1e-9 up to |x| of 12."""
    q = x * x / 4.0
    return reduce(lambda acc, k: F.lit(1.0) + acc * q / float(k * k), range(terms, 0, -1), F.lit(1.0))


def mixed_order(c: Column) -> list[Column]:
    """Sort keys of an id that is a number for some rows: numbers by value first, then texts, nulls last."""
    n = F.when(c.rlike(r"^[0-9]{1,15}$"), c.cast("double"))
    return [c.isNull(), n.isNull(), n, c]
