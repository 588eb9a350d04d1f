"""Numbers, durations, sizes and names as text."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal units.
_UNITS = ["B", "kB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]


def _halves(a: float | Column) -> tuple:
    """Veltkamp's split: two parts of 26 bits that add up to a."""
    c = a * 134_217_729.0
    high = c - (c - a)
    return high, a - high


def _decimals(v: Column, places: int) -> Column:
    """v with `places` decimals as C's printf rounds: the exact binary value, halves to even. For numbers below 1e15."""
    scale = 10.0**places
    a = F.abs(v)
    whole = F.floor(a)
    f = a - whole
    p = f * scale
    (fh, fl), (sh, sl) = _halves(f), _halves(scale)
    error = ((fh * sh - p) + fh * sl + fl * sh) + fl * sl  # f * scale is p + error, exactly
    down = F.floor(p)
    half = p - down
    up = (half > 0.5) | ((half == 0.5) & ((error > 0) | ((error == 0) & (down % 2 == 1))))
    n = down + up.cast("long")
    carried = (n >= int(scale)).cast("long")
    return F.format_string(f"%s%d.%0{places}d", F.when(v < 0, "-").otherwise(""), whole + carried, n - carried * int(scale))


def decimals(v: Column, places: int) -> Column:
    """v with `places` decimals, halves of the exact value to even. Java's format rounds the shortest decimal text of v, halves up."""
    plain = F.format_string(f"%.{places}f", v)
    if not 0 < places <= 15:
        return plain
    p = F.abs(v) * 10.0**places
    # The two can differ only where the shortest text has a 5 behind the last place; near 2^53 that isn't seen in p.
    doubtful = (F.abs(v) < 1e15) & ((p > 1e12) | (F.abs(p % 1 - 0.5) < 0.001))
    return F.when(doubtful, _decimals(v, places)).otherwise(plain)


def trimmed(v: Column, places: int) -> Column:
    """At most `places` decimals, without trailing zeros."""
    return F.regexp_replace(decimals(v.cast("double"), places), r"(\.[0-9]*?)0+$", "$1").cast("string")


def _no_point(text: Column) -> Column:
    return F.regexp_replace(text, r"\.$", "")


def number_text(v: Column) -> Column:
    """Whole numbers below 1e15 without a point, others with at most ten decimals."""
    v = v.cast("double")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, F.format_string("%.0f", v)).otherwise(_no_point(trimmed(v, 10)))


def number_array(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, number_text), ","), F.lit("]"))


def fixed(v: Column, places: int) -> Column:
    return _no_point(trimmed(v, places))


def bytes_text(n: Column) -> Column:
    """Decimal units; one decimal under ten of a unit."""
    n = n.cast("double")
    e = F.least(F.floor(F.log10(F.greatest(n, F.lit(1.0))) / 3 + F.lit(1e-12)), F.lit(len(_UNITS) - 1)).cast("int")
    value = F.floor(n / F.pow(F.lit(1000.0), e) * 10 + 0.5) / 10
    unit = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), e + 1)
    big = F.concat_ws(" ", F.when(value < 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.0f", value)), unit)
    return F.when(n < 10, F.concat(number_text(n), F.lit(" B"))).otherwise(big)


def duration_text(ms: Column, unit: str = "") -> Column:
    """Milliseconds as ns, µs, ms, s, m and h, cut, not rounded; or in one of the units s, ms, us."""
    ms = ms.cast("double")
    if unit:
        factor, sign = {"s": (0.001, "s"), "ms": (1.0, "ms"), "us": (1000.0, "µs")}[unit]
        return F.concat(F.format_string("%.2f", ms * factor), F.lit(sign))
    minutes = F.floor(ms / 60000)
    # The one number that is cut, and its unit: one formatting for every size.
    small = F.when(ms < 0.001, F.floor(ms * 1e6)).when(ms < 1, ms * 1000).when(ms < 1000, ms).otherwise(ms % 60000 / 1000)
    unit_ = F.when(ms < 0.001, F.lit("ns")).when(ms < 1, F.lit("µs")).when(ms < 1000, F.lit("ms")).otherwise(F.lit("s"))
    scale = F.when(ms > 60000, F.lit(1.0)).otherwise(F.lit(100.0))
    ahead = F.when(minutes < 1, F.lit("")).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), (minutes % 60).cast("string"), F.lit("m")))
    return F.when(ms == 0, F.lit("0s")).otherwise(F.concat(ahead, fixed(F.floor(small * scale) / scale, 2), unit_))


def percent_text(share: Column) -> Column:
    """Cut to two decimals."""
    scaled = share.cast("double") * 100 * 100
    return F.concat(F.format_string("%.2f", F.floor(scaled) / 100), F.lit("%"))


def value_text(v: Column, kind: Column, contains: Column, unit: str = "") -> Column:
    """By the kind of metric (`rate`) and what it holds (`data`, `time`, else a plain number)."""
    return F.when(kind == "rate", percent_text(v)).when(contains == "data", bytes_text(v)).when(contains == "time", duration_text(v, unit)).otherwise(fixed(v, 6))


def metric_name(name: Column) -> Column:
    """A sub-metric `a{b}` is shown as `{ b }`."""
    inner = F.regexp_replace(F.regexp_extract(name, r"\{(?s)(.*)", 1), "(?s).$", "")
    return F.when(F.contains(name, F.lit("{")), F.concat(F.lit("{ "), inner, F.lit(" }"))).otherwise(name)


def metric_indent(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("{")), F.lit("  ")).otherwise(F.lit(""))


def escaped(text: Column) -> Column:
    """For HTML and XML; the ampersand first, as the others bring ampersands."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


_ESCAPE = regex.compile(r"\x1b(?:\[[^\x40-\x7e]*(?:[\x40-\x7e]|$)|[^\[\x40-\x5f]*(?:[\x40-\x5a\x5c-\x5f]|$))")


def width_of(text: str | None) -> int | None:
    """Characters that a terminal shows: NFKC, without escape sequences."""
    return None if text is None else len(_ESCAPE.sub("", unicodedata.normalize("NFKC", text)))


def _widths(text: pd.Series) -> pd.Series:
    return text.map(width_of).astype("Int32")


def text_width(text: Column) -> Column:
    """Normalization isn't a built-in function: an Arrow UDF."""
    return F.pandas_udf(_widths, "int")(text)
