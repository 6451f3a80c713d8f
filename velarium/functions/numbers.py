"""Vector and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def scaled_dot(a: Column, b: Column, norms: Column) -> Column:
    """Cosine from the product of the norms; 0 if that is zero."""
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def power_mean(a: Column, p: float = -3.0) -> Column:
    """Power mean over the positive elements; 0 if there are none."""
    pos = F.filter(a, lambda x: x > 0)
    total = F.aggregate(pos, F.lit(0.0), lambda s, x: s + F.pow(x, F.lit(p)))
    return F.when(F.size(pos) == 0, F.lit(0.0)).otherwise(F.pow(total / F.size(pos), F.lit(1.0 / p)))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Between ``low`` and ``high``; null stays null, which ``greatest`` alone would turn into a bound."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def close(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Relative closeness to ``b``; zero only equals zero."""
    return F.when(b == 0, a == 0).otherwise(F.abs(a - b) / F.abs(b) <= tolerance)


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def iteration_penalty(i: Column, most: int) -> Column:
    """1 at the first iteration, falling to 0 after ``most``."""
    return F.greatest(F.lit(0.0), 1.0 - (i - 1) / F.lit(float(most)))


def parse_number(c: Column) -> Column:
    """A number as reports write it: currency, thousands commas, K/M/B/T, percent as hundredths, parentheses for minus; null for other text."""
    t = F.regexp_replace(c, r"^\s+|\s+\z", "")
    negative = t.startswith("(") & t.endswith(")")
    t = F.regexp_replace(F.when(negative, F.regexp_replace(t, r"^\(|\)\z", "")).otherwise(t), r"^(-?)[$€£]+", "$1")
    percent = t.endswith("%")
    t = F.regexp_replace(t, r"%\z", "")
    unit = F.lower(F.regexp_extract(t, r"([KkMmBbTt])\z", 1))
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).when(unit == "t", 1e12).otherwise(1.0)
    t = F.regexp_replace(t, r"[KkMmBbTt]\z", "")
    plain = F.when(t.rlike(r"^[+-]?\d*(,\d{3})*(\.\d*)?([eE][+-]?\d+)?\z") & t.rlike(r"\d"), F.regexp_replace(t, ",", "").try_cast("double")) * scale
    value = F.when(percent, plain / 100.0).otherwise(plain)
    return F.when(negative, -value).otherwise(value)


def numbers_in(c: Column) -> Column:
    """All numbers of a text, commas removed."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(-?\d[\d,]*\.?\d*)"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))


#: Amounts as reports write them: currency, sign, thousands, K/M/B/T, percent, or in parentheses. Fixed value.
_DIGITS = r"\d(?:[\d,]*\d)?\.?\d*(?:[KkMmBb]|[Tt](?![Hh]))?"
AMOUNT = rf"\([$€£]?[-]?{_DIGITS}\)|(?:(?<!\w)-[$€£]|[$€£]?[-]?){_DIGITS}%?"


def amounts_in(c: Column) -> Column:
    """All amounts of a text: parentheses as minus, percent as hundredths, scale letters multiplied; what doesn't parse is left out."""

    def value(x: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(x, r"^\(|\)$", ""), r"^(-?)[$€£]+", "$1")
        unit = F.lower(F.regexp_extract(t, r"([KkMmBbTt])%?$", 1))
        scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).when(unit == "t", 1e12).otherwise(1.0)
        plain = F.regexp_replace(F.regexp_replace(t, r"[KkMmBbTt]?%?$", ""), r",(?=\d{3}(?:[,.]|$))", "").try_cast("double") * scale
        return F.when(x.startswith("("), -plain).when(x.endswith("%"), plain / 100.0).otherwise(plain)

    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(0)), value), lambda x: x.isNotNull())


def distinct_numbers(c: Column) -> Column:
    """Different numbers to four decimals, without zero, in order of appearance."""
    return F.array_distinct(F.filter(F.transform(numbers_in(c), lambda x: F.round(x, 4)), lambda x: x.isNotNull() & (x != 0)))


def number_recall(prediction: Column, gold: Column, tolerance: float = 0.02) -> Column:
    """Share of gold's different numbers, zero left out, that the prediction has within tolerance; 1 without such numbers."""
    plain = lambda c: F.translate(c, "$%", "")
    g, p = distinct_numbers(plain(gold)), numbers_in(plain(prediction))
    hit = F.filter(g, lambda x: F.exists(p, lambda y: F.abs(y - x) / F.abs(x) <= tolerance))
    return F.when(F.size(g) > 0, F.round(F.size(hit) / F.size(g), 4)).otherwise(1.0)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k of ``c`` right answers out of ``n``; 0 if ``k`` exceeds ``n`` or none is right."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda s, i: s * (1.0 - F.lit(float(k)) / i))
    return F.when((F.lit(k) > n) | (c == 0), 0.0).when(n - c < k, 1.0).otherwise(1.0 - product)
