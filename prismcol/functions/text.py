"""Column helpers for text, numbers and checksums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\r\n"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def trimmed(c: Column) -> Column:
    """Without spaces, tabs and line breaks at both ends."""
    return F.btrim(c, F.lit(SPACES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def whole(pattern: str, ignore_case: bool = False) -> Callable[[Column], Column]:
    """A predicate: the pattern matches the whole value. ``\\z`` is used, as Java's ``$`` lets a final line break pass."""
    full = ("(?i)" if ignore_case else "") + rf"^(?:{pattern})\z"
    return lambda c: c.rlike(full)


def number(c: Column) -> Column:
    """A double where the text is a plain number, else null (a bare cast takes '12d', 'Infinity' and padded text)."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def digit(c: Column, i: int) -> Column:
    """The i-th character, from 1, as an integer; null where it is none."""
    return F.substring(c, i, 1).try_cast("int")


def weighted(c: Column, weights: list[int]) -> Column:
    """The digits from the left, each times its weight, added up."""
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + digit(c, i) * w
    return total


def check_x(c: Column, i: int, lower: bool = True) -> Column:
    """The i-th character as a check digit, where X stands for 10."""
    last = F.substring(c, i, 1)
    return F.when(F.upper(last) == "X", F.lit(10)).otherwise(last.try_cast("int")) if lower else F.when(last == "X", F.lit(10)).otherwise(last.try_cast("int"))


def luhn(c: Column) -> Column:
    return (F.length(c) >= 2) & F.call_function("luhn_check", c)


def fields_between(c: Column, separator: str, ranges: list[tuple[float, float]]) -> Column:
    """As many separated fields as ranges, each a number in its range; one empty field at the end is let go."""
    parts = F.split(F.regexp_replace(c, f"{separator}\\z", ""), separator)
    ok = F.size(parts) == len(ranges)
    for i, (lo, hi) in enumerate(ranges):
        ok = ok & F.coalesce(number(trimmed(F.get(parts, F.lit(i)))).between(lo, hi), F.lit(False))
    return ok


def number_text(v: Column) -> Column:
    """A double as text without a trailing ``.0``."""
    return F.when(v == F.floor(v), F.when(F.abs(v) < 1e15, v.cast("long").cast("string")).otherwise(v.cast("string"))).otherwise(v.cast("string"))
