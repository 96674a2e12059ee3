"""A tolerant date parser as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trimmed
from .vocabulary import MONTHS, WEEKDAYS

MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + ")"
_TIME = r"(?: (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ?([AaPp][Mm]))?)?"
_SEPARATOR = r"(?:[-/.]| ?, ?| )"


def normalised(c: Column) -> Column:
    """Without weekday, ordinal endings, fractions of seconds, offsets and zone names; one space between parts."""
    x = trimmed(c)
    x = F.regexp_replace(x, f"(?i)^(?:{'|'.join(d[:3] for d in WEEKDAYS)})[a-z]*,?\\s+", "")
    x = F.regexp_replace(x, r", (?=[0-9]{1,2}:[0-9]{2})", " ")
    x = F.regexp_replace(x, r"(?i)([0-9]{1,2})(?:st|nd|rd|th)\b", "$1")
    x = F.regexp_replace(x, r"(:[0-9]{2})\.[0-9]+", "$1")
    x = F.regexp_replace(x, r"([0-9])T([0-9])", "$1 $2")
    x = F.regexp_replace(x, r"(:[0-9]{2})\s*[+-][0-9]{2}:?[0-9]{2}\s*\z", "$1")
    x = F.regexp_replace(x, r"([0-9Mm])Z\s*\z", "$1")
    x = F.regexp_replace(x, r"\s+(?!AM\b|PM\b)(?:UTC|GMT|[A-Z]{2,4})\s*\z", "")
    return F.regexp_replace(x, r"\s+", " ")


def _year(text: Column) -> Column:
    y = text.try_cast("int")
    return F.when(F.length(text) == 2, F.when(y < 69, y + 2000).otherwise(y + 1900)).otherwise(y)


def _month(text: Column) -> Column:
    names = "".join(m[:3].lower() for m in MONTHS)
    return F.floor((F.call_function("locate", F.lower(F.substring(text, 1, 3)), F.lit(names)) + 2) / 3).cast("int")


def _date(y: Column, m: Column, d: Column) -> Column:
    """A date where year, month and day make one, else null."""
    return F.when(y.between(1, 9999) & m.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date"))


def parse_date(c: Column) -> Column:
    """The date of a value in any of the orders year-month-day, day-month-year, month-day-year and year-day-month, tried in this order, with numeric or
    English months, and an optional time behind it; null where none fits or the day does not exist.

    A value that begins as an ISO date and goes on with a time at most needs no rewriting and is cast.
    """
    plain = c.rlike(r"^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?:[ T][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?\z")
    return F.when(plain, F.substring(c, 1, 10).try_cast("date")).otherwise(let(normalised(c), _parsed))


def _groups(x: Column, pattern: str, *groups: int) -> Column:
    """The groups of a pattern that matches, as an array, by one more match for all of them."""
    return F.split(F.regexp_replace(x, pattern, "\u0001".join(f"${i}" for i in groups)), "\u0001")


def _parsed(x: Column) -> Column:
    n3 = rf"^(\d{{4}})({_SEPARATOR})(\d{{1,2}})\2(\d{{1,2}}){_TIME}\z"
    dmy = rf"^(\d{{1,2}})({_SEPARATOR})(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_TIME}\z"
    compact = rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_TIME}\z"
    d_mon_y = rf"(?i)^(\d{{1,2}}){_SEPARATOR}({MONTH})\.?{_SEPARATOR}(\d{{4}}|\d{{2}}){_TIME}\z"
    mon_d_y = rf"(?i)^({MONTH})\.?{_SEPARATOR}(\d{{1,2}}){_SEPARATOR}(\d{{4}}|\d{{2}}){_TIME}\z"
    y_mon_d = rf"(?i)^(\d{{4}}){_SEPARATOR}({MONTH})\.?{_SEPARATOR}(\d{{1,2}}){_TIME}\z"
    number = lambda p, i: F.get(p, i).try_cast("int")
    first = F.substring(x, 1, 1)
    digits_only = ~x.rlike("[A-Za-z]")

    def made(pattern: str, groups: tuple[int, ...], body) -> Column:
        return let(_groups(x, pattern, *groups), body)

    numeric = (
        F.when(x.rlike(n3), made(n3, (1, 3, 4), lambda p: F.coalesce(_date(number(p, 0), number(p, 1), number(p, 2)), _date(number(p, 0), number(p, 2), number(p, 1)))))
        .when(x.rlike(dmy), made(dmy, (1, 3, 4), lambda p: F.coalesce(_date(_year(F.get(p, 2)), number(p, 1), number(p, 0)), _date(_year(F.get(p, 2)), number(p, 0), number(p, 1)))))
        .when(x.rlike(compact), made(compact, (1, 2, 3), lambda p: _date(number(p, 0), number(p, 1), number(p, 2))))
    )
    named = (
        F.when(x.rlike(d_mon_y), made(d_mon_y, (1, 2, 3), lambda p: _date(_year(F.get(p, 2)), _month(F.get(p, 1)), number(p, 0))))
        .when(x.rlike(mon_d_y), made(mon_d_y, (1, 2, 3), lambda p: _date(_year(F.get(p, 2)), _month(F.get(p, 0)), number(p, 1))))
        .when(x.rlike(y_mon_d), made(y_mon_d, (1, 2, 3), lambda p: _date(number(p, 0), _month(F.get(p, 1)), number(p, 2))))
    )
    # All begin with a digit or a letter; am and pm are letters too, so a value with letters is tried in all orders.
    return F.when(digits_only, F.when(first.between("0", "9"), numeric)).otherwise(F.coalesce(numeric, named))


def parse_time(c: Column) -> Column:
    """``HH:mm:ss`` of a value's time, 00:00:00 where it has none."""
    p = r"(\d{1,2}):(\d{2})(?::(\d{2}))? ?([AaPp][Mm])?\z"
    x = normalised(c)
    h, m, s, half = (F.regexp_extract(x, p, k) for k in range(1, 5))
    hour = h.try_cast("int")
    hour = F.when((F.lower(half) == "pm") & (hour < 12), hour + 12).when((F.lower(half) == "am") & (hour == 12), 0).otherwise(hour)
    return F.when(h == "", "00:00:00").otherwise(F.format_string("%02d:%02d:%02d", hour, m.try_cast("int"), F.coalesce(s.try_cast("int"), F.lit(0))))
