"""A small language of transforms, compiled to one Column: ``{{ [strip:$,][as_number] }}`` or ``as_number+dec:2``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.dates import parse_date, parse_time
from ..functions.text import number, number_text, trimmed
from .detectors import REGISTRY

TRUTH = dict.fromkeys("yes y true t 1 on".split(), "TRUE") | dict.fromkeys("no n false f 0 off".split(), "FALSE")  # fixed values


def _keep(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


def _number(x: Column) -> Column:
    return number(F.regexp_replace(F.regexp_replace(x, ",", ""), "[^0-9.eE+-]", ""))


def _money(x: Column) -> Column:
    return number_text(number(F.regexp_replace(F.regexp_replace(x, ",", ""), "[^0-9.-]", "")))


def _filled(x: Column) -> Column:
    return F.nullif(trimmed(x), F.lit(""))


def _is(name: str, x: Column) -> Column:
    return REGISTRY[name](x)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _integer(x: Column) -> Column:
    v = _number(x)
    return _keep(v == F.round(v), number_text(v))


def _isbn(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(trimmed(x), r"\[[0-9]+\]\s*\z", ""), r"^[A-Za-z]{2,}[ :._-]*", "")
    s = F.regexp_replace(s, "[- ]", "")
    return _keep((s != "") & _is("isbn", s), s)


def _full_name(x: Column) -> Column:
    tokens = F.filter(F.split(trimmed(F.regexp_replace(x, "[.,]", " ")), r"\s+"), lambda t: t != "")
    low = F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), "[^a-z]", ""))
    listed = lambda which: F.arrays_overlap(low, F.array(*map(F.lit, V.lexicon(which))))
    turned = F.when(x.contains(","), F.concat(F.slice(tokens, 2, 4), F.slice(tokens, 1, 1))).otherwise(tokens)
    return _keep(F.size(tokens).between(2, 4) & listed("first_name") & listed("last_name"), F.initcap(F.array_join(turned, " ")))


def maps(name: str) -> dict[str, str] | None:
    """The tables of ``lookup:``, from lower-case keys."""
    if name == "usps":
        return {k: v.split()[0] for s, v in V.STATES.items() for k in (s.lower(), v.split()[0].lower())}
    if name == "iso3166":
        return {c.lower(): c for c in V.countries()}
    if name in ("given", "surname", "place", "us_city"):
        return {x: x.title() for x in V.lexicon({"given": "first_name", "surname": "last_name"}.get(name, "us_city"))}
    return None


def _lookup(x: Column, name: str | None) -> Column:
    table = maps(name or "")
    if table is None:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(z) for kv in table.items() for z in kv)), F.lower(trimmed(x)))


def _fixed(x: Column, arg: str | None) -> Column:
    n = re.sub("[^0-9]", "", arg or "2")
    return F.when(_number(x).isNotNull(), F.format_string(f"%.{n}f", _number(x))) if n else F.lit(None).cast("string")


def _matching(pattern: str, form: Callable[[Column], Column] = trimmed) -> Callable[[Column, str | None], Column]:
    return lambda x, a: _keep(form(x).rlike(pattern), form(x))


VERBS: dict[str, Callable[[Column, str | None], Column]] = {
    "as_number": lambda x, a: number_text(_number(x)),
    "as_percent": lambda x, a: number_text(_number(x)),
    "as_integer": lambda x, a: _integer(x),
    "as_rank": lambda x, a: _integer(x),
    "as_probability": lambda x, a: _keep(_number(x).between(-0.001, 1.001), number_text(_number(x))),
    "as_usd": lambda x, a: _money(x),
    "as_euro": lambda x, a: _money(x),
    "as_currency": lambda x, a: _money(x),
    "as_coord": lambda x, a: _keep(F.abs(_number(x)) <= 180, number_text(_number(x))),
    "as_range": lambda x, a: _keep(x.rlike("[0-9].*(?:-|to|,).*[0-9]"), trimmed(x)),
    "as_mmddyyyy": lambda x, a: F.date_format(parse_date(x), "yyyy-MM-dd"),
    "as_datetime": lambda x, a: F.concat(F.date_format(parse_date(x), "yyyy-MM-dd"), F.lit("T"), parse_time(x)),
    "as_yyyy": _matching(r"^(?:1[89]\d{2}|20\d{2})\z"),
    "as_yyyymm": lambda x, a: F.date_format(parse_date(x), "yyyy-MM"),
    "as_quarter": _matching(r"^(?:Q[1-4]-?\d{4}|\d{4}-?Q[1-4])\z", lambda x: F.upper(F.regexp_replace(x, r"\s", ""))),
    "as_clock": _matching(r"^\d{1,2}:\d{2}(?::\d{2})?\s*(?:[AaPp][.]?[Mm][.]?)?\z"),
    "as_email": lambda x, a: _keep(_is("email", F.lower(trimmed(x))), F.lower(trimmed(x))),
    "as_url": lambda x, a: _keep(_is("url", x) | _is("url", F.concat(F.lit("http://"), x)), trimmed(x)),
    "as_ein": lambda x, a: _keep(F.length(_digits(x)) == 9, F.concat(F.substring(_digits(x), 1, 2), F.lit("-"), F.substring(_digits(x), 3, 7))),
    "as_phone": lambda x, a: _keep(F.length(_digits(x)).isin(10, 11), _digits(x)),
    "as_hex": lambda x, a: _keep(_is("hex_color", x), F.upper(trimmed(x))),
    "as_handle": lambda x, a: _keep(trimmed(x).rlike(r"^@?[A-Za-z0-9_.]{2,}\z"), F.regexp_replace(trimmed(x), "^@", "")),
    "as_isbn": lambda x, a: _isbn(x),
    "as_doi": lambda x, a: _keep(_is("doi", F.regexp_replace(F.lower(trimmed(x)), "^doi[: ]*", "")), F.regexp_replace(F.lower(trimmed(x)), "^doi[: ]*", "")),
    "as_orcid": lambda x, a: _keep(_is("orcid", trimmed(x)), trimmed(x)),
    "as_issn": lambda x, a: _keep(_is("issn", trimmed(x)), trimmed(x)),
    "strip": lambda x, a: F.translate(x, a, "") if a else x,
    "dec": _fixed,
    "zeropad5": lambda x, a: _keep(F.length(_digits(x)).between(1, 5), F.lpad(_digits(x), 5, "0")),
    "lookup": _lookup,
    "as_boolean": lambda x, a: F.try_element_at(F.create_map(*(F.lit(z) for kv in TRUTH.items() for z in kv)), F.lower(trimmed(x))),
    "as_full_name": lambda x, a: _full_name(x),
    "split": lambda x, a: _full_name(x),
    **{v: (lambda x, a: x) for v in ("range", "validate", "order")},
    **{v: (lambda x, a: _filled(x)) for v in ("as_id", "as_serial", "none", "as_factor", "as_ordered")},
}


def parse_transform(expression: str) -> list[tuple[str, str | None]]:
    """The steps of an expression: verb and argument."""
    text = expression.strip().removeprefix("{{").removesuffix("}}").strip()
    if text.startswith("["):
        steps = [s.strip() for s in re.findall(r"\[((?:[^\[\]]|\[[^\]]*\])*)\]", text)]
    else:
        steps = [s.strip() for s in text.split("+")]
    out = []
    for s in filter(None, steps):
        verb, _, arg = (m[1], "", m[2]) if (m := re.fullmatch(r"(\w+)\[(.*)\]", s)) else s.partition(":")
        out.append((verb.strip(), arg or None))
    return out


def transform(c: Column, expression: str) -> Column:
    """The value after all steps, null where one fails. An unknown verb or an empty expression gives nulls."""
    steps = parse_transform(expression)
    if not steps or any(verb not in VERBS for verb, _ in steps):
        return F.lit(None).cast("string")
    for verb, arg in steps:
        c = VERBS[verb](c, arg)
    return c


#: Recipes by semantic type, and by type and format where a type has several.
RECIPES = {
    "calendar": "as_mmddyyyy", "timestamp": "as_datetime", "clock": "as_clock", "year": "as_yyyy", "month": "as_yyyymm", "quarter": "as_quarter",
    "measurement": "as_number", "currency": "as_usd", "percent": "as_percent", "probability": "as_probability", "coordinate": "as_coord", "range": "as_range",
    "geographic/us_state": "lookup:usps", "geographic/country_code": "lookup:iso3166", "geographic/zip_code": "zeropad5", "geographic/us_city": "lookup:us_city",
    "administrative/isbn": "as_isbn", "administrative/doi": "as_doi", "administrative/orcid": "as_orcid", "administrative/issn": "as_issn", "administrative/ein": "as_ein",
    "email": "as_email", "url": "as_url", "phone": "as_phone", "color": "as_hex", "indicator": "as_boolean", "person": "as_full_name", "record": "as_id", "nominal": "as_factor",
}


def stabilize(c: Column, semantic_type: str, format_label: str | None = None) -> Column:
    """A value in the stable form of its type; raises for a type or format that is not known."""
    keys = [k for k in RECIPES if k.split("/")[0] == semantic_type]
    if not keys:
        raise ValueError(f"unknown semantic type: {semantic_type}")
    key = next((k for k in keys if format_label is None or k.partition("/")[2] == format_label), None)
    if key is None:
        raise ValueError(f"no format {format_label!r} of {semantic_type}")
    return transform(c, RECIPES[key])


def as_ein(c: Column) -> Column:
    """Padded with zeros to nine characters; longer text stays."""
    s = c.cast("string")
    return F.when(F.length(s) < 9, F.lpad(s, 9, "0")).otherwise(s)


def as_mm(c: Column) -> Column:
    s = c.cast("string")
    return F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)


def as_yyyymm(c: Column) -> Column:
    s = c.cast("string")
    return F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2))
