"""The 88 detectors: predicates over text columns, each true, false, or null for null."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.dates import parse_date
from ..functions.text import check_x, digit, fields_between, luhn, trimmed, weighted, whole

Predicate = Callable[[Column], Column]


@dataclass(frozen=True)
class Detector:
    """A predicate with its place in the registry, its four coordinates, and whether it yields to stricter ones in ties."""

    name: str
    index: int
    coordinates: tuple[str, str, str, str]
    loose: bool
    raw: Predicate
    blank_is_null: bool = False

    def __call__(self, c: Column) -> Column:
        known = c.isNotNull() & (trimmed(c) != "") if self.blank_is_null else c.isNotNull()
        return F.when(known, F.coalesce(self.raw(c), F.lit(False)))


REGISTRY: dict[str, Detector] = {}


def register(name: str, coordinates: str, predicate: Predicate, loose: bool = False, blank_is_null: bool = False) -> None:
    """Add a detector, or replace the one of that name. ``coordinates`` are type/subtype/class/format; ``blank_is_null``: it says nothing of blank values."""
    at = REGISTRY[name].index if name in REGISTRY else len(REGISTRY)
    REGISTRY[name] = Detector(name, at, tuple(coordinates.split("/")), loose, predicate, blank_is_null)  # type: ignore[arg-type]


def _words(*lists: list[str]) -> str:
    return "(?:" + "|".join(x for xs in lists for x in xs) + ")"


_MON = _words([f"{m[:3]}(?:{m[3:]})?" for m in V.MONTHS])
_MON3 = _words([m[:3] for m in V.MONTHS])
_DAY = _words([f"{d[:3]}(?:{d[3:]})?" for d in V.WEEKDAYS])
_YEAR = r"(?:19|20)\d{2}"
_STREET = _words(V.STREETS)
_AT = r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}"
_TIME_TAIL = r"(?:\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp][Mm])?)?"


def _between(c: Column, lo: float, hi: float) -> Column:
    return c.try_cast("long").between(lo, hi)


def _state(c: Column) -> Column:
    return F.upper(trimmed(c)).isin([*V.STATE_CODES, *(s.upper() for s in V.STATES)])


def _letters(c: Column, spaces: bool) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(F.lower(trimmed(c)), "[^a-z ]" if spaces else "[^a-z]", ""), " +", " "))


def _city(c: Column) -> Column:
    return _letters(c, True).isin(V.lexicon("us_city"))


def _in_names(c: Column, which: str) -> Column:
    return _letters(c, False).isin(V.lexicon(which))


def _full_name(c: Column) -> Column:
    tokens = F.filter(F.split(trimmed(F.regexp_replace(c, "[.,]", " ")), r"\s+"), lambda t: t != "")
    first, second = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    hit = F.when(c.contains(","), F.coalesce(_in_names(first, "last_name"), F.lit(False)) | F.coalesce(_in_names(second, "first_name"), F.lit(False))).otherwise(_in_names(first, "first_name"))
    return F.size(tokens).between(2, 4) & F.coalesce(hit, F.lit(False))


def _address(c: Column, at_least: int = 3) -> Column:
    flags = [
        c.rlike(rf"(?i)\b\d+\s+[A-Za-z0-9. '-]+\s+{_STREET}\b"),
        c.rlike(r"(?i)\bp\.?\s?o\.?\s?box\b|\bpob\b|\bpost\s?office\s?box\b"),
        c.rlike(rf"(?:,\s*|\s)(?:{'|'.join([*V.STATE_CODES, *V.STATES])})(?:\b|,)"),
        c.rlike(r"\b\d{5}(?:-\d{4})?\b"),
        F.exists(F.split(c, ","), _city),
    ]
    total = F.lit(0)
    for f in flags:
        total = total + F.coalesce(f, F.lit(False)).cast("int")
    return total >= at_least


def _isbn(c: Column) -> Column:
    s = F.regexp_replace(c, "[ -]", "")
    ten = (weighted(s, list(range(10, 1, -1))) + check_x(s, 10)) % 11 == 0
    thirteen = weighted(s, [1, 3] * 6 + [1]) % 10 == 0
    return F.when(s.rlike(r"^\d{9}[0-9Xx]\z"), ten).when(s.rlike(r"^\d{13}\z"), thirteen).otherwise(False)


def _issn(c: Column) -> Column:
    s = F.regexp_replace(c, "-", "")
    return F.when(c.rlike(r"^\d{4}-\d{3}[0-9Xx]\z"), (weighted(s, list(range(8, 1, -1))) + check_x(s, 8)) % 11 == 0).otherwise(False)


def _orcid(c: Column) -> Column:
    s = F.regexp_replace(c, "-", "")
    total = F.lit(0).cast("long")
    for i in range(1, 16):
        total = (total + digit(s, i)) * 2
    return F.when(c.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[0-9Xx]\z"), (12 - total % 11) % 11 == check_x(s, 16)).otherwise(False)


def _dea(c: Column) -> Column:
    d = F.substring(c, 3, 7)
    return F.when(c.rlike(r"^[A-Za-z]{2}\d{7}\z"), weighted(d, [1, 2, 1, 2, 1, 2]) % 10 == digit(d, 7)).otherwise(False)


def _chinese_id(c: Column) -> Column:
    total = weighted(c, [2 ** (18 - i) % 11 for i in range(1, 18)])
    return F.when(c.rlike(r"^\d{17}[0-9Xx]\z"), (12 - total % 11) % 11 == check_x(c, 18)).otherwise(False)


def _ssn(c: Column) -> Column:
    a, g, s = F.substring(c, 1, 3), F.substring(c, 5, 2), F.substring(c, 8, 4)
    return c.rlike(r"^\d{3}-\d{2}-\d{4}\z") & ~a.isin("000", "666") & ~a.startswith("9") & (g != "00") & (s != "0000")


def _wkb(c: Column) -> Column:
    h = F.upper(F.substring(c, 3, 8))
    little = F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))
    kind = F.conv(F.when(F.substring(c, 1, 2) == "01", little).otherwise(h), 16, 10).try_cast("long")
    ok = kind.between(1, 7) | (kind % 1000).between(1, 7) | kind.bitwiseAND(255).between(1, 7)
    return F.when(c.rlike(r"^(?:00|01)[0-9A-Fa-f]{8,}\z") & (F.length(c) % 2 == 0) & (F.length(c) >= 42), ok).otherwise(False)


def _flexible_date(c: Column) -> Column:
    d = parse_date(c)
    return d.isNotNull() & F.year(d).between(1900, 2100)


def _fips(n: int) -> Predicate:
    return lambda c: c.rlike(rf"^\d{{{n}}}\z") & F.substring(c, 1, 2).isin(V.STATE_FIPS)


def _int_range(pattern: str, lo: int, hi: int) -> Predicate:
    return lambda c: c.rlike(rf"^(?:{pattern})\z") & _between(c, lo, hi)


def _clock(c: Column) -> Column:
    p = r"(?i)^(\d{1,2}):(\d{2})(:\d{2})?\s*([AP]M)?\z"
    return c.rlike(p) & F.regexp_extract(c, p, 1).try_cast("int").between(0, 23) & F.regexp_extract(c, p, 2).try_cast("int").between(0, 59)


def _us_date(c: Column) -> Column:
    p = r"^(\d{1,2})/(\d{1,2})/\d{2,4}\z"
    return c.rlike(p) & F.regexp_extract(c, p, 1).try_cast("int").between(1, 12) & F.regexp_extract(c, p, 2).try_cast("int").between(1, 31)


def _iso_date(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.substring(c, 6, 2).try_cast("int").between(1, 12) & F.substring(c, 9, 2).try_cast("int").between(1, 31)


def _tail_state(pattern: str, group: int) -> Predicate:
    return lambda c: c.rlike(pattern) & _state(F.regexp_extract(c, pattern, group))


# Name; coordinates; predicate; loose.
register("currency_code", "categorical/nominal/category/code", lambda c: F.upper(c).isin(V.CURRENCIES))
register("currency_symbol", "number/continuous/currency/currency", whole(r"[$€¥£]\d+(?:\.\d{1,2})?"))
register("currency_code_symbol", "number/continuous/currency/currency", lambda c: c.rlike(r"^[A-Z]{3}[$€¥£]\d+(?:\.\d{1,2})?\z") & F.substring(c, 1, 3).isin(V.CURRENCIES))
register("email", "text/token/email/plain", whole(r"[\p{Alnum}._%+-]+@\p{Alnum}[\p{Alnum}.-]*\.\p{Alpha}{2,}"))
register("url", "text/token/url/plain", whole(r"(?:https?|ftp)://[\p{Alnum}_-]+(?:\.[\p{Alnum}_-]+)+(?:[:/?#]\S*)?", True))
register("ipv4", "text/token/network_address/plain", lambda c: c.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}\z") & fields_between(c, r"\.", [(0, 255)] * 4))
register("ipv6", "text/token/network_address/plain", whole(r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,7}:|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}"))
register("mac", "text/token/network_address/plain", whole(r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}|(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}"))
register("hex_color", "text/token/color/hex", whole(r"#(?:[0-9A-Fa-f]{3}|[0-9A-Fa-f]{6})"))
register("rgb_color", "text/token/color/rgb", lambda c: c.rlike(r"^[0-9, ]+\z") & fields_between(c, ",", [(0, 255)] * 3))
register("hsl_color", "text/token/color/hsl", lambda c: c.rlike(r"^\s*\d{1,3}\s*,\s*\d{1,3}\s*%\s*,\s*\d{1,3}\s*%\s*\z") & fields_between(F.regexp_replace(c, "%", ""), ",", [(0, 360), (0, 100), (0, 100)]))
register("cmyk_color", "text/token/color/cmyk", lambda c: c.rlike(r"^[0-9., ]+\z") & fields_between(c, ",", [(0, 1)] * 4))
register("md5", "identifier/hash_id/record_id/plain", whole(r"[0-9a-fA-F]{32}"))
register("sha1", "identifier/hash_id/record_id/plain", whole(r"[0-9a-fA-F]{40}"))
register("sha256", "identifier/hash_id/record_id/plain", whole(r"[0-9a-fA-F]{64}"))
register("guid", "identifier/text_id/record_id/plain", whole(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"))
register("ensembl_id", "identifier/text_id/entity_id/plain", whole(r"ENS[A-Z]{0,3}[EGTP][0-9]{11}"))
register("uniprot_id", "identifier/text_id/entity_id/plain", whole(r"[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2}"))
register("icd9_code", "categorical/nominal/classification_code/code", whole(r"(?:\d{3}|E\d{3}|V\d{2})(?:\.\d{1,2})?"))
register("icd10_code", "categorical/nominal/classification_code/code", whole(r"[A-Z][0-9]{2}(?:\.[A-Z0-9]{1,4})?"))
register("snp_id", "identifier/text_id/entity_id/plain", whole(r"rs[0-9]+"))
register("asin", "identifier/text_id/administrative_id/plain", whole(r"B0[0-9A-Z]{8}"))
register("bibcode", "identifier/text_id/entity_id/plain", whole(r"[0-9]{4}[A-Za-z0-9.&]{14}[A-Za-z.]"))
register("roman", "categorical/ordinal/ordered_category/roman", lambda c: c.rlike(r"^M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})\z") & (c != ""), True)
register("http_status", "categorical/nominal/category/code", _int_range(r"\d{3}", 100, 599), True)
register("unix_time", "temporal/point/timestamp/epoch", _int_range(r"\d{9,10}", 100_000_000, 9_999_999_999), True)
register("zip_code", "categorical/nominal/geography/code", whole(r"\d{5}(?:-\d{4})?"))
register("uk_postcode", "categorical/nominal/geography/code", whole(r"[A-Za-z]{1,2}[0-9][A-Za-z0-9]? ?[0-9][A-Za-z]{2}"))
register("ca_postal_code", "categorical/nominal/geography/code", whole(r"[A-Za-z][0-9][A-Za-z](?: ?[0-9][A-Za-z][0-9])?"))
register("us_state", "categorical/nominal/geography/code", lambda c: F.upper(c).isin(V.STATE_CODES), True)
register("country_code", "categorical/nominal/geography/code", lambda c: F.upper(c).isin(V.countries()), True)
register("iso_date", "temporal/point/calendar_date/yyyymmdd", _iso_date)
register("iso_datetime", "temporal/point/timestamp/yyyymmddHHiiss", whole(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"))
register("us_date", "temporal/point/calendar_date/mmddyyyy", _us_date)
register("us_datetime", "temporal/point/timestamp/mmddyyyyhhiiA", whole(r"\d{1,2}[/-]\d{1,2}[/-]\d{4}\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:[AP]M)?", True))
register("abbr_month_date", "temporal/point/calendar_date/dMyyyy", whole(rf"\d{{1,2}}[-/]{_MON3}[-/](?:\d{{2}}|\d{{4}})"))
register("rfc2822_datetime", "temporal/point/timestamp/rfc2822", whole(rf"{_DAY},\s+\d{{1,2}}\s+{_MON3}\s+\d{{4}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+(?:GMT|UTC|[+-]\d{{4}})"))
register("long_date", "temporal/point/calendar_date/long", whole(rf"{_DAY},?\s+{_MON}\s+\d{{1,2}}(?:,?\s+\d{{1,4}}(?:\s*(?:BCE|BC|CE|AD))?)?{_TIME_TAIL}|{_MON}\s+\d{{1,2}},?\s+\d{{1,4}}(?:\s*(?:BCE|BC|CE|AD))?{_TIME_TAIL}"))
register("month_year", "temporal/period/month/Myyyy", whole(rf"{_MON},?\s+\d{{4}}"))
register("yyyymm", "temporal/period/month/yyyymm", whole(r"(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])"))
register("month_day", "temporal/point/calendar_date/Md", whole(rf"{_MON}\s+\d{{1,2}}"))
register("clock_time", "temporal/point/time_of_day/hhii", _clock)
register("date_range", "temporal/interval/date_range/range", whole(rf"(?:{_AT})\s+(?:to|-)\s+(?:{_AT})"))
register("hijri_date", "temporal/point/calendar_date/hijri", whole(rf"\d{{1,2}}\s+{_words(V.HIJRI)}\s+\d{{3,4}}"))
register("quarter", "temporal/period/quarter/yyyyQq", whole(rf"(?:FY)?{_YEAR}[- ]?Q[1-4]|Q[1-4][- ]?{_YEAR}", True))
register("day_of_week", "temporal/phase/day_of_week/name", lambda c: whole(_DAY, True)(trimmed(c)), True)
register("month_of_year", "temporal/phase/month_of_year/name", lambda c: whole(_MON, True)(trimmed(c)), True)
register("fiscal_year", "temporal/period/year/FYyyyy", lambda c: whole(r"FY\s?(?:(?:19|20)\d{2}|\d{2})(?:[-/](?:(?:19|20)?\d{2}))?", True)(trimmed(c)))
register("date", "temporal/point/calendar_date/flex", _flexible_date)
register("street_address", "text/line/address/plain", whole(rf"\d+\s+(?:[NSEW]\.?\s+)?[A-Za-z0-9. '-]+\s+{_STREET}\.?", True))
register("po_box", "text/line/address/plain", whole(r"(?:p\.?\s?o\.?\s?box|pob|p\.?o\.?b\.?|post\s?office\s?box)\s*#?\s*\d+", True))
register("city_name", "categorical/nominal/geography/label", _city)
register("city_state", "categorical/nominal/geography/label", _tail_state(r"^\s*(.+?),\s*([A-Za-z. ]{2,})\s*\z", 2))
register("state_zip", "categorical/nominal/geography/label", _tail_state(r"^\s*([A-Za-z. ]{2,}),?\s+(\d{5}(?:-\d{4})?)\s*\z", 1))
register("address", "text/line/address/plain", _address)
register("first_name", "text/line/person_name/plain", lambda c: _in_names(c, "first_name"), True)
register("last_name", "text/line/person_name/plain", lambda c: _in_names(c, "last_name"), True)
register("full_name", "text/line/person_name/plain", _full_name, blank_is_null=True)
register("boolean", "boolean/binary/indicator/true_false", lambda c: F.lower(trimmed(c)).isin(V.BOOLEANS), True)
register("wkt_geometry", "structured/spatial/geometry/wkt", lambda c: c.rlike(r"(?i)^\s*(?:POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|GEOMETRYCOLLECTION)\s*(?:Z|M|ZM)?\s*(?:\(.*\)|EMPTY)\s*\z") & c.rlike(r"(?i)\d|EMPTY\s*\z"))
register("geojson", "structured/spatial/geometry/geojson", lambda c: c.rlike(r"(?s)^\s*\{.*\}\s*\z") & c.rlike(r'"type"\s*:\s*"(?:Point|LineString|Polygon|MultiPoint|MultiLineString|MultiPolygon|GeometryCollection|Feature|FeatureCollection)"') & c.rlike(r'"(?:coordinates|geometry|geometries|features)"\s*:'))
register("wkb", "structured/spatial/geometry/wkb", _wkb)
register("json", "text/block/serialized_text/serialized", lambda c: trimmed(c).rlike(r'(?s)^\{\s*".+"\s*:.*\}\z|^\[.*\]\z'), True)
register("state_fips", "categorical/nominal/geography/code", lambda c: c.isin(V.STATE_FIPS), True)
register("county_fips", "categorical/nominal/geography/code", _fips(5), True)
register("tract_fips", "categorical/nominal/geography/code", _fips(11))
register("block_group_fips", "categorical/nominal/geography/code", _fips(12))
register("block_fips", "categorical/nominal/geography/code", _fips(15))
register("nces_locale", "categorical/nominal/category/code", whole(r"[1-4][1-3]"), True)
register("cbsa", "categorical/nominal/geography/code", lambda c: c.isin(V.lexicon("cbsa")))
register("csa", "categorical/nominal/geography/code", lambda c: c.isin(V.lexicon("csa")))
register("metro_area_name", "categorical/nominal/geography/label", lambda c: F.regexp_replace(F.lower(trimmed(c)), r"\s+", " ").isin(V.lexicon("metro_area")))
register("urban_rural", "categorical/nominal/category/label", lambda c: F.lower(trimmed(c)).isin(V.URBAN_RURAL))
register("census_region", "categorical/nominal/geography/label", lambda c: F.lower(trimmed(c)).isin(V.REGIONS))
register("ssn", "identifier/numeric_id/administrative_id/plain", _ssn)
register("ein", "identifier/numeric_id/administrative_id/plain", lambda c: c.rlike(r"^[0-9]{2}-?[0-9]{7}\z") & ~c.startswith("00") & ~F.regexp_replace(c, "-", "").rlike(r"^(.)\1{8}\z"), True)
register("dea", "identifier/text_id/administrative_id/plain", _dea)
register("chinese_resident_id", "identifier/numeric_id/administrative_id/plain", _chinese_id)
register("uei", "identifier/text_id/administrative_id/plain", whole(r"[A-HJ-NP-Z1-9][A-HJ-NP-Z0-9]{11}"))
register("naics", "categorical/nominal/classification_code/code", lambda c: c.rlike(r"^\d{2,6}\z") & c.isin(V.lexicon("naics")))
register("phone", "text/token/phone/plain", whole(r"(?:\+?1[-. ]?)?(?:\(\d{3}\)[-. ]?|\d{3}[-. ]?)\d{3}[-. ]?\d{4}"), True)
register("intl_phone", "text/token/phone/plain", lambda c: c.rlike(r"^\+\d{1,3}[0-9 ().-]{6,18}\z") & F.length(F.regexp_replace(c, "[^0-9]", "")).between(8, 15), True)
register("msisdn", "text/token/phone/plain", whole(r"\d{10,15}"), True)
register("doi", "identifier/text_id/administrative_id/plain", whole(r"10\.\d{4,9}/\p{Graph}+"))
register("orcid", "identifier/numeric_id/administrative_id/plain", _orcid)
register("isbn", "identifier/numeric_id/administrative_id/plain", _isbn)
register("issn", "identifier/numeric_id/administrative_id/plain", _issn)
register("npi", "identifier/numeric_id/administrative_id/plain", lambda c: c.rlike(r"^\d{10}\z") & luhn(F.concat(F.lit("80840"), c)))
