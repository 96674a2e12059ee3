"""All detectors over values of each type, over columns of the tables, and over variants of both that are mostly no values of the type; and the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators.detectors import REGISTRY

# Some values of each type, separated by |.
VALUES = {
    "currency_code": "AUD|usd|JPY", "currency_symbol": "$12.30|€299.10|£5", "currency_code_symbol": "USD$12.30|EUR€299.10|XXX$1", "email": "cjudgkins0@de.vu|csoutar1@bigcartel.com|a.b+c@x-y.org|@c.de",
    "url": "http://ezproxy.baylor.edu/|https://www.ezproxy.unibo.it/|ftp://a.b:21/x?y#z|www.a.de", "ipv4": "54.219.219.166|49.200.88.156|256.1.1.1|1.2.3|10.0.0.0.", "ipv6": "89a4:e654:d143:d1d0:b986:73e4:c8e1:4710|::1|fe80::1|1::|::ffff:1|1:2",
    "mac": "40-1F-3C-B6-3C-BC|1E:42:64:5E:54:69|40-1F:3C-B6-3C-BC", "hex_color": "#4d9cf8|#fff|4d9cf8|#ffff", "rgb_color": "220,220,220|255, 250 ,250|256,0,0|1,2|1,2,3,", "hsl_color": "195, 100%, 27%|361, 1%, 1%|10,20%,30%", "cmyk_color": "0.0,0.31,0.37,0.0|1.5,0,0,0|0,0,0,1",
    "md5": "6e8a6448a62364225da9991fd8e1ef8c", "sha1": "16de70e8fcd093964a448a86bc89b1c607152ead", "sha256": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "guid": "f2a59360-1d1a-49e8-9a2f-f9cdf0d5a811", "ensembl_id": "ENSMUSG00000102659|ENSG00000102659",
    "uniprot_id": "P33667|P17888|A0A022YWF9", "icd9_code": "078.11|008.8|V10|E950.1|78.1", "icd10_code": "I61|I63.9|Z99.89A", "snp_id": "rs3918290", "asin": "B01L7DYXL0", "bibcode": "2004PASP..116...98K|2003ApJ...597..957H", "roman": "I|II|XIV|MMXX|IIII|MCMXC|ABC",
    "http_status": "100|404|99|600", "unix_time": "1513036980|99999999|9999999999", "zip_code": "98052|15206-1234|9805", "uk_postcode": "SA43 2BU|PO122DU|M1 1AA", "ca_postal_code": "V5K|K0H 1A0|K0H1A0", "us_state": "WA|oh|ZZ|DC", "iso_date": "2016-03-15|2016-13-15|2016-02-31|2016-00-10",
    "iso_datetime": "1987-02-06T06:00:37|1988-01-12T06:34:58.123Z|1988-01-12T06:34:58+0100", "us_date": "3/3/16|1/27/16|13/1/16|12/32/2016|1/1/2016", "us_datetime": "2/6/1987 6:00:37 AM|1-12-1988 6:34", "abbr_month_date": "1-Jul-14|2/Jul/2014|1-jul-14", "rfc2822_datetime": "Fri, 06 Feb 1987 06:00:37 GMT|Tue, 12 Jan 1988 06:34:58 +0100",
    "long_date": "Friday, June 16, 1967|June 9, 1955|Mon Jan 1|June 9|June 9, 44 BC 10:30 PM", "month_year": "February 1987|Feb, 1988", "yyyymm": "201912|201913|189912", "month_day": "February 6|Jan 12", "clock_time": "6:00:37 AM|23:59|24:00|6:60", "date_range": "07/21/16 to 08/19/16|2016-01-01 - 2016-02-01",
    "hijri_date": "11 Shawwal 1430|5 Muharram 1300|5 March 1300", "quarter": "2019Q1|Q4-2020|FY2019 Q3|2019Q5", "day_of_week": "Monday|tue|Mo", "month_of_year": "January|feb|Janu", "fiscal_year": "FY2019|FY19-20|FY2019/2020|2019", "street_address": "2325 140th St|303 Aspen Ct|1 N. Main Street.|Aspen Ct",
    "po_box": "PO Box 1234|P.O. Box 56|post office box #7|Box 5", "city_name": "Chicago|new orleans|Nowhere", "city_state": "Bloomington, IN|Cheshire, Connecticut|Bloomington, ZZ", "state_zip": "IN 47401|CT, 06410-1234|New York 10001|ZZ 47401", "address": "1225 S Walnut St, Bloomington, IN 47401|30 Grandview Ct, Cheshire, CT 06410|PO Box 5, Tulsa, OK 74101|12 Main St, Nowhere", "first_name": "James|mary|Xqz", "last_name": "Smith|johnson|O'Brien",
    "full_name": "John Smith|Smith, Mary|Mary A. Jones|Xqz Abc|A B C D E", "boolean": "true|N|1|maybe", "wkt_geometry": "POINT (30 10)|POLYGON EMPTY|POINT Z (1 2 3)|POINT|POINT (a)", "geojson": '{"type":"Point","coordinates":[30,10]}|{"type": "Feature", "geometry": null}|{"type":"Point"}', "json": '{"a":1,"b":2}|[1]|{}|{"a"}',
    "state_fips": "06|36|03|72", "county_fips": "06037|36061|03001", "tract_fips": "06037206200", "block_group_fips": "060372062001", "block_fips": "060372062001001", "nces_locale": "11|43|14|51", "cbsa": "10100|10140|99999", "csa": "101|220|999", "metro_area_name": "Aberdeen, SD|Abilene,  TX|Nowhere, TX",
    "urban_rural": "Urban|rural|sea", "census_region": "Northeast|pacific|north", "ssn": "540-39-4268|518-07-5084|000-12-3456|900-12-3456|123-00-1234|666-12-3456|123-45-0000", "ein": "15-4464349|589042990|00-1234567|111111111", "dea": "AP5836727|BJ6125341|AP5836728", "chinese_resident_id": "141002197808194474|431026197506218370|11010519491231002X",
    "uei": "ZQGGHJH74DW7|R7KZ8N2QP4M5|0QGGHJH74DW7", "naics": "11|236|00|541511", "phone": "510-577-3201|(309) 647-1820|+1 510.577.3201|5105773201|12345", "intl_phone": "+1-4250013981|+61 3 6216 0864|14250013981", "msisdn": "919961345678|13109976224|123", "doi": "10.1109/ICDCSW.2017.43|10.1109/IRI.2016.84|11.1/x",
    "orcid": "0000-0002-0488-8591|0000-0002-6390-6569|0000-0002-1694-233X", "isbn": "140955525-9|038027303-9|0-8044-2957-X|978-0-306-40615-7", "issn": "0001-2092|0001-253X", "npi": "1225155880|1649397217", "wkb": "0101000000000000000000f03f000000000000f03f|00000000013ff00000000000003ff0000000000000|0109000000000000000000f03f000000000000f03f",
    "none": "| |.|n/a|x y",
}
#: Columns of the tables whose distinct values are tried too, as SQL of both engines.
COLUMNS = [
    ("nation", "n_name"), ("customer", "c_name"), ("customer", "c_mktsegment"), ("part", "p_type"), ("orders", "substring(cast(o_orderdate as string), 1, 10)"), ("orders", "concat(substring(cast(o_orderdate as string), 6, 2), '/', substring(cast(o_orderdate as string), 9, 2), '/', substring(cast(o_orderdate as string), 1, 4))"),
    ("customer", "concat(lpad(cast(c_custkey * 7 % 1000 as string), 3, '0'), '-', lpad(cast(c_custkey % 100 as string), 2, '0'), '-', lpad(cast(c_custkey * 13 % 10000 as string), 4, '0'))"), ("nation", "cast(1000000000 + n_nationkey * 7919 as string)"), ("pages", "url"), ("events", "event_type"), ("customer", "concat(lpad(cast(c_custkey as string), 4, '0'), '-', lpad(cast(c_custkey * 17 % 10000 as string), 4, '0'))"),
]
#: What is made of each value, in the same words in both engines.
VARIANTS = ["v", "upper(v)", "lower(v)", "concat(v, chr(10))", "concat(' ', v)", "substring(v, 2)", "substring(v, 1, length(v) - 1)", "concat(v, '0')", "translate(v, '0123456789', '1234567890')", "replace(v, '-', '/')", "replace(v, ' ', '')"]


def _typed() -> list[str]:
    return sorted({x for xs in VALUES.values() for x in xs.split("|")})


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v``: each value to be tried, once."""
    out = spark.createDataFrame([(x,) for x in _typed()], "v string")
    for t, e in COLUMNS:
        out = out.unionByName(spark.read.parquet(f"{sf_dir}/{t}.parquet").selectExpr(f"{e} as v"))
    out = out.where("v is not null").distinct()
    return out.select(F.explode(F.array(*map(F.expr, VARIANTS))).alias("v")).distinct()


def detect_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``data_type, n, hits, digest`` for each detector: how many probes it accepts, and a sum of their digests, which tells sets apart."""
    tried = probes(spark, sf_dir).withColumn("h", F.conv(F.substring(F.md5("v"), 1, 8), 16, 10).cast("long"))
    verdicts = F.array(*(F.struct(F.lit(name).alias("data_type"), REGISTRY[name](F.col("v")).alias("hit")) for name in RULES))
    rows = tried.select("h", F.inline(verdicts))
    return rows.groupBy("data_type").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("h"))), F.lit(0).cast("long")).alias("digest"))


# ---- the rules in SQL --------------------------------------------------------------------------------------------------


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _full(pattern: str, options: str = "", of: str = "v") -> str:
    return f"regexp_full_match({of}, {_q(pattern)}{', ' + _q(options) if options else ''})"


def _any(terms) -> str:
    return "(" + ", ".join(map(_q, terms)) + ")"


_TRIM = "trim(v, ' ' || chr(9) || chr(10) || chr(13))"
_MON = "(?:" + "|".join([*(m for m in V.MONTHS), *(m[:3] for m in V.MONTHS)]) + ")"
_MON3 = "(?:" + "|".join(m[:3] for m in V.MONTHS) + ")"
_DAY = "(?:" + "|".join([*V.WEEKDAYS, *(d[:3] for d in V.WEEKDAYS)]) + ")"
_ERA = r"(?:\s*(?:BCE|BC|CE|AD))?"
_TIME = r"(?:\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp][Mm])?)?"
_STATES = _any([*V.STATE_CODES, *(s.upper() for s in V.STATES)])
_HEX4 = "[0-9a-fA-F]{1,4}"


def _digit(s: str, i: int) -> str:
    return f"try_cast(substr({s}, {i}, 1) as bigint)"


def _check(s: str, i: int) -> str:
    return f"(case when upper(substr({s}, {i}, 1)) = 'X' then 10 else {_digit(s, i)} end)"


def _sum(s: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * {_digit(s, i)}" for i, w in enumerate(weights, 1)) + ")"


def _fields(cleaned: str, n: int, tests: list[str]) -> str:
    """``n`` fields that commas (or points) cut, an empty last one let go, each a plain number in its range."""
    parts = f"string_split(regexp_replace({cleaned}, ',$', ''), ',')"
    checks = [f"regexp_full_match(trim(({parts})[{i + 1}]), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') and try_cast(trim(({parts})[{i + 1}]) as double) {t}" for i, t in enumerate(tests)]
    return f"len({parts}) = {n} and " + " and ".join(checks)


def _month_day(month: str, day: str) -> str:
    return f"coalesce(try_cast({month} as int) between 1 and 12 and try_cast({day} as int) between 1 and 31, false)"


_NO_DASH = "replace(v, '-', '')"
_ISBN = "replace(replace(v, '-', ''), ' ', '')"
_ORCID_SUM = "0"
for _i in range(1, 16):
    _ORCID_SUM = f"(({_ORCID_SUM} + {_digit(_NO_DASH, _i)}) * 2)"
_NPI = "('80840' || v)"
_LUHN = " + ".join(f"(case when 2 * {_digit(_NPI, i)} > 9 then 2 * {_digit(_NPI, i)} - 9 else 2 * {_digit(_NPI, i)} end)" if i % 2 == 0 else _digit(_NPI, i) for i in range(1, 16))
_NAME = "regexp_replace(lower({}), '[^a-z]', '', 'g')"
_CITY = "trim(regexp_replace(regexp_replace(lower(trim({})), '[^a-z ]', '', 'g'), ' +', ' ', 'g'))"
_TOKENS = "list_filter(string_split(regexp_replace(regexp_replace(v, '[.,]', ' ', 'g'), '\\s+', ' ', 'g'), ' '), lambda t: t <> '')"
_WKB_KIND = "try_cast('0x' || case when substr(v, 1, 2) = '01' then substr(v, 9, 2) || substr(v, 7, 2) || substr(v, 5, 2) || substr(v, 3, 2) else substr(v, 3, 8) end as bigint)"


def _fips(n: int) -> str:
    return f"{_full(f'[0-9]{{{n}}}')} and substr(v, 1, 2) in {_any(V.STATE_FIPS)}"


#: For each detector, when it accepts ``v``. The flexible date and the country codes are those of the Java runtime and have none.
RULES = {
    "currency_code": f"upper(v) in {_any(V.CURRENCIES)}",
    "currency_symbol": _full(r"[$€¥£][0-9]+(\.[0-9]{1,2})?"),
    "currency_code_symbol": f"{_full(r'[A-Z]{3}[$€¥£][0-9]+(\.[0-9]{1,2})?')} and substr(v, 1, 3) in {_any(V.CURRENCIES)}",
    "email": _full(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"),
    "url": _full(r"(https?|ftp)://[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+([:/?#][^\s]*)?", "i"),
    "ipv4": _full(r"[0-9]{1,3}(\.[0-9]{1,3}){3}") + " and list_max(list_transform(string_split(v, '.'), lambda x: try_cast(x as int))) <= 255",
    "ipv6": " or ".join([_full(f"({_HEX4}:){{7}}{_HEX4}"), _full(f"::({_HEX4}:){{0,6}}{_HEX4}"), _full(f"({_HEX4}:){{1,7}}:"), _full(f"({_HEX4}:){{1,6}}:{_HEX4}")]),
    "mac": _full("([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}") + " or " + _full("([0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}"),
    "hex_color": "v[1] = '#' and length(v) in (4, 7) and " + _full("[0-9A-Fa-f]+", of="substr(v, 2)"),
    "rgb_color": _full("[0-9, ]+") + " and " + _fields("v", 3, ["between 0 and 255"] * 3),
    "hsl_color": _full(r"\s*[0-9]{1,3}\s*,\s*[0-9]{1,3}\s*%\s*,\s*[0-9]{1,3}\s*%\s*") + " and " + _fields("regexp_replace(replace(v, '%', ''), '\\s', '', 'g')", 3, ["between 0 and 360", "between 0 and 100", "between 0 and 100"]),
    "cmyk_color": _full("[0-9., ]+") + " and " + _fields("v", 4, ["between 0 and 1"] * 4),
    "md5": "length(v) = 32 and " + _full("[0-9a-fA-F]+"),
    "sha1": "length(v) = 40 and " + _full("[0-9a-fA-F]+"),
    "sha256": "length(v) = 64 and " + _full("[0-9a-fA-F]+"),
    "guid": "length(v) = 36 and " + _full("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    "ensembl_id": _full("ENS[A-Z]{0,3}[EGTP][0-9]{11}"),
    "uniprot_id": _full("[OPQ][0-9][A-Z0-9]{3}[0-9]") + " or " + _full("[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2}"),
    "icd9_code": _full(r"([0-9]{3}|E[0-9]{3}|V[0-9]{2})(\.[0-9]{1,2})?"),
    "icd10_code": _full(r"[A-Z][0-9]{2}(\.[A-Z0-9]{1,4})?"),
    "snp_id": "v[1:2] = 'rs' and " + _full("[0-9]+", of="substr(v, 3)"),
    "asin": "v[1:2] = 'B0' and length(v) = 10 and " + _full("[0-9A-Z]+"),
    "bibcode": _full("[0-9]{4}[A-Za-z0-9.&]{14}[A-Za-z.]"),
    "roman": "v <> '' and " + _full("M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})"),
    "http_status": _full("[0-9]{3}") + " and try_cast(v as int) between 100 and 599",
    "unix_time": _full("[0-9]{9,10}") + " and try_cast(v as bigint) between 100000000 and 9999999999",
    "zip_code": _full("[0-9]{5}(-[0-9]{4})?"),
    "uk_postcode": _full("[A-Za-z]{1,2}[0-9][A-Za-z0-9]? ?[0-9][A-Za-z]{2}"),
    "ca_postal_code": _full("[A-Za-z][0-9][A-Za-z]( ?[0-9][A-Za-z][0-9])?"),
    "us_state": f"upper(v) in {_any(V.STATE_CODES)}",
    "iso_date": _full("[0-9]{4}-[0-9]{2}-[0-9]{2}") + " and " + _month_day("v[6:7]", "v[9:10]"),
    "iso_datetime": _full(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?"),
    "us_date": _full("[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}") + " and " + _month_day("split_part(v, '/', 1)", "split_part(v, '/', 2)"),
    "us_datetime": _full(r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}\s+[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?\s*([AP]M)?", "i"),
    "abbr_month_date": _full(f"[0-9]{{1,2}}[-/]{_MON3}[-/]([0-9]{{4}}|[0-9]{{2}})"),
    "rfc2822_datetime": _full(rf"{_DAY},\s+\d{{1,2}}\s+{_MON3}\s+\d{{4}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+(GMT|UTC|[+-]\d{{4}})"),
    "long_date": _full(rf"{_DAY},?\s+{_MON}\s+\d{{1,2}}(,?\s+\d{{1,4}}{_ERA})?{_TIME}") + " or " + _full(rf"{_MON}\s+\d{{1,2}},?\s+\d{{1,4}}{_ERA}{_TIME}"),
    "month_year": _full(rf"{_MON},?\s+\d{{4}}"),
    "yyyymm": _full("[0-9]{6}") + " and try_cast(v[1:2] as int) in (19, 20) and try_cast(v[5:6] as int) between 1 and 12",
    "month_day": _full(rf"{_MON}\s+\d{{1,2}}"),
    "clock_time": _full(r"\d{1,2}:\d{2}(:\d{2})?\s*([AP]M)?", "i") + " and try_cast(split_part(v, ':', 1) as int) <= 23 and try_cast(split_part(v, ':', 2)[1:2] as int) <= 59",
    "date_range": _full(r"(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\s+(to|-)\s+(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})"),
    "hijri_date": _full(rf"\d{{1,2}}\s+({'|'.join(V.HIJRI)})\s+\d{{3,4}}"),
    "quarter": _full("(FY)?(19|20)[0-9]{2}[- ]?Q[1-4]", "i") + " or " + _full("Q[1-4][- ]?(19|20)[0-9]{2}", "i"),
    "day_of_week": f"lower({_TRIM}) in {_any([x.lower() for d in V.WEEKDAYS for x in (d, d[:3])])}",
    "month_of_year": f"lower({_TRIM}) in {_any([x.lower() for m in V.MONTHS for x in (m, m[:3])])}",
    "fiscal_year": _full(r"FY\s?((19|20)\d{2}|\d{2})([-/]((19|20)?\d{2}))?", "i", _TRIM),
    "street_address": _full(rf"\d+\s+([NSEW]\.?\s+)?[A-Za-z0-9. '-]+\s+({'|'.join(V.STREETS)})\.?", "i"),
    "po_box": _full(r"(p\.?\s?o\.?\s?box|pob|p\.?o\.?b\.?|post\s?office\s?box)\s*#?\s*\d+", "i"),
    "city_name": f"{_CITY.format('v')} in {_any(V.SEEDS['us_city'])}",
    "city_state": _full(r"\s*.+,\s*[A-Za-z. ]{2,}\s*") + rf" and upper(trim(regexp_extract(v, '^\s*(.+?),\s*([A-Za-z. ]{{2,}})\s*$', 2))) in {_STATES}",
    "state_zip": _full(r"\s*[A-Za-z. ]{2,},?\s+\d{5}(-\d{4})?\s*") + rf" and upper(trim(regexp_extract(v, '^\s*([A-Za-z. ]{{2,}}),?\s+(\d{{5}}(?:-\d{{4}})?)\s*$', 1))) in {_STATES}",
    "address": " + ".join(
        f"({x})::int"
        for x in (
            rf"regexp_matches(v, '(?i)\b\d+\s+[A-Za-z0-9. ''-]+\s+({'|'.join(V.STREETS)})\b')", r"regexp_matches(v, '(?i)\bp\.?\s?o\.?\s?box\b|\bpob\b|\bpost\s?office\s?box\b')",
            rf"regexp_matches(v, '(,\s*|\s)({'|'.join([*V.STATE_CODES, *V.STATES])})(\b|,)')", r"regexp_matches(v, '\b\d{5}(-\d{4})?\b')", f"len(list_filter(string_split(v, ','), lambda t: {_CITY.format('t')} in {_any(V.SEEDS['us_city'])})) > 0",
        )
    ) + " >= 3",
    "first_name": f"{_NAME.format('v')} in {_any(V.SEEDS['first_name'])}",
    "last_name": f"{_NAME.format('v')} in {_any(V.SEEDS['last_name'])}",
    "full_name": f"len({_TOKENS}) between 2 and 4 and (case when contains(v, ',') then {_NAME.format(f'({_TOKENS})[1]')} in {_any(V.SEEDS['last_name'])} or {_NAME.format(f'({_TOKENS})[2]')} in {_any(V.SEEDS['first_name'])} else {_NAME.format(f'({_TOKENS})[1]')} in {_any(V.SEEDS['first_name'])} end)",
    "boolean": f"lower({_TRIM}) in {_any(V.BOOLEANS)}",
    "wkt_geometry": _full(r"\s*(POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|GEOMETRYCOLLECTION)\s*(Z|M|ZM)?\s*(\(.*\)|EMPTY)\s*", "i") + r" and (regexp_matches(v, '[0-9]') or upper(rtrim(v, ' ' || chr(10))) like '%EMPTY')",
    "geojson": f"{_TRIM} like '{{%}}'" + r""" and regexp_matches(v, '"type"\s*:\s*"(Point|LineString|Polygon|MultiPoint|MultiLineString|MultiPolygon|GeometryCollection|Feature|FeatureCollection)"') and regexp_matches(v, '"(coordinates|geometry|geometries|features)"\s*:')""",
    "json": f"{_TRIM} like '[%]' or " + _full(r'\{\s*".+"\s*:.*\}', "s", _TRIM),
    "state_fips": f"v in {_any(V.STATE_FIPS)}",
    "county_fips": _fips(5),
    "tract_fips": _fips(11),
    "block_group_fips": _fips(12),
    "block_fips": _fips(15),
    "nces_locale": "length(v) = 2 and v[1] in ('1', '2', '3', '4') and v[2] in ('1', '2', '3')",
    "cbsa": f"v in {_any(V.SEEDS['cbsa'])}",
    "csa": f"v in {_any(V.SEEDS['csa'])}",
    "metro_area_name": rf"regexp_replace(lower({_TRIM}), '\s+', ' ', 'g') in {_any(V.SEEDS['metro_area'])}",
    "urban_rural": f"lower({_TRIM}) in {_any(V.URBAN_RURAL)}",
    "census_region": f"lower({_TRIM}) in {_any(V.REGIONS)}",
    "ssn": _full("[0-9]{3}-[0-9]{2}-[0-9]{4}") + " and v[1:3] not in ('000', '666') and v[1] <> '9' and v[5:6] <> '00' and v[8:11] <> '0000'",
    "ein": _full("[0-9]{2}-?[0-9]{7}") + f" and v[1:2] <> '00' and {_NO_DASH} <> repeat(v[1], 9)",
    "dea": _full("[A-Za-z]{2}[0-9]{7}") + f" and {_sum('v[3:]', [1, 2, 1, 2, 1, 2])} % 10 = {_digit('v', 9)}",
    "chinese_resident_id": _full("[0-9]{17}[0-9Xx]") + f" and (12 - {_sum('v', [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2])} % 11) % 11 = {_check('v', 18)}",
    "uei": "length(v) = 12 and v[1] <> '0' and " + _full("[A-Z0-9]+") + " and not regexp_matches(v, '[IO]')",
    "naics": f"v in {_any(V.SEEDS['naics'])}",
    "phone": _full(r"(\+?1[-. ]?)?(\([0-9]{3}\)[-. ]?|[0-9]{3}[-. ]?)[0-9]{3}[-. ]?[0-9]{4}"),
    "intl_phone": _full(r"\+[0-9]{1,3}[0-9 ().-]{6,18}") + " and length(regexp_replace(v, '[^0-9]', '', 'g')) between 8 and 15",
    "msisdn": "length(v) between 10 and 15 and " + _full("[0-9]+"),
    "doi": _full(r"10\.[0-9]{4,9}/[!-~]+"),
    "orcid": _full("[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9Xx]") + f" and (12 - {_ORCID_SUM} % 11) % 11 = {_check(_NO_DASH, 16)}",
    "isbn": f"case when {_full('[0-9]{9}[0-9Xx]', of=_ISBN)} then ({_sum(_ISBN, list(range(10, 1, -1)))} + {_check(_ISBN, 10)}) % 11 = 0 when {_full('[0-9]{13}', of=_ISBN)} then {_sum(_ISBN, [1, 3] * 6 + [1])} % 10 = 0 else false end",
    "issn": _full("[0-9]{4}-[0-9]{3}[0-9Xx]") + f" and ({_sum(_NO_DASH, list(range(8, 1, -1)))} + {_check(_NO_DASH, 8)}) % 11 = 0",
    "npi": _full("[0-9]{10}") + f" and ({_LUHN}) % 10 = 0",
    "wkb": "length(v) >= 42 and length(v) % 2 = 0 and " + _full("(00|01)[0-9A-Fa-f]+") + f" and ({_WKB_KIND} between 1 and 7 or {_WKB_KIND} % 1000 between 1 and 7 or ({_WKB_KIND} & 255) between 1 and 7)",
}


def probes_sql() -> str:
    """The probes as ``w`` with ``v``, as the beginning of a query."""
    typed = ", ".join(f"({_q(x)})" for x in _typed())
    columns = " union all ".join(f"select {e.replace('as string', 'as varchar')} from {t}" for t, e in COLUMNS)
    return f"with t as (select distinct v from (select * from (values {typed}) x(v) union all {columns}) where v is not null), w as materialized (select distinct unnest([{', '.join(VARIANTS)}]) as v from t) "


def detect_probes_sql() -> str:
    each = " union all ".join(f"select '{name}' as data_type, count(*) as n, count(*) filter ({rule}) as hits, coalesce(sum(h) filter ({rule}), 0)::bigint as digest from p" for name, rule in RULES.items())
    return f"{probes_sql()}, p as materialized (select v, ('0x' || substr(md5(v), 1, 8))::bigint as h from w) {each}"
