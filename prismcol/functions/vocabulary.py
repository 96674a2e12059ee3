"""Fixed values and lexicons. Long lists are parameters: a folder of text files, one term a line, replaces the seeds here."""

from __future__ import annotations

from pathlib import Path

# ISO 4217 alphabetic codes.
CURRENCIES = """AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD
CDF CHF CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HRK HTG HUF IDR
ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR
MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP
SLE SOS SRD SSP STN SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWL""".split()

# States of the USA, with their postal and FIPS codes.
STATES = {
    "Alabama": "AL 01", "Alaska": "AK 02", "Arizona": "AZ 04", "Arkansas": "AR 05", "California": "CA 06", "Colorado": "CO 08", "Connecticut": "CT 09", "Delaware": "DE 10",
    "District of Columbia": "DC 11", "Florida": "FL 12", "Georgia": "GA 13", "Hawaii": "HI 15", "Idaho": "ID 16", "Illinois": "IL 17", "Indiana": "IN 18", "Iowa": "IA 19",
    "Kansas": "KS 20", "Kentucky": "KY 21", "Louisiana": "LA 22", "Maine": "ME 23", "Maryland": "MD 24", "Massachusetts": "MA 25", "Michigan": "MI 26", "Minnesota": "MN 27",
    "Mississippi": "MS 28", "Missouri": "MO 29", "Montana": "MT 30", "Nebraska": "NE 31", "Nevada": "NV 32", "New Hampshire": "NH 33", "New Jersey": "NJ 34", "New Mexico": "NM 35",
    "New York": "NY 36", "North Carolina": "NC 37", "North Dakota": "ND 38", "Ohio": "OH 39", "Oklahoma": "OK 40", "Oregon": "OR 41", "Pennsylvania": "PA 42", "Rhode Island": "RI 44",
    "South Carolina": "SC 45", "South Dakota": "SD 46", "Tennessee": "TN 47", "Texas": "TX 48", "Utah": "UT 49", "Vermont": "VT 50", "Virginia": "VA 51", "Washington": "WA 53",
    "West Virginia": "WV 54", "Wisconsin": "WI 55", "Wyoming": "WY 56",
}
STATE_CODES = [v.split()[0] for v in STATES.values()]
STATE_FIPS = [v.split()[1] for v in STATES.values()] + ["60", "66", "69", "72", "78"]

# Months, weekdays, Islamic months.
MONTHS = "January February March April May June July August September October November December".split()
WEEKDAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
HIJRI = ["Muharram", "Safar", r"Rabi' al-Awwal", r"Rabi' al-Thani", "Rabi I", "Rabi II", "Jumada al-Awwal", "Jumada al-Thani", "Jumada I", "Jumada II", "Rajab", "Sha'ban", "Shaban", "Ramadan", "Shawwal", r"Dhu al-Qi'dah", r"Dhu al-Hijjah", "Dhul-Qadah", "Dhul-Hijjah"]

# Street suffixes; words for urban and rural areas; census regions and divisions; truth values; missing values; stop words.
STREETS = "St Street Ave Avenue Blvd Boulevard Rd Road Dr Drive Ln Lane Ct Court Pl Place Ter Terrace Cir Circle Hwy Highway Pkwy Parkway Way Trl Trail Sq Square Loop Pike Row".split()
URBAN_RURAL = "urban rural suburban suburb exurban exurb metropolitan metro micropolitan city town village hamlet".split()
REGIONS = ["northeast", "midwest", "south", "west", "new england", "middle atlantic", "mid-atlantic", "east north central", "west north central", "south atlantic", "east south central", "west south central", "mountain", "pacific"]
BOOLEANS = "true false t f yes no y n 1 0".split()
SENTINELS = ["", " ", ".", "-", "--", "n/a", "na", "n.a.", "null", "none", "nan", "unknown", "unk", "missing", "not reported", "?", "#n/a"]
STOPWORDS = """the of and a to in for on at by with from as is it or an be this that are was were been has have had not but they we you he she his her
its their our all any can will would there which when who what how if no so up out about into over after before than then""".split()

# Seeds of lexicons that are larger in use.
SEEDS = {
    "first_name": "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony sandra mark margaret donald ashley steven kimberly andrew emily paul donna joshua michelle kenneth carol kevin amanda brian melissa george deborah maria priscilla anna olivia emma noah liam sophia jacob".split(),
    "last_name": "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson thomas taylor moore jackson martin lee perez thompson white harris sanchez clark ramirez lewis robinson walker young allen king wright scott torres nguyen hill flores green adams nelson baker hall rivera campbell mitchell carter roberts ramos".split(),
    "us_city": ["new york", "los angeles", "chicago", "houston", "phoenix", "philadelphia", "san antonio", "san diego", "dallas", "san jose", "austin", "jacksonville", "fort worth", "columbus", "charlotte", "indianapolis", "seattle", "denver", "boston", "nashville", "detroit", "portland", "las vegas", "memphis", "louisville", "baltimore", "milwaukee", "albuquerque", "tucson", "fresno", "sacramento", "kansas city", "atlanta", "miami", "new orleans", "cleveland", "tampa", "bloomington", "cheshire", "minneapolis", "pittsburgh", "cincinnati", "st louis", "orlando", "honolulu", "anchorage"],
    "cbsa": "10100 10140 10180 12060 14460 16980 19100 26420 31080 33100 35620 37980 38060 41860 42660 47900".split(),
    "csa": "101 220 148 176 206 216 288 348 370 378 408 488".split(),
    "metro_area": ["aberdeen, sd", "abilene, tx", "aberdeen", "abilene", "akron, oh", "albany, ga", "boston-cambridge-newton, ma-nh", "chicago-naperville-elgin, il-in-wi"],
    "naics": "11 21 22 23 31 42 44 48 51 52 53 54 55 56 61 62 71 72 81 92 111 236 541 5415 54151 541511 622110 611310".split(),
}


_folder: str | None = None


def use_lexicons(folder: str | None) -> None:
    """From now on detectors take their terms from ``folder/<name>.txt`` (first_name, last_name, us_city, cbsa, csa, metro_area, naics), one a line, where that is there; null: from the seeds."""
    global _folder
    _folder = folder


def lexicon(name: str, folder: str | None = None) -> list[str]:
    """The terms of ``folder/name.txt`` (default: the folder of ``use_lexicons``), or the seeds. Detectors test values against them as one set of
    literals, which is hashed; a list of some ten thousand terms is meant to fit."""
    path = Path(folder or _folder, f"{name}.txt") if folder or _folder else None
    return [x.strip().lower() for x in path.read_text(encoding="utf-8").splitlines() if x.strip()] if path and path.exists() else SEEDS[name]


def countries() -> list[str]:
    """ISO 3166-1 alpha-2 codes, as the Java runtime of the active session lists them."""
    from pyspark.sql import SparkSession

    return list(SparkSession.active()._jvm.java.util.Locale.getISOCountries())
