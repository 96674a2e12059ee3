"""Each detector accepts values of its type, rejects others, and gives null for null."""

from pyspark.sql import functions as F

from prismcol.operators.detectors import REGISTRY
from prismcol.operators.testgen import GENERIC, alphabet, detector_results, mutate, negatives, report_text, summary_row
from prismcol.plans.probes import VALUES

# Type: values to accept | values to reject.
CASES = {
    "currency_code": ("AUD usd", "AAA US"), "currency_symbol": ("$12.30 €299.10", "$1,234 12.30"), "currency_code_symbol": ("USD$12.30 EUR€299.10", "XXX$1 usd$1"),
    "email": ("cjudgkins0@de.vu csoutar1@bigcartel.com", "a@b @c.de"), "url": ("http://ezproxy.baylor.edu/ https://www.ezproxy.unibo.it/", "www.a.de http://a"),
    "ipv4": ("54.219.219.166 49.200.88.156", "256.1.1.1 1.2.3"), "ipv6": ("89a4:e654:d143:d1d0:b986:73e4:c8e1:4710 ::1 fe80::1", "fe80::1:2 1:2"), "mac": ("40-1F-3C-B6-3C-BC 1E:42:64:5E:54:69", "40-1F:3C-B6-3C-BC"),
    "hex_color": ("#4d9cf8 #fff", "4d9cf8 #ffff"), "rgb_color": ("220,220,220 255,250,250", "256,0,0 1,2"), "cmyk_color": ("0.0,0.31,0.37,0.0", "1.5,0,0,0"), "md5": ("6e8a6448a62364225da9991fd8e1ef8c", "6e8a"),
    "sha1": ("16de70e8fcd093964a448a86bc89b1c607152ead", "16de"), "sha256": ("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "e3"), "guid": ("f2a59360-1d1a-49e8-9a2f-f9cdf0d5a811", "f2a59360"),
    "ensembl_id": ("ENSMUSG00000102659", "ENSX1"), "uniprot_id": ("P33667 P17888", "P3366"), "icd9_code": ("078.11 008.8 V10", "78.1"), "icd10_code": ("I61 I63.9", "i61"), "snp_id": ("rs3918290", "rs"), "asin": ("B01L7DYXL0", "A01L7DYXL0"),
    "bibcode": ("2004PASP..116...98K", "2004PASP"), "roman": ("I II XIV MMXX", "IIII ABC"), "http_status": ("100 404", "99 600"), "unix_time": ("1513036980", "99999999"), "zip_code": ("98052 15206-1234", "9805"), "uk_postcode": ("SA432BU PO122DU", "123"),
    "ca_postal_code": ("V5K K0H", "VVK"), "us_state": ("WA oh", "ZZ"), "country_code": ("MA AR", "ZZ"), "iso_date": ("2016-03-15", "2016-13-15"), "iso_datetime": ("1987-02-06T06:00:37", "1987-02-06"), "us_date": ("3/3/16 1/27/16", "13/1/16"),
    "abbr_month_date": ("1-Jul-14", "1-jul-14"), "yyyymm": ("201912", "201913"), "clock_time": ("6:00 23:59:59", "24:00"), "quarter": ("2019Q1 Q4-2020", "2019Q5"), "day_of_week": ("Monday tue", "Mo"), "month_of_year": ("January feb", "Janu"), "fiscal_year": ("FY2019 FY19-20", "2019"),
    "date": ("2016-03-15 3/3/16 20200229", "2016-02-31 1800-01-01 x"), "city_name": ("Chicago boston", "Nowhere"), "first_name": ("James mary", "Xqz"), "last_name": ("Smith johnson", "Xqz"), "boolean": ("true N 1", "2 maybe"), "state_fips": ("06 36", "03 99"), "county_fips": ("06037 36061", "03001"),
    "tract_fips": ("06037206200", "03037206200"), "block_group_fips": ("060372062001", "030372062001"), "block_fips": ("060372062001001", "030372062001001"), "nces_locale": ("11 43", "14 51"), "cbsa": ("10100 10140", "99999"), "csa": ("101 220", "999"), "urban_rural": ("Urban rural", "sea"), "census_region": ("Northeast pacific", "north"),
    "ssn": ("540-39-4268 518-07-5084", "000-12-3456 900-12-3456 123-00-1234"), "ein": ("15-4464349 589042990", "00-1234567 111111111"), "dea": ("AP5836727 BJ6125341", "AP5836728"), "chinese_resident_id": ("141002197808194474 431026197506218370", "141002197808194475"), "uei": ("ZQGGHJH74DW7 R7KZ8N2QP4M5", "0QGGHJH74DW7"),
    "naics": ("11 236", "00"), "phone": ("510-577-3201 (309)647-1820", "12345"), "intl_phone": ("+1-4250013981", "14250013981"), "msisdn": ("919961345678", "123"), "doi": ("10.1109/ICDCSW.2017.43", "11.1/x"), "orcid": ("0000-0002-0488-8591 0000-0002-6390-6569", "0000-0002-0488-8592"),
    "isbn": ("140955525-9 038027303-9", "140955525-8"), "issn": ("0001-2092 0001-253X", "0001-2093"), "npi": ("1225155880 1649397217", "1225155881"),
    "wkb": ("0101000000000000000000f03f000000000000f03f", "0101"),
}
# The same for values with spaces, separated by |.
SPACED = {
    "hsl_color": ("195, 100%, 27%|195, 100%, 47%", "361, 1%, 1%"), "us_datetime": ("2/6/1987 6:00:37 AM", "2/6/1987"), "rfc2822_datetime": ("Fri, 06 Feb 1987 06:00:37 GMT", "06 Feb 1987"), "long_date": ("Friday, June 16, 1967|June 9, 1955", "June 9"), "month_year": ("February 1987", "February"),
    "month_day": ("February 6|January 12", "February"), "date_range": ("07/21/16 to 08/19/16", "07/21/16"), "hijri_date": ("11 Shawwal 1430|5 Muharram 1300", "5 March 1300"), "street_address": ("2325 140th St|303 Aspen Ct", "Aspen Ct"), "po_box": ("PO Box 1234|P.O. Box 56", "Box 5"), "city_state": ("Bloomington, IN|Cheshire, CT", "Bloomington, ZZ"),
    "state_zip": ("IN 47401|CT, 06410", "ZZ 47401"), "address": ("1225 S Walnut St, Bloomington, IN 47401|30 Grandview Ct, Cheshire, CT 06410", "Walnut"), "full_name": ("John Smith|Smith, Mary", "Xqz Abc"), "wkt_geometry": ("POINT (30 10)|POLYGON EMPTY", "POINT"), "geojson": ('{"type":"Point","coordinates":[30,10]}', '{"a":1}'), "json": ('{"a":1,"b":2}|[1]', "{}"), "metro_area_name": ("Aberdeen, SD|abilene,  tx", "Nowhere, ZZ"),
}


def test_values(spark):
    assert len(REGISTRY) == 88 and not set(REGISTRY) - set(CASES) - set(SPACED)
    rows = [(name, v, want) for table, cut in ((CASES, " "), (SPACED, "|")) for name, sides in table.items() for side, want in zip(sides, (True, False)) for v in side.split(cut)]
    df = spark.createDataFrame(rows, "name string, v string, want boolean")
    got = F.lit(None).cast("boolean")
    for name, d in REGISTRY.items():
        got = F.when(F.col("name") == name, d(F.col("v"))).otherwise(got)
    wrong = [tuple(r)[:3] for r in df.withColumn("got", got).where("got is null or got <> want").collect()]
    assert not wrong


def test_null_and_line_break(spark):
    df = spark.createDataFrame([(None,), ("98052\n",)], "v string")
    rows = df.select(*(d(F.col("v")).alias(n) for n, d in REGISTRY.items())).collect()
    assert not any(v is not None for v in rows[0]) and rows[1]["zip_code"] is False


# Types that accept less than a tenth of the widest mutants.
STRICT = "email url ipv4 ipv6 mac hex_color rgb_color hsl_color cmyk_color md5 sha1 sha256 guid ensembl_id uniprot_id snp_id asin bibcode zip_code".split()


def test_strict_detectors_reject_mutants(spark):
    values = [(name, v) for name in STRICT for v in VALUES[name].split("|")]
    accepted = F.lit(False)
    for name in STRICT:
        accepted = F.when(F.col("name") == name, REGISTRY[name](F.col("v"))).otherwise(accepted)
    positives = spark.createDataFrame(values, "name string, v string").where(accepted)
    assert positives.select("name").distinct().count() == len(STRICT)
    k = F.explode(F.sequence(F.lit(1), F.lit(200)))
    mutants = positives.select("name", "v", k.alias("k")).select("name", mutate(F.col("v"), F.col("k"), F.array(*map(F.lit, GENERIC)), False).alias("v")).distinct().join(positives, ["name", "v"], "left_anti")
    rates = {r["name"]: r["rate"] for r in mutants.groupBy("name").agg(F.avg(accepted.cast("int")).alias("rate")).collect()}
    assert len(rates) == len(STRICT) and max(rates.values()) < 0.1, rates


def test_tiers(spark):
    positives = spark.createDataFrame([(v,) for v in CASES["guid"][0].split() + ["0f2a5936-1d1a-49e8-9a2f-f9cdf0d5a811", "abcdef01-0000-4000-8000-123456789abc"]], "v string")
    results = detector_results(REGISTRY["guid"], positives)
    row = summary_row("guid", results).first()
    assert row["n_positives"] == 3 and row["n_false_negatives"] == 0 and row["rate_S1"] == 1 and row["rate_S2"] < 0.2 and row["rate_S3"] < 0.01 and row["rate_SP"] < 0.1
    moved = [r["v"] for r in negatives(positives, "SP").collect()]
    letters = {v.replace("-", "") for v in (r["v"] for r in positives.collect())}
    assert len(moved) > 30 and all(m.replace("-", "") in letters and m.count("-") == 4 for m in moved)
    assert report_text("guid", results).startswith("guid: 0 of 3 positives rejected")
    known = alphabet(positives).first()
    assert known["marks"] == ["-"] and set(known["everything"]) == {"-", *known["alnum"]}
    assert {c for r in negatives(positives, "S1").collect() for c in r["v"]} <= set(known["everything"])


def test_lexicons_from_a_folder(spark, tmp_path):
    from prismcol.functions import vocabulary

    df = spark.createDataFrame([("Kowalski",), ("Smith",)], "v string")
    (tmp_path / "last_name.txt").write_text("Kowalski\nFitzgerald\n")
    try:
        vocabulary.use_lexicons(str(tmp_path))
        got = [r[0] for r in df.select(REGISTRY["last_name"](F.col("v"))).collect()]
    finally:
        vocabulary.use_lexicons(None)
    assert got == [True, False] and [r[0] for r in df.select(REGISTRY["last_name"](F.col("v"))).collect()] == [False, True]
    assert [r[0] for r in spark.createDataFrame([("",), (" ",), ("x",)], "v string").select(REGISTRY["full_name"](F.col("v"))).collect()] == [None, None, False]
