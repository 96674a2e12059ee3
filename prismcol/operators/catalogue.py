"""The ontology of types as a table, and the two-stage guess: a shortlist by signatures, then the recipes that stabilise a column and reject junk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from . import similarity
from .ontology import MATCH_KINDS, node_labels  # noqa: F401 - the kinds of match that match_kind gives
from .stabilize import transform

# A variant a line, as path | format | recipe | examples | unit. Variants of one path follow one another.
ROWS = """
number/quantity/measurement | measurement | as_number | 3.14 ;; 12.5 ;; 0.82 |
number/quantity/count | count | as_integer | 12 ;; 7 ;; 130 |
number/quantity/duration | duration | as_number | 3.5 ;; 12 ;; 48 | hr
number/quantity/index | index | as_number | 101.3 ;; 99.8 |
number/quantity/rank | rank | as_rank | 1 ;; 2 ;; 3 |
number/quantity/rate | rate | as_number | 4.2 ;; 0.7 |
number/quantity/ratio | ratio | as_number | 1.5 ;; 0.66 |
number/quantity/score | score | as_number | 88 ;; 92.5 |
number/portion/percent | percent | as_percent | 45% ;; 12.5% | pct
number/portion/percentile | percentile | as_number | 50 ;; 95 |
number/portion/probability | probability | as_probability | 0.05 ;; 0.93 |
number/currency/usd | usd | as_usd | $1,234.50 ;; $99.00 ;; $12 | usd
number/currency/euro | euro | as_euro | €1234.50 ;; €99 | eur
number/currency/balance | balance | as_currency | -120.50 ;; 3400.00 |
number/range/confidence_interval | confidence_interval | as_range | 1.2-3.4 ;; 0.8, 1.1 |
number/range/min_max | comma_pair | as_range | 10, 20 ;; 3, 9 |
number/range/min_max | to_range | as_range | 10 to 20 ;; 3 to 9 |
number/coordinate/lat | lat | as_coord | 47.6062 ;; -33.8688 |
number/coordinate/lat_lon | dms | as_coord | 47.6062 ;; -122.3321 |
number/coordinate/lat_lon | iso6709 | as_coord | +47.6062 ;; -122.3321 |
temporal/date/calendar | calendar | as_mmddyyyy | 03/15/2019 ;; 2019-03-15 ;; 3-15-2019 |
temporal/date/timestamp | timestamp | as_datetime | 2019-03-15T14:30:00 ;; 2020-09-12 10:50:39 |
temporal/time/clock | clock | as_clock | 2:30 PM ;; 14:30:00 |
temporal/interval/date_range | date_range | as_range | 2019-01-01 to 2019-02-01 ;; 01/01/19 - 02/01/19 |
temporal/period/year | year | as_yyyy | 2019 ;; 1987 |
temporal/period/quarter | quarter | as_quarter | 2019Q1 ;; Q3-2020 |
text/name/person | first_name | lookup:given | James ;; Mary |
text/name/person | last_name | lookup:surname | Smith ;; Garcia |
text/name/person | full_name | split+order | Jane Doe ;; Doe, Jane |
temporal/period/month | month | as_yyyymm | 2019-03 ;; March 2019 |
temporal/period/reporting_period | reporting_period | as_factor | 2019-2020 ;; FY2019 |
temporal/phase/day_of_week | day_of_week | as_factor | Monday ;; Tue |
temporal/phase/month_of_year | month_of_year | as_factor | January ;; Feb |
temporal/phase/hour_of_day | hour_of_day | as_integer | 0 ;; 13 ;; 23 |
temporal/phase/week_of_year | week_of_year | as_integer | 1 ;; 27 ;; 52 |
boolean/binary/indicator | indicator | as_boolean | yes ;; no ;; TRUE |
boolean/binary/presence | presence | as_boolean | 1 ;; 0 |
boolean/binary/response | response | as_boolean | yes ;; no |
boolean/binary/status | status | as_factor | active ;; inactive |
categorical/multiselect/tags | tags | as_factor | red;blue ;; green |
categorical/mutually_exclusive/classification_code | classification_code | as_factor | 541511 ;; I63.9 |
categorical/mutually_exclusive/missingness_reason | missingness_reason | as_factor | refused ;; not asked |
categorical/mutually_exclusive/ordered | ordered | as_ordered | low ;; medium ;; high |
categorical/mutually_exclusive/unordered | unordered | as_factor | apple ;; pear ;; plum |
categorical/scale/grade_level | grade_level | as_ordered | 9th ;; 10th |
categorical/mutually_exclusive/geographic | iso_country | lookup:iso3166 | France ;; FR |
categorical/mutually_exclusive/geographic | us_state | lookup:usps | California ;; CA |
categorical/mutually_exclusive/geographic | us_city | lookup:place | Chicago ;; Boston |
categorical/mutually_exclusive/geographic | county_fips | zeropad5+validate | 06037 ;; 6037 |
categorical/scale/likert | likert | as_ordered | strongly agree ;; neutral |
categorical/scale/rating | rating | as_ordered | 4 ;; 5 |
identifier/id/entity | entity | as_id | ENSG00000139618 ;; rs3918290 |
identifier/id/geographic | geographic | zeropad5 | 53033 ;; 06037 |
identifier/id/hash | hash | as_id | 6e8a6448a62364225da9991fd8e1ef8c ;; 3df4ffb6eb24fffab3763041f13dbdea |
identifier/id/record | record | as_id | A-10293 ;; A-10294 |
identifier/id/version | version | as_id | 1.2.3 ;; 2.0.0 |
structured/collection/array | array | none | [1,2,3] ;; [4,5] |
structured/collection/list | list | none | a;b;c ;; d;e |
structured/geometry/point | point | none | POINT (30 10) ;; POINT (1 2) |
structured/geometry/polygon | polygon | none | POLYGON ((0 0, 1 1, 1 0, 0 0)) |
structured/record/key_value | key_value | none | a=1;b=2 ;; c=3 |
structured/record/object | object | none | {"a":1,"b":2} ;; {"c":3} |
text/color/hex | hex | as_hex | #4d9cf8 ;; #1f3a8e |
text/color/rgb | rgb | none | 220,220,220 ;; 255,250,250 |
text/contact/email | email | as_email | a@b.com ;; jane.doe@x.org |
text/contact/phone | phone | as_phone | 510-577-3201 ;; (309) 647-1820 |
text/name/handle | handle | as_handle | @jane_doe ;; @rstats |
text/name/organization | organization | none | Acme Inc ;; Ford Foundation |
text/name/place | place | none | Lake Tahoe ;; Mount Rainier |
text/postal/full | full | as_full_address | 1225 S Walnut St, Bloomington, IN 47401 |
text/postal/po_box | po_box | as_po_box | PO Box 1234 ;; P.O. Box 56 |
text/postal/street | street | as_street | 2325 140th St ;; 303 Aspen Ct |
identifier/id/administrative | ein | as_ein | 12-3456789 ;; 01-2345678 |
identifier/id/administrative | isbn | as_isbn | isbn 0062049879 ;; 978-0-14-044806-1 ;; 4-04-924701-1 |
identifier/id/administrative | doi | as_doi | 10.1000/xyz123 ;; doi:10.1038/nature12373 |
identifier/id/administrative | orcid | as_orcid | 0000-0002-1825-0097 |
identifier/id/administrative | issn | as_issn | 2049-3630 ;; 0028-0836 |
text/text/label | label | none | north gate ;; main hall |
text/text/literal | literal | none | lorem ;; ipsum |
text/text/long | long | none | the quick brown fox jumps over the lazy dog ;; a long remark about something |
text/text/serialized | serialized | none | {"a":[1,2]} ;; {"b":[3]} |
text/text/title | title | none | A Tale of Two Cities ;; War and Peace |
text/web/ip | ip | none | 54.219.219.166 ;; 49.200.88.156 |
text/web/url | url | as_url | https://a.com/x ;; http://b.org |
unknown/unknown/malformed | malformed | none | Ã©Ã¨ ;; â€™ |
unknown/unknown/mixed | mixed | none | 12 ;; abc ;; 2019-01-01 |
unknown/unknown/unclassified | unclassified | none | x1?y ;; q-9z |
"""
# Ids of types that are known; the others take the free numbers in the order of the rows.
KNOWN_IDS = {"number/quantity/measurement": 1, "number/range/min_max": 16, "number/coordinate/lat_lon": 18, "text/name/person": 27, "categorical/mutually_exclusive/geographic": 46, "identifier/id/administrative": 73}
# Strings of many shapes that no validating recipe accepts.
FOIL = ["qxzptr", "vbnmlk", "zzxywq", "jkqvxz", "wqpzrn", "xcvbnm", "foo bar baz", "lorem ipsum", "hello world foo", "a1b2c3", "x9y8z7", "q4w5e6d8", "zz99xx11", "!@#$%^", "...///", "--__--", "<<>>||", "42", "3.14159", "1000000", "0.5", "2020-13-45", "99/99/9999"]
#: Values of a column that are looked at; types on the shortlist; shares of values that a recipe has to accept, and may accept of the foil; and the least likeness of a shortlist.
SAMPLE, SHORTLIST, CONFIRM, LEAK, MARGIN, FLOOR = 100, 8, 0.80, 0.25, 0.50, 0.55
SCHEMA = "semantic_type_id string, variant_id string, data_type string, semantic_family string, semantic_type string, format_label string, match_kind string, raw_to_stable_transform string, examples string, dd_data_unit string, version_added string, version_deprecated string, superseded_by string"


def match_kind(data_type: str, family: str, kind: str, label: str) -> str:
    """How a variant is recognised, by its path, and for names and places by its format."""
    if kind == "person":
        return "mask+lexicon" if label == "full_name" else "lexicon"
    if data_type == "categorical" and kind == "geographic":
        return "mask+lexicon" if label == "county_fips" else "lexicon"
    rules = [
        ("genome", data_type == "temporal" and family in ("date", "time")),
        ("lexicon", family == "phase" and kind in ("day_of_week", "month_of_year") or family == "name"),
        ("mask+lexicon", family == "postal" or kind in ("classification_code", "geographic")),
        ("shape", family in ("portion", "quantity")),
        ("none", data_type in ("categorical", "unknown") or data_type == "text" and family not in ("contact", "web", "color")),
    ]
    return next((k for k, ok in rules if ok), "mask")


def ontology_rows() -> list[tuple]:
    lines = [[x.strip() for x in line.split("|")] for line in ROWS.strip().splitlines()]
    ids, free = dict(KNOWN_IDS), iter(i for i in range(1, 1000) if i not in KNOWN_IDS.values())
    out, variants = [], {}
    for path, label, recipe, examples, unit in lines:
        if path not in ids:
            ids[path] = next(free)
        variants[path] = variants.get(path, 0) + 1
        node = f"n{ids[path]:04d}"
        out.append((node, f"{node}-f{variants[path]:02d}", *path.split("/"), label, match_kind(*path.split("/"), label), recipe, examples, unit, "v6", "", ""))
    return out


def ontology_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The catalogue, or that of a CSV file with a header."""
    if path:
        return spark.read.csv(path, header=True, inferSchema=False, emptyValue="", nullValue="\u0000", multiLine=True, escape='"')
    return node_labels(spark.createDataFrame(ontology_rows(), SCHEMA)).withColumnRenamed("derived_label", "node_label")


def sample_values(values: DataFrame, n: int = SAMPLE, seed: int = 1) -> DataFrame:
    """``column, v, w`` of at most ``n`` distinct values of each column that are not blank, by hashes; ``w`` is 1."""
    rows = values.where(F.col("v").isNotNull() & (trimmed(F.col("v")) != "")).select("column", "v").distinct()
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.xxhash64("v", F.lit(seed)), "v"))
    return rows.withColumn("place", place).where(f"place <= {n}").select("column", "v", F.lit(1).cast("long").alias("w"))


def example_signatures(ontology: DataFrame) -> DataFrame:
    examples = ontology.select(F.col("variant_id").alias("column"), F.explode(F.split("examples", " *;; *")).alias("v")).where("v <> ''").groupBy("column", "v").agg(F.count("*").alias("w"))
    return similarity.signatures(examples).withColumnRenamed("column", "variant_id")


def shortlist(sampled: DataFrame, ontology: DataFrame, k: int = SHORTLIST, weights: list[float] | None = None) -> DataFrame:
    """``column, place, router_sim`` and the path of the ``k`` variants whose examples look most like each column."""
    a = similarity.signatures(sampled).alias("a")
    b = F.broadcast(example_signatures(ontology)).alias("b")  # as many rows as the catalogue
    pairs = a.join(b).select(F.col("a.column").alias("column"), "b.variant_id", similarity.similarity("a", "b", weights).alias("router_sim"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.round("router_sim", 9).desc_nulls_last(), "variant_id"))
    near = pairs.withColumn("place", place).where(f"place <= {k}")
    return near.join(F.broadcast(ontology.select("variant_id", "semantic_type_id", "data_type", "semantic_family", "semantic_type")), "variant_id")


def recipe_rates(sampled: DataFrame, recipes: list[str]) -> DataFrame:
    """``column, recipe, confirm``: the share of a column's values that each recipe gives a stable form."""
    rates = sampled.groupBy("column").agg(*(F.avg(transform(F.col("v"), r).isNotNull().cast("int")).alias(f"r{i}") for i, r in enumerate(recipes)))
    return rates.select("column", F.inline(F.array(*(F.struct(F.lit(r).alias("recipe"), F.col(f"r{i}").alias("confirm")) for i, r in enumerate(recipes)))))


def route(values: DataFrame, ontology: DataFrame | None = None, k: int = SHORTLIST, n: int = SAMPLE) -> DataFrame:
    """One row for each column: as much of a type's path as its values show.

    ``column, data_type, semantic_family, semantic_type, semantic_type_id, variant_id, format_label, match_kind, depth, confidence, dd_unit, router_method``. Candidates are the shortlist's
    types and all variants of kinds genome and mask+lexicon. A variant whose recipe accepts CONFIRM of the values, and of the foil LEAK at most and MARGIN less,
    is selective: the best gives the whole path (depth 4). Dates, timestamps and times accept each other's values, so what the raw values hold of
    dates and times comes first. Without a selective variant the path goes as deep as the shortlist agrees, and nowhere below a likeness of FLOOR.
    """
    spark = values.sparkSession
    ontology = ontology_table(spark) if ontology is None else ontology
    sampled = sample_values(values, n)
    recipes = sorted(r["r"] for r in ontology.select(F.col("raw_to_stable_transform").alias("r")).distinct().collect() if (r["r"] or "").strip())  # a catalogue's
    foil = spark.createDataFrame([("foil", v, 1) for v in FOIL], "column string, v string, w long")
    leaks = F.broadcast(recipe_rates(foil, recipes).select("recipe", F.col("confirm").alias("leak")))
    near = shortlist(sampled, ontology, k)
    u = F.col("v")
    content = sampled.groupBy("column").agg(
        (F.avg(u.rlike("[0-2]?[0-9]:[0-5][0-9]").cast("int")) >= 0.5).alias("has_time"),
        (F.avg(u.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}").cast("int")) >= 0.5).alias("has_date"),
    )
    best = near.groupBy("column", "semantic_type_id").agg(F.max("router_sim").alias("router_sim"))
    fields = ["semantic_type_id", "variant_id", "data_type", "semantic_family", "semantic_type", "format_label", "match_kind", "dd_data_unit"]
    verified = recipe_rates(sampled, recipes).join(leaks, "recipe").join(F.broadcast(ontology.select(*fields, F.col("raw_to_stable_transform").alias("recipe"))), "recipe")
    verified = verified.join(best, ["column", "semantic_type_id"], "left").join(content, "column").where(F.col("router_sim").isNotNull() | F.col("match_kind").isin("genome", "mask+lexicon"))
    gain, time, date, kind = F.col("confirm") - F.col("leak"), F.col("has_time"), F.col("has_date"), F.col("semantic_type")
    bonus = F.when((kind == "timestamp") & time & date | (kind == "calendar") & date & ~time | (kind == "clock") & time & ~date, 1).otherwise(0)
    selective = verified.where((F.col("confirm") >= CONFIRM) & (F.col("leak") <= LEAK) & (gain >= MARGIN))
    order = [bonus.desc(), F.round(gain, 9).desc(), F.col("confirm").desc(), F.coalesce("router_sim", F.lit(0.0)).desc(), "variant_id"]
    leaf = selective.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))).where("rank = 1").select("column", F.struct(*fields, F.col("confirm").alias("confidence")).alias("leaf"))
    agree = near.groupBy("column").agg(
        F.count_distinct("data_type").alias("t"), F.count_distinct("data_type", "semantic_family").alias("f"), F.count_distinct("data_type", "semantic_family", "semantic_type").alias("s"),
        F.min_by(F.struct("data_type", "semantic_family", "semantic_type", "semantic_type_id", "router_sim"), "place").alias("top"),
    )
    columns = values.select("column").distinct()
    j = columns.join(leaf, "column", "left").join(agree, "column", "left")
    found = F.col("leaf").isNotNull()
    depth = F.when(found, 4).when(F.col("top").isNull() | (F.col("top.router_sim") < FLOOR), 0).when(F.col("s") == 1, 3).when(F.col("f") == 1, 2).otherwise(1)
    at = lambda name, least: F.when(found, F.col(f"leaf.{name}")).when(depth >= least, F.col(f"top.{name}"))
    only = lambda name: F.when(found, F.col(f"leaf.{name}"))
    return j.select(
        "column", at("data_type", 1).alias("data_type"), at("semantic_family", 2).alias("semantic_family"), at("semantic_type", 3).alias("semantic_type"), at("semantic_type_id", 3).alias("semantic_type_id"),
        only("variant_id").alias("variant_id"), only("format_label").alias("format_label"), only("match_kind").alias("match_kind"), depth.alias("depth"),
        F.when(found, F.col("leaf.confidence")).otherwise(F.col("top.router_sim")).alias("confidence"), F.nullif(only("dd_data_unit"), F.lit("")).alias("dd_unit"), F.when(depth > 0, "signature").alias("router_method"),
    )


def audit(ontology: DataFrame) -> DataFrame:
    """The spreadsheet hazards and the round trip of each variant's examples."""
    from .screens import roundtrip

    examples = ontology.select(F.col("variant_id").alias("column"), F.explode(F.split("examples", " *;; *")).alias("v")).where("v <> ''").groupBy("column", "v").agg(F.count("*").alias("w"))
    return roundtrip(examples).withColumnRenamed("column", "variant_id")


def classify_table(df: DataFrame, columns: list[str] | None = None, rows: int = 500, blocks: list[str] | None = None, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Predictions and features of a table's columns: a row each of guess and route, and of the profile of ``rows`` rows with the core block of all.

    Guess, route and features see the same sample of rows.
    """
    from .profile_more import row_sample, sampled_profile
    from .scoring import guess_columns

    sample = row_sample(df, columns, rows)
    guess = guess_columns(sample, threshold)
    routed = route(sample)
    routed = routed.select("column", *(F.col(c).alias(f"route_{c}") for c in routed.columns if c != "column"))
    return guess.join(routed, "column", "left"), sampled_profile(df, columns, rows, blocks)


def stabilize_by(c: Column, ontology: DataFrame, semantic_type: str, format_label: str | None = None) -> Column:
    """A value in the stable form of a type of the catalogue; raises for a type or a format that it does not have."""
    rows = ontology.where(F.col("semantic_type") == semantic_type).orderBy("variant_id").select("format_label", "raw_to_stable_transform").collect()  # a type's variants
    if not rows:
        raise ValueError(f"unknown semantic type: {semantic_type}")
    row = next((r for r in rows if format_label is None or r["format_label"] == format_label), None)
    if row is None:
        raise ValueError(f"no format {format_label!r} of {semantic_type}")
    return transform(c, row["raw_to_stable_transform"])
