"""What type of value a column holds: scores of all detectors, ranked, with the header as a second opinion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..sources.values import values_frame
from .detectors import REGISTRY, Detector

# Header rules as name; coordinates; confidence; pattern over the tokenised header. The first of equal confidence wins.
NAME_RULES = [
    ("email", "text/token/email", 0.85, r"\b(email|e ?mail)\b"),
    ("url", "text/token/url", 0.80, r"\b(url|uri|link|website|homepage)\b"),
    ("phone", "text/token/phone", 0.80, r"\b(phone|telephone|tel|mobile|cell|fax)\b"),
    ("admin_id", "identifier/text_id/administrative_id", 0.90, r"\b(ssn|ein|npi|doi|orcid|isbn|issn|duns|uei|dea)\b"),
    ("record_id", "identifier/text_id/record_id", 0.72, r"(^| )id$|\b(identifier|uuid|guid|rowid|row id|primary key)\b"),
    ("eligibility", "boolean/binary/eligibility", 0.78, r"\b(eligible|eligibility|qualif\w*)\b"),
    ("response", "boolean/binary/response", 0.66, r"\b(response|responded|consent\w*|agree\w*|answered)\b"),
    ("presence", "boolean/binary/presence", 0.60, r"\b(present|presence|exists|has)\b"),
    ("indicator", "boolean/binary/indicator", 0.80, r"^(is|has|had|was|does|do|can|should|will) |\b(flag|flg|indicator|dummy|binary|bool|boolean|yn)\b"),
    ("status", "boolean/binary/status", 0.55, r"\b(status|active|inactive|enabled|disabled)\b"),
    ("standard_error", "number/continuous/standard_error", 0.80, r"\b(se|stderr|std err|standard error)\b"),
    ("standardized_score", "number/continuous/standardized_score", 0.82, r"\b(z score|zscore|t score|tscore|std score|standardized)\b"),
    ("coefficient", "number/continuous/coefficient", 0.70, r"\b(coef\w*|beta|slope|elasticity)\b"),
    ("weight", "number/continuous/weight", 0.72, r"\b(wt|wgt|weight|pweight|aweight|fweight)\b"),
    ("percentile", "number/continuous/percentile", 0.80, r"\b(pctile|percentile|quantile|decile|quartile)\b"),
    ("probability", "number/continuous/probability", 0.68, r"\b(prob\w*|likelihood|pval\w*|p value)\b"),
    ("growth_rate", "number/continuous/growth_rate", 0.72, r"\b(growth|cagr|yoy|mom|pct change|percent change)\b"),
    ("rate", "number/continuous/rate", 0.68, r"\b(rate|per capita|percapita|incidence|prevalence|mortality)\b"),
    ("ratio", "number/continuous/ratio", 0.70, r"\b(ratio|odds)\b"),
    ("proportion", "number/continuous/proportion", 0.62, r"\b(prop|proportion|share|fraction|pct|percent|percentage)\b"),
    ("estimate", "number/continuous/estimate", 0.60, r"\b(est|estimate\w*|predicted|prediction|fitted|yhat)\b"),
    ("difference", "number/continuous/difference", 0.58, r"\b(diff\w*|delta|change|gap|net change)\b"),
    ("balance", "number/continuous/balance", 0.70, r"\b(balance|net worth|assets|liabilities)\b"),
    ("currency", "number/continuous/currency", 0.65, r"\b(amount|amt|cost|price|revenue|income|salary|wage|wages|earnings|expense|expenditure|budget|usd|eur|gbp|dollars?|payment|fee|funding)\b"),
    ("coordinate", "number/continuous/coordinate", 0.80, r"\b(lat|latitude|lon|lng|longitude|easting|northing|x coord|y coord)\b"),
    ("index", "number/continuous/index", 0.55, r"\b(index|idx)\b"),
    ("duration", "number/continuous/duration", 0.62, r"\b(duration|elapsed|tenure|age|los|length of stay|time spent)\b"),
    ("measurement", "number/continuous/measurement", 0.58, r"\b(height|length|width|depth|temperature|temp|mass|volume|distance|km|cm|mm|kg)\b"),
    ("frequency", "number/discrete/frequency", 0.70, r"\b(freq|frequency)\b"),
    ("rank", "number/discrete/rank", 0.70, r"\b(rank\w*|position|placement)\b"),
    ("score", "number/discrete/score", 0.62, r"\b(score|pts|points)\b"),
    ("count", "number/discrete/count", 0.66, r"\b(count|cnt|tally|num|number of)\b|^n "),
    ("likert", "categorical/ordinal/likert", 0.72, r"\b(likert|satisfaction)\b"),
    ("grade_level", "categorical/ordinal/grade_level", 0.66, r"\b(grade|grade level|class year)\b"),
    ("rating", "categorical/ordinal/rating", 0.68, r"\b(rating|stars)\b"),
    ("missingness", "categorical/nominal/missingness_reason", 0.72, r"\b(missingness|nonresponse reason|reason missing|refused)\b"),
    ("group", "categorical/nominal/group", 0.55, r"\b(group|grp|arm|cohort|treatment|condition|segment|category|cat)\b"),
    ("geography", "categorical/nominal/geography", 0.68, r"\b(state|county|city|zip|zipcode|country|region|fips|cbsa|tract|census)\b"),
    ("quarter", "temporal/period/quarter", 0.70, r"\b(quarter|qtr|q[1-4])\b"),
    ("year", "temporal/period/year", 0.68, r"\b(year|yr|fy|fiscal year|vintage)\b"),
    ("reporting_period", "temporal/period/reporting_period", 0.58, r"\b(period|reporting period|fiscal period|as of|snapshot)\b"),
    ("calendar_date", "temporal/point/calendar_date", 0.60, r"\b(date|dob|dt|timestamp|datetime)\b"),
    ("person_name", "text/line/person_name", 0.58, r"\b(name|fname|lname|first name|last name|surname|full name)\b"),
    ("org_name", "text/line/organization_name", 0.62, r"\b(company|employer|organization|org name|firm|agency|institution)\b"),
    ("address", "text/line/address", 0.66, r"\b(address|addr|street|mailing)\b"),
    ("title", "text/line/title", 0.55, r"\b(title|headline|subject line)\b"),
    ("long_text", "text/block/long_text", 0.60, r"\b(comment|comments|note|notes|description|remarks|feedback|narrative|abstract)\b"),
]


def tokenised(name: Column) -> Column:
    """A header as lower-case words: camel case is split, and all but letters and digits separates."""
    x = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"))
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def classify_names(names: DataFrame, column: str = "column", min_conf: float = 0.5) -> DataFrame:
    """``column, header, name_class, name_path, confidence`` for each header: its best rule, nulls where none fits."""
    header = tokenised(F.col(column))
    found = F.filter(
        F.array(*(F.when(header.rlike(p), F.struct(F.lit(-conf).alias("c"), F.lit(i).alias("i"), F.lit(n).alias("name_class"), F.lit(path).alias("name_path"))) for i, (n, path, conf, p) in enumerate(NAME_RULES))),
        lambda x: x.isNotNull() & (-x["c"] >= min_conf),
    )
    best = F.array_min(found)
    return names.select(F.col(column).alias("column"), header.alias("header"), best["name_class"].alias("name_class"), best["name_path"].alias("name_path"), (-best["c"]).alias("confidence"))


def score_values(values: DataFrame, detectors: dict[str, Detector] | None = None) -> DataFrame:
    """``column, data_type, n, pass_rate`` over rows ``column, v``, each counted once; null and blank values do not count.

    All detectors run in one pass over the distinct values and meet in one partial aggregation.
    """
    detectors = REGISTRY if detectors is None else detectors
    rows = values.where(F.col("v").isNotNull() & (trimmed(F.col("v")) != "")).select("column", "v")
    rows = rows if "w" in values.columns else rows.distinct()  # with counts, values are distinct already
    wide = rows.groupBy("column").agg(F.count("*").alias("n"), *(F.avg(d(F.col("v")).cast("int")).alias(f"d_{name}") for name, d in detectors.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("data_type"), F.lit(d.index).alias("registry"), F.lit(d.loose).alias("loose"), F.col(f"d_{name}").alias("pass_rate")) for name, d in detectors.items()))
    return wide.select("column", "n", F.inline(pairs))


def guess_columns(values: DataFrame, threshold: float = 0.8, detectors: dict[str, Detector] | None = None) -> DataFrame:
    """One row for each column: its best detector where it reaches ``threshold``, else what its header says.

    Ranked by the rate to three places, then a match of header and type, stricter before loose detectors, the unrounded rate, and the registry.
    """
    detectors = REGISTRY if detectors is None else detectors
    scores = score_values(values, detectors)
    hint = F.exists(F.filter(F.split(F.regexp_replace("data_type", "_", " "), " "), lambda w: F.length(w) >= 3), lambda w: F.lower("column").contains(w))
    order = [F.bround("pass_rate", 3).desc(), hint.desc(), F.col("loose").asc(), F.col("pass_rate").desc(), F.col("registry").asc()]
    ranked = scores.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
    best = ranked.where("place = 1").select("column", "n", F.col("data_type").alias("best_type"), "pass_rate")
    paths = F.create_map(*(x for name, d in detectors.items() for x in (F.lit(name), F.lit("/".join(d.coordinates)))))
    names = classify_names(values.select("column").distinct())
    by_value = F.col("pass_rate") >= threshold
    return names.join(best, "column", "left").select(
        "column",
        F.coalesce("n", F.lit(0)).alias("n_values"),
        F.when(by_value, F.col("best_type")).otherwise(F.col("name_class")).alias("guess"),
        F.when(by_value, paths[F.col("best_type")]).otherwise(F.col("name_path")).alias("path"),
        F.when(by_value, "value").when(F.col("name_class").isNotNull(), "name").otherwise("none").alias("source"),
        F.round(F.when(by_value, F.col("pass_rate")).otherwise(F.col("confidence")), 6).alias("confidence"),
    )


def guess_table(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.8) -> DataFrame:
    return guess_columns(values_frame(df, columns), threshold)
