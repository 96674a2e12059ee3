"""Screens of columns: spreadsheet hazards, round trips through files, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.values import usable
from . import profile as P

# Hazards and the patterns of values, upper-cased where marked, that run into them.
HAZARDS = {
    "leading_zeros_dropped": (r"^0[0-9]+\z", False),
    "precision_loss_15_digits": (r"^[0-9]{16,}\z", False),
    "coerced_to_date": (r"^[0-9]{1,2}[-/][0-9]{1,2}([-/][0-9]{2,4})?\z", False),
    "symbol_coerced_to_date": (r"^(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[0-9]{1,2}\z", True),
    "sequence_at_date_risk": (r"^[ACGT]{3,}\z", True),
    "formula_injection": (r"^[=+@]|^-[^0-9.]", False),
    "scientific_notation_expansion": (r"^[0-9]+[eE][-+]?[0-9]+\z", False),
}


def hazards(values: DataFrame) -> DataFrame:
    """``column, hazards``: what a spreadsheet would do to values of each column, joined by commas."""
    v = F.col("v")
    flags = values.groupBy("column").agg(*(F.coalesce(F.bool_or((F.upper(v) if up else v).rlike(p)), F.lit(False)).alias(h) for h, (p, up) in HAZARDS.items()))
    return flags.select("column", F.array_join(F.array_compact(F.array(*(F.when(F.col(h), F.lit(h)) for h in HAZARDS))), ",").alias("hazards"))


def roundtrip(values: DataFrame) -> DataFrame:
    """``column, inferred, value_changed, hazards``: the type a reader of a CSV file infers, and whether values come back other than they were."""
    v = F.col("v")
    rows = usable(values)
    every = lambda p: F.coalesce(F.bool_and(v.rlike(p)), F.lit(False))
    kinds = rows.groupBy("column").agg(every(r"^[+-]?[0-9]+\z").alias("i"), every(P.NUMBER).alias("d"), every(r"^(?i:true|false|t|f)\z").alias("l"), F.bool_or(v.rlike(r"^[+-]?0[0-9]+\z|^\+|^[0-9]{16,}\z")).alias("zero"), F.bool_or(v.rlike(r"\.[0-9]*0\z|[eE]|\.\z")).alias("tail"))
    inferred = F.when(F.col("i"), "integer").when(F.col("d"), "double").when(F.col("l"), "logical").otherwise("character")
    changed = F.when(F.col("i"), F.col("zero")).when(F.col("d"), F.col("zero") | F.col("tail")).when(F.col("l"), F.lit(True)).otherwise(F.lit(False))
    return kinds.select("column", inferred.alias("inferred"), changed.alias("value_changed")).join(hazards(rows), "column")


# The class a reader has to give for a storage, and storages that no reader can see in values.
STORAGE = {"character": "character", "string": "character", "factor": "character", "integer": "integer", "double": "numeric", "numeric": "numeric", "logical": "logical", "date": "character", "datetime": "character"}
ALWAYS_RULE = ["factor", "ordered", "date", "datetime"]


def roundtrip_check(values: DataFrame, intended: DataFrame) -> DataFrame:
    """``id, intended, inferred_base, inferred_guess, value_changed, type_wrong, reader_disagree, excel_hazards, needs_import_rule, reason`` for each column of stable values.

    ``intended`` has ``column, storage``. The first reader takes a file of quoted values, in which blanks at the ends do not make text of numbers; the second guesses from the values
    as they are. Columns without a usable value are logical to both.
    """
    v = F.col("v")
    rows = usable(values)
    every = lambda x, p: F.coalesce(F.bool_and(x.rlike(p)), F.lit(False))
    bare = F.btrim(v, F.lit(" "))
    truth = r"^(?:T|F|TRUE|FALSE|true|false)\z"

    def inferred(x: Column) -> Column:
        return F.when(every(x, truth), "logical").when(every(x, r"^[+-]?[0-9]{1,9}\z"), "integer").when(every(x, P.NUMBER), "numeric").otherwise("character")

    changed = F.when(every(bare, truth), F.bool_or(~bare.isin("TRUE", "FALSE"))).when(every(bare, P.NUMBER), F.bool_or(bare.rlike(r"^[+-]?0[0-9]+\z|^\+|^[0-9]{16,}\z|\.[0-9]*0\z|[eE]|\.\z|^-?\.")))
    kinds = rows.groupBy("column").agg(inferred(bare).alias("inferred_base"), inferred(v).alias("inferred_guess"), F.coalesce(changed, F.lit(False)).alias("value_changed"))
    j = intended.join(kinds, "column", "left").join(hazards(values), "column", "left").na.fill({"inferred_base": "logical", "inferred_guess": "logical", "value_changed": False, "hazards": ""})
    storage = F.lower("storage")
    want = F.create_map(*(F.lit(x) for kv in STORAGE.items() for x in kv))[storage]
    j = j.withColumns({
        "type_wrong": F.coalesce(want != F.col("inferred_base"), F.lit(False)), "reader_disagree": F.col("inferred_base") != F.col("inferred_guess"), "always": storage.isin(ALWAYS_RULE), "risky": F.col("hazards") != "",
    })
    flags = {"value_changed": "VALUE_CHANGED", "type_wrong": "TYPE_WRONG", "reader_disagree": "READER_DISAGREE", "always": "NOT_INFERABLE_FROM_VALUES", "risky": "EXCEL_HAZARD"}
    reasons = F.array_compact(F.array(*(F.when(F.col(c), F.lit(t)) for c, t in flags.items())))
    return j.select(
        F.col("column").alias("id"), F.col("storage").alias("intended"), "inferred_base", "inferred_guess", "value_changed", "type_wrong", "reader_disagree", F.regexp_replace("hazards", ",", ";;").alias("excel_hazards"),
        (F.size(reasons) > 0).alias("needs_import_rule"), F.array_join(reasons, ";;").alias("reason"),
    )


def difficulty(f: DataFrame) -> DataFrame:
    """Adds ``rating`` (hard, medium, easy) and ``markers`` of noise to rows of features; a feature that is null counts as 0."""
    g = lambda k: F.coalesce(F.col(k).cast("double"), F.lit(0.0))
    found = {
        "mixed_subformats": g("mask_top_share") < 0.9, "sentinel_missing": g("pct_sentinel_na") > 0, "whitespace_damage": (g("pct_trail_ws") > 0) | (g("pct_lead_ws") > 0),
        "mixed_case": (g("pct_all_upper") > 0.05) & (g("pct_title_case") > 0.05), "encoding_damage": g("pct_nonascii") > 0.01,
    }
    markers = F.array_compact(F.array(*(F.when(ok, F.lit(k)) for k, ok in found.items())))
    return f.withColumns({"markers": markers, "rating": F.when(g("mask_top_share") < 0.5, "hard").when(F.size(markers) > 0, "medium").otherwise("easy")})


def triage(values: DataFrame, expected: Column | None = None) -> DataFrame:
    """``column, verdict, keep, reasons, difficulty, noise_markers``: empty, garbage, mismatch with the type that is expected (a column over ``column``), hard or clean.

    Empty and garbage columns are not kept, and have no difficulty. All features come from distinct values and counts.
    """
    f = P.core(values)
    for block in (P.charclass, P.mask, P.numeric, P.length):
        f = f.join(block(values), "column", "left")
    f = difficulty(f)
    c = F.col
    empty = F.when(c("n_usable") < 8, "n_usable < 8").when(c("is_constant") == 1, "constant column").when(c("pct_sentinel_na") > 0.9, "all-sentinel")
    garbage = F.array_compact(
        F.array(
            F.when(c("pct_nonascii") > 0.15, F.format_string("non-ascii %.0f%% (mojibake)", 100 * c("pct_nonascii"))),
            F.when((c("pct_chr_punct") > 0.5) & (c("pct_chr_alpha") < 0.2) & (c("pct_chr_digit") < 0.2), F.lit("punctuation-dominant")),
            F.when((c("mask_top_share") > 0.9) & (c("pct_chr_alpha") + c("pct_chr_digit") < 0.15), F.lit("single-punctuation mask")),
        )
    )
    numeric = F.coalesce(c("coerce_rate_strip") > 0.7, F.lit(False))
    wanted = (expected if expected is not None else F.lit(None).cast("string")) == "number"
    mismatch = F.coalesce(wanted != numeric, F.lit(False))
    words = lambda x: F.when(x, "numeric").otherwise("non-numeric")
    unlike = F.format_string("values look %s but label implies %s", words(numeric), words(wanted))
    gone = empty.isNotNull() | (F.size(garbage) > 0)
    verdict = F.when(empty.isNotNull(), "empty").when(F.size(garbage) > 0, "garbage").when(mismatch, "mismatch").when(c("rating") == "hard", "hard").otherwise("clean")
    reasons = F.when(empty.isNotNull(), F.array(empty)).when(F.size(garbage) > 0, garbage).when(mismatch, F.array(unlike)).otherwise(F.array(F.lit("genuine example")))
    return f.select("column", verdict.alias("verdict"), (~gone).alias("keep"), F.array_join(reasons, ",").alias("reasons"), F.when(~gone, c("rating")).alias("difficulty"), F.when(~gone, F.array_join("markers", ",")).otherwise("").alias("noise_markers"))
