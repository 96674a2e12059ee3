"""Column profiles from distinct values and counts: blocks of features, each a row for each column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NUMBER, luhn, trimmed
from ..functions.vocabulary import SENTINELS, STOPWORDS
from ..sources.values import usable, values_frame

# Marks of punctuation and their names; marks whose place is measured; patterns of the battery; header keywords.
MARKS = dict(zip("period comma dash under slash colon semi lparen rparen at hash dollar pct amp star plus eq apos quote pipe qmark bang".split(), ".,-_/:;()@#$%&*+='\"|?!", strict=True))
PLACED = "period dash slash at colon comma under lparen hash dollar".split()
PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}\z", "url": r"^(https?://|www\.)\S+\z", "ipv4": r"^([0-9]{1,3}\.){3}[0-9]{1,3}\z",
    "uuid": r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\z", "hexhash": r"^[0-9a-fA-F]{16,}\z", "hexcolor": r"^#?[0-9a-fA-F]{6}\z",
    "base64": r"^[A-Za-z0-9+/]{16,}={0,2}\z", "filepath": r"^([A-Za-z]:)?[/\\].*[/\\]", "jsonfrag": r"^\s*[{\[].*[}\]]\s*\z",
    "phone_us": r"^\(?[0-9]{3}\)?[- .]?[0-9]{3}[- .]?[0-9]{4}\z", "phone_intl": r"^\+[0-9]{1,3}[- ]?[0-9 -]{6,14}\z", "zip5": r"^[0-9]{5}\z", "zip9": r"^[0-9]{5}-[0-9]{4}\z",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z", "ein": r"^[0-9]{2}-[0-9]{7}\z", "ein_bare": r"^[0-9]{9}\z", "fips_st": r"^[0-9]{2}\z", "fips_cty": r"^[0-9]{5}\z",
    "naics": r"^[0-9]{2,6}\z", "cusip": r"^[0-9A-Z]{9}\z", "isin": r"^[A-Z]{2}[0-9A-Z]{9}[0-9]\z", "money": r"^\(?[-$]?[0-9]{1,3}(,[0-9]{3})*(\.[0-9]{2})?\)?\z",
    "percent": r"^-?[0-9]+(\.[0-9]+)?%\z", "sci_not": r"^-?[0-9](\.[0-9]+)?[eE][-+]?[0-9]+\z", "latlon": r"^-?[0-9]{1,3}\.[0-9]{3,}\z",
    "latlon_dms": r"^[0-9]{1,3}[^0-9][0-9]{1,2}'[0-9.]+\"?[NSEW]\z", "date_iso": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "date_us": r"^[0-9]{1,2}/[0-9]{1,2}/([0-9]{2}|[0-9]{4})\z",
    "date_eu": r"^[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{4}\z", "date_word": r"^[0-9]{0,2} ?(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)", "yyyymm": r"^(19|20)[0-9]{2}(0[1-9]|1[0-2])\z",
    "time": r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?( ?[APap]\.?[Mm]\.?)?\z", "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}",
    "duration": r"^[0-9]+(\.[0-9]+)? ?(sec|min|hr|hour|day|week|month|year)s?\z", "org_suffix": r"(Inc|Corp|LLC|Ltd|Foundation|Trust|Assn|Association|Church|Society)\.?\z",
    "person_lastfirst": r"^[A-Z][a-z]+, [A-Z]([a-z]+|\.)\z", "person_firstlast": r"^[A-Z][a-z]+ [A-Z][a-z]+\z", "street_addr": r"^[0-9]+ [A-Z0-9]", "city_state": r"^[A-Za-z .'-]+, ?[A-Z]{2}\z",
}
HEADER_WORDS = {
    "id": r"(^|_)(id|key|num|no|nbr)($|_)", "code": r"code|cd$|_cd", "date": r"date|dt$|day|month|year|yr|time|stamp",
    "amt": r"amt|amount|total|sum|revenue|expense|cost|price|pay|fee|salary|comp", "pct": r"pct|percent|rate|ratio|share|prop", "flag": r"flag|is_|has_|ind$|indicator|_yn",
    "name": r"name|nm$|title|desc|label", "geo": r"city|state|zip|county|fips|addr|street|lat|lon|geo", "cnt": r"count|n_|num_|qty|freq|total_n", "ein": r"ein|tin|fein|taxid",
    "org": r"org|company|firm|entity|filer", "person": r"person|first|last|middle|contact",
}


def V() -> Column:  # noqa: N802
    return F.col("v")


def W() -> Column:  # noqa: N802
    return F.col("w")


def L() -> Column:  # noqa: N802
    return F.length("v")


def share(cond: Column) -> Column:
    """The share of rows with the condition."""
    return F.sum(F.when(cond, W()).otherwise(0)) / F.sum(W())


def mean(x: Column) -> Column:
    return F.sum(x * W()) / F.sum(F.when(x.isNotNull(), W()))


def spread(x: Column) -> Column:
    """Population standard deviation over rows; null with fewer than two distinct values."""
    return F.when(F.count_distinct(x) >= 2, F.sqrt(F.greatest(F.lit(0.0), F.sum(x * x * W()) / F.sum(W()) - F.pow(mean(x), 2))))


def core(values: DataFrame) -> DataFrame:
    """Counts, shares and evenness. Shares come from counts of counts, so no column's values are ranked in one task."""
    missing, sentinel = V().isNull(), F.coalesce(F.lower(trimmed(V())).isin(SENTINELS), F.lit(False))
    base = values.groupBy("column").agg(F.sum("w").alias("n"), (F.sum(F.when(missing, W()).otherwise(0)) / F.sum("w")).alias("pct_missing"), (F.sum(F.when(sentinel, W()).otherwise(0)) / F.sum("w")).alias("pct_sentinel_na"))
    counts = usable(values).groupBy("column", "w").agg(F.count("*").alias("k"))
    down = Window.partitionBy("column").orderBy(F.col("w").desc())
    ranked = counts.withColumn("upto", F.sum("k").over(down)).withColumn("total", F.sum(F.col("w") * F.col("k")).over(Window.partitionBy("column")))
    p = F.col("w") / F.col("total")
    first = lambda m: F.sum(F.col("w") * F.greatest(F.lit(0), F.least(F.col("k"), m - (F.col("upto") - F.col("k")))))
    out = ranked.groupBy("column").agg(
        F.first("total").alias("n_usable"), F.sum("k").alias("n_unique"), F.max("w").alias("max_value_freq"),
        (first(F.lit(1)) / F.first("total")).alias("top1_share"), (first(F.lit(5)) / F.first("total")).alias("top5_share"), (first(F.lit(2)) - first(F.lit(1))).alias("second"),
        (F.sum(F.when(W() == 1, F.col("k")).otherwise(0)) / F.sum("k")).alias("hapax_ratio"), (-F.sum(F.col("k") * p * F.log(p))).alias("entropy"), (1 - F.sum(F.col("k") * p * p)).alias("gini_simpson"),
        F.sum(W() * W() * F.col("k")).alias("ww"),
    )
    u, m = F.col("n_unique"), F.col("n_usable") / F.col("n_unique")
    cols = ["unique_ratio", "log_n_unique", "is_candidate_key", "is_constant", "top1_to_top2", "entropy_norm", "mean_value_freq", "freq_cv"]
    made = [u / F.col("n_usable"), F.log1p(u), (u == F.col("n_usable")).cast("double"), (u <= 1).cast("double"), F.when(F.col("second") > 0, F.col("max_value_freq") / F.col("second")), F.when(u >= 2, F.col("entropy") / F.log(u)), m, F.when(u >= 2, F.sqrt(F.greatest(F.lit(0.0), (F.col("ww") - u * m * m) / (u - 1))) / m)]
    out = out.withColumns(dict(zip(cols, made, strict=True))).drop("second", "ww")
    return base.join(out, "column", "left").withColumns({"n_usable": F.coalesce("n_usable", F.lit(0)), "n_unique": F.coalesce("n_unique", F.lit(0))})


def zipf(values: DataFrame) -> DataFrame:
    """Slope and fit of log count on log rank, for ten values or more that do not all occur once."""
    counts = usable(values).groupBy("column", "w").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("column").orderBy(F.col("w").desc()))
    ranks = counts.withColumn("upto", upto).select("column", "w", F.explode(F.sequence(F.col("upto") - F.col("k") + 1, F.col("upto"))).alias("r"))
    fit = ranks.groupBy("column").agg(F.regr_slope(F.log("w"), F.log("r")).alias("zipf_slope"), F.regr_r2(F.log("w"), F.log("r")).alias("zipf_r2"), F.count("*").alias("k"), F.max("w").alias("m"))
    ok = (F.col("k") >= 10) & (F.col("m") > 1)
    return fit.select("column", F.when(ok, F.col("zipf_slope")).alias("zipf_slope"), F.when(ok, F.col("zipf_r2")).alias("zipf_r2"))


def length(values: DataFrame) -> DataFrame:
    tokens = F.size(F.split(trimmed(V()), r"\s+"))
    return usable(values).groupBy("column").agg(
        mean(L()).alias("len_mean"), spread(L()).alias("len_sd"), F.min(L()).alias("len_min"), F.max(L()).alias("len_max"), (F.max(L()) - F.min(L())).alias("len_range"),
        F.percentile(L(), F.lit(0.5), F.least(W(), F.lit(1000))).alias("len_median"), (F.min(L()) == F.max(L())).cast("double").alias("is_fixed_width"), F.count_distinct(L()).alias("n_distinct_len"),
        share(V().rlike("^0[0-9]")).alias("has_leading_zeros"), share(V().rlike(r"^\s")).alias("pct_lead_ws"), share(V().rlike(r"\s\z")).alias("pct_trail_ws"),
        share(V().rlike(r"\s{2,}")).alias("pct_multi_ws"), mean(tokens).alias("tok_mean"), spread(tokens).alias("tok_sd"), F.max(tokens).alias("tok_max"), share(tokens == 1).alias("pct_single_tok"),
    )


def charclass(values: DataFrame) -> DataFrame:
    count = lambda p: F.regexp_count(V(), F.lit(p))
    parts = {"digit": "[0-9]", "alpha": "[A-Za-z]", "space": r"\s", "punct": r"\p{Punct}"}
    shares = {k: count(p) / F.nullif(L(), F.lit(0)) for k, p in parts.items()}
    return usable(values).groupBy("column").agg(
        *(mean(s).alias(f"pct_chr_{k}") for k, s in shares.items()),
        mean(1 - reduce(lambda a, b: a + b, shares.values())).alias("pct_chr_other"), mean((F.octet_length(V()) - count(r"[\x00-\x7F]")) / F.nullif(L(), F.lit(0))).alias("pct_nonascii"),
        spread(shares["digit"]).alias("sd_pct_digit"), spread(shares["alpha"]).alias("sd_pct_alpha"),
        *(share(V().rlike(p)).alias(f"pct_{k}") for k, p in {"all_digits": r"^[0-9]+\z", "all_alpha": r"^[A-Za-z]+\z", "all_alpha_sp": r"^[A-Za-z ]+\z", "alnum_mixed": "(?s)^(?=.*[0-9])(?=.*[A-Za-z])", "starts_digit": r"^[0-9]", "ends_digit": r"[0-9]\z", "title_case": r"^[A-Z][a-z]+( [A-Z][a-z']+)*\z", "camel_case": "^[a-z]+[A-Z]"}.items()),
        share(V().rlike("[A-Za-z]") & (V() == F.upper(V()))).alias("pct_all_upper"), share(V().rlike("[A-Za-z]") & (V() == F.lower(V()))).alias("pct_all_lower"),
        mean(count("[A-Z]") / F.nullif(count("[A-Za-z]"), F.lit(0))).alias("pct_upper_chr"),
    )


def punct(values: DataFrame) -> DataFrame:
    out = []
    for name, ch in MARKS.items():
        n = L() - F.length(F.replace(V(), F.lit(ch), F.lit("")))
        out += [share(n > 0).alias(f"has_{name}"), mean(n).alias(f"cnt_{name}"), spread(n).alias(f"sd_{name}"), ((F.min(n) == F.max(n)) & (F.max(n) > 0)).cast("double").alias(f"const_{name}")]
        if name in PLACED:
            at = F.nullif(F.instr(V(), ch), F.lit(0))
            out += [F.when(F.count(at) > 0, F.count_distinct(at) / F.count(at)).alias(f"possd_{name}"), mean(at / L()).alias(f"posrel_{name}"), F.percentile(at, F.lit(0.5)).alias(f"posmed_{name}")]
    half = len(out) // 2  # two aggregates: one would be too much code for a method
    u = usable(values)
    return u.groupBy("column").agg(*out[:half]).join(u.groupBy("column").agg(*out[half:]), "column")


def mask_of(c: Column) -> Column:
    """Digits as 9, capitals as A, small letters as a."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")


def mask(values: DataFrame) -> DataFrame:
    """Shapes of values, plain and with runs collapsed, and what all values begin and end with: that of the least and the greatest."""
    rows = usable(values).withColumn("m", mask_of(V()))
    by = lambda c, pre: rows.groupBy("column", F.expr(c).alias("x")).agg(F.sum("w").alias("w"), F.count("*").alias("k")).groupBy("column").agg(F.count("*").alias(f"n_{pre}s"), (F.count("*") / F.sum("k")).alias(f"{pre}_unique_ratio"), (F.max("w") / F.sum("w")).alias(f"{pre}_top_share"), (F.log(F.sum("w")) - F.sum(W() * F.log(W())) / F.sum("w")).alias(f"{pre}_entropy"))
    ends = rows.groupBy("column").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.min(F.reverse("v")).alias("c"), F.max(F.reverse("v")).alias("d"))
    common = lambda x, y: F.expr(f"size(filter(sequence(1, greatest(1, least(length({x}), length({y})))), i -> left({x}, i) = left({y}, i) and i <= length({x})))")
    plain = by("m", "mask").withColumn("mask_residual_rate", 1 - F.col("mask_top_share")).withColumn("is_single_mask", (F.col("mask_top_share") > 0.95).cast("double")).withColumn("mask_entropy_norm", F.when(F.col("n_masks") >= 2, F.col("mask_entropy") / F.log("n_masks")))
    return plain.join(by(r"regexp_replace(m, '(.)\\1+', '$1+')", "cmask"), "column").join(ends.select("column", common("a", "b").alias("lcp_len"), common("c", "d").alias("lcs_len")), "column")


def charfreq(values: DataFrame) -> DataFrame:
    """Shares of letters and digits among all letters and digits."""
    low = F.lower(V())
    n = {ch: F.sum((F.length(low) - F.length(F.replace(low, F.lit(ch), F.lit("")))) * W()) for ch in "abcdefghijklmnopqrstuvwxyz0123456789"}
    raw = usable(values).groupBy("column").agg(*(c.alias(f"c_{ch}") for ch, c in n.items()))
    total = lambda chars: F.nullif(reduce(lambda a, b: a + b, (F.col(f"c_{ch}") for ch in chars)), F.lit(0))
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    entropy = lambda chars, t: -reduce(lambda a, b: a + b, (F.when(F.col(f"c_{ch}") > 0, F.col(f"c_{ch}") / t * F.log(F.col(f"c_{ch}") / t)).otherwise(0.0) for ch in chars))
    return raw.select("column", *((F.col(f"c_{ch}") / total(letters)).alias(f"ltr_{ch}") for ch in letters), *((F.col(f"c_{ch}") / total(digits)).alias(f"dig_{ch}") for ch in digits), entropy(letters, total(letters)).alias("ltr_entropy"), entropy(digits, total(digits)).alias("dig_entropy"))


def regex(values: DataFrame) -> DataFrame:
    rates = usable(values).groupBy("column").agg(
        *(share(V().rlike(p)).alias(f"rx_{k}") for k, p in PATTERNS.items()),
        share(F.lower(trimmed(V())).isin("true", "false", "t", "f", "yes", "no", "y", "n", "1", "0")).alias("rx_boolean"),
        (F.sum(F.when(V().rlike(r"^[0-9]{12,}\z") & luhn(V()), W())) / F.sum(F.when(V().rlike(r"^[0-9]{12,}\z"), W()))).alias("chk_luhn_rate"),
    )
    return rates.withColumn("rx_n_hits", reduce(lambda a, b: a + b, ((F.col(f"rx_{k}") > 0.9).cast("int") for k in PATTERNS)))


def stripped(c: Column) -> Column:
    """A number as text without ``$``, commas, percent signs and spaces; brackets mean minus."""
    x = F.regexp_replace(c, "[$,%\\s ]", "")
    return F.regexp_replace(x, r"^\((.*)\)\z", "-$1")


def numeric(values: DataFrame) -> DataFrame:
    """Measures of the values that are numbers; null where fewer than three rows are."""
    s = F.col("s")
    rows = usable(values).withColumn("s", stripped(V())).withColumn("x", F.when(s.rlike(NUMBER), s.try_cast("double"))).withColumn("raw", V().rlike(NUMBER))
    x = F.col("x")
    decimals = F.when(x.isNotNull(), F.when(s.contains("."), F.length(F.substring_index(s, ".", -1))).otherwise(0))
    of = lambda cond: F.sum(F.when(cond, W()).otherwise(0)) / F.sum(F.when(x.isNotNull(), W()))
    nw = F.sum(F.when(x.isNotNull(), W()))
    m1 = F.sum(x * W()) / nw
    made = {
        "num_min": F.min(x), "num_max": F.max(x), "num_mean": m1, "num_sd": F.when(F.count_distinct(x) >= 2, F.sqrt(F.greatest(F.lit(0.0), F.sum(x * x * W()) / nw - m1 * m1))),
        "num_median": F.percentile(x, F.lit(0.5), F.least(W(), F.lit(500))), "num_iqr": F.percentile(x, F.lit(0.75), F.least(W(), F.lit(500))) - F.percentile(x, F.lit(0.25), F.least(W(), F.lit(500))),
        "pct_integer": of(x == F.floor(x)), "pct_negative": of(x < 0), "pct_zero": of(x == 0), "pct_positive": of(x > 0), "dec_mean": F.sum(decimals * W()) / nw, "dec_max": F.max(decimals), "dec_n_distinct": F.count_distinct(decimals),
        **{k: F.min(x.between(a, b).cast("double")) for k, (a, b) in {"bound_unit": (0, 1), "bound_pct": (0, 100), "bound_corr": (-1, 1), "bound_lat": (-90, 90), "bound_lon": (-180, 180), "bound_age": (0, 120), "range_excel_dt": (25000, 60000), "range_epoch_s": (5e8, 2.5e9), "range_epoch_ms": (5e11, 2.5e12)}.items()},
        "bound_year": F.min((x.between(1900, 2100) & (x == F.floor(x))).cast("double")), "all_integer": F.min((x == F.floor(x)).cast("double")), "dec_fixed_2": F.min((decimals == 2).cast("double")), "dec_fixed": (F.count_distinct(decimals) == 1).cast("double"),
        "num_cv": F.when(m1 != 0, F.when(F.count_distinct(x) >= 2, F.sqrt(F.greatest(F.lit(0.0), F.sum(x * x * W()) / nw - m1 * m1))) / F.abs(m1)),
        "pct_round_10": of(x % 10 == 0), "pct_round_100": of(x % 100 == 0), "pct_num_sentinel": of(x.isin(-1.0, -8.0, -9.0, -99.0, -999.0, -9999.0, 999.0, 9999.0, 99999.0, 999999.0)),
    }
    return rows.groupBy("column").agg((F.sum(F.when(F.col("raw"), W()).otherwise(0)) / F.sum(W())).alias("coerce_rate_raw"), (F.sum(F.when(x.isNotNull(), W()).otherwise(0)) / F.sum(W())).alias("coerce_rate_strip"), *(F.when(nw >= 3, c).alias(k) for k, c in made.items()))


def token(values: DataFrame) -> DataFrame:
    """Tokens of letters, digits and apostrophes in small letters. The type-token ratio and the closure are over distinct values."""
    u = usable(values)
    toks = u.select("column", "w", F.explode(F.filter(F.split(F.lower(F.regexp_replace(V(), "[^A-Za-z0-9' ]", " ")), " +"), lambda t: t != "")).alias("t"))
    by = toks.groupBy("column", "t").agg(F.sum("w").alias("w"), F.count("*").alias("k"))
    t = F.col("t")
    entropy = F.log(F.sum(W())) - F.sum(W() * F.log(W())) / F.sum(W())
    out = by.groupBy("column").agg(
        F.count("*").alias("tok_n_unique"), entropy.alias("tok_entropy"), F.when(F.count("*") >= 2, entropy / F.log(F.count("*"))).alias("tok_entropy_norm"), (F.sum(F.when(W() == 1, 1).otherwise(0)) / F.count("*")).alias("tok_hapax_ratio"), (F.count("*") / F.sum("k")).alias("tok_ttr"),
        share(t.isin(STOPWORDS)).alias("stopword_rate"), mean(F.length(t)).alias("tok_len_mean"), F.sqrt(F.greatest(F.lit(0.0), mean(F.length(t) * F.length(t)) - F.pow(mean(F.length(t)), 2))).alias("tok_len_sd"),
        share(t.rlike(r"^[a-z']+\z")).alias("pct_tok_alpha"), share(t.rlike(r"^[0-9]+\z")).alias("pct_tok_numeric"), share(t.rlike("[a-z]") & t.rlike("[0-9]")).alias("pct_tok_mixed"), (F.sum(F.regexp_count(t, F.lit("[aeiou]")) * W()) / F.sum(F.length(t) * W())).alias("vowel_rate"),
    )
    distinct = u.groupBy("column").agg(F.count("*").alias("n_values"))
    return out.join(distinct, "column").withColumn("tok_vocab_closure", F.col("tok_n_unique") / F.col("n_values")).drop("n_values")


def header(values: DataFrame) -> DataFrame:
    name = F.lower("column")
    return values.select("column").distinct().select("column", *(name.rlike(p).cast("double").alias(f"nm_{k}") for k, p in HEADER_WORDS.items()), F.length("column").alias("nm_nchar"), F.col("column").contains("_").cast("double").alias("nm_has_under"), (F.col("column") == F.upper("column")).cast("double").alias("nm_is_upper"), F.size(F.split("column", "[_ .]+")).alias("nm_n_tokens"))


BLOCKS = {"core": core, "zipf": zipf, "length": length, "charclass": charclass, "punct": punct, "mask": mask, "charfreq": charfreq, "regex": regex, "numeric": numeric, "token": token, "header": header}


def profile(df: DataFrame, columns: list[str] | None = None, blocks: list[str] | None = None) -> DataFrame:
    """All chosen blocks' features, a row for each column; core is always part of it. Blocks share the shuffle that makes the value table."""
    from . import profile_ends, profile_more  # noqa: F401 - they use the helpers above, and add their blocks

    values = values_frame(df, columns)
    frames = [BLOCKS[b](values) for b in dict.fromkeys(["core", *(blocks or BLOCKS)])]
    return reduce(lambda a, b: a.join(b, "column", "left"), frames)
