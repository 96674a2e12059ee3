"""Queries over the sample tables, and DuckDB SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import SENTINELS, STATES, STOPWORDS
from ..operators import screens, similarity, testgen
from ..operators import profile as P
from ..operators import profile_ends as E
from ..operators.detectors import REGISTRY
from ..operators.scoring import NAME_RULES, classify_names, guess_columns, score_values
from ..operators.stabilize import transform
from ..sources.values import values_frame
from ..streaming.rates import detector_rates
from .columns import COLUMNS
from .lifecycle import LIFECYCLE
from .more import MORE
from .probes import detect_probes, detect_probes_sql
from .verbs import stabilize_probes, stabilize_probes_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TEXTS = {"customer": ["c_name", "c_mktsegment"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "pages": ["url"]}
NUMBERS = {"lineitem": ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def values_of(spark: SparkSession, sf_dir: str, tables: dict[str, list[str]]) -> DataFrame:
    frames = [values_frame(read(spark, sf_dir, t), cols) for t, cols in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All measures as doubles of so many places."""
    return df.select(*[F.col(c) if t == "string" else F.round(F.col(c).cast("double"), places).alias(c) for c, t in df.dtypes])


def sql_values(tables: dict[str, list[str]]) -> str:
    each = [f"select '{c}' as \"column\", cast({c} as varchar) as v, count(*) as w from {t} group by 2" for t, cols in tables.items() for c in cols]
    return "with vals as (" + " union all ".join(each) + "), u as (select * from vals where v is not null and lower(trim(v)) not in (" + ", ".join(f"'{s}'" for s in SENTINELS) + "))"


def sql_measures(measures: dict[str, str], places: int = 6) -> str:
    return ", ".join(f'round(cast({e} as double), {places}) as "{n}"' for n, e in measures.items())


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SHARE = "sum(case when {} then w else 0 end) / sum(w)"

# ---- what columns hold -------------------------------------------------------------------------------------------------


query("detect_probes", detect_probes_sql())(detect_probes)
query("stabilize_probes", stabilize_probes_sql())(stabilize_probes)

SIMPLE = {
    "currency_symbol": r"^[$€¥£][0-9]+(\.[0-9]{1,2})?\z", "md5": r"^[0-9a-fA-F]{32}\z", "zip_code": r"^[0-9]{5}(-[0-9]{4})?\z", "snp_id": r"^rs[0-9]+\z", "asin": r"^B0[0-9A-Z]{8}\z", "icd10_code": r"^[A-Z][0-9]{2}(\.[A-Z0-9]{1,4})?\z",
    "yyyymm": r"^(19|20)[0-9]{2}(0[1-9]|1[0-2])\z", "uei": r"^[A-HJ-NP-Z1-9][A-HJ-NP-Z0-9]{11}\z", "msisdn": r"^[0-9]{10,15}\z", "url": r"(?i)^(https?|ftp)://[[:alnum:]_-]+(\.[[:alnum:]_-]+)+([:/?#]\S*)?\z",
}


@query(
    "score_columns",
    sql_values(TEXTS)
    + ", d as (select distinct \"column\", v from vals where v is not null and trim(v) <> '') "
    + " union all ".join(f"select \"column\", '{n}' as data_type, count(*) as n, round(avg(case when regexp_matches(v, {q(p)}) then 1.0 else 0.0 end), 6) as pass_rate from d group by 1" for n, p in SIMPLE.items()),
)
def score_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_values(values_of(spark, sf_dir, TEXTS), {n: REGISTRY[n] for n in SIMPLE})
    return scores.select("column", "data_type", "n", F.round("pass_rate", 6).alias("pass_rate"))


def detect(name: str, table: str, expression: str, detector: str, sql_value: str, sql_rule: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(spark, sf_dir, table).select(F.expr(expression).alias("v"))
        return rows.agg(F.count("v").alias("n"), F.sum(REGISTRY[detector](F.col("v")).cast("long")).alias("hits"))

    query(f"detect_{name}", f"select count(v) as n, sum(case when {sql_rule} then 1 else 0 end)::bigint as hits from (select {sql_value} as v from {table})")(run)


def _luhn_sql(s: str, n: int) -> str:
    """Luhn's rule for texts of n digits."""
    parts = []
    for i in range(1, n + 1):
        d = f"cast(substr({s}, {i}, 1) as int)"
        parts.append(f"(case when 2 * {d} > 9 then 2 * {d} - 9 else 2 * {d} end)" if (n - i) % 2 else d)
    return f"({' + '.join(parts)}) % 10 = 0"


def _weighted_sql(s: str, weights: list[int]) -> str:
    return " + ".join(f"cast(substr({s}, {i}, 1) as int) * {w}" for i, w in enumerate(weights, 1))


KEY10 = "lpad(cast(l_orderkey * 7919 + l_linenumber as {}), 10, '0')"
detect("url", "pages", "url", "url", "url", f"regexp_matches(v, {q(SIMPLE['url'])})")
detect("json", "events", "props", "json", "props", r"regexp_matches(trim(v), '(?s)^\{\s*\".+\"\s*:.*\}\z|^\[.*\]\z')".replace('\\"', '"'))
detect("boolean", "lineitem", "l_linestatus", "boolean", "l_linestatus", "lower(trim(v)) in ('true','false','t','f','yes','no','y','n','1','0')")
detect("iso_date", "orders", "date_format(o_orderdate, 'yyyy-MM-dd')", "iso_date", "strftime(o_orderdate, '%Y-%m-%d')", r"regexp_matches(v, '^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\z')")
detect("iso_datetime", "events", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", "iso_datetime", "strftime(ts, '%Y-%m-%dT%H:%M:%S')", r"regexp_matches(v, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\z')")
detect("npi", "lineitem", KEY10.format("string"), "npi", KEY10.format("varchar"), _luhn_sql("('80840' || v)", 15))
detect("isbn", "lineitem", KEY10.format("string"), "isbn", KEY10.format("varchar"), f"({_weighted_sql('v', list(range(10, 0, -1)))}) % 11 = 0")
detect("unix_time", "lineitem", KEY10.format("string"), "unix_time", KEY10.format("varchar"), "cast(v as bigint) between 100000000 and 9999999999")
detect("ssn", "lineitem", "concat(substr(lpad(l_orderkey * 31, 9, '0'), 1, 3), '-', substr(lpad(l_orderkey * 31, 9, '0'), 4, 2), '-', substr(lpad(l_orderkey * 31, 9, '0'), 6, 4))", "ssn",
       "substr(lpad(cast(l_orderkey * 31 as varchar), 9, '0'), 1, 3) || '-' || substr(lpad(cast(l_orderkey * 31 as varchar), 9, '0'), 4, 2) || '-' || substr(lpad(cast(l_orderkey * 31 as varchar), 9, '0'), 6, 4)",
       "substr(v,1,3) not in ('000','666') and substr(v,1,1) <> '9' and substr(v,5,2) <> '00' and substr(v,8,4) <> '0000'")
detect("dea", "lineitem", "concat('AB', lpad(l_orderkey * 13 + l_linenumber, 7, '0'))", "dea", "'AB' || lpad(cast(l_orderkey * 13 + l_linenumber as varchar), 7, '0')", f"({_weighted_sql('substr(v, 3)', [1, 2, 1, 2, 1, 2])}) % 10 = cast(substr(v, 9, 1) as int)")
detect("issn", "lineitem", "concat(substr(lpad(l_orderkey * 17, 8, '0'), 1, 4), '-', substr(lpad(l_orderkey * 17, 8, '0'), 5, 4))", "issn",
       "substr(lpad(cast(l_orderkey * 17 as varchar), 8, '0'), 1, 4) || '-' || substr(lpad(cast(l_orderkey * 17 as varchar), 8, '0'), 5, 4)", f"({_weighted_sql('replace(v, chr(45), chr(0)[:0])'.replace('chr(0)[:0]', repr('')), list(range(8, 0, -1)))}) % 11 = 0")
detect("us_date", "orders", "date_format(o_orderdate, 'M/d/yyyy')", "us_date", "month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate)", "true")

TABLE_HEADERS = ["c_custkey", "c_name", "c_acctbal", "o_orderdate", "o_totalprice", "o_orderstatus", "l_quantity", "l_discount", "l_shipdate", "customerId", "emailAddress", "is_active", "sampling_weight", "survival_rate", "zipCode", "n children", "unitPrice", "first_name", "notes", "q3_total", "xqz_blob_42"]


@query(
    "classify_headers",
    "with h as (select unnest(['" + "','".join(TABLE_HEADERS) + "']) as \"column\"), t as (select \"column\", trim(regexp_replace(lower(regexp_replace(\"column\", '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')) as header from h) select \"column\", header, "
    + ", ".join("case " + " ".join(f"when regexp_matches(header, {q(p)}) then {value(n, path, conf)}" for n, path, conf, p in sorted(NAME_RULES, key=lambda r: -r[2])) + f" end as {alias}" for alias, value in (("name_class", lambda n, path, conf: f"'{n}'"), ("name_path", lambda n, path, conf: f"'{path}'"), ("confidence", lambda n, path, conf: f"cast({conf} as double)")))
    + " from t",
)
def classify_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_names(spark.createDataFrame([(h,) for h in TABLE_HEADERS], "column string"))


# ---- profiles ----------------------------------------------------------------------------------------------------------

_CORE = {
    "n_usable": "sum(w)", "n_unique": "count(*)", "unique_ratio": "count(*) / sum(w)", "log_n_unique": "ln(1 + count(*))", "is_candidate_key": "case when count(*) = sum(w) then 1 else 0 end", "is_constant": "case when count(*) <= 1 then 1 else 0 end",
    "max_value_freq": "max(w)", "top1_share": "max(w) / sum(w)", "top5_share": "list_sum(list_slice(list_reverse_sort(list(w)), 1, 5)) / sum(w)", "hapax_ratio": "sum(case when w = 1 then 1 else 0 end) / count(*)",
    "entropy": "ln(sum(w)) - sum(w * ln(w)) / sum(w)", "mean_value_freq": "sum(w) / count(*)", "freq_cv": "case when count(*) > 1 then stddev_samp(w) / avg(w) end",
}


@query("profile_core", sql_values(TEXTS) + f' select "column", {sql_measures(_CORE)} from u group by 1')
def profile_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.core(values_of(spark, sf_dir, TEXTS)).select("column", *_CORE))


@query("profile_zipf", sql_values(TEXTS) + ", r as (select *, row_number() over (partition by \"column\" order by w desc, v) as r from u) select \"column\", case when count(*) >= 10 and max(w) > 1 then round(regr_slope(ln(w), ln(r)), 6) end as zipf_slope, case when count(*) >= 10 and max(w) > 1 then round(regr_r2(ln(w), ln(r)), 6) end as zipf_r2 from r group by 1")
def profile_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.zipf(values_of(spark, sf_dir, TEXTS)))


_TOK = r"len(regexp_split_to_array(trim(v), '\s+'))"


def _sd(x: str) -> str:
    return f"case when count(distinct {x}) >= 2 then sqrt(greatest(0, sum({x} * {x} * w) / sum(w) - pow(sum({x} * w) / sum(w), 2))) end"


_LENGTH = {
    "len_mean": "sum(length(v) * w) / sum(w)", "len_sd": _sd("length(v)"), "len_min": "min(length(v))", "len_max": "max(length(v))", "len_range": "max(length(v)) - min(length(v))", "is_fixed_width": "case when max(length(v)) = min(length(v)) then 1 else 0 end",
    "n_distinct_len": "count(distinct length(v))", "has_leading_zeros": SHARE.format("regexp_matches(v, '^0[0-9]')"), "tok_mean": f"sum({_TOK} * w) / sum(w)", "tok_max": f"max({_TOK})", "pct_single_tok": SHARE.format(f"{_TOK} = 1"),
}


@query("profile_length", sql_values(TEXTS) + f' select "column", {sql_measures(_LENGTH)} from u group by 1')
def profile_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.length(values_of(spark, sf_dir, TEXTS)).select("column", *_LENGTH))


def _part(p: str) -> str:
    return f"sum(len(regexp_extract_all(v, '{p}')) * w / length(v)) / sum(w)"


def _count(chars: str) -> str:
    return f"length(regexp_replace(v, '[^{chars[1:]}', '', 'g'))"


_CHARS = {
    "pct_chr_digit": _part("[0-9]"), "pct_chr_alpha": _part("[A-Za-z]"), "pct_chr_space": _part(r"\s"), "pct_chr_punct": _part("[[:punct:]]"), "pct_upper_chr": f"sum(w * {_count('[A-Z]')} / nullif({_count('[A-Za-z]')}, 0)) / sum(case when {_count('[A-Za-z]')} > 0 then w end)",
    "pct_all_upper": SHARE.format("regexp_matches(v, '[A-Za-z]') and v = upper(v)"), "pct_all_lower": SHARE.format("regexp_matches(v, '[A-Za-z]') and v = lower(v)"), "pct_alnum_mixed": SHARE.format("regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')"),
    "pct_all_digits": SHARE.format(r"regexp_matches(v, '^[0-9]+\z')"), "pct_all_alpha": SHARE.format(r"regexp_matches(v, '^[A-Za-z]+\z')"), "pct_starts_digit": SHARE.format("regexp_matches(v, '^[0-9]')"), "pct_ends_digit": SHARE.format(r"regexp_matches(v, '[0-9]\z')"),
}


@query("profile_charclass", sql_values(TEXTS) + f' select "column", {sql_measures(_CHARS)} from u group by 1')
def profile_charclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.charclass(values_of(spark, sf_dir, TEXTS)).select("column", *_CHARS))


def _mark(ch: str) -> str:
    return f"(length(v) - length(replace(v, {q(ch)}, '')))"


_PUNCT = {f"{k}_{n}": e for n, ch in P.MARKS.items() for k, e in (("has", SHARE.format(f"{_mark(ch)} > 0")), ("cnt", f"sum({_mark(ch)} * w) / sum(w)"), ("sd", _sd(_mark(ch))), ("const", f"case when min({_mark(ch)}) = max({_mark(ch)}) and max({_mark(ch)}) > 0 then 1 else 0 end"))}


@query("profile_punct", sql_values(TEXTS) + f' select "column", {sql_measures(_PUNCT)} from u group by 1')
def profile_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.punct(values_of(spark, sf_dir, TEXTS)).select("column", *_PUNCT))


_MASK = {"n_masks": "count(*)", "mask_unique_ratio": "count(*) / sum(k)", "mask_top_share": "max(w) / sum(w)", "mask_entropy": "ln(sum(w)) - sum(w * ln(w)) / sum(w)", "is_single_mask": "case when max(w) / sum(w) > 0.95 then 1 else 0 end"}


@query("profile_mask", sql_values(TEXTS) + ", m as (select \"column\", regexp_replace(regexp_replace(regexp_replace(v, '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g') as m, sum(w) as w, count(*) as k from u group by 1, 2) select \"column\", " + sql_measures(_MASK) + " from m group by 1")
def profile_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.mask(values_of(spark, sf_dir, TEXTS)).select("column", *_MASK))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query("profile_charfreq", sql_values(TEXTS) + ", c as (select \"column\", " + ", ".join(f"sum((length(v) - length(replace(lower(v), '{ch}', ''))) * w) as c_{ch}" for ch in _LETTERS) + " from u group by 1) select \"column\", " + sql_measures({f"ltr_{ch}": f"c_{ch} / nullif({' + '.join(f'c_{x}' for x in _LETTERS)}, 0)" for ch in _LETTERS}) + " from c")
def profile_charfreq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.charfreq(values_of(spark, sf_dir, TEXTS)).select("column", *(f"ltr_{c}" for c in _LETTERS)))


@query("profile_regex_battery", sql_values(TEXTS) + ' select "column", ' + sql_measures({f"rx_{n}": SHARE.format(f"regexp_matches(v, {q(p)})") for n, p in P.PATTERNS.items()}) + " from u group by 1")
def profile_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.regex(values_of(spark, sf_dir, TEXTS)).select("column", *(f"rx_{n}" for n in P.PATTERNS)))


_NUM = {
    "coerce_rate_strip": "1.0", "num_min": "min(x)", "num_max": "max(x)", "num_mean": "sum(x * w) / sum(w)", "pct_integer": SHARE.format("x = floor(x)"), "pct_negative": SHARE.format("x < 0"), "pct_zero": SHARE.format("x = 0"), "pct_positive": SHARE.format("x > 0"),
    "bound_unit": "min(case when x between 0 and 1 then 1 else 0 end)", "bound_pct": "min(case when x between 0 and 100 then 1 else 0 end)", "bound_age": "min(case when x between 0 and 120 then 1 else 0 end)", "bound_year": "min(case when x between 1900 and 2100 and x = floor(x) then 1 else 0 end)", "all_integer": "min(case when x = floor(x) then 1 else 0 end)", "pct_round_10": SHARE.format("x % 10 = 0"), "pct_num_sentinel": SHARE.format("x in (-1,-8,-9,-99,-999,-9999,999,9999,99999,999999)"),
}


@query("profile_numeric", sql_values(NUMBERS) + ", n as (select \"column\", cast(v as double) as x, w from u) select \"column\", " + sql_measures(_NUM, 8) + " from n group by 1")
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Means of cents over 60,000 rows lie on halves of the sixth place, which sums of doubles in another order round either way.
    return rounded(P.numeric(values_of(spark, sf_dir, NUMBERS)).select("column", *_NUM), 8)


_TOKENS = {
    "tok_n_unique": "count(*)", "tok_entropy": "ln(sum(w)) - sum(w * ln(w)) / sum(w)", "tok_hapax_ratio": "sum(case when w = 1 then 1 else 0 end) / count(*)", "tok_ttr": "count(*) / sum(k)", "tok_entropy_norm": "case when count(*) >= 2 then (ln(sum(w)) - sum(w * ln(w)) / sum(w)) / ln(count(*)) end", "stopword_rate": SHARE.format("t in (" + ", ".join(f"'{s}'" for s in STOPWORDS) + ")"),
    "tok_len_mean": "sum(length(t) * w) / sum(w)", "pct_tok_alpha": SHARE.format(r"regexp_matches(t, '^[a-z'']+\z')"), "pct_tok_mixed": SHARE.format("regexp_matches(t, '[a-z]') and regexp_matches(t, '[0-9]')"), "vowel_rate": "sum(w * length(regexp_replace(t, '[^aeiou]', '', 'g'))) / sum(w * length(t))", "pct_tok_numeric": SHARE.format(r"regexp_matches(t, '^[0-9]+\z')"),
}


@query("profile_token", sql_values(TEXTS) + ", e as (select \"column\", unnest(string_split(lower(regexp_replace(v, '[^A-Za-z0-9'' ]', ' ', 'g')), ' ')) as t, w from u), t as (select \"column\", t, sum(w) as w, count(*) as k from e where t <> '' group by 1, 2) select \"column\", " + sql_measures(_TOKENS) + " from t group by 1")
def profile_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.token(values_of(spark, sf_dir, TEXTS)).select("column", *_TOKENS))


_ENDS = {
    **{f"first_{c}": SHARE.format(f"t[1] = '{c}'") for c in _LETTERS}, **{f"last_{c}": SHARE.format(f"t[-1] = '{c}'") for c in _LETTERS}, "suffix2_n_distinct": "count(distinct right(t, 2))",
}


@query("profile_letters", sql_values(TEXTS) + ", e as (select \"column\", unnest(string_split(lower(regexp_replace(v, '[^A-Za-z ]', ' ', 'g')), ' ')) as t, w from u) select \"column\", " + sql_measures(_ENDS) + " from e where t <> '' group by 1")
def profile_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.letters(values_of(spark, sf_dir, TEXTS)).select("column", *_ENDS))


_LAST = {"top_share": "max(w) / sum(w)", "entropy": "ln(sum(w)) - sum(w * ln(w)) / sum(w)", "n_unique": "count(*)"}


@query("profile_token_ends", sql_values(TEXTS) + ", a as (select \"column\", list_filter(string_split(lower(regexp_replace(v, '[^A-Za-z0-9'' ]', ' ', 'g')), ' '), lambda x: x <> '') as a, w from u), " + ", ".join(f"{n} as (select \"column\", a[{i}] as t, sum(w) as w from a where len(a) > 0 group by 1, 2), {n}s as (select \"column\", " + sql_measures({f"{n}_tok_{k}": e for k, e in _LAST.items()}) + f" from {n} group by 1)" for n, i in (("first", 1), ("last", -1))) + " select * from firsts join lasts using (\"column\")")
def profile_token_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.token_ends(values_of(spark, sf_dir, TEXTS)).select("column", *(f"{n}_tok_{k}" for n in ("first", "last") for k in _LAST)))


_SHAPES = {"len_top_share": "max(w) / sum(w)", "len_entropy": "ln(sum(k)) - sum(k * ln(k)) / sum(k)"}


@query("profile_shapes", sql_values(TEXTS) + ", l as (select \"column\", length(v) as x, sum(w) as w, count(*) as k from u group by 1, 2) select \"column\", " + sql_measures(_SHAPES) + " from l group by 1")
def profile_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.shapes(values_of(spark, sf_dir, TEXTS)).select("column", *_SHAPES))


_MOMENTS = {"skewness": "sum(w * pow((x - m) / s, 3)) / sum(w)", "kurtosis": "sum(w * pow((x - m) / s, 4)) / sum(w) - 3", "zero_inflation": SHARE.format("x = 0")}


@query("profile_moments", sql_values(NUMBERS) + ", n as (select \"column\", cast(v as double) as x, w from u), m as (select \"column\", sum(x * w) / sum(w) as m from n group by 1), d as (select \"column\", m, sqrt(sum(w * (x - m) * (x - m)) / sum(w)) as s from n join m using (\"column\") group by 1, 2) select \"column\", " + sql_measures(_MOMENTS) + " from n join d using (\"column\") group by 1")
def profile_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.moments(values_of(spark, sf_dir, NUMBERS)).select("column", *_MOMENTS))


for _name, (_f, _sql) in MORE.items():
    query(_name, _sql)(_f)


# ---- signatures, transforms, screens --------------------------------------------------------------------------------------


@query("stabilize_dec", "select l_orderkey, l_linenumber, printf('%.2f', round(l_quantity, 2)) as stable from lineitem")
def stabilize_dec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", transform(F.col("l_quantity").cast("string"), "dec:2").alias("stable"))


@query("stabilize_usd", "select p_partkey, cast(p_partkey as varchar) || '.5' as stable from part")
def stabilize_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", transform(F.concat(F.lit("$"), F.format_number(F.col("p_partkey"), 0), F.lit(".50")), "as_usd").alias("stable"))


@query("stabilize_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as long_form, strftime(o_orderdate, '%Y-%m-%d') as abbreviated, strftime(o_orderdate, '%Y-%m') as month from orders")
def stabilize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", transform(F.date_format(d, "MMMM d, yyyy"), "as_mmddyyyy").alias("long_form"), transform(F.date_format(d, "d-MMM-yyyy"), "as_mmddyyyy").alias("abbreviated"), transform(F.date_format(d, "yyyy/MM/dd"), "{{ [as_yyyymm] }}").alias("month"))


_STATE_NAMES = sorted(STATES)


@query("stabilize_lookup", "select n_nationkey, (['" + "','".join(STATES[s].split()[0] for s in _STATE_NAMES) + "'])[n_nationkey + 1] as stable from nation")
def stabilize_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, _STATE_NAMES)), F.col("n_nationkey"))
    return read(spark, sf_dir, "nation").select("n_nationkey", transform(F.concat(F.lit(" "), F.upper(name)), "lookup:usps").alias("stable"))


@query("stabilize_zeropad", "select p_partkey, lpad(cast(p_partkey as varchar), 5, '0') as stable from part")
def stabilize_zeropad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.when(F.length(F.col("p_partkey").cast("string")) <= 5, transform(F.col("p_partkey").cast("string"), "zeropad5")).otherwise(F.substring(F.col("p_partkey").cast("string"), 1, 5)).alias("stable"))


_KEYS = {"customer": ["c_name", "c_mktsegment", "c_custkey"], "part": ["p_name", "p_brand"], "events": ["props", "event_type"]}


@query("excel_hazards", sql_values(_KEYS) + ", f as (select \"column\", " + ", ".join(f"coalesce(bool_or(regexp_matches({'upper(v)' if up else 'v'}, {q(p)})), false) as h{i}" for i, (p, up) in enumerate(screens.HAZARDS.values())) + " from vals group by 1) select \"column\", array_to_string(list_filter([" + ", ".join(f"case when h{i} then '{h}' end" for i, h in enumerate(screens.HAZARDS)) + "], lambda x: x is not null), ',') as hazards from f")
def excel_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.hazards(values_of(spark, sf_dir, _KEYS))


# ---- ontology, evaluation, test data --------------------------------------------------------------------------------------


for _name, (_f, _sql) in {**COLUMNS, **LIFECYCLE}.items():
    query(_name, _sql)(_f)


@query("window_rates", "select time_bucket(interval '10 minutes', ts) as start, count(props) as n, round(avg(case when regexp_matches(trim(props), '^\\{.*\\}\\z') then 1.0 else 0.0 end), 6) as pass_rate from events group by 1")
def window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detector_rates(read(spark, sf_dir, "events"), REGISTRY["json"], "props", "ts")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("pass_rate", 6).alias("pass_rate"))


