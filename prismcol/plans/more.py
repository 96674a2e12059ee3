"""Queries of the further profile blocks and of the order of rows, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile_more as M
from .columns import KEYS, TEXTS, rounded, sql_values, values

NUMBERS = {"lineitem": ["l_quantity", "l_tax", "l_extendedprice"], "customer": ["c_acctbal", "c_custkey"], "part": ["p_retailprice", "p_size"]}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(xs) -> str:
    return "(" + ", ".join(map(_q, sorted(set(xs)))) + ")"


_TOKENS = "t as (select \"column\", t, sum(w) as w from (select \"column\", w, unnest(string_split(lower(regexp_replace(v, '[^A-Za-z0-9'' ]', ' ', 'g')), ' ')) as t from u) where t <> '' group by 1, 2)"
_LETTER = lambda c: f"sum(w * (length(lower(v)) - length(replace(lower(v), '{c}', ''))))"
_KL = " + ".join(f"case when {_LETTER(c)} > 0 then {_LETTER(c)} / ltrs * ln({_LETTER(c)} / ltrs / {e}) else 0 end" for c, e in zip(M.LETTERS, M.ENGLISH, strict=True))
_CHI = " + ".join(f"({_LETTER(str(d))} / digs - 0.1) ** 2 / 0.1" for d in range(10))
DIVERGENCES_SQL = f"""with {sql_values(KEYS)}, {_TOKENS}, b as (select "column", nullif(sum(w * length(regexp_replace(v, '[^A-Za-z]', '', 'g'))), 0) as ltrs, nullif(sum(w * length(regexp_replace(v, '[^0-9]', '', 'g'))), 0) as digs from u group by 1),
    a as (select "column", case when max(ltrs) > 0 then {_KL} end as kl, case when max(digs) > 0 then {_CHI} end as chi, sum(case when regexp_full_match(v, '[0-9]{{2}}-?[0-9]{{7}}') and v[1:2] in {_in(M.EIN_PREFIXES)} then w else 0 end) / nullif(sum(case when regexp_full_match(v, '[0-9]{{2}}-?[0-9]{{7}}') then w else 0 end), 0) as ein from u join b using ("column") group by "column", ltrs, digs),
    c as (select "column", count(distinct x) as n, count(distinct case when regexp_full_match(x, '[A-Za-z]') then lower(x) end) / 26 as closure from (select "column", unnest(string_split(v, '')) as x from u) group by 1),
    z as (select "column", case when count(*) >= 10 and max(w) > 1 then regr_slope(ln(w), ln(r)) end as slope from (select *, row_number() over (partition by "column" order by w desc) as r from t) group by 1)
    select "column", round(kl, 6) as ltr_kl_english, round(chi, 6) as dig_uniform_chi2, n as n_distinct_chars, round(closure, 6) as alphabet_closure, round(ein, 6) as chk_ein_prefix_rate, round(slope, 6) as tok_zipf_slope from a left join c using ("column") left join z using ("column")"""


def _lexicon_sql() -> str:
    lists = M.lexicons()
    low = "lower(trim(v, ' ' || chr(9) || chr(10) || chr(13)))"
    whole = ", ".join(f"round(sum(case when {low} in {_in(xs)} then w else 0 end) / sum(w), 6) as lex_{k}_value" for k, xs in lists.items())
    part = ", ".join(f"round(sum(case when t in {_in(xs)} then w else 0 end) / max(total), 6) as lex_{k}_token" for k, xs in lists.items())
    everything = _in(x for xs in lists.values() for x in xs)
    return f"""with {sql_values(TEXTS)}, {_TOKENS}, k2 as (select *, sum(w) over (partition by "column") as total, row_number() over (partition by "column" order by w desc, t) as place from t),
        a as (select "column", {whole}, round(sum(case when {low} in {everything} then w else 0 end) / sum(w), 6) as lex_any_value from u group by 1), b as (select "column", {part}, round(sum(w) / max(total), 6) as lex_top_k_covered from k2 where place <= {M.TOP_TOKENS} group by 1)
        select * from a left join b using ("column")"""


GCD = "list_reduce(list(cast(abs(x) as bigint)) filter (x <> 0), lambda a, b: gcd(a, b))"
DISTRIBUTION_SQL = f"""with {sql_values(NUMBERS)}, x as (select "column", cast(v as double) as x, w from u), p as (select *, row_number() over (partition by "column" order by x) as i, row_number() over (partition by "column" order by x desc) as down, count(*) over (partition by "column") as n, count(*) filter (x > 0) over (partition by "column") as np from x),
    b as (select "column", max(n) as n, max(np) as np, case when min(x) >= 0 and sum(x) > 0 then sum((2 * i - n - 1) * x) / (max(n) * sum(x)) end as gini, case when max(np) >= 50 then 1 / (avg(ln(x)) filter (x > 0 and down <= greatest(10, floor(0.1 * np))) - min(ln(x)) filter (x > 0 and down <= greatest(10, floor(0.1 * np)))) end as hill, case when bool_and(x = floor(x)) and max(n) <= 5000 then {GCD} end as step from (select *, case when x > 0 then x end as pos from p) group by 1)
    select "column", round(gini, 8) as gini_coef, round(hill, 6) as hill_alpha, step::bigint as granularity from b"""


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.distribution(values(spark, sf_dir, NUMBERS))
    return out.select("column", F.round("gini_coef", 8).alias("gini_coef"), F.round("hill_alpha", 6).alias("hill_alpha"), "granularity")


def _ordered_sql() -> str:
    parts = []
    for t, c, o in (("events", "event_type", "event_id"), ("events", "value", "event_id"), ("orders", "o_orderkey", "o_orderkey"), ("lineitem", "l_linenumber", "l_orderkey * 10 + l_linenumber")):
        parts.append(
            f"""select * from (with s as (select cast({c} as varchar) as v, row_number() over (order by {o}) as i from {t} where {c} is not null), g as (select *, lag(v) over (order by i) as p, try_cast(v as double) as x from s),
            ru as (select count(*) as n from (select sum(case when p is null or p <> v then 1 else 0 end) over (order by i) as r from g) group by r), rk as (select v, (sum(count(*)) over (order by v)) - count(*) + (count(*) + 1) / 2 as rank from s group by v),
            d as (select x, lag(x) over (order by i) as y from g where x is not null), e as (select *, x - y as d from d)
            select '{c}' as "column", (select round(corr(rank, i), 6) from s join rk using (v)) as spearman_index, round(sum(n) / count(*), 6) as mean_run_length, max(n) as max_run_length, round(count(*) / sum(n), 6) as run_ratio,
                (select case when count(*) > 5 then min(case when d >= 0 then 1 when d is not null then 0 end) end from e) as is_monotone_incr, (select case when count(*) > 5 then min(case when d <= 0 then 1 when d is not null then 0 end) end from e) as is_monotone_decr,
                (select case when count(*) > 5 then min(case when d = 1 then 1 when d is not null then 0 end) end from e) as is_autoincrement, (select case when count(*) > 5 then (bool_and(x = floor(x)) and max(x) - min(x) + 1 = count(distinct x))::int end from e) as is_dense_index,
                (select case when count(*) > 5 then (count(distinct d) = 1)::int end from e) as diff_constant, (select case when count(*) > 5 then round(corr(x, y), 6) end from e) as lag1_autocorr, (select case when count(*) > 5 then round(avg(case when d = 0 then 1.0 when d is not null then 0.0 end), 6) end from e) as pct_diff_zero from ru)"""
        )
    return " union all ".join(parts)


def profile_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, c, o in (("events", "event_type", "event_id"), ("events", "value", "event_id"), ("orders", "o_orderkey", "o_orderkey"), ("lineitem", "l_linenumber", "l_orderkey * 10 + l_linenumber")):
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet").selectExpr(c, f"{o} as o_")
        one = M.ordered(df, c, "o_")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


MORE = {
    "profile_divergences": (lambda spark, sf_dir: rounded(M.divergences(values(spark, sf_dir, KEYS))), DIVERGENCES_SQL),
    "profile_lexicon": (lambda spark, sf_dir: rounded(M.lexicon(values(spark, sf_dir, TEXTS))), _lexicon_sql()),
    "profile_distribution": (distribution, DISTRIBUTION_SQL),
    "profile_sequence": (profile_sequence, _ordered_sql()),
}
