"""What columns of the tables hold, how they look and what files do to them, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import SENTINELS
from ..operators import profile as P
from ..operators import catalogue, screens, similarity, testgen
from ..operators.detectors import REGISTRY
from ..operators.scoring import NAME_RULES, guess_columns, score_values
from ..sources.values import values_frame
from .probes import RULES

TABLES = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]}
TEXTS = {"customer": ["c_name", "c_mktsegment"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "pages": ["url"]}
KEYS = {"customer": ["c_name", "c_mktsegment", "c_custkey", "c_acctbal"], "part": ["p_name", "p_brand", "p_retailprice"], "events": ["props", "event_type"], "nation": ["n_nationkey"]}
_TRIM = "trim(v, ' ' || chr(9) || chr(10) || chr(13))"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(spark: SparkSession, sf_dir: str, tables: dict[str, list[str]]) -> DataFrame:
    out = None
    for t, cols in tables.items():
        v = values_frame(spark.read.parquet(f"{sf_dir}/{t}.parquet"), cols)
        out = v if out is None else out.unionByName(v)
    return out


def sql_values(tables: dict[str, list[str]]) -> str:
    each = " union all ".join(f"select '{c}' as \"column\", '{t}' as \"table\", cast({c} as varchar) as v, count(*) as w from {t} group by 3" for t, cols in tables.items() for c in cols)
    return f"vals as materialized ({each}), u as materialized (select * from vals where v is not null and lower({_TRIM}) not in ({', '.join(map(_q, SENTINELS))})), k as materialized (select * from vals where v is not null and {_TRIM} <> '')"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c).cast("double"), places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


# The two that probes leave out, as far as the values of these tables go: timestamps are dates, and no value is a country's code.
_RULES = RULES | {
    "date": r"regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2})?') and try_cast(v[1:10] as date) is not null and try_cast(v[1:4] as int) between 1900 and 2100",
    "country_code": "false",
}


def _scores(names) -> str:
    return " union all ".join(f"select \"column\", '{n}' as data_type, count(*) as n, avg(coalesce({_RULES[n]}, false)::int) as rate from k group by 1" for n in names)


SCORES_SQL = f"with {sql_values(TEXTS)} select \"column\", data_type, n, round(rate, 9) as pass_rate from ({_scores(RULES)})"


def score_all_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score_values(values(spark, sf_dir, TEXTS), {n: REGISTRY[n] for n in RULES}).select("column", "data_type", "n", "pass_rate"), 9)


def _guess_sql() -> str:
    facts = ", ".join(f"('{n}', {d.index}, {str(d.loose).lower()}, '{'/'.join(d.coordinates)}')" for n, d in REGISTRY.items())
    rules = ", ".join(f"({i}, '{n}', '{path}', {conf}, {_q(p)})" for i, (n, path, conf, p) in enumerate(NAME_RULES))
    header = "trim(regexp_replace(lower(regexp_replace(\"column\", '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'))"
    return f"""with {sql_values(TABLES)}, f(data_type, i, loose, path) as (values {facts}), s as ({_scores(REGISTRY)}),
        o as (select s.*, f.path, len(list_filter(string_split(data_type, '_'), lambda w: length(w) >= 3 and contains(lower("column"), w))) > 0 as hint, loose, i from s join f using (data_type)),
        b as (select * from o qualify row_number() over (partition by "column" order by round_even(rate, 3) desc, hint desc, loose, rate desc, i) = 1),
        r(i, name, path, conf, pattern) as (values {rules}), c as (select distinct "column", "table" from vals), h as (select *, {header} as header from c),
        m as (select "column", name, path, conf from h join r on regexp_matches(header, pattern) and conf >= 0.5 qualify row_number() over (partition by "column" order by conf desc, r.i) = 1)
        select c."column", c."table", coalesce(b.n, 0) as n_values, case when b.rate >= 0.8 then b.data_type else m.name end as guess, case when b.rate >= 0.8 then b.path else m.path end as path,
            case when b.rate >= 0.8 then 'value' when m.name is not null then 'name' else 'none' end as source, round(case when b.rate >= 0.8 then b.rate else m.conf::double end, 6) as confidence
        from c left join b using ("column") left join m using ("column")"""


def guess_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.create_map(*(F.lit(x) for t, cols in TABLES.items() for c in cols for x in (c, t)))
    return guess_columns(values(spark, sf_dir, TABLES)).withColumn("table", owner[F.col("column")])


def _header_sql() -> str:
    flags = ", ".join(f"regexp_matches(lower(c), {_q(p)})::int::double as nm_{k}" for k, p in P.HEADER_WORDS.items())
    cols = ", ".join(f"('{c}')" for cols in TABLES.values() for c in cols)
    return f"select c as \"column\", {flags}, length(c) as nm_nchar, contains(c, '_')::int::double as nm_has_under, (c = upper(c))::int::double as nm_is_upper, len(regexp_split_to_array(c, '[_ .]+'))::int as nm_n_tokens from (values {cols}) t(c)"


# Shares of the signature, over distinct values and their counts.
_AXES = {
    "composition": "sum(w * length(regexp_replace(v, '[^0-9]', '', 'g')) / length(v)) / sum(w)",
    "numbers": r"sum(w * regexp_full_match(regexp_replace(regexp_replace(v, '[$,%\s]', '', 'g'), '^\((.*)\)$', '-\1'), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')::int) / sum(w)",
    "width": "log10(1 + sum(w * length(v)) / sum(w)) / 2",
    "punctuation": "sum(w * length(regexp_replace(v, '[^[:punct:]]', '', 'g')) / length(v)) / sum(w)",
    "tokenization": rf"sum(case when len(regexp_split_to_array({_TRIM}, '\s+')) = 1 then w else 0 end) / sum(w)",
    "cardinality": "count(*) / sum(w)",
}
_SIGNATURES = f"""{sql_values(TEXTS)}, a as (select "column", {', '.join(f'{e} as {n}' for n, e in _AXES.items())} from u group by 1),
    g as (select "column", max(w) / sum(w) as rigidity from (select "column", translate(regexp_replace(regexp_replace(regexp_replace(v, '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '', '') as m, sum(w) as w from u group by 1, 2) group by 1),
    z as (select "column", {', '.join(f'greatest(0, least(1, {e}))::double as {n}' for n, e in {**{n: n for n in similarity.AXES}, 'numeric_gap': '(numbers - composition + 1) / 2'}.items())} from a join g using ("column"))"""
SIGNATURES_SQL = f"with {_SIGNATURES} select \"column\", {', '.join(f'round({n}, 6) as {n}' for n in similarity.AXES)} from z"
SIBLINGS_SQL = f"""with {_SIGNATURES}, p as (select *, ends_with("column", 'name') as named from z),
    d as (select a."column" as "left", b."column" as "right", round(({' + '.join(f'abs(a.{n} - b.{n})' for n in similarity.AXES)}) / {len(similarity.AXES)}, 3) as sig_dist, case when a.named = b.named then 0.0 else 1.0 end::double as path_dist from p a join p b on a."column" < b."column")
    select *, case when path_dist <= 0.34 and sig_dist <= 0.1 then 'both' when sig_dist <= 0.1 then 'hidden_risk' when path_dist <= 0.34 then 'safe_split' else 'unrelated' end as verdict from d"""


def sibling_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = similarity.signatures(values(spark, sf_dir, TEXTS))
    return similarity.sibling_report(signed.withColumn("path", F.when(F.col("column").endswith("name"), "text/line/name").otherwise("categorical/nominal/label")))


_HAZARDS = "array_to_string(list_filter([" + ", ".join(f"case when bool_or(regexp_matches({'upper(v)' if up else 'v'}, {_q(p)})) then '{h}' end" for h, (p, up) in screens.HAZARDS.items()) + "], lambda x: x is not null), ',')"
ROUNDTRIP_SQL = rf"""with {sql_values(KEYS)},
    m as (select "column", bool_and(regexp_full_match(v, '[+-]?[0-9]+')) as i, bool_and(regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')) as d, bool_and(lower(v) in ('true', 'false', 't', 'f')) as l,
        bool_or(regexp_full_match(v, '[+-]?0[0-9]+') or v[1] = '+' or regexp_full_match(v, '[0-9]{{16,}}')) as zero, bool_or(regexp_matches(v, '\.[0-9]*0$') or regexp_matches(v, '[eE]') or ends_with(v, '.')) as tail, {_HAZARDS} as hazards from u group by 1)
    select "column", case when i then 'integer' when d then 'double' when l then 'logical' else 'character' end as inferred, case when i then zero when d then zero or tail when l then true else false end as value_changed, hazards from m"""
# What the columns are said to hold, to be held against their values.
EXPECTED = {"c_name": "number", "c_custkey": "text", "c_acctbal": "number", "p_brand": "text", "props": "number"}
TRIAGE_SQL = rf"""with {sql_values(KEYS)}, b as (select "column", sum(w) as n, sum(case when v is not null and lower({_TRIM}) in ({', '.join(map(_q, SENTINELS))}) then w else 0 end) / sum(w) as sentinel from vals group by 1),
    m as (select "column", sum(w) as usable, count(*) as k, sum(w * length(regexp_replace(v, '[^0-9]', '', 'g')) / length(v)) / sum(w) as dg, sum(w * length(regexp_replace(v, '[^A-Za-z]', '', 'g')) / length(v)) / sum(w) as al, {_AXES['punctuation']} as pu, sum(w * (strlen(v) - length(regexp_replace(v, '[^\x00-\x7F]', '', 'g'))) / length(v)) / sum(w) as na, {_AXES['numbers']} as num,
        sum(case when regexp_matches(v, '^\s') or regexp_matches(v, '\s$') then w else 0 end) as ws, sum(case when regexp_matches(v, '[A-Za-z]') and v = upper(v) then w else 0 end) / sum(w) as up, sum(case when regexp_full_match(v, '[A-Z][a-z]+( [A-Z][a-z'']+)*') then w else 0 end) / sum(w) as ti from u group by 1),
    g as (select "column", max(w) / sum(w) as top from (select "column", regexp_replace(regexp_replace(regexp_replace(v, '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g') as x, sum(w) as w from u group by 1, 2) group by 1),
    x(c, expected) as (values {', '.join(f"('{c}', '{t}')" for c, t in EXPECTED.items())}),
    r as (select "column", case when coalesce(usable, 0) < 8 then 'n_usable < 8' when coalesce(k, 0) <= 1 then 'constant column' when sentinel > 0.9 then 'all-sentinel' end as e,
        list_filter([case when na > 0.15 then printf('non-ascii %.0f%% (mojibake)', 100 * na) end, case when pu > 0.5 and al < 0.2 and dg < 0.2 then 'punctuation-dominant' end, case when top > 0.9 and al + dg < 0.15 then 'single-punctuation mask' end], lambda x: x is not null) as j,
        list_filter([case when top < 0.9 then 'mixed_subformats' end, case when sentinel > 0 then 'sentinel_missing' end, case when ws > 0 then 'whitespace_damage' end, case when up > 0.05 and ti > 0.05 then 'mixed_case' end, case when na > 0.01 then 'encoding_damage' end], lambda x: x is not null) as mk, top, num > 0.7 as isnum, expected = 'number' as wants
        from b left join m using ("column") left join g using ("column") left join x on x.c = b."column"),
    z as (select *, e is null and len(j) = 0 as keep, case when top < 0.5 then 'hard' when len(mk) > 0 then 'medium' else 'easy' end as rating, coalesce(wants <> isnum, false) as unlike from r)
    select "column", case when e is not null then 'empty' when len(j) > 0 then 'garbage' when unlike then 'mismatch' when rating = 'hard' then 'hard' else 'clean' end as verdict, keep,
        case when e is not null then e when len(j) > 0 then array_to_string(j, ',') when unlike then 'values look ' || case when isnum then 'numeric' else 'non-numeric' end || ' but label implies ' || case when wants then 'numeric' else 'non-numeric' end else 'genuine example' end as reasons, case when keep then rating end as difficulty, case when keep then array_to_string(mk, ',') else '' end as noise_markers from z"""


def triage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.create_map(*(F.lit(x) for kv in EXPECTED.items() for x in kv))[F.col("column")]
    return screens.triage(values(spark, sf_dir, KEYS), expected)


# Storage that columns are meant for.
STORES = {"c_name": "character", "c_mktsegment": "factor", "c_custkey": "integer", "c_acctbal": "double", "p_brand": "string", "p_retailprice": "integer", "props": "character", "n_nationkey": "character"}
_READ = lambda x: rf"case when bool_and({x} in ('T', 'F', 'TRUE', 'FALSE', 'true', 'false')) then 'logical' when bool_and(regexp_full_match({x}, '[+-]?[0-9]{{1,9}}')) then 'integer' when bool_and(regexp_full_match({x}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')) then 'numeric' else 'character' end"
CHECK_SQL = rf"""with {sql_values(KEYS)}, s(id, intended, want) as (values {', '.join(f"('{c}', '{t}', '{screens.STORAGE.get(t)}')" for c, t in STORES.items())}),
    m as (select "column" as id, {_READ("trim(v)")} as a, {_READ("v")} as g, bool_or(regexp_matches(trim(v), '^[+-]?0[0-9]+$|^\+|^[0-9]{{16,}}$|\.[0-9]*0$|[eE]|\.$|^-?\.')) as odd from u group by 1), h as (select "column" as id, {_HAZARDS} as hz from vals group by 1),
    j as (select s.*, a, g, a in ('integer', 'numeric') and odd as ch, want <> a as tw, a <> g as rd, intended in ('factor', 'ordered', 'date', 'datetime') as al, hz from s join m using (id) join h using (id))
    select id, intended, a as inferred_base, g as inferred_guess, ch as value_changed, tw as type_wrong, rd as reader_disagree, replace(hz, ',', ';;') as excel_hazards, ch or tw or rd or al or hz <> '' as needs_import_rule,
        array_to_string(list_filter([case when ch then 'VALUE_CHANGED' end, case when tw then 'TYPE_WRONG' end, case when rd then 'READER_DISAGREE' end, case when al then 'NOT_INFERABLE_FROM_VALUES' end, case when hz <> '' then 'EXCEL_HAZARD' end], lambda x: x is not null), ';;') as reason from j"""


def roundtrip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.createDataFrame(list(STORES.items()), "column string, storage string")
    return screens.roundtrip_check(values(spark, sf_dir, KEYS), stored)


def route_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of each column by shortlist and recipes; SQL has no transforms, tests hold known columns against it."""
    return rounded(catalogue.route(values(spark, sf_dir, TABLES)))


def _mutants_sql(n: int = 20, seed: int = 514) -> str:
    tiers = []
    for tier in ("S1", "S2", "S3"):
        pool = {"S1": "(select list(c order by c) from a where regexp_matches(c, '[A-Za-z0-9]'))", "S2": "(select list(c order by c) from a)", "S3": f"(select string_split({_q(testgen.GENERIC)}, ''))"}[tier]
        swap = "h % 1000 < 500" + (" and regexp_matches(c, '[A-Za-z0-9]')" if tier == "S1" else "")
        tiers.append(f"select distinct m as v, '{tier}' as label from (select v, k, string_agg(case when {swap} then ({pool})[(h // 1000) % len({pool}) + 1] else c end, '' order by i) as m from e group by v, k) where m not in (select v from p)")
    return f"""with p as (select distinct p_brand as v from part), a as (select distinct unnest(string_split(v, '')) as c from p),
        e as (select v, k, i, v[i + 1] as c, ('0x' || substr(md5(v || '|' || k || '|' || i || '|{seed}'), 1, 10))::bigint as h from (select v, k, unnest(range(length(v))) as i from (select v, unnest(range(1, {n + 1})) as k from p)))
        {' union all '.join(tiers)}"""


def mutation_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("v")).distinct()
    out = testgen.negatives(brands, "S1")
    for tier in ("S2", "S3"):
        out = out.unionByName(testgen.negatives(brands, tier))
    return out


COLUMNS = {
    "guess_tables": (guess_tables, _guess_sql()),
    "score_all_detectors": (score_all_detectors, SCORES_SQL),
    "profile_header": (lambda spark, sf_dir: P.header(values(spark, sf_dir, TABLES)), _header_sql()),
    "signature_columns": (lambda spark, sf_dir: rounded(similarity.signatures(values(spark, sf_dir, TEXTS))), SIGNATURES_SQL),
    "sibling_report": (sibling_report, SIBLINGS_SQL),
    "roundtrip_screen": (lambda spark, sf_dir: screens.roundtrip(values(spark, sf_dir, KEYS)), ROUNDTRIP_SQL),
    "roundtrip_check": (roundtrip_check, CHECK_SQL),
    "triage_columns": (triage_columns, TRIAGE_SQL),
    "route_tables": (route_tables, None),
    "mutation_negatives": (mutation_negatives, _mutants_sql()),
}
