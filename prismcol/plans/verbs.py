"""Verbs of the transform language over the probes of all types, and the same in SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators.stabilize import TRUTH, transform
from . import probes as P

_T = "trim(v, ' ' || chr(9) || chr(10) || chr(13))"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_NUMBER = "regexp_replace(v, '[^0-9.eE+-]', '', 'g')"
_DOI = f"regexp_replace(lower({_T}), '^doi[: ]*', '')"
_BOOK = rf"replace(replace(regexp_replace(regexp_replace({_T}, '\[[0-9]+\]\s*$', ''), '^[A-Za-z]{{2,}}[ :._-]*', ''), '-', ''), ' ', '')"


def _of(rule: str, x: str) -> str:
    """A detector's rule over another value than ``v``."""
    return "coalesce(" + re.sub(r"\bv\b", lambda _: f"({x})", P.RULES[rule]) + ", false)"


_INTEGER = rf"case when regexp_full_match({_NUMBER}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and abs(try_cast({_NUMBER} as double)) < 1e15 and try_cast({_NUMBER} as double) = round(try_cast({_NUMBER} as double)) then cast(cast(try_cast({_NUMBER} as double) as hugeint) as varchar) end"
_STATES = ", ".join(f"('{k}', '{c}')" for s, v in V.STATES.items() for c in [v.split()[0]] for k in (s.lower(), c.lower()))
#: Each expression, and the stable form of ``v`` in SQL.
VERBS = {
    "as_integer": _INTEGER,
    "as_rank": _INTEGER,
    "as_range": rf"case when regexp_matches(v, '[0-9].*(-|to|,).*[0-9]') then {_T} end",
    "as_yyyy": f"case when regexp_full_match({_T}, '(1[89][0-9]{{2}}|20[0-9]{{2}})') then {_T} end",
    "as_quarter": r"case when regexp_full_match(upper(regexp_replace(v, '\s', '', 'g')), '(Q[1-4]-?[0-9]{4}|[0-9]{4}-?Q[1-4])') then upper(regexp_replace(v, '\s', '', 'g')) end",
    "as_clock": rf"case when regexp_full_match({_T}, '\d{{1,2}}:\d{{2}}(:\d{{2}})?\s*([AaPp][.]?[Mm][.]?)?') then {_T} end",
    "as_email": f"case when {_of('email', f'lower({_T})')} then lower({_T}) end",
    "as_url": f"case when {_of('url', 'v')} or {_of('url', chr(39) + 'http://' + chr(39) + ' || v')} then {_T} end",
    "as_ein": f"case when length({_DIGITS}) = 9 then ({_DIGITS})[1:2] || '-' || ({_DIGITS})[3:9] end",
    "as_phone": f"case when length({_DIGITS}) in (10, 11) then {_DIGITS} end",
    "as_hex": f"case when {_of('hex_color', 'v')} then upper({_T}) end",
    "as_handle": rf"case when regexp_full_match({_T}, '@?[A-Za-z0-9_.]{{2,}}') then regexp_replace({_T}, '^@', '') end",
    "as_isbn": f"case when {_BOOK} <> '' and {_of('isbn', _BOOK)} then {_BOOK} end",
    "as_doi": f"case when {_of('doi', _DOI)} then {_DOI} end",
    "as_orcid": f"case when {_of('orcid', _T)} then {_T} end",
    "as_issn": f"case when {_of('issn', _T)} then {_T} end",
    "strip:-,": "translate(v, '-,', '')",
    "zeropad5": f"case when length({_DIGITS}) between 1 and 5 then lpad({_DIGITS}, 5, '0') end",
    "lookup:usps": f"(select min(c) from (values {_STATES}) s(k, c) where s.k = lower({_T}))",
    "as_boolean": f"case when lower({_T}) in ({', '.join(repr(k) for k, x in TRUTH.items() if x == 'TRUE')}) then 'TRUE' when lower({_T}) in ({', '.join(repr(k) for k, x in TRUTH.items() if x == 'FALSE')}) then 'FALSE' end",
    "as_factor": f"nullif({_T}, '')",
    "as_id": f"nullif({_T}, '')",
    "validate": "v",
    "{{ [strip:$][as_integer] }}": _INTEGER.replace(_NUMBER, _NUMBER.replace("(v,", "(replace(v, '$', ''),")),
    "nonsense": "null",
}


def stabilize_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``verb, n, stable, digest``: how many probes each expression brings into a stable form, and a sum of the forms' digests. Of whole numbers those below 10^15 count."""
    tried = P.probes(spark, sf_dir)
    whole = lambda e: "as_integer" in e or e == "as_rank"
    form = lambda e: (lambda x: F.when(x.rlike(r"^-?[0-9]{1,15}\z"), x) if whole(e) else x)(transform(F.col("v"), e))
    # A few at once: the code of all would be too large to be compiled.
    parts = [list(VERBS)[i : i + 5] for i in range(0, len(VERBS), 5)]
    frames = [tried.select(F.inline(F.array(*(F.struct(F.lit(e).alias("verb"), form(e).alias("s")) for e in part)))) for part in parts]
    rows = reduce(DataFrame.unionByName, frames)
    h = F.conv(F.substring(F.md5("s"), 1, 8), 16, 10).cast("long")
    return rows.groupBy("verb").agg(F.count("*").alias("n"), F.count("s").alias("stable"), F.coalesce(F.sum(h), F.lit(0).cast("long")).alias("digest"))


def stabilize_probes_sql() -> str:
    each = " union all ".join(f"select {P._q(e)} as verb, count(*) as n, count(s) as stable, coalesce(sum(('0x' || substr(md5(s), 1, 8))::bigint), 0)::bigint as digest from (select ({sql})::varchar as s from w)" for e, sql in VERBS.items())
    return P.probes_sql() + each
