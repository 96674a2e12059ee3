"""Queries over two versions of an ontology, a bank of cases and predictions that are made from the tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bank, evaluation, ontology

# Expressions that both engines read: the variants of the old and the new version, from parts; k is the type's number.
_OLD = {
    "semantic_type_id": "concat('t', k)", "variant_id": "concat('v', p_partkey)", "data_type": "concat('d', k % 4)", "semantic_family": "concat('f', k % 11)", "semantic_type": "concat('s', k)",
    "version_deprecated": "case when k % 29 = 0 then 'v1' else '' end", "superseded_by": "''", "short_desc": "p_name", "format_label": "p_brand", "match_kind": "case when k % 23 = 0 then 'guess' else 'mask' end",
}
_NEW = _OLD | {
    "data_type": "concat('d', case when k % 13 = 1 and k % 2 = 0 then (k + 1) % 4 else k % 4 end)", "semantic_family": "concat('f', case when k % 13 = 1 then k % 7 else k % 11 end)", "semantic_type": "concat('s', k, case when k % 13 = 2 then 'x' else '' end)",
    "version_deprecated": "case when k % 29 = 0 then 'v1' when k % 13 = 4 then 'v2' else '' end",
    "superseded_by": "case when k % 13 <> 4 then '' when k % 3 = 0 then concat('t', k + 1, ' ;; t', k + 2, ';;t', k + 13) when k % 3 = 1 then concat('t', k + 1) else '' end",
    "variant_id": "concat(case when k % 13 in (7, 9) and p_partkey % 3 = 0 then 'w' else 'v' end, p_partkey)", "short_desc": "concat(p_name, case when k % 13 = 8 then '!' else '' end)",
}
_OLD_ROWS, _NEW_ROWS = "k % 19 <> 5", "k % 17 <> 3 and not (k % 13 in (6, 9) and p_partkey % 5 = 0)"
_PART = "select *, p_partkey % 300 as k from part"
_CASES = {
    "case_id": "concat('c', o_orderkey)", "semantic_type_id": "case when o_orderkey % 50 = 0 then null else concat('t', o_custkey % 300) end", "semantic_type": "concat('s', o_custkey % 300)", "depth_labeled": "cast(case when o_orderkey % 9 = 0 then null else o_orderkey % 4 + 1 end as int)",
    "ontology_version": "case when o_orderkey % 8 = 0 then 'v2' else 'v1' end", "method": "case when o_orderkey % 3 = 0 then 'human' when o_orderkey % 3 = 1 then 'llm' end", "difficulty": "case o_custkey % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end",
    "needs_relabel": "o_orderkey % 40 = 1", "relabel_trigger": "o_orderpriority",
}


def _columns(made: dict[str, str]) -> str:
    return ", ".join(f"{e} as {c}" for c, e in made.items())


def version(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("k", F.expr("p_partkey % 300"))
    return parts.where(_NEW_ROWS if new else _OLD_ROWS).selectExpr(*(f"{e} as {c}" for c, e in (_NEW if new else _OLD).items()))


def case_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*(f"{e} as {c}" for c, e in _CASES.items()))


def bank_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases as the bank has them: labels in a struct."""
    i = case_index(spark, sf_dir)
    fields = [x.strip().split(" ") for x in bank.LABEL.split(",")]
    label = F.struct(*((F.col(n) if n in i.columns else F.lit(None)).cast(t).alias(n) for n, t in fields))
    return i.select("case_id", label.alias("label"))


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.ontology_diff(version(spark, sf_dir, False), version(spark, sf_dir, True))


_VERSIONS = f"""o as (select {_columns(_OLD)} from ({_PART}) where {_OLD_ROWS}), n as (select {_columns(_NEW)} from ({_PART}) where {_NEW_ROWS}),
    ot as (select semantic_type_id as id, min(data_type || '/' || semantic_family || '/' || semantic_type) as p, bool_or(version_deprecated <> '') as gone from o group by 1),
    nt as (select semantic_type_id as id, min(data_type || '/' || semantic_family || '/' || semantic_type) as p, bool_or(version_deprecated <> '') as gone, max(superseded_by) as next from n group by 1),
    tg as (select nt.id, t.i, t.x from nt, lateral (select unnest(regexp_split_to_array(next, ' *;; *')) as x, unnest(range(len(regexp_split_to_array(next, ' *;; *')))) as i) t where next <> ''),
    lv as (select tg.id, count(*) as c, string_agg(a.p, ' ;; ' order by tg.i) as ps from tg join nt a on a.id = tg.x where not a.gone group by 1),
    vs as (select coalesce(a.id, b.id) as id, count(*) filter (a.v is null) as more, count(*) filter (b.v is null) as less, count(*) filter (a.s <> b.s) as edits from (select distinct semantic_type_id as id, variant_id as v, short_desc as s from o) a full join (select distinct semantic_type_id as id, variant_id as v, short_desc as s from n) b on a.id = b.id and a.v = b.v group by 1),
    j as (select coalesce(ot.id, nt.id) as id, ot.p as a, nt.p as b, coalesce(nt.gone, false) and not coalesce(ot.gone, false) as ends, coalesce(c, 0) as c, ps, more, less, edits from ot full join nt on ot.id = nt.id left join lv on lv.id = nt.id left join vs on vs.id = coalesce(ot.id, nt.id)),
    kinds as (
        select id, 'added' as kind, a, b from j where a is null union all select id, 'deprecated', a, null from j where b is null
        union all select id, case when c >= 2 then 'split' when c = 1 then 'merged' else 'deprecated' end, a, ps from j where a is not null and b is not null and ends
        union all select id, 'moved', a, b from j where not ends and (split_part(a, '/', 1) <> split_part(b, '/', 1) or split_part(a, '/', 2) <> split_part(b, '/', 2))
        union all select id, 'renamed', a, b from j where not ends and a <> b and split_part(a, '/', 1) = split_part(b, '/', 1) and split_part(a, '/', 2) = split_part(b, '/', 2)
        union all select id, 'variant_add', a, b from j where not ends and a = b and more > 0 union all select id, 'variant_drop', a, b from j where not ends and a = b and less > 0
        union all select id, 'attr_edit', a, b from j where not ends and a = b and more = 0 and less = 0 and edits > 0),
    impact(kind, ci, si) as (values ('added', 'none', 'affected_pairs'), ('renamed', 'none', 'none'), ('moved', 'none', 'all_pairs'), ('merged', 'mechanical', 'affected_pairs'), ('split', 'review_required', 'affected_pairs'), ('deprecated', 'review_required', 'affected_pairs'), ('variant_add', 'none', 'none'), ('variant_drop', 'none', 'none'), ('attr_edit', 'none', 'none')),
    d as (select id, kind, a, b, ci, si, case when kind = 'moved' then case when split_part(a, '/', 1) <> split_part(b, '/', 1) then 1 else 2 end when kind in ('renamed', 'merged', 'split', 'deprecated') then 3 else 4 end as acts from kinds join impact using (kind)),
    cs as (select {_columns(_CASES)} from orders)"""

DIFF_SQL = f"with {_VERSIONS} select id as semantic_type_id, kind as change_kind, a as from_path, b as to_path, ci as case_impact, si as scoring_impact, acts as change_depth from d"


def ontology_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(spark, sf_dir).withColumn("change_depth", ontology.change_depth()).drop("note")


IMPACTED_SQL = f"""with {_VERSIONS},
    h as (select case_id, id, kind, ci, a, b, row_number() over (partition by case_id order by case ci when 'review_required' then 0 when 'mechanical' then 1 else 2 end, kind) as r from cs join d on d.id = cs.semantic_type_id where coalesce(depth_labeled, 3) >= acts and ontology_version <> 'v2')
    select case_id, id as semantic_type_id, kind as change_kind, ci as case_impact, case ci when 'mechanical' then 'relabel_mechanical' when 'review_required' then 'requeue_for_review' else 'none' end as action, kind || ' of ' || id || ' (' || coalesce(a, 'NA') || ' -> ' || coalesce(b, 'NA') || ')' as relabel_trigger from h where r = 1"""


def impacted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.impacted_cases(diff(spark, sf_dir), case_index(spark, sf_dir), "v2")


MIGRATE_SQL = f"""with {_VERSIONS}, f as (select id, min(kind) as kind, arg_min(ci, kind) as ci from d group by 1),
    m as (select case_id, case when cs.semantic_type_id is null then 'orphaned' when ontology_version = 'v2' or f.id is null then 'skipped' when ci = 'mechanical' then 'migrated' when ci = 'review_required' then 'flagged' else 'skipped' end as outcome, cs.semantic_type_id as old_id, kind, ontology_version, needs_relabel, relabel_trigger from cs left join f on f.id = cs.semantic_type_id)
    select case_id, outcome, case when outcome = 'migrated' and kind = 'merged' then null else old_id end as semantic_type_id, case when outcome = 'migrated' then 'v2' else ontology_version end as ontology_version,
        case when outcome = 'flagged' then true else needs_relabel end as needs_relabel, case when outcome = 'flagged' then kind || ' of ' || old_id else relabel_trigger end as relabel_trigger from m"""


def migrate_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bank.migrate(diff(spark, sf_dir), bank_cases(spark, sf_dir), "v2")
    return out.select("case_id", "outcome", "label.semantic_type_id", "label.ontology_version", "label.needs_relabel", "label.relabel_trigger")


COUNTS_SQL = "with m as (" + MIGRATE_SQL + ") select count(*) filter (outcome = 'migrated') as n_migrated, count(*) filter (outcome = 'flagged') as n_flagged, count(*) filter (outcome = 'orphaned') as n_orphaned, count(*) filter (outcome = 'skipped') as n_skipped from m"


def migration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.migration_counts(bank.migrate(diff(spark, sf_dir), bank_cases(spark, sf_dir), "v2"))


QUEUE_SQL = f"""with cs as (select {_columns(_CASES)} from orders), q as (select *, count(*) over (partition by semantic_type_id) as c from cs where needs_relabel)
    select case_id, semantic_type_id, relabel_trigger, difficulty, method, row_number() over (order by c, case difficulty when 'hard' then 1 when 'medium' then 2 when 'easy' then 3 else 99 end, case method when 'human' then 1 when 'llm' then 2 else 99 end, case_id)::int as place from q"""


def relabel_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.relabel_queue(case_index(spark, sf_dir))


COVERAGE_SQL = f"""with cs as (select {_columns(_CASES)} from orders) select semantic_type, count(*) filter (difficulty = 'easy') as easy, count(*) filter (difficulty = 'medium') as medium, count(*) filter (difficulty = 'hard') as hard, count(*) as N, round(count(*) filter (difficulty = 'hard') / count(*), 3) as pct_hard from cs group by 1"""


def bank_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.coverage(case_index(spark, sf_dir))


VALIDATE_SQL = f"""with o as (select {_columns(_NEW | {'superseded_by': "case when k % 13 = 4 then concat('t', k + 250) else '' end", 'variant_id': "concat('v', p_partkey % 1990)", 'semantic_type': "concat('s', case when k % 31 = 0 then p_partkey else k % 290 end)"})} from ({_PART})), p as (select *, data_type || '/' || semantic_family || '/' || semantic_type as path from o)
    select 'duplicate variant_id' as problem, variant_id as key from p group by variant_id having count(*) > 1
    union all select 'path with several ids', path from p group by path having count(distinct semantic_type_id) > 1
    union all select 'id with several paths', semantic_type_id from p group by semantic_type_id having count(distinct path) > 1
    union all select 'deprecated id used again', semantic_type_id from p group by semantic_type_id having count(distinct path) > 1 and bool_or(version_deprecated <> '')
    union all select distinct 'unknown successor', superseded_by from p where superseded_by <> '' and superseded_by not in (select semantic_type_id from p)
    union all select 'empty format_label', variant_id from p where format_label = ''
    union all select distinct 'duplicate format_label', semantic_type_id from (select semantic_type_id, format_label from p group by 1, 2 having count(*) > 1)
    union all select distinct 'unknown match_kind', match_kind from p where match_kind not in ('genome', 'mask', 'lexicon', 'mask+lexicon', 'shape', 'none')"""


def validate_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _NEW | {"superseded_by": "case when k % 13 = 4 then concat('t', k + 250) else '' end", "variant_id": "concat('v', p_partkey % 1990)", "semantic_type": "concat('s', case when k % 31 = 0 then p_partkey else k % 290 end)"}
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("k", F.expr("p_partkey % 300"))
    return ontology.validate(parts.selectExpr(*(f"{e} as {c}" for c, e in made.items())))


_PRED = {
    "semantic_type_id": "case when c_custkey % 3 = 0 then concat('t', c_custkey % 300) end", "data_type": "case when c_custkey % 3 <> 0 then c_mktsegment end", "semantic_family": "case when c_custkey % 5 = 0 then '' when c_custkey % 3 <> 0 then 'f' end",
    "semantic_type": "case when c_custkey % 7 <> 0 and c_custkey % 3 <> 0 then 's' end", "confidence": "case when c_custkey % 4 <> 0 then round(c_custkey % 100 / 100.0, 2) end", "detector_id": "case when c_custkey % 2 = 0 then c_name end",
}
GOVERNANCE_SQL = f"""with p as (select c_custkey, {_columns(_PRED)} from customer), o as (select {_columns(_OLD)} from ({_PART}) where {_OLD_ROWS}), t as (select distinct semantic_type_id, data_type as a, semantic_family as b, semantic_type as c from o),
    g as (select c_custkey, case when data_type is null then a else data_type end as data_type, case when data_type is null then b else semantic_family end as semantic_family, case when data_type is null then c else semantic_type end as semantic_type, p.semantic_type_id, confidence::double as confidence, detector_id from p left join t on t.semantic_type_id = p.semantic_type_id)
    select *, case when coalesce(data_type, '') = '' then 0 when coalesce(semantic_family, '') = '' then 1 when coalesce(semantic_type, '') = '' then 2 else 3 end as depth_labeled, 'v6' as ontology_version from g"""


def governance_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", *(f"{e} as {c}" for c, e in _PRED.items()))
    return ontology.governance(rows, version(spark, sf_dir, False))


# Predictions of what orders are, by priority: labels with marks and cases, classes some of which are out of scope.
_GUESS = {"label": "concat(case when o_orderkey % 2 = 0 then upper(o_orderpriority) else replace(o_orderpriority, '-', '_') end, ' ')", "pred_class": "case when o_custkey % 6 = 0 then null else concat('class', o_custkey % 5) end", "pred_type": "case when o_custkey % 6 <> 0 then concat('type', o_custkey % 2) end"}
_CROSS = [("1-URGENT", "type0", "class0"), ("2 high", "type1", "class1"), ("3.medium", "type0", "class2"), ("4-NOT SPECIFIED", "type1", None), ("1 urgent", "type1", "class4")]
_RESULTS = f"""g as (select {_columns(_GUESS)} from orders), x(source_label, gold_type, gold_class) as (values {', '.join(f"('{a}', '{b}', {'null' if c is None else repr(c)})" for a, b, c in _CROSS)}),
    y as (select regexp_replace(lower(source_label), '[^a-z0-9]', '', 'g') as key, arg_min(gold_type, source_label) as gold_type, arg_min(coalesce(gold_class, ''), source_label) as gc from x group by 1),
    r as (select g.*, gold_type, nullif(gc, '') as gold_class, nullif(gc, '') is not null as in_scope, coalesce(nullif(gc, '') = pred_class, false) as class_correct, coalesce(gold_type = pred_type, false) as type_correct from g left join y on y.key = regexp_replace(lower(trim(label)), '[^a-z0-9]', '', 'g'))"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*(f"{e} as {c}" for c, e in _GUESS.items()))
    cross = spark.createDataFrame([(a, b, None, c) for a, b, c in _CROSS], "source_label string, data_type string, data_subtype string, data_class string")
    return evaluation.evaluate(rows, cross)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


OVERALL_SQL = f"with {_RESULTS} select count(*) as n_columns, count(*) filter (in_scope) as n_in_scope, round(avg(class_correct::int) filter (in_scope), 9) as class_accuracy, round(avg(type_correct::int) filter (in_scope), 9) as type_accuracy, round(avg((pred_class is not null)::int) filter (in_scope), 9) as coverage from r"
SUMMARY_SQL = f"""with {_RESULTS}, a as (select gold_class, count(*) as support, count(*) filter (pred_class = gold_class) / count(*) as rc from r where in_scope group by 1), b as (select pred_class, count(*) filter (pred_class = gold_class and in_scope) / count(*) as pr from r where pred_class is not null group by 1)
    select gold_class, support, round(rc, 9) as recall, round(pr, 9) as precision, round(case when pr + rc > 0 then 2 * pr * rc / (pr + rc) end, 9) as f1 from a left join b on pred_class = gold_class"""

_FEASIBLE = {"label": "p_partkey", "type": "case when p_partkey % 5 = 0 then null else concat('a', p_partkey % 3) end", "class": "case when p_partkey % 7 = 0 then '' else concat('b', p_partkey % 2) end", "subclass": "concat('c', p_size % 2)", "unit": "case when p_size % 3 = 0 then 'kg' end"}
_IDEAL = {"label": "p_partkey", "v4_type": "case when p_partkey % 11 = 0 then '' else 'a1' end", "v4_class": "case when p_partkey % 11 = 0 then null when p_partkey % 4 = 0 then '' else 'b1' end", "v4_subclass": "case when p_partkey % 11 = 0 then null else 'c1' end", "feasible_depth": "p_size % 4", "unit": "case when p_partkey % 2 = 0 then 'kg' else '' end"}
FEASIBLE_SQL = f"""with p as (select {_columns(_FEASIBLE)} from part), i as (select {_columns(_IDEAL)} from part),
    m as (select p.*, i.unit as iu, feasible_depth as f, coalesce(v4_type, '') = '' and coalesce(v4_class, '') = '' and coalesce(v4_subclass, '') = '' as noideal, coalesce(type, '') = '' and coalesce(class, '') = '' and coalesce(subclass, '') = '' as nopred,
        case when coalesce(type = v4_type and v4_type <> '', false) then case when coalesce(class = v4_class and v4_class <> '', false) then case when coalesce(subclass = v4_subclass and v4_subclass <> '', false) then 3 else 2 end else 1 end else 0 end as md from p join i using (label))
    select label, type, class, subclass, unit, case when noideal then case when nopred then 0 else 2 end when md = 0 then 2 when md >= f then 0 else 1 end as score, case when iu <> '' then coalesce(unit = iu, false)::int end as unit_recovered from m"""


def feasibility_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return evaluation.feasibility_table(parts.selectExpr(*(f"{e} as {c}" for c, e in _FEASIBLE.items())), parts.selectExpr(*(f"{e} as {c}" for c, e in _IDEAL.items())))


LIFECYCLE = {
    "ontology_diff": (ontology_diff, DIFF_SQL),
    "validate_ontology": (validate_ontology, VALIDATE_SQL),
    "impacted_cases": (impacted_cases, IMPACTED_SQL),
    "migrate_bank": (migrate_bank, MIGRATE_SQL),
    "migration_counts": (migration_counts, COUNTS_SQL),
    "relabel_queue": (relabel_queue, QUEUE_SQL),
    "bank_coverage": (bank_coverage, COVERAGE_SQL),
    "governance_fields": (governance_fields, GOVERNANCE_SQL),
    "eval_overall": (lambda spark, sf_dir: rounded(evaluation.eval_overall(results(spark, sf_dir))), OVERALL_SQL),
    "eval_summary": (lambda spark, sf_dir: rounded(evaluation.eval_summary(results(spark, sf_dir))), SUMMARY_SQL),
    "feasibility_table": (feasibility_table, FEASIBLE_SQL),
}
