"""An ontology of types as a table of variants: rules, differences of versions, governance fields.

Rows are variants: ``semantic_type_id, variant_id, data_type, semantic_family, semantic_type, version_deprecated, superseded_by`` (ids with ``;;`` between) and attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What each kind of change asks of stored cases, and of scores.
IMPACT = {
    "added": ("none", "affected_pairs"),
    "renamed": ("none", "none"),
    "moved": ("none", "all_pairs"),
    "merged": ("mechanical", "affected_pairs"),
    "split": ("review_required", "affected_pairs"),
    "deprecated": ("review_required", "affected_pairs"),
    "variant_add": ("none", "none"),
    "variant_drop": ("none", "none"),
    "attr_edit": ("none", "none"),
}
# Attributes whose edits count, and how a variant may be matched.
ATTRIBUTES = ["examples", "data_format", "raw_to_stable_transform", "stable_format", "stable_import_rule", "dd_data_unit", "short_desc", "detail", "validation", "default_storage"]
MATCH_KINDS = ["genome", "mask", "lexicon", "mask+lexicon", "shape", "none"]
BETWEEN = " *;; *"


def impact_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in IMPACT.items()], "change_kind string, case_impact string, scoring_impact string")


def path_of(data_type: str = "data_type", family: str = "semantic_family", kind: str = "semantic_type") -> Column:
    return F.concat_ws("/", data_type, family, kind)


def filled(c: Column | str) -> Column:
    """Neither null nor empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) != ""


def _types(df: DataFrame, attributes: list[str], p: str) -> DataFrame:
    """A row for each type: its path, its variants with attributes, whether it is deprecated, and its successors."""
    return df.groupBy("semantic_type_id").agg(
        F.min(path_of()).alias(f"{p}_path"),
        F.array_sort(F.collect_set("variant_id")).alias(f"{p}_variants"),
        F.bool_or(filled("version_deprecated")).alias(f"{p}_gone"),
        F.array_distinct(F.flatten(F.collect_list(F.when(filled("superseded_by"), F.split("superseded_by", BETWEEN))))).alias(f"{p}_next"),
        F.array_sort(F.collect_set(F.struct("variant_id", *attributes))).alias(f"{p}_rows"),
    )


def ontology_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``semantic_type_id, change_kind, from_path, to_path, case_impact, scoring_impact, note`` for each difference of two versions.

    Types are joined on their ids, whatever their paths. One that the new version deprecates is split, merged or deprecated by the number of its successors that are
    there and not deprecated themselves, and ``to_path`` has theirs. A type whose path has changed is moved or renamed; with the same path its variants, and
    where they are the same its attributes, are compared. A type may have both added and dropped variants, which are two rows.
    """
    attributes = [a for a in ATTRIBUTES if a in old.columns and a in new.columns]
    after = _types(new, attributes, "new")
    j = _types(old, attributes, "old").join(after, "semantic_type_id", "full_outer")
    targets = j.where("new_gone and not coalesce(old_gone, false)").select("semantic_type_id", F.posexplode("new_next").alias("at", "t"))
    live = targets.join(after.select(F.col("semantic_type_id").alias("t"), F.col("new_path").alias("p"), F.col("new_gone").alias("g")), "t").where("not g")
    live = live.groupBy("semantic_type_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("live"))
    j = j.join(live, "semantic_type_id", "left")
    level = lambda c: F.substring_index(c, "/", 2)
    added, dropped = F.array_except("new_variants", "old_variants"), F.array_except("old_variants", "new_variants")
    n = F.coalesce(F.size("live"), F.lit(0))
    listed = lambda text, c: F.concat(F.lit(text), F.array_join(c, ", "))
    row = lambda kind, note, to=F.col("new_path"): F.struct(F.lit(kind).alias("change_kind") if isinstance(kind, str) else kind.alias("change_kind"), to.alias("to_path"), (F.lit(note) if isinstance(note, str) else note).alias("note"))
    superseded = row(
        F.when(n >= 2, "split").when(n == 1, "merged").otherwise("deprecated"),
        F.concat(F.lit("superseded_by: "), F.when(F.size("new_next") > 0, F.array_join("new_next", ", ")).otherwise("none")),
        F.when(n > 0, F.array_join("live", " ;; ")),
    )
    same = F.array_compact(
        F.array(
            F.when(F.size(added) > 0, row("variant_add", listed("new variants: ", added))),
            F.when(F.size(dropped) > 0, row("variant_drop", listed("dropped variants: ", dropped))),
            F.when((F.size(added) == 0) & (F.size(dropped) == 0) & (F.col("old_rows") != F.col("new_rows")), row("attr_edit", "attributes edited")),
        )
    )
    changes = (
        F.when(F.col("old_path").isNull(), F.array(row("added", "new type")))
        .when(F.col("new_path").isNull(), F.array(row("deprecated", "type not there", F.lit(None).cast("string"))))
        .when(F.col("new_gone") & ~F.col("old_gone"), F.array(superseded))
        .when(level("old_path") != level("new_path"), F.array(row("moved", "type or family changed")))
        .when(F.col("old_path") != F.col("new_path"), F.array(row("renamed", "text changed")))
        .otherwise(same)
    )
    out = j.select("semantic_type_id", F.col("old_path").alias("from_path"), F.inline(changes))
    impact = F.create_map(*(x for k, (a, b) in IMPACT.items() for x in (F.lit(k), F.struct(F.lit(a).alias("case_impact"), F.lit(b).alias("scoring_impact")))))[F.col("change_kind")]
    return out.withColumn("i", impact).select("semantic_type_id", "change_kind", "from_path", "to_path", "i.case_impact", "i.scoring_impact", "note")


def change_depth(kind: str = "change_kind", a: str = "from_path", b: str = "to_path") -> Column:
    """The level of a path from which on a label is touched: 1 or 2 for a move, 3 for what concerns the type, 4 for what concerns less."""
    moved = F.when(F.substring_index(a, "/", 1) != F.substring_index(b, "/", 1), 1).otherwise(2)
    return F.when(F.col(kind) == "moved", moved).when(F.col(kind).isin("renamed", "merged", "split", "deprecated"), 3).otherwise(4)


def node_labels(ontology: DataFrame) -> DataFrame:
    """Adds ``derived_label``: three letters of type and family, the type's id, and the variant's ending.

    Families of one type whose first three letters are the same are told apart by more letters. As many rows as a catalogue has.
    """
    short = lambda c: F.upper(F.substring(F.regexp_replace(c, "[^A-Za-z]", ""), 1, 3))
    return ontology.withColumn("derived_label", F.concat_ws("-", short("data_type"), short("semantic_family"), "semantic_type_id", F.substring_index("variant_id", "-", -1)))


def validate(ontology: DataFrame) -> DataFrame:
    """``problem, key`` for each breach of the rules: unique variants; one path for a type and one type for a path, also where it is deprecated; successors
    that exist; formats that are named, once in a type; known kinds of match. The last three need columns ``format_label`` and ``match_kind``."""
    o = ontology.withColumn("path", path_of())

    def repeats(by: str, what: Column, problem: str, rows: DataFrame = o) -> DataFrame:
        return rows.groupBy(by).agg(what.alias("n")).where("n > 1").select(F.lit(problem).alias("problem"), F.col(by).alias("key"))

    gone = o.join(o.where(filled("version_deprecated")).select("semantic_type_id").distinct(), "semantic_type_id", "left_semi")
    targets = o.where(filled("superseded_by")).select(F.explode(F.split("superseded_by", BETWEEN)).alias("semantic_type_id")).distinct()
    found = [
        repeats("variant_id", F.count("*"), "duplicate variant_id"),
        repeats("path", F.count_distinct("semantic_type_id"), "path with several ids"),
        repeats("semantic_type_id", F.count_distinct("path"), "id with several paths"),
        repeats("semantic_type_id", F.count_distinct("path"), "deprecated id used again", gone),
        targets.join(o, "semantic_type_id", "left_anti").select(F.lit("unknown successor").alias("problem"), F.col("semantic_type_id").alias("key")),
    ]
    if "format_label" in o.columns:
        named = o.groupBy("semantic_type_id", "format_label").agg(F.count("*").alias("n"))
        found.append(o.where(~filled("format_label")).select(F.lit("empty format_label").alias("problem"), F.col("variant_id").alias("key")))
        found.append(named.where("n > 1").select(F.lit("duplicate format_label").alias("problem"), F.col("semantic_type_id").alias("key")).distinct())
    if "match_kind" in o.columns:
        kinds = o.where(~F.col("match_kind").isin(MATCH_KINDS)).select(F.lit("unknown match_kind").alias("problem"), F.col("match_kind").alias("key"))
        found.append(kinds.distinct())
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def governance(predictions: DataFrame, ontology: DataFrame | None = None, version: str = "v6") -> DataFrame:
    """The eight fields of a governance file for each row of predictions, which have any of them.

    ``data_type, semantic_family, semantic_type, semantic_type_id, depth_labeled, confidence, ontology_version, detector_id``. The depth counts the levels
    before the first one that is missing. Where only the id is given, the path comes from the ontology.
    """
    levels = ["data_type", "semantic_family", "semantic_type"]
    kinds = {**dict.fromkeys([*levels, "semantic_type_id", "ontology_version", "detector_id"], "string"), "confidence": "double"}
    p = predictions.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in predictions.columns})
    if ontology is not None:
        known = ontology.groupBy("semantic_type_id").agg(F.min(F.struct(*levels)).alias("known"))  # a row for each type of a catalogue
        p = p.join(known, "semantic_type_id", "left")
        bare = F.col("data_type").isNull()
        p = p.withColumns({c: F.when(bare, F.col(f"known.{c}")).otherwise(F.col(c)) for c in levels})
    has = [filled(c) for c in levels]
    depth = F.when(~has[0], 0).when(~has[1], 1).when(~has[2], 2).otherwise(3)
    rest = [c for c in predictions.columns if c not in kinds]
    return p.select(*rest, *levels, "semantic_type_id", depth.alias("depth_labeled"), F.col("confidence").cast("double").alias("confidence"), F.coalesce("ontology_version", F.lit(version)).alias("ontology_version"), "detector_id")
