"""A bank of labelled test cases: a JSON file each, read as one table, and what a new version of the ontology asks of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ontology import change_depth, filled

LABEL = "data_type string, semantic_family string, semantic_type string, semantic_type_id string, variant_id string, depth_labeled int, ontology_version string, confidence string, method string, reviewer string, labeled_on string, relabeled boolean, relabel_reason string, notes string, needs_relabel boolean, relabel_trigger string"
SCHEMA = f"""case_id string, schema_version string, label struct<{LABEL.replace(' string', ': string').replace(' int', ': int').replace(' boolean', ': boolean')}>,
    difficulty struct<rating: string, rationale: string, noise_markers: array<string>>, source struct<corpus: string, corpus_version: string, original_header: string, original_label: string, table_id: string, parent_case_id: string>,
    values struct<storage_mode: string, n_stored: int, is_lossless: boolean, seed: long, data: array<struct<value: string, count: long>>>, profile map<string, string>"""
# Sizes up to which all values, or all distinct ones, of a case are stored; else so many are drawn.
STORE_ALL, STORE_DISTINCT, STORE_SAMPLE = 250, 150, 100


def read_bank(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """All cases of a folder, with ``file``: a file for each case, or, with ``lines``, a line for each, as ``write_bank`` leaves them."""
    return spark.read.schema(SCHEMA).option("multiLine", not lines).option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.input_file_name())


def write_bank(cases: DataFrame, folder: str) -> None:
    """The cases as JSON, a line for each, to another folder than they are read from."""
    cases.drop("file").write.mode("append").json(folder)


def index_bank(cases: DataFrame) -> DataFrame:
    """A flat row for each case."""
    label = [f"label.{c}" for c in ("data_type", "semantic_family", "semantic_type", "semantic_type_id", "depth_labeled", "ontology_version", "method")]
    return cases.select("case_id", *label, F.col("difficulty.rating").alias("difficulty"), "label.needs_relabel", "label.relabel_trigger", *(["file"] if "file" in cases.columns else []))


def coverage(index: DataFrame) -> DataFrame:
    """``semantic_type, easy, medium, hard, N, pct_hard`` by type."""
    by = index.where("semantic_type is not null").groupBy("semantic_type").pivot("difficulty", ["easy", "medium", "hard"]).count().na.fill(0)
    n = F.col("easy") + F.col("medium") + F.col("hard")
    return by.withColumn("N", n).withColumn("pct_hard", F.when(n > 0, F.round(F.col("hard") / n, 3)))


def stored_values(values: DataFrame, key: str = "column", seed: int = 514) -> DataFrame:
    """``key, v, w, storage_mode`` from distinct values ``v`` and counts ``w``: all where there are few, else 100, drawn without
    replacement in proportion to their counts by hashes, so that reruns agree."""
    by = Window.partitionBy(key)
    u = (F.pmod(F.xxhash64(key, "v", F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    drawn = values.withColumn("n", F.sum("w").over(by)).withColumn("k", F.count("*").over(by)).withColumn("place", F.row_number().over(by.orderBy(-F.log(u) / F.col("w"), "v")))
    mode = F.when(F.col("n") <= STORE_ALL, "full").when(F.col("k") <= STORE_DISTINCT, "unique_count").otherwise("sample")
    return drawn.withColumn("storage_mode", mode).where(f"storage_mode <> 'sample' or place <= {STORE_SAMPLE}").select(key, "v", "w", "storage_mode")


def make_cases(values: DataFrame, labels: DataFrame, corpus: str = "manual", version: str | None = None) -> DataFrame:
    """Cases from columns (``column, v, w``) and their labels (``column`` and label fields, ``difficulty``); a case is named after its column."""
    stored = stored_values(values).groupBy("column").agg(F.first("storage_mode").alias("mode"), F.array_sort(F.collect_list(F.struct(F.col("v").alias("value"), F.col("w").cast("long").alias("count")))).alias("data"))
    given = [x.strip().split(" ") for x in LABEL.split(",")]
    label = F.struct(*((F.col(f"l.{n}") if n in labels.columns else F.lit(version) if n == "ontology_version" else F.lit(None)).cast(t).alias(n) for n, t in given))
    j = stored.join(labels.alias("l"), "column", "left")
    none = F.lit(None).cast("string")
    return j.select(
        F.col("column").alias("case_id"), F.lit("2.0").alias("schema_version"), label.alias("label"),
        F.struct((F.col("l.difficulty") if "difficulty" in labels.columns else none).alias("rating"), none.alias("rationale"), F.array().cast("array<string>").alias("noise_markers")).alias("difficulty"),
        F.struct(F.lit(corpus).alias("corpus"), none.alias("corpus_version"), F.col("column").alias("original_header"), none.alias("original_label"), none.alias("table_id"), none.alias("parent_case_id")).alias("source"),
        F.struct(F.col("mode").alias("storage_mode"), F.size("data").alias("n_stored"), (F.col("mode") != "sample").alias("is_lossless"), F.lit(514).cast("long").alias("seed"), "data").alias("values"),
        F.lit(None).cast("map<string,string>").alias("profile"),
    )


def impacted_cases(diff: DataFrame, index: DataFrame, new_version: str | None = None) -> DataFrame:
    """``case_id, semantic_type_id, change_kind, case_impact, action, relabel_trigger`` of cases that are labelled as deep as a change of their type acts, with the gravest.

    Cases that have the new version already are left out; a label without a depth counts as a whole path.
    """
    rank = F.create_map(F.lit("review_required"), F.lit(0), F.lit("mechanical"), F.lit(1), F.lit("none"), F.lit(2))
    due = index if new_version is None else index.where(~F.col("ontology_version").eqNullSafe(F.lit(new_version)))
    hits = due.select("case_id", "semantic_type_id", "depth_labeled").join(diff.withColumn("acts", change_depth()), "semantic_type_id").where("coalesce(depth_labeled, 3) >= acts")
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(rank[F.col("case_impact")], "change_kind"))
    worst = hits.withColumn("place", place).where("place = 1")
    action = F.when(F.col("case_impact") == "mechanical", "relabel_mechanical").when(F.col("case_impact") == "review_required", "requeue_for_review").otherwise("none")
    trigger = F.format_string("%s of %s (%s -> %s)", "change_kind", "semantic_type_id", F.coalesce("from_path", F.lit("NA")), F.coalesce("to_path", F.lit("NA")))
    return worst.select("case_id", "semantic_type_id", "change_kind", "case_impact", action.alias("action"), trigger.alias("relabel_trigger"))


def flag_cases(cases: DataFrame, impacted: DataFrame) -> DataFrame:
    """Cases with the flag and the reason to be labelled again set where an action is due; only ``label`` changes."""
    due = impacted.where("action <> 'none'").select("case_id", F.col("relabel_trigger").alias("why"))
    label = F.col("label").withField("needs_relabel", F.lit(True)).withField("relabel_trigger", F.col("why"))
    return cases.join(due, "case_id", "left").withColumn("label", F.when(F.col("why").isNotNull(), label).otherwise(F.col("label"))).select(*cases.columns)


def migrate(diff: DataFrame, cases: DataFrame, new_version: str) -> DataFrame:
    """Cases with ``outcome``: migrated, flagged, orphaned (no type) or skipped; the first change of a type by kind decides. Only ``label`` changes.

    A mechanical change gives the label the new version and a note; a merged type's id is taken away, as it is no longer a type. What needs a review is flagged.
    """
    first = diff.groupBy("semantic_type_id").agg(F.min(F.struct("change_kind", "case_impact", "to_path", "note")).alias("ch"))
    j = cases.join(first.withColumnRenamed("semantic_type_id", "changed_id"), F.col("label.semantic_type_id") == F.col("changed_id"), "left")
    outcome = (
        F.when(~filled("label.semantic_type_id"), "orphaned")
        .when(F.col("label.ontology_version").eqNullSafe(F.lit(new_version)) | F.col("ch").isNull(), "skipped")
        .when(F.col("ch.case_impact") == "mechanical", "migrated").when(F.col("ch.case_impact") == "review_required", "flagged").otherwise("skipped")
    )
    moved = F.col("label").withField("semantic_type_id", F.when(F.col("ch.change_kind") != "merged", F.col("label.semantic_type_id"))).withField("ontology_version", F.lit(new_version))
    moved = moved.withField("notes", F.concat_ws(" | ", "label.notes", F.concat(F.lit("migrated: "), "ch.note")))
    flagged = F.col("label").withField("needs_relabel", F.lit(True)).withField("relabel_trigger", F.format_string("%s of %s", F.col("ch.change_kind"), F.col("changed_id")))
    j = j.withColumn("outcome", outcome)
    return j.withColumn("label", F.when(F.col("outcome") == "migrated", moved).when(F.col("outcome") == "flagged", flagged).otherwise(F.col("label"))).select(*cases.columns, "outcome")


def migration_counts(migrated: DataFrame) -> DataFrame:
    return migrated.agg(*(F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("migrated", "flagged", "orphaned", "skipped")))


def relabel_queue(index: DataFrame) -> DataFrame:
    """Flagged cases with ``place``: types with few flagged cases first, then hard before easy, then labels of people before those of models; unknown ones last."""
    order = lambda c, names: F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(c)).cast("int"), F.lit(0))
    last = lambda x: F.when(x == 0, 99).otherwise(x)
    q = index.where("needs_relabel").withColumn("covered", F.count("*").over(Window.partitionBy("semantic_type_id")))
    place = Window.orderBy("covered", last(order("difficulty", ["hard", "medium", "easy"])), last(order("method", ["human", "llm"])), "case_id")  # as many rows as people are to look at
    return q.select("case_id", "semantic_type_id", "relabel_trigger", "difficulty", "method", F.row_number().over(place).alias("place"))
