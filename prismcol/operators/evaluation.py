"""Measures of predictions against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(label: Column) -> Column:
    """A label as letters and digits in small letters, so that ways of writing it are one."""
    return F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "")


def evaluate(predictions: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """``predictions`` (``label, pred_type, pred_class`` and others) with ``gold_type, gold_class, in_scope, class_correct, type_correct``.

    ``crosswalk`` has ``source_label, data_type, data_subtype, data_class``; of several rows for a label the first by its own text counts. A label
    without a class is out of scope. A catalogue's rows are joined, not looked up one by one.
    """
    key = normalised(F.col("source_label"))
    first = crosswalk.withColumn("key", key).withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("source_label"))).where("place = 1")
    gold = first.select("key", F.col("data_type").alias("gold_type"), F.col("data_class").alias("gold_class"))
    j = predictions.withColumn("key", normalised(F.col("label"))).join(gold, "key", "left").drop("key")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return j.withColumns({"in_scope": F.col("gold_class").isNotNull(), "class_correct": same("gold_class", "pred_class"), "type_correct": same("gold_type", "pred_type")})


def eval_overall(results: DataFrame) -> DataFrame:
    """One row: ``n_columns, n_in_scope, class_accuracy, type_accuracy, coverage``, the last three over what is in scope."""
    rate = lambda c: F.avg(F.when(F.col("in_scope"), c.cast("int")))
    return results.agg(F.count("*").alias("n_columns"), F.count_if("in_scope").alias("n_in_scope"), rate(F.col("class_correct")).alias("class_accuracy"), rate(F.col("type_correct")).alias("type_accuracy"), rate(F.col("pred_class").isNotNull()).alias("coverage"))


def eval_summary(results: DataFrame) -> DataFrame:
    """``gold_class, support, recall, precision, f1`` for each gold class in scope. Precision is over all predictions of a class, those for
    columns out of scope too; null where there are none."""
    tp = F.count_if(F.coalesce(F.col("gold_class") == F.col("pred_class"), F.lit(False)))
    gold = results.where("in_scope").groupBy("gold_class").agg(F.count("*").alias("support"), tp.alias("tp"))
    made = results.where("pred_class is not null").groupBy(F.col("pred_class").alias("gold_class")).agg(F.count("*").alias("predicted"))
    j = gold.join(made, "gold_class", "left")
    recall, precision = F.col("tp") / F.col("support"), F.col("tp") / F.col("predicted")
    return j.select("gold_class", "support", recall.alias("recall"), precision.alias("precision"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).alias("f1"))


def feasibility(pred: list[Column], ideal: list[Column], feasible_depth: Column) -> Column:
    """0 where a prediction (type, class, subclass) agrees with the ideal as deep as is feasible, 1 where it agrees but stops short, 2 where it is on another
    branch or says nothing. Without an ideal, 0 for saying nothing and 2 for anything else."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    agrees, matched = F.lit(True), F.lit(0)
    for k, (p, i) in enumerate(zip(pred, ideal, strict=True), 1):
        agrees = agrees & has(i) & F.coalesce(p == i, F.lit(False))
        matched = F.when(agrees, k).otherwise(matched)
    nothing = lambda cs: ~(has(cs[0]) | has(cs[1]) | has(cs[2]))
    return F.when(nothing(ideal), F.when(nothing(pred), 0).otherwise(2)).when(matched == 0, 2).when(matched >= feasible_depth, 0).otherwise(1)


def unit_recovered(pred: Column, ideal: Column) -> Column:
    """1 where the unit is the ideal one, 0 where it is not, null where the ideal has none."""
    return F.when(F.coalesce(ideal, F.lit("")) != "", F.coalesce(pred == ideal, F.lit(False)).cast("int"))


def feasibility_table(predictions: DataFrame, crosswalk: DataFrame, key: str = "label") -> DataFrame:
    """``predictions`` (``type, class, subclass, unit``) with ``score`` and ``unit_recovered`` against the crosswalk's row of the same key (``v4_type, v4_class, v4_subclass, feasible_depth, unit``)."""
    c = crosswalk.select(key, "v4_type", "v4_class", "v4_subclass", "feasible_depth", F.col("unit").alias("ideal_unit"))
    j = predictions.join(c, key)
    score = feasibility([F.col("type"), F.col("class"), F.col("subclass")], [F.col("v4_type"), F.col("v4_class"), F.col("v4_subclass")], F.col("feasible_depth"))
    return j.select(*predictions.columns, score.alias("score"), unit_recovered(F.col("unit"), F.col("ideal_unit")).alias("unit_recovered"))
