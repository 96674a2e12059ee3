"""Tables as distinct values with counts, and files as all-text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trimmed
from ..functions.vocabulary import SENTINELS


def as_text(df: DataFrame, name: str) -> Column:
    """A column as text; nested values as JSON."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")


def values_frame(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, v, w``: each column's distinct values, null included, and their counts.

    One scan of the chosen columns and one shuffle on (column, value), so a column of many values is spread over all tasks.
    """
    columns = columns or df.columns
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), as_text(df, c).alias("v")) for c in columns))
    return df.select(F.inline(pairs)).groupBy("column", "v").agg(F.count("*").alias("w"))


def usable(values: DataFrame) -> DataFrame:
    """Without nulls and words for missing values."""
    return values.where(F.col("v").isNotNull() & ~F.lower(trimmed(F.col("v"))).isin(SENTINELS))


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with all columns as text; an empty field stays an empty string."""
    return spark.read.csv(path, header=True, inferSchema=False, emptyValue="", nullValue="\u0000")
