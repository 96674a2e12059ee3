"""Contiguous shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise


def shard_by_bytes(rows: DataFrame, n_shards: int, size: str = "size", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Deal ``rows`` into ``n_shards`` contiguous runs of the given order, of nearly equal total ``size``.

    Adds ``shard`` (int, from 0) and ``slot`` (long, the row's place in its shard, gapless from 0).

    The rows are range-partitioned by the order, which no single key can skew: a running tie-breaker
    is part of the range key. Each partition gives its row count and total size, running totals of
    those few figures place it, and running totals inside it place each row. A row goes to the shard
    in whose equal span of the total the row's middle byte lies, so a shard's total differs from the
    target by less than its two outermost rows.

    Null order keys come first; rows equal in the order are dealt in any order (equal rows give equal
    results). A null size counts as 0. An empty table gives no rows; rows that are all of size 0 go to shard 0.
    A row larger than the target leaves some shard without rows. Columns of the input stay as they
    are, but ``shard`` and ``slot`` of the input are replaced.
    """
    rows = rows.drop("shard", "slot")
    tie, part, before, first, index, total = fresh(rows, "tie", "part", "before", "first", "index", "total")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in order]
    length = F.coalesce(F.col(size).cast("long"), F.lit(0))
    dealt = materialise(
        rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *keys, F.col(tie)).withColumn(part, F.spark_partition_id()),
        "shards",
    )
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    whole = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = dealt.groupBy(part).agg(F.sum(length).alias("b"), F.count("*").alias("n"))
    totals = totals.select(
        part,
        F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias(before),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(first),
        F.sum("b").over(whole).alias(total),
    )
    inside = Window.partitionBy(part).orderBy(*keys, tie)
    placed = dealt.join(F.broadcast(totals), part).withColumns(  # as many rows as range partitions
        {
            before: F.col(before) + F.sum(length).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - length,
            index: F.col(first) + F.row_number().over(inside) - 1,
        }
    )
    placed = placed.withColumn(
        "shard",
        F.when(F.col(total) > 0, F.least(F.lit(n_shards - 1), F.expr(f"(2 * `{before}` + coalesce(cast(`{size}` as long), 0)) * {n_shards} div (2 * `{total}`)"))).otherwise(0).cast("int"),
    )
    starts = placed.groupBy("shard").agg(F.min(index).alias(first))  # as many rows as shards
    return (
        placed.drop(first)
        .join(F.broadcast(starts), "shard")
        .withColumn("slot", F.col(index) - F.col(first))
        .select(*rows.columns, "shard", "slot")
    )

