"""Signatures of columns, and distances of signatures and of paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import profile as P

# The axes, and the weights by which formats of one type are compared.
AXES = ["composition", "numeric_gap", "rigidity", "width", "punctuation", "tokenization", "cardinality"]
FORMAT_WEIGHTS = [1.0, 0.5, 2.0, 2.0, 2.0, 1.0, 0.0]


def signatures(values: DataFrame) -> DataFrame:
    """``column`` and seven axes in [0, 1], from the values' shares of digits and marks, numbers, masks, lengths, tokens and distinct values."""
    f = P.charclass(values).join(P.numeric(values), "column").join(P.mask(values), "column").join(P.length(values), "column").join(P.core(values), "column")
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    axes = [F.col("pct_chr_digit"), (F.col("coerce_rate_strip") - F.col("pct_chr_digit") + 1) / 2, F.col("mask_top_share"), F.log10(1 + F.col("len_mean")) / 2, F.col("pct_chr_punct"), F.col("pct_single_tok"), F.col("unique_ratio")]
    return f.select("column", *(clamp(a).alias(n) for n, a in zip(AXES, axes, strict=True)))


def signature_distance(a: str, b: str, weights: list[float] | None = None) -> Column:
    """Weighted mean difference over the axes that both rows (aliased ``a`` and ``b``) have."""
    both = [(F.col(f"{a}.{x}"), F.col(f"{b}.{x}"), w) for x, w in zip(AXES, weights or [1.0] * len(AXES), strict=True)]
    top = reduce(lambda s, t: s + t, (F.coalesce(F.abs(x - y) * w, F.lit(0.0)) for x, y, w in both))
    return top / F.nullif(reduce(lambda s, t: s + t, (F.when((x - y).isNotNull(), F.lit(float(w))).otherwise(0.0) for x, y, w in both)), F.lit(0.0))


def path_distance(p: Column, q: Column, levels: int = 3) -> Column:
    """Levels below the last one that two slash-separated paths share, as a part of all."""
    a, b = F.split(p, "/"), F.split(q, "/")
    shared = F.lit(0)
    for k in range(levels, 0, -1):
        shared = F.when((F.size(a) >= k) & (F.size(b) >= k) & (F.slice(a, 1, k) == F.slice(b, 1, k)), F.greatest(shared, F.lit(k))).otherwise(shared)
    return (levels - shared) / levels


def sibling_report(signed: DataFrame, path_near: float = 0.34, sig_near: float = 0.10) -> DataFrame:
    """Pairs of types (rows ``column, path`` and axes; as many as a catalogue has) by how near they are on paper and in shape."""
    a, b = signed.alias("a"), signed.alias("b")
    pairs = a.join(b, F.col("a.column") < F.col("b.column")).select(F.col("a.column").alias("left"), F.col("b.column").alias("right"), F.round(signature_distance("a", "b"), 3).alias("sig_dist"), F.round(path_distance(F.col("a.path"), F.col("b.path")), 6).alias("path_dist"))
    near_p, near_s = F.col("path_dist") <= path_near, F.col("sig_dist") <= sig_near
    return pairs.withColumn("verdict", F.when(near_p & near_s, "both").when(near_s, "hidden_risk").when(near_p, "safe_split").otherwise("unrelated"))


def similarity(a: str, b: str, weights: list[float] | None = None) -> Column:
    """One less the distance."""
    return 1 - signature_distance(a, b, weights)


def explain_pair(signed: DataFrame, left: str, right: str, weights: list[float] | None = None) -> DataFrame:
    """``axis, left, right, difference, part`` for two columns of signatures: how much each axis adds to their distance, largest first."""
    w = weights or [1.0] * len(AXES)
    a, b = signed.where(F.col("column") == left).alias("a"), signed.where(F.col("column") == right).alias("b")
    gap = lambda x: F.abs(F.col(f"a.{x}") - F.col(f"b.{x}"))
    total = reduce(lambda s, t: s + t, (F.when(gap(x).isNotNull(), F.lit(float(k))).otherwise(0.0) for x, k in zip(AXES, w, strict=True)))
    rows = F.array(*(F.struct(F.lit(x).alias("axis"), F.col(f"a.{x}").alias("left"), F.col(f"b.{x}").alias("right"), gap(x).alias("difference"), (gap(x) * k / F.nullif(total, F.lit(0.0))).alias("part")) for x, k in zip(AXES, w, strict=True)))
    return a.join(b).select(F.inline(rows)).orderBy(F.col("part").desc_nulls_last(), "axis")  # one row each
