"""Further profile blocks: word ends, length and delimiter shapes, moments of numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NUMBER
from ..sources.values import usable
from .profile import BLOCKS, L, V, W, mean, spread, stripped

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
DELIMITERS = {"comma": ",", "semi": ";", "pipe": "|", "slash": "/"}


def entropy() -> Column:
    """Of the weights ``w`` of a group's rows, in nats."""
    return F.log(F.sum(W())) - F.sum(W() * F.log(W())) / F.sum(W())


def tallies(rows: DataFrame, by: str, names: dict[str, str]) -> DataFrame:
    """Top share, entropy and number of the values of one expression; ``names`` says which, and what they are called."""
    made = {"top": F.max("w") / F.sum("w"), "entropy": entropy(), "n": F.count("*")}
    return rows.groupBy("column", F.expr(by).alias("x")).agg(F.sum("w").alias("w")).groupBy("column").agg(*(made[k].alias(name) for k, name in names.items()))


def letters(values: DataFrame) -> DataFrame:
    """First and last letters of words and their last two letters. No more rows than triples of letters are kept for a column."""
    words = F.filter(F.split(F.lower(F.regexp_replace(V(), "[^A-Za-z ]", " ")), " +"), lambda t: t != "")
    ends = usable(values).select("column", "w", F.explode(words).alias("t")).groupBy("column", F.expr("left(t, 1)").alias("f"), F.expr("right(t, 2)").alias("s")).agg(F.sum("w").alias("w"))
    of = lambda c, ch: F.sum(F.when(c == ch, W()).otherwise(0)) / F.sum(W())
    shares = ends.groupBy("column").agg(*(of(F.col("f"), ch).alias(f"first_{ch}") for ch in ALPHABET), *(of(F.expr("right(s, 1)"), ch).alias(f"last_{ch}") for ch in ALPHABET))
    for by, names in {"s": {"entropy": "suffix2_entropy", "top": "suffix2_top_share", "n": "suffix2_n_distinct"}, "right(s, 1)": {"entropy": "last_entropy"}, "f": {"entropy": "first_entropy"}}.items():
        shares = shares.join(tallies(ends, by, names), "column")
    return shares


def token_ends(values: DataFrame) -> DataFrame:
    """First and last tokens, shapes of token rows, and whether ten last tokens end nine in ten values."""
    tokens = F.filter(F.split(F.lower(F.regexp_replace(V(), "[^A-Za-z0-9' ]", " ")), " +"), lambda t: t != "")
    rows = usable(values).select("column", "w", tokens.alias("a")).where("size(a) > 0")
    kinds = "array_join(transform(a, t -> case when t rlike '^[0-9]+$' then '9' when t rlike '^[a-z]+$' then 'a' else 'x' end), ' ')"
    out = tallies(rows, "a[0]", {"top": "first_tok_top_share", "entropy": "first_tok_entropy", "n": "first_tok_n_unique"})
    out = out.join(tallies(rows, "element_at(a, -1)", {"top": "last_tok_top_share", "entropy": "last_tok_entropy", "n": "last_tok_n_unique"}), "column")
    out = out.join(tallies(rows, kinds, {"top": "tokmask_top_share", "n": "tokmask_n_unique"}), "column")
    # counts of counts, so that no column's tokens are ranked in one task
    counts = rows.groupBy("column", F.expr("element_at(a, -1)").alias("x")).agg(F.sum("w").alias("w")).groupBy("column", "w").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("column").orderBy(F.col("w").desc()))
    taken = F.greatest(F.lit(0), F.least(F.col("k"), 10 - (F.col("upto") - F.col("k"))))
    closed = counts.withColumn("upto", upto).groupBy("column").agg((F.sum(W() * taken) / F.sum(W() * F.col("k")) > 0.9).cast("double").alias("last_tok_closed"))
    return out.join(closed, "column")


def shapes(values: DataFrame) -> DataFrame:
    """Spread, skew and evenness of lengths, and how constantly delimiters cut. Length entropy is over distinct values."""
    u = usable(values)
    # the pieces that a delimiter cuts, without an empty one at the end; an empty value has none
    n = {k: F.when(V() == "", 0).otherwise(L() - F.length(F.replace(V(), F.lit(d), F.lit(""))) + F.when(V().endswith(d), 0).otherwise(1)) for k, d in DELIMITERS.items()}
    tokens = F.size(F.split(F.btrim(V(), F.lit(" \t\r\n")), r"\s+"))
    cuts = [c for k, x in n.items() for c in (((F.min(x) == F.max(x)) & (F.min(x) > 1)).cast("double").alias(f"delim_const_{k}"), mean(x).alias(f"delim_nfld_{k}"))]
    base = u.groupBy("column").agg(*cuts, F.when(mean(L()) > 0, spread(L()) / mean(L())).alias("len_cv"), F.when(mean(tokens) > 0, mean(L()) / mean(tokens)).alias("word_len_mean"))
    by = u.groupBy("column", L().alias("x")).agg(F.sum("w").alias("w"), F.count("*").alias("k"))
    even = F.log(F.sum("k")) - F.sum(F.col("k") * F.log("k")) / F.sum("k")
    lengths = by.groupBy("column").agg(even.alias("len_entropy"), F.when(F.count("*") >= 2, even / F.log(F.count("*"))).alias("len_entropy_norm"), (F.max("w") / F.sum("w")).alias("len_top_share"))
    return base.join(lengths, "column").join(standard_moments(by, "len_skew", "len_kurt"), "column")


def standard_moments(rows: DataFrame, skew: str, kurt: str) -> DataFrame:
    """Population skew and excess kurtosis of ``x`` weighted by ``w``; null without spread. Deviations are from the mean of a first pass: sums of raw powers would cancel."""
    first = rows.where("x is not null").groupBy("column").agg((F.sum(F.col("x") * W()) / F.sum("w")).alias("m"))
    d = F.col("x") - F.col("m")
    at = lambda k: F.sum(F.pow(d, k) * W()) / F.sum("w")
    ok = at(2) > 0
    return rows.where("x is not null").join(first, "column").groupBy("column").agg(F.when(ok, at(3) / F.pow(at(2), 1.5)).alias(skew), F.when(ok, at(4) / F.pow(at(2), 2) - 3).alias(kurt))


def chi_square(cell: Column, expected: dict[int, float], ok: Column) -> Column:
    """Sum of squared deviations from expected shares over these, each as a share of the total weight."""
    total = F.sum(F.when(ok & cell.isin(list(expected)), W()))
    parts = [F.pow(F.sum(F.when(ok & (cell == d), W()).otherwise(0)) / total - e, 2) / e for d, e in expected.items()]
    return sum(parts[1:], parts[0])


def moments(values: DataFrame) -> DataFrame:
    """Third and fourth moments of numbers, their dispersion and digits; null where fewer than three rows are numbers."""
    s = stripped(V())
    rows = usable(values).select("column", "w", F.when(s.rlike(NUMBER), s.try_cast("double")).alias("x"), F.length(F.substring_index(F.regexp_replace(s, "^-", ""), ".", 1)).alias("i")).where("x is not null")
    x = F.col("x")
    n = F.sum("w")
    m = F.sum(x * W()) / n
    var = F.sum(x * x * W()) / n - m * m
    pos, tens = x > 0, (x == F.floor(x)) & (F.abs(x) >= 10)
    lead = F.bround(x / F.pow(F.lit(10.0), F.floor(F.log10(x)))).cast("int")
    lead = F.when(lead == 10, 1).otherwise(lead)
    log = lambda v: F.log10(v + 1)
    whole = F.min(((x >= 0) & (x == F.floor(x))).cast("int")) == 1
    base = rows.groupBy("column").agg(
        n.alias("n"), F.count_if(pos).alias("n_pos"), (F.sum(F.col("i") * W()) / n).alias("n_digits_mean"), (log(F.max(F.abs(x))) - log(F.min(F.when(x != 0, F.abs(x))))).alias("log10_range"),
        F.when((m > 0) & whole & (F.count("*") >= 2), F.greatest(F.lit(0.0), var) / m).alias("overdispersion"), (F.sum(F.when(x == 0, W()).otherwise(0)) / n).alias("zero_inflation"),
        F.when(F.count_if(pos) >= 30, chi_square(lead, {d: math.log10(1 + 1 / d) for d in range(1, 10)}, pos)).alias("benford_chi2"),
        F.when(F.count_if(tens) >= 30, chi_square((F.abs(x) % 10).cast("int"), dict.fromkeys(range(10), 0.1), tens)).alias("lastdigit_chi2"),
    )
    logs = standard_moments(rows.where(pos).select("column", "w", F.log("x").alias("x")), "skewness_log", "kurtosis_log").drop("kurtosis_log")
    out = base.join(standard_moments(rows, "skewness", "kurtosis"), "column", "left").join(logs, "column", "left").withColumn("skewness_log", F.when(F.col("n_pos") > 3, F.col("skewness_log")))
    return out.select("column", *(F.when(F.col("n") >= 3, F.col(c)).alias(c) for c in out.columns if c not in ("column", "n", "n_pos")))


BLOCKS.update(letters=letters, token_ends=token_ends, shapes=shapes, moments=moments)
