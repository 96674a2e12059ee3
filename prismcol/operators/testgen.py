"""Negatives for detectors: seeded mutations of values, and what a detector accepts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters, digits, and the marks and the space of the widest tier.
ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
GENERIC = ALNUM + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ "
TIERS = ("S1", "S2", "S3", "SP")


def alphabet(positives: DataFrame) -> DataFrame:
    """One row: ``everything``, ``alnum`` and ``marks``, the characters that occur in the values, sorted; as many as an alphabet has."""
    chars = positives.select(F.explode(F.split("v", "")).alias("c")).where("c <> ''").groupBy("c").count()
    plain = F.col("c").rlike("[A-Za-z0-9]")
    return chars.agg(F.array_sort(F.collect_list("c")).alias("everything"), F.array_sort(F.collect_list(F.when(plain, F.col("c")))).alias("alnum"), F.array_sort(F.collect_list(F.when(~plain, F.col("c")))).alias("marks"))


def _hash(v: Column, k: Column, i: Column, seed: int) -> Column:
    """40 bits of an MD5, which any engine can state."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", v, k.cast("string"), i.cast("string"), F.lit(str(seed)))), 1, 10), 16, 10).cast("long")


def mutate(v: Column, k: Column, pool: Column, only_alnum: bool, p: float = 0.5, seed: int = 514) -> Column:
    """Each character, or each letter and digit, replaced with probability ``p`` by one of the pool; hashes of value, number and place decide, so reruns agree."""

    def one(c: Column, i: Column) -> Column:
        h = _hash(v, k, i, seed)
        swap = (h % 1000 < int(p * 1000)) & (c.rlike("[A-Za-z0-9]") if only_alnum else F.lit(True)) & (F.size(pool) > 0)
        return F.when(swap, F.get(pool, F.pmod(F.floor(h / 1000), F.greatest(F.size(pool), F.lit(1))).cast("int"))).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(v, ""), lambda c: c != ""), one), "")


def scramble(v: Column, k: Column, p: float = 1.0, seed: int = 514) -> Column:
    """The marks that move, each with probability ``p``, taken out and put back, shuffled, at random places; letters and digits keep their order. Values without marks stay."""
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    tagged = F.transform(chars, lambda c, i: F.struct(c.alias("c"), (~c.rlike("[A-Za-z0-9]") & (_hash(v, k, i, seed) % 1000 < int(p * 1000))).alias("moves"), _hash(v, k, i, seed + 1).alias("h"), _hash(v, k, i, seed + 2).alias("g"), i.alias("i")))
    rest = F.filter(tagged, lambda x: ~x["moves"])
    moving = F.array_sort(F.transform(F.filter(tagged, lambda x: x["moves"]), lambda x: F.struct(x["h"].alias("h"), x["i"].alias("i"), x["c"].alias("c"))))
    # The places of smallest hash are those of the marks.
    places = F.array_sort(F.transform(F.slice(F.array_sort(F.transform(tagged, lambda x: F.struct(x["g"].alias("g"), x["i"].alias("i")))), 1, F.size(moving)), lambda x: x["i"]))
    out = F.transform(
        F.sequence(F.lit(0), F.size(chars) - 1),
        lambda i: F.when(F.array_contains(places, i), F.get(moving, F.array_position(places, i).cast("int") - 1)["c"]).otherwise(F.get(rest, i - F.size(F.filter(places, lambda x: x < i)))["c"]),
    )
    return F.when(F.size(moving) == 0, v).otherwise(F.array_join(out, ""))


def negatives(positives: DataFrame, tier: str, n: int = 20, p: float = 0.5, seed: int = 514) -> DataFrame:
    """Distinct mutants of rows ``v`` that are no positives, with ``label``.

    Tier S1 changes letters and digits to others that the positives have, S2 all characters to any that they have, S3 to any of letters, digits, marks and the space; SP moves marks.
    """
    numbered = positives.select("v").where("length(v) > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    if tier == "SP":
        out = numbered.select(scramble(F.col("v"), F.col("k"), 1.0, seed).alias("v"))
    elif tier == "S3":
        out = numbered.select(mutate(F.col("v"), F.col("k"), F.array(*map(F.lit, GENERIC)), False, p, seed).alias("v"))
    else:
        known = F.broadcast(alphabet(positives))  # one row
        out = numbered.join(known).select(mutate(F.col("v"), F.col("k"), F.col("alnum" if tier == "S1" else "everything"), tier == "S1", p, seed).alias("v"))
    return out.distinct().join(positives.select("v"), "v", "left_anti").withColumn("label", F.lit(tier))


def detector_results(detector, positives: DataFrame, tiers: tuple[str, ...] = TIERS, n: int = 20, threshold: float = 0.5) -> DataFrame:
    """``v, label, accepted`` for positives (label valid) and the negatives of each tier. A detector may give a number, which counts from ``threshold`` on."""
    rows = positives.select("v", F.lit("valid").alias("label"))
    for tier in tiers:
        rows = rows.unionByName(negatives(positives, tier, n))
    got = detector(F.col("v"))
    scored = rows.withColumn("got", got)
    numeric = scored.schema["got"].dataType.simpleString() != "boolean"
    return scored.select("v", "label", F.coalesce(F.col("got") >= threshold if numeric else F.col("got"), F.lit(False)).alias("accepted"))


def detector_report(detector, positives: DataFrame, tiers: tuple[str, ...] = TIERS, n: int = 20) -> DataFrame:
    """``label, n, accepted, pass_rate`` for positives and each tier."""
    return detector_results(detector, positives, tiers, n).groupBy("label").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"), F.avg(F.col("accepted").cast("int")).alias("pass_rate"))


def summary_row(name: str, results: DataFrame, examples: int = 3) -> DataFrame:
    """One row for a detector: positives, false negatives and the share of negatives accepted, by tier, with some examples of both."""
    some = lambda cond: F.slice(F.array_sort(F.collect_set(F.when(cond, F.col("v")))), 1, examples)
    valid = F.col("label") == "valid"
    rates = [F.avg(F.when(F.col("label") == t, F.col("accepted").cast("int"))).alias(f"rate_{t}") for t in TIERS]
    return results.agg(F.lit(name).alias("data_type"), F.count_if(valid).alias("n_positives"), F.count_if(valid & ~F.col("accepted")).alias("n_false_negatives"), *rates, some(valid & ~F.col("accepted")).alias("false_negatives"), some(~valid & F.col("accepted")).alias("false_positives"))


def report_text(name: str, results: DataFrame, examples: int = 3) -> str:
    """The report of a detector as lines of text."""
    row = summary_row(name, results, examples).first()
    lines = [f"{name}: {row['n_false_negatives']} of {row['n_positives']} positives rejected" + "".join(f"\n  {x}" for x in row["false_negatives"])]
    return "\n".join(lines + [f"{t}: {row[f'rate_{t}']:.1%} of negatives accepted" for t in TIERS if row[f"rate_{t}"] is not None] + [f"  {x}" for x in row["false_positives"]])
