"""More blocks of a column's profile: divergences, lexicons, shapes of distributions, declared types, and the order of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V
from ..functions.text import NUMBER
from ..sources.values import usable, values_frame
from . import profile as P

# Shares of the letters a to z in English; prefixes of employer numbers.
ENGLISH = [0.0817, 0.0149, 0.0278, 0.0425, 0.1270, 0.0223, 0.0202, 0.0609, 0.0697, 0.0015, 0.0077, 0.0403, 0.0241, 0.0675, 0.0751, 0.0193, 0.0010, 0.0599, 0.0633, 0.0906, 0.0276, 0.0098, 0.0236, 0.0015, 0.0197, 0.0007]
EIN_PREFIXES = [f"{i:02d}" for a, b in ((1, 6), (10, 16), (20, 27), (30, 39), (40, 48), (50, 59), (60, 68), (71, 77), (80, 88), (90, 95), (98, 99)) for i in range(a, b + 1)]
# Short lexicons.
WORDS = {
    "org_suffix": "inc incorporated corp corporation llc ltd llp co foundation trust fund assn association society institute council center centre church ministries alliance coalition network partnership university college academy school".split(),
    "street_suffix": "st street ave avenue rd road blvd boulevard ln lane dr drive ct court pl place way pkwy parkway hwy highway ter terrace cir circle sq square apt suite ste".split(),
    "honorific": "mr mrs ms dr prof rev hon sr jr ii iii iv phd md jd mba rn cpa esq".split(),
    "direction": "north south east west ne nw se sw n s e w".split(),
    "unit_token": "kg g mg lb lbs oz km m cm mm mi ft in yd l ml gal qt pt hr min sec usd eur gbp pct".split(),
    "boolean_word": "yes no y n true false t f on off".split(),
}
TOP_TOKENS = 200
SAMPLE_ROWS = 500
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def lexicons() -> dict[str, list[str]]:
    """The lists of the lexicon block, with the names and cities of the folder of ``vocabulary.use_lexicons`` or the seeds."""
    states = [s.lower() for s in V.STATES if s != "District of Columbia"]
    return {
        "first_name": V.lexicon("first_name"), "last_name": V.lexicon("last_name"), "us_city": sorted({*V.lexicon("us_city"), *states}), "us_state_name": states,
        "us_state_abb": [c.lower() for c in V.STATE_CODES if c != "DC"], "month_name": [x.lower() for m in V.MONTHS for x in (m, m[:3])], "day_name": [x.lower() for d in V.WEEKDAYS for x in (d, d[:3])], **WORDS, "stopword": V.STOPWORDS,
    }


def row_sample(df: DataFrame, columns: list[str] | None = None, n: int = SAMPLE_ROWS, seed: int = 1) -> DataFrame:
    """``column, v, w`` of ``n`` rows of each column, drawn among those with a value by hashes of the row, so that reruns agree.

    Only the ``n`` smallest hashes of a task are shuffled for each column.
    """
    columns = columns or df.columns
    key = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(seed))
    from ..sources.values import as_text

    pairs = F.array(*(F.struct(F.lit(c).alias("column"), as_text(df, c).alias("v")) for c in columns))
    rows = df.select(F.inline(pairs), key.alias("h")).where("v is not null and trim(v) <> ''")
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.xxhash64("h", "column"), "v"))
    return rows.withColumn("place", place).where(f"place <= {n}").groupBy("column", "v").agg(F.count("*").alias("w"))


def divergences(values: DataFrame) -> DataFrame:
    """How far letters are from English and digits from even shares; distinct characters; checks of employer numbers; the slope of token counts."""
    c = P.charfreq(values)
    parts = [F.when(F.col(f"ltr_{x}") > 0, F.col(f"ltr_{x}") * F.log(F.col(f"ltr_{x}") / e)).otherwise(F.when(F.col(f"ltr_{x}").isNotNull(), 0.0)) for x, e in zip(LETTERS, ENGLISH, strict=True)]
    even = reduce(lambda a, b: a + b, (F.pow(F.col(f"dig_{d}") - 0.1, 2) / 0.1 for d in range(10)))
    c = c.select("column", reduce(lambda a, b: a + b, parts).alias("ltr_kl_english"), even.alias("dig_uniform_chi2"))
    u = usable(values)
    chars = u.select("column", F.explode(F.split("v", "")).alias("c")).where("c <> ''").distinct()
    letter = F.when(F.col("c").rlike("[A-Za-z]"), F.lower("c"))
    chars = chars.groupBy("column").agg(F.count("*").alias("n_distinct_chars"), (F.count_distinct(letter) / 26).alias("alphabet_closure"))
    shaped = F.col("v").rlike(r"^[0-9]{2}-?[0-9]{7}\z")
    ein = u.groupBy("column").agg((F.sum(F.when(shaped & F.substring("v", 1, 2).isin(EIN_PREFIXES), F.col("w")).when(shaped, 0)) / F.sum(F.when(shaped, F.col("w")))).alias("chk_ein_prefix_rate"))
    counts = tokens(values).groupBy("column", "w").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("column").orderBy(F.col("w").desc()))
    # Rows of one count stand on ranks that follow one another: as many rows as tokens, but only counts are sorted.
    ranks = counts.withColumn("upto", upto).select("column", "w", F.explode(F.sequence(F.col("upto") - F.col("k") + 1, F.col("upto"))).alias("r"))
    slope = ranks.groupBy("column").agg(F.regr_slope(F.log("w"), F.log("r")).alias("s"), F.count("*").alias("n"), F.max("w").alias("m"))
    slope = slope.select("column", F.when((F.col("n") >= 10) & (F.col("m") > 1), F.col("s")).alias("tok_zipf_slope"))
    return c.join(chars, "column", "left").join(ein, "column", "left").join(slope, "column", "left")


def tokens(values: DataFrame) -> DataFrame:
    """``column, t, w``: tokens of letters, digits and apostrophes in small letters, and their weights."""
    split = F.filter(F.split(F.lower(F.regexp_replace("v", "[^A-Za-z0-9' ]", " ")), " +"), lambda t: t != "")
    return usable(values).select("column", "w", F.explode(split).alias("t")).groupBy("column", "t").agg(F.sum("w").alias("w"))


def lexicon(values: DataFrame, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """For each list the shares of values, and of tokens by weight, that are in it; of tokens the TOP_TOKENS of most weight are looked up."""
    lists = lists or lexicons()
    low, w = F.lower(F.btrim("v", F.lit(" \t\r\n"))), F.col("w")
    hit = lambda x: F.sum(F.when(x, w).otherwise(0)) / F.sum(w)
    everything = sorted({x for xs in lists.values() for x in xs})
    whole = usable(values).groupBy("column").agg(*(hit(low.isin(xs)).alias(f"lex_{k}_value") for k, xs in lists.items()), hit(low.isin(everything)).alias("lex_any_value"))
    t = tokens(values).withColumn("total", F.sum("w").over(Window.partitionBy("column"))).withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(F.col("w").desc(), "t")))
    share = lambda x: F.sum(F.when(x, w).otherwise(0)) / F.first("total")
    part = t.where(f"place <= {TOP_TOKENS}").groupBy("column").agg(*(share(F.col("t").isin(xs)).alias(f"lex_{k}_token") for k, xs in lists.items()), (F.sum(w) / F.first("total")).alias("lex_top_k_covered"))
    return whole.join(part, "column", "left")


# The rational approximation of the normal tail by Hart, to double precision.
_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function."""
    x = F.least(F.abs(z), F.lit(37.0))
    poly = lambda cs: reduce(lambda a, c: a * x + c, cs[1:], F.lit(cs[0]))
    far = x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))
    tail = F.exp(-x * x / 2) * F.when(x < 7.07106781186547, poly(_TOP) / poly(_BOTTOM)).otherwise(1 / far / 2.506628274631)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def _gcd(a: Column, b: Column) -> Column:
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), b.alias("b")), step)["a"]


def distribution(values: DataFrame) -> DataFrame:
    """Tail, evenness, step and normality of a column's distinct numbers: ``hill_alpha, gini_coef, granularity, ks_normal, ks_lognormal``.

    Null where fewer than three rows are numbers, and where a measure has too few. One column's distinct numbers are ranked in one task,
    which spills; tables of many rows are meant to be profiled by ``row_sample``.
    """
    s = P.stripped(F.col("v"))
    rows = usable(values).select("column", F.when(s.rlike(NUMBER), s.try_cast("double")).alias("x"), "w").where("x is not null")
    x, w = F.col("x"), F.col("w")
    base = rows.groupBy("column").agg(F.sum("w").alias("rows"), F.count("*").alias("n"), F.count_if(x > 0).alias("np"), (F.sum(x * w) / F.sum(w)).alias("m"), F.min(x).alias("lo"), F.sum(x).alias("total"),
        F.bool_and(x == F.floor(x)).alias("whole"), F.avg(F.when(x > 0, F.log(x))).alias("lm"), F.stddev_samp(F.when(x > 0, F.log(x))).alias("ls"))
    base = base.join(rows.join(base.select("column", "m"), "column").groupBy("column").agg(F.when(F.count_distinct(x) >= 2, F.sqrt(F.sum(F.pow(x - F.col("m"), 2) * w) / F.sum(w))).alias("sd")), "column")
    up = Window.partitionBy("column").orderBy("x")
    j = rows.withColumns({"i": F.row_number().over(up), "down": F.row_number().over(Window.partitionBy("column").orderBy(x.desc()))}).join(base, "column")
    i, n, pos = F.col("i"), F.col("n"), x > 0
    pi = i - (n - F.col("np"))  # the rank among positive numbers: they are the largest
    k = F.greatest(F.lit(10), F.floor(0.1 * F.col("np")))
    gap = lambda r, c, z: F.max(F.greatest(r / c - normal_cdf(z), normal_cdf(z) - (r - 1) / c))
    z, lz = (x - F.col("m")) / F.col("sd"), (F.log(F.when(pos, x)) - F.col("lm")) / F.greatest(F.col("ls"), F.lit(1e-9))
    top = pos & (F.col("down") <= k)
    out = j.groupBy("column").agg(
        F.first("rows").alias("rows"), F.first("np").alias("np"), F.first("n").alias("n"),
        (F.sum(F.when(top, F.log(x))) / F.count_if(top)).alias("top_log"), F.min(F.when(top, F.log(x))).alias("cut_log"),
        F.when((F.first("lo") >= 0) & (F.first("total") > 0), F.sum((2 * i - n - 1) * x) / (F.first("n") * F.first("total"))).alias("gini_coef"),
        F.when(F.first("sd") > 0, gap(i, n, z)).alias("ksn"), gap(F.when(pos, pi), F.col("np"), lz).alias("ksl"),
        F.when(F.first("whole") & (F.first("n") <= 5000), F.collect_list(F.when((x != 0) & (F.col("n") <= 5000), F.abs(x).cast("long")))).alias("steps"),
    )
    made = {
        "hill_alpha": F.when(F.col("np") >= 50, 1 / F.nullif(F.col("top_log") - F.col("cut_log"), F.lit(0.0))),
        "gini_coef": F.col("gini_coef"),
        "granularity": F.when(F.size("steps") > 0, F.aggregate("steps", F.lit(0).cast("long"), _gcd)),
        "ks_normal": F.when(F.col("n") >= 8, F.col("ksn")),
        "ks_lognormal": F.when(F.col("np") >= 8, F.col("ksl")),
    }
    return out.select("column", *(F.when(F.col("rows") >= 3, c).alias(name) for name, c in made.items()))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, over rows that have both; null without spread, where the built-in one divides by zero."""
    both = a.isNotNull() & b.isNotNull()
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)), F.lit(0.0))


def declared(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, in_is_numeric, in_is_factor, in_is_logical, in_is_date`` by the columns' types; a table has no factors."""
    rows = []
    for c in columns or df.columns:
        t = df.schema[c].dataType
        rows.append((c, int(isinstance(t, T.NumericType)), 0, int(isinstance(t, T.BooleanType)), int(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)))))
    return df.sparkSession.createDataFrame(rows, "column string, in_is_numeric int, in_is_factor int, in_is_logical int, in_is_date int")


def ordered(df: DataFrame, column: str, order: str, rows_at_once: int = 200_000) -> DataFrame:
    """The eleven measures of how a column runs along a numeric order: correlation of ranks, runs of equal values, monotony, steps and lag-1 correlation.

    The order is cut into spans of equal width, so many that they hold some ``rows_at_once`` rows each; neighbours are found inside a span, and across
    spans from the spans' edges, which are one row for each. Only values' ranks, of distinct values, go through one task. Null values are no rows of the order; rows that tie
    in it follow in the order of their values. Measures of steps need more than five numbers.
    """
    rows = df.select(F.col(f"`{column}`").cast("string").alias("v"), F.col(f"`{order}`").cast("double").alias("o")).where("v is not null and o is not null")
    lo, hi, count = rows.agg(F.min("o"), F.max("o"), F.count("*")).first()
    spans = max(1, -(-(count or 0) // rows_at_once))
    width = ((hi - lo) / spans if count else 0) or 1.0
    number = F.regexp_replace("v", "[,$ ]", "")
    rows = rows.withColumns({"b": F.least(F.floor((F.col("o") - F.lit(lo or 0.0)) / F.lit(width)), F.lit(spans - 1)), "x": F.when(number.rlike(NUMBER), number.try_cast("double"))})
    inside = Window.partitionBy("b").orderBy("o", "v")

    def lagged(r: DataFrame, c: str) -> DataFrame:
        """Adds ``p``, the value before in the whole order, ``first``, whether there is none, and ``i``, the place."""
        r = r.withColumns({"p": F.lag(c).over(inside), "j": F.row_number().over(inside)})
        edges = r.groupBy("b").agg(F.max_by(c, F.struct("o", "v")).alias("edge"), F.count("*").alias("n"))
        whole = Window.orderBy("b")  # one row for each span
        edges = edges.select("b", F.lag("edge").over(whole).alias("edge"), (F.sum("n").over(whole) - F.col("n")).alias("base"))
        r = r.join(F.broadcast(edges), "b").withColumn("i", F.col("base") + F.col("j"))
        return r.withColumns({"p": F.when(F.col("j") == 1, F.col("edge")).otherwise(F.col("p")), "first": F.col("i") == 1}).drop("edge", "base", "j")

    v = lagged(rows, "v")
    starts = v.withColumn("s", (F.col("first") | (F.col("p") != F.col("v"))).cast("long"))
    per = starts.groupBy("b").agg(F.sum("s").alias("k"))
    per = per.select("b", (F.sum("k").over(Window.orderBy("b")) - F.col("k")).alias("kbase"))
    runs = starts.withColumn("run", F.sum("s").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(per), "b").withColumn("run", F.col("run") + F.col("kbase")).groupBy("run").agg(F.count("*").alias("n"))
    runs = runs.agg((F.sum("n") / F.count("*")).alias("mean_run_length"), F.max("n").alias("max_run_length"), (F.count("*") / F.sum("n")).alias("run_ratio"))
    counts = rows.groupBy("v").agg(F.count("*").alias("n"))
    ranks = counts.select("v", (F.sum("n").over(Window.orderBy("v")) - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
    spearman = v.join(ranks, "v").agg(F.when(F.count("*") >= 5, correlation(F.col("rank").cast("double"), F.col("i").cast("double"))).alias("spearman_index"))
    d = F.col("x") - F.col("p")
    step = lambda ok: F.min(F.when(~F.col("first"), ok.cast("int")))
    steps = lagged(rows.where("x is not null"), "x").agg(
        F.count("*").alias("n"), step(d >= 0).alias("is_monotone_incr"), step(d <= 0).alias("is_monotone_decr"), step(d == 1).alias("is_autoincrement"),
        (F.bool_and(F.col("x") == F.floor("x")) & (F.max("x") - F.min("x") + 1 == F.count_distinct("x"))).cast("int").alias("is_dense_index"),
        (F.count_distinct(F.when(~F.col("first"), d)) == 1).cast("int").alias("diff_constant"), correlation(F.when(~F.col("first"), F.col("p")), F.when(~F.col("first"), F.col("x"))).alias("lag1_autocorr"), F.avg(F.when(~F.col("first"), (d == 0).cast("int"))).alias("pct_diff_zero"),
    )
    names = ["is_monotone_incr", "is_monotone_decr", "is_autoincrement", "is_dense_index", "diff_constant", "lag1_autocorr", "pct_diff_zero"]
    steps = steps.select(*(F.when(F.col("n") > 5, F.col(c)).alias(c) for c in names))
    one = F.lit(1)
    return spearman.withColumn("one", one).join(runs.withColumn("one", one), "one").join(steps.withColumn("one", one), "one").select(F.lit(column).alias("column"), "spearman_index", "mean_run_length", "max_run_length", "run_ratio", *names)


P.BLOCKS.update(divergences=divergences, lexicon=lexicon, distribution=distribution)


def sampled_profile(df: DataFrame, columns: list[str] | None = None, n: int = SAMPLE_ROWS, blocks: list[str] | None = None, seed: int = 1) -> DataFrame:
    """The profile of ``n`` rows of each column, with the core block of all rows: how a wide table is described at a bounded cost."""
    sample = row_sample(df, columns, n, seed)
    frames = [P.BLOCKS["core"](values_frame(df, columns))] + [P.BLOCKS[b](sample) for b in (blocks or P.BLOCKS) if b != "core"]
    return reduce(lambda a, b: a.join(b, "column", "left"), frames)
