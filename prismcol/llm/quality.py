"""Quality rules whose thresholds follow each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, fresh, let, materialise, small, words

#: Measures, in thousandths: what is counted, and of how many; the upper and the lower quantile (per mille) between which the group's
#: spread lies; how many spreads above the upper one are still accepted; and the least distance that is, as so many counts in a
#: document of the group's median length (None: an eighth of the group's median, and values far below the lower quantile are outliers too).
#: Junk may be a quarter of a group without moving quartiles; repetitions are rare and harmless in small numbers, so their tail is what sets their fence.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 750, 250, 4, 10),
    "dup_lines": ("n_dup_lines", "n_lines", 990, 500, 1, 1),
    "repeats": ("n_repeat_words", "n_words", 990, 500, 1, 6),
    "word_length": ("word_chars", "n_words", 750, 250, 4, None),
}
#: A quantile is taken from a group with so many rows beyond it, else from all of the language, else from all rows.
SUPPORT = 20
#: Groups up to which their fences, some 100 bytes each, are broadcast; beyond, they are joined by shuffles.
MOST_GROUPS = 100_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """How many words lie in windows of ``width`` words that the array holds twice or more, the first included.

    Windows are compared by 64-bit hash. Hash and place are packed into one long, so that one sort of primitives
    brings equal windows together; neighbours are then compared by the whole hash.
    """
    one = F.lit(1).cast("long")

    def hashes(ws: Column) -> Column:
        return F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (width - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(ws, i + k) for k in range(1, width))))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(width).cast("long"), F.coalesce(F.get(places, i + 1) - p, F.lit(width).cast("long"))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def found(hs: Column, mask: Column) -> Column:
        packed = F.sort_array(F.transform(hs, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

        def twice(ss: Column) -> Column:
            at = lambda x: F.get(hs, x.bitwiseAND(mask).cast("int"))
            same = lambda x, y: F.coalesce(at(x) == at(y), F.lit(False))
            kept = F.filter(ss, lambda x, i: same(x, F.get(ss, i - 1)) | same(x, F.get(ss, i + 1)))
            return let(F.sort_array(F.transform(kept, lambda x: x.bitwiseAND(mask))), covered)

        return let(packed, twice)

    mask = lambda hs: F.call_function("shiftleft", one, F.length(F.bin(F.size(hs).cast("long")))) - one
    return let(tokens, lambda ws: let(hashes(ws), lambda hs: let(mask(hs), lambda m: found(hs, m))))


def base_counts(text: Column) -> dict[str, Column]:
    """The counts that the rules rest on, each a long, none null; a null text has no words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.regexp_count(text, F.lit(f"{WORD}+")).cast("long"),
        "word_chars": (F.char_length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.regexp_count(text, F.lit(rf"(?m)^[^\n]*?{WORD}")).cast("long"),
        "n_repeat_words": repeated_words(words(text)),
    }


def quality_rules(docs: DataFrame, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Judge each document by base rules and by how far its measures lie outside what its language and source show.

    Adds the base counts, ``base_failed`` and ``kept`` to the columns ``carry`` (default: all). Each group
    of equal language and source (null is a value of its own) gets a log-linear histogram of each measure: values below
    256 have a bucket each, larger ones keep their eight leading bits, so quantiles are at most 1/128 too low. Such
    sketches merge by adding counts, in any order to the same result, and one row for each bucket is all that is shuffled,
    however large a group is. Sketches of groups are merged to those of languages and of all rows, from which groups too small for
    a quantile take theirs. Documents that fail the base rules do not count for the sketches. All fences come from the sketches (MEASURES): a document is
    rejected where symbols, repeated lines or repeated words lie above the upper fence, or its mean word length outside both fences.

    Null, empty and blank texts have no words and fail. Repeated rows count and are judged each. An empty
    table gives none. Columns of the input with the names of results are replaced.
    """
    names = [*base_counts(F.lit("")), "base_failed", "kept"]
    kept_columns = [c for c in (carry or docs.columns) if c.lower() not in names]
    lang, source, fence, *values = fresh(docs, "g_lang", "g_source", "fence", *(f"m_{m}" for m in MEASURES))
    counts = docs.select(*kept_columns, F.col("lang").alias(lang), F.col("source").alias(source), *(v.alias(k) for k, v in base_counts(docs["text"]).items()))
    measure = {m: F.expr(f"1000 * {c} div greatest({of}, 1)") for m, (c, of, *_) in MEASURES.items()}
    counts = materialise(
        counts.withColumns({v: measure[m] for v, m in zip(values, MEASURES, strict=True)}).withColumn(
            "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
        ),
        "quality",
    )
    fences = materialise(thresholds(counts.where(~F.col("base_failed")).select(F.col(lang).alias("l"), F.col(source).alias("s"), "n_words", "n_lines", *(F.col(v).alias(m) for v, m in zip(values, MEASURES, strict=True)))), "fences")
    fences, _ = small(fences.select(F.struct(*fences.columns).alias(fence)), MOST_GROUPS)
    bad = F.lit(False)
    for v, m in zip(values, MEASURES, strict=True):
        bad = bad | F.coalesce(F.col(v) > F.col(f"{fence}.hi_{m}"), F.lit(False))
        if MEASURES[m][-1] is None:
            bad = bad | F.coalesce(F.col(v) < F.col(f"{fence}.lo_{m}"), F.lit(False))
    joined = counts.join(fences, F.col(lang).eqNullSafe(F.col(f"{fence}.l")) & F.col(source).eqNullSafe(F.col(f"{fence}.s")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad).select(*kept_columns, *names)


def thresholds(rows: DataFrame) -> DataFrame:
    """For each group ``l``, ``s`` of ``rows`` (measures, ``n_words``, ``n_lines``): ``hi_<measure>`` and ``lo_<measure>`` from the measures' sketches."""
    lengths = sorted({of for _, of, *_ in MEASURES.values()})
    sketched = [*MEASURES, *lengths]
    v = rows.selectExpr("l", "s", f"stack({len(sketched)}, {', '.join(f"'{m}', {m}" for m in sketched)}) as (measure, v)")
    bits = "length(bin(v)) - 8"
    own = v.groupBy("l", "s", "measure", F.expr(f"case when v < 256 then v else shiftleft(shiftright(v, {bits}), {bits}) end").alias("bucket")).agg(F.count("*").alias("n"))
    own = materialise(own, "sketches")
    upper, lower = (F.lit(500) for _ in range(2))
    for m, (_, _, top, bottom, *_) in MEASURES.items():
        upper, lower = F.when(F.col("measure") == m, F.lit(top)).otherwise(upper), F.when(F.col("measure") == m, F.lit(bottom)).otherwise(lower)

    def quantiles(keys: list[str], level: int) -> DataFrame:
        sketch = own.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        by = Window.partitionBy(*keys, "measure")
        upto = sketch.withColumn("c", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
        at = lambda p: F.min(F.when(1000 * F.col("c") >= p * F.col("total"), F.col("bucket")))
        q = upto.groupBy(*keys, "measure").agg(F.max("total").alias("total"), at(upper).alias("top"), at(lower).alias("bottom"), at(F.lit(500)).alias("mid"))
        enough = F.lit(True) if not keys else F.col("total") * (1000 - upper) >= SUPPORT * 1000
        return q.select(*(F.col(k).alias(f"{k}{level}") for k in keys), F.col("measure").alias(f"measure{level}"), F.when(enough, F.struct("top", "bottom", "mid")).alias(f"q{level}"))

    # As many rows as groups and measures, and fewer; those of languages and of all rows are joined to those of groups.
    q = quantiles(["l", "s"], 0)
    q = q.join(quantiles(["l"], 1), F.col("l0").eqNullSafe(F.col("l1")) & (F.col("measure0") == F.col("measure1"))).join(quantiles([], 2), F.col("measure0") == F.col("measure2"))
    q = q.select(F.col("l0").alias("l"), F.col("s0").alias("s"), F.col("measure0").alias("measure"), F.coalesce("q0", "q1", "q2").alias("q"))
    pick = lambda m: F.max(F.when(F.col("measure") == m, F.col("q"))).alias(m)
    q = q.groupBy("l", "s").agg(*(pick(m) for m in sketched))
    out = []
    for m, (_, of, _, _, fence, least) in MEASURES.items():
        slack = f"{m}.mid div 8" if least is None else f"{1000 * least} div greatest({of}.mid, 1)"
        spread = f"greatest({fence} * ({m}.top - {m}.bottom), {slack})"
        out += [F.expr(f"{m}.top + {spread}").alias(f"hi_{m}"), F.expr(f"{m}.bottom - {spread}").alias(f"lo_{m}")]
    return q.select("l", "s", *out)
