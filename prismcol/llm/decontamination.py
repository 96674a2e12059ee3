"""Benchmark decontamination by exact containment of item-sized windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh, let, materialise, small

#: Words are runs of digits, ASCII letters and characters beyond ASCII; what breaks them is named one by one, as Java tests a set of
#: single characters by a table and ranges one after the other.
_BREAKS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
BREAK, WORD = f"[{_BREAKS}]+", f"[^{_BREAKS}]+"
WINDOW = 13
SHINGLE = 5
#: Rows of the benchmark's shingles or windows up to which they are broadcast (some 50 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def _words(text: Column, lower: bool = True) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER) if lower else text, BREAK), "")


def _shingles(ws: Column, width: int) -> Column:
    return F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (width - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(ws, i + k) for k in range(1, width))) if width > 1 else F.xxhash64(w))


def _shingles_of(ws: Column, width: int) -> Column:
    return let(ws, lambda x: _shingles(x, width))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The windows of all items, a row for each that an item has: ``wid``, ``wtext`` (words joined by a space), ``len``, ``width`` (of its shingles), ``shingles``, ``item``."""
    ws = benchmark.select(F.col("item_id").cast("string").alias("item"), _words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    n = F.size("ws")
    each = ws.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1))))).withColumn("w", F.slice("ws", F.col("at"), F.least(n, F.lit(window))))
    out = each.select("item", "w", F.array_join("w", " ").alias("wtext")).dropDuplicates(["item", "wtext"])
    out = out.withColumn("len", F.size("w")).withColumn("width", F.least("len", F.lit(shingle))).withColumn("wid", F.xxhash64("wtext"))
    sets = F.lit(None).cast("array<bigint>")
    for k in range(1, shingle + 1):
        sets = F.when(F.col("width") == k, _shingles_of(F.col("w"), k)).otherwise(sets)
    return materialise(out.select("wid", "wtext", "len", "width", sets.alias("shingles"), "item"), "windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, percent: int = 5) -> DataFrame:
    """Mark the words of each document that lie in an occurrence of a window of a benchmark item.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Adds ``n_words``, ``n_hit``, ``n_items``,
    ``items_sha256`` (of the item ids, as sorted strings joined by commas) and ``contaminated`` (``percent`` of the
    words or more are hit). One pass over the corpus keeps the places at which it has a shingle of any window. Their counts order each
    window's shingles by rarity. As a window must be contained whole, its rarest shingle is a sufficient prefix: places of other
    shingles are dropped, and each place left gives one start, which must leave room for the whole window on either side
    (bounds on position and length). What remains is compared word by word.

    Null, empty and wordless texts have no words and are clean; so are all documents where the benchmark is empty. Null and
    wordless items have no window. Repeated rows are judged each. Columns of ``docs`` stay, but
    for those with the names of results, which are replaced.
    """
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in names])
    kind = docs.schema["doc_id"].dataType.simpleString()
    owned = benchmark_windows(benchmark, window, shingle)
    windows = owned.drop("item").dropDuplicates(["wtext"])
    key, d, t, hits, items = fresh(docs, "text_key", "d", "t", "hits", "items")
    # Only A-Z is folded, as in windows: lower() would fold a sigma by what stands around its word.
    keyed = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("x"))
    widths = [r[0] for r in windows.select("width").distinct().collect()]  # at most as many as a shingle has words
    tokens = windows.select("wid", "len", "width", F.posexplode("shingles").alias("offset", "h"))
    vocabulary, _ = small(tokens.select("h", "width").distinct(), BROADCAST_ROWS)
    places = docs.sparkSession.createDataFrame([], f"d {kind}, t long, n int, place int, h long, width int")
    for k in widths:
        hashed = keyed.select("d", "t", _shingles_of(F.array_remove(F.split("x", BREAK), ""), k).alias("hs"))
        at = hashed.select("d", "t", F.size("hs").alias("n"), F.posexplode("hs").alias("place", "h"))
        met = at.join(vocabulary.where(F.col("width") == k).select("h"), "h").withColumn("n", F.col("n") + (k - 1)).withColumn("width", F.lit(k))
        places = places.unionByName(met)
    places = materialise(places, "places")
    rarity = places.groupBy("h", "width").agg(F.count("*").alias("df"))
    prefix = tokens.join(rarity, ["h", "width"], "left").groupBy("wid", "len", "width").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("rarest"))
    prefix, _ = small(prefix.where("rarest.df > 0").select("wid", "len", "width", F.col("rarest.h").alias("h"), F.col("rarest.offset").alias("offset")), BROADCAST_ROWS)
    starts = places.join(prefix, ["h", "width"]).withColumn("start", F.col("place") - F.col("offset")).where("start >= 0 and start + len <= n")
    starts = materialise(starts.select("d", "t", "wid", "start", "len").distinct(), "starts")
    # Texts of documents with a candidate only; keys are broadcast where they are few.
    wanted, _ = small(starts.select("d", "t").distinct(), BROADCAST_ROWS)
    texts = docs.select("doc_id", F.xxhash64("text").alias("tt"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tt") == F.col("t")), "left_semi")
    texts = texts.dropDuplicates(["doc_id", "tt"])
    wtexts, _ = small(windows.select("wid", "wtext"), BROADCAST_ROWS)
    candidates = starts.join(wtexts, "wid").groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("start", "len", "wtext"))).alias("found"))
    exact = let(_words(F.col("text")), lambda ws: F.filter("found", lambda c: F.array_join(F.slice(ws, c["start"] + 1, c["len"]), " ") == c["wtext"]))

    def hit(cs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

        def step(acc: Column, c: Column) -> Column:
            end = c["start"] + c["len"]
            return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["upto"], c["start"]))).alias("n"))

        return F.aggregate(cs, zero, step)["n"]

    verified = texts.join(candidates, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tt") == F.col("t"))).select("d", "t", exact.alias("found"))
    verified = materialise(verified.select("d", "t", hit(F.col("found")).alias(hits), F.array_distinct("found.wtext").alias("met")).where(F.col(hits) > 0), "verified")
    # Each document's distinct windows, then their items.
    owners, _ = small(owned.select("wtext", "item"), BROADCAST_ROWS)
    met = verified.select("d", "t", F.explode("met").alias("wtext")).join(owners, "wtext").select("d", "t", "item").distinct()
    met = met.groupBy("d", "t").agg(F.array_sort(F.collect_list("item")).alias(items))
    judged = verified.select(F.col("d").alias(d), F.col("t").alias(t), hits).join(met.select(F.col("d").alias(f"{d}_2"), F.col("t").alias(f"{t}_2"), items), F.col(d).eqNullSafe(F.col(f"{d}_2")) & (F.col(t) == F.col(f"{t}_2"))).select(d, t, hits, items)
    judged, _ = small(materialise(judged, "judged"), BROADCAST_ROWS // 10)
    rows = docs.withColumns({key: F.xxhash64("text"), "n_words": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")})
    joined = rows.join(judged, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(key) == F.col(t)), "left")
    joined = joined.withColumns({"n_hit": F.coalesce(hits, F.lit(0).cast("long")), items: F.coalesce(items, F.array().cast("array<string>"))})
    return joined.select(
        *docs.columns, "n_words", "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
    )
