"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise, small

WEIGHTS = (5, 2, 1)
MIX_PERCENT, MOST_REPEATS = 150, 2
BLOCK = 4096  # words
CHUNK = 1 << 16  # slots that are ranked together
BUCKET_BITS = 12  # of the shuffle key: parts of a source whose running totals are taken apart
#: Points of slots, as whole numbers below 2^32: slot i has i * GOLDEN modulo 2^32. GOLDEN / 2^32 is one less the fractional part of
#: the golden ratio, whose multiples modulo 1 are spread more evenly than any other's; whole numbers are exact for any number of slots.
POINTS = 1 << 32
GOLDEN = 1640531527
CELL_BITS = 12  # the points are cut into so many cells, by which slots find their sources
#: Spans of sources, cut at cells, up to which they are broadcast (some 50 bytes each); beyond, slots are shuffled by cell.
BROADCAST_ROWS = 200_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """From rows ``source, size``: a row for each source with ``source_size``, ``weight``, ``target`` (words).

    Weights follow the sources in code-point order, null last. Together the targets are MIX_PERCENT of all
    words; none is above MOST_REPEATS times its source's, and the excess is shared by weight among the rest: sources
    are taken by rising cap for each unit of weight, and those stay at their cap whose cap is below the level that
    the remaining words and weights give. As many rows as sources go through one task.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("long")).withColumn("cap", MOST_REPEATS * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("budget", F.sum("source_size").over(whole) * (MIX_PERCENT / 100)).withColumn(
        "level", (F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    )
    # The first source whose cap is above its level sets the level for itself and all that follow.
    by = by.withColumn("set", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"])
    return by.select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap").cast("double"), F.col("set") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def block_plan(targets: DataFrame, block: int) -> DataFrame:
    """Adds ``words`` (the target, rounded), ``blocks`` in one pass over the source, and ``slots`` that its target takes."""
    return targets.where("source_size > 0").selectExpr(
        "source", "source_size", "target", "cast(round(target) as long) as words", f"(source_size + {block - 1}) div {block} as blocks",
    ).withColumn("slots", F.expr(f"words div source_size * blocks + (words % source_size + {block - 1}) div {block}"))


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as slots: ``slot, source, rank`` (the slot's place among its source's), then ``pass``, ``block``, ``from``, ``to``.

    A slot is given to the source whose span of the cumulated shares holds the slot's point (POINTS, GOLDEN). Any
    stretch of slots then holds each source close to its share. A source's slots beyond its number are left out,
    and the few that it still lacks at the end follow, so each target is met to the word. Slots are ranked
    inside chunks, and running totals of the chunks' counts place them; the largest source is spread over all chunks.
    ``from`` and ``to`` bound the words that the slot takes of the source's shuffled stream.
    """
    spark = plan.sparkSession
    order = Window.orderBy(F.col("source").asc_nulls_last())
    shares = plan.select("*", (F.row_number().over(order) - 1).alias("k"), F.sum("slots").over(order).alias("upto"))  # as many rows as sources
    n = shares.agg(F.max("upto")).first()[0] or 0
    point = lambda c: F.floor(F.col(c) / F.lit(max(n, 1)) * F.lit(float(POINTS))).cast("long")
    spans = shares.withColumn("before", F.col("upto") - F.col("slots")).select("k", "slots", point("before").alias("lo"), point("upto").alias("hi")).where("hi > lo")
    cell = 32 - CELL_BITS
    # A slot's point lies in one cell, and a cell in few spans: no slot meets more than those.
    cells, _ = small(spans.withColumn("cell", F.explode(F.expr(f"sequence(shiftright(lo, {cell}), shiftright(hi - 1, {cell}))"))).drop("slots"), BROADCAST_ROWS)
    slots = spark.range(n).withColumn("u", F.expr(f"(id % {POINTS}) * {GOLDEN} % {POINTS}")).withColumn("cell", F.expr(f"shiftright(u, {cell})"))
    slots = slots.join(cells, "cell").where("lo <= u and u < hi").select("id", "k", F.expr(f"id div {CHUNK}").alias("chunk"))
    counts = slots.groupBy("k", "chunk").agg(F.count("*").alias("c"))
    base = counts.select("k", "chunk", (F.sum("c").over(Window.partitionBy("k").orderBy("chunk")) - F.col("c")).alias("base"))
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("chunk", "k").orderBy("id")) - 1).join(base, ["k", "chunk"]).select("k", F.col("id").alias("slot"), (F.col("base") + F.col("r")).alias("rank"))
    given = counts.groupBy("k").agg(F.sum("c").alias("given"))
    short = shares.join(given, "k", "left").where("slots > coalesce(given, 0)").select("k", F.explode(F.sequence(F.coalesce("given", F.lit(0)), F.col("slots") - 1)).alias("rank"))
    ranked = ranked.unionByName(short.select("k", (F.lit(n) + F.col("rank")).alias("slot"), "rank"))
    known, _ = small(shares.drop("upto"), BROADCAST_ROWS)
    return ranked.join(known, "k").where("rank < slots").selectExpr(
        "slot", "source", "rank", "rank div blocks as pass", "rank % blocks as block",
        f"rank % blocks * {block} as from", f"least((rank % blocks + 1) * {block}, source_size, words - rank div blocks * source_size) as to",
    )


def stream(sizes: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Adds to rows ``doc_id, source, size`` their place ``start`` in their source's shuffled stream of words.

    The shuffle order is that of the MD5 of seed and document id. Its first bits cut each source into buckets of nearly
    equal counts; running totals of the buckets' sizes, then inside each bucket, give the place, so
    no source has to pass through one task.
    """
    rows = sizes.withColumn("mixed", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("bucket", F.conv(F.substring("mixed", 1, BUCKET_BITS // 4), 16, 10).cast("int"))
    by = rows.groupBy("source", "bucket").agg(F.sum("size").alias("b"))
    before = by.select(F.col("source").alias("s"), F.col("bucket").alias("k"), (F.sum("b").over(Window.partitionBy("source").orderBy("bucket")) - F.col("b")).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("mixed", "size", *[c for c in ("th", "rid") if c in sizes.columns]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(before, rows["source"].eqNullSafe(before["s"]) & (rows["bucket"] == before["k"]))
    return rows.select(*sizes.columns, (F.col("before") + F.col("inside")).alias("start"))


def mix_taken(docs: DataFrame, seed: str = "mix", block: int = BLOCK) -> DataFrame:
    """How many words of each document the mix takes, and from where in it on: ``doc_id, size, source_size, target, taken, first_slot, last_slot``.

    Each source's documents are shuffled and strung together, the string is cut into blocks of ``block`` words,
    and each slot of the schedule takes the block of its rank; after the last block the source starts again. A
    block's edge may lie inside a document. A source's taken words are its rounded target, and no document is taken more than
    MOST_REPEATS times. ``first_slot`` and ``last_slot`` are those of the schedule's slots that take words of the document, null where none does. Nothing
    depends on partitions, so reruns agree.

    Null and empty texts have size 0 and are never taken. A null source is a source of its own. Repeated rows are documents
    of their own. An empty table gives no rows.
    """
    sizes = materialise(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"{WORD}+")).cast("long").alias("size")), "mix")
    targets = materialise(source_targets(sizes), "mix-targets")
    plan = block_plan(targets, block)
    placed = stream(sizes, targets, seed)
    parts = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    slots = schedule(plan, block).select(F.col("source").alias("s"), F.col("block").alias("k"), "slot", "from", "to")
    met = parts.join(slots, parts["source"].eqNullSafe(slots["s"]) & (parts["block"] == slots["k"]), "left")
    words = F.greatest(F.lit(0), F.least(F.col("to"), F.col("start") + F.col("size")) - F.greatest("from", "start"))
    words = F.when(F.col("to").isNotNull(), words).otherwise(0)  # least and greatest pass over nulls: a block without a slot would count whole
    used = F.when(words > 0, F.col("slot"))
    taken = met.groupBy("doc_id", "source", "size", "start").agg(F.sum(words).alias("taken"), F.min(used).alias("first_slot"), F.max(used).alias("last_slot")).drop("start")
    never = F.lit(None).cast("long")
    taken = taken.unionByName(sizes.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_slot": never, "last_slot": never}))
    known = targets.select(F.col("source").alias("s"), "source_size", "target")
    return taken.join(known, taken["source"].eqNullSafe(known["s"])).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def mix_documents(docs: DataFrame, seed: str = "mix", block: int = BLOCK) -> DataFrame:
    """The mix as whole documents, in the order of the schedule: each row of ``docs`` as often as slots take its first word, range-partitioned and sorted by those slots.

    So a source's words differ from its target by less than a document, a document comes MOST_REPEATS times at most, and any stretch of the
    rows holds the sources close to their shares. Inside a slot documents have the order of their source's shuffled stream. The rows keep their
    columns. Documents without a word are never taken; else as in ``mix_taken``.
    """
    (rid,) = fresh(docs, "rid")
    stored = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "mix")
    sizes = stored.select(F.col(rid).alias("rid"), F.xxhash64("text").alias("th"), "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"{WORD}+")).cast("long").alias("size"))
    targets = materialise(source_targets(sizes), "mix-targets")
    first = stream(sizes, targets, seed).where("size > 0").withColumn("block", F.expr(f"start div {block}"))
    slots = schedule(block_plan(targets, block), block).select(F.col("source").alias("s"), F.col("block").alias("k"), "slot", "from", "to")
    met = first.join(slots, first["source"].eqNullSafe(slots["s"]) & (first["block"] == slots["k"])).where("from <= start and start < to")
    slot, start = fresh(stored, "slot", "start")
    taken = stored.join(met.select(F.col("rid").alias(rid), F.col("slot").alias(slot), F.col("start").alias(start)), rid)
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(slot), F.col(start), F.col(rid)]
    return taken.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*docs.columns)
