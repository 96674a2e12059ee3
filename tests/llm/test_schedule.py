"""The schedule of sources: every stretch of slots is close to the shares, and what is taken follows it."""

from pyspark.sql import functions as F

from prismcol.llm import mixing
from prismcol.llm.mixing import block_plan, mix_documents, mix_taken, schedule, source_targets

BLOCK = 16


def plan_of(spark, sizes):
    return block_plan(source_targets(spark.createDataFrame(sizes, "source string, size long")), BLOCK)


def brute_schedule(plan):
    """``{slot: (source, rank)}`` by a loop over the slots."""
    rows = sorted(plan.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    n, upto, spans, given, out = sum(r["slots"] for r in rows), 0, [], {}, {}
    for r in rows:
        lo, upto = upto, upto + r["slots"]
        spans.append((int(lo / n * mixing.POINTS), int(upto / n * mixing.POINTS), r["source"], r["slots"]))
    for i in range(n):
        u = i * mixing.GOLDEN % mixing.POINTS
        source, slots = next((s, k) for lo, hi, s, k in spans if lo <= u < hi)
        rank = given.get(source, 0)
        given[source] = rank + 1
        if rank < slots:
            out[i] = (source, rank)
    for _, _, source, slots in spans:
        out |= {n + rank: (source, rank) for rank in range(given.get(source, 0), slots)}
    return out


def test_schedule_against_a_loop(spark, monkeypatch):
    plan = plan_of(spark, [("a", 5000), ("b", 40), ("c", 9000), (None, 700), ("e", 3)] + [(f"s{i}", 50 + i) for i in range(40)])
    want = brute_schedule(plan)
    for most in (200_000, 0):  # the spans broadcast, and shuffled
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", most)
        got = {r["slot"]: (r["source"], r["rank"]) for r in schedule(plan, BLOCK).collect()}
        assert got == want


def test_every_stretch_is_close_to_the_shares(spark):
    plan = plan_of(spark, [("a", 50_000), ("b", 30_000), ("c", 20_000), ("d", 4_000)])
    slots = {r["source"]: r["slots"] for r in plan.collect()}
    n = sum(slots.values())
    order = [r["source"] for r in schedule(plan, BLOCK).where(f"slot < {n}").orderBy("slot").collect()]
    for source, k in slots.items():
        seen, worst = 0, 0.0
        for i, s in enumerate(order):
            seen += s == source
            worst = max(worst, abs(seen - (i + 1) * k / n))
        assert worst < 4, (source, worst)  # a random order would stray by tens of slots


def test_result_follows_the_points(spark, documents, monkeypatch):
    def slots():
        return {r["doc_id"]: (r["first_slot"], r["last_slot"]) for r in mix_taken(documents, block=64).collect()}

    real = slots()
    assert slots() == real
    monkeypatch.setattr(mixing, "GOLDEN", 0)
    assert slots() != real
    monkeypatch.setattr(mixing, "GOLDEN", 1 << 31)
    assert slots() != real


def test_mixed_documents_come_in_slot_order(spark):
    rows = [(i, " ".join(["w"] * 10), "abc"[i % 3], "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(7)
    out = [(r["doc_id"], r["source"]) for r in mix_documents(docs, block=50).collect()]  # partitions in order
    assert out == [(r["doc_id"], r["source"]) for r in mix_documents(docs.repartition(3), block=50).collect()]
    shares = {s: sum(x == s for _, x in out) / len(out) for s in "abc"}
    for at in range(0, len(out) - 100, 100):
        stretch = [s for _, s in out[at : at + 100]]
        assert all(abs(stretch.count(s) - 100 * shares[s]) <= 25 for s in "abc")
    twice = spark.createDataFrame([(1, "a b c", "s", "en"), (1, "a b d", "s", "en")], docs.schema)
    assert mix_documents(twice).groupBy("text").agg(F.count("*").alias("n")).where("n > 2").count() == 0
