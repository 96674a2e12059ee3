"""Shards against a loop over the sorted rows."""

import random
import zlib

from prismcol.llm.queries import op1_sharding
from prismcol.llm.sharding import shard_by_bytes


def brute(rows, n_shards):
    """``{key: (shard, slot)}`` of rows ``(key, size)`` in order."""
    total, before, next_slot, out = sum(s for _, s in rows), 0, {}, {}
    for key, size in sorted(rows):
        shard = min(n_shards - 1, (2 * before + size) * n_shards // (2 * total)) if total else 0
        out[key] = (shard, next_slot.get(shard, 0))
        next_slot[shard] = next_slot.get(shard, 0) + 1
        before += size
    return out


def test_shards_against_a_loop(spark):
    rng = random.Random(3)
    for sizes in ([rng.randrange(1, 500) for _ in range(700)], [1] * 5, [0] * 9, [10**6] + [1] * 50):
        rows = list(enumerate(sizes))
        got = {r["k"]: (r["shard"], r["slot"]) for r in shard_by_bytes(spark.createDataFrame(rows, "k long, size long"), 7, order=("k",)).collect()}
        assert got == brute(rows, 7)


def test_query_keeps_equal_texts_together(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", *(f"text {rng.randrange(60)} " * rng.randrange(1, 4) for _ in range(500))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in op1_sharding(spark, str(tmp_path)).collect()}
    assert all((r["size"], r["text_crc32"]) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t, r in ((texts[d], r) for d, r in rows.items()))
    by_text = {}
    for d, t in enumerate(texts):
        by_text.setdefault(t or "", set()).add(rows[d]["shard"])
    assert all(max(s) - min(s) <= 1 or len(s) == max(s) - min(s) + 1 for s in by_text.values()) and sum(len(s) > 1 for s in by_text.values()) <= 39
