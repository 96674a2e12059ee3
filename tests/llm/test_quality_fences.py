"""Fences follow the groups' own measures, and small groups borrow."""

import random

from prismcol.llm.quality import SUPPORT, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string"


def document(rng, symbols, words=100):
    ws = [f"word{rng.randrange(10**7)}" for _ in range(words)]
    for i in range(symbols):
        ws[i % words] += "#"
    return " ".join(ws)


def test_fences_follow_their_group(spark):
    rng = random.Random(1)
    n = 8 * SUPPORT
    rows = [(i, document(rng, 0), "en", "prose") for i in range(n)] + [(1000 + i, document(rng, 10 + i % 60), "en", "code") for i in range(n)]
    probes = [(9000, document(rng, 90), "en", "prose"), (9001, document(rng, 90), "en", "code"), (9002, document(rng, 400), "en", "code"), (9003, document(rng, 90), "en", "few"), (9004, document(rng, 0), None, None)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows + probes, SCHEMA)).select("doc_id", "kept").collect()}
    # The same document is junk among prose and usual among code; far outside both it is junk; the small source borrows its language's fence.
    assert not kept[9000] and kept[9001] and not kept[9002] and kept[9003] and kept[9004]
    assert all(kept[i] for i in [*range(n), *range(1000, 1000 + n)])
    # With the code group moved down, its fence moves down too.
    rows = [r if r[3] == "prose" else (r[0], document(rng, 0), "en", "code") for r in rows]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows + probes, SCHEMA)).select("doc_id", "kept").collect()}
    assert not kept[9000] and not kept[9001] and not kept[9002] and not kept[9003] and kept[9004]


def test_few_junk_rows_of_a_small_group_do_not_set_its_fence(spark):
    rng = random.Random(2)
    rows = [(i, document(rng, 0), "en", "big") for i in range(8 * SUPPORT)] + [(5000 + i, document(rng, 300), "en", "small") for i in range(6)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "kept").collect()}
    assert not any(kept[5000 + i] for i in range(6)) and all(kept[i] for i in range(8 * SUPPORT))
