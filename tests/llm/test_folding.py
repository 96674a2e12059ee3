"""Documents and benchmark items are folded alike, and hits are those of brute force."""

import hashlib
import random
import re

import pytest

from prismcol.llm import decontamination
from prismcol.llm.decontamination import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(texts, items, window=13):
    split = lambda t: WORD.findall((t or "").translate(FOLD))
    windows = {}
    for item, text in items:
        ws = split(text)
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            windows.setdefault(tuple(ws[i : i + window]), set()).add(item)
    out = {}
    for d, text in texts:
        ws, hit, found = split(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(ws[i : i + n])]
        out[d] = (len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws))
    return out


def rows(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


def test_decontamination_folds_words_alike(spark):
    items = [("1", "ΟΔΟΣ ΑΒΓ one two three"), ("2", "Α.Σ. four"), ("3", "ΛΟΓΟΣ ΑΒΓ ΔΕΖ ΗΘΙ ΚΛΜ"), ("4", "İstanbul Kelvin É five six")]
    texts = [(1, "x ΟΔΟΣ.ΑΒΓ ONE two three y"), (2, "Α.Σ.four"), (3, "οδος αβγ one two three"), (4, "ΛΟΓΟΣ.ΑΒΓ.ΔΕΖ.ΗΘΙ.ΚΛΜ"), (5, "ΛΟΓΟΣ-ΑΒΓ:ΔΕΖ'ΗΘΙ ΚΛΜ"), (6, "İSTANBUL! KELVIN, É Five SIX"), (7, "i̇stanbul kelvin é five six")]
    got = rows(decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")))
    assert got == brute(texts, items) and [got[k][1] for k in (1, 2, 4, 5, 6, 7)] == [5, 3, 5, 5, 5, 0]


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontamination_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
    rng = random.Random(most)
    word = lambda: rng.choice(["a", "B", "c", "Σ", "d1", "é"])
    items = [(str(i), " ".join(word() for _ in range(rng.choice([0, 1, 2, 4, 12, 13, 14, 20])))) for i in range(12)] + [("same", "a B c Σ d1"), ("same2", "A b C Σ D1"), ("none", None)]
    texts = [(i, " . ".join(rng.choice([word(), rng.choice(items)[1] or "", f"f{rng.randrange(99)}"]) for _ in range(rng.randrange(30)))) for i in range(150)] + [(1000, None), (1001, ""), (1002, "?!")]
    got = rows(decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")))
    assert got == brute(texts, items)


def test_ids_of_any_type_and_an_empty_benchmark(spark):
    docs = spark.createDataFrame([("x", "one two"), (None, "one two three"), ("x", "one two"), ("y", None)], "doc_id string, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted(r["n_words"] for r in decontaminate(docs, none).collect()) == [0, 2, 2, 3] and decontaminate(docs, none).where("contaminated or n_hit > 0").count() == 0
    some = decontaminate(docs, spark.createDataFrame([(4, "ONE two")], "item_id long, text string")).collect()
    assert sorted((r["n_words"], r["n_hit"], r["n_items"]) for r in some) == [(0, 0, 0), (2, 2, 1), (2, 2, 1), (3, 2, 1)]
