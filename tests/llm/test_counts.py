"""Shards, quality rules, mixing, token counts and token output."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismcol.llm import byte_level
from prismcol.llm.mixing import mix_documents, mix_taken, source_targets
from prismcol.llm.quality import quality_rules, repeated_words
from prismcol.llm.sharding import shard_by_bytes
from prismcol.llm.token_count import PairCounter, token_counts
from prismcol.llm.token_output import encode_and_read, read_tokens, token_checksums, token_index, write_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_shards(spark, odd, none):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 17 + 1).alias("size"))
    got = sorted(shard_by_bytes(rows, 7).collect(), key=lambda r: r["doc_id"])
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    for k in range(7):
        mine = [r for r in got if r["shard"] == k]
        assert [r["slot"] for r in mine] == list(range(len(mine))) and abs(sum(r["size"] for r in mine) - sum(r["size"] for r in got) / 7) <= 17
    sized = odd.withColumn("size", F.octet_length("text") + 16)
    out = shard_by_bytes(sized, 3).collect()
    assert len(out) == 10 and sorted(r["slot"] for r in out if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in out)))
    assert shard_by_bytes(none.withColumn("size", F.lit(1)), 3).count() == 0
    hot = spark.range(900).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(1).alias("size"))
    assert [r["count"] for r in shard_by_bytes(hot, 3).groupBy("shard").count().collect()] == [300] * 3


def test_repeated_words(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in range(40)] + [" ".join(rng.choice("abcdefghij") for _ in range(3000)), ""]
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "i int, ws array<string>")
    got = {r[0]: r[1] for r in df.select("i", repeated_words(F.col("ws"))).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        want = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in (k, k + 1, k + 2)} if len(w) < 100 else None
        assert want is None or got[i] == len(want)


def test_quality(spark, odd, none):
    out = {r["doc_id"]: r for r in quality_rules(odd).collect()}
    assert len(quality_rules(odd).collect()) == 10 and out[2]["n_words"] == 0 and out[2]["base_failed"] and not out[3]["kept"] and out[5]["n_words"] == 60_000 and out[5]["base_failed"]
    assert quality_rules(none).count() == 0
    clean = [(i, " ".join(f"word{random.Random(i * 1000 + k).randrange(10**6)}" for k in range(80)), "en", "s", 1) for i in range(60)]
    junk = [(99, " ".join(f"w{k}$$$" for k in range(80)), "en", "s", 1)]
    kept = {r["doc_id"] for r in quality_rules(spark.createDataFrame(clean + junk, none.schema)).where("kept").collect()}
    assert kept == set(range(60))


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 100), ("z", 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(sizes).collect()}
    assert got["a"] == 20 and got["z"] == 0 and abs(sum(got.values()) - 1.5 * 2110) < 1e-6 and all(t <= 2 * s + 1e-9 for t, s in ((got["b"], 1000), (got["c"], 1000), (got[None], 100)))


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_mix(spark, documents, odd, none, block):
    out = mix_taken(documents, block=block).toPandas()
    assert (out.taken <= 2 * out["size"]).all() and len(out) == documents.count()
    by = out.merge(documents.select("doc_id", "source").toPandas()).groupby("source").agg(taken=("taken", "sum"), target=("target", "max"))
    assert (abs(by.taken - by.target) <= 0.5).all()
    if block == 64:
        again = mix_taken(documents.repartition(5), block=block).toPandas()
        assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
        assert len(mix_taken(odd).collect()) == 10 and mix_taken(none).count() == 0 and mix_documents(none).count() == 0
        whole = mix_documents(odd)
        assert whole.columns == odd.columns and all(r["count"] <= 4 for r in whole.groupBy("doc_id").count().collect())


def test_pair_counter_agrees_with_library():
    counter, library = PairCounter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    texts = ["", " ", "  a", "a  ", "\n", " \n b", "<s> </s> <unk>", "日本語 テスト", "naïve café\u0000x", "a\tb\r\nc", "▁x ▁▁ y", "🎉" * 9, "the " * 500]
    texts += ["".join(rng.choice("abcdeé ▁\n\t<s>.,日🎉0") for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert [counter.count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_token_counts(odd, none):
    rows = token_counts(odd, MODEL).collect()
    assert len(rows) == 10 and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0} and any(r["over_limit"] for r in rows)
    assert token_counts(none, MODEL).count() == 0


def test_token_output(documents, odd, none):
    args = public_tokenizers.path("byte_bpe_50k.json"), 0
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    spark = documents.sparkSession
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(["<|endoftext|> a", "<|endoftext|><|endoftext|>", "x" * 300 + " <|endoftext|", "a \x1c b\u00a0 c\u2003\n\u0085d e", "a<|endoftext|>", "  x \n\n y  ", "日本🎉", "don't we'LL 12345", "\u0000\u001f", "\u0558\u088f a\u0c5cb", ""])], "doc_id long, text string")
    stored = encode_and_read(documents.select("doc_id", "text").unionByName(extra), *args)
    start = 0
    sums = {r["doc_id"]: r for r in token_checksums(stored).collect()}
    index = {r["doc_id"]: r for r in token_index(stored).collect()}
    for r in sorted(stored.collect(), key=lambda r: r["doc_id"]):
        assert sums[r["doc_id"]]["start"] == index[r["doc_id"]]["start"] == start
        assert sums[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(r["tokens"], "<u4").tobytes())
        assert sums[r["doc_id"]]["n_tokens"] == index[r["doc_id"]]["n_tokens"] == len(r["tokens"])
        start += len(r["tokens"])
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").unionByName(extra).collect()}
    assert all(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0] == r["tokens"] for r in stored.collect())
    rows = token_checksums(encode_and_read(odd, *args)).collect()
    assert len(rows) == 10 and min(r["n_tokens"] for r in rows) == 1 and token_checksums(encode_and_read(none, *args)).count() == 0
    named = documents.select(F.concat(F.lit("id"), F.col("doc_id")).alias("doc_id"), "text").limit(20)
    by_id = sorted(token_checksums(encode_and_read(named, *args)).collect(), key=lambda r: r["doc_id"])
    assert [r["start"] for r in by_id] == [sum(x["n_tokens"] for x in by_id[:i]) for i in range(20)]


def test_rows_of_one_id_fill_several_parts_in_order(spark):
    rows = [(7, f"text {i}") for i in range(200)] + [(7, "text 3")] * 50 + [(1, "a"), (9, "b")]
    stored = encode_and_read(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    assert stored.where("doc_id = 7").select("part").distinct().count() > 1
    got = sorted(token_checksums(stored).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [1] + [7] * 250 + [9] and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))


def test_token_files_allow_selective_reads(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("the of and cat dog house").strip() + str(rng.randrange(99)) for _ in range(400))) for i in range(3000)], "doc_id long, text string")
    path = str(tmp_path / "tokens")
    write_tokens(docs, f"file://{path}", public_tokenizers.path("byte_bpe_50k.json"), 0)
    files = sorted(tmp_path.glob("tokens/part-*.parquet"))
    assert len(files) == 4
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema.split(".")[0]: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert any("DICTIONARY" in e or e.startswith("DELTA") for e in columns["tokens"].encodings)
            assert all(c.has_column_index and c.has_offset_index for c in columns.values()) and columns["doc_id"].statistics.has_min_max
            assert meta.row_group(g).total_byte_size <= 17 << 20
    some = read_tokens(spark, f"file://{path}").where("doc_id between 1500 and 1510").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,1500)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan
    assert [r["doc_id"] for r in some.orderBy("doc_id").collect()] == list(range(1500, 1511))


def test_encoder_agrees_with_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    classes = byte_level.character_classes(path)
    encoder, rng = byte_level.ByteLevelEncoder(path, classes), random.Random(5)
    alphabet = [*" \n\t\r\x1c\x1f\x85\xa0\u2003\u3000'sat1.,-<|>éя日🎉_\u0558\u088f\u0301\u200b²Ⅷ", "  ", "<|endoftext|>", "<|endof", "text|>", "'re", "'ll", "'ve", "'d", "'s", " the", " cat", " a b"]
    any_of = lambda: chr(rng.choice([x for x in (rng.randrange(0x110000), rng.randrange(0x3000)) if not 0xD800 <= x < 0xE000] or [65]))
    old = byte_level.AT_ONCE
    for at_once in (old, 12):
        byte_level.AT_ONCE = at_once
        try:
            for i in range(1500):
                texts = ["".join(any_of() if i % 3 == 0 else rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 6))]
                ids, counts = encoder.batch([memoryview(t.encode()) for t in texts], 0)
                want = [encoder.library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
                assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]
        finally:
            byte_level.AT_ONCE = old


def test_store_may_be_as_small_as_it_likes(documents, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(byte_level, "SLOT_BITS", 4)
    encoder = byte_level.ByteLevelEncoder(path, byte_level.character_classes(path))
    for r in documents.limit(40).collect():
        assert encoder.batch([memoryview((r["text"] or "").encode())], None)[0].tolist() == encoder.library.encode(r["text"] or "", add_special_tokens=False).ids


def test_other_tokenizers_are_given_whole_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert byte_level.character_classes(path) is None
    stored = encode_and_read(spark.createDataFrame([(1, "Some words"), (2, None)], "doc_id long, text string"), path, 7)
    assert {r["doc_id"]: r["tokens"] for r in stored.collect()} == {1: Tokenizer.from_file(path).encode("Some words", add_special_tokens=False).ids + [7], 2: [7]}
