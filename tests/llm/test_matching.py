"""Similarity join, decontamination, licences, line dedup, archives, components, and the pipeline."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from prismcol.llm import jaccard_join
from prismcol.llm.common import materialise
from prismcol.llm.components import connected_components
from prismcol.llm.decontamination import decontaminate
from prismcol.llm.hashing import Words, shingles
from prismcol.llm.jaccard_join import drop_similar, similarity_classes
from prismcol.llm.line_dedup import chunk_ends, dedup_lines, line_hashes
from prismcol.llm.warc import archive_and_read, classify_records, read_warc, write_warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_word_hashes_do_not_depend_on_pieces():
    import prismcol.llm.hashing as h

    text = ("The quick\tBROWN fox é日本 " * 50 + "x" * 300 + " end").encode()
    whole = Words(b" \t\n\x0b\x0c\r").hashes(text)
    old, h.PIECE = h.PIECE, 37
    try:
        parts = Words(b" \t\n\x0b\x0c\r").hashes(text)
    finally:
        h.PIECE = old
    assert (whole == parts).all() and len(whole) == len(text.split()) and len(set(whole.tolist())) == len(set(text.lower().split()))
    assert len(shingles(whole[:2], 4)) == 1 and len(shingles(whole[:0], 4)) == 0


def brute_components(texts, width=4, percent=85):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
                links[a] += 1
                links[b] += 1
    return {d: (len(sets[d]), root(d), links[d]) for d in ids}


def test_similarity_classes(spark, odd, none, monkeypatch):
    rng = random.Random(5)
    base = [[f"v{rng.randrange(3000)}" for _ in range(n)] for n in (4, 5, 20, 60, 150, 150)]
    texts = {}
    for i in range(400):  # many near copies of a few texts, so that shared shingles are frequent, and some unlike any
        w = list(base[i % 6]) if i % 4 else [f"u{rng.randrange(500)}" for _ in range(rng.randrange(1, 90))]
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(40)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    as_rows = lambda x: {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in similarity_classes(x).collect()}
    want = brute_components(texts)
    assert as_rows(df) == want
    for hot in (2, 10_000):  # all shared shingles by stars, and none
        monkeypatch.setattr(jaccard_join, "HOT", hot)
        assert as_rows(df) == want
    monkeypatch.setattr(jaccard_join, "BLOCK", 2000)  # components of many blocks
    assert as_rows(df) == want
    named = df.select(F.format_string("d%04d", "doc_id").alias("doc_id"), "text")
    assert as_rows(named) == {f"d{d:04d}": (n, f"d{c:04d}", k) for d, (n, c, k) in want.items()}
    assert {r["doc_id"] for r in drop_similar(df).collect()} == {c for _, c, _ in want.values()}
    rows = similarity_classes(odd).collect()
    assert len(rows) == 10 and {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] in (2, 3, 4, 6, 8)} == {(2, 0, 2), (3, 0, 3), (4, 0, 4), (6, 1, 6), (8, 9, 7)}
    assert similarity_classes(none).count() == 0 and drop_similar(none).count() == 0 and len(drop_similar(odd).collect()) == 8


def test_drop_similar_goes_by_rows(spark):
    rng = random.Random(8)
    text = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4)]
    near = text[0].rsplit(" ", 1)[0] + " other"
    rows = [(5, text[0], "a"), (None, text[0], "b"), (7, near, "c"), (5, text[1], "d"), (None, text[2], "e"), (None, text[2] + " x", "f"), (None, None, "g"), (None, "", "h"), (1, "", "i"), (9, text[3], "j"), (9, text[3], "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string")
    out = sorted(r["rid"] for r in drop_similar(df).collect())
    assert out in (["a", "d", "e", "g", "h", "i", "j"], ["a", "d", "f", "g", "h", "i", "j"])
    assert sorted(r["rid"] for r in drop_similar(df.repartition(3)).collect()) == out and drop_similar(df).columns == df.columns


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5000, 5000), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(200)) and 5000 not in got
    assert all(got[a] == got[b] for a, b in chain[260:-2] if a != b)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, odd, none):
    item = " ".join(f"t{i}" for i in range(20))
    items = spark.createDataFrame([("10", item), ("9", "Short ITEM"), ("8", None), ("7", "?!"), ("6", item)], "item_id string, text string")
    filler = " ".join(f"f{i}" for i in range(100))
    docs = spark.createDataFrame([(1, f"{filler} {item.upper()}"), (2, filler), (3, "a short, item! É"), (4, None), (5, " ".join(item.split()[:12])), (6, f"{filler} " * 9 + "short item"), (7, "ſhort item")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate(docs, items).collect()}
    sha = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"], got[1]["items_sha256"], got[1]["contaminated"]) == (120, 20, 2, sha("10", "6"), True)
    assert (got[2]["n_hit"], got[2]["items_sha256"]) == (0, sha()) and (got[3]["n_words"], got[3]["n_hit"], got[3]["contaminated"]) == (4, 2, True)
    assert got[4]["n_words"] == 0 and not got[4]["contaminated"] and got[5]["n_hit"] == 0 and got[6]["n_hit"] == 2 and not got[6]["contaminated"] and got[7]["n_hit"] == 0
    assert decontaminate(none, items).count() == 0 and decontaminate(docs, items.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert len(decontaminate(odd, items).collect()) == 10


def test_line_dedup(spark, odd, none):
    rng = random.Random(4)
    passage = [f"shared line {i} of many" for i in range(12)]
    texts = {i: "\n".join([f"own {i} {rng.random()}" for _ in range(rng.randrange(1, 9))] + (passage if i % 3 else []) + [f"tail {i} {rng.random()}" for _ in range(4)]) for i in range(60)}
    seen, want = set(), {}
    for i, t in texts.items():
        lines, start, kept = t.encode().split(b"\n"), 0, []
        full = [x + b"\n" for x in lines[:-1]] + lines[-1:]
        for end in chunk_ends(line_hashes(lines)):
            b = b"".join(full[start:end])
            if end - start < 2 or b.removesuffix(b"\n") not in seen:
                kept.append(b)
            if end - start >= 2:
                seen.add(b.removesuffix(b"\n"))
            start = end
        want[i] = b"".join(kept).decode()
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i: r["text"] for i, r in got.items()} == want and sum(r["removed_lines"] for r in got.values()) > 200
    out = {r["doc_id"]: r for r in dedup_lines(odd).collect()}
    assert len(dedup_lines(odd).collect()) == 10 and out[2]["text"] is None and out[3]["text"] == "" and out[7]["removed_lines"] == 0 and out[8]["removed_lines"] >= 4 and out[4]["text"] == " \n\t "
    assert dedup_lines(none).count() == 0


def test_warc(spark, tmp_path):
    big = "<html>" + "é" * 90_000
    rows = [(1, "http://a", big, 0), (2, "http://b?x=\"1\"\\", big, 0), (3, None, None, 0), (4, "http://c", "", 0), (5, "http://d", "small", 0), (6, "http://e", "small", 0), (7, "http://f", big + "!", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = {int(r["page_id"]): r for r in archive_and_read(pages).collect()}
    assert got[1]["record_type"] == "revisit" and got[1]["refers_to"] == "2" and got[1]["payload"] is None and got[1]["payload_bytes"] == len(big.encode())
    assert all(bytes(got[i]["payload"]).decode() == (h or "") and got[i]["url"] == u for i, u, h, _ in rows if i != 1)
    assert all(r["payload_digest"] == hashlib.sha1((h or "").encode()).hexdigest() for (_, _, h, _), r in zip(rows, (got[i] for i in range(1, 8))))
    path = f"file://{tmp_path}/w"
    write_warc(pages, path)
    some = read_warc(spark, path, payload=False).where((F.col("record_type") == "response") & (F.col("url") == "http://f"))
    assert [(r["page_id"], r["payload"], r["payload_bytes"]) for r in some.collect()] == [("7", None, len(big.encode()) + 1)]
    assert archive_and_read(pages.limit(0)).count() == 0
    # A second write to the folder adds to the first.
    write_warc(spark.createDataFrame([(8, "http://h", "more")], "page_id long, url string, html string"), path)
    assert sorted(r["page_id"] for r in read_warc(spark, path).collect()) == [str(i) for i in range(1, 9)]
    plan = read_warc(spark, path, payload=False).where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan warc" in plan and "record_type#" in plan and " = revisit" not in plan


def test_warc_revisits_by_shuffle(spark):
    rows = [(i, "u", "x" * 2000 + str(i % 3)) for i in range(60)] + [(None, "n", "x" * 2000 + "0")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (200_000, 0):
        got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in classify_records(pages, most=most).collect()}
        assert got == {None if i is None else str(i): ("response", None) if i is not None and i >= 57 else ("revisit", str(57 + (0 if i is None else i % 3))) for i, _, _ in rows}


def test_warc_of_others(spark, tmp_path):
    """Plain and packed archives without a manifest or lengths of members, other record types, and HTTP headers of any length."""
    import gzip

    http = b"HTTP/1.1 200 OK\r\n" + b"".join(b"X-%d: %s\r\n" % (i, b"v" * 900) for i in range(90)) + b"\r\n"
    body = b"<html>" + bytes(range(256)) * 700
    record = lambda kind, block, more=b"": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:uuid:1>\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    typed = b"Content-Type: application/http; msgtype=response\r\nWARC-Target-URI: http://x\r\n"
    records = [record(b"warcinfo", b"software: x\r\n"), record(b"response", http + body, typed), record(b"request", b"GET / HTTP/1.1\r\n\r\n"), record(b"revisit", http, typed)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    for payload in (True, False):
        rows = read_warc(spark, f"file://{tmp_path}", payload).collect()
        assert sorted(r["record_type"] for r in rows) == sorted(["warcinfo", "response", "request", "revisit"] * 2)
        for r in rows:
            if r["record_type"] == "response":
                assert r["payload_bytes"] == len(body) and r["url"] == "http://x" and (bytes(r["payload"]) == body if payload else r["payload"] is None)
            if r["record_type"] == "warcinfo" and payload:
                assert bytes(r["payload"]) == b"software: x\r\n"


def test_materialise_survives_its_source(spark):
    assert materialise(spark.range(5), "t").count() == 5


def test_pipeline(spark, documents):
    import corpus_pipeline

    counts, docs = [], documents
    for _, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert set(documents.columns) <= set(out.columns)
        counts.append(out.count())
        docs = out
    assert counts[0] <= documents.count() and counts[2] <= counts[1] <= counts[0] and counts[4] == counts[3] > 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == counts[4]
