"""What the pipeline's stages do beyond the queries of the same operators."""

import corpus_pipeline


def test_pipeline_drops_near_copies_of_five_words(spark):
    words = [f"w{i}" for i in range(100)]
    near = [f"z{i}" if i in (25, 75) else w for i, w in enumerate(words)]
    sets = lambda ws, k: {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
    share = lambda k: len(sets(words, k) & sets(near, k)) / len(sets(words, k) | sets(near, k))
    assert share(5) >= 0.8 and share(4) < 0.85
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "something else of some words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}


def as_tables(con, docs, benchmark=None):
    con.register("documents", docs)
    if benchmark is not None:
        con.register("benchmark", benchmark)
    return con


def test_each_stage_against_brute_force(spark, documents):
    """Each stage on what the one before kept: SQL for the rules and the benchmark, sets of words for near copies, the schedule's slots for the mix, a loop for the shards."""
    import duckdb
    from test_folding import brute as contamination
    from test_matching import brute_components
    from test_shards import brute as shards

    from prismcol.llm import oracles
    from prismcol.llm.mixing import mix_taken

    sf_dir, stages = "/root/testdata/sf0.001", dict(corpus_pipeline.STAGES)
    docs = documents.toPandas()

    def run(name):
        return stages[name](spark, spark.createDataFrame(docs, documents.schema), sf_dir).toPandas()

    kept = set(as_tables(duckdb.connect(), docs).execute(f"select doc_id from ({oracles.quality()}) where kept").df().doc_id)
    out = run("quality rules")
    assert set(out.doc_id) == kept and 0 < len(out) < len(docs) and list(out.columns) == documents.columns
    docs = out
    components = brute_components(dict(zip(docs.doc_id, docs.text, strict=True)), 5, 80)
    out = run("n-gram Jaccard join")
    assert sorted(out.doc_id) == sorted({c for _, c, _ in components.values()}) and len(out) < len(docs)
    docs = out
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    bad = contamination(list(zip(docs.doc_id, docs.text, strict=True)), [(str(r["item_id"]), r["text"]) for r in items])
    out = run("benchmark decontamination")
    assert sorted(out.doc_id) == sorted(d for d, x in bad.items() if not x[4]) and len(out) < len(docs)
    docs = out
    out = run("mixing sources to target weights")
    size = lambda t: len((t or "").split())
    taken = mix_taken(spark.createDataFrame(docs, documents.schema)).toPandas().set_index("doc_id")
    copies = out.groupby("doc_id").size()
    assert all(copies.get(d, 0) <= 2 for d in docs.doc_id) and set(out.doc_id) <= set(taken.index[taken.taken > 0])
    by = {s: (g.target.iloc[0], g["size"].max()) for s, g in taken.join(docs.set_index("doc_id").source).groupby("source")}
    for s, g in out.groupby("source"):
        assert abs(sum(map(size, g.text)) - by[s][0]) <= by[s][1] + 1
    docs = out
    import hashlib

    out = run("sharding")
    order = [(hashlib.md5((t or "").encode()).hexdigest(), d) for d, t in zip(docs.doc_id, docs.text, strict=True)]
    ranks = [((*k, i), len((t or "").encode()) + 16) for i, (k, t) in enumerate(zip(order, docs.text, strict=True))]
    want = sorted((d, *x) for (_, d, _), x in shards(ranks, corpus_pipeline.N_SHARDS).items())
    assert sorted(zip(out.doc_id, out.shard, out.slot, strict=True)) == want


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        rows = out.collect()
        assert set(odd.columns) <= set(out.columns) and len(rows) <= 2 * odd.count(), name
        assert all(r["chunks"] == r["gone"] == "clash" for r in rows), name
        assert stage(spark, none, "/root/testdata/sf0.001").collect() == []
