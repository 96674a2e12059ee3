"""More profile blocks against plain Python."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from prismcol.operators import profile as P
from prismcol.operators import profile_more as M
from prismcol.sources.values import values_frame


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def close(a, b, tol=1e-9):
    return a is None and b is None or a is not None and b is not None and abs(a - b) <= tol * max(1, abs(b))


def test_normal_distribution(spark):
    zs = [i / 7 for i in range(-260, 261)]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", M.normal_cdf(F.col("z"))).collect()
    assert all(close(r[1], phi(r[0]), 1e-12) for r in got)


def test_distribution(spark):
    rng = random.Random(1)
    columns = {"a": [round(rng.lognormvariate(2, 1), 3) for _ in range(300)], "b": [6 * rng.randrange(-20, 90) for _ in range(300)], "c": [rng.gauss(0, 1) for _ in range(300)], "d": [7.0] * 300, "e": [12 * rng.randrange(1, 50) for _ in range(300)]}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} {'long' if c in 'be' else 'double'}" for c in columns))
    got = {r["column"]: r for r in M.distribution(values_frame(df)).collect()}
    for c, xs in columns.items():
        counts = Counter(xs)
        v = sorted(counts)
        n, w = len(v), sum(counts.values())
        m = sum(x * k for x, k in counts.items()) / w
        sd = math.sqrt(sum(k * (x - m) ** 2 for x, k in counts.items()) / w) if n > 1 else None
        pos = [x for x in v if x > 0]
        ks = lambda zs: max(max((i + 1) / len(zs) - phi(z), phi(z) - i / len(zs)) for i, z in enumerate(zs))
        k = max(10, len(pos) // 10)
        hill = None
        if len(pos) >= 50:
            top = sorted(pos, reverse=True)[:k]
            hill = 1 / (sum(math.log(x / top[-1]) for x in top) / k)
        gini = sum((2 * (i + 1) - n - 1) * x for i, x in enumerate(v)) / (n * sum(v)) if v[0] >= 0 and sum(v) > 0 else None
        logs = [math.log(x) for x in pos]
        lm = sum(logs) / len(logs) if logs else 0
        ls = math.sqrt(sum((x - lm) ** 2 for x in logs) / (len(logs) - 1)) if len(logs) > 1 else 0
        whole = all(float(x).is_integer() for x in v)
        r = got[c]
        assert close(r["gini_coef"], gini) and close(r["hill_alpha"], hill), c
        assert close(r["ks_normal"], ks([(x - m) / sd for x in v]) if n >= 8 else None), c
        assert close(r["ks_lognormal"], ks([(x - lm) / max(ls, 1e-9) for x in logs]) if len(pos) >= 8 else None), c
        assert r["granularity"] == (math.gcd(*(int(abs(x)) for x in v if x)) if whole else None), c


def test_divergences(spark):
    texts = ["The quick brown fox", "jumps over", "a lazy dog 12-3456789", "99-1234567", "07-1234567", "071234567", "the the the fox"] * 3 + ["12", "3456"]
    values = values_frame(spark.createDataFrame([(t,) for t in texts], "t string"))
    r = M.divergences(values).first()
    letters = Counter(c for t in texts for c in t.lower() if c.isalpha())
    digits = Counter(c for t in texts for c in t if c.isdigit())
    p = {c: k / sum(letters.values()) for c, k in letters.items()}
    assert close(r["ltr_kl_english"], sum(x * math.log(x / M.ENGLISH[ord(c) - 97]) for c, x in p.items()))
    assert close(r["dig_uniform_chi2"], sum((digits.get(str(d), 0) / sum(digits.values()) - 0.1) ** 2 / 0.1 for d in range(10)))
    assert r["n_distinct_chars"] == len(set("".join(texts))) and close(r["alphabet_closure"], len(letters) / 26) and close(r["chk_ein_prefix_rate"], 1 / 3)
    import numpy as np
    import re

    counts = sorted(Counter(t for x in texts for t in re.sub("[^A-Za-z0-9' ]", " ", x).lower().split()).values(), reverse=True)
    assert close(r["tok_zipf_slope"], float(np.polyfit(np.log(range(1, len(counts) + 1)), np.log(counts), 1)[0]))


def test_lexicon_block(spark):
    texts = ["Mary", "mary smith", "New York", "Dr Smith", "yes", "March", "12 Main St"]
    r = M.lexicon(values_frame(spark.createDataFrame([(t,) for t in texts], "t string"))).first()
    assert len(r.asDict()) == 31 and close(r["lex_first_name_value"], 1 / 7) and close(r["lex_us_state_name_value"], 1 / 7) and close(r["lex_month_name_token"], 1 / 12) and close(r["lex_last_name_token"], 2 / 12) and close(r["lex_any_value"], 4 / 7) and r["lex_top_k_covered"] == 1


def test_order_of_rows(spark):
    rng = random.Random(2)
    for xs in ([rng.choice([1, 1, 2, 3, 10]) for _ in range(500)], list(range(10, 200)), [5] * 40, [rng.random() for _ in range(100)], [3, 1]):
        rows = list(enumerate(xs))
        rng.shuffle(rows)
        df = spark.createDataFrame([(i, float(x)) for i, x in rows], "i long, x double").withColumn("x", F.col("x").cast("string"))
        got = [M.ordered(df, "x", "i", n).first() for n in (10**6, 37)]
        assert all(close(a, b) if isinstance(a, float) else a == b for a, b in zip(*got))
        r, ds = got[0], [b - a for a, b in zip(xs, xs[1:])]
        runs, k = [], 1
        for a, b in zip(xs, xs[1:]):
            if a != b:
                runs.append(k)
                k = 0
            k += 1
        runs.append(k)
        assert close(r["mean_run_length"], sum(runs) / len(runs)) and r["max_run_length"] == max(runs) and close(r["run_ratio"], len(runs) / len(xs))
        if len(xs) > 5:
            assert r["is_monotone_incr"] == int(all(d >= 0 for d in ds)) and r["is_autoincrement"] == int(all(d == 1 for d in ds)) and close(r["pct_diff_zero"], sum(d == 0 for d in ds) / len(ds)) and r["is_dense_index"] == int(all(float(x).is_integer() for x in xs) and max(xs) - min(xs) + 1 == len(set(xs)))
        else:
            assert r["is_monotone_incr"] is None


def test_declared_and_samples(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("string").alias("s"), (F.col("id") > 5).alias("b"), F.current_date().alias("d"))
    assert {r["column"]: tuple(r)[1:] for r in M.declared(df).collect()} == {"id": (1, 0, 0, 0), "s": (0, 0, 0, 0), "b": (0, 0, 1, 0), "d": (0, 0, 0, 1)}
    a, b = (sorted(M.row_sample(x, ["id", "s"]).collect()) for x in (df, df.repartition(5)))
    assert a == b and sum(r["w"] for r in a if r["column"] == "id") == 500 and sum(r["w"] for r in a if r["column"] == "s") == 500
    out = M.sampled_profile(df, ["id", "s"], 100, ["core", "length", "distribution"])
    assert {r["column"]: r["n_usable"] for r in out.collect()} == {"id": 3000, "s": 3000} and "gini_coef" in out.columns
    from prismcol.operators import profile_ends  # noqa: F401

    assert set(P.BLOCKS) >= {"lexicon", "divergences", "distribution", "moments"}
