import math

import numpy as np
import pytest

from prismcol.operators import profile_ends as E
from prismcol.sources.values import values_frame

WORDS = ["Anna Bell", "anna bell", "Otto's 12 Bells", "x1;y2;z3", "a;b;c", "", "  p  q ", "Anna Bell", "7", None]


def shares(xs):
    _, n = np.unique(xs, return_counts=True)
    return n / n.sum()


def entropy(xs):
    return -(shares(xs) * np.log(shares(xs))).sum()


@pytest.fixture(scope="module")
def words(spark):
    return values_frame(spark.createDataFrame([(w,) for w in WORDS], "c string"))


def row(df):
    return df.collect()[0].asDict()


def test_letters(words):
    import re

    kept = [w for w in WORDS if w]
    toks = [t for w in kept for t in re.sub("[^A-Za-z ]", " ", w).lower().split()]
    got = row(E.letters(words))
    assert got["first_a"] == pytest.approx(sum(t[0] == "a" for t in toks) / len(toks)) and got["last_l"] == pytest.approx(sum(t[-1] == "l" for t in toks) / len(toks))
    assert got["suffix2_n_distinct"] == len({t[-2:] for t in toks}) and got["suffix2_entropy"] == pytest.approx(entropy([t[-2:] for t in toks])) and got["first_entropy"] == pytest.approx(entropy([t[0] for t in toks]))


def test_token_ends(words):
    import re

    toks = [t for w in WORDS if w and (t := re.sub("[^A-Za-z0-9' ]", " ", w).lower().split())]
    got = row(E.token_ends(words))
    assert got["first_tok_top_share"] == pytest.approx(max(shares([t[0] for t in toks]))) and got["last_tok_entropy"] == pytest.approx(entropy([t[-1] for t in toks]))
    assert got["last_tok_closed"] == 1 and got["tokmask_n_unique"] == len({" ".join("9" if x.isdigit() else "a" if x.isalpha() else "x" for x in t) for t in toks})


def test_moments(spark):
    xs = [float(k * k % 97) for k in range(1, 200)] + [0.5, -3.0]
    got = row(E.moments(values_frame(spark.createDataFrame([(str(x),) for x in xs], "c string"))))
    x = np.array(xs)
    z = (x - x.mean()) / x.std()
    assert got["skewness"] == pytest.approx((z**3).mean()) and got["kurtosis"] == pytest.approx((z**4).mean() - 3)
    lead = [int(f"{v:.0e}"[0]) for v in xs if v > 0]
    assert got["benford_chi2"] == pytest.approx(sum((lead.count(d) / len(lead) - math.log10(1 + 1 / d)) ** 2 / math.log10(1 + 1 / d) for d in range(1, 10)))
    assert row(E.moments(values_frame(spark.createDataFrame([("1",), ("2",)], "c string"))))["skewness"] is None


def test_shapes(spark):
    xs = ["a;b", "c;d", "ee;f", "g;hhh"]
    got = row(E.shapes(values_frame(spark.createDataFrame([(x,) for x in xs], "c string"))))
    n = np.array([len(x) for x in xs])
    assert got["delim_const_semi"] == 1 and got["delim_nfld_semi"] == 2 and got["delim_const_comma"] == 0 and got["len_cv"] == pytest.approx(n.std() / n.mean()) and got["len_entropy"] == pytest.approx(entropy(n))
