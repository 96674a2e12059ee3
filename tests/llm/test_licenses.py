"""Licence notices: retrieval against a search of all windows, recall, wordings, and what is no notice."""

import random

from prismcol.llm.hashing import Words, shingles
from prismcol.llm.license_scan import BREAKS, NOTICES, SHORT, STEP, Templates, _clearest, notices_of, scan_licenses


def found(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in scan_licenses(docs, **more).collect():
        out.setdefault(r["doc_id"], {})[r["license"]] = (r["contained"], r["first_word"], r["n_words"])
    return [out.get(i, {}) for i in range(len(texts))]


def brute(texts, notices, percent=80, width=5):
    """Each window of each document against each notice, by sets of words."""
    words = Words(BREAKS)
    split = lambda t: words.hashes(t.encode())
    out = []
    for text in texts:
        s, best = shingles(split(text), width).tolist(), {}
        for name in notices:
            for notice in notices[name]:
                ws = split(notice)
                want = set(shingles(ws, width).tolist())
                step = STEP
                while step < len(want):
                    step *= 2
                for lo in range(0, len(s), step):
                    window = s[lo : lo + 2 * step]
                    score = len(want & set(window)) * 1000 // len(want)
                    if score >= (1000 if len(want) < SHORT else 10 * percent):
                        first = lo + next(i for i, x in enumerate(window) if x in want)
                        got = (-score, first, -len(ws))
                        best[0, name] = min(best.get((0, name), got), got)
        out.append({name: x for (_, name), x in _clearest({k: (-a, b, -c) for k, (a, b, c) in best.items()}).items()})
    return out


def test_against_all_windows(spark):
    rng = random.Random(6)
    some = {k: NOTICES[k][:3] + NOTICES[k][-2:] for k in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "CC-BY-4.0", "CC-BY-SA-3.0", "Zlib")}
    every = [x for xs in some.values() for x in xs]
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            notice = rng.choice(every).split()
            for _ in range(rng.choice([0, 0, 1, 2, len(notice) // 12, len(notice) // 5])):  # some near, some too far
                notice[rng.randrange(len(notice))] = f"z{rng.randrange(50)}"
            parts += [f"f{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 60))] + notice[: rng.choice([len(notice)] * 3 + [len(notice) * 9 // 10])]
        texts.append(" ".join(parts))
    got, want = found(spark, texts, notices=some), brute(texts, some)
    hits = sum(map(len, want))
    assert hits > 120 and sum(len(w) == 0 for w in want) > 20
    missed = sum(1 for g, w in zip(got, want, strict=True) for k in w if k not in g)
    assert missed <= 1 and all(g == w for g, w in zip(got, want, strict=True) if set(g) == set(w)) and sum(g != w for g, w in zip(got, want, strict=True)) <= missed
    assert found(spark, texts[::-1], notices=some)[::-1] == got  # whatever documents stand beside


def test_each_notice_is_found(spark):
    t = Templates(NOTICES)
    assert len(NOTICES) >= 40 and min(t.chance(k) for k in range(len(t.names))) > 0.999
    filler = " ".join(f"f{i}" for i in range(37))
    cases = [(name, x) for name, xs in NOTICES.items() for x in xs]
    got = found(spark, [f"{filler} {x}\n{filler}" for _, x in cases])
    assert sum(name in g for g, (name, _) in zip(got, cases, strict=True)) == len(cases)


def test_wordings_and_what_is_no_notice(spark):
    texts = {
        "see LICENSE. Licensed under the MIT license, as is": {"MIT"},
        "code released under the GNU General Public License v3.0 and docs": {"GPL-3.0"},
        "This project is licensed under the GNU Lesser General Public License, version 2.1.": {"LGPL-2.1"},
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": {"CC-BY-SA-3.0"},
        "released under the GNU General Public License of any version": set(),
        "This work is licensed under the terms of a contract with the publisher": set(),
        "permission to use this software is not granted to any person": set(),
        "Redistribution in any form is forbidden": set(),
    }
    got = found(spark, list(texts))
    assert [set(g) for g in got] == list(texts.values())
    r = found(spark, ["word " * 9 + "Released under the MIT License."])[0]
    assert r == {"MIT": (1000, 9, 5)}


def test_odd_input(spark, odd, none, tmp_path):
    assert scan_licenses(odd).count() == 0 and scan_licenses(none).count() == 0
    (tmp_path / "Own-1.0.txt").write_text("all of this text may be used by those who own a blue bicycle")
    (tmp_path / "Own-1.0.2.txt").write_text("whoever owns a blue bicycle may use this")
    assert {k: len(v) for k, v in notices_of(str(tmp_path)).items()} == {"Own-1.0": 2}
    assert found(spark, ["x whoever owns a blue bicycle may use this y"], notices=notices_of(str(tmp_path)))[0] == {"Own-1.0": (1000, 1, 8)}
