"""Licence notices in documents: retrieved by MinHash bands, verified by exact containment."""

from __future__ import annotations

import pathlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import Words, shingles, utf8

#: Everything in ASCII but letters and digits ends a word.
BREAKS = bytes(b for b in range(128) if not chr(b).isalnum())
WIDTH, PERCENT = 5, 80
BANDS = 64  # of one row each
STEP = 4  # shingles between windows of the shortest kind
#: A notice of fewer shingles has to be there whole: one that lacks its last shingle would be the notice of another version, or of none.
SHORT = 10
SIEVE = 1 << 16  # places of a table that most windows' values do not pass
PIECE = 1 << 18  # shingles that are scanned together

#: Public licence texts and notices by SPDX identifier. Placeholders for names and years are left out of texts.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_0 = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ZERO_BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"
_ZLIB = (
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
    "for any purpose, commercial or non-commercial, and by any means."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, "
    "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
)
_WTFPL = "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"
_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {} which accompanies this distribution, and is available at"
_GNU = {  # identifier: the licence's name in notices, its short name, and its versions
    "GPL": ("GNU General Public License", "GNU GPL", ("1", "2", "3")),
    "LGPL": ("GNU Lesser General Public License", "GNU LGPL", ("2.1", "3")),
    "AGPL": ("GNU Affero General Public License", "GNU AGPL", ("3",)),
}
_CREATIVE = {  # identifier: the licence's name
    "BY": "Attribution",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
}


def _usual(name: str) -> list[str]:
    """How texts say that they are under a licence of this name."""
    return [f"Released under the {name}", f"Licensed under the {name}", f"This work is licensed under the {name}", f"This project is licensed under the {name}", f"Distributed under the terms of the {name}"]


def public_notices() -> dict[str, list[str]]:
    """The notices that are looked for by default."""
    out = {
        "0BSD": [_ZERO_BSD, *_usual("Zero-Clause BSD License")],
        "Apache-2.0": [_APACHE, *_usual("Apache License, Version 2.0"), *_usual("Apache License 2.0"), *_usual("Apache 2.0 License")],
        "BSD-2-Clause": [_BSD_2, *_usual("BSD 2-Clause License"), *_usual("Simplified BSD License")],
        "BSD-3-Clause": [f"{_BSD_2} {_BSD_3}", f"{_BSD_2} 3. {_BSD_3}", *_usual("BSD 3-Clause License"), *_usual("BSD License"), *_usual("New BSD License")],
        "BSL-1.0": [_BOOST, "Distributed under the Boost Software License, Version 1.0", *_usual("Boost Software License, Version 1.0")],
        "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "This work is dedicated to the public domain under CC0 1.0 Universal", *_usual("CC0 1.0 Universal Public Domain Dedication")],
        "EPL-1.0": [_EPL.format("v1.0"), *_usual("Eclipse Public License v1.0"), *_usual("Eclipse Public License 1.0")],
        "EPL-2.0": [_EPL.format("2.0"), *_usual("Eclipse Public License v2.0"), *_usual("Eclipse Public License 2.0")],
        "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation", *_usual("GNU Free Documentation License 1.3")],
        "ISC": [_ISC, *_usual("ISC License")],
        "MIT": [_MIT, f"{_MIT} {_AS_IS}", *_usual("MIT License")],
        "MIT-0": [_MIT_0, *_usual("MIT No Attribution License")],
        "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.", *_usual("Mozilla Public License 1.1")],
        "MPL-2.0": [_MPL, *_usual("Mozilla Public License 2.0"), *_usual("Mozilla Public License, Version 2.0")],
        "Unlicense": [_UNLICENSE],
        "WTFPL": [_WTFPL, *_usual("Do What The Fuck You Want To Public License")],
        "Zlib": [_ZLIB, *_usual("zlib License")],
    }
    for code, (name, short, versions) in _GNU.items():
        for v in versions:
            spoken = [f"{name}, version {v}", f"{name} version {v}", f"{name} v{v}", f"{name} {v}", f"{short} v{v}", f"{short} version {v}"]
            spoken += [f"{x}.0" for x in spoken] if "." not in v else []
            terms = f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version"
            out[f"{code}-{v}" if "." in v else f"{code}-{v}.0"] = [f"This program is free software: {terms}", f"This library is free software; {terms}", f"This program is free software; {terms}", *(x for n in spoken for x in _usual(n))]
    for code, name in _CREATIVE.items():
        for v in ("2.0", "3.0", "4.0"):
            full = f"Creative Commons {name} {v}"
            kinds = [f"{full} International License", f"{full} License"] if v == "4.0" else [f"{full} Unported License", f"{full} License"]
            out[f"CC-{code}-{v}"] = [f"This work is licensed under a {k}" for k in kinds] + [f"Licensed under CC {code} {v}", f"Released under CC {code} {v}", f"This work is licensed under CC {code} {v}", f"under a {full} license"]
    return out


NOTICES = public_notices()


def notices_of(folder: str) -> dict[str, list[str]]:
    """Notices from a local folder that has a file of text for each, named by identifier: ``MIT.txt``, or ``MIT.2.txt`` for a second one."""
    out: dict[str, list[str]] = {}
    for path in sorted(pathlib.Path(folder).glob("*.txt")):
        name = re.sub(r"\.\d+$", "", path.stem) if re.search(r"[A-Za-z].*\.\d+$", path.stem) and path.with_name(re.sub(r"\.\d+$", "", path.stem) + ".txt").exists() else path.stem
        out.setdefault(name, []).append(path.read_text(encoding="utf-8"))
    return out


def _clearest(found: dict[tuple[int, str], tuple[int, int, int]]) -> dict[tuple[int, str], tuple[int, int, int]]:
    """Without a document's matches that overlap one of another licence that is contained to a larger share, or that lie in a longer one that is contained to the same."""
    out: dict[tuple[int, str], tuple[int, int, int]] = {}
    spans: dict[int, list[tuple[int, int, int]]] = {}
    for (doc, name), (score, first, n) in sorted(found.items(), key=lambda x: (x[0][0], -x[1][0], -x[1][2], x[0][1])):
        covered = any(first < b and a < first + n and score < other or a <= first and first + n <= b and n < b - a for a, b, other in spans.get(doc, []))
        if not covered:
            out[doc, name] = (score, first, n)
            spans.setdefault(doc, []).append((first, first + n, score))
    return out


class Templates:
    """Notices as shingle sets in classes of length, with their MinHash values.

    A class holds notices of up to L shingles, L = 4, 8, 16 and so on (so more than L / 2, but for the first class); its windows have
    2 L shingles and start at each L-th, so an occurrence of a notice lies whole in one of them. A notice of m shingles in a window of 2 L has a
    Jaccard coefficient j of m / 2 L or more: with BANDS single-row bands it is missed with a probability
    of (1 - j)^BANDS, which ``chance`` gives.
    """

    def __init__(self, notices: dict[str, list[str]], width: int = WIDTH) -> None:
        words = Words(BREAKS)
        self.width = width
        rng = np.random.default_rng(7)
        self.a = rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
        self.names, self.sets, self.lengths = [], [], []
        for name in sorted(notices):
            for text in notices[name]:
                ws = words.hashes(text.encode())
                if len(ws):
                    self.names.append(name)
                    self.lengths.append(len(ws))
                    self.sets.append(np.unique(shingles(ws, width)))
        self.classes: dict[int, list[int]] = {}
        for t in range(len(self.names)):
            level = 0
            while STEP << level < len(self.sets[t]):
                level += 1
            self.classes.setdefault(level, []).append(t)
        self.bands: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, list[list[int]]]] = {}
        for level, ts in self.classes.items():
            for p in range(BANDS):
                holders: dict[int, list[int]] = {}
                for t in ts:
                    holders.setdefault(int(self._permuted(self.sets[t], p).min()), []).append(t)
                values = np.array(sorted(holders), np.uint64)
                sieve = np.zeros(SIEVE, bool)
                sieve[values & np.uint64(SIEVE - 1)] = True
                self.bands[level, p] = sieve, values, [holders[int(v)] for v in values]

    def _permuted(self, x: np.ndarray, p: int) -> np.ndarray:
        return x * self.a[p] + self.b[p]

    def chance(self, t: int) -> float:
        """The probability that notice ``t`` is retrieved where it stands."""
        level = next(k for k, ts in self.classes.items() if t in ts)
        j = len(self.sets[t]) / max(len(self.sets[t]), 2 * (STEP << level))
        return 1 - (1 - j) ** BANDS

    def needed(self, t: int, percent: int) -> int:
        """The share of notice ``t`` that has to be contained, in thousandths."""
        return 1000 if len(self.sets[t]) < SHORT else 10 * percent

    def scan(self, docs: list[np.ndarray], percent: int) -> dict[tuple[int, str], tuple[int, int, int]]:
        """For each document (its shingles) and licence that is found: ``(per mille contained, first word, the notice's words)`` of the best window, the first of equals.

        Documents are laid one after the other, each filled up to a multiple of the longest step with its last shingle, so that its windows start where they would
        if it stood alone. A window may reach into the next document; what it contains is counted for each document alone.
        """
        top = max(self.classes)
        unit = STEP << top
        lengths = np.array([len(d) for d in docs])
        offsets = np.concatenate([[0], np.cumsum(-(-lengths // unit) * unit)])
        s = np.concatenate([x for d in docs if len(d) for x in (d, np.full(-len(d) % unit, d[-1], np.uint64))] or [np.empty(0, np.uint64)])
        best: dict[tuple[int, str], tuple[int, int, int]] = {}
        for at in range(0, len(s), PIECE):  # a piece has one longest window more than PIECE shingles
            for step, i, t in self._retrieve(s[at : at + PIECE + 2 * unit], top):
                lo, hi = at + i * step, min(at + (i + 2) * step, len(s))
                doc = int(np.searchsorted(offsets, lo, "right")) - 1
                while doc < len(docs) and offsets[doc] < hi:
                    start, end = max(lo, int(offsets[doc])), min(hi, int(offsets[doc] + lengths[doc]))
                    if start < end:
                        window = s[start:end]
                        score = int(np.isin(self.sets[t], window).sum()) * 1000 // len(self.sets[t])
                        if score >= self.needed(t, percent):
                            first = start + int(np.flatnonzero(np.isin(window, self.sets[t]))[0]) - int(offsets[doc])
                            found, key = (score, first, self.lengths[t]), (doc, self.names[t])
                            if key not in best or (-score, first, -found[2]) < (-best[key][0], best[key][1], -best[key][2]):
                                best[key] = found
                    doc += 1
        return _clearest(best)

    def _retrieve(self, s: np.ndarray, top: int) -> set[tuple[int, int, int]]:
        """``(step, window, notice)`` wherever a band of a window agrees with a notice's."""
        hits: set[tuple[int, int, int]] = set()
        starts = np.arange(0, len(s), STEP)
        for p in range(BANDS):
            least = np.minimum.reduceat(self._permuted(s, p), starts)
            for level in range(top + 1):
                # least[i] covers the shingles that start in the i-th step of STEP << level words; a window is two steps.
                if level in self.classes:
                    window = np.minimum(least, np.append(least[1:], least[-1]))
                    sieve, values, holders = self.bands[level, p]
                    maybe = np.flatnonzero(sieve[(window & np.uint64(SIEVE - 1)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(values, window[maybe]), len(values) - 1)
                    same = values[place] == window[maybe]
                    for i, v in zip(maybe[same].tolist(), place[same].tolist(), strict=True):
                        hits.update((STEP << level, i, t) for t in holders[v])
                pairs = least[: len(least) // 2 * 2].reshape(-1, 2).min(axis=1)
                least = np.append(pairs, least[-1]) if len(least) % 2 else pairs
        return hits


def scan_licenses(docs: DataFrame, notices: dict[str, list[str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """``doc_id, license, contained, first_word, n_words``: a row for each document and licence of which it holds a notice.

    ``contained`` is the share of the notice's WIDTH-word shingles, in thousandths, that its best window holds: ``percent`` hundredths or more, and all where the notice has fewer than SHORT.
    Of notices of different licences that overlap, those that are contained to a smaller share are left out, and those that lie in a longer one.
    ``first_word`` is the place of the first of them in the text, and ``n_words`` the notice's length. Words are runs of ASCII letters and digits and characters beyond ASCII, in
    ASCII lower case. Whole texts are scanned in overlapping windows. Bands of MinHash values retrieve notices, and the sets
    themselves decide. The notices are a parameter, of bounded size: ``public_notices`` or those of a folder (``notices_of``).

    Null, empty and wordless texts hold none, and have no row. Repeated rows have rows each. An empty table gives no rows; other columns are ignored.
    """
    templates = Templates(notices or NOTICES)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(BREAKS)
        for batch in batches:
            at, texts = 0, list(utf8(batch.column(1)))
            while at < len(texts):
                end, sets, n = at, [], 0
                while end < len(texts) and n < PIECE:
                    sets.append(shingles(words.hashes(texts[end]), WIDTH) if texts[end] is not None and len(texts[end]) else np.empty(0, np.uint64))
                    n += len(sets[-1])
                    end += 1
                found = sorted(templates.scan(sets, percent).items()) if n else []
                columns = list(zip(*((d + at, name, *x) for (d, name), x in found), strict=True)) or [[]] * 5
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names=["doc_id", "license", "contained", "first_word", "n_words"])
                at = end

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, license string, contained int, first_word long, n_words int")
