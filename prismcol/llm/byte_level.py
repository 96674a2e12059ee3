"""Token ids of many texts at once, by the tokenizers library, for byte-level tokenizers.

A byte-level tokenizer cuts a text into pieces by a fixed pattern and merges inside each piece only. Here numpy cuts all texts of
a batch, and the library encodes each piece that is not known yet; a store of fixed size in each worker knows the others.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .hashing import BASE, mix

LETTER, NUMBER, OTHER, WHITE = range(4)
SLOT_BITS = 21
#: Ids that a slot of the store holds; a piece with more is encoded again in each batch.
WIDTH = 8
#: Bytes of text that are cut and looked up together; longer texts are given in segments.
AT_ONCE = 1 << 19
#: No piece reaches over this place: a word of ASCII letters ends, and the next starts with its space.
SAFE = re.compile(rb"(?<=[A-Za-z])(?= [A-Za-z])")


def library(tokenizer: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


def character_classes(tokenizer: str) -> list[tuple[int, int]] | None:
    """``(first code point, class)`` of runs of code points of one class, as the library's own pattern sees them; None where the file's tokenizer is of another kind.

    Code points are tried in blocks, which are halved until all of a block are alike.
    """
    t = library(tokenizer)
    made = json.loads(t.to_str())
    pre = made["pre_tokenizer"] or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or made["normalizer"] or made["model"]["type"] != "BPE" or made["model"].get("dropout"):
        return None
    one_piece = lambda s: len(t.pre_tokenizer.pre_tokenize_str(s)) == 1
    out: list[tuple[int, int]] = []

    def split(a: int, b: int) -> None:
        block = "".join(map(chr, range(a, b)))
        found = next((c for c, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if one_piece(lead + block)), WHITE if b - a == 1 else None)
        if found is None:
            split(a, (a + b) // 2)
            split((a + b) // 2, b)
        elif not out or out[-1][1] != found:
            out.append((a, found))

    for a in range(0, 0x110000, 0x800):
        if a != 0xD800:
            split(a, a + 0x800)
    return out


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all elements of runs, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)


class ByteLevelEncoder:
    """Gives the ids of UTF-8 texts; ``classes`` as ``character_classes`` gives them."""

    def __init__(self, tokenizer: str, classes: list[tuple[int, int]]) -> None:
        self.library = library(tokenizer)
        self.table = np.empty(0x110000, np.uint8)
        for (a, c), b in zip(classes, [x for x, _ in classes[1:]] + [0x110000], strict=True):
            self.table[a:b] = c
        added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(added, key=len, reverse=True))) if added else None
        vocabulary = self.library.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for x, i in vocabulary.items() if x.startswith("Ġ")]] = True
        self.values = mix(np.arange(256, dtype=np.uint64) * np.uint64(BASE) + np.uint64(1))
        self._powers(AT_ONCE + 1)
        self.keys, self.counts = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.uint8)
        self.ids = np.zeros((1 << SLOT_BITS, WIDTH), np.uint16 if len(self.spaced) <= 1 << 16 else np.int32)

    def _powers(self, n: int) -> None:
        self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))))

    def cut(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start in texts that start at ``texts``, and the class of each byte's character.

        The pattern's rules: runs of letters, of numbers and of others, each with a space before it; 's 't 'm 'd 're 've 'll where a piece would start
        with the apostrophe; white space otherwise, of which the last character before something else stands alone or is that space.
        """
        n = len(data)
        cls = self.table[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            b = np.concatenate([data, np.zeros(4, np.uint8)])
            first = b[lead].astype(np.int32)
            low = [(b[lead + k] & 0x3F).astype(np.int32) for k in (1, 2, 3)]
            two, three = first < 0xE0, first < 0xF0
            point = np.where(two, (first & 0x1F) << 6 | low[0], np.where(three, (first & 0x0F) << 12 | low[0] << 6 | low[1], (first & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2]))
            of = self.table[np.minimum(point, 0x10FFFF)]
            cls[lead], cls[lead + 1] = of, of
            cls[lead[~two] + 2] = of[~two]
            cls[lead[~three] + 3] = of[~three]
        begins = np.zeros(n + 3, bool)
        begins[texts] = begins[n:] = True
        starts = np.empty(n, bool)
        starts[:1] = True
        np.not_equal(cls[1:], cls[:-1], out=starts[1:])
        starts |= begins[:n]
        # What follows white space, and the last character of that.
        after = np.flatnonzero(starts[1:] & (cls[1:] != WHITE) & (cls[:-1] == WHITE) & ~begins[1:n]) + 1
        last = after - 1
        for _ in range(3):
            last -= (data[last] & 0xC0) == 0x80
        starts[last] = True
        starts[after[data[last] == 0x20]] = False
        quote = np.flatnonzero(data == 0x27)
        if len(quote):
            b = np.concatenate([data, np.zeros(3, np.uint8)])
            quote = quote[starts[quote] & ~begins[quote + 1]]
            x, y = b[quote + 1], b[quote + 2]
            one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
            pair = ((y == 0x65) & ((x == 0x72) | (x == 0x76)) | (x == 0x6C) & (y == 0x6C)) & ~begins[quote + 2]
            starts[quote[one | pair] + 1] = False
            for found, length in ((one, 2), (pair, 3)):
                at = quote[found] + length
                starts[at[at < n]] = True
        return np.flatnonzero(starts), cls

    def _new(self, data: np.ndarray, cls: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ids, and ids, of pieces that are not known.

        Those of a space and a word are given to the library as one text: each starts with its space, so the library cuts them there, and
        their ids start at those tokens that have a space first.
        """
        spaced = (length > 1) & (data[start] == 0x20) & (cls[np.minimum(start + 1, len(cls) - 1)] != WHITE)
        counts, parts = np.zeros(len(start), np.int64), {}
        if spaced.any():
            text = data[_ragged(start[spaced], length[spaced])].tobytes().decode()
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            at = np.flatnonzero(self.spaced[ids])
            if len(at) != int(spaced.sum()) or at[0]:
                raise ValueError("the tokenizer does not cut at spaces")
            counts[spaced] = np.diff(np.append(at, len(ids)))
            parts[True] = ids
        if not spaced.all():
            found = [e.ids for e in self.library.encode_batch_fast([data[a : a + n].tobytes().decode() for a, n in zip(start[~spaced], length[~spaced], strict=True)], add_special_tokens=False)]
            counts[~spaced] = [len(x) for x in found]
            parts[False] = np.array([i for x in found for i in x], np.int32)
        flat, before = np.empty(counts.sum(), np.int32), np.cumsum(counts) - counts
        for kind, ids in parts.items():
            mine = spaced == kind
            flat[_ragged(before[mine], counts[mine])] = ids
        return counts, flat

    def encode(self, data: np.ndarray, texts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie one after the other in ``data`` from ``texts`` on, each with ``end_id`` after it, and how many each has."""
        tail = 0 if end_id is None else 1
        if not len(data):
            return np.full(len(texts) * tail, end_id or 0, np.int32), np.full(len(texts), tail, np.int64)
        filled = texts[texts < len(data)]
        start, cls = self.cut(data, filled)
        length = np.diff(np.append(start, len(data)))
        if len(data) >= len(self.up):
            self._powers(len(data) + 1)
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=run[1:])
        key = mix((run[start + length] - run[start]) * self.down[start] + length.astype(np.uint64)) | np.uint64(1)
        slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        known = self.keys[slot] == key
        counts = self.counts[slot].astype(np.int64)
        missed = np.flatnonzero(~known)
        if len(missed):
            new, first, which = np.unique(key[missed], return_index=True, return_inverse=True)
            new_counts, new_ids = self._new(data, cls, start[missed[first]], length[missed[first]])
            counts[missed] = new_counts[which]
        of = np.searchsorted(texts, start, side="right") - 1
        place = np.cumsum(counts) - counts + of * tail
        out = np.empty(int(counts.sum()) + len(texts) * tail, np.int32)
        held = slot[known]
        inside = np.arange(WIDTH) < counts[known][:, None]
        out[(place[known][:, None] + np.arange(WIDTH))[inside]] = self.ids[held][inside]
        if len(missed):
            before = np.cumsum(new_counts) - new_counts
            out[_ragged(place[missed], counts[missed])] = new_ids[_ragged(before[which], counts[missed])]
            fit = np.flatnonzero(new_counts <= WIDTH)
            at = (new[fit] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            self.keys[at], self.counts[at] = new[fit], new_counts[fit]
            column = np.arange(int(new_counts[fit].sum())) - np.repeat(np.cumsum(new_counts[fit]) - new_counts[fit], new_counts[fit])
            self.ids[np.repeat(at, new_counts[fit]), column] = new_ids[_ragged(before[fit], new_counts[fit])]
        totals = np.bincount(of, counts, minlength=len(texts)).astype(np.int64) + tail
        if tail:
            out[np.cumsum(totals) - 1] = end_id
        return out, totals

    def whole(self, text: bytes, end_id: int | None) -> np.ndarray:
        """As the library gives them for a text that may hold strings of added tokens."""
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids + ([] if end_id is None else [end_id]), np.int32)

    def long(self, text: bytes, end_id: int | None) -> np.ndarray:
        """The ids of a long text, by segments."""
        out, at = [], 0
        while at < len(text):
            cut = SAFE.search(text, at + AT_ONCE)
            upto = cut.start() if cut and cut.start() < len(text) else len(text)
            out.append(self.encode(np.frombuffer(text[at:upto], np.uint8), np.zeros(1, np.int64), None)[0])
            at = upto
        return np.concatenate(out + ([] if end_id is None else [np.array([end_id], np.int32)]))

    def batch(self, texts: list[memoryview], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts of any length, one after the other, and how many each has."""
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= AT_ONCE):
                size += len(texts[upto])
                upto += 1
            data = b"".join(texts[at:upto])
            if self.added and self.added.search(data) or size > AT_ONCE:
                # Text by text; a string of an added token may also have come about where two texts meet.
                for t in map(bytes, texts[at:upto]):
                    if self.added and self.added.search(t):
                        ids.append(self.whole(t, end_id))
                    elif len(t) > AT_ONCE:
                        ids.append(self.long(t, end_id))
                    else:
                        ids.append(self.encode(np.frombuffer(t, np.uint8), np.zeros(1, np.int64), end_id)[0])
                    counts.append(np.array([len(ids[-1])], np.int64))
            else:
                starts = np.cumsum([0] + [len(t) for t in texts[at:upto]][:-1])
                found = self.encode(np.frombuffer(data, np.uint8), starts, end_id)
                ids.append(found[0])
                counts.append(found[1])
            at = upto
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.empty(0, np.int32), np.empty(0, np.int64))
