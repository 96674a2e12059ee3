"""Token counts by byte-pair merging, without token identifiers."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MARK = "▁"  # stands for a space
CACHED = 600_000  # pieces of text whose counts a worker remembers
NORMAL, BYTE, USER_DEFINED = 1, 6, 4  # kinds of vocabulary entries


class PairCounter:
    """Counts the tokens that a byte-pair model with byte fallback gives.

    A text's characters are a linked list; a heap holds the adjacent pairs that make a vocabulary entry, best rank first and
    then leftmost. Popping and merging until none is left gives the count: symbols at the start, less merges; a lone character
    that the vocabulary lacks counts its bytes. No entry spans a place where two characters meet that meet in no entry, so texts are cut
    there without changing a result, and the counts of the pieces are remembered.
    """

    def __init__(self, model: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models are supported that leave characters as they are and mark spaces in front of words")
        if any(p.type == USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        scored = sorted({p.score for p in proto.pieces if p.type == NORMAL}, reverse=True)
        rank = {s: i for i, s in enumerate(scored)}
        self.rank = {p.piece: rank[p.score] for p in proto.pieces if p.type == NORMAL}
        self.fallback = proto.trainer_spec.byte_fallback
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.meets = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        alone = "\n" not in "".join(self.rank)
        self.newline = 1 if alone and self.fallback else None
        # Marks begin pieces and never follow another character in one: each word can be taken with the mark before it.
        self.by_word = not any(m[1] == MARK and m[0] != MARK for m in self.meets)
        self.pieces = _Memo(self._merge)
        self.words = _Memo(lambda w: self._cut(MARK + w))
        self.starts = _Memo(self._cut)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word or self.newline is None:
            return self._cut(self.prefix + text.replace(" ", MARK))
        total, first = 0, bool(self.prefix)
        for line in text.split("\n"):
            if "  " in line or MARK in line or line[-1:] == " " or line[:1] == " ":
                total += self._cut((self.prefix if first else "") + line.replace(" ", MARK))
            elif line or first:
                ws = line.split(" ")
                total += sum(map(self.words.__getitem__, ws if first else ws[1:]))
                if not first:
                    total += self.starts[ws[0]]
            first = False
        return total + self.newline * text.count("\n")

    def _cut(self, s: str) -> int:
        total, at, meets, pieces = 0, 0, self.meets, self.pieces
        for i in range(1, len(s)):
            if s[i - 1 : i + 1] not in meets:
                total += pieces[s[at:i]]
                at = i
        return total + pieces[s[at:]] if s else 0

    def _merge(self, s: str) -> int:
        rank = self.rank
        if s in rank and len(s) == 1:
            return 1
        sym: list[str] = list(s)
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(s[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not sym[i] or j >= n or len(sym[i]) + len(sym[j]) != size:
                continue  # one of the two has been merged since
            sym[i] += sym[j]
            sym[j] = ""
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(sym[i] + sym[k])) is not None:
                    heapq.heappush(heap, (r, i, size + len(sym[k])))
            h = before[i]
            if h >= 0 and (r := rank.get(sym[h] + sym[i])) is not None:
                heapq.heappush(heap, (r, h, size + len(sym[h])))
        extra = sum(len(c.encode()) - 1 for c in sym if len(c) == 1 and c not in rank) if self.fallback else 0
        return n - merges + extra


class _Memo(dict):
    """A dictionary that computes what it lacks, and forgets all when full."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> int:
        value = self.compute(key)
        if len(self) >= CACHED:
            self.clear()
        if len(key) < 64:
            self[key] = value
        return value


_COUNTERS: dict[str, PairCounter] = {}


def _counter(model: str) -> PairCounter:
    """One counter for each model in a Python worker, kept between tasks."""
    import builtins

    kept = builtins.__dict__.setdefault("_prismcol_counters", _COUNTERS)
    if model not in kept:
        kept[model] = PairCounter(model)
    return kept[model]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row: the whole text's tokens under the model file at ``model``.

    The file has to be at that path on each executor. A null text counts as empty and has no tokens. No token is added at either end, strings that
    look like control tokens are ordinary text, and nothing is cut off. Repeated rows are counted each; other columns are ignored; an
    empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in batches:
            n = [0 if t is None else counter.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
