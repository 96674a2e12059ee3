"""Token ids in Parquet: list columns in document order that allow selective reads."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_level import ByteLevelEncoder, character_classes, library
from .common import bound_batches, fresh, new_path
from .hashing import utf8

#: Row groups are small enough to be skipped by their statistics one by one, pages by the page index; the second
#: writer version stores ids as dictionary codes, or as deltas where a dictionary does not pay.
LAYOUT = {"parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10), "parquet.enable.dictionary": "true", "parquet.writer.version": "v2", "compression": "zstd"}
BYTES_AT_ONCE = 4 << 20


def _encoder(tokenizer: str, classes: list[tuple[int, int]] | None):
    """A function that gives the ids of UTF-8 texts, one after the other, with an end id each, and their numbers; one in each Python worker."""
    import builtins

    kept = builtins.__dict__.setdefault("_prismcol_encoders", {})
    if tokenizer not in kept:
        if classes is not None:
            kept[tokenizer] = ByteLevelEncoder(tokenizer, classes).batch
        else:
            given = library(tokenizer)

            def encode(texts: list[memoryview], end_id: int) -> tuple[np.ndarray, np.ndarray]:
                found = [np.array([*e.ids, end_id], np.int32) for e in given.encode_batch_fast([bytes(t).decode() for t in texts], add_special_tokens=False)]
                return np.concatenate(found), np.array([len(x) for x in found], np.int64)

            kept[tokenizer] = encode
    return kept[tokenizer]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode each whole text with the tokenizer of a file of the tokenizers library, without added special tokens, append ``end_id``, and write ``doc_id, part, inside, n_tokens, tokens`` at ``path``.

    All ids are the library's. Texts of a byte-level tokenizer are cut into its pieces for a whole batch at once, and the library is given each piece that a
    worker's store does not know (see ``byte_level``); other tokenizers are given whole texts.

    Documents are range-partitioned by id, null first, and sorted: file after file, the ids are in document order.
    ``part`` is the place of a file in that order, ``inside`` the number of ids before the document in its part. A null text counts as empty and has the end id alone. Rows of one id
    are kept, in the order of their texts' hashes; so many rows of one id that they fill several parts are spread over them. The vocabulary file has to be at its path on each executor.
    Other columns are not written. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    classes = character_classes(tokenizer)  # some thousands of pairs

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, inside = _encoder(tokenizer, classes), 0
        for batch in batches:
            texts = [t if t is not None else memoryview(b"") for t in utf8(batch.column(2))]
            at = 0
            while at < len(texts):
                upto, n = at, 0
                while upto < len(texts) and n < BYTES_AT_ONCE:
                    n += len(texts[upto])
                    upto += 1
                flat, counts = ids_of(texts[at:upto], end_id)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                columns = [batch.column(0)[at:upto], batch.column(1)[at:upto], pa.array(inside + offsets[:-1], pa.int64()), pa.array(counts, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "inside", "n_tokens", "tokens"])
                inside += int(offsets[-1])
                at = upto

    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key, tie = fresh(docs, "key", "tie")
    order = [F.col("doc_id").asc_nulls_first(), F.col(key), F.col(tie)]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias(key), F.monotonically_increasing_id().alias(tie))
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    with bound_batches(docs.sparkSession):
        dealt.select("doc_id", F.spark_partition_id().alias("part"), "text").mapInArrow(encode, f"doc_id {kind}, part int, inside long, n_tokens long, tokens array<int>").write.options(**LAYOUT).parquet(path)


def read_tokens(spark, path: str, kind: str = "bigint") -> DataFrame:
    """Written tokens as a table; ``kind`` is the type of the document ids."""
    return spark.read.schema(f"doc_id {kind}, part int, inside long, n_tokens long, tokens array<int>").parquet(path)


def _placed(rows: DataFrame, stored: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``start``, from their place in a part and the totals of the parts before, one row for each part."""
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = totals.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), *columns)


def token_index(stored: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens`` of written tokens: ``start`` counts the ids of all documents before. The ids themselves are not read, nothing is sorted."""
    return _placed(stored.select("doc_id", "part", "inside", "n_tokens"), stored, "n_tokens")


def token_checksums(stored: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of written tokens; the checksum is that of the ids as little-endian unsigned 32-bit integers, taken from the ids as they are read, and ``n_tokens`` is their count."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4", copy=False)
            crc = [zlib.crc32(memoryview(flat[a:b]).cast("B")) if b > a else 0 for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "inside", "n_tokens", "ids_crc32"])

    rows = stored.select("doc_id", "part", "inside", "tokens").mapInArrow(sums, f"doc_id {kind}, part int, inside long, n_tokens long, ids_crc32 long")
    return _placed(rows, stored, "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the tokens of ``docs`` in the shared folder; give the table as it is read back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path, docs.schema["doc_id"].dataType.simpleString())
