"""A corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing to target weights, shards.

Each stage takes (spark, docs, sf_dir) and gives all rows that it keeps; ``docs`` needs ``doc_id, text, lang, source`` and may have other columns, of any
name, which stay. All stages give no rows for an empty table. Rows are judged one by one, so rows that repeat are so many documents.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcol.llm.common import collecting, fresh, new_path, remove
from prismcol.llm.decontamination import decontaminate
from prismcol.llm.jaccard_join import drop_similar
from prismcol.llm.mixing import mix_documents
from prismcol.llm.quality import quality_rules
from prismcol.llm.sharding import shard_by_bytes

N_SHARDS = 40
#: Near duplicates share 80 hundredths of their five-word shingles; op7's own values are its contract's.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of their language and source accept.

    Null, empty and short texts have too few words and go. A null language or source is a value of its own. Repeated rows are judged alike.
    """
    return quality_rules(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one of the smallest id.

    Of repeated rows one stays; rows with one id and unlike texts all stay. Rows with a null id are compared like others and come last in a group. Texts without
    words are similar to nothing and stay.
    """
    return drop_similar(docs, SHINGLE_WORDS, SIMILAR_PERCENT).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate.

    Null and empty texts are clean; so are all documents where the benchmark is empty. Repeated rows are judged alike.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark).where(~F.col("contaminated")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's slots take it, in the order of the slots.

    Texts without words are never taken. A null source is a source of its own. Repeated rows, and rows with one id, are documents of their own.
    """
    return mix_documents(docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's shard and its place there; shards are of nearly equal bytes, in the order of the texts' digests and ids, so equal texts stand together.

    A null text has no bytes; its row still has a place. Ties are dealt in any order. Columns ``shard`` and ``slot`` of the input are replaced, and it gets ``size``.
    """
    key, *_ = fresh(docs, "key")
    sized = docs.withColumns({"size": (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long"), key: F.md5(F.coalesce("text", F.lit("")))})
    return shard_by_bytes(sized, N_SHARDS, order=(key, "doc_id")).drop(key)


def _stages(*stages):
    """Each stage so wrapped that it first deletes what the one before it, in this thread, left in the shared folder: a stage's rows have to be written before the next is called.

    A stage that follows none, or the last, deletes what the last run in this thread has left.
    """
    state = threading.local()

    def wrapped(f):
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            remove(spark, *getattr(state, "left", []))
            state.left = []
            with collecting() as paths:
                out = f(spark, docs, sf_dir)
            state.left = paths
            return out

        stage.__doc__ = f.__doc__
        return stage

    return [(name, wrapped(f)) for name, f in stages]


STAGES = _stages(("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing), ("sharding", sharding))

#: SQL cannot state the result as a whole within its time; tests compare each stage to a brute-force version, on that stage's own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
