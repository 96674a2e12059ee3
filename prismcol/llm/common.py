"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is space and U+0009 to U+000D; a word is a run of anything else.
SPACE = r"[\x20\x09\x0A\x0B\x0C\x0D]"
WORD = r"[^\x20\x09\x0A\x0B\x0C\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a session in one process gets a new local folder; on a cluster that would be another folder on each machine, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="prismcol-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


_collecting = threading.local()


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths that new_path gives while in it, in this thread, for those who want to remove what an operator has left."""
    before, mine = getattr(_collecting, "paths", ()), []
    _collecting.paths = (*before, mine)
    try:
        yield mine
    finally:
        _collecting.paths = before


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in getattr(_collecting, "paths", ()):
        paths.append(path)
    return path


def materialise(frame: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder as Parquet and read them again: cuts lineage, and survives lost executors."""
    spark = frame.sparkSession
    path = new_path(spark, label)
    frame.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark deletes the shuffle files of frames that nothing holds any more only then, and the driver's heap shrinks to what it holds."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def bound_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """While in it, plans are made that give Python at most so many rows at once: long texts would otherwise make batches of hundreds of MB.

    The setting is read when a plan is made, so what runs in it has to be an action; afterwards the session has its own again.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    if 0 < int(was) <= rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda's variable is not inlined, as a projected column may be."""
    return F.transform(F.array(value), body)[0]


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """For each name, one like it that is no column of the frame, whatever the case of letters."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small(frame: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The frame, to be broadcast only where it has at most ``most`` rows, and whether that is so."""
    ok = len(frame.limit(most + 1).select(F.lit(1)).take(most + 1)) <= most if most < 1000 else frame.count() <= most
    return (F.broadcast(frame) if ok else frame), ok


SALTS = 32


def salted_join(many: DataFrame, one: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """``many`` joined to ``one``, which has a row for each ``key``; rows of one key are dealt to ``salts`` parts, so none has all of a hot one."""
    (salt,) = fresh(many.select(*many.columns, *(F.lit(None).alias(c) for c in one.columns if c not in many.columns)), "salt")
    dealt = many.withColumn(salt, F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int"))
    return dealt.join(one.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, salt]).drop(salt)


def words(text: Column) -> Column:
    """The white-space separated words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")
