"""One query for each corpus operator, with production parameters, over whole tables; DuckDB SQL where that can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .decontamination import decontaminate
from .jaccard_join import similarity_classes
from .license_scan import scan_licenses
from .line_dedup import dedup_runs
from .mixing import mix_taken
from .quality import quality_rules
from .sharding import shard_by_bytes
from .token_count import token_counts
from .token_output import encode_and_read, token_checksums
from .warc import archive_and_read

N_SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_md5"))
    # By the text's digest first: equal texts stand together, in one shard but for a group that a shard's edge cuts.
    out = shard_by_bytes(rows, N_SHARDS, order=("text_md5", "doc_id"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = dedup_runs(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "removed_lines", "removed_bytes", F.sha2("text", 256).alias("text_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    back = archive_and_read(pages)
    return back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    stored = encode_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_checksums(stored)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), carry=("doc_id",)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_taken(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_license_scan, op4_warc, op5_line_dedup, op6_token_counts, op7_jaccard_join, op8_quality_rules, op9_token_output, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    """For those results that SQL can state: it lacks MinHash, line chunks and tokenizers."""
    return {
        "op1_sharding": oracles.sharding(N_SHARDS),
        "op2_decontamination": oracles.decontamination(),
        "op4_warc": oracles.warc(),
        "op7_jaccard_join": oracles.jaccard(),
        "op8_quality_rules": oracles.quality(),
        "op10_mixing": oracles.mixing(),
    }
