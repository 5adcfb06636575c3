"""Queries of this subpackage for the driver: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    common,
    conversations,
    decontaminate,
    fingerprints,
    line_dedup,
    ngram_join,
    oracles,
    packing,
    phrases,
    sharding,
    suffix_dedup,
    token_counts,
    toxicity,
    warc,
)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; it is read where it lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "shards")
    sharding.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    text = F.coalesce("text", F.lit(""))
    return spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_texts(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("k_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.repair(rows, copies=copies, texts=False).drop("repaired")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return byte_bpe.encoded_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = {
        "op1_fingerprints": op1_fingerprints,
        "op2_toxicity": op2_toxicity,
        "op3_warc_archive": op3_warc_archive,
        "op4_packing": op4_packing,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_sharding": op6_sharding,
        "op7_ngram_join": op7_ngram_join,
        "op8_line_dedup": op8_line_dedup,
        "op9_decontamination": op9_decontamination,
        "op10_token_counts": op10_token_counts,
        "op11_collocations": op11_collocations,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_byte_bpe": op13_byte_bpe,
    }
    return made


def oracle_sql() -> dict[str, str]:
    """The other queries have none: SQL has no sketches, index search, tokenizers, seeded shuffles or fast byte windows."""
    return dict(oracles.SQL)
