"""Corpus pipeline: five stages over documents, each written as Parquet and read by the next.

Rejecting toxic documents, deleting repeated runs of lines, keeping one document of each
near-duplicate group, rejecting documents that contain benchmark passages, and packing
what is left. All stages but the last return the columns of ``documents``, and others that
the table has beside them.

Defined results: a null text counts as empty in every stage; a document whose text is null or
empty from the start is kept by the first two stages and is one group with all others of its
kind in the third; a null id is an id of its own and comes first; rows equal in id and text are
decided alike, and one of them stays in the third stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common, decontaminate, line_dedup, ngram_join, packing, toxicity
from plumbline.llm.queries import table, tokenizer_path

#: SQL cannot express the first stage's index, nor the last stage's token ids.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, unchanged; examples come from the labels outside the held-out fold.

    Without labels, or without words in the text, the score is a base rate.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with later repeated runs of lines deleted; one that loses all its text goes, one that had none stays.

    n_chars follows a changed text; all else stays as it is.
    """
    found = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    changed = F.col("n_removed") > 0
    columns = []
    for name in docs.columns:
        was = F.col(f"row.{name}")
        now = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}.get(name)
        columns.append((was if now is None else F.when(changed, now).otherwise(was)).alias(name))
    return found.select(*columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; a null id is the last choice."""
    return ngram_join.first_of_class(docs)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = common.saved(found.where("n_hit > 0").select("k_id", "k_text").distinct(), "contaminated")
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    if common.is_small(hit):
        hit = F.broadcast(hit)
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["k_id"]) & (text == hit["k_text"]), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", delete_repeated_lines),
    ("ngram_join", keep_one_of_each_group),
    ("decontamination", reject_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return docs
