"""Benchmark decontamination by a prefix-filtered set join.

Windows of ``size`` consecutive words of each item (or the whole item, if shorter) are the
sets to find. Their words are ordered by rarity over all documents; as containment must be
whole, the rarest word alone is the necessary prefix. Document positions of prefix words
are joined with the windows, positions whose window would not fit into the document are
dropped, and the rest are verified word by word. Every word of a verified occurrence is hit.

Only DataFrame functions are used, and no text is shuffled: words are exploded and probed
in the scan's own stage. The side that is broadcast, windows of the benchmark, is counted
first; beyond ``limit`` rows the same join shuffles by prefix word.

Words are maximal runs of code points other than ASCII ones that are not letters or digits,
with A-Z lower-cased. Defined results: a null text has no words; an item without words is
ignored; rows equal in id and text share a result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

WINDOW = 10
LIMIT = 200_000
#: What separates words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def item_windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window): distinct windows of each item."""
    rows = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return rows.select("item", F.explode(F.array_distinct(F.transform(
        starts, lambda i: F.slice("w", i, F.lit(size))))).alias("window"))


def prefixes(docs: DataFrame, found: DataFrame, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(prefix, before, window, items): for each distinct window its rarest word and how many come before it.

    Windows with a word that no document has cannot occur and are left out.
    """
    named = found.groupBy("window").agg(F.collect_set("item").alias("items"))
    vocabulary = saved(found.select(F.explode("window").alias("word")).distinct(), "words")
    said = docs.select(F.explode(words(F.col(text_col))).alias("word"))
    counts = small(said, vocabulary, "word", limit).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    each = named.select("window", "items", F.posexplode("window").alias("before", "word")).join(
        saved(counts, "counts"), "word", "left")
    best = each.groupBy("window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "before")).alias("best"),
        F.first("items").alias("items"))
    return best.where("best.n > 0").select(F.col("best.word").alias("prefix"), F.col("best.before").alias("before"),
                                           "window", "items")


def small(left: DataFrame, right: DataFrame, on: str, limit: int) -> DataFrame:
    """Inner join with a saved side; broadcast only if counted to be small."""
    return left.join(F.broadcast(right) if right.limit(limit + 1).count() <= limit else right, on)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", limit: int = LIMIT) -> DataFrame:
    """(k_id, k_text, n_words, n_hit, items array<string>), one row per input row."""
    sought = saved(prefixes(docs, item_windows(items, size, item_col), text_col, limit), "prefixes")
    key = [F.col(id_col).alias("k_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("k_text")]
    said = docs.select(*key, words(F.col(text_col)).alias("w"))
    at = said.select("k_id", "k_text", "w", F.posexplode("w").alias("at", "prefix"))
    if sought.limit(limit + 1).count() > limit:  # shuffled: carry the words around the position only
        low = F.greatest(F.col("at") - size + 1, F.lit(0))
        at = at.select("k_id", "k_text", "prefix", low.alias("low"), (F.col("at") - low).alias("at"),
                       F.slice("w", low + 1, F.lit(2 * size)).alias("w"))
    else:
        at = at.withColumn("low", F.lit(0))
    start = F.col("at") - F.col("before")
    fits = (start >= 0) & (start + F.size("window") <= F.size("w"))
    hits = small(at, sought, "prefix", limit).where(
        fits & F.when(fits, F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window")))
    hits = hits.select("k_id", "k_text", (F.col("low") + start).alias("start"), F.size("window").alias("n"), "items")
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("n") - 1))))
    per_doc = hits.groupBy("k_id", "k_text").agg(
        F.size(covered).cast("long").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    per_doc = per_doc.select(F.col("k_id").alias("h_id"), F.col("k_text").alias("h_text"), "n_hit",
                             F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"))
    base = said.select("k_id", "k_text", F.size("w").cast("long").alias("n_words"))
    joined = base.join(per_doc, F.col("k_id").eqNullSafe(F.col("h_id")) & (F.col("k_text") == F.col("h_text")), "left")
    return joined.select("k_id", "k_text", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                         F.coalesce("items", F.array().cast("array<string>")).alias("items"))
