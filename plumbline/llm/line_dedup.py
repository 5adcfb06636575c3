"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that are not blank. Of every window of ``run`` lines
the line of the smallest hash is selected, the leftmost of equal ones, so two equal windows
select the same line: it is their fingerprint. One position is often selected by several
windows and counts once. A line of at least ``long_chars`` characters is also a window by
itself, and its own fingerprint.

Positions whose fingerprint no other position has are dropped. The others are extended to the left and right to
all windows that selected them, and a window is matched with its earliest occurrence by the hash of all its lines. A window
that occurred earlier, in the order of id and position, is deleted; overlapping windows make
the whole repeated run, and the earliest occurrence of a run stays. So a line goes exactly if
it lies in a run of at least ``run`` lines, or is a long line, that occurs earlier. A match is not grown beyond a window at
a time: a long copied run is as many matches as it has windows.

Only DataFrame functions are used. Fingerprints are counted, and matches reduced to their
earliest occurrence, by aggregates with a map-side step; what joins them back is a broadcast of
a size that is checked, or a plain equi-join of two exchanges, whose skewed partitions Spark
splits. The work on a document is linear in its lines. Lines are told apart by 128 bits of hash.

Defined results: a null text counts as empty and has no lines; blank lines are kept, but a
text that loses all others becomes empty; rows equal in id and text are one document and
share a result; a null id comes first. Extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, with_small

RUN = 3
LONG_CHARS = 60


def keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells documents apart: the id, and a hash of the text."""
    return F.col(id_col).alias("k_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("k_text")


def positions(docs: DataFrame, run: int = RUN, long_chars: int = LONG_CHARS, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(k_id, k_text, start, first, size, mark, near): the selected positions.

    start: where the first window begins that selected it; first: its place there, from 1; near: hashes and
    numbers of the lines from there on, as far as its windows can go; size: lines of its windows.
    """
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n")
    hashed = F.array_compact(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", F.struct(
        F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), i.cast("long").alias("raw"), (F.length(x) >= long_chars).alias("long")))))
    rows = docs.select(*keys(id_col, text_col), hashed.alias("l")).where(F.size("l") > 0)
    # Each line with those that its windows reach, and the one before it.
    rows = rows.select("k_id", "k_text", F.posexplode(F.transform("l", lambda x, i: F.struct(
        F.slice("l", F.greatest(i, F.lit(1)), F.when(i > 0, 2 * run).otherwise(2 * run - 1)).alias("around"), x["long"].alias("long"),
        x["h"].alias("h")))).alias("start", "x"))
    back = F.when(F.col("start") > 0, 1).otherwise(0)
    rows = rows.select("k_id", "k_text", "start", "x.long", "x.h", back.alias("back"), F.col("x.around").alias("around"),
                       F.transform("x.around", lambda x: x["h"]).alias("hs"))
    own, before = F.slice("hs", F.col("back") + 1, F.lit(run)), F.slice("hs", F.lit(1), F.lit(run))
    first = F.array_position(own, F.array_min(own))
    fresh = (F.col("back") == 0) | (F.array_position(before, F.array_min(before)) != first + 1)
    sizes = F.array_compact(F.array(F.when((F.size(own) == run) & fresh, F.lit(run)), F.when(F.col("long"), F.lit(1))))
    rows = rows.select("k_id", "k_text", "start", "h", "around", "back", first.alias("place"), F.array_min(own).alias("least"),
                       F.explode(F.array_distinct(sizes)).alias("size"))
    single = F.col("size") == 1
    return rows.select("k_id", "k_text", "start", F.when(single, 1).otherwise(F.col("place")).alias("first"), "size",
                       F.when(single, F.col("h")).otherwise(F.col("least")).alias("mark"),
                       F.slice("around", F.col("back") + 1, F.col("size") * 2 - 1).alias("near"))


def windows(found: DataFrame) -> DataFrame:
    """(k_id, k_text, start, size, w1, w2, lines): the windows that selected a position, by two hashes of all their lines.

    lines: number of each line among those that are not blank, times 2**32, plus its number among all.
    """
    cut = lambda j: F.slice("near", j + 1, F.col("size"))
    hashes = lambda j: F.transform(cut(j), lambda x: x["h"])
    starts = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda j: (F.size(cut(j)) == F.col("size")) & (
        j + F.array_position(hashes(j), F.array_min(hashes(j))) == F.col("first")))
    rows = found.select("k_id", "k_text", "start", "size", "near", F.explode(starts).alias("j"))
    rows = rows.select("k_id", "k_text", (F.col("start") + F.col("j")).alias("start"), "size", F.slice("near", F.col("j") + 1, F.col("size")).alias("w"))
    code = lambda name, seed: F.aggregate("w", F.lit(seed).cast("long"), lambda a, x: F.xxhash64(a, x[name]))
    return rows.select("k_id", "k_text", "start", "size", code("h", 11).alias("w1"), code("g", 13).alias("w2"),
                       F.transform("w", lambda x, i: F.shiftleft((F.col("start") + i).cast("long"), 32) + x["raw"]).alias("lines"))


def repeated_lines(docs: DataFrame, run: int = RUN, long_chars: int = LONG_CHARS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(k_id, k_text, gone): for documents that lose lines, those as windows has them, ascending."""
    found = positions(docs, run, long_chars, id_col, text_col)
    marks = saved(found.groupBy("size", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size", "mark"), "marks")
    near = saved(windows(with_small(found, marks, ["size", "mark"])), "windows")
    place = F.struct("k_id", "k_text", "start")
    first = near.groupBy("size", "w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = saved(first.where("n > 1").select("size", "w1", "w2", "first"), "first")
    later = near.join(first, ["size", "w1", "w2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("k_id", "k_text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("gone"))


def dedup_lines(docs: DataFrame, run: int = RUN, long_chars: int = LONG_CHARS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_removed, n_runs, kept): the input row as a struct, and its text without repeated runs."""
    gone = repeated_lines(docs, run, long_chars, id_col, text_col)
    k_id, k_text = keys(id_col, text_col)
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), k_id, k_text, text.alias("t"))
    gone = gone.select(F.col("k_id").alias("g_id"), F.col("k_text").alias("g_text"), "gone")
    both = rows.join(gone, F.col("k_id").eqNullSafe(F.col("g_id")) & (F.col("k_text") == F.col("g_text")), "left")
    lines = F.split("t", "\n")
    n_lines = F.size(F.filter(lines, lambda x: F.trim(x) != ""))
    raw = lambda code: F.expr("4294967295L").bitwiseAND(code)
    before = lambda j: F.get(F.col("gone"), j - 1)
    # One flag for each line up to the last that goes.
    flags = F.flatten(F.transform("gone", lambda c, j: F.concat(
        F.array_repeat(F.lit(False), (raw(c) - F.coalesce(raw(before(j)), F.lit(-1)) - 1).cast("int")), F.array(F.lit(True)))))
    rest = F.array_compact(F.zip_with(lines, flags, lambda x, gone: F.when(F.coalesce(gone, F.lit(False)), F.lit(None)).otherwise(x)))
    runs = F.size(F.filter("gone", lambda c, j: (j == 0) | (F.shiftright(before(j), 32) != F.shiftright(c, 32) - 1)))
    removed = F.size("gone")
    none = F.col("gone").isNull()
    kept = F.when(none, F.col("t")).when(removed == n_lines, F.lit("")).otherwise(F.array_join(rest, "\n"))
    return both.select("row", n_lines.cast("long").alias("n_lines"), F.when(none, 0).otherwise(removed).cast("long").alias("n_removed"),
                       F.when(none, 0).otherwise(runs).cast("long").alias("n_runs"), kept.alias("kept"))
