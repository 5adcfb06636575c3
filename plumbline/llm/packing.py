"""Hierarchical multi-length packing of token sequences.

Documents are cut at the longest window; the rest of each is routed to the shortest tier
that holds it. Long windows are filled first: each long rest takes the pieces of shorter
tiers that fit its gap best. What remains is packed in its own tier where it fills a
window exactly, and otherwise goes to long windows. Windows of one tier are dealt to step
groups in turn, so that all groups of a tier hold about as many tokens.

The plan depends only on how many pieces there are of each length, a table of at most
``window`` rows, so it is made on the driver at any scale. Pieces are numbered within
their length by counts per (length, hash bucket), and a number determines the window and
the offset. No task needs all pieces of a length.

Defined results: a null text counts as empty and has the end token only; repeated rows and
ids are packed once for each row; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved

WINDOW = 1024
TIERS = (256, 512, 1024)
STEP_TOKENS = 1 << 18

#: Code points that make a run too long for a pattern that backtracks.
LONG_RUN = 20_000
BLANKS = re.compile(r"\s{64,}").findall

_ENCODERS: dict[str, object] = {}

#: The pattern that byte-level vocabularies split text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def longest_run(text: str) -> int:
    """The most code points in a row without a blank, or of blanks (0 for fewer than 64 of those), in time that grows with the text alone."""
    return max(max(map(len, text.split()), default=0), max(map(len, BLANKS(text)), default=0))


def encoder(path: str):
    """Identifiers of a text as a numpy array, for a byte-level BPE file of the ``tokenizers`` library.

    The merges run in tiktoken, which gives the same identifiers several times faster; tests
    compare the two. Its pattern cannot split very long runs without or of blanks, so texts with
    such a run go to ``tokenizers`` itself, as do all texts if the file asks for more than the pattern.
    """
    if path not in _ENCODERS:
        import json

        import numpy as np
        import tiktoken
        import tokenizers

        from .token_counts import byte_symbols

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        marks = {t["content"]: t["id"] for t in whole["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in whole["model"]["vocab"].items()
                 if token not in marks}
        fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=marks)
        split = whole.get("pre_tokenizer") or {}
        plain = whole.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
        slow: list = []  # made for the first text that needs it

        def encode(text: str) -> np.ndarray:
            if plain and (len(text) < LONG_RUN or longest_run(text) < LONG_RUN):
                return fast.encode_to_numpy(text, allowed_special="all")
            if not slow:
                slow.append(tokenizers.Tokenizer.from_file(path))
                slow[0].no_truncation()
                slow[0].no_padding()
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def cuts(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: whole windows, then the rest."""
    return [(s, min(window, n - s)) for s in range(0, n, window)]


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): the documents' pieces. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        tail = int(end_id).to_bytes(4, "little")
        for batch in batches:
            at, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                raw = (encode(text).astype("<u4").tobytes() if text else b"") + tail
                for s, n in cuts(len(raw) // 4, window):
                    part = raw[4 * s:4 * (s + n)]
                    at.append(i)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    total.append(len(raw) // 4)
                    ids.append(part)
            out = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(ids, pa.binary())] if with_ids else out,
                                             names=[*names, "ids"] if with_ids else names)

    form = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, form).withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Pattern:
    """``copies`` windows of ``size`` tokens that hold pieces of these lengths, in order."""

    size: int
    lengths: tuple[int, ...]
    copies: int


class Stock:
    """How many pieces of each length are left, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.order = sorted(self.left)

    def take(self, lengths: list[int], copies: int) -> None:
        for n in lengths:
            self.left[n] -= copies
        for n in set(lengths):
            if not self.left[n]:
                del self.left[n]
                self.order.pop(bisect.bisect_left(self.order, n))

    def free(self, n: int, used: list[int]) -> bool:
        return self.left.get(n, 0) > used.count(n)

    def largest(self, most: int, used: list[int]) -> int | None:
        """The longest piece of at most ``most`` tokens that the window does not use up already."""
        for i in range(bisect.bisect_right(self.order, most) - 1, -1, -1):
            if self.free(self.order[i], used):
                return self.order[i]
        return None

    def pair(self, gap: int, used: list[int]) -> tuple[int, int] | None:
        """Two pieces that fill the gap exactly."""
        for a in reversed(self.order[:bisect.bisect_right(self.order, gap - 1)]):
            if 2 * a < gap:
                return None
            if self.free(a, used) and self.free(gap - a, [*used, a]):
                return a, gap - a
        return None


def filled(stock: Stock, size: int, first: int) -> list[int]:
    """A window that starts with a piece and is filled by the pieces that fit its gap best."""
    lengths = [first]
    gap = size - first
    while gap:
        if stock.free(gap, lengths):
            return [*lengths, gap]
        if two := stock.pair(gap, lengths):
            return [*lengths, *two]
        n = stock.largest(gap, lengths)
        if n is None:
            break
        lengths.append(n)
        gap -= n
    return lengths


def plan(counts: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[Pattern]:
    """Windows for so many pieces of each length; every piece gets one place."""
    stock, out, long = Stock(counts), [], tiers[-1]

    def use(size: int, lengths: list[int]) -> None:
        copies = min(stock.left[n] // lengths.count(n) for n in set(lengths))
        stock.take(lengths, copies)
        out.append(Pattern(size, tuple(lengths), copies))

    def pack(low: int, high: int, size: int, exact: bool) -> None:
        """Windows that start with a piece of low < length <= high, longest first."""
        n = high
        while (n := _at_most(stock.order, n)) > low:
            lengths = filled(stock, size, n)
            if exact and sum(lengths) < size:
                n -= 1
                continue
            use(size, lengths)

    pack(tiers[-2] if len(tiers) > 1 else 0, long, long, exact=False)
    for size, low in zip(tiers[-2::-1], [*tiers[-3::-1], 0], strict=True) if len(tiers) > 1 else []:
        pack(low, size, size, exact=True)
    pack(0, long, long, exact=False)
    return out


def _at_most(order: list[int], n: int) -> int:
    i = bisect.bisect_right(order, n)
    return order[i - 1] if i else 0


def places(patterns: list[Pattern], step_tokens: int = STEP_TOKENS) -> list[tuple[int, ...]]:
    """(length, first, last, sequence, offset, size, step groups, step base, first in tier) by range of numbers.

    Piece ``k`` of a length, first <= k <= last, lies in sequence + (k - first) at the offset.
    """
    windows: dict[int, int] = {}
    for p in patterns:
        windows[p.size] = windows.get(p.size, 0) + p.copies
    steps = {size: max(1, -(-n * size // step_tokens)) for size, n in windows.items()}
    base, at = {}, 0
    for size in sorted(steps):
        base[size] = at
        at += steps[size]
    rows, used, sequence, in_tier = [], {}, 0, dict.fromkeys(windows, 0)
    for p in patterns:
        offset = 0
        for n in p.lengths:
            k = used.get(n, 0)
            rows.append((n, k, k + p.copies - 1, sequence, offset, p.size, steps[p.size], base[p.size], in_tier[p.size]))
            used[n] = k + p.copies
            offset += n
        sequence += p.copies
        in_tier[p.size] += p.copies
    return rows


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS,
         id_col: str = "doc_id", text_col: str = "text", step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Every piece with its place: sequence_id, offset, window, step_group."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, vocabulary, end_id, tiers[-1], id_col, text_col), "pieces")
    counts = dict(cut.groupBy("length").count().collect())  # at most one row per length
    rows = places(plan(counts, tiers), step_tokens)
    form = ("length long, low long, high long, sequence long, offset long, window int, steps long, step_base long, "
            "in_tier long")
    table = F.broadcast(spark.createDataFrame(rows, form))  # bounded by the window's length, not by the data
    buckets = max(partitions(spark), sum(counts.values()) // 20_000)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(buckets)))
    sums = (cut.groupBy("length", "bucket").count()
            .withColumn("before", F.sum("count").over(
                Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
            .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")))
    own = Window.partitionBy("length", "bucket").orderBy(id_col, "start", "ids_crc32")
    numbered = cut.withColumn("k", F.row_number().over(own)).join(sums, ["length", "bucket"])
    numbered = numbered.withColumn("k", F.col("k") - 1 + F.col("before"))
    placed = numbered.join(table, (numbered["length"] == table["length"]) & F.col("k").between(F.col("low"), F.col("high")))
    shift = F.col("k") - F.col("low")
    return placed.select(
        id_col, "start", numbered["length"], "ids_crc32", "doc_tokens", (F.col("sequence") + shift).alias("sequence_id"),
        "offset", "window", (F.col("step_base") + F.pmod(F.col("in_tier") + shift, F.col("steps"))).alias("step_group"))


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str, end_id: int = 0, window: int = WINDOW,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids array<int>): the packed windows themselves, one group of at most a window per row."""
    cut = pieces(docs, vocabulary, end_id, window, id_col, text_col, with_ids=True).dropDuplicates(
        [id_col, "start", "ids_crc32"])
    both = placed.join(cut.select(id_col, "start", "ids_crc32", "ids"), [id_col, "start", "ids_crc32"])
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = both.groupBy("sequence_id").agg(rows.alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out = [np.frombuffer(b"".join(x["ids"] for x in r), "<u4").astype("int32") for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))],
                                             names=["sequence_id", "ids"])

    return joined.mapInArrow(run, "sequence_id long, ids array<int>")
