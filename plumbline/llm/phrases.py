"""Phrase collocation mining: exact counts of all phrases of two to five words that occur often enough, and the score of their weakest cut.

Method. Words are counted exactly through the dictionaries of blocks (``wordblocks``); frequent ones get numbers. Then level by level,
a phrase of m + 1 words is the pair of the numbers of its first m and its last m words, both frequent (what Apriori allows; no
frequent phrase is lost), one exact 64-bit key. On each level

1. mappers count hashes of the keys into numpy arrays (``bincount``), which are summed as a tree; a key whose cell stays below
   the least count cannot be frequent;
2. the keys left are the candidates. A minimal perfect hash gives each a slot, and a table of keys by slot tells strangers apart;
3. mappers count slots (``bincount`` again), arrays are summed as a tree, and counts are read by slot, exact.

Cuts are read by slot too: the count of a phrase's beginning and end of any length come with the phrases of the level below.

Scale. The tables of a level are split into parts of at most TABLE_KEYS keys; only one part is in a task's memory at a time, and
the driver, too, holds one at a time. The array of step 1 has FILTER_CELLS cells whatever the input. Beyond about a hundred million
frequent phrases raise both with the executors' memory: every block is looked up in every part.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each; equal scores are ordered by
count, then phrase by bytes; an empty table gives no rows. Columns other than text and language are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, wordblocks
from .wordblocks import batches, pack, unpack

LEAST, LONGEST, TOP = 100, 5, 2000
#: Cells of the array that rules out keys; cells and slots of one row of an array.
FILTER_CELLS, ROW_CELLS = 1 << 23, 1 << 16
#: Keys in one part of a table, unless one shard has more; candidates that a task unites before it sends them on.
TABLE_KEYS, HELD_KEYS = 1 << 21, 1 << 21
#: Arrays that one task of the first step of a tree adds up.
FAN_IN = 32
#: Code points of a block of texts.
BLOCK_CHARS = 8_000_000
#: Words, and what ends a piece, a token each; no word has one of these signs.
TOKENS = re.compile("[^ \t.,;:!?\x0a-\x0d]+|[.,;:!?\x0a-\x0d]")
BREAKS = frozenset(b".,;:!?\x0a\x0b\x0c\x0d"[i:i + 1] for i in range(10))


def chunks(text: str) -> Iterator[str]:
    """Stretches between spaces, then the end of the text as one of its own. Only A to Z are lower-cased."""
    return chain(text.encode().lower().decode().split(" "), ".")


# -- arrays of counts, summed as a tree -------------------------------------------


class Cells:
    """An array of counts in 32 bits, one flat array if it has few rows; else rows in use, given up when there are too many to hold."""

    def __init__(self, size: int, most: int = 256):
        self.most = most
        rows = -(-size // ROW_CELLS)
        self.flat = np.zeros(rows * ROW_CELLS, np.int32) if rows <= most else None
        self.rows: dict[int, np.ndarray] = {}

    def add(self, at: np.ndarray) -> Iterator[dict]:
        """Counts cells; gives rows of counts if there is no more room."""
        if self.flat is not None:
            np.add.at(self.flat, at, 1)
            return
        at = np.sort(at)
        for some in np.split(at, np.flatnonzero(np.diff(at // ROW_CELLS)) + 1):
            if len(some):
                row = int(some[0]) // ROW_CELLS
                if row not in self.rows:
                    self.rows[row] = np.zeros(ROW_CELLS, np.int32)
                self.rows[row] += np.bincount(some % ROW_CELLS, minlength=ROW_CELLS).astype(np.int32)
        if len(self.rows) > self.most:
            yield from self.given()

    def given(self) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        if self.flat is not None:
            self.rows = {i: c for i, c in enumerate(self.flat.reshape(-1, ROW_CELLS)) if c.any()}
        for row, counts in sorted(self.rows.items()):
            yield array_row(row, part, counts.astype(np.int64))
        self.rows = {}


def array_row(cell: int, part: int, counts: np.ndarray) -> dict:
    return {"cell": cell, "part": part, "low": pack((counts & 0xFFFFFFFF).astype(np.uint32)), "high": pack((counts >> 32).astype(np.uint32)) if counts.max() >> 32 else None}


ARRAY_FORM = "cell long, part long, low binary, high binary"
ARRAY_SCHEMA = pa.schema([("cell", pa.int64()), ("part", pa.int64()), ("low", pa.binary()), ("high", pa.binary())])


def array_of(low: bytes, high: bytes | None) -> np.ndarray:
    out = unpack(low).astype(np.int64)
    return out if high is None else out + (unpack(high).astype(np.int64) << 32)


def tree_sum(rows: DataFrame) -> DataFrame:
    """One row a cell with the sum of all arrays, in two steps of shuffles; a task holds one array at a time."""
    n = common.partitions(rows.sparkSession)

    def add(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            now, total = None, None
            for batch in found:
                for i in range(batch.num_rows):
                    cell, part, low, high = (batch.column(j)[i].as_py() for j in range(4))
                    if (cell, part) != now:
                        if now is not None:
                            yield array_row(*now, total)
                        now, total = (cell, part), array_of(low, high)
                    else:
                        total = total + array_of(low, high)
            if now is not None:
                yield array_row(*now, total)

        yield from batches(out(), ARRAY_SCHEMA)

    for part in (F.expr(f"part div {FAN_IN}"), F.lit(0).cast("long")):
        rows = rows.withColumn("part", part).repartition(n, "cell", "part").sortWithinPartitions("cell", "part").mapInArrow(add, ARRAY_FORM)
    return rows


def enough(summed: DataFrame, least: int) -> DataFrame:
    """(cell, bits): which counts of each row reach the least, as packed bits."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            bits = [np.packbits(array_of(low.as_py(), high.as_py()) >= least).tobytes() for low, high in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["cell", "bits"])

    return summed.select("cell", "low", "high").mapInArrow(run, "cell long, bits binary")


# -- minimal perfect hash with stored keys ----------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def build(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(bits of each level, keys by slot) of distinct keys.

    A level holds twice as many bits as keys are left; keys that are alone on their bit are placed there, the others go
    to the next level. A key's slot is how many bits are set before its own.
    """
    levels, placed, left = [], [], keys
    while len(left):
        at = (mixed(left, len(levels) + 1) % np.uint64(2 * len(left))).astype(np.int64)
        alone = np.bincount(at, minlength=2 * len(left)) == 1
        mine = alone[at]
        order = np.argsort(at[mine], kind="stable")
        placed.append(left[mine][order])
        levels.append(alone)
        left = left[~mine]
    return levels, np.concatenate(placed) if placed else np.zeros(0, np.int64)


class Table:
    """Hash functions of many shards side by side, with the keys by slot; looks up whole arrays."""

    def __init__(self, shards: list[tuple[int, bytes, bytes, bytes]], count: int, first: int):
        """shards: (shard, sizes of levels, bits, keys), in order; count: shards of the whole level; first: the number of slot 0."""
        self.count, self.first = count, first
        sizes = {s: unpack(z).astype(np.int64) for s, z, _, _ in shards}
        depth = max((len(z) for z in sizes.values()), default=0)
        self.base = np.zeros((depth, count), np.int64)
        self.size = np.zeros((depth, count), np.int64)
        at = 0
        for s, z in sizes.items():
            for level, n in enumerate(z.tolist()):
                self.base[level, s], self.size[level, s] = at, n
                at += n
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(sizes[s].sum())) for s, _, b, _ in shards]
        packed = np.packbits(np.concatenate([*bits, np.zeros(64, np.uint8)]), bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8")
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int32) - np.bitwise_count(self.words)
        self.keys = np.concatenate([np.frombuffer(k, "<i8") for _, _, _, k in shards]) if shards else np.zeros(0, np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key in this part, -1 for those that are not in it."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        shard = shard_of(keys, self.count)
        left = np.flatnonzero(self.size[0][shard] > 0)
        for level in range(len(self.size)):
            size = self.size[level][shard[left]]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.base[level][shard[left]] + (mixed(keys[left], level + 1) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)) > 0
            lower = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(lower)
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        out[found[self.keys[out[found]] != keys[found]]] = -1
        return out


def shard_of(keys: np.ndarray, count: int) -> np.ndarray:
    return (mixed(keys, 0) % np.uint64(count)).astype(np.int64)


RUN_SCHEMA = pa.schema([("shard", pa.int64()), ("keys", pa.binary())])


def as_runs(keys: np.ndarray, shards: int) -> Iterator[dict]:
    """The keys of each shard, in order."""
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(some):
            yield {"shard": int(shard[some[0]]), "keys": keys[some].astype("<i8").tobytes()}


class Level:
    """The tables of one level: saved shards, and parts of them as broadcast variables of bounded size."""

    def __init__(self, spark: SparkSession, runs: DataFrame, name: str, table_keys: int):
        """runs: (shard, keys), sorted runs of keys that tasks have found; every shard's are united, and placed in one step."""
        self.spark = spark
        n = common.partitions(spark)
        self.count = count = wordblocks.bucket_count(runs)
        schema = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("sizes", pa.binary()), ("bits", pa.binary()), ("keys", pa.binary())])

        def place(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out() -> Iterator[dict]:
                now, keys = None, np.zeros(0, np.int64)
                for batch in found:
                    for shard, run in zip(batch.column(0), batch.column(1), strict=True):
                        if shard.as_py() != now:
                            if now is not None:
                                yield row(now, keys)
                            now, keys = shard.as_py(), np.zeros(0, np.int64)
                        keys = np.union1d(keys, np.frombuffer(run.as_py(), "<i8"))
                if now is not None:
                    yield row(now, keys)

            def row(shard: int, keys: np.ndarray) -> dict:
                levels, placed = build(keys)
                return {"shard": shard, "n": len(keys), "sizes": pack(np.array([len(b) for b in levels], np.uint32)),
                        "bits": np.packbits(np.concatenate(levels)).tobytes(), "keys": placed.astype("<i8").tobytes()}

            yield from batches(out(), schema)

        placed = runs.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(place, "shard long, n long, sizes binary, bits binary, keys binary")
        self.shards = common.saved(placed, name)
        self.total, first, held = 0, 0, 0
        self.tables: list = []
        bounds = [0]
        for shard, keys in sorted(self.shards.select("shard", "n").collect()):  # a number for each shard
            if held and held + keys > table_keys:
                bounds.append(shard)
                held = 0
            held += keys
            self.total += keys
        for low, high in zip(bounds, [*bounds[1:], count], strict=True):
            table = Table(self.part(low, high), count, first)
            self.tables.append(spark.sparkContext.broadcast(table))
            first += -(-len(table.keys) // ROW_CELLS) * ROW_CELLS  # a row of counts belongs to one part
        self.slots = first
        if first >= 1 << 31:
            raise ValueError("more than 2**31 candidates on one level; raise the least count")

    def part(self, low: int, high: int) -> list[tuple]:
        inside = (F.col("shard") >= low) & (F.col("shard") < high)
        return sorted(tuple(r) for r in self.shards.where(inside).select("shard", "sizes", "bits", "keys").collect())

    def keep(self, flags: DataFrame) -> None:
        """Forgets the keys of slots that are not frequent; flags: (cell, bits), read part by part."""
        fresh = []
        for b in self.tables:
            table = b.value
            row, rows = table.first // ROW_CELLS, -(-len(table.keys) // ROW_CELLS)
            bits = np.zeros((rows, ROW_CELLS), np.uint8)
            for cell, some in flags.where((F.col("cell") >= row) & (F.col("cell") < row + rows)).collect():
                bits[cell - row] = np.unpackbits(np.frombuffer(some, np.uint8))
            table.keys = np.where(bits.reshape(-1)[:len(table.keys)] > 0, table.keys, -1)
            fresh.append(self.spark.sparkContext.broadcast(table))
            b.unpersist()
        self.tables = fresh


def look_up(tables: list, keys: np.ndarray) -> np.ndarray:
    """Numbers of keys over all parts, -1 for strangers."""
    out = np.full(len(keys), -1, np.int64)
    for b in tables:
        slots = b.value.slots(keys)
        out = np.where(slots >= 0, slots + b.value.first, out)
    return out


def keys_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) wherever two numbers follow each other; -1 is no number."""
    at = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
    return at, numbers[at] << 32 | numbers[at + 1]


def read_by_slot(summed: DataFrame, tables: list, least: int) -> DataFrame:
    """(id, head, tail, f) of the slots whose count reaches the least."""
    firsts = [b.value.first for b in tables]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for cell, low, high in zip(*(batch.column(i) for i in range(3)), strict=True):
                first = cell.as_py() * ROW_CELLS
                table = tables[bisect_right(firsts, first) - 1].value
                counts = array_of(low.as_py(), high.as_py())
                at = np.flatnonzero(counts >= least)
                keys = table.keys[first - table.first + at]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (first + at, keys >> 32, keys & 0xFFFFFFFF, counts[at])], names=["id", "head", "tail", "f"])

    return summed.select("cell", "low", "high").mapInArrow(run, "id long, head long, tail long, f long")


def longer_phrases(level: DataFrame, frequent: DataFrame, name: str) -> DataFrame:
    """Phrases of one word more, with the counts of their beginnings and ends, saved."""
    begin = level.select(F.col("id").alias("head"), "lang", "words", "heads")
    end = level.select(F.col("id").alias("tail"), F.element_at("words", -1).alias("last"), "tails")
    return common.saved(frequent.join(begin, "head").join(end, "tail").select(
        "id", "head", "tail", "lang", F.concat("words", F.array("last")).alias("words"), "f", F.concat("heads", F.array("f")).alias("heads"),
        F.concat("tails", F.array("f")).alias("tails")), name)


# -- the operator -----------------------------------------------------------------


def word_counts(found: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((lang, word, f) of frequent words, (lang, n), answers for blocks: a word's number + 1, or nothing).

    Words are counted per bucket while the dictionaries of blocks pass in order; the numbers of frequent ones go back.
    """
    spark = found.sparkSession
    n = common.partitions(spark)
    schema = pa.schema([("bucket", pa.int32()), ("lang", pa.binary()), ("word", pa.binary()), ("f", pa.int64())])

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            now, total = None, {}
            for batch in rows:
                for bucket, tags, words, uses in zip(*(batch.column(i) for i in range(4)), strict=True):
                    if bucket.as_py() != now:
                        yield from close(now, total)
                        now, total = bucket.as_py(), {}
                    for t, w, u in zip(wordblocks.unpack_bytes(tags.as_py()), wordblocks.unpack_bytes(words.as_py()), unpack(uses.as_py()).tolist(), strict=True):
                        total[t, w] = total.get((t, w), 0) + u
            yield from close(now, total)

        def close(bucket, total: dict) -> Iterator[dict]:
            sums: dict[bytes, int] = {}
            for (t, w), f in total.items():
                if w not in BREAKS:
                    sums[t] = sums.get(t, 0) + f
                    if f >= least:
                        yield {"bucket": bucket, "lang": t, "word": w, "f": f}
            for t, f in sums.items():
                yield {"bucket": bucket, "lang": t, "word": None, "f": f}

        yield from batches(out(), schema)

    dictionaries = found.where(f"bucket > {wordblocks.PLACES}")
    passed = dictionaries.select("bucket", "tags", "words", "uses").repartition(n, "bucket").sortWithinPartitions("bucket")
    counted = common.saved(passed.mapInArrow(count, "bucket int, lang binary, word binary, f long"), "words")
    totals = counted.where("word is null").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.sum("f").alias("n"))
    frequent = counted.where("word is not null")
    # Numbers run on from bucket to bucket; there is one row a bucket to add up.
    sizes = frequent.groupBy("bucket").count().collect()
    starts, at = {}, 0
    for bucket, c in sorted(sizes):
        starts[bucket] = at
        at += c
    if at >= 1 << 31:
        raise ValueError("more than 2**31 frequent words")
    offsets = spark.createDataFrame(sorted(starts.items()), "bucket int, start long")
    own = Window.partitionBy("bucket").orderBy("lang", "word")
    numbered = common.saved(frequent.join(F.broadcast(offsets), "bucket").select(
        "bucket", "lang", "word", "f", (F.col("start") + F.row_number().over(own) - 1).alias("id")), "word_numbers")

    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            now, known = None, {}
            for batch in rows:
                for block, bucket, tags, words, lang, word, i in zip(*(batch.column(j) for j in range(7)), strict=True):
                    if bucket.as_py() != now:
                        now, known = bucket.as_py(), {}
                    if i.as_py() is not None:
                        known[lang.as_py(), word.as_py()] = (i.as_py() + 1).to_bytes(4, "little")
                        continue
                    pairs = zip(wordblocks.unpack_bytes(tags.as_py()), wordblocks.unpack_bytes(words.as_py()), strict=True)
                    yield {"block": block.as_py(), "bucket": now} | wordblocks.answers([known.get(p, b"") for p in pairs])

        yield from batches(out(), wordblocks.ANSWER_SCHEMA)

    none = lambda kind: F.lit(None).cast(kind)
    asked = dictionaries.select("block", "bucket", "tags", "words", none("binary").alias("lang"), none("binary").alias("word"), none("long").alias("id"))
    told = numbered.select(none("long").alias("block"), "bucket", none("binary").alias("tags"), none("binary").alias("words"), "lang", "word", "id")
    made = told.union(asked).repartition(n, "bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first()).mapInArrow(
        answer, wordblocks.ANSWERS)
    return numbered.select("id", F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("word"), "f"), totals, made


STREAM_FORM = "numbers binary, cell long, part long, low binary, high binary"
STREAM_SCHEMA = pa.schema([("numbers", pa.binary()), *ARRAY_SCHEMA])


def with_filter(stream: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], cells: int) -> Callable:
    """Task that passes numbers on and adds the array of hashed keys of all of its rows."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            counts = Cells(cells)
            for numbers in stream(found):
                _, keys = keys_of(numbers)
                if len(keys):
                    yield from counts.add(cell_of(keys, cells))
                    yield {"numbers": pack((numbers + 1).astype(np.uint32))}
            yield from counts.given()

        yield from batches(({**dict.fromkeys(STREAM_SCHEMA.names), **r} for r in out()), STREAM_SCHEMA)

    return run


def cell_of(keys: np.ndarray, cells: int) -> np.ndarray:
    return (mixed(keys, 77) % np.uint64(cells)).astype(np.int64)


def numbers_in(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for cell in batch.column(0):
        yield unpack(cell.as_py()).astype(np.int64) - 1


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
         filter_cells: int = FILTER_CELLS, table_keys: int = TABLE_KEYS) -> tuple[DataFrame, DataFrame]:
    """((lang, words, f, heads, tails, whole) of all frequent phrases of 1 to ``longest`` words, (lang, n)).

    heads and tails are the counts of a phrase's first and last 1, 2, ... words, up to the whole; ``whole`` tells that a phrase one word longer
    contains it and is as frequent.
    """
    spark = docs.sparkSession
    tagged = docs.select(F.lit(0).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("tag"))
    found = wordblocks.blocks(tagged, "key", "text", lambda: (chunks, TOKENS.findall), tag="tag", uses=True, name="phrase_words", most_chars=BLOCK_CHARS)
    words, totals, answers = word_counts(found, least)

    def as_numbers(start: np.ndarray, length: np.ndarray, flat: np.ndarray, keys: list, sizes: np.ndarray, codes: np.ndarray) -> Iterator[dict]:
        number = np.zeros(len(length), np.uint32)
        number[length > 0] = flat[start[length > 0]]
        yield {"numbers": pack(number[codes])}

    stream = common.saved(wordblocks.with_texts(found, answers, as_numbers, "numbers binary", pa.schema([("numbers", pa.binary())])), "numbers")
    level = words.select("id", "lang", F.array("word").alias("words"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    phrases = [level]
    tables: list = []
    for size in range(2, longest + 1):
        deeper = tables

        def renumbered(found: Iterator[pa.RecordBatch], tables=deeper) -> Iterator[np.ndarray]:
            for batch in found:
                for numbers in numbers_in(batch):
                    if tables:
                        at, keys = keys_of(numbers)
                        longer = np.full(len(numbers), -1, np.int64)
                        longer[at] = look_up(tables, keys)
                        numbers = longer
                    yield numbers

        both = common.saved(stream.mapInArrow(with_filter(renumbered, filter_cells), STREAM_FORM), f"stream{size}")
        stream = both.where("numbers is not null").select("numbers")
        passing = np.zeros(-(-filter_cells // ROW_CELLS) * ROW_CELLS // 8, np.uint8)
        for cell, bits in enough(tree_sum(both.where("cell is not null").select("cell", "part", "low", "high")), least).collect():
            passing[cell * ROW_CELLS // 8:(cell + 1) * ROW_CELLS // 8] = np.frombuffer(bits, np.uint8)
        sent = spark.sparkContext.broadcast(passing)

        shards = wordblocks.bucket_count(stream)

        def candidates(found: Iterator[pa.RecordBatch], sent=sent, shards=shards) -> Iterator[pa.RecordBatch]:
            def out() -> Iterator[dict]:
                bits = np.unpackbits(sent.value, count=filter_cells)
                held = np.zeros(0, np.int64)
                for batch in found:
                    for numbers in numbers_in(batch):
                        keys = np.unique(keys_of(numbers)[1])
                        held = np.union1d(held, keys[bits[cell_of(keys, filter_cells)] > 0])
                        if len(held) > HELD_KEYS:
                            yield from as_runs(held, shards)
                            held = held[:0]
                yield from as_runs(held, shards)

            yield from batches(out(), RUN_SCHEMA)

        made = Level(spark, stream.mapInArrow(candidates, "shard long, keys binary"), f"tables{size}", table_keys)
        if not made.total:
            break
        tables = made.tables

        def counts(found: Iterator[pa.RecordBatch], tables=tables, slots=made.slots) -> Iterator[pa.RecordBatch]:
            def out() -> Iterator[dict]:
                total = Cells(slots)
                for batch in found:
                    for numbers in numbers_in(batch):
                        at = look_up(tables, keys_of(numbers)[1])
                        yield from total.add(at[at >= 0])
                yield from total.given()

            yield from batches(out(), ARRAY_SCHEMA)

        summed = common.saved(tree_sum(stream.mapInArrow(counts, ARRAY_FORM)), f"counts{size}")
        frequent = read_by_slot(summed, tables, least)
        level = longer_phrases(level, frequent, f"phrases{size}")
        phrases.append(level)
        made.keep(enough(summed, least))
        tables = made.tables
    marked = []
    for shorter, longer in zip(phrases, [*phrases[1:], None], strict=True):
        if longer is None:
            marked.append(shorter.withColumn("whole", F.lit(False)))
            continue
        best = longer.select(F.col("head").alias("id"), "f").union(longer.select(F.col("tail").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("f_longer"))
        marked.append(shorter.join(best, "id", "left").withColumn("whole", F.coalesce(F.col("f_longer") >= F.col("f"), F.lit(False))))
    columns = ["lang", "words", "f", "heads", "tails", "whole"]
    out = marked[0].select(*columns)
    for m in marked[1:]:
        out = out.union(m.select(*columns))
    return out, totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
                 filter_cells: int = FILTER_CELLS, table_keys: int = TABLE_KEYS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of two words or more.

    A phrase scores floor(1000 a n / (l r)) at its weakest cut; phrases that a longer one contains as often are left out.
    """
    found, totals = mine(docs, text, lang, least, longest, filter_cells, table_keys)
    return scored(found, common.saved(totals, "totals"), top)


def scored(found: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The best phrases of each language, of what ``mine`` gives."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    left, right = "heads[k - 1]", "tails[size(words) - k - 1]"
    cuts = F.expr(f"transform(sequence(1, size(words) - 1), k -> named_struct('score', ({wide('f')} * 1000 * {wide('n')}) div ({wide(left)} * {wide(right)}), "
                  f"'k', k, 'l', {left}, 'r', {right}))")
    own = found.where((F.size("words") > 1) & ~F.col("whole"))
    cut = common.with_small(own, totals, ["lang"]).select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "n",
                                                             F.array_min(cuts).alias("cut"))
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    # The best of a share of a language first, so that no task sorts all of its phrases.
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    some = cut.withColumn("at", F.row_number().over(shares)).where(F.col("at") <= top).drop("at")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
