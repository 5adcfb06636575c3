"""Texts as numbers of their words, block by block, with each distinct word known once for all blocks.

A block is a run of whole texts that one task reads. It keeps a dictionary of its distinct words and, for every
text, the numbers of its words in order. Dictionaries go through one shuffle by word, where something is made of
each distinct word; the answers go back to the blocks by a second one. Occurrences never leave their block.

A block ends after BLOCK_CHARS code points or BLOCK_WORDS distinct words, so that its size is bounded for any
input; a single longer text is a block of its own.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

BLOCK_CHARS = 32_000_000
BLOCK_WORDS = 1_000_000
#: Words in a row of texts, unless one text has more.
ROW_WORDS = 1_000_000
#: Chunks of a long text that are taken at a time; code points of a chunk that is remembered.
STEP, CHUNK_KEPT = 1_000_000, 64


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte of equal weight, deflated."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    used = 4
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + zlib.compress(np.ascontiguousarray(planes[:used]).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    used = data[0]
    planes = np.frombuffer(zlib.decompress(memoryview(data)[1:]), np.uint8).reshape(used, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u4").reshape(-1)


def squeeze(data: bytes) -> bytes:
    """Deflated by an algorithm that also finds what is repeated far away; the size comes first."""
    return len(data).to_bytes(8, "little") + bytes(pa.Codec("zstd", compression_level=9).compress(data))


def unsqueeze(data: bytes) -> bytes:
    return bytes(pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little")))


#: Fixed values of the code for small numbers: below ONE a byte, then LOW leading bytes with one more, the others with two more.
ONE, LOW = 192, 40


def pack_ranks(numbers: np.ndarray) -> bytes:
    """Numbers of which small ones are frequent: leading bytes, second and third bytes, each deflated apart."""
    two, three = ONE, ONE + LOW * 256
    if len(numbers) and int(numbers.max()) >= three + (256 - ONE - LOW) * 65536:
        return b"\0" + pack(numbers)
    v = numbers.astype(np.int64)
    mid, far = (v >= two) & (v < three), v >= three
    lead = np.where(mid, ONE + (v - two >> 8), np.where(far, ONE + LOW + (v - three >> 16), v)).astype(np.uint8)
    rest = np.where(mid, v - two, v - three)[mid | far]
    parts = [squeeze(x.tobytes()) for x in (lead, (rest & 255).astype(np.uint8), ((v[far] - three) >> 8 & 255).astype(np.uint8))]
    return b"\1" + b"".join(len(p).to_bytes(4, "little") for p in parts[:2]) + b"".join(parts)


def unpack_ranks(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return unpack(data[1:])
    a, b = int.from_bytes(data[1:5], "little"), int.from_bytes(data[5:9], "little")
    lead, second, third = (np.frombuffer(unsqueeze(x), np.uint8).astype(np.int64) for x in (data[9:9 + a], data[9 + a:9 + a + b], data[9 + a + b:]))
    out = lead.copy()
    more = np.flatnonzero(lead >= ONE)
    value = np.where(lead[more] < ONE + LOW, ONE + ((lead[more] - ONE) << 8), ONE + LOW * 256 + ((lead[more] - ONE - LOW) << 16)) + second
    value[lead[more] >= ONE + LOW] += third << 8
    out[more] = value
    return out


def pack_bytes(parts: list[bytes]) -> bytes:
    sizes = pack(np.array([len(p) for p in parts], np.uint32))
    return len(sizes).to_bytes(4, "little") + sizes + squeeze(b"".join(parts))


def unpack_bytes(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpack(data[4:4 + n]), dtype=np.int64).tolist()
    body = unsqueeze(data[4 + n:])
    return [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def gather(start: np.ndarray, length: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start:start + length] over all pairs."""
    total = int(length.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(length)
    return flat[np.arange(total) + np.repeat(start - (ends - length), length)]


class Chunks(dict):
    """Numbers for chunks of text of one tag, in order of first use; a chunk's words are looked up once."""

    def __init__(self, block: Block, tag: str, words_of: Callable[[str], list[str]]):
        super().__init__()
        self.block, self.tag, self.words_of = block, tag, words_of
        self.numbers: dict[str, int] = {}

    def __missing__(self, chunk: str) -> int:
        block, numbers = self.block, self.numbers
        n = len(block.ends)
        for w in self.words_of(chunk):
            i = numbers.get(w)
            if i is None:
                i = numbers[w] = len(block.words)
                block.words.append(w)
                block.tag_of.append(self.tag)
            block.flat.append(i)
        block.ends.append(len(block.flat))
        if len(chunk) <= CHUNK_KEPT:
            self[chunk] = n
        return n


class Block:
    """Texts of one block while they are read: for each text the numbers of its chunks, for each chunk those of its words."""

    def __init__(self, number: int, most_chars: int):
        self.number, self.most_chars = number, most_chars
        self.words: list[str] = []
        self.tag_of: list[str] = []
        self.flat, self.ends = array("I"), array("Q")
        self.tags: dict[str, Chunks] = {}
        self.keys: list = []
        self.texts: list[np.ndarray] = []
        self.chars = 0

    def add(self, key, tag: str, chunks: Iterator[str], words_of: Callable[[str], list[str]], chars: int) -> None:
        known = self.tags.get(tag)
        if known is None:
            known = self.tags[tag] = Chunks(self, tag, words_of)
        parts = []
        while some := list(islice(chunks, STEP)):
            parts.append(np.fromiter(map(known.__getitem__, some), np.uint32, len(some)))
        self.keys.append(key)
        self.texts.append(parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32))
        self.chars += chars

    @property
    def full(self) -> bool:
        return self.chars >= self.most_chars or len(self.words) >= BLOCK_WORDS

    def rows(self, buckets: int, uses: bool) -> Iterator[dict]:
        """A row with the numbers of words in order of the dictionary, its rows by bucket, then rows of texts; frequent words have small numbers."""
        self.tags = {}
        flat, ends = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.ends, np.uint64).astype(np.int64)
        start = np.concatenate([np.zeros(1, np.int64), ends])[:-1]
        length = ends - start
        seen = np.zeros(len(ends), np.int64)
        for t in self.texts:
            np.add.at(seen, t, 1) if len(t) < len(seen) // 8 else np.add(seen, np.bincount(t, minlength=len(seen)), out=seen)
        used = np.bincount(flat, weights=np.repeat(seen, length), minlength=len(self.words)).astype(np.int64)
        by_use = np.argsort(-used, kind="stable")
        rank = np.empty(len(used), np.uint32)
        rank[by_use] = np.arange(len(used), dtype=np.uint32)
        if len(self.words):
            bucket = np.fromiter((zlib.crc32(w.encode(), zlib.crc32(t.encode())) % buckets for t, w in zip(self.tag_of, self.words, strict=True)), np.int64, len(self.words))
            order = np.argsort(bucket, kind="stable")
            places = []
            for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                those = sorted((self.tag_of[i].encode(), self.words[i].encode(), i) for i in some.tolist())
                at = np.array([i for _, _, i in those])
                yield {"block": self.number, "bucket": int(bucket[at[0]]), "tags": pack_bytes([t for t, _, _ in those]),
                       "words": pack_bytes([w for _, w, _ in those]), "uses": pack(used[at]) if uses else None}
                places.append(rank[at])
            yield {"block": self.number, "bucket": PLACES, "places": pack(np.concatenate(places))}
        self.words, self.tag_of = [], []
        ranked = rank[flat]
        keys, texts, total = [], [], 0
        for k, t in zip(self.keys, self.texts, strict=True):
            keys.append(k)
            texts.append(gather(start[t], length[t], ranked))
            total += len(texts[-1])
            if total >= ROW_WORDS:
                yield self._texts(keys, texts)
                keys, texts, total = [], [], 0
        if keys:
            yield self._texts(keys, texts)

    def _texts(self, keys: list, texts: list[np.ndarray]) -> dict:
        return {"block": self.number, "keys": keys, "sizes": pack(np.array([len(t) for t in texts], np.uint32)), "codes": pack_ranks(np.concatenate(texts))}


def batches(rows: Iterable[dict], schema: pa.Schema, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each of bounded bytes unless one row has more."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) if isinstance(v, (bytes, str)) else 16 * len(v) if isinstance(v, list) else 8 for v in r.values())
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def bucket_count(df: DataFrame) -> int:
    return 8 * common.partitions(df.sparkSession)


#: In place of a bucket, on the row with the numbers of a block's words.
PLACES = -1
#: Functions from a text to its chunks and from a chunk to its words; no word reaches over the end of a chunk.
Split = Callable[[], tuple[Callable[[str], Iterator[str]], Callable[[str], list[str]]]]


def blocks(docs: DataFrame, key: str, text: str, split: Split, tag: str | None = None, uses: bool = False,
           name: str = "blocks", most_chars: int | None = None) -> DataFrame:
    """Saved rows of dictionaries (bucket, tags, words, uses if asked for), of numbers (places) and of texts (keys, sizes, codes) of all blocks.

    ``split`` makes, in the task, what cuts texts into words. A null text has none. Blocks are saved, as
    their dictionaries and texts must be of one reading. ``most_chars``: code points of a block, BLOCK_CHARS if left out; smaller blocks take less
    memory and repeat more words.
    """
    most_chars = most_chars or BLOCK_CHARS
    buckets = bucket_count(docs)
    kind = docs.schema[key].dataType
    form = (f"block long, bucket int, tags binary, words binary, uses binary, places binary, keys array<{kind.simpleString()}>, "
            "sizes binary, codes binary")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks_of, words_of = split()
        part = TaskContext.get().partitionId()
        schema = None

        def rows() -> Iterator[dict]:
            nonlocal schema
            block, n = None, 0
            for batch in found:
                if schema is None:
                    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("tags", pa.binary()), ("words", pa.binary()), ("uses", pa.binary()),
                                        ("places", pa.binary()), ("keys", pa.list_(batch.schema.field(0).type)), ("sizes", pa.binary()), ("codes", pa.binary())])
                for k, t, g in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                    if block is None:
                        block = Block(part << 32 | n, most_chars)
                        n += 1
                    t = t.as_py() or ""
                    block.add(k.as_py(), g.as_py(), chunks_of(t), words_of, len(t))
                    if block.full:
                        yield from block.rows(buckets, uses)
                        block = None
            if block is not None:
                yield from block.rows(buckets, uses)

        made = rows()
        first = next(made, None)
        if first is not None:
            yield from batches(({**dict.fromkeys(schema.names), **r} for part in ([first], made) for r in part), schema)

    tags = F.lit("") if tag is None else F.col(tag)
    return common.saved(common.spread(docs.select(F.col(key), F.col(text), tags.alias("tag"))).mapInArrow(run, form), name)


ANSWERS = "block long, bucket int, sizes binary, made binary"
ANSWER_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("sizes", pa.binary()), ("made", pa.binary())])


def pack_runs(numbers: np.ndarray) -> bytes:
    """Numbers of which the same ones follow each other often, in two bytes each if they fit."""
    kind = "<u2" if not len(numbers) or int(numbers.max()) < 65536 else "<u4"
    return kind[-1].encode() + squeeze(numbers.astype(kind).tobytes())


def unpack_runs(data: bytes) -> np.ndarray:
    return np.frombuffer(unsqueeze(data[1:]), f"<u{data[:1].decode()}").astype(np.uint32)


def answers(parts: list[bytes]) -> dict:
    """Columns of a row of answers, each of them 32-bit numbers one after another."""
    return {"sizes": pack(np.array([len(p) // 4 for p in parts], np.uint32)), "made": pack_runs(np.frombuffer(b"".join(parts), "<u4"))}


def each_word(found: DataFrame, make: Callable[[], Callable[[list[bytes]], list[bytes]]]) -> DataFrame:
    """(block, bucket, sizes, made): the 32-bit numbers that ``make`` gives for the words of every dictionary; each distinct word is
    asked once a task.

    One shuffle by bucket of words. A task keeps the answers of its bucket, so its memory follows the distinct words of one bucket.
    """
    n = common.partitions(found.sparkSession)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = make()

        def rows() -> Iterator[dict]:
            known: dict[bytes, bytes] = {}
            now = None
            for batch in found:
                for b, k, w in zip(*(batch.column(i) for i in range(3)), strict=True):
                    if k.as_py() != now:
                        now, known = k.as_py(), {}
                    words = unpack_bytes(w.as_py())
                    new = [x for x in words if x not in known]
                    known.update(zip(new, ask(new), strict=True))
                    yield {"block": b.as_py(), "bucket": now} | answers([known[x] for x in words])

        yield from batches(rows(), ANSWER_SCHEMA)

    words = found.where(f"bucket > {PLACES}").select("block", "bucket", "words")
    return words.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWERS)


Use = Callable[[np.ndarray, np.ndarray, np.ndarray, list, np.ndarray, np.ndarray], Iterator[dict]]


def with_texts(found: DataFrame, made: DataFrame, use: Use, form: str, schema: pa.Schema) -> DataFrame:
    """Rows that ``use(start, length, flat, keys, sizes, codes)`` gives for each row of texts.

    The answer to word i of the block is flat[start[i]:start[i] + length[i]]. Answers come first in the sorted partition, so a task
    holds one block's at a time.
    """
    n = common.partitions(found.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    texts = found.where(f"bucket is null or bucket = {PLACES}").select("block", "bucket", "places", "sizes", none("binary").alias("made"), "keys", "codes")
    words = made.select("block", "bucket", none("binary").alias("places"), "sizes", "made", none(found.schema["keys"].dataType).alias("keys"), none("binary").alias("codes"))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            now, order, parts, told = None, None, [], None
            for batch in found:
                for i in range(batch.num_rows):
                    block, bucket, places, sizes, made, keys, codes = (batch.column(j)[i].as_py() for j in range(7))
                    if block != now:
                        now, order, parts, told = block, None, [], None
                    if bucket == PLACES:
                        order = unpack(places)
                        continue
                    if bucket is not None:
                        parts.append((unpack(sizes), unpack_runs(made)))
                        continue
                    if told is None:
                        told, parts = in_order(order, parts), []
                    yield from use(*told, keys, unpack(sizes), unpack_ranks(codes))

        yield from batches(rows(), schema)

    return words.union(texts).repartition(n, "block").sortWithinPartitions("block", F.col("bucket").asc_nulls_last()).mapInArrow(run, form)


def in_order(order: np.ndarray | None, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, flat) by number of the word, of answers in order of buckets."""
    if order is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    sizes, flat = (np.concatenate([p[i] for p in parts]) for i in range(2))
    start, length = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    length[order] = sizes
    start[order] = np.cumsum(sizes, dtype=np.int64) - sizes
    return start, length, flat
