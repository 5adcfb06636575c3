"""Byte-level BPE encoding and decoding of whole corpora, each distinct word encoded once.

Texts are split into words by the pattern of the vocabulary; words go with their positions into blocks (``wordblocks``),
the blocks' dictionaries through one shuffle by word, in which each distinct word is encoded once, and the ids back to the
blocks, where texts are put together by position. Decoding looks every id up in the token-byte table, whose size is that of
the vocabulary file and which every task therefore reads; asked for together with encoding, it is done in the same Python worker.

Defined results: a null or empty text has no ids and decodes to nothing; texts and words of any length are taken whole;
repeated rows each get a row; null ids of documents stay null. Columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordblocks

#: Bytes of a vocabulary that is sent to all tasks.
VOCABULARY_BYTES = 64_000_000
#: Words up to this many bytes are merged by scanning their pairs, longer ones by a heap.
SHORT = 24


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Rank by token, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        lines = f.read(VOCABULARY_BYTES + 1)
    if len(lines) > VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of more than {VOCABULARY_BYTES} bytes: {path}")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}


def token_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, bytes) of tokens by id; ids without a token have size -1."""
    start, size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64), np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
    at = 0
    for token, i in ranks.items():
        start[i], size[i] = at, len(token)
        at += len(token)
    return start, size, np.frombuffer(b"".join(ranks), np.uint8)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the pair of lowest rank, leftmost among equals, is merged until none is left."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return [ranks[p] for p in (_short(word, ranks) if len(word) <= SHORT else _long(word, ranks))]


def _short(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    parts = [word[i:i + 1] for i in range(len(word))]
    top = len(ranks) + (1 << 40)
    get = ranks.get
    scores = [get(a + b, top) for a, b in zip(parts, parts[1:], strict=False)]
    while scores:
        low = min(scores)
        if low == top:
            break
        i = scores.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i:
            scores[i - 1] = get(parts[i - 1] + parts[i], top)
        if i < len(scores):
            scores[i] = get(parts[i] + parts[i + 1], top)
    return parts


def _long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same with a heap of pairs over a linked list of ends, n log n for a word of n bytes."""
    n, get = len(word), ranks.get
    end = list(range(1, n + 1))  # where the part that begins here ends; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(word[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := get(word[i:end[stop]])) is not None:
                heappush(heap, (rank, i, end[stop]))
        h = before[i]
        if h >= 0 and (rank := get(word[h:stop])) is not None:
            heappush(heap, (rank, h, stop))
    parts, i = [], 0
    while i < n:
        parts.append(word[i:end[i]])
        i = end[i]
    return parts


@lru_cache(maxsize=1)
def letters_apart() -> str:
    """Code points that this machine's ``regex`` counts among letters or numbers and the tokenizer library does not.

    Both are asked once for each code point; the two follow different versions of Unicode.
    """
    import tiktoken

    single = {bytes([b]): b for b in range(256)}

    def known(kind: str, every: str) -> str:
        return bytes(tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()

    return classes_apart(known)


def classes_apart(known: Callable[[str, str], str]) -> str:
    """Code points whose class differs; ``known(kind, text)`` gives the characters of a class that the library finds in a text."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    apart: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        own, theirs = set(regex.findall(kind, every)), set(known(kind, every))
        if theirs - own:
            raise ValueError("the tokenizer library knows letters or numbers that the regex module does not")
        apart |= own - theirs
    return "".join(sorted(apart))


def code_ranges(chars: str) -> str:
    """The characters as ranges inside a class of a pattern."""
    out, i, codes = [], 0, [ord(c) for c in chars]
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\U{codes[i]:08x}-\\U{codes[j]:08x}")
        i = j + 1
    return "".join(out)


#: Two blanks in a row, of which one is a space; most texts have none.
BLANKS = re.compile(r"\s | \s")
PAIRS = [p for c in " \t\n\r\x0b\x0c" for p in (c + " ", " " + c)]
CUTS = re.compile(r"(?<=\S)(?= \S)")


def chunks(text: str) -> Iterator[str]:
    """The text cut before single spaces between other signs, where every match of the patterns in use ends."""
    if any(p in text for p in PAIRS) if text.isascii() else BLANKS.search(text):
        return iter(CUTS.split(text))
    parts = text.split(" ")
    return chain(parts[:1], map(" ".__add__, islice(parts, 1, None)))


def splitter(pattern: str, apart: str) -> Callable[[str], list[str]]:
    """The function from a chunk of text to its words.

    Code points in ``apart`` (as class ranges) are neither letters nor numbers to the library; texts with one of them take a
    pattern that says so.
    """
    plain = regex.compile(pattern)
    if not apart:
        return plain.findall
    odd, strict = regex.compile(f"[{apart}]"), regex.compile(without(pattern, apart), regex.V1)
    return lambda text: (plain if text.isascii() or not odd.search(text) else strict).findall(text)


def without(pattern: str, apart: str) -> str:
    """The pattern, in the newer syntax of classes, with code points that are neither letters nor numbers in it."""
    rest = "[^\\s\\p{L}\\p{N}]"
    parts = pattern.split(rest)
    for kind in (r"\p{L}", r"\p{N}"):
        parts = [p.replace(f"[{kind}]", kind).replace(kind, f"[{kind}--[{apart}]]") for p in parts]
    return f"[{rest}||[{apart}]]".join(parts)


#: Ids of a long text that are decoded at a time.
STEP = 1 << 18


@lru_cache(maxsize=2)
def decoder(vocabulary: str) -> Callable[[np.ndarray], bytes]:
    """The function from ids to their bytes, by the token-byte table; an id without a token is an error."""
    start, size, data = token_table(read_ranks(vocabulary))

    def run(ids: np.ndarray) -> bytes:
        if len(ids) and (int(ids.max()) >= len(size) or (size[ids] < 0).any()):
            raise ValueError("an id has no token")
        parts = (ids[i:i + STEP] for i in range(0, len(ids), STEP))
        return b"".join(wordblocks.gather(start[p], size[p], data).tobytes() for p in parts)

    return run


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids) of each row; ids as little-endian unsigned 32-bit integers. Two shuffles, of dictionaries and of word numbers.

    With ``decoded`` also what decode gives for the ids, made from them in the same task: a second Python worker beside each
    would take the memory of the first once more.
    """
    apart = code_ranges(letters_apart())
    found = wordblocks.blocks(docs, id_col, text_col, lambda: (chunks, splitter(pattern, apart)), name="pretokens")

    def encoder() -> Callable[[list[bytes]], list[bytes]]:
        ranks = read_ranks(vocabulary)
        return lambda words: [np.array(merge_word(w, ranks), "<u4").tobytes() for w in words]

    def put_together(start: np.ndarray, length: np.ndarray, flat: np.ndarray, keys: list, sizes: np.ndarray, codes: np.ndarray) -> Iterator[dict]:
        text_of = decoder(vocabulary) if decoded else None
        at = 0
        for key, n in zip(keys, sizes.tolist(), strict=True):
            mine = codes[at:at + n]
            at += n
            ids = wordblocks.gather(start[mine], length[mine], flat).astype("<u4").tobytes()
            yield {"id": key, "ids": ids} | ({"decoded": text_of(np.frombuffer(ids, "<u4"))} if text_of else {})

    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("id", wordblocks.arrow_type(docs, id_col)), ("ids", pa.binary()), *([("decoded", pa.binary())] if decoded else [])])
    made = wordblocks.each_word(found, encoder)
    form = f"id {kind}, ids binary" + ", decoded binary" * decoded
    return wordblocks.with_texts(found, made, put_together, form, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``: bytes of their ids, by a join with the token-byte table that every task holds.

    An id without a token fails the job; a null list of ids decodes to null.
    """
    out = encoded.schema.names
    at = out.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = decoder(vocabulary)
        for batch in batches:
            raw = (cell.as_py() for cell in batch.column(at))
            texts = [None if x is None else text_of(np.frombuffer(x, "<u4")) for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*out, "decoded"])

    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"
    return encoded.mapInArrow(run, form)


def encoded_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    found = encode(docs, vocabulary, pattern, id_col, text_col, decoded=True)
    return found.select(F.col(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
