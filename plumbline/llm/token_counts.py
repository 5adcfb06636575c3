"""Token counts by byte-pair merging, without making identifiers.

A word's symbols form a linked list, and its adjacent pairs that have a rank a heap. The
lowest pair (leftmost among equals) is popped and merged until none is left; the count is
the number of first symbols minus the merges. The vocabulary file is a parameter.

Defined results: a null or empty text has 0 tokens; any length of text is counted whole.
Repeated rows each get a row. Columns other than id and text are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import classes_apart, code_ranges, splitter

LIMIT = 2048
#: Small letters of Unicode 16 and 17 that Python's tables may lack, by capital letter.
NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
         **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
#: Words whose counts a worker keeps; the store starts anew when full.
CACHE_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + len(chars) - len(shown))
    return [chars[b] for b in range(256)]


@lru_cache(maxsize=1)
def letters_apart() -> str:
    """Letters and numbers of ``regex`` that the ``tokenizers`` library does not know, as it follows an older version of Unicode."""
    from tokenizers import Regex, pre_tokenizers

    def known(kind: str, every: str) -> str:
        return "".join(w for w, _ in pre_tokenizers.Split(Regex(f"{kind}+"), "removed", invert=True).pre_tokenize_str(every))

    return classes_apart(known)


class PairMerger:
    """Counts tokens of words and texts for one vocabulary file in the ``tokenizers`` format."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, apart: str | None = None):
        """apart: letters and numbers of ``regex`` that the library does not know, as ranges; asked for if left out."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.vocab = vocab
        size = max(vocab.values()) + 1
        self.size = size
        #: pair of symbols, as one number -> rank and merged symbol, as one number
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[a] * size + vocab[b]] = rank * size + vocab[a + b]
        symbols = byte_symbols()
        self.first = [vocab.get(s, -1) for s in symbols]
        self.last = [vocab.get(s + self.end, -1) for s in symbols]
        steps = (whole.get("normalizer") or {}).get("normalizers", [whole.get("normalizer") or {}])
        kinds = {s.get("type") for s in steps}
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pre = whole["pre_tokenizer"]
        split = next(s for s in pre["pretokenizers"] if s["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
        self.words = splitter(pattern, code_ranges(letters_apart()) if apart is None else apart)
        marks = [t["content"] for t in whole["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(marks, key=len, reverse=True)))) if marks else None
        self.cache: dict[str, int] = {}
        self.cache_words = cache_words

    def merged(self, word: str) -> int:
        """Tokens of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        first = self.first
        ids = [first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if -1 in ids:
            ids = [i for i in ids if i >= 0]
        n = len(ids)
        if n < 2:
            return n
        pairs, size = self.pairs, self.size
        heap = []
        for i in range(n - 1):
            found = pairs.get(ids[i] * size + ids[i + 1])
            if found is not None:
                heap.append((found // size, i, found % size, ids[i], ids[i + 1]))
        if not heap:
            return n
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        left = n
        while heap:
            _, i, new, a, b = heappop(heap)
            if ids[i] != a:
                continue
            j = after[i]
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get(new * size + ids[k])
                if found is not None:
                    heappush(heap, (found // size, i, found % size, new, ids[k]))
            h = before[i]
            if h >= 0:
                found = pairs.get(ids[h] * size + new)
                if found is not None:
                    heappush(heap, (found // size, h, found % size, ids[h], new))
        return left

    def plain(self, text: str) -> int:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            # Letter by letter, without the special rule for a final sigma.
            text = text.lower() if text.isascii() else text.replace("Σ", "σ").lower().translate(NEWER)
        total, cache = 0, self.cache
        for word in self.words(text):
            n = cache.get(word)
            if n is None:
                n = self.merged(word)
                if len(word) <= 64:
                    if len(cache) >= self.cache_words:
                        cache.clear()
                    cache[word] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<|" not in text and not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_MERGERS: dict[str, PairMerger] = {}


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row. No shuffle; workers reuse counts of frequent words."""
    kind = docs.schema[id_col].dataType.simpleString()
    apart = code_ranges(letters_apart())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _MERGERS.get(vocabulary)
        if merger is None:
            merger = _MERGERS[vocabulary] = PairMerger(vocabulary, apart=apart)
        for batch in batches:
            texts = batch.column(1)
            counts = [merger.count(t.as_py()) for t in texts]
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])

    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col).withColumn("over_limit", F.col("n_tokens") > limit)
