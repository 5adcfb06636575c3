"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The terms are all words, and beginnings of words that go with the label: those of four to eight letters whose presence is
associated with it among the examples (chi-square). Terms of the examples are indexed, and other words of a text count in
its length. Document frequencies of all are counted over all documents. The examples' vectors
form an inverted index in blocks of examples. A query reads the postings of its rare terms whole.
Those of frequent terms lie block by block, beside the largest weight of each term in each block;
a block's bound is its best score by rare terms plus what the largest weights add. The blocks of
highest bound are read first, and then only those whose bound reaches the k-th best score so far.
The best are scored again in double precision, so the result is exact. The neighbours vote
with weights that are their cosines, and they are the evidence. The score is a logistic function of the
vote that never falls as the vote grows, fitted on the examples' own votes, each without itself. Nothing else enters it.

``max_examples`` bounds the labelled rows per class that are learnt from (those with the
smallest hash of the id); all else covers all documents. Index and terms are bounded by it, so
they can be sent to every task; they travel as term numbers and counts, and each worker makes
its postings once.

Defined results: null and empty texts, and texts without any word, get the share of
toxic examples without words; missing labels and a class without examples give the
base rate; repeated ids and rows each get a row. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, saved, spread, with_small

FOLDS = 5
MAX_EXAMPLES = 6000
MIN_CHI2 = 15.0
NEIGHBOURS = 8
BLOCK = 64
#: Blocks that a query reads before it knows a k-th best score; texts that are read, or searched for, together;
#: examples of which postings are made together. Results do not depend on them.
FIRST_BLOCKS = 8
TOGETHER = 256
EXAMPLES = 512
#: Terms are frequent if at least this share of the examples has them; at most so many are, for memory. Results do not depend on it.
FREQUENT = 1 / 16
MOST_FREQUENT = 1024
#: Single-precision scores are this close to exact ones, with room to spare.
SLACK = 1e-5
#: Pseudo-similarity that the base rate votes with.
PRIOR_VOTES = 0.25

#: A word that no example has and that more than this share of the documents has is joined by broadcast;
#: a text has only so many words, so there are at most this many times the words of a mean text.
OFTEN = 1 / 1000

#: Lengths of the word beginnings that may be terms beside whole words.
HEADS = (4, 5, 6, 7, 8)

_NONE = np.zeros(0, np.int64)
_WORDS = re.compile(r"[^\W_]+").findall


def terms(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def beginnings(word: str) -> list[str]:
    """The beginnings of a word, which its endings do not hide; no word ends with their sign."""
    return [f"{word[:k]}*" for k in HEADS if len(word) >= k]


def heads(known: dict[str, int]) -> set[str]:
    """What known beginnings begin with; words that begin otherwise need no closer look."""
    return {w[:HEADS[0]] for w in known}


def marks_in(words: Iterable[str], known: dict[str, int], begins: set[str]) -> list[int]:
    """The known beginnings of words, by number, one word after the other."""
    return [known[f] for w in words if w[:HEADS[0]] in begins for f in beginnings(w) if f in known]


def all_terms(text: str | None, known: dict[str, int], begins: set[str]) -> Counter:
    """How often a text has each word and each known beginning."""
    seen = Counter(terms(text))
    out = Counter(seen)
    for w, n in seen.items():
        if w[:HEADS[0]] in begins:
            for f in beginnings(w):
                if f in known:
                    out[f] += n
    return out


def ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers from each a up to its b, one range after the other."""
    n = b - a
    return np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)


def fold(id_col: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.pmod(F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")), F.lit(folds))


def largest_of(e: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores with their examples; of equal ones at the edge, the lowest examples."""
    if len(s) <= k:
        return e, s
    edge = np.partition(s, len(s) - k)[len(s) - k]
    above, level = np.flatnonzero(s > edge), np.flatnonzero(s == edge)
    level = level[np.argsort(e[level], kind="stable")[:k - len(above)]]
    keep = np.concatenate([above, level])
    return e[keep], s[keep]


def width_of(most: int) -> int:
    """Bytes that integers from 0 to most need."""
    return 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4


def packed(a: np.ndarray) -> bytes:
    """Integers from 0 in as few bytes each as the largest needs, after that number."""
    width = width_of(int(a.max(initial=0)))
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


@dataclass
class Lists:
    """What a search reads, made from the examples' word numbers and counts."""

    length: np.ndarray  # of each example's vector before it is scaled to 1, in double precision
    example: np.ndarray  # of words that are not frequent, by word and example, as is weight, in single precision
    weight: np.ndarray
    at: np.ndarray  # where the postings of each word begin, among those of all
    frequent: int  # words below this number are frequent
    blocks: np.ndarray  # weights of frequent words: examples, padded to whole blocks, x words
    largest: np.ndarray  # blocks x words
    same: np.ndarray  # the first example with an equal vector


@dataclass
class Index:
    """Examples as an inverted index in blocks, with the fit that calibrates votes. A word of it is any term: a word or a beginning."""

    words: dict[str, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    total: int = 0
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Of each example, where its words begin; the words and how often it has them.
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    word: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    base: float = 0.5
    featureless: float = 0.5
    slope: float = 1.0
    shift: float = 0.0
    #: Beginnings that are terms, and what they begin with.
    marks: dict[str, int] = field(default_factory=dict)
    begins: set[str] = field(default_factory=set)
    lists: Lists | None = field(default=None, repr=False, compare=False)

    def to_send(self) -> Index:
        """What searches need, without what only reading texts needs."""
        return replace(self, words={}, marks={}, begins=set(), lists=None)

    def vector(self, text: str | None, df: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text and their weights, of length 1 together; df has the document frequencies of words outside the examples."""
        seen = all_terms(text, self.marks, self.begins)
        found = sorted((self.words[w], n) for w, n in seen.items() if w in self.words)
        others = sum(((1 + math.log(n)) * idf(self.total, (df or {}).get(w, 0)))**2 for w, n in seen.items() if w not in self.words)
        return self.weigh(np.array([w for w, _ in found], np.int64), np.array([n for _, n in found], np.int64), others)

    def weigh(self, found: np.ndarray, counts: np.ndarray, others: float) -> tuple[np.ndarray, np.ndarray]:
        """Ascending words and their weights; a last one is that of all words which no example has, others the sum of their squares."""
        value = np.append((1 + np.log(counts)) * self.idf[found], math.sqrt(others))
        size = np.sqrt((value**2).sum())
        return np.append(found, len(self.idf)), value / size if size else value

    @property
    def rest(self) -> np.ndarray:
        """Weights of words that no example has: none."""
        return np.zeros(len(self.ids))

    @property
    def postings(self) -> list[tuple[np.ndarray, ...]]:
        """Of each word: examples and weights, and its blocks of examples with the largest weight in each."""
        made, out = self.ready(), []
        order = np.argsort(self.word, kind="stable")
        value, example = self.values(np.arange(len(self.word)), np.repeat(made.length, np.diff(self.at)))[order], np.repeat(np.arange(len(self.ids)), np.diff(self.at))[order]
        for a, b in zip(made.at[:-1], made.at[1:], strict=True):
            e, v = example[a:b], value[a:b]
            block, first = np.unique(e // BLOCK, return_index=True)
            out.append((e, v, block, np.maximum.reduceat(v, first) if len(v) else v))
        return out

    def values(self, places: np.ndarray | slice, length: np.ndarray | float) -> np.ndarray:
        """Weights of the examples' terms at the places, in double precision; not kept, for memory."""
        return (1 + np.log(self.count[places].astype(np.float64))) * self.idf[self.word[places]] / length

    def ready(self) -> Lists:
        """Postings, blocks and largest weights; made once in each worker."""
        if self.lists is None:
            n, sizes, n_words = len(self.ids), np.diff(self.at), len(self.idf)
            parts = [(a, min(a + EXAMPLES, n)) for a in range(0, n, EXAMPLES)]  # for memory, never all postings at once
            length, number = np.zeros(n), np.zeros(n_words, np.int64)
            for a, b in parts:
                x, y = self.at[a], self.at[b]
                length[a:b] = np.sqrt(np.add.reduceat(self.values(slice(x, y), 1.0)**2, self.at[a:b] - x))
                number += np.bincount(self.word[x:y], minlength=n_words)
            at = np.concatenate([[0], np.cumsum(number)])
            # Words are numbered by falling number of examples.
            frequent = min(MOST_FREQUENT, int((number >= max(1, n * FREQUENT)).sum()))
            blocks = np.zeros((-(-n // BLOCK) * BLOCK, frequent), np.float32)
            example = np.zeros(len(self.word) - at[frequent], f"<u{width_of(n)}")
            weight = np.zeros(len(example), np.float32)
            free = at[:-1] - at[frequent]  # where the next posting of each word goes
            for a, b in parts:
                x, y = self.at[a], self.at[b]
                word, mine = self.word[x:y], np.repeat(np.arange(a, b), sizes[a:b])
                value = self.values(slice(x, y), np.repeat(length[a:b], sizes[a:b])).astype(np.float32)
                often = word < frequent
                blocks[mine[often], word[often]] = value[often]
                rare = np.flatnonzero(~often)
                rare = rare[np.argsort(word[rare], kind="stable")]
                kinds, first, many = np.unique(word[rare], return_index=True, return_counts=True)
                to = np.arange(len(rare)) + np.repeat(free[kinds] - first, many)
                example[to], weight[to] = mine[rare], value[rare]
                free[kinds] += many
            largest = blocks.reshape(-1, BLOCK, frequent).max(axis=1) if n else blocks
            first_of: dict[bytes, int] = {}
            same = [first_of.setdefault(hashlib.sha256(self.word[a:b].tobytes() + self.count[a:b].tobytes()).digest(), i)
                    for i, (a, b) in enumerate(zip(self.at[:-1], self.at[1:], strict=True))]
            self.lists = Lists(length, example, weight, at, frequent, blocks, largest, np.array(same, np.int64))
        return self.lists

    def bounded(self, found: list[np.ndarray], value: list[np.ndarray], without: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query: scores of all examples by its rare words, weights of its frequent words, bounds of all blocks."""
        made = self.ready()
        score = np.zeros((len(found), len(made.blocks)), np.float32)
        asked = np.zeros((len(found), made.frequent), np.float32)
        for i, (words, weights) in enumerate(zip(found, value, strict=True)):
            cut = int(np.searchsorted(words, made.frequent))
            asked[i, words[:cut]] = weights[:cut]
            rare = words[cut:-1]
            a, b = made.at[rare] - made.at[made.frequent], made.at[rare + 1] - made.at[made.frequent]
            spots = list(zip(a.tolist(), b.tolist(), strict=True))
            if spots:
                v = np.concatenate([made.weight[x:y] for x, y in spots]) * np.repeat(weights[cut:-1].astype(np.float32), b - a)
                score[i] = np.bincount(np.concatenate([made.example[x:y] for x, y in spots]), v, minlength=score.shape[1])
            if without[i] >= 0:
                score[i, without[i]] = -np.inf
        best = score.reshape(len(found), -1, BLOCK).max(axis=2)
        return score, asked, best + asked @ made.largest.T

    def search(self, found: list[np.ndarray], value: list[np.ndarray], k: int = NEIGHBOURS,
               without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the k examples of highest cosine above 0, and it; ties by place in the index."""
        if not len(self.ids):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(found)
        made = self.ready()
        score, asked, bound = self.bounded(found, value, without or [-1] * len(found))
        by_block = score.reshape(len(found), -1, BLOCK)
        todo = np.zeros(bound.shape, bool)
        np.put_along_axis(todo, np.argsort(-bound, axis=1)[:, :FIRST_BLOCKS], True, axis=1)
        read = np.zeros(bound.shape, bool)
        for _ in range(2):
            for b in np.flatnonzero(todo.any(axis=0)):
                rows = np.flatnonzero(todo[:, b])
                by_block[rows, b] += asked[rows] @ made.blocks[b * BLOCK:(b + 1) * BLOCK].T
            read |= todo
            edge = np.zeros(len(found))
            for i in range(len(found)):
                some = by_block[i][read[i]].ravel()
                edge[i] = np.partition(some, len(some) - k)[len(some) - k] if len(some) > k else 0
            todo = (bound >= edge[:, None] - SLACK) & (bound > 0) & ~read
        by_block[~read] = -np.inf
        query = np.zeros(len(self.idf) + 1)
        return [self.exact(f, v, np.flatnonzero(score[i] > max(edge[i] - SLACK, 0)), k, query) for i, (f, v) in enumerate(zip(found, value, strict=True))]

    def exact(self, found: np.ndarray, value: np.ndarray, mine: np.ndarray, k: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the examples ``mine`` by cosines in double precision; equal examples are scored once. query: zeros, also after."""
        made = self.ready()
        kinds, which = np.unique(made.same[mine], return_inverse=True)
        a, b = self.at[kinds], self.at[kinds + 1]
        places = ranges(a, b)
        query[found] = value
        product = query[self.word[places]] * self.values(places, np.repeat(made.length[kinds], b - a))
        query[found] = 0
        total = np.add.reduceat(product, np.cumsum(b - a) - (b - a)) if len(kinds) else np.zeros(0)
        e, s = largest_of(mine, total[which], k)
        best = np.lexsort((e, -s))
        return e[best], np.minimum(s[best], 1.0)

    def nearest(self, found: np.ndarray, value: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Of one query, as search."""
        return self.search([found], [value], k, [without])[0]

    def vote(self, e: np.ndarray, s: np.ndarray) -> float:
        """Log odds of the similarity-weighted vote; the base rate votes too."""
        w = s * self.weight[e]
        yes = (w * self.toxic[e]).sum() + PRIOR_VOTES * self.base
        no = (w * (1 - self.toxic[e])).sum() + PRIOR_VOTES * (1 - self.base)
        return math.log(max(yes, 1e-9) / max(no, 1e-9))

    def calibrate(self, votes: np.ndarray) -> None:
        """Logistic fit of the labels on the examples' votes without themselves, with a slope of 0 or more; NaN where an example has no word."""
        some = np.flatnonzero(~np.isnan(votes))
        y, w = self.toxic[some], self.weight[some]
        if len(some) < 10 or y.min() == y.max():
            return
        x = np.column_stack([votes[some], np.ones(len(some))])
        start = fit = np.array([1.0, 0.0])

        def loss(c: np.ndarray) -> float:
            z = x @ c
            return (w * (np.logaddexp(0, z) - y * z)).sum() + 5e-4 * ((c - start)**2).sum()

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
            g = x.T @ (w * (p - y)) + 1e-3 * (fit - start)
            h = (x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, g)
            while loss(fit - step) > loss(fit) and np.abs(step).max() >= 1e-8:
                step = step / 2
            fit = fit - step
            if np.abs(step).max() < 1e-8:
                break
        if fit[0] < 0:  # likeness to toxic examples never speaks for a text
            share = (w * y).sum() / w.sum()
            fit = np.array([0.0, math.log(share / (1 - share))])
        if np.isfinite(fit).all():
            self.slope, self.shift = float(fit[0]), float(fit[1])

    def judged(self, e: np.ndarray, s: np.ndarray, size: int) -> tuple[float, list[int], list[float]]:
        """Probability of the label for a text with words, and the evidence: ids of the nearest examples and their cosines."""
        if not len(self.ids) or not size:
            return self.featureless, [], []
        z = self.slope * self.vote(e, s) + self.shift
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), self.ids[e].tolist(), s.tolist()


def idf(total: int, df: int) -> float:
    return math.log((1 + total) / (1 + df)) + 1


def examples(docs: DataFrame, labels: DataFrame, max_examples: int, id_col: str, text_col: str,
             label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(id, toxic, text) of the chosen training rows, and how many training rows each class has."""
    train = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(F.col(id_col)) != 0))
    train = train.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    totals = {int(y): n for y, n in train.groupBy("toxic").count().collect()}
    order = [F.xxhash64("id"), F.col("id")]
    chosen = [train.where(F.col("toxic") == y).orderBy(*order).limit(max_examples) for y in (0, 1)]
    few = F.broadcast(saved(chosen[0].union(chosen[1]), "examples"))  # at most 2 * max_examples rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(few, "id")
    return spread(saved(rows.select("id", "toxic", "text"), "example-texts")), totals


def features(rows: DataFrame, sent: Broadcast, text_col: str = "text") -> DataFrame:
    """rows with what the model asks of a text in its place; sent is what send_words made.

    words and counts: which terms of the examples it has and how often, packed (terms as steps from one to the next);
    others and other_counts: the same of all its other words; size: how many different words it has.
    """
    at = rows.columns.index(text_col)
    kept = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, marks, begins, mark_at, mark_of = sent.value
        kinds = (pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32())
        number_of = np.array([words[m] for m in marks], np.int64)
        begun_by: dict[str, list[int]] = {}  # the beginnings of words by what can be of one

        def marks_of(word: str) -> list[int]:
            head = word[:HEADS[-1]]
            out = begun_by.get(head)
            if out is None:
                if len(begun_by) >= 200_000:
                    begun_by.clear()
                out = begun_by[head] = marks_in((word,), marks, begins)
            return out

        # Few texts at once, as lists of words take several times the room of a text.
        for batch in (whole.slice(i, TOGETHER) for whole in batches for i in range(0, len(whole), TOGETHER)):
            out: list[list] = [[] for _ in kinds]
            for text in batch.column(at):
                seen = Counter(terms(text.as_py()))
                number = np.fromiter(map(words.get, seen, repeat(-1)), np.int64, len(seen))
                count = np.fromiter(seen.values(), np.int64, len(seen))
                some = number >= 0
                found, often = number[some], count[some]
                others = [w for w, n in zip(seen, number.tolist(), strict=True) if n < 0]
                mine, its = mark_of[ranges(mark_at[found], mark_at[found + 1])], np.repeat(often, mark_at[found + 1] - mark_at[found])
                begun = [(m, seen[w]) for w in others if w[:HEADS[0]] in begins for m in marks_of(w)]
                if begun:
                    mine, its = np.append(mine, [m for m, _ in begun]), np.append(its, [n for _, n in begun])
                total = np.bincount(mine, its, minlength=len(marks)).astype(np.int64)
                has = np.flatnonzero(total)
                found, often = np.append(found, number_of[has]), np.append(often, total[has])
                order = np.argsort(found)
                found = found[order]
                for column, x in zip(out, (packed(np.diff(found, prepend=0)), packed(often[order]), others, [seen[w] for w in others], len(seen)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns) if i != at), *(pa.array(x, kind) for x, kind in zip(out, kinds, strict=True))],
                names=[*kept, "words", "counts", "others", "other_counts", "size"])

    form = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text_col]
    return rows.mapInArrow(run, ", ".join([*form, "words binary, counts binary, others array<string>, other_counts array<int>, size int"]))


def with_others(found: DataFrame, total: int) -> DataFrame:
    """The rows of features, which have a number ``row``, with other_squares: the sum of the squared weights of the other words.

    Words are told apart by 64 bits of hash. Frequent ones are joined by broadcast, so that no task gets all rows of one.
    """
    pairs = found.where(F.size("others") > 0).select("row", F.explode(F.arrays_zip("others", "other_counts")).alias("p")).select(
        "row", F.xxhash64("p.others").alias("word"), F.col("p.other_counts").alias("n"))
    df = saved(pairs.groupBy("word").agg(F.count("*").alias("df")), "other-words")
    often = df.where(F.col("df") > max(20.0, total * OFTEN))
    rare = df.where(F.col("df") <= max(20.0, total * OFTEN))
    if is_small(often):
        joined = pairs.join(F.broadcast(often), "word").union(
            pairs.join(F.broadcast(often), "word", "left_anti").join(rare.hint("merge"), "word").select("word", "row", "n", "df"))
    else:  # few, very long texts: Spark splits what is skewed
        joined = pairs.join(df.hint("merge"), "word").select("word", "row", "n", "df")
    weight = (1 + F.log("n")) * (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1)
    # Added in order, so that equal texts get equal sums.
    squares = joined.groupBy("row").agg(F.aggregate(F.array_sort(F.collect_list(weight * weight)), F.lit(0.0), lambda a, x: a + x)
                                        .alias("other_squares"))
    out = with_small(found.drop("others", "other_counts"), saved(squares, "other-squares"), ["row"], "left")
    return out.withColumn("other_squares", F.coalesce("other_squares", F.lit(0.0)))


@dataclass
class Training:
    """The chosen examples' texts, and how many training rows and examples each class has."""

    rows: DataFrame
    totals: dict[int, int]
    have: dict[int, int]


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> Index:
    """The index of the labelled examples outside the held-out fold."""
    model, training = vocabulary(docs, labels, max_examples, id_col, text_col, label_col)
    if model.words:
        sent = send_words(docs, model)
        index_examples(model, training, saved(features(docs.select(text_col), sent, text_col), "features"), example_features(training, sent))
    return model


def send_words(docs: DataFrame, model: Index) -> Broadcast:
    """What features reads of the model, with the marks of each word; bounded by the examples."""
    at, own = array("q", [0]), array("q")  # no list for each word, for the driver's memory
    for w in model.words:
        if not w.endswith("*"):
            own.extend(marks_in((w,), model.marks, model.begins))
        at.append(len(own))
    return docs.sparkSession.sparkContext.broadcast((model.words, model.marks, model.begins, np.array(at, np.int64), np.array(own, np.int64)))


def vocabulary(docs: DataFrame, labels: DataFrame, max_examples: int, id_col: str, text_col: str,
               label_col: str) -> tuple[Index, Training]:
    """A model that knows its words and marks only, and what it is to be trained on."""
    rows, totals = examples(docs, labels, max_examples, id_col, text_col, label_col)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in set(terms(text)) for f in beginnings(w)}:
                    counts.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts), *(pa.array([c[y] for c in counts.values()], pa.int64()) for y in (0, 1))],
                names=["word", "n0", "n1"])

    have = {int(y): n for y, n in rows.groupBy("toxic").count().collect()}
    n0, n1 = have.get(0, 0), have.get(1, 0)
    base = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    model = Index(base=base, featureless=base)
    training = Training(rows, totals, have)
    if not n0 or not n1:
        return model, training
    a, b, n = F.col("n1"), F.col("n0"), float(n0 + n1)
    gap = a * (n0 - b) - b * (n1 - a)
    with_, without = a + b, n - a - b
    chi2 = n * gap * gap / (with_ * without * n0 * n1)
    marks = (rows.select("toxic", "text").mapInArrow(presence, "word string, n0 long, n1 long")
             .groupBy("word").agg(F.sum("n0").cast("double").alias("n0"), F.sum("n1").cast("double").alias("n1"))
             .where((with_ >= 3) & (without > 0)).withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2)
             .orderBy(F.desc("chi2"), "word").select("word").collect())  # bounded by the examples' words
    model.marks = known = {r[0]: i for i, r in enumerate(marks)}
    model.begins = begins = heads(model.marks)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(w for text in batch.column(0).to_pylist() for w in all_terms(text, known, begins))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    words = rows.select("text").mapInArrow(distinct, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    # Frequent terms come first, as the first word of an example decides its block.
    words = words.sort_by([("n", "descending"), ("word", "ascending")]).column("word").to_pylist()
    model.words = {w: i for i, w in enumerate(words)}
    return model, training


def example_features(training: Training, words_sent: Broadcast) -> DataFrame:
    """Saved features of the examples, with a number ``row``."""
    rows = training.rows.select("id", F.col("toxic").cast("int").alias("toxic"), "text").withColumn("row", F.monotonically_increasing_id())
    return saved(features(rows, words_sent).drop("others", "other_counts"), "example-features")  # examples have no other words


def index_examples(model: Index, training: Training, all_features: DataFrame, rows: DataFrame, n_words: int | None = None) -> Broadcast:
    """Weights by document frequencies over all documents, then the index of the examples, of which rows are the features, and
    calibration; the index as sent to tasks. n_words: how many words the model had, if it no longer holds them."""
    n_words = len(model.words) if n_words is None else n_words

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(n_words, np.int64), 0
        for batch in batches:
            rows += len(batch)
            found = [np.cumsum(unpacked(x)) for x in batch.column(0).to_pylist()]
            n += np.bincount(np.concatenate([np.zeros(0, np.int64), *found]), minlength=n_words)
        some = np.flatnonzero(n)
        # The number of texts goes under -1.
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[some], rows))], names=["w", "n"])

    df = all_features.select("words").mapInArrow(counted, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()  # a row per word
    w, n = (df.column(c).to_numpy() for c in ("w", "n"))
    model.total = int(n[w < 0].sum())
    count = np.zeros(n_words)
    count[w[w >= 0]] = n[w >= 0]
    model.idf = np.log((1 + model.total) / (1 + count)) + 1
    got = rows.toArrow()
    id_, y, row = (got.column(c).to_numpy() for c in ("id", "toxic", "row"))
    words, counts = ([unpacked(x) for x in got.column(c).to_pylist()] for c in ("words", "counts"))
    totals, n0, n1, base = training.totals, training.have.get(0, 0), training.have.get(1, 0), model.base
    share = np.array([totals.get(0, 0) / n0, totals.get(1, 0) / n1])
    size = np.array([len(w) for w in words])
    odds = [share[c] * ((size == 0) & (y == c)).sum() for c in (0, 1)]
    model.featureless = float((odds[1] + base) / (sum(odds) + 1))
    # Blocks hold examples with the same most frequent word and alike lengths, so that their bounds are tight.
    first = np.array([w[0] if len(w) else n_words for w in words])
    order = [int(i) for i in np.lexsort((row, id_, size, first)) if size[i]]
    model.ids, model.toxic, model.weight = id_[order].astype(np.int64), y[order].astype(np.float64), share[y[order]]
    model.at = np.concatenate([[0], np.cumsum(size[order])]).astype(np.int64)
    model.word = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(words[i]) for i in order)]).astype(np.int32)
    often = np.concatenate([np.zeros(0, np.int64), *(counts[i] for i in order)])
    model.count = often.astype(f"<u{width_of(int(often.max(initial=0)))}")
    place = {int(row[i]): at for at, i in enumerate(order)}
    sent = rows.sparkSession.sparkContext.broadcast((model.to_send(), place))  # bounded by max_examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at = sent.value
        for batch in batches:
            for part in range(0, len(batch), TOGETHER):
                mine = [(at[r], *index.weigh(np.cumsum(unpacked(w)), unpacked(c), 0.0))
                        for r, w, c in zip(*(batch.column(i).slice(part, TOGETHER).to_pylist() for i in range(3)), strict=True) if r in at]
                best = index.search([x[1] for x in mine], [x[2] for x in mine], without=[x[0] for x in mine])
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in mine], pa.int64()), pa.array([index.vote(*x) for x in best], pa.float64())],
                                                 names=["at", "vote"])

    got = rows.select("row", "words", "counts").mapInArrow(run, "at long, vote double").toArrow()
    votes = np.full(len(order), np.nan)
    votes[got.column("at").to_numpy()] = got.column("vote").to_numpy()
    model.calibrate(votes)
    return sent


def scored(rows: DataFrame, model: Index, sent: Broadcast) -> DataFrame:
    """rows of with_others without what describes the text, but with score, evidence array<long>, cosines array<double>."""
    asked = ["words", "counts", "other_squares", "size"]
    kept = [c for c in rows.columns if c not in [*asked, "row"]]
    fitted = model.featureless, model.slope, model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = replace(sent.value[0], featureless=fitted[0], slope=fitted[1], shift=fitted[2], lists=sent.value[0].ready())
        for batch in batches:
            for part in range(0, len(batch), TOGETHER):
                now = batch.slice(part, TOGETHER)
                words, counts, others, size = (now.column(len(kept) + i).to_pylist() for i in range(4))
                asked_for = [index.weigh(np.cumsum(unpacked(w)), unpacked(c), q) for w, c, q in zip(words, counts, others, strict=True)]
                best = index.search([x[0] for x in asked_for], [x[1] for x in asked_for])
                out = [index.judged(*x, n) for x, n in zip(best, size, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(now.column(i) for i in range(len(kept))), pa.array([x[0] for x in out], pa.float64()),
                     pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))],
                    names=[*kept, "score", "evidence", "cosines"])
        sent.value[0].lists = None  # idle workers do not keep postings

    form = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.select(*kept, *asked).mapInArrow(run, ", ".join([*form, "score double, evidence array<long>, cosines array<double>"]))


def learnt_and_scored(docs: DataFrame, labels: DataFrame, kept: list[Column], max_examples: int, id_col: str, text_col: str,
                      label_col: str) -> tuple[DataFrame, Broadcast | None]:
    """kept, score, evidence and cosines of each row of docs, and what their plan reads in every task; each text is read for features once."""
    model, training = vocabulary(docs, labels, max_examples, id_col, text_col, label_col)
    rows = spread(docs).select(*kept, F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    if not model.words:
        return rows.drop("text", "row").select("*", F.lit(model.featureless).alias("score"), F.array().cast("array<long>").alias("evidence"),
                                               F.array().cast("array<double>").alias("cosines")), None
    words_sent = send_words(docs, model)
    found, own = saved(features(rows, words_sent), "features"), example_features(training, words_sent)
    # Both are saved, so nothing reads the words again; the driver holds them no longer while it makes the index.
    n_words, model.words, model.marks, model.begins = len(model.words), {}, {}, set()
    words_sent.destroy()
    del words_sent
    sent = index_examples(model, training, found, own, n_words)
    return scored(with_others(spread(found), model.total), model, sent), sent


def toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted, evidence, cosines) of all rows by the examples among them."""
    found, _ = learnt_and_scored(docs, labels, [F.col(id_col).alias("kept")], max_examples, id_col, text_col, label_col)
    return found.select(F.col("kept").alias(id_col), (fold(F.col("kept")) == 0).alias("held_out"), "score",
                        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "evidence", "cosines")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, unchanged; equal texts have equal scores."""
    key = [F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("k1"), F.xxhash64(F.lit(1), F.coalesce(text_col, F.lit(""))).alias("k2")]
    found, sent = learnt_and_scored(docs, labels, key, MAX_EXAMPLES, id_col, text_col, "toxic")
    bad = saved(found.where(F.col("score") >= threshold).select("k1", "k2").distinct(), "toxic")
    if sent is not None:
        sent.destroy()  # the verdicts are saved
    both = [key[0] == bad["k1"], key[1] == bad["k2"]]
    return docs.join(F.broadcast(bad) if is_small(bad) else bad, both[0] & both[1], "left_anti")
