"""Repeated byte strings by induced sorting of sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in
any text or the same; strings never cross texts, and all are judged on the input.

Sampling. A suffix is sampled if the hash of its first ``gram`` bytes is the smallest in
some window of ``length`` bytes. Any two equal windows sample the same suffix, so a window
can repeat only if its sampled suffix's hash does. Spark's external sort carries the
tuples (hash, text, position): it is the disk-backed queue that delivers each class of
equal hashes together, whatever the memory.

Runs of a short period, such as blanks, would sample every position. All windows of such a run
recur in it, so the run goes as a whole, and only its first windows, one for each place in the
period, stand for it where other texts are compared.

Induction. Within a class, sampled suffixes are sorted by what follows, in rounds over
eight bytes, with the lengths of common prefixes of neighbours. The order of the suffixes
d bytes further left is then induced from the order at d - 1 by a stable sort on one
preceding byte, and the common prefix of neighbours by range minima. Neighbours whose
common prefix reaches ``length`` mark both windows as repeated. Sampled suffixes with the
same whole surroundings repeat for certain: they are counted with a map-side step and one
stands for all. A class of more than ``class_limit`` different surroundings is not sorted
in one task: its windows are counted by hash, again with a map-side step.

Equal texts are one class from the start; all but their first are not scanned at all.
Defined results: a null text counts as empty; texts shorter than ``length`` keep all;
repeated rows are copies. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, saved, with_small
from .shingles import mix

LENGTH = 200
GRAM = 64
CLASS_LIMIT = 20_000
BATCH_BYTES = 8_000_000
#: Longest period of runs that go as a whole; those of longer ones sample few positions.
MOST_PERIOD = 32

_RNG = np.random.default_rng(5)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Shifts that put eight bytes into a big-endian word, and that leave its first 1 to 8.
SHIFTS = np.arange(56, -8, -8, dtype=np.int64).astype(np.uint64)
_POWERS = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the bytes [i, i + gram) for each i."""
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up)])
    return mix((sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1])


def sliding(a: np.ndarray, width: int, op: np.ufunc, rest: int) -> np.ndarray:
    """op over each window of the width; two running passes over blocks of it."""
    n = len(a) - width + 1
    blocks = np.full(-(-len(a) // width) * width, rest, a.dtype)
    blocks[:len(a)] = a
    blocks = blocks.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1:width - 1 + n])


def sampled(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of sampled suffixes, their hashes, and the smallest hash of each window."""
    g = gram_hashes(data, gram)
    width = length - gram + 1
    least = sliding(g, width, np.minimum, 2**64 - 1)
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1:width - 1 + len(least)] = least
    at = np.flatnonzero(sliding(padded, width, np.maximum, 0) == g)
    return at, g[at], least


def owners(at: np.ndarray, value: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window, which sampled suffix it belongs to: the leftmost of its smallest hash."""
    owner = np.searchsorted(at, np.arange(len(least)))
    while True:
        wrong = np.flatnonzero(value[owner] != least)
        if not len(wrong):
            return owner
        owner[wrong] += 1


def periodic(data: np.ndarray, at: np.ndarray, value: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start, end, period) of runs in which sampled hashes recur so close, and that are longer than a window by a period at least."""
    steps = np.diff(at)
    out = []
    for p in np.unique(steps[(steps <= MOST_PERIOD) & (value[1:] == value[:-1])]).tolist():
        same = np.concatenate([[0], (data[p:] == data[:-p]).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        long = edges[1::2] - edges[::2] >= length
        out += [(a, b + p, p) for a, b in zip(edges[::2][long].tolist(), edges[1::2][long].tolist(), strict=True)]
    return out


def compared(runs: list[tuple[int, int, int]], windows: int, length: int = LENGTH) -> np.ndarray:
    """The windows that are compared with others: all but those in runs after the first period."""
    needed = np.ones(windows, bool)
    for a, b, p in runs:
        needed[a + p:b - length + 1] = False
    return np.flatnonzero(needed)


def right_order(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray,
                most: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each suffix data[start:end] within the order by (group, bytes), and common prefixes with the one before.

    Rounds of eight bytes refine the order; only suffixes that still tie take part.
    """
    n = len(start)
    order = np.argsort(group, kind="stable")
    name = group[order]
    common = np.zeros(n, np.int64)
    tied = np.ones(n, bool)
    wide = np.concatenate([data, np.zeros(16, np.uint8)])
    for skip in range(0, most, 8):
        same = np.zeros(n + 1, bool)
        same[1:n] = (name[1:] == name[:-1]) & tied[1:] & tied[:-1]
        live = np.flatnonzero(same[1:] | same[:-1])
        if not len(live):
            break
        who = order[live]
        have = np.clip(end[who] - start[who] - skip, 0, 8)
        chunk = wide[np.minimum(start[who] + skip, len(data))[:, None] + np.arange(8)].astype(np.uint64)
        chunk[np.arange(8)[None, :] >= have[:, None]] = 0
        key = (chunk << SHIFTS).sum(axis=1, dtype=np.uint64)
        turn = np.lexsort((have, key, name[live]))
        order[live], names, key, have = who[turn], name[live][turn], key[turn], have[turn]
        new = np.ones(len(live), bool)
        new[1:] = (names[1:] != names[:-1]) | (key[1:] != key[:-1]) | (have[1:] != have[:-1])
        split = np.flatnonzero(new[1:] & (names[1:] == names[:-1])) + 1
        differ = (key[split] ^ key[split - 1])[:, None] >> SHIFTS
        same_bytes = (differ == 0).sum(axis=1)
        common[live[split]] = skip + np.minimum(same_bytes, np.minimum(have[split], have[split - 1]))
        fresh = np.cumsum(new)
        first = np.flatnonzero(new)
        name[live] = live[first][fresh - 1] + (n + 1) * (skip // 8 + 1)
        tied[live] = have == 8
        still = np.flatnonzero(~new)
        common[live[still]] = skip + have[still]
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank, common


class RangeMinimum:
    """Least of common[a + 1 .. b], by a table of powers of two."""

    def __init__(self, common: np.ndarray):
        self.table = [common.astype(np.int16)]
        step = 1
        while 2 * step <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = b - a
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            i = np.flatnonzero(level == k)
            t = self.table[k]
            out[i] = np.minimum(t[a[i] + 1], t[b[i] - (1 << k) + 1])
        return out


def repeated_windows(parts: list[bytes], group: np.ndarray, mark: np.ndarray, low: np.ndarray, high: np.ndarray,
                     length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(part, d) for each window, d bytes before its sampled suffix, that another part of the group holds too.

    parts: the bytes around each sampled suffix; mark: where it starts there; low, high:
    the least and the largest d of the part's windows.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = begin + mark
    rank, common = right_order(data, at, begin + sizes, group, length)
    least = RangeMinimum(common)
    queue = np.argsort(rank)  # tuples in order; their names and preceding bytes are pushed on, level by level
    name = group[queue]
    found_part, found_d = [], []
    for d in range(int(high.max()) + 1):
        if d:
            on = high[queue] >= d
            queue, name = queue[on], name[on]
            key = name * 256 + data[at[queue] - d]
            turn = np.argsort(key, kind="stable")
            queue, key = queue[turn], key[turn]
        else:
            key = name
        if len(queue) < 2:
            break
        same = key[1:] == key[:-1]
        i = np.flatnonzero(same)
        hit = i[least(rank[queue[i]], rank[queue[i + 1]]) >= length - d]
        both = np.union1d(hit, hit + 1)
        both = queue[both]
        both = both[low[both] <= d]
        found_part.append(both)
        found_d.append(np.full(len(both), d))
        name = np.concatenate([[0], np.cumsum(~same)])
        alone = ~(np.append(same, False) | np.append(False, same))
        queue, name = queue[~alone], name[~alone]
    if not found_part:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_part), np.concatenate(found_d)


def spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of [s, s + length) for ascending starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


def union(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of intervals; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _samples(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, len(batch), 256):
                keys, ats, values, known = [], [], [], []
                rows = batch.slice(part, 256)
                for key, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                    data = np.frombuffer(text.as_buffer(), np.uint8)
                    at, value, least = sampled(data, length, gram)
                    if runs := periodic(data, at, value, length):
                        who = np.unique(owners(at, value, least)[compared(runs, len(least), length)])
                        at, value = at[who], value[who]
                        known += [(key, a, b) for a, b, _ in runs]
                    keys.append(np.full(len(at), key, np.int64))
                    ats.append(at)
                    values.append(value)
                n, names = sum(map(len, ats)), ["text", "at", "hash", "stop"]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.concatenate(x)) for x in (keys, ats)), pa.array(np.concatenate(values).view(np.int64)), pa.nulls(n, pa.int64())], names=names)
                if known:
                    text, start, stop = (pa.array(x, pa.int64()) for x in zip(*known, strict=True))
                    yield pa.RecordBatch.from_arrays([text, start, pa.nulls(len(known), pa.int64()), stop], names=names)

    return run


def _surroundings(length: int, gram: int):
    def made(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int64()] * 5 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                          names=["text", "at", "low", "high", "hash", "code", "around"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for key, text, chosen in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_py()
                data = np.frombuffer(raw, np.uint8)
                at, value, least = sampled(data, length, gram)
                windows = compared(periodic(data, at, value, length), len(least), length)
                who, first, count = np.unique(owners(at, value, least)[windows], return_index=True, return_counts=True)
                low, high = windows[first], windows[first + count - 1]
                mine = np.isin(at[who], np.asarray(chosen.values))
                for w, a, b in zip(who[mine].tolist(), low[mine].tolist(), high[mine].tolist(), strict=True):
                    around = raw[a:b + length]
                    m = int(at[w])
                    code = hashlib.blake2b(around + (m - a).to_bytes(2, "big"), digest_size=16).digest()
                    out.append((key, m, a, b, int(value[w].view(np.int64)), code, around))
                    size += len(around)
                    if size > BATCH_BYTES:
                        yield made(out)
                        out, size = [], 0
        yield made(out)

    return run


def _induced(length: int):
    """Rows (hash, text, at, low, high, n, around) sorted by hash -> (text, start, end) of repeated bytes."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        group = np.unique([r[0] for r in rows], return_inverse=True)[1].astype(np.int64)
        at, low, high = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
        part, d = repeated_windows([r[6] for r in rows], group, at - low, at - high, at - low, length)
        once = np.array([r[5] for r in rows]) == 1  # the others are known to repeat as a whole
        keep = once[part]
        part, start = part[keep], (at[part] - d)[keep]
        order = np.lexsort((start, part))
        part, start = part[order], start[order]
        out: list[tuple] = []
        edge = np.flatnonzero(np.diff(part)) + 1
        for i, s in zip(part[np.append(0, edge)] if len(part) else [], np.split(start, edge), strict=False):
            out += [(rows[i][1], a, b) for a, b in spans(s, length)]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["text", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BATCH_BYTES and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
        if rows:
            yield flush(rows)

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hash_, text, _, low, high, n, around in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = [hashlib.blake2b(around[i:i + length], digest_size=16).digest() for i in range(high - low + 1)]
                k = len(codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes, pa.binary()), pa.array([text] * k, pa.int64()), pa.array(range(low, high + 1), pa.int64()),
                     pa.array([n] * k, pa.int64())], names=["code", "text", "start", "n"])

    return run


def repeated_bytes(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, class_limit: int = CLASS_LIMIT) -> DataFrame:
    """(text, start, end): intervals of repeated bytes in different texts, given as (text long, bytes binary)."""
    spark = texts.sparkSession
    texts = texts.where(F.octet_length("bytes") >= length).select("text", "bytes")
    samples = saved(texts.mapInArrow(_samples(length, gram), "text long, at long, hash long, stop long"), "samples")
    known = samples.where("stop is not null").select("text", F.col("at").alias("start"), F.col("stop").alias("end"))
    samples = samples.where("stop is null").select("text", "at", "hash")
    twice = saved(samples.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "twice")
    chosen = saved(samples.join(twice, "hash").groupBy("text").agg(F.collect_list("at").alias("chosen")), "chosen")
    # Only texts with such a suffix are shuffled to meet their positions.
    texts = with_small(texts, chosen.select("text"), ["text"], "left_semi")
    near = texts.join(chosen, "text").select("text", "bytes", "chosen").mapInArrow(
        _surroundings(length, gram), "text long, at long, low long, high long, hash long, code binary, around binary")
    near = saved(near, "near")
    kinds = near.groupBy("hash", "code").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text", "at")).alias("first"))
    kinds = saved(kinds.select("hash", "code", "n", "first.text", "first.at"), "kinds")
    whole = near.join(kinds.where("n > 1").select("hash", "code"), ["hash", "code"]).select(
        "text", F.col("low").alias("start"), (F.col("high") + length).alias("end"))
    open_ = saved(kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("n") == 1).alias("u"))
                  .where("c > 1 and u > 0").select("hash", "c"), "open")
    sent = kinds.join(open_, "hash").select("text", "at", "n", "c")
    work = near.join(sent, ["text", "at"]).select("hash", "text", "at", "low", "high", "n", "around", "c")
    if open_.where(F.col("c") > class_limit).isEmpty():
        usual, hot = work, None
    else:
        work = saved(work, "work")
        usual, hot = work.where(F.col("c") <= class_limit), work.where(F.col("c") > class_limit)
    sorted_ = usual.drop("c").repartition(partitions(spark), "hash").sortWithinPartitions("hash", "text", "at")
    out = whole.union(known).union(sorted_.mapInArrow(_induced(length), "text long, start long, end long"))
    if hot is not None:
        each = saved(hot.drop("c").mapInArrow(_windows(length), "code binary, text long, start long, n long"), "windows")
        again = saved(each.groupBy("code").agg(F.sum("n").alias("m")).where("m > 1").select("code"), "again")
        out = out.union(each.where("n = 1").join(again, "code").select("text", "start", (F.col("start") + length).alias("end")))
    return out


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                class_limit: int = CLASS_LIMIT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of each row."""
    text = F.coalesce(text_col, F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text"), F.xxhash64(F.lit(1), text).alias("check"),
                        F.encode(text, "UTF-8").alias("bytes"))
    # Copies are told by 128 bits; a text is named by 64 of them.
    copies = saved(keyed.groupBy("text", "check").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "copies")
    many = saved(copies.where("n > 1").select("text", "first"), "many")
    long = keyed.where(F.octet_length("bytes") >= length)
    once = with_small(long, many, ["text"], "left").where(F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first")))
    found = repeated_bytes(once.select("text", "bytes"), length, gram, class_limit)
    lists = found.groupBy("text").agg(F.flatten(F.array_sort(F.collect_set(F.array("start", "end")))).alias("cuts"))
    lists = lists.join(many.select("text", F.lit(True).alias("copied")), "text", "full")
    lists = saved(lists.select("text", F.when(F.col("copied"), F.array(F.lit(0), F.lit(1 << 62))).otherwise(F.col("cuts")).alias("cuts")), "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for raw, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = len(raw)
                runs = union(list(zip(cuts[::2], cuts[1::2], strict=True))) if cuts and n >= length else []
                runs = [(a, min(b, n)) for a, b in runs]
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                out.append((n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows, cut = keyed.select("id", "text", "bytes"), lists.select("text")
    touched = with_small(rows, cut, ["text"], "left_semi").join(lists, "text").select("id", "bytes", "cuts")
    touched = touched.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    none = F.lit(0).cast("long")
    whole = with_small(rows, cut, ["text"], "left_anti").select(
        "id", F.octet_length("bytes").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.sha2("bytes", 256).alias("kept_sha256"), F.col("bytes").alias("kept"))
    return touched.union(whole).withColumnRenamed("id", id_col)
