"""Phrase counts and scores against counters over all phrases."""

import collections
import random
import re

import numpy as np
import pytest

from plumbline.llm import phrases, wordblocks

FORM = "text string, lang string, words string, n long, id long, f string"


def brute(rows, least, top, longest=5):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").encode().lower().decode()):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(zip(*(words[i:] for i in range(k)), strict=False))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in kept.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= kept[p[i:j]]}
        made = []
        for p, a in kept.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                made.append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, m[3], m[4], m[5], m[6], n[lang], -m[0]) for i, m in enumerate(sorted(made)[:top])]
    return sorted(out)


def made_rows(rng, count):
    words = ["the", "The", "a", "of", "new", "york", "city", "Écu", "ÉCU", "x", "\x00", "ﬀ", "12", "in-law"]
    rows = []
    for i in range(count):
        text = "".join(rng.choice(["new york city ", "of the ", rng.choice(words) + rng.choice([" ", "\t", "  ", ", ", ".\n", " "])]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice([text, text, text, None, ""]) if i % 9 == 0 else text, rng.choice(["en", "en", "en", "fr", None]), "w", 1, 2, "f"))
    return rows


@pytest.mark.parametrize("options", [{}, {"filter_cells": 1 << 16, "table_keys": 3}, {"least": 2, "top": 7}, {"least": 1, "longest": 3}])
def test_collocations(spark, monkeypatch, options):
    rows = made_rows(random.Random(4), 120)
    rows += [rows[5]] * 4 + [("a a a a a a a", "en", "w", 1, 2, "f")] * 3 + [("Long " * 20_000, "de", "w", 1, 2, "f"), ("y" * 50_000, "de", "w", 1, 2, "f")]
    least, top, longest = options.get("least", 5), options.get("top", 2000), options.get("longest", 5)
    got = phrases.collocations(spark.createDataFrame(rows, FORM).repartition(3), **{"least": least, "top": top, "longest": longest} | options)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, top, longest)


def test_no_rows_and_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], FORM)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("one two", "en", "", 1, 2, ""), (None, None, "", 1, 2, "")], FORM)).count() == 0


def test_exact_scores_beyond_64_bits(spark):
    """The cuts of a phrase with counts near 2**40, as the query scores them."""
    row = [("en", ["a", "b", "c"], 2**40 + 1, [2**41 + 3, 2**40 + 5, 2**40 + 1], [2**42 + 7, 2**40 + 9, 2**40 + 1], False)]
    found = spark.createDataFrame(row, "lang string, words array<string>, f long, heads array<long>, tails array<long>, whole boolean")
    n = 2**43 + 11
    got = phrases.scored(found, spark.createDataFrame([("en", n)], "lang string, n long"), 10).first()
    want = min((1000 * (2**40 + 1) * n // (h * t), k, h, t) for k, h, t in ((1, 2**41 + 3, 2**40 + 9), (2, 2**40 + 5, 2**42 + 7)))
    assert (got["score"], got["l"], got["r"], got["a"]) == (want[0], want[2], want[3], 2**40 + 1)


def test_minimal_perfect_hash_knows_its_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**62, 30_000))
    shards = 7
    rows = []
    for r in phrases.as_runs(keys, shards):
        mine = np.frombuffer(r["keys"], "<i8")
        levels, placed = phrases.build(mine)
        rows.append((r["shard"], wordblocks.pack(np.array([len(x) for x in levels], np.uint32)), np.packbits(np.concatenate(levels)).tobytes(), placed.astype("<i8").tobytes()))
    table = phrases.Table(sorted(rows), shards, 0)
    slots = table.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys))) and (table.keys[slots] == keys).all()
    strangers = np.setdiff1d(rng.integers(0, 2**62, 30_000), keys)
    assert (table.slots(strangers) == -1).all() and len(phrases.Table([], 5, 0).slots(keys[:3])) == 3


def test_cells_beyond_memory_are_given_up(spark):
    at = np.random.default_rng(2).integers(0, 50 * phrases.ROW_CELLS, 20_000)
    cells, total = phrases.Cells(50 * phrases.ROW_CELLS, most=4), np.zeros(50 * phrases.ROW_CELLS, np.int64)
    from unittest import mock
    with mock.patch.object(phrases.TaskContext, "get") as get:
        get.return_value.partitionId.return_value = 3
        rows = [r for part in np.split(at, 5) for r in cells.add(part)] + list(cells.given())
    for r in rows:
        total[r["cell"] * phrases.ROW_CELLS:(r["cell"] + 1) * phrases.ROW_CELLS] += phrases.array_of(r["low"], r["high"])
    assert (total == np.bincount(at, minlength=len(total))).all() and len(rows) > 50
    summed = phrases.tree_sum(spark.createDataFrame([tuple(r.values()) for r in rows], phrases.ARRAY_FORM).repartition(3)).collect()
    assert len(summed) == len({r["cell"] for r in rows}) and sum(int(phrases.array_of(r["low"], r["high"]).sum()) for r in summed) == len(at)
    big = phrases.array_row(0, 0, np.array([2**40 + 5, 1, 0], np.int64))
    assert phrases.array_of(big["low"], big["high"]).tolist() == [2**40 + 5, 1, 0]
