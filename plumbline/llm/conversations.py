"""Repair of conversation structure: the cheapest edits that make roles alternate.

A conversation's turns are kept (0), given the other role (3) or deleted (4), and empty turns are inserted (3), so that the
initials of roles read ``(s?(ua)+)?``; blank and repeated turns must go, cut-off ones cost 3 more if they stay. Of the cheapest
ways the one with the least string of edit initials (D, I, K, R) wins.

Method. A macro edit is a run of inserts with the turn's own edit after it: I..ID, I..IK or I..IR. These codes are prefix-free, and
sorted they stand in the order of the strings that they make; so among ways through equally many turns, order is that of the
first macro edit that differs, and a way's whole string may be replaced by its rank in its layer. A layer holds for each of four
states of the grammar the least cost and rank, a pointer to the state before, and the code. Layers repeat, as only
differences of cost count, so a step is a table lookup. Strings are rebuilt backwards from the pointers.

Scale. Turns are range-partitioned by conversation and place, so that a conversation of any length spreads over
tasks. Conversations inside one partition are finished there. Those on its edges, or longer than a segment, go on
as segments: each gives its costs and ranks from every state to every state, these are chained in order, and then each segment
rebuilds its piece. Only the hash of a repaired conversation and its string of edits go through one task, as a stream.

Defined results: null roles and texts are one space; null turns come first; rows of one turn are ordered by role and text, and
equal rows follow each other; a null conversation id is one of its own; a conversation without turns has zeros, no edits and the hash of
the empty string; roles are told apart by their first letter, and a turn whose role begins with no s, u or a, or is empty, is never kept as it is.
Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .wordblocks import arrow_type, batches

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: Turns and bytes of a segment of a conversation.
SEGMENT_TURNS, SEGMENT_BYTES = 50_000, 4_000_000
#: States of the grammar: nothing yet, after s, after u, after a whole pair.
START, SYSTEM, USER, PAIR = range(4)
#: The role that may follow each state besides a leading s, and the state that it leads to.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", PAIR), PAIR: ("user", USER)}
#: Inserts that may be of use before a turn; more would come back to a state at a cost.
RUNS = {START: 2, SYSTEM: 2, USER: 1, PAIR: 1}
#: Inserts that complete the pair at the end.
TAIL = {START: 0, SYSTEM: 2, USER: 1, PAIR: 0}
CODES = sorted("I" * k + edit for k in range(3) for edit in "DKR")
LEGAL = {"su", "ua", "au"}

Layer = tuple  # for each state None or (cost over the layer's least, rank)


@cache
def moves(initial: str, must_go: bool, cut: bool) -> list[tuple[int, int, int, int]]:
    """(state before, code, state after, cost) of all macro edits of a turn."""
    out = []
    stay = CUT_OFF if cut else 0
    for state in range(4):
        at = state
        for k in range(RUNS[state] + 1):
            cost, code = k * INSERT, lambda edit, k=k: CODES.index("I" * k + edit)
            out.append((state, code("D"), at, cost + DELETE))
            if not must_go:
                role, to = NEXT[at]
                if initial == role[0]:
                    out.append((state, code("K"), to, cost + KEEP + stay))
                if initial == "s" and at == START:
                    out.append((state, code("K"), SYSTEM, cost + KEEP + stay))
                out.append((state, code("R"), to, cost + REROLE + stay))
            at = NEXT[at][1]
    return out


@cache
def step(layer: Layer, initial: str, must_go: bool, cut: bool) -> tuple[int, Layer, tuple]:
    """(least cost added, next layer, pointers (state before, code) by state)."""
    best: list = [None] * 4
    for before, code, after, cost in moves(initial, must_go, cut):
        if layer[before] is not None:
            c, rank = layer[before]
            found = (c + cost, rank, code, before)
            if best[after] is None or found < best[after]:
                best[after] = found
    return (*ranked([None if b is None else (b[0], (b[1], b[2])) for b in best]), tuple(None if b is None else (b[3], b[2]) for b in best))


def ranked(ways: list) -> tuple[int, Layer]:
    """Least cost, and the layer with costs above it and dense ranks in place of what orders the ways."""
    there = [w for w in ways if w is not None]
    low = min(c for c, _ in there)
    order = {o: i for i, o in enumerate(sorted({o for _, o in there}))}
    return low, tuple(None if w is None else (w[0] - low, order[w[1]]) for w in ways)


def entry(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in range(4))


def through(kinds: list[tuple], state: int) -> tuple[int, Layer, list[tuple]]:
    """Cost, last layer and pointers of each turn, from one state."""
    cost, layer, pointers = 0, entry(state), []
    for kind in kinds:
        added, layer, back = step(layer, *kind)
        cost += added
        pointers.append(back)
    return cost, layer, pointers


def codes_to(pointers: list[tuple], state: int) -> list[int]:
    """The macro edits of the way that ends in the state."""
    out = []
    for back in reversed(pointers):
        state, code = back[state]
        out.append(code)
    return out[::-1]


def best_end(cost: int, layer: Layer) -> tuple[int, int]:
    """(cost, last state) of the best way, with the inserts that complete it."""
    c, _, _, s = min((cost + w[0] + TAIL[s] * INSERT, w[1], TAIL[s], s) for s, w in enumerate(layer) if w is not None)
    return c, s


def lines(rows: list[tuple[str, str]], codes: list[int], state: int) -> list[str]:
    """The repaired turns as ``role:text``."""
    out = []
    for (role, text), code in zip(rows, codes, strict=True):
        edits = CODES[code]
        for _ in edits[:-1]:
            name, state = NEXT[state]
            out.append(f"{name}:")
        if edits[-1] == "K":
            out.append(f"{role}:{text}")
            state = SYSTEM if role[:1] == "s" else NEXT[state][1]
        elif edits[-1] == "R":
            name, state = NEXT[state]
            out.append(f"{name}:{text}")
    return out


def tail_lines(state: int) -> list[str]:
    out = []
    for _ in range(TAIL[state]):
        name, state = NEXT[state]
        out.append(f"{name}:")
    return out


class Facts:
    """Counts of faults of a run of turns, which merge with those of the run after it."""

    def __init__(self):
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.first = self.last = None

    def add(self, turn, role: str, fault: str) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.first = initial if self.first is None else self.first
        self.last = initial
        self.rows += 1
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)

    def then(self, more: list) -> None:
        """Adds what ``values`` gave for the run that follows."""
        rows, blank, duplicate, truncated, illegal, turns, low, high, first, last = more
        if self.rows and rows:
            illegal += self.last + first not in LEGAL
        if low is not None and low == self.high:
            turns -= 1
        self.rows, self.blank, self.duplicate, self.truncated = self.rows + rows, self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal, self.turns = self.illegal + illegal, self.turns + turns
        self.low = low if self.low is None else self.low
        self.high = self.high if high is None else high
        self.first = first if self.first is None else self.first
        self.last = self.last if last is None else last

    def values(self) -> list:
        return [self.rows, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high, self.first, self.last]

    def counts(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


def fault_of(text: str, seen: bool) -> str:
    rest = text.rstrip(SPACE)
    if not rest:
        return "blank"
    if seen:
        return "duplicate"
    return "" if rest[-1] in ".!?" else "truncated"


def kind_of(role: str, fault: str) -> tuple[str, bool, bool]:
    initial = role[:1]
    return initial if initial in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated"


def digest(conv, role: str, text: str) -> bytes:
    head = f"{conv!r}\0{len(role)}\0{role}".encode()
    return hashlib.blake2b(head + text.encode(), digest_size=16).digest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"


def _finished(rows: list[tuple], texts: bool) -> dict:
    """All results of a whole conversation of rows (turn, role, text), in order."""
    facts, kinds, seen = Facts(), [], set()
    for turn, role, text in rows:
        mark = (role, text)
        fault = fault_of(text, mark in seen)
        seen.add(mark)
        facts.add(turn, role, fault)
        kinds.append(kind_of(role, fault))
    cost, layer, pointers = through(kinds, START)
    cost, state = best_end(cost, layer)
    codes = codes_to(pointers, state)
    whole = "\n".join(lines([(r, t) for _, r, t in rows], codes, START) + tail_lines(state))
    return facts.counts() | {"cost": cost, "audit": "".join(CODES[c] for c in codes) + "I" * TAIL[state],
                             "repaired_sha256": hashlib.sha256(whole.encode()).hexdigest(), "repaired": whole if texts else None}


def cells(found: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of record batches as tuples, a thousand at a time."""
    for batch in found:
        for i in range(0, batch.num_rows, 1000):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns), strict=True)


def merged(rows: DataFrame) -> DataFrame:
    """The rows with equal ones of a batch counted together, so that a turn repeated without end is few rows."""
    schema = rows.schema

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            counted: dict[tuple, int] = {}
            for *row, copies in cells([batch]):
                counted[tuple(row)] = counted.get(tuple(row), 0) + copies
            yield pa.RecordBatch.from_pydict({f.name: v for f, v in zip(batch.schema, zip(*((*k, n) for k, n in counted.items()), strict=True), strict=True)},
                                             batch.schema) if counted else batch

    return rows.mapInArrow(run, schema)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           copies: Column | None = None, texts: bool = True, segment_turns: int = SEGMENT_TURNS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired), a row per conversation.

    ``copies``: how often a row stands there; 0 only names its conversation. ``texts``: whether to give the repaired
    conversation itself, its turns as ``role:text`` on lines of their own, or null.
    """
    spark = turns.sparkSession
    n = common.partitions(spark)
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    count = F.lit(1).cast("long") if copies is None else copies.cast("long")
    there = count > 0
    rows = turns.select(F.col(conv).alias("conv"), F.when(there, F.col(turn)).cast("long").alias("turn"), F.when(there, space(role)).otherwise("").alias("role"),
                        F.when(there, space(text)).otherwise("").alias("text"), count.alias("copies"))
    conv_form, conv_type = rows.schema["conv"].dataType.simpleString(), arrow_type(rows, "conv")
    # A text's beginning stands for it among the bounds of ranges, so that they stay short.
    ranged = (merged(rows).repartitionByRange(n, "conv", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 32))
              .sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text"))
    open_form = "seg long, at long, turn long, role string, text string, copies long, mark binary"
    open_types = [("seg", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()),
                  ("mark", pa.binary())]
    result_types = [*((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                    *((c, pa.string()) for c in ("audit", "repaired_sha256", "repaired"))]
    first_schema = pa.schema([("conv", conv_type), *open_types, *result_types])

    def first_pass(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def as_open(conv, held: list[tuple], seg: int) -> Iterator[dict]:
            for at, (turn, role, text, copies) in enumerate(held):
                yield {"conv": conv, "seg": part << 32 | seg, "at": at, "turn": turn, "role": role, "text": text, "copies": copies, "mark": digest(conv, role, text)}

        def out() -> Iterator[dict]:
            now, held, size, seg, edge, begun = None, [], 0, 0, True, False
            for conv, *row in cells(found):
                if begun and conv != now:
                    if edge:
                        yield from as_open(now, held, seg)
                        seg += 1
                    else:
                        yield {"conv": now} | _finished([(t, r, x) for t, r, x, c in held for _ in range(c)], texts)
                    held, size, edge = [], 0, False
                begun, now = True, conv
                held.append(tuple(row))
                size += len(row[2]) + 100 * row[3]
                if len(held) >= segment_turns or size >= segment_bytes:  # too long for one piece
                    yield from as_open(now, held, seg)
                    held, size, edge, seg = [], 0, True, seg + 1
            if begun and held:
                yield from as_open(now, held, seg)

        yield from batches(out(), first_schema)

    first = common.saved(ranged.mapInArrow(first_pass, f"conv {conv_form}, {open_form}, {RESULT}"), "conversations")
    done = first.where("seg is null").select("conv", *[c.split()[0] for c in RESULT.split(", ")])
    return done.unionByName(_across(first.where("seg is not null"), conv_form, conv_type, texts, n)).withColumnRenamed("conv", conv)


def _across(opened: DataFrame, conv_form: str, conv_type: pa.DataType, texts: bool, n: int) -> DataFrame:
    """Results of conversations that lie in several partitions or segments."""
    place = F.struct("seg", "at")
    repeated = opened.where("copies > 0").groupBy("mark").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = common.saved(opened.join(repeated, "mark", "left").select(
        "conv", "seg", "at", "turn", "role", "text", "copies", F.coalesce(place > F.col("first"), F.lit(False)).alias("seen")), "segments")
    summary_schema = pa.schema([("conv", conv_type), ("seg", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())),
                                ("facts", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string())])
    summary_form = f"conv {conv_form}, seg long, costs array<long>, ranks array<long>, facts array<long>, first string, last string"

    def spelled(rows: list[tuple]) -> tuple[list[tuple], list[tuple], Facts]:
        """Each turn as often as it stands there, its kind, and the facts of all."""
        turns, kinds, facts = [], [], Facts()
        for _, _, _, turn, role, text, copies, seen in rows:
            for k in range(copies):
                fault = fault_of(text, seen or k > 0)
                facts.add(turn, role, fault)
                kinds.append(kind_of(role, fault))
                turns.append((role, text))
        return turns, kinds, facts

    def runs(rows: Iterable[tuple], key: int) -> Iterator[list[tuple]]:
        """Rows in a row with an equal cell; one run is held at a time."""
        held: list[tuple] = []
        for row in rows:
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
        if held:
            yield held

    def summaries(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for rows in runs(cells(found), 1):
                _, kinds, facts = spelled(rows)
                costs, ranks = [], []
                for s in range(4):
                    cost, layer, _ = through(kinds, s)
                    costs += [None if w is None else cost + w[0] for w in layer]
                    ranks += [None if w is None else w[1] for w in layer]
                *numbers, first, last = facts.values()
                yield {"conv": rows[0][0], "seg": rows[0][1], "costs": costs, "ranks": ranks, "facts": numbers, "first": first, "last": last}

        yield from batches(out(), summary_schema)

    by_segment = lambda df: df.repartition(n, "seg").sortWithinPartitions("seg", "at")
    by_conv = lambda df: df.repartition(n, "conv").sortWithinPartitions("conv", "seg")
    summed = by_segment(marked).mapInArrow(summaries, summary_form)

    chain_schema = pa.schema([("conv", conv_type), ("seg", pa.int64()), ("enter", pa.int64()), ("leave", pa.int64()), ("counts", pa.list_(pa.int64()))])

    def chain(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for rows in runs(cells(found), 0):
                cost, layer, facts, back = 0, entry(START), Facts(), []
                for _, _, costs, ranks, numbers, first, last in rows:
                    best: list = [None] * 4
                    for s, w in enumerate(layer):
                        for e in range(4):
                            if w is not None and costs[4 * s + e] is not None:
                                way = (w[0] + costs[4 * s + e], (w[1], ranks[4 * s + e]), s)
                                if best[e] is None or way < best[e]:
                                    best[e] = way
                    added, layer = ranked([None if b is None else b[:2] for b in best])
                    cost += added
                    back.append([None if b is None else b[2] for b in best])
                    facts.then([*numbers, first, last])
                cost, state = best_end(cost, layer)
                counts = [*facts.counts().values(), cost, state]
                for row, before in zip(reversed(rows), reversed(back), strict=True):
                    yield {"conv": row[0], "seg": row[1], "enter": before[state], "leave": state, "counts": None}
                    state = before[state]
                yield {"conv": rows[0][0], "seg": -1, "enter": None, "leave": None, "counts": counts}

        yield from batches(out(), chain_schema)

    chained = common.saved(by_conv(summed).mapInArrow(chain, f"conv {conv_form}, seg long, enter long, leave long, counts array<long>"), "chain")
    led = marked.withColumn("enter", F.lit(None).cast("long")).withColumn("leave", F.lit(None).cast("long")).unionByName(
        chained.where("seg >= 0").select("conv", "seg", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                                         F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(False).alias("seen"), "enter", "leave"))
    piece_schema = pa.schema([("conv", conv_type), ("seg", pa.int64()), ("audit", pa.string()), ("piece", pa.string())])

    def pieces(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for rows in runs(cells(found), 1):
                head, body = rows[0], [r[:8] for r in rows[1:]]
                turns, kinds, _ = spelled(body)
                _, _, pointers = through(kinds, head[8])
                codes = codes_to(pointers, head[9])
                made = lines(turns, codes, head[8])
                yield {"conv": head[0], "seg": head[1], "audit": "".join(CODES[c] for c in codes), "piece": "\n".join(made) if made else None}

        yield from batches(out(), piece_schema)

    cut = by_segment(led).mapInArrow(pieces, f"conv {conv_form}, seg long, audit string, piece string")
    ended = cut.withColumn("counts", F.lit(None).cast("array<long>")).unionByName(
        chained.where("seg < 0").select("conv", "seg", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("piece"), "counts"))
    last_schema = pa.schema([("conv", conv_type), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                             *((c, pa.string()) for c in ("audit", "repaired_sha256", "repaired"))])

    def last(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(conv, counts: list, audit: list, hashed, some: bool, held: list) -> dict:
            state = counts[6]
            for line in tail_lines(state):
                hashed.update((("\n" if some else "") + line).encode())
                held.append(line)
                some = True
            return {"conv": conv, **dict(zip(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), counts, strict=False)),
                    "audit": "".join(audit) + "I" * TAIL[state], "repaired_sha256": hashed.hexdigest(), "repaired": "\n".join(held) if texts else None}

        def out() -> Iterator[dict]:
            counts = None
            for conv, _, edits, piece, numbers in cells(found):
                if numbers is not None:  # the head of the next conversation
                    if counts is not None:
                        yield close(now, counts, audit, hashed, some, held)
                    now, counts, audit, hashed, some, held = conv, numbers, [], hashlib.sha256(), False, []
                    continue
                audit.append(edits)
                if piece is not None:
                    hashed.update((("\n" if some else "") + piece).encode())
                    some = True
                    if texts:
                        held.append(piece)
            if counts is not None:
                yield close(now, counts, audit, hashed, some, held)

        yield from batches(out(), last_schema)

    return by_conv(ended).mapInArrow(last, f"conv {conv_form}, {RESULT}")


def damage(turns: DataFrame) -> tuple[DataFrame, Column]:
    """The rows of a table of conversations with faults sown by crc32 of ``conv_id:turn``, and how often each stands there."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = turns.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), fate.alias("fate"))
    return rows, F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1)
