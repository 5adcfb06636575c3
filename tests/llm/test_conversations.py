"""Conversation repair against all ways of editing, on small conversations and across segments."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from plumbline.llm import conversations

FORM = "conv_id long, turn long, role string, text string, row string, text_2 string"
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    """The rows after damage, by the words of the task."""
    out = []
    for conv, turn, role, text, *_ in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(name.encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        rest = text.strip(SPACES)
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "" if rest[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired) by trying every way of at most two inserts in each gap."""
    best = None
    name = {"u": "user", "a": "assistant"}
    edits = []
    for (_, _, role, text), fault in zip(rows, found, strict=True):
        cut = 3 if fault == "truncated" else 0
        own = [("D", 4, "", None)]
        if fault not in ("blank", "duplicate"):
            # an empty role is no role
            own += [("K", cut, role[:1] or "?", f"{role}:{text}")] + [("R", 3 + cut, r, f"{name[r]}:{text}") for r in "ua"]
        edits.append(own)
    fills = [("I" * k, 3 * k, "".join(r), [f"{name[x]}:" for x in r]) for k in range(3) for r in itertools.product("ua", repeat=k)]
    ways = [(0, "", "", [])]
    for own in [*edits, None]:
        grown = []
        for cost, audit, roles, lines in ways:
            for fa, fc, fr, fl in fills:
                for a, c, r, line in own or [("", 0, "", None)]:
                    shown = roles + fr + r
                    if re.fullmatch("s?(ua)*u?", shown):
                        grown.append((cost + fc + c, audit + fa + a, shown, lines + fl + ([] if line is None else [line])))
        # what ends in the same grammar and costs over six more than another cannot win: six buys any inserts
        least = min(w[0] for w in grown)
        ways = [w for w in grown if w[0] <= least + 6]
    best = min((w for w in ways if re.fullmatch("(s?(ua)+)?", w[2])), key=lambda w: (w[0], w[1]))
    return best[0], best[1], "\n".join(best[3])


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in damaged(rows) if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        found = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, text = cheapest(mine, found)
        out[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit,
                     hashlib.sha256(text.encode()).hexdigest(), text)
    return out


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], FORM).repartition(parts)


def results(spark, rows, **options):
    turns, copies = conversations.damage(table(spark, rows))
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"], r["repaired"])
            for r in conversations.repair(turns, copies=copies, **options).collect()}


def made(rng, convs, longest):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(0, longest)):
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(["system", "user", "user", "assistant", "tool", "", None]),
                         rng.choice(["Yes.", "No", "", " \t", "Why? ", "Ok.\n", None, "über!", "Sure.", "Fine."])))
    return rows


@pytest.mark.parametrize("options", [{}, {"segment_turns": 2}, {"segment_bytes": 150}])
def test_repair(spark, options):
    rows = made(random.Random(7), 90, 6)
    rows += [rows[0]] * 3
    want = expected(rows)
    got = results(spark, rows, **options)
    assert got == want


def test_long_conversation_is_one_result(spark):
    rng = random.Random(3)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{'word ' * rng.randint(1, 30)}{t}{rng.choice(['.', '.', ''])}") for t in range(4000)]
    rows += [(2, t, "user", "same.") for t in range(500)] + [(3, 5, "user", "x." * 300_000)]
    whole = results(spark, rows)
    assert results(spark, rows, segment_turns=100) == whole == results(spark, rows, segment_bytes=5000)
    assert whole[2][2] + whole[2][1] > 400 and whole[2][6].count("K") <= 1
    plain = table(spark, [(4, t, r, "Well.") for t, r in enumerate(["system", "user", "assistant"])])
    assert [(r["cost"], r["audit"]) for r in conversations.repair(plain).collect()] == [(0, "KKK")]


def test_no_turns_and_no_rows(spark):
    empty = table(spark, [])
    assert conversations.repair(empty).count() == 0
    turns, copies = conversations.damage(empty)
    assert conversations.repair(turns, copies=copies, texts=False).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert results(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), "")}


def test_ranks_order_whole_strings():
    """A layer's ranks put its ways in the order of their strings, and their costs are least."""
    rng = random.Random(11)
    for _ in range(300):
        kinds = [(rng.choice(["s", "u", "a", ""]), rng.random() < 0.3, rng.random() < 0.3) for _ in range(rng.randint(0, 6))]
        cost, layer, pointers = conversations.through(kinds, conversations.START)
        strings = {s: "".join(conversations.CODES[c] for c in conversations.codes_to(pointers, s)) for s in range(4) if layer[s] is not None}
        assert sorted(strings, key=lambda s: layer[s][1]) == sorted(strings, key=strings.get)
