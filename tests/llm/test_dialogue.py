"""Repair of conversations against exhaustive search, in one block and in many."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from fleetspan.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, conv string, open int"


def every_repair(kinds):
    """(cost, audit) of all edits of up to two insertions a place, cheapest and ASCII-least first."""
    best = None
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def go(i, last, cost, audit):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(kinds) and last in ("", "a"):
            best = min(best or (cost, audit), (cost, audit))
        for speaker in set("ua") & set(after[last]):
            if not audit.endswith("II"):
                go(i, speaker, cost + 3, audit + "I")
        if i < len(kinds):
            initial, gone, cut = kinds[i]
            go(i + 1, last, cost + 4, audit + "D")
            if not gone:
                if initial and initial in after[last]:
                    go(i + 1, initial, cost + 3 * cut, audit + "K")
                for speaker in set("ua") & set(after[last]):
                    go(i + 1, speaker, cost + 3 + 3 * cut, audit + "R")

    go(0, "", 0, "")
    return best


def expected(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    kinds, seen, counts = [], set(), [0, 0, 0]
    for _, r, x in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", x)
        again = not blank and (r, x) in seen
        cut = not blank and not again and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", x)
        seen.add((r, x))
        counts = [a + b for a, b in zip(counts, (blank, again, cut))]
        kinds.append((r[:1] if r[:1] in tuple("sua") else "", blank or again, cut))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = every_repair(kinds)
    out, last, i = [], "", 0
    for c in audit:
        if c == "D":
            i += 1
        elif c == "K":
            out.append(rows[i][1] + ":" + rows[i][2])
            last, i = rows[i][1][:1], i + 1
        else:
            last = "a" if last == "u" else "u"
            out.append({"u": "user", "a": "assistant"}[last] + ":" + (rows[i][2] if c == "R" else ""))
            i += c == "R"
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "Where is it?", "on the way", " ", "", None, "Done!\n", "Late. \x0b", "Yes"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choices(roles, [5, 5, 2, 1, 1, 1])[0], rng.choice(texts)) for c in [*range(60), None] for _ in range(rng.randint(1, 7))]
    rows += [(500, t, "ua"[t % 2] + "x", f"row {t}." if t % 7 else "same.") for t in range(40)]
    return rows


@pytest.mark.parametrize("block_rows", [4096, 3, 1])
def test_repairs_against_all_edits(spark, turns, block_rows):
    small = [r for r in turns if r[0] != 500]
    want = {}
    for c, *r in small:
        want.setdefault(c, []).append(tuple(r))
    df = spark.createDataFrame([(*r, "x", 1) for r in small], SCHEMA)
    got = dialogue.repair_conversations(df, block_rows=block_rows).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == expected(want[r["conv_id"]]), r


def test_blocks_change_nothing(spark, turns):
    df = spark.createDataFrame([(*r, "x", 1) for r in turns], SCHEMA)
    whole, *others = [sorted(map(tuple, dialogue.repair_conversations(df.repartition(n), block_rows=b).collect()), key=str) for n, b in ((1, 4096), (5, 2), (3, 7))]
    assert all(o == whole for o in others)


def test_long_conversation_and_empty_table(spark):
    n = 20_000
    df = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"{t}." if t % 1000 else "again.") for t in range(n)], "conv_id long, turn long, role string, text string")
    row = dialogue.repair_conversations(df).first()
    # every even thousandth says the same, as the user; all but the first go
    assert row["duplicate"] == n // 1000 - 1 and len(row["audit"]) >= n and row["gaps"] == 0
    none = df.limit(0)
    assert dialogue.repair_conversations(none).count() == 0 and dialogue.repair_conversations(none).columns[0] == "conv_id"


def test_weights_are_read_back():
    ends = dialogue.weights([("u", False, False), ("u", False, True)])[0]
    assert [w and (w >> 15) for w in ends] == [8, None, 4, 6]
    cost, slots = dialogue.read_weight(ends[dialogue.ASSISTANT], 2)
    assert (cost, slots) == (6, ["K", "R", ""])


def test_damage(spark):
    df = spark.createDataFrame([(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    import zlib

    want = []
    for r in df.collect():
        said = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{said(r[0])}:{said(r[1])}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", said(r[3])) if k == 2 else said(r[3])
        want += [(r[0], r[1], "user" if k == 4 else said(r[2]), text)] * {0: 0, 3: 2}.get(k, 1)
    assert sorted(map(str, map(tuple, dialogue.damaged_turns(df).collect()))) == sorted(map(str, want))
