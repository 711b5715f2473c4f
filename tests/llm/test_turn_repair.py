"""Conversation repair against a search over all edits, whole and in segments."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import product

import numpy as np
import pytest

from convoq.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, messages int, uid int, rows int"
sys.setrecursionlimit(10_000)
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = lambda x: " " if x is None else str(x)
        how = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if how == 1:
            text = ""
        if how == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv, turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, messages) of the ASCII-least of the cheapest edits, by trying all."""

    def follows(state, initial):
        return {"u": state in ("", "s", "a"), "a": state == "u", "s": state == ""}.get(initial, False)

    @lru_cache(None)
    def best(i, state, inserts):
        need = "assistant" if state == "u" else "user"
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            c, a, m = best(i, need[0], inserts + 1)
            found.append((c + 2, "I" + a, ((need, ""), *m)))
        if i < len(rows):
            c, a, m = best(i + 1, state, 0)
            found.append((c + 3, "D" + a, m))
            _, _, role, text = rows[i]
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if follows(state, role[:1]):
                    c, a, m = best(i + 1, role[:1], 0)
                    found.append((c + more, "K" + a, ((role, text), *m)))
                c, a, m = best(i + 1, need[0], 0)
                found.append((c + 2 + more, "R" + a, ((need, text), *m)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def plain(rows):
    held = defaultdict(list)
    for r in damage(rows):
        held[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(held[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            core = text.strip(SPACE)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit, messages = cheapest(own, faults)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def repaired(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(parts)
    got = turn_repair.report(turn_repair.repaired(turn_repair.damaged(df))).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def conversation(rng, conv, n, roles=("user", "assistant", "user", "assistant", "system", "tool", "")):
    texts = ["Yes.", "no", "What?", "Well, then!", " ", "", "End.  ", "a b", None]
    text = lambda: rng.choice(texts) if rng.random() < 0.5 else f"Turn {rng.randrange(50)}" + rng.choice(".!? x")
    return [(conv, t if rng.random() < 0.9 else None, rng.choice([*roles, None]), text()) for t in range(n)]


@pytest.mark.parametrize("segment", [1024, 3])
def test_equal_to_a_search_over_all_edits(spark, segment, monkeypatch):
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    rng = random.Random(segment)
    rows = [r for conv in range(60) for r in conversation(rng, conv, rng.choice([1, 2, 3, 5, 8, 13]))]
    rows += conversation(rng, None, 40) + conversation(rng, 1000, 150) + conversation(rng, 1001, 90, ("user", "assistant"))
    assert repaired(spark, rows) == plain(rows)


def test_odd_conversations(spark):
    gone = next(t for t in range(200) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = [(7, gone, "user", "All of it is dropped.")]
    rows += [(8, None, None, None)] * 3 + [(None, None, "user", "Same row.")] * 40  # repeated rows, all nulls
    rows += [(9, 5, "user", "Ties."), (9, 5, "assistant", "Ties."), (9, 5, "user", "ties"), (9, 50, "system", "Late.")]
    rows += [(10, 0, "user", "x" * 3_000_000 + "."), (10, 1, "assistant", "y" * 3_000_000), (10, 2, "user", "　")]  # long texts; white space of another kind
    rows += [(11, t, "user", "The same.") for t in range(30)]
    got = repaired(spark, rows)
    assert got == plain(rows)
    assert got[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.report(turn_repair.repaired(turn_repair.damaged(empty))).count() == 0


def test_one_long_conversation_is_spread(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "SEGMENT", 16)
    rows = conversation(random.Random(5), 3, 700)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    found = turn_repair.repaired(turn_repair.damaged(df)).collect()
    assert len(found) > 30 and max(len(r.messages) for r in found) <= 16 * 4
    want = plain(rows)
    assert repaired(spark, rows) == want and "".join(r.audit for r in sorted(found, key=lambda r: (r.turn is not None, r.turn or 0, r.role, r.digest, r.uid))) == want[3][6]


def test_least_costs_of_all_short_conversations():
    """Every sequence of up to four turns of four kinds of role, whole or cut off: costs and audits, all columns of one tensor."""
    kinds = [(r, f) for r in ("user", "assistant", "system", "tool") for f in (None, "truncated")] + [("user", "blank")]
    cases = [list(c) for n in range(4) for c in product(kinds, repeat=n)]
    turns = []
    for c in cases:
        t = turn_repair.Turns([])
        t.role = np.array([turn_repair._CODE.get(r[:1], 3) for r, _ in c], np.int8)
        t.gone, t.cut = np.array([f == "blank" for _, f in c], bool), np.array([f == "truncated" for _, f in c], bool)
        turns.append(t)
    audits, costs, _ = turn_repair.solved(turns, np.tile(turn_repair._END, (len(cases), 1)), np.zeros(len(cases), np.int64))
    for c, audit, cost in zip(cases, audits, costs, strict=True):
        assert (cost, audit) == cheapest(tuple((0, 0, r, "x") for r, _ in c), tuple(f for _, f in c))[:2], c
