"""Repair of conversations against a plain programme over whole strings."""

import hashlib
import random
import zlib

import pytest

from pairloom.llm import turn_repair

SCHEMA = "text string, conv_id long, score string, turn long, role string, id string"
NAMES = {"u": "user", "a": "assistant"}


def after(state):
    return "a" if state == "u" else "u"


def with_insertions(best):
    best, again = dict(best), True
    while again:
        again = False
        for state, (cost, audit, turns) in list(best.items()):
            n = after(state)
            new = (cost + 3, audit + "I", (*turns, f"{NAMES[n]}:"))
            if n not in best or new[:2] < best[n][:2]:
                best[n], again = new, True
    return best


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of each conversation of rows (conv_id, turn, role, text)."""
    found, blank = {}, lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        own, kind = found.setdefault(conv, []), zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else blank(role), "" if kind == 1 else blank(text)
        text = "".join(c for c in text if c not in ".!?") if kind == 2 else text
        own += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    return {conv: plain_conversation(own) for conv, own in found.items()}


def plain_conversation(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials, turns = [r[1][:1] for r in rows], [r[0] for r in rows if r[0] is not None]
    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def offer(state, cost, audit, turns, new=new):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, turns)

        for state, (cost, audit, made) in with_insertions(best).items():
            offer(state, cost + 4, audit + "D", made)
            if fault not in ("blank", "duplicate"):
                more, n = 3 * (fault == "truncated"), after(state)
                offer(n, cost + 3 + more, audit + "R", (*made, f"{NAMES[n]}:{text}"))
                if role[:1] == n or (role[:1] == "s" and state == ""):
                    offer(role[:1], cost + more, audit + "K", (*made, f"{role}:{text}"))
        best = new
    last = with_insertions(best)
    cost, audit, made = min((last[s] for s in ("", "a") if s in last), key=lambda x: x[:2])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def got_of(df, **sizes):
    rows = turn_repair.repaired(df, **sizes).collect()
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def some_rows(seed, n, conversations):
    r = random.Random(seed)
    roles, texts = [None, "user", "assistant", "system", "tool", "", "s2"], [None, "", "a.", "b", "c!", "x? ", "same.", "  \n", "...", "é .", "long " * 3000 + "."]
    return [(r.choice([None, *range(conversations)]), r.choice([None, *range(12)]), r.choice(roles), r.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize(("seed", "n", "conversations", "block"), [(1, 600, 60, 512), (2, 800, 6, 5), (3, 2000, 3, 17), (4, 300, 1, 1)])
def test_repairs_are_the_plain_ones(spark, seed, n, conversations, block):
    """Nulls in all columns, ties, repeated rows, clashing columns; one conversation over several tasks, and over blocks of any length."""
    rows = some_rows(seed, n, conversations)
    assert got_of(spark.createDataFrame([(x, c, "score", t, r, "id") for c, t, r, x in rows], SCHEMA), block=block, most=64) == plain_repair(rows)


def test_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got_of(table) == plain_repair([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_merged_sides_give_the_same(spark, monkeypatch):
    """Marks and places of blocks are merged, not broadcast, where they are many."""
    monkeypatch.setattr(turn_repair, "picked", lambda keys: (False, keys.hint("merge")))
    rows = some_rows(5, 500, 20)
    assert got_of(spark.createDataFrame([(x, c, "score", t, r, "id") for c, t, r, x in rows], SCHEMA)) == plain_repair(rows)


def test_nothing_left_and_empty_tables(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = [("x.", 7, "s", gone, "user", "i")]
    assert got_of(spark.createDataFrame(rows, SCHEMA)) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got_of(spark.createDataFrame([], SCHEMA)) == {}
