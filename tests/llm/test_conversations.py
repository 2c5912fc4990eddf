"""Conversation repair against all sequences of edits, over slices of any length."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessera.llm import conversations, registry

GRAMMAR = re.compile("(s?(ua)+)?")
COST = {"K": 0, "R": 3, "D": 4, "I": 3}


def all_edits(turns, most):
    """Every (cost, audit) of a sequence of edits that gives the grammar, at most ``most`` insertions."""
    found = []

    def go(at, roles, audit, cost, inserted):
        if at == len(turns):
            if GRAMMAR.fullmatch(roles):
                found.append((cost, audit))
        else:
            c = turns[at]
            go(at + 1, roles, audit + "D", cost + 4, inserted)
            if c != "-":
                own = cost + 3 * c.isupper()
                go(at + 1, roles + c.lower(), audit + "K", own, inserted)
                for r in "ua":
                    go(at + 1, roles + r, audit + "R", own + 3, inserted)
        if inserted < most:
            for r in "ua":
                go(at, roles + r, audit + "I", cost + 3, inserted + 1)

    go(0, "", "", 0, 0)
    return min(found)


@pytest.mark.parametrize("size", [1, 2, 256])
def test_equals_all_sequences_of_edits(monkeypatch, size):
    monkeypatch.setattr(conversations, "SLICE", size)
    draw = random.Random(3)
    cases = [""] + ["".join(c) for c in itertools.product("suaxUA-", repeat=2)] + ["".join(draw.choice("suuaaxSUAX-") for _ in range(draw.randint(3, 4))) for _ in range(60)]
    for turns in cases:
        assert conversations.plan(turns) == all_edits(turns, 3), turns


def test_slices_agree_on_long_conversations(monkeypatch):
    draw = random.Random(4)
    turns = "".join(draw.choice("suauauaxUA-") for _ in range(700))
    whole = []
    for size in (10_000, 100, 7):
        monkeypatch.setattr(conversations, "SLICE", size)
        whole.append(conversations.plan(turns))
    assert whole[0] == whole[1] == whole[2]


def brute(rows, most=3):
    """The contract, row by row."""
    by, out = defaultdict(list), []
    name = lambda v: " " if v is None else str(v)
    for c, t, role, text in rows:
        h = zlib.crc32(f"{name(c)}:{name(t)}".encode()) % 20
        role, text = name(role), name(text)
        role, text = "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        by[c] += [(t, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()[:16]))
        known = [r[0] for r in own if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        turns, seen, counts = "", set(), [0, 0, 0]
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            i = role[:1] if role[:1] in "sua" and role else "x"
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else 3
            counts = [n + (k == fault) for k, n in enumerate(counts)]
            turns += ("-", "-", i.upper(), i)[fault]
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = all_edits(turns, most)
        state, at, lines = 0, 0, []
        for e in audit:
            role = "ua"[state % 2]
            if e == "I":
                lines.append({"u": "user", "a": "assistant"}[role] + ":")
                state += 1
                continue
            _, own_role, text = own[at]
            at += 1
            if e == "K":
                lines.append(f"{own_role}:{text}")
                state += own_role[:1] != "s"
            elif e == "R":
                lines.append({"u": "user", "a": "assistant"}[role] + ":" + text)
                state += 1
        out.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def made(n=150, most=5):
    draw, rows = random.Random(9), []
    texts = ["One.", "Two!", "three", "", " \t", "Four?\n", "five ", "six. ", None, "é." * 9]
    for c in range(n):
        for t in range(draw.randint(1, most)):
            rows.append((c, draw.choice([t, t, t, None, 2 * t]), draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), draw.choice(texts)))
    return rows + [(None, 0, "user", "a."), (None, None, None, None), rows[0], rows[0], (-7, 1 << 40, "user", "b."), (-7, 3, "assistant", "c.")]


SCHEMA = "conv_id long, turn long, role string, text string, code int, kind string, first string"


def test_query_equals_brute_force(spark, tmp_path):
    rows = made()
    frame = spark.createDataFrame([(*r, 1, "k", "f") for r in rows], SCHEMA)
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["op11_conversations"](spark, str(tmp_path))
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[6] for w in want) > 100 and any(not w[7] for w in want)


def test_turns_have_the_hash_of_the_summary(spark):
    frame = conversations.damaged(spark.createDataFrame(made(40, 9), "conv_id long, turn long, role string, text string"))
    lines = defaultdict(dict)
    for r in conversations.repaired_turns(frame, frame["present"]).collect():
        lines[r.conv_id][r.place] = f"{r.role}:{r.text}"
        assert r.edit != "I" or r.text == ""
    for r in conversations.repaired(frame, frame["present"]).collect():
        own = [lines[r.conv_id][k] for k in range(len(lines[r.conv_id]))]
        assert r.repaired_sha256 == hashlib.sha256("\n".join(own).encode()).hexdigest() and len(own) == sum(e != "D" for e in r.audit)


def test_one_long_conversation_and_none(spark):
    rows = [(1, n, "user" if n % 2 == 0 else "assistant", f"text {n}.") for n in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = conversations.repaired(frame).collect()
    assert (got.cost, got.audit, got.gaps) == (0, "K" * 3000, 0)
    assert conversations.repaired(frame.limit(0)).count() == 0 and conversations.repaired_turns(frame.limit(0)).count() == 0
