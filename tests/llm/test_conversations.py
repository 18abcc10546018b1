from __future__ import annotations

import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from lumora.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, gaps string, audit string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def by_hand(rows):
    """Cheapest edits of (role, text, fault) rows by a search over whole edit strings, least string first among equal costs."""
    heap, seen = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in out)
        if i == len(rows) and GRAMMAR.match(initials):
            return cost, audit, out
        if (audit, i, out) in seen or len(audit) > 2 * len(rows) + 3:
            continue
        seen.add((audit, i, out))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if fault not in ("B", "U"):
                more = 3 if fault == "T" else 0
                if role[:1] in "sua" and role:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, (*out, (new, text))))
    raise AssertionError


def judged(rows):
    """(role, text, fault) of rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in sorted(((t is not None, t or 0), r or " ", " " if x is None else x) for t, r, x in rows):
        body = text.strip(" \t\n\v\f\r")
        fault = "B" if not body else "U" if (role, text) in seen else "T" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = []
    for conv in range(40):
        for turn in range(rnd.randint(1, 4)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            out.append((conv if conv else None, rnd.choice([turn, turn, turn + 2, None]), role, rnd.choice(["Yes.", "No!", "Cut", " \n", "", "Yes.", "Long " * 2000 + "?"])))
    return [*out, (900, None, None, None), (901, 5, "user", "Alone."), (901, 5, "user", "Alone.")]


def want(rows):
    groups = {}
    for conv, *row in rows:
        groups.setdefault(conv, []).append(row)
    for conv, group in groups.items():
        known = judged(group)
        cost, audit, out = by_hand(known)
        turns = {t for t, _, _ in group if t is not None}
        initials = [r[:1] for r, _, _ in known]
        count = {f: sum(x == f for _, _, x in known) for f in "BUT"}
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        yield conv, (gaps, count["B"], count["U"], count["T"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest())


@pytest.mark.parametrize("how", [{}, {"long_rows": 1, "segment_bits": 1}, {"long_rows": 1, "segment_bits": 0}])
def test_repair(spark, rows, how):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair(df, **how).collect()}
    assert got == dict(want(rows))


def test_turns(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    for how in ({}, {"long_rows": 1, "segment_bits": 1}):
        turns = {}
        for r in sorted(C.repair(df, turns=True, **how).collect(), key=lambda r: r["pos"]):
            turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        hashes = {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in turns.items()}
        assert hashes == {c: v[-1] for c, v in want(rows) if v[-1] != hashlib.sha256(b"").hexdigest()}


def test_random_solutions():
    rnd = random.Random(6)
    for _ in range(400):
        rows = [(rnd.choice(["system", "user", "assistant", "tool"]), str(i), rnd.choice(["", "", "T", "B", "U"])) for i in range(rnd.randint(0, 5))]
        known = [(r[:1], f) for r, _, f in rows]
        before, steps = C.solve(known)
        edits, q = C.follow(known, steps)
        cost, audit, _ = by_hand(rows)
        assert (before[0], edits + C.closing(q)) == (cost, audit)


def test_gone_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (2, 0, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string").withColumn("gone", F.col("conv_id") == 1)
    got = {r["conv_id"]: r for r in C.repair(df, gone_col="gone").collect()}
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and got[2]["audit"] == "KI"
    assert C.repair(df.where("false")).collect() == []
    assert C.damage(df.drop("gone").where("false")).collect() == []


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "A. B! C?") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    got = C.damage(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    space = lambda v: " " if v is None else str(v)
    expect = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        row = (c, t, "user" if h == 4 else space(role), "" if h in (0, 1) else " A B C"[1:] if h == 2 else space(text), h == 0)
        expect += [row] * (2 if h == 3 else 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expect))
