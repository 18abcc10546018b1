from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lumora.functions.tiles import is_thirteen_orphans, parse_tiles, tile_code
from lumora.operators.decompose import decompose, waits
from lumora.operators.scoring import HAND, score_hands
from lumora.operators.settlement import balances

_BASE = {"m": 0, "p": 9, "s": 18, "z": 27, "f": 34}


def tiles(text: str) -> list[int]:
    out, digits = [], ""
    for ch in text:
        if ch.isdigit():
            digits += ch
        else:
            out += [_BASE[ch] + int(d) - 1 for d in digits]
            digits = ""
    return out


def hand(i: int, text: str, **kw) -> dict:
    t = tiles(text)
    row = dict(hand_id=i, concealed=t, melds=[], flowers=[], winning_tile=t[-1] if t else None, source="discard", winner=1, discarder=2, dealer=0, round_wind=0, continuations=0, last_tile="none", replacement="none", kong_chain=0, liable_player=None, heavenly=False, earthly=False, confirmed=True, family="hongKong", minimum=3, cap=10, use_flowers=True, base=0, unit=1, payment="preset", overrides={})
    row.update(kw)
    return row


def scored(spark, rows):
    return {r["hand_id"]: r for r in score_hands(spark.createDataFrame(rows, HAND)).collect()}


def test_notation(spark):
    df = spark.createDataFrame([("123m55z1f",), ("1 2 3m",), ("8z",), ("12",), ("",), (None,), ("0m",)], "t string").select("t", parse_tiles(F.col("t")).alias("x"))
    assert [r["x"] for r in df.collect()] == [[0, 1, 2, 31, 31, 34], [0, 1, 2], None, None, [], None, None]
    codes = [r[0] for r in spark.range(-1, 43).select(tile_code(F.col("id").cast("int"))).collect()]
    assert codes[0] is None and codes[-1] is None and codes[1] == "1m" and codes[42] == "8f" and codes[34] == "7z"


LIMITS = [("allHonors", "11122255566677z", 32), ("smallWinds", "111222333z456m44z", 30), ("bigWinds", "111222333444z55m", 4), ("allTerminals", "111999m111999p11s", 0), ("fourHidden", "111m222p333s55566z", 32), ("orphans", "19m19p19s1234567z1m", 0), ("nineGates", "11123456789995m", 4)]


def test_limit_hands_and_anchors(spark):
    rows = [hand(i, text, winning_tile=w, source="selfDraw" if name in ("fourHidden",) else "discard") for i, (name, text, w) in enumerate(LIMITS)]
    rows.append(hand(20, "123456789m123p55s"))
    rows.append(hand(21, "11122233344455m", winning_tile=4))
    rows.append(hand(22, "11122233344455m", winning_tile=4, cap=8))
    rows.append(hand(23, "19m19p19s1234567z1m", winning_tile=8, source="robConcealedKong"))
    rows.append(hand(24, "123456789m123p45s"))
    rows.append(hand(25, "123m"))
    rows.append(hand(26, "123456789m123p55s", source=None))
    got = scored(spark, rows)
    for i, (name, _, _) in enumerate(LIMITS):
        assert [p["id"] for p in got[i]["patterns"]] == [name] and got[i]["score"] == 10 and got[i]["status"] == "valid", name
    assert sum(t["amount"] for t in got[0]["transfers"]) == 512
    assert (got[20]["status"], got[20]["score"]) == ("belowMinimum", 2)
    assert [p["id"] for p in got[21]["patterns"]] == ["fourHidden"]
    assert (got[22]["raw_score"], got[22]["score"], sum(t["amount"] for t in got[22]["transfers"])) == (10, 8, 256)
    assert sum(t["amount"] for t in got[23]["transfers"]) == 768
    assert [got[i]["status"] for i in (24, 25, 26)] == ["invalid", "incomplete", "needsContext"]


def test_zero_sum_and_order(spark):
    rnd, rows = random.Random(5), []
    while len(rows) < 120:
        t = [x for _ in range(4) for x in (lambda a: [a] * 3 if rnd.random() < 0.5 else [9 * (a % 3) + a % 7 + k for k in range(3)])(rnd.randrange(34))] + [rnd.randrange(34)] * 2
        if max(map(t.count, t)) > 4:
            continue
        i = len(rows)
        row = hand(2 * i, "", concealed=t, winning_tile=rnd.choice(t), source=rnd.choice(["selfDraw", "discard"]), payment=rnd.choice(["preset", "fullEach", "splitTotal"]))
        shuffled = rnd.sample(t, len(t))
        rows += [row, {**row, "hand_id": 2 * i + 1, "concealed": shuffled}]
    got = scored(spark, rows)
    for r in rows[::2]:
        a, b = got[r["hand_id"]], got.get(r["hand_id"] + 1)
        if b:
            assert (a["status"], a["raw_score"], a["transfers"]) == (b["status"], b["raw_score"], b["transfers"])
    df = score_hands(spark.createDataFrame(rows, HAND)).where("transfers is not null").select(F.aggregate(balances(F.col("transfers")), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("z"))
    assert {r["z"] for r in df.collect()} <= {0}


def brute(ts: list[int], n: int) -> set:
    def groups(rest: list[int]):
        if not rest:
            yield ()
            return
        a = rest[0]
        if rest.count(a) >= 3:
            r = rest.copy()
            for _ in range(3):
                r.remove(a)
            for g in groups(r):
                yield (("pung", a), *g)
        if a < 27 and a % 9 <= 6 and a + 1 in rest and a + 2 in rest:
            r = rest.copy()
            for k in range(3):
                r.remove(a + k)
            for g in groups(r):
                yield (("chow", a), *g)

    out = set()
    if len(ts) != 3 * n + 2 or max(map(ts.count, ts)) > 4:
        return out
    for p in set(ts):
        if ts.count(p) >= 2:
            r = sorted(ts)
            r.remove(p)
            r.remove(p)
            out |= {(p, tuple(sorted(g))) for g in groups(r)}
    return out


def test_decompositions_against_brute_force(spark):
    rnd, rows = random.Random(11), []
    for i in range(300):
        n = rnd.choice([1, 2, 4, 5])
        pool = rnd.sample(range(34), 9) if i % 2 else list(range(9 * (i % 3), 9 * (i % 3) + 9))
        deck = list(itertools.chain(*[[t] * 4 for t in pool]))
        rows.append((i, rnd.sample(deck, 3 * n + 2), n))
    got: dict[int, list] = {}
    for r in decompose(spark.createDataFrame(rows, "hand_id int, concealed array<int>, n_groups int")).collect():
        got.setdefault(r["hand_id"], []).append((r["pair"], tuple(sorted((g["kind"], g["tile"]) for g in r["groups"]))))
    for i, t, n in rows:
        assert len(got.get(i, [])) == len(set(got.get(i, []))) and set(got.get(i, [])) == brute(t, n)


def test_waits(spark):
    df = spark.createDataFrame([(1, tiles("1112345678999m"), [], 4), (2, tiles("1111m"), [], 1)], "hand_id int, before array<int>, meld_tiles array<int>, n_groups int")
    got = {(r["hand_id"], r["wait"]) for r in waits(df).collect()}
    assert got == {(1, t) for t in range(9)}


@pytest.mark.parametrize("text,want", [("19m19p19s1234567z1m", True), ("19m19p19s1234567z2m", False), ("19m19p19s1234567z", False)])
def test_orphans(spark, text, want):
    assert spark.createDataFrame([(tiles(text),)], "t array<int>").select(is_thirteen_orphans(F.col("t"))).first()[0] is want
