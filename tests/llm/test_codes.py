from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.llm import codes as C

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, code int, v double"


def by_hand(rows, parts, entries, rounds, scale=256):
    """Codes, errors and codebooks, each part compared with each entry. ``rows``: (vec_id, vector, label) that can be coded."""
    ints = [[math.floor(scale * x) for x in v] for _, v, _ in rows]
    width = len(ints[0]) // parts
    least = {}
    for (i, _, _), v in zip(rows, ints, strict=True):
        if i is not None:
            least[i] = min(least.get(i, v), v)
    seeds = [least[i] for i in sorted(least)[:entries]]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in seeds] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = [[cut(v, p) for v in ints if near(v, p)[1] == e] for e in range(len(seeds))]
            new.append([[sum(x) // len(x) for x in zip(*m, strict=True)] if m else books[p][e] for e, m in enumerate(of)])
        books = new
    best = [[near(v, p) for p in range(parts)] for v in ints]
    return [(i, label, "".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b)) for (i, _, label), b in zip(rows, best, strict=True)], books


def vectors(rnd, n, width):
    out = [(rnd.randrange(10**6), [round(rnd.gauss(0, 0.2), rnd.choice([1, 2, 6])) for _ in range(width)], rnd.choice([None, 1, 2])) for _ in range(n)]
    return [(i, np.float32(v).tolist(), label) for i, v, label in out]


@pytest.mark.parametrize(("n", "entries", "chunk"), [(300, 7, 90), (60, 64, 1000), (5, 4, 1)])
def test_codes(spark, n, entries, chunk):
    rnd = random.Random(n)
    good = vectors(rnd, n, 12) + [(-5, [0.5] * 12, 3)] * 30 + [(None, [0.25] * 12, 3)]
    odd = [(-9, None, 1), (-8, [None] + [0.0] * 11, 1), (-7, [float("nan")] + [0.0] * 11, 1), (-6, [float("inf")] + [0.0] * 11, 1), (10**7, [0.0] * 8, 1), (10**7, [0.0] * 7, 1), (10**7, [], 1), (10**7, [3e38] * 12, 1)]
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in good + odd], SCHEMA).repartition(3)
    coded, books = C.compress(df, parts=3, entries=entries, chunk=chunk)
    want, want_books = by_hand(good, 3, entries, 2)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or 0, r[2], r[3])
    assert sorted(map(tuple, coded.collect()), key=key) == sorted(want, key=key)
    assert books.tolist() == want_books
    total = {}
    for _, label, _, error in want:
        total[label] = total.get(label, 0) + error
    assert {r["label"]: r["label_error"] for r in C.with_label_error(coded).collect()} == total


def test_label_error_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_IDS", 0)
    coded = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2, "00", i) for i in range(60)], "id bigint, label int, code string, error bigint")
    got = C.with_label_error(coded).collect()
    total = coded.groupBy("label").agg(F.sum("error")).collect()
    assert len(got) == 60 and {(r["label"], r["label_error"]) for r in got} == {tuple(r) for r in total}


def test_filter_equals_comparison():
    rnd = np.random.default_rng(1)
    for n, spread in ((1, 5), (40, 3), (700, 40), (700, 2)):
        points, book = rnd.integers(-spread, spread, (n, 3)), rnd.integers(-spread, spread, (20, 3))
        want = ((points[:, None] - book) ** 2).sum(-1).argmin(1)
        tree = C.Tree.unpack(C.Tree.build(points).pack(), 3)
        counts, sums, got = tree.filter(book, assign=True)
        assert (got == want).all() and (counts == np.bincount(want, minlength=20)).all()
        assert (sums == np.stack([points[want == e].sum(0) for e in range(20)])).all()
        again = tree.filter(book, assign=False)
        assert (again[0] == counts).all() and (again[1] == sums).all()


def test_empty(spark):
    for rows in ([], [(1, None, 1, "x", 1, 0.5)]):
        coded, books = C.compress(spark.createDataFrame(rows, SCHEMA))
        assert C.with_label_error(coded).collect() == [] and C.digest(books) == C.digest(np.zeros((16, 0, 4), int))
    with pytest.raises(ValueError):
        C.compress(spark.createDataFrame([], SCHEMA), entries=300)
