"""Running sums, exact percentiles, cycles and hubs: few large groups and long chains."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from lumora.operators import graph
from lumora.operators.audit import group_ids
from lumora.operators.graph import components, cycle_nodes
from lumora.operators.ordered import percentiles, running_sums


def test_running_sums_of_a_hot_group(spark):
    rnd = random.Random(1)
    rows = [(i, "hot" if rnd.random() < 0.9 else rnd.choice(["a", "b", None]), rnd.choice([None, 1, 5, -3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, g string, x int").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        out = running_sums(df, by=["g"], order=[F.col("i")], sums={"used": F.col("x"), "n": F.lit(1)})
        got = {r["i"]: (r["used"], r["n"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    total, n = {}, {}
    for i, g, x in rows:
        total[g], n[g] = total.get(g, 0) + (x or 0), n.get(g, 0) + 1
        assert got[i] == (total[g], n[g])
    assert len(got) == len(rows) and running_sums(df.where("false"), by=["g"], order=[F.col("i")], sums={"s": F.col("x")}).collect() == []


def test_percentiles(spark):
    rnd = random.Random(2)
    groups = {"hot": [rnd.gauss(0, 1) for _ in range(4000)], "ties": [float(rnd.randrange(3)) for _ in range(500)], "one": [7.0], None: [1.0, 2.0, None, 4.0], "nulls": [None, None]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double").repartition(5)
    shares = {"least": 0.0, "p10": 0.1, "median": 0.5, "p95": 0.95, "most": 1.0}
    got = {r["g"]: r for r in percentiles(df, by="g", value="x", shares=shares, splitters=20).collect()}
    assert set(got) == {"hot", "ties", "one", None}
    for g, r in got.items():
        xs = [x for x in groups[g] if x is not None]
        assert r["n"] == len(xs) and all(np.isclose(r[k], np.quantile(xs, s), rtol=1e-12, atol=1e-12) for k, s in shares.items())


def test_long_chains_have_few_rounds(spark):
    chain = [(i, i + 1) for i in range(10_000)]
    rounds: list[int] = []
    assert cycle_nodes(spark.createDataFrame(chain, "src int, dst int"), rounds).collect() == [] and len(rounds) <= 40
    rounds = []
    tree = [(i, (i - 1) // 2) for i in range(1, 2000)]
    assert cycle_nodes(spark.createDataFrame(tree, "src int, dst int"), rounds).collect() == [] and len(rounds) <= 40


def test_cycles_against_brute_force(spark):
    rnd = random.Random(3)
    for n, m in ((12, 12), (30, 28), (25, 60)):
        edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)}
        reach = {a: set() for a in range(n)}
        for _ in range(n):
            for a, b in edges:
                reach[a] |= {b} | reach[b]
        loops = {a for a in reach if a in reach[a]}
        want = {a for a in range(n) if (a in loops or any(a in reach[x] for x in loops)) and (a in loops or reach[a] & loops)}
        assert {r["node"] for r in cycle_nodes(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()} == want


def test_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_EDGES", 20)
    links = [(5, 1000 + i) for i in range(300)] + [(1000 + i, 2000 + i) for i in range(300)] + [(3, 2299), (7000, 7001)]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {i: 3 for i in {x for link in links[:-1] for x in link} - {3}} | {7001: 7000}


def test_ids_of_a_large_group_are_hashed_as_a_stream(spark):
    """No task collects a group's ids: they come sorted, a batch at a time, and a group may begin and end anywhere in a batch."""
    ids = {"big": [f"é{i}" for i in range(100)] + [None], "a": ["x"], "b": ["9", "10", "\U0001f600", "\uffff"], None: ["n", "m"], "none": [None, None]}
    df = spark.createDataFrame([(g, x) for g, xs in ids.items() for x in xs], "root string, id string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        named = group_ids(df, "id")
        assert "collect_list" not in named._jdf.queryExecution().executedPlan().toString()
        got = {r["root"]: (r["group_id"], r["size"]) for r in named.collect()}
        assert group_ids(df.where("false"), "id").collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    lines = {g: "\n".join(sorted((x for x in xs if x is not None), key=str.encode)) for g, xs in ids.items()}
    assert got == {g: (hashlib.sha256(lines[g].encode()).hexdigest()[:20], len(xs)) for g, xs in ids.items()}
