from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.functions.geometry import row_angle
from lumora.functions.metrics import wilson, zero_failure_bound
from lumora.operators.audit import assign_split, keep_first, unit_value
from lumora.operators.consensus import DECISION, FRAME, Policy, State, by_center, can_confirm, frame_issue, gate_batch
from lumora.operators.decompose import decompose
from lumora.operators.detections import assign, best_class, match_boxes, nms
from lumora.operators import fingerprints
from lumora.operators.fingerprints import blocks_kept, hamming_links, near_links, near_pairs
from lumora.operators.graph import components, cycle_nodes
from lumora.streaming.gate import ROCKSDB, gate_stream


def test_intervals(spark):
    df = spark.createDataFrame([(2, 7), (0, 10), (0, 0)], "s int, n int").select(wilson(F.col("s"), F.col("n")).alias("w"), zero_failure_bound(F.lit(298)).alias("a"), zero_failure_bound(F.lit(299)).alias("b"), zero_failure_bound(F.lit(1)).alias("c"))
    got = df.collect()
    assert abs(got[0]["w"]["low"] - 0.082218924004) < 1e-9 and abs(got[0]["w"]["high"] - 0.641065548167) < 1e-9
    assert abs(got[1]["w"]["high"] - 0.2775327998628892) < 1e-9 and got[2]["w"] is None
    assert got[0]["a"] > 0.01 > got[0]["b"] and abs(got[0]["c"] - 0.95) < 1e-12


def test_assignment_against_brute_force():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5):
        for _ in range(20):
            w = rnd.random((n, n)) * (rnd.random((n, n)) > 0.3)
            to = assign(w)
            best = max(sum(w[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert sorted(to) == list(range(n)) and abs(sum(w[i, to[i]] for i in range(n)) - best) < 1e-9


def test_matching_is_optimal_and_inclusive(spark):
    box = "k int, idx int, cls int, l double, t double, r double, b double"
    gt = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 1.0, 1.0), (1, 1, 0, 0.2, 0.0, 1.2, 1.0), (2, 0, 0, 0.0, 0.0, 1.0, 1.0)], box)
    pred = spark.createDataFrame([(1, 0, 0, 0.1, 0.0, 1.1, 1.0), (1, 1, 1, -0.2, 0.0, 0.8, 1.0), (2, 0, 0, 0.0, 0.0, 1.0, 0.5)], box)
    got = {(r["k"], r["gt_idx"]): r["pred_idx"] for r in match_boxes(gt, pred, key="k").collect()}
    assert got == {(1, 0): 1, (1, 1): 0, (2, 0): 0}
    # equal boxes: pairs in the order of idx; one prediction for two of them: the larger idx
    same = [(k, i, 0, 0.0, 0.0, 1.0, 1.0) for k, i in [(1, 0), (1, 1), (2, 0), (2, 1)]]
    got = {(r["k"], r["gt_idx"]): r["pred_idx"] for r in match_boxes(spark.createDataFrame(same, box), spark.createDataFrame(same[:3], box), key="k").collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (2, 1): 0}


def test_nms_and_argmax(spark):
    rows = [(1, a, 0, c, x, 0.0, x + 0.1, 0.1) for a, (c, x) in enumerate([(0.9, 0.0), (0.8, 0.01), (0.7, 0.5), (0.6, 0.3)])]
    df = spark.createDataFrame(rows, "k int, anchor bigint, cls int, conf double, l double, t double, r double, b double")
    assert [r["anchor"] for r in nms(df, key="k").orderBy("pos").collect()] == [0, 3, 2]
    assert nms(df, key="k", most=1).count() == 1
    s = spark.createDataFrame([([0.1, float("nan"), 0.4, 0.4],), ([None, float("inf"), -1.0],)], "s array<double>")
    top, cls = best_class(F.col("s"))
    assert [(r[0], r[1]) for r in s.select(top, cls).collect()] == [(0.4, 2), (0.0, 0)]


def test_components_and_cycles(spark):
    rnd = random.Random(7)
    for n, m in ((20, 15), (30, 40), (40, 20)):
        links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        got = {r["u"]: r["root"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
        assert all(got.get(i, i) == find(i) for i in range(n))
    assert {r["node"] for r in cycle_nodes(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)], "src int, dst int")).collect()} == {1, 2, 3}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_near_links_against_brute_force(spark):
    rnd = random.Random(12)
    base = [(rnd.getrandbits(64), rnd.getrandbits(64), [rnd.randrange(256) for _ in range(12)]) for _ in range(4)]

    def flip(x, most):
        for p in rnd.sample(range(64), rnd.randint(0, most)):
            x ^= 1 << p
        return x

    rows = [(i, flip(d, 5), flip(p, 5), 100 + rnd.choice([0, 0, 3, 9]), 100, [min(255, c + rnd.choice([0, 5, 20, 25])) for c in rgb]) for i in range(60) for d, p, rgb in [base[i % 4]]]
    want = set()
    for a, b in itertools.combinations(rows, 2):
        if (a[1] ^ b[1]).bit_count() <= 4:
            continue
        if (a[2] ^ b[2]).bit_count() <= 6 and abs((b[3] / b[4]) / (a[3] / a[4]) - 1) <= 0.05 and sum(abs(x - y) for x, y in zip(a[5], b[5], strict=True)) / 12 <= 12:
            want.add((a[0], b[0]))
    signed = [(i, d - (d >> 63 << 64), p - (p >> 63 << 64), w, h, c) for i, d, p, w, h, c in rows]
    df = spark.createDataFrame([*signed, (99, None, None, 1, 1, None)], "id bigint, dh bigint, ph bigint, w int, h int, rgb array<int>")
    got = near_links(df, id_col="id", dhash_col="dh", phash_col="ph", width_col="w", height_col="h", rgb_col="rgb").collect()
    assert want and {(r["u"], r["v"]) for r in got if r["reason"] == "phash_mae"} == want
    near = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if (a[1] ^ b[1]).bit_count() <= 4}
    assert {(r["u"], r["v"]) for r in got if r["reason"] == "dhash"} <= near


def test_hamming_links(spark):
    rnd = random.Random(9)
    bits = [rnd.getrandbits(16) for _ in range(150)] + [0, 0x0F, 0xFF, 0]
    rows = [(i, b) for i, b in enumerate(bits)] + [(999, None)]
    got = {(r["u"], r["v"]) for r in hamming_links(spark.createDataFrame(rows, "id bigint, bits bigint"), id_col="id", bits_col="bits", distance=3, width=16).where("distance > 0").collect()}
    first: dict[int, int] = {}
    for i, b in enumerate(bits):
        first.setdefault(b, i)
    assert got == {(min(i, j), max(i, j)) for (a, i), (b, j) in itertools.combinations(first.items(), 2) if bin(a ^ b).count("1") <= 3}


def test_first_and_splits(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), (None, 3, "z")], "k string, o int, v string")
    assert sorted(r["v"] for r in keep_first(df, "k", "o").collect()) == ["x", "z"]
    got = spark.range(2000).select(assign_split(unit_value(F.lit("s"), F.col("id").cast("string")), {"train": 8.0, "dev": 2.0}).alias("s")).groupBy("s").count().collect()
    assert 300 < {r["s"]: r["count"] for r in got}["dev"] < 500


def _frame(stream, seq, at, n=2, shift=0.0):
    return (stream, seq, at, [dict(tile=i, confidence=0.95, l=0.05 + 0.06 * i + shift, t=0.3, r=0.085 + 0.06 * i + shift, b=0.7, red_five=False) for i in range(n)])


def _decisions(spark, frames, policy):
    return {(r["stream_id"], r["seq"]): (r["issue"], r["matched_frames"], r["observed_count"]) for r in gate_batch(spark.createDataFrame(frames, FRAME), policy).collect()}


def test_gate(spark):
    got = _decisions(spark, [_frame(1, i, 300 * i) for i in range(5)] + [_frame(1, 5, 1200), _frame(1, 6, 1300), (1, 7, 1400, []), _frame(1, 8, 1500, 3), (1, 9, 1600, None)], Policy(2))
    assert [got[1, i][0] for i in range(10)] == ["collecting"] * 4 + ["stable", "stale", "collecting", "empty", "count", "empty"] and got[1, 6] == ("collecting", 1, 2)
    got = _decisions(spark, [_frame(1, 0, 0), _frame(1, 1, 1000), _frame(2, 0, 0), _frame(2, 1, 1001)], Policy(2))
    assert got[1, 1][1] == 2 and got[2, 1][1] == 1
    assert not State(1500).expired(2700, Policy(2)) and State(1500).expired(2701, Policy(2)) and State(1500).expired(1499, Policy(2)) and not State().expired(5, Policy(2))
    # a slow drift agrees with the last frame, but not with the first
    got = _decisions(spark, [_frame(1, i, 300 * i, shift=0.01 * i) for i in range(4)], Policy(2))
    assert [got[1, i][1] for i in range(4)] == [1, 2, 3, 1]
    for bad in (dict(expected_count=1), dict(expected_count=18), dict(expected_count=2, required_frames=1), dict(expected_count=2, minimum_span_ms=0), dict(expected_count=2, minimum_confidence=float("nan"))):
        with pytest.raises(ValueError):
            Policy(**bad)


def test_frame_checks(spark):
    base = _frame(1, 0, 0, 6)[3]

    def with_(i, **kw):
        return [dict(x, **kw) if j == i else x for j, x in enumerate(base)]

    cases = {
        None: base[::-1], "empty": [], "count": base[:5], "confidence": with_(2, confidence=0.79), "physical": with_(0, tile=34), "arrangement": with_(5, r=0.999),
        "confidence ": with_(2, confidence=float("nan")), "confidence  ": with_(1, confidence=None, tile=99), "physical ": [dict(x, tile=3) for x in base], "arrangement ": with_(3, b=0.37),
        "arrangement  ": with_(2, t=0.05, b=0.25), "arrangement   ": with_(2, l=base[1]["l"] + 0.01, r=base[1]["r"] + 0.01), "arrangement    ": with_(0, l=0.004), "physical  ": with_(0, tile=-1, l=0.001),
    }
    rows = spark.createDataFrame([(1, i, 0, d) for i, d in enumerate(cases.values())], FRAME).select("seq", by_center(F.col("detections")).alias("d"))
    got = {r["seq"]: (r["i"], r["c"]) for r in rows.select("seq", frame_issue(F.col("d"), Policy(6)).alias("i"), can_confirm(F.col("d"), 6).alias("c")).collect()}
    assert [got[i][0] for i in range(len(cases))] == [k and k.strip() for k in cases]
    assert [got[i][1] for i in range(len(cases))] == [True, False, False, True, False, True, False, False, False, True, True, True, True, False]


def test_gate_timer(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        spark.createDataFrame([_frame(7, i, 300 * i) for i in range(3)], FRAME).coalesce(1).write.parquet(str(tmp_path / "in"))
        out = gate_stream(spark.readStream.schema(FRAME).parquet(str(tmp_path / "in")), Policy(2), expire=True)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
        for _ in range(120):
            time.sleep(0.5)
            got = [r["issue"] for r in spark.read.schema(DECISION).parquet(str(tmp_path / "out")).collect()] if (tmp_path / "out").exists() else []
            if "stale" in got:
                break
        q.stop()
        assert sorted(got) == ["collecting"] * 3 + ["stale"]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_index_stays_flat(spark):
    """Candidates a row, before their distance is looked at, for random fingerprints and 100 times as many; and every pair once."""
    def candidates(n):
        rows = spark.range(n).select(F.col("id"), F.xxhash64("id").alias("bits"))
        k = blocks_kept(n, 4, 64)
        ends = [64 * i // (4 + k) for i in range(5 + k)]
        masks = [((1 << e) - 1) ^ ((1 << b) - 1) for b, e in zip(ends, ends[1:], strict=False)]
        keys = [sum(masks[i] for i in c) for c in itertools.combinations(range(4 + k), k)]
        index = rows.select(F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("bits").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(keys)])).alias("k"))
        return index.groupBy("k").count().agg(F.sum(F.col("count") * (F.col("count") - 1)) / 2 / n).first()[0]

    assert candidates(200_000) < 10 and candidates(2_000) < 10
    rnd = random.Random(4)
    bits = [rnd.getrandbits(24) - (1 << 23) for _ in range(60)]
    bits = [b ^ (1 << rnd.randrange(24)) ^ (1 << rnd.randrange(24)) for b in bits for _ in range(3)]
    rows = spark.createDataFrame(list(enumerate(bits)), "id int, bits bigint").withColumn("bits", F.col("bits").bitwiseAND(F.lit((1 << 24) - 1)))
    want = sorted((i, j) for (i, a), (j, b) in itertools.combinations(enumerate(bits), 2) if ((a ^ b) & ((1 << 24) - 1)).bit_count() <= 3)
    for kept in (1, 2, 3, 5):
        got = near_pairs(rows, bits_col="bits", id_col="id", distance=3, width=24, kept=kept).select("a.id", "b.id").collect()
        assert want and sorted(map(tuple, got)) == want


def test_near_links_of_copies(spark):
    """Copies are linked to their class alone; aspects are compared in the order of ids, whichever row of a class is the earlier one."""
    rows = [(i, None, 7, 100.0, 100.0, [1, 2]) for i in range(50)] + [(50, 0, 7, 105.1, 100.0, [1, 2]), (-1, 0, 7, 105.1, 100.0, [1, 2])]
    df = spark.createDataFrame(rows, "id bigint, dh bigint, ph bigint, w double, h double, rgb array<int>")
    got = {(r["u"], r["v"]) for r in near_links(df, id_col="id", dhash_col="dh", phash_col="ph", width_col="w", height_col="h", rgb_col="rgb").where("reason = 'phash_mae'").collect()}
    assert got == {(0, i) for i in range(1, 50)} | {(-1, 0)}


def test_row_angle_works_medians_out_once(spark):
    """Each of the four medians stands once in the expression; a row of 60 boxes, turned by 5 degrees, is done at once."""
    slope = float(np.tan(np.radians(5.0)))
    boxes = [(i / 60, 0.4 + slope * i / 60, i / 60, 0.5 + slope * i / 60) for i in range(60)]
    df = spark.createDataFrame([(boxes,), (boxes[:4],)], "boxes array<struct<l:double,t:double,r:double,b:double>>").select(row_angle(F.col("boxes"), F.lit(1000.0), F.lit(1000.0)).alias("angle"))
    assert df._jdf.queryExecution().analyzed().toString().lower().count("array_sort(") == 4
    got = [r["angle"] for r in df.collect()]
    assert abs(got[0] - 5.0) < 1e-9 and got[1] == 0.0


def test_near_pairs_are_joined_by_a_shuffle(spark, monkeypatch):
    """A small table is not broadcast, since its candidates are many; bits in few places are told apart; hot keys are dealt, each pair once."""
    monkeypatch.setattr(fingerprints, "HOT_ROWS", 5)
    rnd = random.Random(8)
    bits = [rnd.getrandbits(7) << 50 for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(bits)), "id int, bits bigint")
    got = near_pairs(rows, bits_col="bits", id_col="id", distance=2)
    assert "SortMergeJoin [choice" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["a"]["id"], r["b"]["id"]) for r in got.collect()) == [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(bits), 2) if (a ^ b).bit_count() <= 2]
    same = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "id int, bits bigint")
    assert [(r["a"]["id"], r["b"]["id"]) for r in near_pairs(same, bits_col="bits", id_col="id", distance=4).collect()] == [(1, 2)]
    assert near_pairs(same.limit(0), bits_col="bits", id_col="id", distance=4).count() == 0


def test_near_pairs_have_as_many_tasks_as_candidates_ask_for(spark, monkeypatch):
    """Rows are few bytes, so Spark would join them in 4 tasks at most here, however many candidates they make."""
    monkeypatch.setattr(fingerprints, "TASK_CANDIDATES", 500, raising=False)
    rnd = random.Random(9)
    bits = [rnd.getrandbits(8) for _ in range(200)]
    got = near_pairs(spark.createDataFrame(list(enumerate(bits)), "id int, bits bigint"), bits_col="bits", id_col="id", distance=2)
    rows = got.select("a.id", "b.id", F.spark_partition_id()).collect()
    assert sorted((a, b) for a, b, _ in rows) == [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(bits), 2) if (a ^ b).bit_count() <= 2]
    assert len({p for *_, p in rows}) > 8


def test_groups_of_near_fingerprints_need_no_broadcast_join(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "HOT_ROWS", 5)
    bits = [random.Random(i // 3).getrandbits(24) ^ (1 << i % 3) for i in range(90)]
    links = hamming_links(spark.createDataFrame(list(enumerate(bits)), "id int, bits bigint"), id_col="id", bits_col="bits", distance=2, width=24)
    assert "SortMergeJoin [choice" in links._jdf.queryExecution().executedPlan().toString()
    root = {r["u"]: r["root"] for r in components(links.select("u", "v")).collect()}
    assert all(root[i] == i // 3 * 3 for i in range(90) if i % 3) and not any(i in root for i in range(0, 90, 3))


def test_decompose_works_tiles_out_once(spark):
    """The expression of the tiles stands in the size and in the keys, not once for each tile and suit."""
    hands = spark.createDataFrame([(1, [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4])], "hand_id int, raw array<int>").select("hand_id", F.transform("raw", lambda x: x + 0).alias("concealed"), F.lit(4).alias("n_groups"))
    got = decompose(hands)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("transform(raw") <= 3
    assert {r["pair"] for r in got.collect()} == {1, 4}
