from __future__ import annotations

import hashlib
import itertools
import json
import random
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.operators.detections import match_boxes, positional_errors
from lumora.operators.fingerprints import add_phash, dhash, hash_bits
from lumora.operators.manifest import assign_groups, canonical_hash, check_lock, eligible, make_lock, manifest_components, manifest_digest, record_json, record_violations
from lumora.sources.writers import append_register, recover_history, replace_history, write_by_split

RECORD = """id string, path string, source_image string, parent_capture string, session_id string, physical_tile_set string, dataset_version string, sha256 string, source_sha256 string, split string,
exposure string, upstream_training_status string, parent_ids array<string>, near_duplicate_clusters array<string>, dhash64 string, annotation_path string, annotation_sha256 string, notes string, upstream_evidence string"""
FINE = {
    "id": "a", "path": "x/y.png", "source_image": "s", "parent_capture": "c", "session_id": "e", "physical_tile_set": "p", "dataset_version": "v", "sha256": "0" * 64, "source_sha256": "1" * 64, "split": "unassigned",
    "exposure": "unexposed", "upstream_training_status": "unknown", "parent_ids": [], "near_duplicate_clusters": [], "dhash64": None, "annotation_path": "x.json", "annotation_sha256": "2" * 64, "notes": None, "upstream_evidence": None,
}


def records(spark, *changes):
    return spark.createDataFrame([tuple((FINE | c)[k] for k in FINE) for c in changes], RECORD)


def test_record_rules(spark):
    got = record_violations(records(
        spark, {}, {"id": "b", "path": "a/../b", "sha256": "F" * 64}, {"id": "b2", "path": "./a//b/", "sha256": "0" * 64 + "\n"}, {"id": "b3", "path": ".", "source_image": "\u3000s"}, {"id": "b4", "path": "a\\b", "dataset_version": "v\u00a0"}, {"id": "y", "parent_ids": ["z"]}, {"id": "z", "parent_ids": ["y"]}, {"id": "c", "parent_ids": ["c", "gone", "a"]}, {"id": "d", "split": "valid", "session_id": "None"}, {"id": "e", "upstream_training_status": "verified_disjoint"},
        {"id": "f", "annotation_sha256": None}, {"id": "g", "near_duplicate_clusters": ["x", "x"], "dhash64": "12"}, {"id": "h"}, {"id": "h", "notes": " "}, {"id": "i", "exposure": None, "source_image": None},
    ))
    assert sorted((r["id"], r["rule"]) for r in got.collect()) == [
        ("b", "invalid_sha256"), ("b", "unsafe_path"), ("b2", "invalid_sha256"), ("b3", "invalid_source_image"), ("b3", "unsafe_path"), ("b4", "invalid_dataset_version"), ("b4", "unsafe_path"), ("c", "dangling_parent"), ("c", "self_parent"), ("d", "invalid_split"), ("d", "unknown_session_id_not_null"), ("e", "evidence_required"), ("f", "invalid_annotation_pair"),
        ("g", "invalid_dhash64"), ("g", "invalid_near_duplicate_clusters"), ("h", "duplicate_id"), ("h", "invalid_notes"), ("i", "invalid_exposure"), ("i", "invalid_source_image"), ("y", "cyclic_parents"), ("z", "cyclic_parents"),
    ]


def test_splits_of_groups(spark):
    rows = [{"id": f"r{i}"} for i in range(400)] + [{"id": "t1", "exposure": "training"}, {"id": "t2"}, {"id": "f1", "split": "quarantine", "exposure": "training"}, {"id": "f2"}, {"id": "k1", "upstream_training_status": "known_in_training"}]
    df = records(spark, *rows).withColumn("root", F.when(F.col("id").startswith("r"), F.floor(F.substring("id", 2, 9).cast("int") / 2).cast("string")).otherwise(F.substring("id", 1, 1)))
    ratios = {"train": 0.5, "internal_test": 0.5}
    got = {r["id"]: r["to_split"] for r in assign_groups(df, root="root", seed="s", ratios=ratios).collect()}
    assert all(got[f"r{2 * i}"] == got[f"r{2 * i + 1}"] for i in range(200))
    for i in range(200):
        value = int.from_bytes(hashlib.sha256(("s\0" + "\0".join(sorted((f"r{2 * i}", f"r{2 * i + 1}")))).encode()).digest(), "big") / 2**256
        assert got[f"r{2 * i}"] == ("internal_test" if value < 0.5 else "train")
    assert (got["t1"], got["t2"], got["f1"], got["f2"], got["k1"]) == ("train", "train", "quarantine", "quarantine", "train")
    none = assign_groups(df.where("id = 'k1'"), root="root", seed="s", ratios={"holdout": 1.0}).first()["to_split"]
    assert none is None
    with pytest.raises(ValueError):
        assign_groups(df, root="root", seed="s", ratios={"unassigned": 1.0})


def test_ids_of_a_large_group_are_dealt_as_a_stream(spark):
    """No task collects a group's ids to deal its split; a group that no split takes and a group without a root are as before."""
    df = records(spark, *[{"id": f"é{i}"} for i in range(60)], {"id": "x"}, {"id": "k", "upstream_training_status": "known_in_training"})
    df = df.withColumn("root", F.when(F.col("id") == "x", "x").when(F.col("id") == "k", "k").otherwise("big"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        dealt = assign_groups(df, root="root", seed="s", ratios={"holdout": 0.5, "internal_test": 0.5})
        assert "collect_list" not in dealt._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: r["to_split"] for r in dealt.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    fits = {r["id"]: r["fits"] for r in df.select("id", eligible("holdout").alias("fits")).collect()}
    for group in ([f"é{i}" for i in range(60)], ["x"]):
        value = int.from_bytes(hashlib.sha256(("s\0" + "\0".join(sorted(group))).encode()).digest(), "big") / 2**256
        want = "internal_test" if not all(fits[i] for i in group) or value >= 0.5 else "holdout"
        assert {got[i] for i in group} == {want}
    assert got["k"] is None and len(got) == 62


def test_manifest_hash_and_lock(spark):
    rows = [{"id": f"é{i}", "parent_ids": ["b", "a"], "notes": 'say "x"\n' if i % 2 else None, "session_id": None} for i in range(30)]
    want = [{k: (sorted(v) if isinstance(v, list) else v) for k, v in (FINE | r).items() if v is not None or k == "session_id"} for r in rows]
    text = json.dumps({"schema_version": 1, "manifest_id": "m", "records": sorted(want, key=lambda r: r["id"].encode())}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    h = canonical_hash(records(spark, *rows[::-1]), "m")
    assert h == hashlib.sha256(text.encode()).hexdigest()
    got = [json.loads(r[0]) for r in records(spark, *rows).select(record_json(list(FINE))).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    digest = manifest_digest(records(spark, *rows), "m")
    assert digest == manifest_digest(records(spark, *rows[::-1]).repartition(7), "m") and digest != manifest_digest(records(spark, *rows[1:]), "m") and digest != manifest_digest(records(spark, *rows), "n")
    lock = make_lock(h, {"records": 30})
    assert check_lock(lock, h, {"records": 30}) == [] and check_lock(lock, "0", {"records": 31}) == ["manifest", "report"] and check_lock(lock | {"report": {}}, h, {}) == ["lock"]


def test_phash(spark):
    rng = np.random.default_rng(1)
    grids = [rng.random(1024) * 255 for _ in range(5)]
    rows = [(i, g.tolist()) for i, g in enumerate(grids)] + [(9, None), (9, [1.0]), (9, [None] * 1024)]
    frame = add_phash(spark.createDataFrame(rows, "i int, g array<double>"), "g")
    got = [r["phash"] for r in frame.where("i < 9").orderBy("i").collect()]
    assert [r["phash"] for r in frame.where("i = 9").collect()] == [None] * 3 and frame.orderBy("i").collect() == frame.orderBy("i").collect()
    for g, h in zip(grids, got, strict=True):
        g = g.reshape(32, 32)
        low = [sum(g[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) * (0.5**0.5 if not u else 1) * (0.5**0.5 if not v else 1) for u in range(8) for v in range(8)]
        assert int(h, 16) == sum(int(x > np.median(low[1:])) << (63 - i) for i, x in enumerate(low))


def test_dhash(spark):
    rng = np.random.default_rng(2)
    grids = [rng.integers(0, 9, 72) for _ in range(20)]
    got = spark.createDataFrame([(i, g.tolist()) for i, g in enumerate(grids)], "i int, g array<int>").select("i", dhash(F.col("g")).alias("h")).withColumn("bits", hash_bits(F.col("h"))).orderBy("i").collect()
    for g, r in zip(grids, got, strict=True):
        value = 0
        for y in range(8):
            for x in range(8):
                value = value << 1 | int(g[y * 9 + x] > g[y * 9 + x + 1])
        assert r["h"] == f"{value:016x}" and r["bits"] % (1 << 64) == value


def test_matching_over_batches(spark):
    """Images that go on in the next batch are solved as one."""
    def row(i, x, c=0):
        return (i // 4, i, c, x, 0.0, x + 1.0, 1.0)

    rows = [row(i, 0.05 * (i % 4)) for i in range(80)]
    kind = "k int, idx int, cls int, l double, t double, r double, b double"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, kind)
        got = match_boxes(df, df, key="k").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["gt_idx"], r["pred_idx"]) for r in got) == [(i, i) for i in range(80)]


def test_positions(spark):
    a, b = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "k int, o int, v double"), spark.createDataFrame([(1, 5, 1.0005), (1, 7, 2.1), (1, 9, 3.0)], "k int, o int, v double")
    got = positional_errors(a, b, key="k", order=["o"], value="v", rtol=0.001, atol=0.0).orderBy("rn").collect()
    assert [(r["rn"], r["close"]) for r in got] == [(1, True), (2, False), (3, False)]


def test_written_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "dev")], "id int, split string")
    write_by_split(df, str(tmp_path / "s"))
    one = spark.read.parquet(str(tmp_path / "s")).where("split = 'dev'")
    assert [r["id"] for r in one.collect()] == [2] and "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().toString()
    append_register(df.select("id"), str(tmp_path / "reg")), append_register(df.select("id"), str(tmp_path / "reg"))
    assert spark.read.parquet(str(tmp_path / "reg")).count() == 4
    path = str(tmp_path / "h")
    rows = spark.createDataFrame([(1, "ok"), (2, "unreadable")], "id int, state string")
    for _ in range(2):
        replace_history(rows, path, str(tmp_path / "q"))
    assert spark.read.parquet(path).count() == 1 and spark.read.json(str(tmp_path / "q")).count() == 2 and not os.path.exists(path + ".old")
    os.rename(path, path + ".old")  # as after a crash between the two renames
    recover_history(spark, path)
    assert spark.read.parquet(path).count() == 1


def test_groups_of_all_relations(spark):
    """Random records whose groups are found by joining each two that share any relation."""
    rnd = random.Random(8)
    for size in (1, 12, 40):
        rows = []
        for i in range(size):
            pick = lambda k, n=size: rnd.choice([None, None, f"{k}{rnd.randrange(n)}"])  # noqa: B023, E731
            rows.append({
                "id": f"r{i}", "source_image": f"s{rnd.randrange(3 * size)}", "parent_capture": pick("x"), "session_id": pick("x"), "physical_tile_set": None, "sha256": f"{rnd.randrange(4 * size):064x}", "source_sha256": f"{rnd.randrange(4 * size):064x}",
                "parent_ids": [f"r{rnd.randrange(i)}"] if i and rnd.random() < 0.1 else [], "near_duplicate_clusters": [f"k{rnd.randrange(2 * size)}"] if rnd.random() < 0.3 else [], "dhash64": f"{rnd.getrandbits(8) << 30 | 1 << 63:016x}" if rnd.random() < 0.1 else None,
            })
        root = {r["id"]: r["id"] for r in rows}

        def related(a, b):
            return (
                any(a[k] is not None and a[k] == b[k] for k in ("source_image", "parent_capture", "session_id")) or {a["sha256"], a["source_sha256"]} & {b["sha256"], b["source_sha256"]} or set(a["near_duplicate_clusters"]) & set(b["near_duplicate_clusters"])
                or a["id"] in b["parent_ids"] or b["id"] in a["parent_ids"] or (a["dhash64"] and b["dhash64"] and (int(a["dhash64"], 16) ^ int(b["dhash64"], 16)).bit_count() <= 4)
            )

        for a, b in itertools.combinations(rows, 2):
            if related(a, b):
                x, y = sorted((root[a["id"]], root[b["id"]]))
                root = {k: x if v == y else v for k, v in root.items()}
        got = manifest_components(records(spark, *rows))
        assert {r["id"]: r["root"] for r in got.collect()} == root
