from __future__ import annotations

import io
import json
import random
import re
import tarfile

import pytest
from pyspark.sql import functions as F

from lumora.operators.history import encode_saved, parse_history
from lumora.sources.readers import list_names, read_coco, read_digests, read_frame_times, read_labels, read_lines, read_numbers, read_regions, read_tar, read_yolo_labels
from lumora.sources.writers import replace_history, write_lists, write_once, write_report


def test_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text("image-name,label,label-name\na.jpg,1,one\nb.jpg,2,two\n")
    assert [(r["image-name"], r["label"]) for r in read_labels(spark, str(tmp_path / "l.csv")).orderBy("row").collect()] == [("a.jpg", 1), ("b.jpg", 2)]
    (tmp_path / "n.csv").write_text("epoch,   loss\n1,  0.5\n2,  0.25\n")
    assert [(r["epoch"], r["loss"]) for r in read_numbers(spark, str(tmp_path / "n.csv"), ["epoch", "   loss"]).collect()] == [(1.0, 0.5), (2.0, 0.25)]
    (tmp_path / "t.csv").write_text("1,0.1,0.1\n0,0.2,0.2\n")
    assert read_frame_times(spark, str(tmp_path / "t.csv")).count() == 2


def test_json_and_text(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"regions": [{"id": "a", "source_id": "s", "roi": [0, 0, 9, 9], "annotations": [{"tile": "1m", "box": [0, 0, 3, 3]}, {"tile": "2m", "box": [3, 0, 6, 3]}]}]}, indent=1))
    regions, gt = read_regions(spark, str(tmp_path / "r.json"))
    assert regions.count() == 1 and [(r["gt_idx"], r["tile"]) for r in gt.orderBy("gt_idx").collect()] == [(0, "1m"), (1, "2m")]
    doc = {"images": [{"id": 1, "file_name": "x.jpg", "width": 10, "height": 10}], "annotations": [{"id": 1, "image_id": 1, "category_id": 3, "bbox": [0, 0, 2, 2], "iscrowd": 0}], "categories": [{"id": 3, "name": "1m", "supercategory": "t"}]}
    for s in ("train", "valid"):
        (tmp_path / f"{s}.json").write_text(json.dumps(doc))
    images, annotations, categories = read_coco(spark, {s: str(tmp_path / f"{s}.json") for s in ("train", "valid")})
    assert images.count() == 2 and annotations.count() == 2 and categories.count() == 1
    (tmp_path / "valid.json").write_text(json.dumps(doc | {"categories": []}))
    with pytest.raises(ValueError):
        read_coco(spark, {s: str(tmp_path / f"{s}.json") for s in ("train", "valid")})
    (tmp_path / "log.txt").write_bytes(b"a\rb\nc\n")
    assert [r["line"] for r in read_lines(spark, str(tmp_path / "log.txt")).orderBy("line_no").collect()] == ["a", "b", "c"]
    (tmp_path / "y.txt").write_text("3 0.5 0.5 0.1 0.2\n\n")
    assert [(r["cls"], r["h"]) for r in read_yolo_labels(spark, str(tmp_path / "y.txt")).collect()] == [(3, 0.2)]


def test_files_and_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, size in (("x.jpg", 10), ("../y.jpg", 1), ("x.jpg", 1), ("z.exe", 1), ("big.jpg", 100)):
            info = tarfile.TarInfo(name)
            info.size = size
            tar.addfile(info, io.BytesIO(b"0" * size))
    got = read_tar(spark, str(tmp_path / "a.tar"), suffixes=(".jpg",), budget=50).collect()
    assert {(r["name"], r["size"], r["refused"]) for r in got} == {("x.jpg", 10, None), ("../y.jpg", 1, "unsafe_path"), ("x.jpg", 1, "duplicate"), ("z.exe", 1, "suffix"), ("big.jpg", 100, "over_budget")}
    assert len(read_digests(spark, str(tmp_path), "*.tar").first()["sha256"]) == 64
    assert [r["name"] for r in list_names(spark, str(tmp_path), "*.tar").collect()] == ["a.tar"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "dev"), (3, "train")], "id int, split string")
    write_once(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        write_once(df, str(tmp_path / "t"))
    write_report(df, str(tmp_path / "r"))
    write_lists(df, str(tmp_path / "lists"), "split", "id")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "lists/split=train")).collect()) == ["1", "3"]
    pay = [{"from": 1, "to": 0, "amount": 2, "reason": "win"}]
    hand = {"concealed": [0, 0, 0, 9, 9, 9, 18, 18, 18, 27, 27, 27, 31, 31], "melds": [], "flowers": [], "winningTile": 31, "source": "discard", "winner": 0, "discarder": 1, "dealer": 0, "roundWind": 0, "continuations": 0}
    hand |= {"lastTile": "none", "replacement": "none", "kongChain": 0, "liablePlayer": None, "heavenly": False, "earthly": False, "circumstancesConfirmed": True}
    rules = {"family": "hongKong", "minimum": 3, "cap": 10, "flowers": True, "base": 50, "unit": 1, "payment": "preset", "overrides": {}, "version": "1"}
    result = {"score": 3, "rawScore": 3, "total": 2, "engineVersion": "1", "balances": [2, -2, 0, 0], "patterns": [], "transfers": pay}
    saved = json.dumps({"id": "a", "date": "2024-05-01T10:30", "hand": hand, "rules": rules, "result": result})
    docs = spark.createDataFrame([(1, saved), (2, "{broken"), (3, None)], "id int, doc string")
    again = parse_history(docs.where("id = 1")).select(encode_saved(F.col("saved.hand"), F.col("saved.rules"), F.col("saved.result"), id=F.col("saved.id"), date=F.col("saved.date")).alias("doc")).first()["doc"]
    assert json.loads(again) == json.loads(saved)
    h = parse_history(docs).select("id", "doc", "state")
    assert [r["state"] for r in h.orderBy("id").collect()] == ["ok", "unreadable", "unreadable"]
    replace_history(h, str(tmp_path / "h"), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 1 and spark.read.schema("id int, doc string").json(str(tmp_path / "q")).count() == 2


def test_lines_of_a_large_file(spark, tmp_path):
    """A file that is read by several tasks has the lines and numbers of one that is read whole."""
    rnd = random.Random(3)
    for k, end in enumerate((b"", b"\n", b"\r\n", b"\r")):
        parts = [bytes(rnd.choice(b"abc ") for _ in range(rnd.randrange(0, 60))) + rnd.choice([b"\r", b"\n", b"\n", b"\r\n"]) for _ in range(900)]
        data = b"".join(parts) + b"last" + end
        (tmp_path / f"{k}.log").write_bytes(data)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        got = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    assert spark.conf.get(key) == before
    for k in range(4):
        text = (tmp_path / f"{k}.log").read_bytes().decode()
        want = re.split(r"\r|\n", re.sub(r"(\r?\n)\Z", "", text))
        mine = sorted((r["line_no"], r["line"]) for r in got if r["path"].endswith(f"{k}.log"))
        assert mine == list(enumerate(want))
