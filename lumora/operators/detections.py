"""Post-processing of detections: decoding, non-maximum suppression, matching and its totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumora.functions.geometry import finite, iou, unletterbox


def best_class(scores: Column) -> tuple[Column, Column]:
    """Confidence and class of an array of scores: not finite counts as 0, ties go to the lowest class."""
    clean = F.transform(scores, lambda s: F.when(s.isNotNull() & finite(s), s).otherwise(F.lit(0.0).cast("double")))
    top = F.array_max(clean)
    return top, (F.array_position(clean, top) - 1).cast("int")


def usable_box(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return finite(cx) & finite(cy) & finite(w) & finite(h) & (w > 0) & (h > 0)


def clamp_box(box: Column) -> Column:
    one = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return F.struct(one(box["l"]).alias("l"), one(box["t"]).alias("t"), one(box["r"]).alias("r"), one(box["b"]).alias("b"))


def nms(candidates: DataFrame, *, key: str, threshold: float = 0.45, most: int | None = 40, per_class: bool = False, inclusive: bool = True, by_center: bool = True) -> DataFrame:
    """Greedy suppression within each key of rows (cls, conf, l, t, r, b, anchor), as a fold over a sorted array.

    A box is dropped if its overlap with a kept one reaches ``threshold`` (exceeds it, if not ``inclusive``), of any
    class or only of its own. At most ``most`` are kept. The rest come in order of their centres or of confidence.
    Candidates of one key are one image's boxes, so the array is bounded by the detector's anchors.
    """
    item = F.struct((-F.col("conf")).alias("neg"), "anchor", "cls", "conf", "l", "t", "r", "b")
    grouped = candidates.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("c"))
    schema = "array<struct<neg:double,anchor:bigint,cls:int,conf:double,l:double,t:double,r:double,b:double>>"

    def step(kept: Column, x: Column) -> Column:
        over = lambda k: (iou(k, x) >= threshold if inclusive else iou(k, x) > threshold) & ((k["cls"] == x["cls"]) if per_class else F.lit(True))
        drop = F.exists(kept, over)
        if most is not None:
            drop = (F.size(kept) >= most) | drop
        return F.when(drop, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(F.col("c").cast(schema), F.array().cast(schema), step)
    if by_center:
        kept = F.array_sort(kept, lambda a, b: F.when(a["l"] + a["r"] < b["l"] + b["r"], -1).when(a["l"] + a["r"] > b["l"] + b["r"], 1).when(a["anchor"] < b["anchor"], -1).otherwise(1))
    return grouped.select(key, F.posexplode(kept).alias("pos", "_box")).select(key, "pos", "_box.anchor", "_box.cls", "_box.conf", "_box.l", "_box.t", "_box.r", "_box.b")


def decode(raw: DataFrame, *, key: str, threshold: float = 0.25) -> DataFrame:
    """Candidates of raw anchors (key, anchor, cx, cy, w, h in the square, scores, geometry of its letterbox): rows of
    key, anchor, cls, conf, l, t, r, b. An anchor is left out if its best score is under the threshold, if its box is not finite or has
    no size, or if nothing of it is left inside the image."""
    conf, cls = best_class(F.col("scores"))
    c = F.col
    rows = raw.where(usable_box(c("cx"), c("cy"), c("w"), c("h"))).withColumn("conf", conf).withColumn("cls", cls).where(F.col("conf") >= threshold)
    rows = rows.withColumn("_b", unletterbox(F.struct("cx", "cy", "w", "h"), c("geometry"))).where("_b.r > _b.l and _b.b > _b.t")
    return rows.select(key, "anchor", "cls", "conf", "_b.l", "_b.t", "_b.r", "_b.b")


def detect(raw: DataFrame, *, key: str, threshold: float = 0.25, overlap: float = 0.45, most: int = 40, shown: int = 17) -> DataFrame:
    """The detector's whole chain: decode, suppress whatever its class, order by centre, and take the first ``shown`` as ``display``."""
    kept = nms(decode(raw, key=key, threshold=threshold), key=key, threshold=overlap, most=most)
    return kept.withColumn("display", F.col("pos") < shown)


def owned(boxes: DataFrame, first: Column, last: Column) -> DataFrame:
    """Boxes whose centre is in their window's own range: half open, but closed where it ends with the image."""
    center = (F.col("l") + F.col("r")) / 2
    return boxes.where((center >= first) & ((center < last) | (last >= 1)))


def softmax(logits: Column) -> Column:
    """Shares of the exponentials, the largest logit taken off first."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0).cast("double"), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def crop_totals(crops: DataFrame) -> DataFrame:
    """One row of totals of crops (expected, covered, best, n_found): of covered ones those whose best or only detection is
    right and those without any; of others those with a false one."""
    yes = F.col("covered")
    right = F.coalesce(F.col("best") == F.col("expected"), F.lit(False))
    return crops.agg(
        F.count_if(yes).alias("covered_crops"), F.count_if(yes & right).alias("top_correct"), F.count_if(yes & right & (F.col("n_found") == 1)).alias("exactly_one_correct"),
        F.count_if(yes & (F.col("n_found") == 0)).alias("no_detection"), F.count_if(~yes).alias("unsupported_crops"), F.count_if(~yes & (F.col("n_found") > 0)).alias("unsupported_with_false_detection"),
    )


def positional_errors(a: DataFrame, b: DataFrame, *, key: str, order: list, value: str, rtol: float, atol: float) -> DataFrame:
    """Rows of two tables joined by their place within a key: key, rn, a, b and whether |a - b| <= atol + rtol * |b|. A row
    without a partner is no match."""
    def placed(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).select(key, "rn", F.col(value).alias(name))

    close = F.abs(F.col("a") - F.col("b")) <= atol + rtol * F.abs(F.col("b"))
    return placed(a, "a").join(placed(b, "b"), [key, "rn"], "full").select(key, "rn", "a", "b", F.coalesce(close, F.lit(False)).alias("close"))


def assign(weights: np.ndarray) -> np.ndarray:
    """Columns of the rows of a square matrix in an assignment of largest total weight (shortest augmenting paths)."""
    n = len(weights)
    cost = weights.max() - weights
    u, v, row_of = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for i in range(n):
        row_of[n], j = i, n
        least, way, used = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[j] >= 0:
            used[j] = True
            r = row_of[j]
            gap = cost[r] - u[r] - v[:n]
            better = ~used[:n] & (gap < least)
            least[better], way[better] = gap[better], j
            free = np.where(used[:n], np.inf, least)
            to = int(free.argmin())
            delta = free[to]
            for k in np.flatnonzero(used):
                u[row_of[k]] += delta
                v[k] -= delta
            least[~used[:n]] -= delta
            j = to
        while j != n:
            row_of[j], j = row_of[way[j]], way[j]
    out = np.empty(n, int)
    out[row_of[:n]] = np.arange(n)
    return out


#: What the order of two boxes adds to the overlap of their match, at most.
TIE = 1e-7


def match_boxes(truth: DataFrame, predicted: DataFrame, *, key: str, threshold: float = 0.5) -> DataFrame:
    """One-to-one matches of truth and predictions (idx, cls, l, t, r, b) of each image: most matches first, then the largest
    total overlap; totals that differ by no more than ``TIE`` a match are ties, which go to larger idx and to pairs in the
    order of idx. Columns: key, gt_idx, pred_idx, gt_cls, pred_cls, iou. Images are small groups."""
    box = lambda p: F.struct(*[F.col(f"{p}_{x}").alias(x) for x in "ltrb"])
    named = lambda df, p: df.select(key, *[F.col(x).alias(f"{p}_{x}") for x in ("idx", "cls", "l", "t", "r", "b")])
    pairs = named(truth, "gt").join(named(predicted, "pred"), key).withColumn("iou", iou(box("gt"), box("pred"))).where(F.col("iou") >= threshold)
    pairs = pairs.select(key, "gt_idx", "pred_idx", "gt_cls", "pred_cls", "iou")

    def solve(part: np.ndarray, gt: np.ndarray, pred: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The rows of one image that are matched; of rows with the same two idx the one with the largest overlap."""
        part = part[np.argsort(value[part], kind="stable")]
        _, r = np.unique(gt[part], return_inverse=True)
        _, p = np.unique(pred[part], return_inverse=True)
        n = max(r.max(), p.max()) + 1
        w, row = np.zeros((n, n)), np.full(n, -1)
        w[r, p] = 100.0 + value[part] + TIE * (r + 1) * (p + 1) / n**2
        hit = assign(w)[r] == p
        row[r[hit]] = part[hit]
        return row[row >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last image of a batch may go on in the next one
        for b in batches:
            t = pa.Table.from_batches([*held, b]).combine_chunks()
            if not len(t):
                continue
            keys = t[key].to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            yield from matched(t.slice(0, last))
            held = t.slice(last).to_batches()
        if held:
            yield from matched(pa.Table.from_batches(held))

    def matched(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(t):
            keys, gt, pred, value = (t[c].to_numpy(zero_copy_only=False) for c in (key, "gt_idx", "pred_idx", "iou"))
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            rows = [solve(part, gt, pred, value) for part in np.split(np.arange(len(keys)), cuts)]
            yield from t.take(pa.array(np.concatenate(rows))).combine_chunks().to_batches()

    # a pair whose boxes are in no other pair is matched; only the rest needs an assignment
    alone = (F.count("*").over(Window.partitionBy(key, "gt_idx")) == 1) & (F.count("*").over(Window.partitionBy(key, "pred_idx")) == 1)
    pairs = pairs.withColumn("_alone", alone)
    rest = pairs.where(~F.col("_alone")).drop("_alone")
    solved = rest.repartition(key).sortWithinPartitions(key).mapInArrow(run, rest.schema)
    return pairs.where("_alone").drop("_alone").unionByName(solved)


def detection_totals(truth: DataFrame, predicted: DataFrame, matches: DataFrame, *, key: str) -> DataFrame:
    """One row: tp, fp, fn (class-aware over class-agnostic matches), matched, precision and recall (0 where undefined)."""
    def counted(df: DataFrame, **ones: Column) -> DataFrame:
        return df.select(*[ones.get(x, F.lit(0)).cast("bigint").alias(x) for x in ("truths", "predictions", "matched", "tp")])

    one = F.lit(1)
    hit = (F.col("gt_cls") == F.col("pred_cls")).cast("int")
    rows = counted(truth, truths=one).unionByName(counted(predicted, predictions=one)).unionByName(counted(matches, matched=one, tp=hit))
    both = rows.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in rows.columns])
    tp = F.col("tp")
    return both.select("tp", (F.col("predictions") - tp).alias("fp"), (F.col("truths") - tp).alias("fn"), "matched", F.coalesce(F.try_divide(tp, F.col("predictions")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp, F.col("truths")), F.lit(0.0)).alias("recall"))
