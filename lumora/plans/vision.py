"""Queries on detections: geometry, decoding, suppression, matching and their totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.functions.geometry import iou, letterbox, pixel_box, relative_size, rotated, row_angle, unletterbox, windows, yolo_box, yuv_to_rgb
from lumora.operators.detections import best_class, detection_totals, match_boxes, nms, usable_box
from lumora.plans.base import BOX, derive, derive_sql, register, table

QUERIES: dict = {}

_BOXES = f"boxes AS (SELECT DISTINCT * FROM ({derive_sql('lineitem', BOX)}))"
_IOU_SQL = """CASE WHEN ({a}.r - {a}.l) * ({a}.b - {a}.t) + ({b}.r - {b}.l) * ({b}.b - {b}.t) - greatest(0.0, least({a}.r, {b}.r) - greatest({a}.l, {b}.l)) * greatest(0.0, least({a}.b, {b}.b) - greatest({a}.t, {b}.t)) > 0
 THEN (greatest(0.0, least({a}.r, {b}.r) - greatest({a}.l, {b}.l)) * greatest(0.0, least({a}.b, {b}.b) - greatest({a}.t, {b}.t)))
 / (({a}.r - {a}.l) * ({a}.b - {a}.t) + ({b}.r - {b}.l) * ({b}.b - {b}.t) - greatest(0.0, least({a}.r, {b}.r) - greatest({a}.l, {b}.l)) * greatest(0.0, least({a}.b, {b}.b) - greatest({a}.t, {b}.t))) ELSE 0.0 END"""


def _boxes(spark, d):
    return derive(table(spark, d, "lineitem"), BOX).distinct()


@register(QUERIES, f"WITH {_BOXES}, p AS (SELECT a.image_id, a.anchor AS anchor_a, b.anchor AS anchor_b, {_IOU_SQL.format(a='a', b='b')} AS v FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.anchor < b.anchor) SELECT image_id, anchor_a, anchor_b, round(v, 6) AS iou FROM p WHERE v >= 0.5")
def iou_pairs(spark, d):
    a, b = _boxes(spark, d).alias("a"), _boxes(spark, d).alias("b")
    box = lambda p: F.struct(*[F.col(f"{p}.{x}").alias(x) for x in "ltrb"])
    pairs = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.anchor") < F.col("b.anchor"))).withColumn("v", iou(box("a"), box("b"))).where("v >= 0.5")
    return pairs.select("a.image_id", F.col("a.anchor").alias("anchor_a"), F.col("b.anchor").alias("anchor_b"), F.round("v", 6).alias("iou"))


# Image sizes and an xywh box in pixels, from a part.
_IMG = {"id": "p_partkey", "width": "CAST(p_partkey % 900 + 100 AS INT)", "height": "CAST(p_partkey * 7 % 500 + 80 AS INT)", "x": "CAST(p_size * 3 AS DOUBLE)", "y": "CAST(p_size * 2 AS DOUBLE)", "w": "CAST(p_partkey % 120 + 5 AS DOUBLE)", "h": "CAST(p_partkey % 70 + 5 AS DOUBLE)"}


def _images(spark, d):
    return derive(table(spark, d, "part"), _IMG)


_LETTER = f"""i AS ({derive_sql('part', _IMG)}), s AS (SELECT *, 640.0::DOUBLE / greatest(width, height) AS scale FROM i),
g AS (SELECT *, CAST(floor(width * scale + 0.5) AS INT) AS rw, CAST(floor(height * scale + 0.5) AS INT) AS rh FROM s),
q AS (SELECT *, CAST(floor((640 - rw) / 2) AS INT) AS pad_x, CAST(floor((640 - rh) / 2) AS INT) AS pad_y FROM g)"""


@register(QUERIES, f"WITH {_LETTER} SELECT id, round(scale, 9) AS scale, rw, rh, pad_x, pad_y FROM q")
def letterbox_geometry(spark, d):
    g = letterbox(F.col("width"), F.col("height"))
    return _images(spark, d).select("id", g.alias("g")).select("id", F.round("g.scale", 9).alias("scale"), "g.rw", "g.rh", "g.pad_x", "g.pad_y")


@register(QUERIES, f"""WITH {_LETTER} SELECT id, round(least(1.0, greatest(0.0, (x + 100 - w / 2 - pad_x) / rw)), 6) AS l, round(least(1.0, greatest(0.0, (y + 100 - h / 2 - pad_y) / rh)), 6) AS t,
round(least(1.0, greatest(0.0, (x + 100 + w / 2 - pad_x) / rw)), 6) AS r, round(least(1.0, greatest(0.0, (y + 100 + h / 2 - pad_y) / rh)), 6) AS b FROM q""")
def box_normalize(spark, d):
    rows = _images(spark, d).withColumn("g", letterbox(F.col("width"), F.col("height"))).withColumn("c", F.struct((F.col("x") + 100).alias("cx"), (F.col("y") + 100).alias("cy"), "w", "h"))
    rows = rows.withColumn("o", unletterbox(F.col("c"), F.col("g")))
    return rows.select("id", *[F.round(f"o.{k}", 6).alias(k) for k in "ltrb"])


@register(QUERIES, f"""WITH i AS ({derive_sql('part', _IMG)}) SELECT id, CAST(greatest(0, least(width, floor(x - w * 0.06::DOUBLE))) AS INT) AS l, CAST(greatest(0, least(height, floor(y - h * 0.06::DOUBLE))) AS INT) AS t,
CAST(greatest(0, least(width, ceil(x + w + w * 0.06::DOUBLE))) AS INT) AS r, CAST(greatest(0, least(height, ceil(y + h + h * 0.06::DOUBLE))) AS INT) AS b,
CASE WHEN least(w, h) < 8 THEN 'too_small' WHEN x + w > width + 0.01 OR y + h > height + 0.01 THEN 'outside' ELSE 'kept' END AS state FROM i""")
def pixel_boxes(spark, d):
    c = F.col
    box = pixel_box(c("x"), c("y"), c("w"), c("h"), c("width"), c("height"))
    state = F.when(F.least("w", "h") < 8, "too_small").when((c("x") + c("w") > c("width") + 0.01) | (c("y") + c("h") > c("height") + 0.01), "outside").otherwise("kept")
    return _images(spark, d).select("id", box.alias("o"), state.alias("state")).select("id", "o.*", "state")


@register(QUERIES, f"""WITH i AS ({derive_sql('part', _IMG)}), e AS (SELECT *, greatest(0.0, x) AS el, greatest(0.0, y) AS et, least(width, x + w) AS er, least(height, y + h) AS eb FROM i)
SELECT id, round((el + er) / 2 / width, 9) AS cx, round((et + eb) / 2 / height, 9) AS cy, round((er - el) / width, 9) AS bw, round((eb - et) / height, 9) AS bh FROM e""")
def yolo_boxes(spark, d):
    c = F.col
    o = yolo_box(c("x"), c("y"), c("w"), c("h"), c("width"), c("height"))
    return _images(spark, d).select("id", o.alias("o")).select("id", F.round("o.cx", 9).alias("cx"), F.round("o.cy", 9).alias("cy"), F.round("o.w", 9).alias("bw"), F.round("o.h", 9).alias("bh"))


# Every other image is upright.
_UPRIGHT = f"i AS (SELECT id, CASE WHEN id % 2 = 0 THEN width ELSE height END AS width, CASE WHEN id % 2 = 0 THEN height ELSE width END AS height FROM ({derive_sql('part', _IMG)}))"


@register(QUERIES, f"""WITH {_UPRIGHT}, s AS (SELECT *, greatest(width, height) AS ls, least(width, height) AS ss FROM i), z AS (SELECT *, CAST(least(ls, greatest(1, floor(ss * 2.0::DOUBLE + 0.5::DOUBLE))) AS INT) AS size FROM s),
p AS (SELECT *, CAST(greatest(1, floor(size * 0.8::DOUBLE + 0.5::DOUBLE)) AS INT) AS step, ls - size AS last FROM z),
q AS (SELECT *, CASE WHEN ls <= ss * 2 THEN [0] ELSE list_sort(list_distinct(list_append(list_transform(range(last // step + 1), lambda k: CAST(k * step AS INT)), last))) END AS starts FROM p)
SELECT id, array_to_string(list_transform(starts, lambda v: CASE WHEN ls <= ss * 2 THEN '0,0,' || width || ',' || height WHEN width > height THEN v || ',0,' || size || ',' || height ELSE '0,' || v || ',' || width || ',' || size END), ';') AS windows FROM q""")
def inference_windows(spark, d):
    side = lambda a, b: F.when(F.col("id") % 2 == 0, F.col(a)).otherwise(F.col(b))
    rows = _images(spark, d).select("id", side("width", "height").alias("w"), side("height", "width").alias("h"))
    text = F.transform(windows(F.col("w"), F.col("h")), lambda o: F.concat_ws(",", *[o[k].cast("string") for k in "xywh"]))
    return rows.select("id", F.array_join(text, ";").alias("windows"))


@register(QUERIES, f"""WITH i AS ({derive_sql('part', _IMG)}), k AS (SELECT *, CAST(id % 4 * 90 AS INT) AS deg, CAST(id % 10 AS INT) AS px, CAST(id % 7 AS INT) AS py, CAST(id % 256 AS INT) AS yy, CAST(id * 3 % 256 AS INT) AS uu, CAST(id * 5 % 256 AS INT) AS vv FROM i)
SELECT id, CASE deg WHEN 90 THEN (height - 1 - px) * width + py WHEN 180 THEN (height - 1 - py) * width + (width - 1 - px) WHEN 270 THEN px * width + (width - 1 - py) ELSE py * width + px END AS pixel,
CAST(least(255, greatest(0, floor(yy + 1.402::DOUBLE * (vv - 128) + 0.5::DOUBLE))) AS INT) AS r, CAST(least(255, greatest(0, floor(yy - 0.344136::DOUBLE * (uu - 128) - 0.714136::DOUBLE * (vv - 128) + 0.5::DOUBLE))) AS INT) AS g,
CAST(least(255, greatest(0, floor(yy + 1.772::DOUBLE * (uu - 128) + 0.5::DOUBLE))) AS INT) AS b FROM k""")
def camera_pixels(spark, d):
    i = F.col("id")
    rows = _images(spark, d).withColumn("deg", i % 4 * 90).withColumn("px", (i % 10).cast("int")).withColumn("py", (i % 7).cast("int"))
    rgb = yuv_to_rgb((i % 256).cast("int"), (i * 3 % 256).cast("int"), (i * 5 % 256).cast("int"))
    return rows.select("id", rotated(F.col("px"), F.col("py"), F.col("width"), F.col("height"), F.col("deg")).alias("pixel"), rgb.alias("c")).select("id", "pixel", "c.*")


@register(QUERIES, f"WITH {_BOXES}, p AS (SELECT a.image_id, a.anchor, lag(r - l) OVER w AS pw, lag(b - t) OVER w AS ph, r - l AS w0, b - t AS h0 FROM boxes a WINDOW w AS (PARTITION BY image_id ORDER BY anchor, l)) SELECT image_id, anchor, round(greatest(abs(w0 - pw) / pw, abs(h0 - ph) / ph), 6) AS change FROM p WHERE pw IS NOT NULL")
def size_changes(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("image_id").orderBy("anchor", "l")
    box = F.struct("l", "t", "r", "b")
    rows = _boxes(spark, d).withColumn("x", box).withColumn("y", F.lag(box).over(w)).where("y is not null")
    return rows.select("image_id", "anchor", F.round(relative_size(F.col("x"), F.col("y")), 6).alias("change"))


# Scores of a row of the embeddings; some are not numbers.
@register(QUERIES, """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN vec_id % 5 = 0 AND i = 1 THEN 0.0::DOUBLE ELSE CAST(x AS DOUBLE) END) AS s FROM embeddings)
SELECT vec_id, round(list_max(s), 6) AS confidence, CAST(list_position(s, list_max(s)) - 1 AS INT) AS cls, list_max(s) >= 0.25 AS kept FROM s""")
def decode_argmax(spark, d):
    nan = F.when((F.col("vec_id") % 5 == 0), F.lit(float("nan")))
    scores = F.transform(F.col("embedding"), lambda x, i: F.when(i == 0, F.coalesce(nan, x.cast("double"))).otherwise(x.cast("double")))
    top, cls = best_class(F.col("s"))
    one = F.lit(1.0)
    rows = table(spark, d, "embeddings").select("vec_id", scores.alias("s")).where(usable_box(one, one, one, one))
    return rows.select("vec_id", F.round(top, 6).alias("confidence"), cls.alias("cls"), (top >= 0.25).alias("kept"))


def _nms_sql(over: str, most: int, order: str, boxes: str = _BOXES) -> str:
    return f"""
WITH RECURSIVE {boxes}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, anchor, cls, l) AS n FROM boxes),
f AS (
  SELECT image_id, 1 AS n, [struct_pack(anchor := anchor, cls := cls, conf := conf, l := l, t := t, r := r, b := b)] AS kept FROM o WHERE n = 1
  UNION ALL
  SELECT f.image_id, o.n, CASE WHEN len(kept) >= {most} OR len(list_filter(kept, lambda k: {over})) > 0 THEN kept ELSE list_append(kept, struct_pack(anchor := o.anchor, cls := o.cls, conf := o.conf, l := o.l, t := o.t, r := o.r, b := o.b)) END
  FROM f JOIN o ON o.image_id = f.image_id AND o.n = f.n + 1),
z AS (SELECT image_id, unnest(kept) AS k FROM f WHERE n = (SELECT max(n) FROM o WHERE o.image_id = f.image_id))
SELECT image_id, k.anchor AS anchor, k.cls AS cls, round(k.conf, 6) AS conf, row_number() OVER (PARTITION BY image_id ORDER BY {order}) - 1 AS pos FROM z"""


@register(QUERIES, _nms_sql(f"{_IOU_SQL.format(a='k', b='o')} >= 0.45", 40, "k.l + k.r, k.anchor, k.l"))
def nms_agnostic(spark, d):
    return nms(_boxes(spark, d), key="image_id").select("image_id", "anchor", "cls", F.round("conf", 6).alias("conf"), F.col("pos").cast("bigint").alias("pos"))


@register(QUERIES, _nms_sql(f"k.cls = o.cls AND {_IOU_SQL.format(a='k', b='o')} > 0.45", 1000, "k.conf DESC, k.anchor, k.l"))
def nms_per_class(spark, d):
    return nms(_boxes(spark, d), key="image_id", per_class=True, inclusive=False, most=None, by_center=False).select("image_id", "anchor", "cls", F.round("conf", 6).alias("conf"), F.col("pos").cast("bigint").alias("pos"))


@register(QUERIES, f"WITH {_BOXES} SELECT image_id, anchor, CASE WHEN (l + r) / 2 < 0.5 THEN 0 ELSE 1 END AS owner FROM boxes")
def nms_windows(spark, d):
    """The window that owns each box by its centre: half-open ranges, the last one closed."""
    center = (F.col("l") + F.col("r")) / 2
    return _boxes(spark, d).select("image_id", "anchor", F.when((center >= 0.0) & (center < 0.5), 0).when(center <= 1.0, 1).alias("owner"))


def _truth_and_predictions(spark, d):
    """Truth: boxes of even line hashes; predictions: all boxes moved a little."""
    rows = _boxes(spark, d).withColumnRenamed("anchor", "idx")
    truth = rows.where("idx % 2 = 0")
    shift = (F.col("idx") % 5) / F.lit(200.0)
    moved = rows.where("idx % 3 > 0").withColumn("cls", F.when(F.col("idx") % 7 == 0, (F.col("cls") + 1) % 3).otherwise(F.col("cls"))).withColumn("l", F.col("l") + shift).withColumn("r", F.col("r") + shift)
    return truth, moved


# All matchings of an image's boxes, prediction by prediction: each one takes a free box of truth or none. A pair whose boxes
# are in no other pair is matched anyway.
_MATCHES = f"""{_BOXES}, truth AS (SELECT image_id, anchor AS idx, cls, l, t, r, b FROM boxes WHERE anchor % 2 = 0),
predicted AS (SELECT image_id, anchor AS idx, CASE WHEN anchor % 7 = 0 THEN (cls + 1) % 3 ELSE cls END AS cls, l + (anchor % 5) / 200.0 AS l, t, r + (anchor % 5) / 200.0 AS r, b FROM boxes WHERE anchor % 3 > 0),
every AS (SELECT image_id, g.idx AS gt_idx, p.idx AS pred_idx, g.cls AS gt_cls, p.cls AS pred_cls, {_IOU_SQL.format(a='g', b='p')} AS iou FROM truth g JOIN predicted p USING (image_id) WHERE {_IOU_SQL.format(a='g', b='p')} >= 0.5),
counted AS (SELECT *, count(*) OVER (PARTITION BY image_id, gt_idx) = 1 AND count(*) OVER (PARTITION BY image_id, pred_idx) = 1 AS alone FROM every),
pairs AS MATERIALIZED (SELECT image_id, gt_idx, pred_idx, gt_cls, pred_cls, alone, max(iou) AS iou FROM counted GROUP BY ALL),
rest AS MATERIALIZED (SELECT * FROM pairs WHERE NOT alone),
ranks AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY gt_idx) AS g, dense_rank() OVER (PARTITION BY image_id ORDER BY pred_idx) AS step FROM rest),
steps AS MATERIALIZED (SELECT *, 100 + iou + 1e-7 * g * step / greatest(max(g) OVER (PARTITION BY image_id), max(step) OVER (PARTITION BY image_id)) ** 2 AS weight, g = min(g) OVER (PARTITION BY image_id, step) AS lowest FROM ranks),
search AS (
  SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS gts, CAST([] AS BIGINT[]) AS preds, CAST(0 AS DOUBLE) AS total FROM rest
  UNION ALL
  SELECT s.image_id, s.step + 1, CASE WHEN taken THEN list_append(gts, gt_idx) ELSE gts END, CASE WHEN taken THEN list_append(preds, pred_idx) ELSE preds END, total + CASE WHEN taken THEN weight ELSE 0 END
  FROM search s JOIN steps x ON x.image_id = s.image_id AND x.step = s.step + 1, (VALUES (true), (false)) v(taken)
  WHERE (taken AND NOT list_contains(gts, gt_idx)) OR (NOT taken AND lowest)),
best AS (SELECT image_id, arg_max({{'g': gts, 'p': preds}}, total) AS m FROM search GROUP BY image_id),
chosen AS (SELECT image_id, unnest(m.g) AS gt_idx, unnest(m.p) AS pred_idx FROM best),
matches AS (SELECT pairs.* FROM pairs LEFT JOIN chosen USING (image_id, gt_idx, pred_idx) WHERE alone OR chosen.image_id IS NOT NULL)"""


@register(QUERIES, f"WITH RECURSIVE {_MATCHES} SELECT image_id, gt_idx, pred_idx, gt_cls, pred_cls, round(iou, 6) AS iou FROM matches")
def match_assignment(spark, d):
    truth, predicted = _truth_and_predictions(spark, d)
    return match_boxes(truth, predicted, key="image_id").withColumn("iou", F.round("iou", 6))


@register(QUERIES, f"""WITH RECURSIVE {_MATCHES}, n AS (SELECT (SELECT count(*) FROM truth) AS g, (SELECT count(*) FROM predicted) AS p, (SELECT count(*) FROM matches) AS matched, (SELECT count(*) FROM matches WHERE gt_cls = pred_cls) AS tp)
SELECT tp, p - tp AS fp, g - tp AS fn, matched, coalesce(tp / nullif(p, 0), 0.0) AS precision, coalesce(tp / nullif(g, 0), 0.0) AS recall FROM n""")
def detection_precision_recall(spark, d):
    truth, predicted = _truth_and_predictions(spark, d)
    return detection_totals(truth, predicted, match_boxes(truth, predicted, key="image_id"), key="image_id")


@register(QUERIES, f"WITH RECURSIVE {_MATCHES} SELECT gt_cls, pred_cls, count(*) AS n FROM matches GROUP BY ALL")
def detection_confusion(spark, d):
    truth, predicted = _truth_and_predictions(spark, d)
    return match_boxes(truth, predicted, key="image_id").groupBy("gt_cls", "pred_cls").agg(F.count("*").alias("n"))


@register(QUERIES, f"""WITH {_BOXES}, h AS (SELECT image_id, cls, anchor % 2 AS side FROM boxes), c AS (SELECT image_id, cls, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN side <> 0 THEN 1 ELSE 0 END) AS b FROM h GROUP BY ALL)
SELECT image_id, CAST(sum(least(a, b)) AS BIGINT) AS shared, CAST(sum(b) - sum(least(a, b)) AS BIGINT) AS extra, CAST(sum(a) - sum(least(a, b)) AS BIGINT) AS missed, sum(abs(a - b)) = 0 AS equal FROM c GROUP BY image_id""")
def multiset_overlap(spark, d):
    counts = _boxes(spark, d).groupBy("image_id", "cls").agg(F.count(F.when(F.col("anchor") % 2 == 0, 1)).alias("a"), F.count(F.when(F.col("anchor") % 2 != 0, 1)).alias("b"))
    s = F.sum(F.least("a", "b"))
    return counts.groupBy("image_id").agg(s.alias("shared"), (F.sum("b") - s).alias("extra"), (F.sum("a") - s).alias("missed"), (F.sum(F.abs(F.col("a") - F.col("b"))) == 0).alias("equal"))


# Boxes of an image as a row that is turned: the height of a box follows its place; the image is 1000 x 600.
_ROW = f"""r0 AS (SELECT DISTINCT image_id, anchor, (l + r) / 2 AS cx, b - t AS h, (t + b) / 2 AS cy FROM ({derive_sql('lineitem', BOX)})),
r1 AS (SELECT image_id, anchor, 500.0::DOUBLE + (cx - 0.5::DOUBLE) * 3000 AS x, 300.0::DOUBLE + (cx - 0.5::DOUBLE) * 3000 * (image_id % 9 - 4) / 10 + (cy - 0.5::DOUBLE) * 6 * (image_id % 40) AS y, h * 600 AS h FROM r0)"""


@register(QUERIES, f"""WITH {_ROW}, p AS (SELECT a.image_id, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM r1 a JOIN r1 b ON a.image_id = b.image_id AND b.x - a.x >= 200 GROUP BY a.image_id),
o AS (SELECT r1.image_id, any_value(slope) AS slope, quantile_cont(y - slope * x, 0.5) AS offs, quantile_cont(h, 0.5) AS tall, count(*) AS n FROM r1 LEFT JOIN p ON r1.image_id = p.image_id GROUP BY r1.image_id),
z AS (SELECT r1.image_id, any_value(o.slope) AS slope, any_value(o.n) AS n, quantile_cont(abs(y - o.slope * x - offs), 0.5) <= any_value(tall) * 0.25 AS fine FROM r1 JOIN o ON r1.image_id = o.image_id GROUP BY r1.image_id)
SELECT image_id, CASE WHEN n >= 5 AND fine AND abs(degrees(atan(slope))) BETWEEN 2 AND 20 THEN round(degrees(atan(slope)), 6) ELSE 0.0 END AS angle FROM z""")
def row_angles(spark, d):
    c = F.col
    place = (c("l") + c("r")) / 2 - 0.5
    y = 300.0 + place * 3000 * (c("image_id") % 9 - 4) / 10 + ((c("t") + c("b")) / 2 - 0.5) * 6 * (c("image_id") % 40)
    rows = _boxes(spark, d).select("image_id", "anchor", ((500.0 + place * 3000) / 1000).alias("cx"), (y / 600).alias("cy"), (c("b") - c("t")).alias("h"))
    box = F.struct(c("cx").alias("l"), (c("cy") - c("h") / 2).alias("t"), c("cx").alias("r"), (c("cy") + c("h") / 2).alias("b"))
    return rows.groupBy("image_id").agg(F.collect_list(box).alias("boxes")).select("image_id", F.round(row_angle(c("boxes"), F.lit(1000.0), F.lit(600.0)), 6).alias("angle"))
