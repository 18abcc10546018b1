"""Queries on camera frames, windows and the detector's chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.functions.geometry import chroma_index, frame_issue, frame_rotation, letterbox, scan_guide, to_whole
from lumora.operators.consensus import shed
from lumora.operators.detections import crop_totals, detect, nms, owned, positional_errors, softmax
from lumora.operators.fingerprints import add_phash, dhash
from lumora.plans.base import register, table
from lumora.plans.vision import _BOXES, _IMG, _IOU_SQL, _boxes, _images, _nms_sql, derive_sql

QUERIES: dict = {}

# Raw anchors of an order's image, 640 x 360: some not finite, without size, or beyond the edge.
_RAW = {
    "image_id": "l_orderkey", "anchor": "CAST(l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS BIGINT)", "cx": "CASE WHEN l_partkey % 29 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(l_partkey % 800 - 80 AS DOUBLE) END",
    "cy": "CAST(l_suppkey % 300 + 170 AS DOUBLE)", "w": "CAST(l_quantity * 3 - 9 AS DOUBLE)", "h": "CAST(l_linenumber * 20 + 10 AS DOUBLE)",
    "s0": "CAST(l_partkey % 100 AS DOUBLE) / 100", "s1": "CASE WHEN l_suppkey % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(l_suppkey % 90 AS DOUBLE) / 100 END", "s2": "CAST(l_linenumber * 11 % 80 AS DOUBLE) / 100",
}
_DECODED = f"""raw AS (SELECT DISTINCT * FROM ({derive_sql('lineitem', _RAW)})),
sc AS (SELECT *, CASE WHEN isnan(s1) THEN 0.0 ELSE s1 END AS z1 FROM raw), cf AS (SELECT *, greatest(s0, z1, s2) AS conf FROM sc),
ub AS (SELECT image_id, anchor, CAST(CASE WHEN s0 = conf THEN 0 WHEN z1 = conf THEN 1 ELSE 2 END AS INT) AS cls, conf, least(1.0, greatest(0.0, (cx - w / 2) / 640)) AS l, least(1.0, greatest(0.0, (cy - h / 2 - 140) / 360)) AS t,
  least(1.0, greatest(0.0, (cx + w / 2) / 640)) AS r, least(1.0, greatest(0.0, (cy + h / 2 - 140) / 360)) AS b FROM cf WHERE conf >= 0.25 AND NOT isnan(cx) AND w > 0 AND h > 0),
boxes AS (SELECT * FROM ub WHERE r > l AND b > t)"""


@register(QUERIES, _nms_sql(f"{_IOU_SQL.format(a='k', b='o')} >= 0.45", 40, "k.l + k.r, k.anchor, k.l", _DECODED).replace("- 1 AS pos", "- 1 AS pos, row_number() OVER (PARTITION BY image_id ORDER BY k.l + k.r, k.anchor, k.l) <= 17 AS display"))
def detector_chain(spark, d):
    """Decode, drop unusable and clipped boxes, suppress, order, and take 17 for display."""
    raw = table(spark, d, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in _RAW.items()]).distinct()
    raw = raw.withColumn("scores", F.array("s0", "s1", "s2")).withColumn("geometry", letterbox(F.lit(640), F.lit(360)))
    return detect(raw, key="image_id").select("image_id", "anchor", "cls", F.round("conf", 6).alias("conf"), "pos", "display")


# Two windows of an image: 0 to 0.6 that owns centres under 0.5, and 0.4 to 1 that owns the others.
_PARTS = f"""{_BOXES.replace('boxes AS', 'whole AS')}, win AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.6::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE), (1, 0.4::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE)) v(k, a, z, o1, o2)),
parts AS (SELECT image_id, anchor * 2 + k AS anchor, cls, conf, a + ((l - a) / (z - a)) * (z - a) AS l, t, a + ((r - a) / (z - a)) * (z - a) AS r, b, o1, o2 FROM whole JOIN win ON l >= a AND r <= z),
boxes AS (SELECT image_id, anchor, cls, conf, l, t, r, b FROM parts WHERE (l + r) / 2 >= o1 AND ((l + r) / 2 < o2 OR o2 >= 1))"""


@register(QUERIES, _nms_sql(f"{_IOU_SQL.format(a='k', b='o')} >= 0.45", 40, "k.conf DESC, k.anchor, k.cls, k.l", _PARTS))
def window_merge(spark, d):
    """Boxes of two overlapping windows, put back in the image; a box counts for the window that owns its centre."""
    whole, parts = _boxes(spark, d), []
    for k, (a, z, first, last) in enumerate(((0.0, 0.6, 0.0, 0.5), (0.4, 1.0, 0.5, 1.0))):
        seen = whole.where((F.col("l") >= a) & (F.col("r") <= z))
        local = F.struct(((F.col("l") - a) / (z - a)).alias("l"), F.col("t").alias("t"), ((F.col("r") - a) / (z - a)).alias("r"), F.col("b").alias("b"))
        window = F.struct(F.lit(a).alias("x"), F.lit(0.0).alias("y"), F.lit(z - a).alias("w"), F.lit(1.0).alias("h"))
        back = seen.select("image_id", (F.col("anchor") * 2 + k).alias("anchor"), "cls", "conf", to_whole(local, window, F.lit(1.0), F.lit(1.0)).alias("x"))
        parts.append(owned(back.select("image_id", "anchor", "cls", "conf", "x.*"), F.lit(first), F.lit(last)))
    kept = nms(parts[0].unionByName(parts[1]), key="image_id", by_center=False)
    return kept.select("image_id", "anchor", "cls", F.round("conf", 6).alias("conf"), F.col("pos").cast("bigint").alias("pos"))


_SIZED = f"WITH i AS ({derive_sql('part', _IMG)})"


@register(QUERIES, f"{_SIZED}, g AS (SELECT id, least(0.82::DOUBLE, width * 0.92::DOUBLE / 3.2::DOUBLE / height) AS h FROM i) SELECT id, round((1 - h) / 2, 9) AS t, round(h, 9) AS h FROM g")
def scan_guides(spark, d):
    g = scan_guide(F.col("width"), F.col("height"))
    return _images(spark, d).select("id", F.round(g["t"], 9).alias("t"), F.round(g["h"], 9).alias("h"))


@register(QUERIES, f"{_SIZED} SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE CAST((id % 4 * 90 - id % 3 * 90 + 360) % 360 AS INT) END AS rotation, abs((width * 1.0::DOUBLE / height) / ((width + id % 30) * 1.0::DOUBLE / height) - 1) > 0.03 AS mismatch FROM i")
def frame_rotations(spark, d):
    """How far a frame is turned, and whether its aspect is more than 3 % off the preview's."""
    i = F.col("id")
    sensor = F.when(i % 11 == 0, 45).otherwise(i % 4 * 90)
    preview = (F.col("width") + i % 30) / F.col("height")
    return _images(spark, d).select("id", frame_rotation(sensor, i % 3 * 90).cast("int").alias("rotation"), (F.abs(F.col("width") / F.col("height") / preview - 1) > 0.03).alias("mismatch"))


@register(QUERIES, f"""{_SIZED}, c AS (SELECT *, CASE WHEN id % 2 = 0 THEN 4 ELSE 1 END AS ch, CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END AS np, CASE WHEN id % 13 = 0 THEN 5000 ELSE width END AS wd FROM i),
s AS (SELECT *, (wd - 1) * ch + ch + id % 3 - 1 AS stride0, (height - 1) * ((wd - 1) * ch + ch + id % 3 - 1) + (wd - 1) * ch + ch - (id % 7 = 0)::INT AS len0, CAST(floor((wd + 1) / 2) AS INT) AS w2, CAST(floor((height + 1) / 2) AS INT) AS h2 FROM c)
SELECT id, CASE WHEN wd > 4096 THEN 'dimensions' WHEN np = 2 THEN 'planes' WHEN stride0 < wd * ch OR len0 < (height - 1) * stride0 + wd * ch THEN 'plane' WHEN ch = 1 AND (id % 17 = 0) THEN 'plane' END AS issue FROM s""")
def frame_issues(spark, d):
    """Why a frame of strided planes can't be read."""
    i, height = F.col("id"), F.col("height")
    bgra = i % 2 == 0
    channels = F.when(bgra, 4).otherwise(1)
    width = F.when(i % 13 == 0, 5000).otherwise(F.col("width"))
    stride = (width - 1) * channels + channels + i % 3 - 1
    kind = "struct<row_stride:bigint,pixel_stride:bigint,length:bigint>"
    first = F.struct(stride.alias("row_stride"), channels.alias("pixel_stride"), ((height - 1) * stride + (width - 1) * channels + channels - F.when(i % 7 == 0, 1).otherwise(0)).alias("length")).cast(kind)
    half, tall = F.floor((width + 1) / 2), F.floor((height + 1) / 2)
    other = F.struct(half.alias("row_stride"), F.lit(1).alias("pixel_stride"), (tall * half - F.when(i % 17 == 0, 1).otherwise(0)).alias("length")).cast(kind)
    planes = F.when(i % 5 == 0, F.array(first, first)).when(bgra, F.array(first)).otherwise(F.array(first, other, other))
    return _images(spark, d).select("id", frame_issue(width, height, i % 4 * 90, F.when(bgra, "bgra8888").otherwise("yuv420"), planes).alias("issue"))


@register(QUERIES, f"{_SIZED} SELECT id, CAST((id % 50 // 2) * (CAST(floor((width + 1) / 2) AS BIGINT) + 16) + (id % 60 // 2) * 2 AS BIGINT) AS chroma FROM i")
def chroma_bytes(spark, d):
    """The byte of a half-size plane of pixel stride 2 and padded rows that colours a pixel."""
    i = F.col("id")
    return _images(spark, d).select("id", chroma_index(i % 60, i % 50, F.floor((F.col("width") + 1) / 2) + 16, F.lit(2)).cast("bigint").alias("chroma"))


@register(QUERIES, f"""WITH o AS (SELECT o_orderkey AS id, o_custkey % 9 + 1 AS width, o_custkey % 5 + 1 AS height FROM orders), s AS (SELECT l_orderkey AS id, count(DISTINCT l_linenumber) + 2 AS width, max(l_linenumber) + 1 AS height FROM lineitem GROUP BY 1)
SELECT id, o.width, o.height, s.width AS found_width, s.height AS found_height FROM o JOIN s USING (id) WHERE o.width <> s.width OR o.height <> s.height""")
def dimension_mismatches(spark, d):
    """Images whose declared size is not the one that was found, in another table."""
    declared = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 9 + 1).alias("width"), (F.col("o_custkey") % 5 + 1).alias("height"))
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.count_distinct("l_linenumber") + 2).alias("found_width"), (F.max("l_linenumber") + 1).alias("found_height"))
    return declared.join(found, "id").where("width <> found_width OR height <> found_height").select("id", "width", "height", "found_width", "found_height")


@register(QUERIES, f"{_SIZED} SELECT id, round((x + w * 0.25::DOUBLE) / width, 9) AS l, round((y + h * 0.5::DOUBLE) / height, 9) AS t, round((x + w * 0.75::DOUBLE) / width, 9) AS r, round((y + h) / height, 9) AS b FROM i")
def region_boxes(spark, d):
    """A box in shares of a region of interest as one in shares of the image."""
    box = F.struct(F.lit(0.25).alias("l"), F.lit(0.5).alias("t"), F.lit(0.75).alias("r"), F.lit(1.0).alias("b"))
    got = to_whole(box, F.struct("x", "y", "w", "h"), F.col("width"), F.col("height"))
    return _images(spark, d).select("id", *[F.round(got[k], 9).alias(k) for k in "ltrb"])


@register(QUERIES, """WITH b AS (SELECT vec_id, list_transform(embedding[1:63], lambda x: CAST(least(255, greatest(0, floor(128 + 127 * CAST(x AS DOUBLE)))) AS INT)) AS v FROM embeddings)
SELECT vec_id, sha256(encode('7x3:RGB:') || unhex(array_to_string(list_transform(v, lambda x: printf('%02x', x)), ''))) AS sha FROM b""")
def pixel_hashes(spark, d):
    """The hash of an image's raw pixels after its size; the pixels are bytes made of a vector's coordinates, three a pixel."""
    level = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + x.cast("double") * 127))).cast("int")
    digits = F.array_join(F.transform(F.slice("embedding", 1, 63), lambda x: F.lpad(F.hex(level(x)), 2, "0")), "")
    return table(spark, d, "embeddings").select("vec_id", F.sha2(F.concat(F.encode(F.lit("7x3:RGB:"), "utf-8"), F.unhex(digits)), 256).alias("sha"))


_CROPS = f"{_BOXES}, c AS (SELECT image_id, CAST(image_id % 3 AS INT) AS expected, image_id % 5 > 0 AS covered, arg_max(cls, struct_pack(c := conf, a := -anchor)) FILTER (WHERE conf >= 0.6) AS best, count(CASE WHEN conf >= 0.6 THEN 1 END) AS n_found FROM boxes GROUP BY image_id)"


def _crops(spark, d):
    sure = F.col("conf") >= 0.6
    by = F.struct(F.col("conf"), -F.col("anchor"))
    rows = _boxes(spark, d).groupBy("image_id").agg(F.max_by("cls", F.when(sure, by)).alias("best"), F.count_if(sure).alias("n_found"))
    return rows.select("image_id", (F.col("image_id") % 3).cast("int").alias("expected"), (F.col("image_id") % 5 > 0).alias("covered"), F.when(F.col("n_found") > 0, F.col("best")).alias("best"), "n_found")


@register(QUERIES, f"""WITH {_CROPS} SELECT count(CASE WHEN covered THEN 1 END) AS covered_crops, count(CASE WHEN covered AND best = expected THEN 1 END) AS top_correct, count(CASE WHEN covered AND best = expected AND n_found = 1 THEN 1 END) AS exactly_one_correct,
count(CASE WHEN covered AND n_found = 0 THEN 1 END) AS no_detection, count(CASE WHEN NOT covered THEN 1 END) AS unsupported_crops, count(CASE WHEN NOT covered AND n_found > 0 THEN 1 END) AS unsupported_with_false_detection FROM c""")
def crop_metrics(spark, d):
    return crop_totals(_crops(spark, d))


@register(QUERIES, f"WITH {_CROPS} SELECT expected, count(*) AS total, count(CASE WHEN best = expected THEN 1 END) AS top_correct, count(CASE WHEN best = expected AND n_found = 1 THEN 1 END) AS exactly_one_correct, count(CASE WHEN n_found = 0 THEN 1 END) AS missing FROM c GROUP BY expected")
def crop_metrics_by_class(spark, d):
    right = F.col("best") == F.col("expected")
    return _crops(spark, d).groupBy("expected").agg(F.count("*").alias("total"), F.count_if(right).alias("top_correct"), F.count_if(right & (F.col("n_found") == 1)).alias("exactly_one_correct"), F.count_if(F.col("n_found") == 0).alias("missing"))


@register(QUERIES, """WITH x AS (SELECT vec_id, list_transform(embedding[1:6], lambda v: exp(CAST(v AS DOUBLE) * 4)) AS e FROM embeddings), p AS (SELECT vec_id, list_max(e) / list_sum(e) AS confidence, CAST(list_position(e, list_max(e)) - 1 AS INT) AS cls FROM x)
SELECT vec_id, cls, round(confidence, 6) AS confidence FROM p WHERE cls <> 0""")
def crop_classes(spark, d):
    """The class of each crop by softmax; those whose best class is the background are rejected."""
    p = softmax(F.transform(F.slice("embedding", 1, 6), lambda v: v.cast("double") * 4))
    rows = table(spark, d, "embeddings").select("vec_id", p.alias("p")).withColumn("top", F.array_max("p"))
    return rows.select("vec_id", (F.array_position("p", F.col("top")) - 1).cast("int").alias("cls"), F.round("top", 6).alias("confidence")).where("cls <> 0")


@register(QUERIES, f"""WITH {_BOXES}, a AS (SELECT image_id, conf, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, anchor, l) AS rn FROM boxes), b AS (SELECT image_id, conf * (1 + (anchor % 3) / 1000.0::DOUBLE) AS conf, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, anchor, l) AS rn FROM boxes WHERE anchor % 17 > 0)
SELECT count(*) AS rows, count(CASE WHEN abs(a.conf - b.conf) <= 0.001::DOUBLE + 0.001::DOUBLE * abs(b.conf) THEN 1 END) AS close, count(CASE WHEN a.conf IS NULL OR b.conf IS NULL THEN 1 END) AS alone FROM a FULL JOIN b ON a.image_id = b.image_id AND a.rn = b.rn""")
def positional_parity(spark, d):
    """Two exports' outputs joined by their place in the order."""
    a = _boxes(spark, d)
    b = a.where("anchor % 17 > 0").withColumn("moved", F.col("conf") * (1 + (F.col("anchor") % 3) / 1000.0))
    got = positional_errors(a.withColumn("moved", F.col("conf")), b, key="image_id", order=[F.desc("conf"), "anchor", "l"], value="moved", rtol=0.001, atol=0.001)
    return got.agg(F.count("*").alias("rows"), F.count_if("close").alias("close"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("alone"))


@register(QUERIES, f"WITH {_BOXES}, p AS (SELECT a.image_id, a.conf, v.n FROM (SELECT image_id, max(conf) AS conf FROM boxes GROUP BY image_id) a JOIN (SELECT image_id, count(*) AS n FROM boxes WHERE cls > 0 GROUP BY image_id) v USING (image_id)) SELECT image_id, round(conf, 6) AS confidence, n FROM p")
def region_proposals(spark, d):
    """The most confident row of each region, with the number of its proposals."""
    a = _boxes(spark, d)
    return a.groupBy("image_id").agg(F.round(F.max("conf"), 6).alias("confidence")).join(a.where("cls > 0").groupBy("image_id").agg(F.count("*").alias("n")), "image_id")


@register(QUERIES, f"WITH {_BOXES} SELECT image_id, array_to_string(list_sort(list(cls))[1:17], '') AS sorted_classes FROM boxes GROUP BY image_id")
def sorted_classes(spark, d):
    """The first 17 of an image's classes in order."""
    rows = _boxes(spark, d).groupBy("image_id").agg(F.slice(F.array_sort(F.collect_list("cls")), 1, 17).alias("c"))
    return rows.select("image_id", F.array_join(F.transform("c", lambda x: x.cast("string")), "").alias("sorted_classes"))


@register(QUERIES, """WITH RECURSIVE e AS (SELECT user_id, event_id, event_id * 100 AS ms, 3000 + event_id % 7 * 2000 AS work, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
t AS (SELECT user_id, event_id, n, ms + work AS free, true AS taken FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.ms >= t.free THEN e.ms + e.work ELSE t.free END, e.ms >= t.free FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1)
SELECT user_id, event_id FROM t WHERE taken""")
def shed_frames(spark, d):
    """Frames that are taken while none is at work."""
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 100).alias("ms"), (3000 + F.col("event_id") % 7 * 2000).alias("work"))
    return shed(rows, key="user_id", order="event_id", at="ms", busy="work").select("user_id", "event_id")


# Brightnesses of a 32 x 32 grid of each vector, from products of its coordinates.
_CELL = "embedding[y + 1]::DOUBLE * 100 + embedding[x + 33]::DOUBLE * 50 + embedding[y + 1]::DOUBLE * embedding[x + 33]::DOUBLE * 80"


@register(QUERIES, f"""WITH cells AS (SELECT vec_id, y, x, {_CELL} AS g FROM embeddings, range(32) a(y), range(32) b(x)),
waves AS (SELECT k, x, cos(pi() * (2 * x + 1) * k / 64) * CASE WHEN k = 0 THEN sqrt(0.5) ELSE 1 END AS w FROM range(8) a(k), range(32) b(x)),
along AS (SELECT vec_id, y, k AS v, sum(g * w) AS g FROM cells JOIN waves USING (x) GROUP BY ALL),
low AS (SELECT vec_id, k AS u, v, sum(g * w) AS g FROM along JOIN waves ON waves.x = along.y GROUP BY ALL),
mid AS (SELECT vec_id, median(g) AS m FROM low WHERE u + v > 0 GROUP BY vec_id)
SELECT vec_id, lpad(lower(hex(sum(CASE WHEN g > m THEN CAST(1 AS UBIGINT) << (63 - u * 8 - v) ELSE 0 END)::UBIGINT)), 16, '0') AS phash FROM low JOIN mid USING (vec_id) GROUP BY vec_id""")
def phash_bits(spark, d):
    """Perceptual hashes of grids that are made of a vector's coordinates."""
    e, cell = F.col("embedding"), F.sequence(F.lit(0), F.lit(1023))
    at = lambda i: F.get(e, i.cast("int")).cast("double")
    grid = F.transform(cell, lambda i: at(F.floor(i / 32)) * 100 + at(i % 32 + 32) * 50 + at(F.floor(i / 32)) * at(i % 32 + 32) * 80)
    return add_phash(table(spark, d, "embeddings").select("vec_id", grid.alias("grid")), "grid").select("vec_id", "phash")


@register(QUERIES, """WITH grids AS (SELECT vec_id, list_transform(range(72), lambda i: CASE WHEN i % 9 < 8 THEN embedding[i // 9 * 8 + i % 9 + 1] ELSE (embedding[i // 9 * 8 + 1] + embedding[(i // 9 * 8 + 63) % 64 + 1]) / 2 END) AS g FROM embeddings)
SELECT vec_id, lpad(lower(hex(CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN g[i // 8 * 9 + i % 8 + 1] > g[i // 8 * 9 + i % 8 + 2] THEN CAST(1 AS UBIGINT) << (63 - i) ELSE 0 END)) AS UBIGINT))), 16, '0') AS dhash FROM grids""")
def dhash_bits(spark, d):
    """Difference hashes of grids of 8 rows of 9 cells: eight coordinates, and the mean of two others."""
    e = F.col("embedding")
    row, col = lambda i: F.floor(i / 9).cast("int"), lambda i: (i % 9).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.when(col(i) < 8, F.get(e, row(i) * 8 + col(i))).otherwise(((F.get(e, row(i) * 8) + F.get(e, (row(i) * 8 + 63) % 64)) / 2).cast("float")))
    return table(spark, d, "embeddings").select("vec_id", dhash(grid).alias("dhash"))
