"""Boxes and image geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumora.functions.arrays import once


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs with l, t, r, b; 0 if the union isn't positive."""
    width = F.greatest(F.lit(0.0), F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]))
    height = F.greatest(F.lit(0.0), F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"]))
    shared = width * height
    union = (a["r"] - a["l"]) * (a["b"] - a["t"]) + (b["r"] - b["l"]) * (b["b"] - b["t"]) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def finite(x: Column) -> Column:
    """Neither NaN (which Spark sorts above everything) nor infinite."""
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def letterbox(width: Column, height: Column, side: int = 640) -> Column:
    """scale, resized size (half-up) and floored padding of an image fitted into a square."""
    scale = F.lit(float(side)) / F.greatest(width, height)
    rw, rh = half_up(width * scale), half_up(height * scale)
    return F.struct(scale.alias("scale"), rw.cast("int").alias("rw"), rh.cast("int").alias("rh"), F.floor((F.lit(side) - rw) / 2).cast("int").alias("pad_x"), F.floor((F.lit(side) - rh) / 2).cast("int").alias("pad_y"))


def unletterbox(box: Column, geometry: Column) -> Column:
    """A box of centre and size in the square as clamped corners in [0, 1] of the image."""
    def side(center: Column, size: Column, sign: int, pad: Column, resized: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (center + sign * size / 2 - pad) / resized))

    x = (box["cx"], box["w"]), (geometry["pad_x"], geometry["rw"])
    y = (box["cy"], box["h"]), (geometry["pad_y"], geometry["rh"])
    return F.struct(side(*x[0], -1, *x[1]).alias("l"), side(*y[0], -1, *y[1]).alias("t"), side(*x[0], 1, *x[1]).alias("r"), side(*y[0], 1, *y[1]).alias("b"))


def pixel_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, margin: float = 0.06) -> Column:
    """An xywh box widened by a share of its size, rounded outwards; each of its sides is clamped to the image."""
    def side(v: Column, most: Column) -> Column:
        return F.greatest(F.lit(0), F.least(most, v)).cast("int")

    return F.struct(
        side(F.floor(x - w * margin), width).alias("l"), side(F.floor(y - h * margin), height).alias("t"),
        side(F.ceil(x + w + w * margin), width).alias("r"), side(F.ceil(y + h + h * margin), height).alias("b"),
    )


def yolo_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A clipped xywh box as centre and size relative to the image."""
    l, t = F.greatest(F.lit(0.0), x), F.greatest(F.lit(0.0), y)
    r, b = F.least(width, x + w), F.least(height, y + h)
    return F.struct(((l + r) / 2 / width).alias("cx"), ((t + b) / 2 / height).alias("cy"), ((r - l) / width).alias("w"), ((b - t) / height).alias("h"))


def relative_size(a: Column, b: Column) -> Column:
    """Largest relative change of width or height from b to a."""
    aw, bw, ah, bh = a["r"] - a["l"], b["r"] - b["l"], a["b"] - a["t"], b["b"] - b["t"]
    return F.greatest(F.abs(aw - bw) / bw, F.abs(ah - bh) / bh)


def windows(width: Column, height: Column, max_aspect: float = 2.0, overlap: float = 0.2) -> Column:
    """Windows (x, y, w, h) along the longer side of an image, none longer than ``max_aspect`` times the shorter side, each
    overlapping the one before; the last one ends with the image. One window if the image is short enough or empty."""
    wide, long, short = width > height, F.greatest(width, height), F.least(width, height)
    size = F.least(long, F.greatest(F.lit(1), half_up(short * max_aspect))).cast("int")
    step = F.greatest(F.lit(1), half_up(size * (1 - min(max(overlap, 0.0), 0.9)))).cast("int")
    last = long - size
    starts = F.array_union(F.transform(F.sequence(F.lit(0), F.floor(last / step).cast("int")), lambda i: i * step), F.array(last))
    none = F.lit(0)

    def at(s: Column) -> Column:
        return F.struct(F.when(wide, s).otherwise(none).alias("x"), F.when(wide, none).otherwise(s).alias("y"), F.when(wide, size).otherwise(width).alias("w"), F.when(wide, height).otherwise(size).alias("h"))

    whole = F.array(F.struct(none.alias("x"), none.alias("y"), width.cast("int").alias("w"), height.cast("int").alias("h")))
    if max_aspect <= 1:
        return whole
    return F.when((short <= 0) | (long / F.when(short > 0, short) <= max_aspect), whole).otherwise(F.transform(starts, at))


def to_whole(box: Column, window: Column, width: Column, height: Column) -> Column:
    """A box in shares of a window as one in shares of the whole image."""
    def out(v: Column, start: Column, size: Column, whole: Column) -> Column:
        return (start + v * size) / whole

    x, y = (window["x"], window["w"], width), (window["y"], window["h"], height)
    return F.struct(out(box["l"], *x).alias("l"), out(box["t"], *y).alias("t"), out(box["r"], *x).alias("r"), out(box["b"], *y).alias("b"))


def median(values: Column) -> Column:
    """The mean of the two middle values of an array of numbers; null of none."""
    at = lambda s, n: F.get(s, F.floor(n / 2).cast("int"))
    return once(F.array_sort(values), lambda s: (at(s, F.size(s) - 1) + at(s, F.size(s))) / 2)


# When a row of boxes has an angle.
ROW_BOXES, ROW_APART, ROW_RESIDUAL, ROW_LEAST, ROW_MOST = 5, 0.2, 0.25, 2.0, 20.0


def row_angle(boxes: Column, width: Column, height: Column) -> Column:
    """Degrees by which a row of boxes (shares of an image) is turned: the median slope of pairs of centres far enough apart;
    0 if there are few boxes, if their centres are not near one line, or if the angle is small or large."""
    points = F.transform(boxes, lambda d: F.struct(((d["l"] + d["r"]) * width / 2).alias("x"), ((d["t"] + d["b"]) * height / 2).alias("y")))

    def slopes(own: Column) -> Column:
        apart = lambda p, i: F.filter(F.slice(own, i + 2, F.size(own)), lambda q: F.abs(q["x"] - p["x"]) >= width * ROW_APART)
        return F.flatten(F.transform(own, lambda p, i: F.transform(apart(p, i), lambda q: (q["y"] - p["y"]) / (q["x"] - p["x"]))))

    tall = median(F.transform(boxes, lambda d: (d["b"] - d["t"]) * height))

    def judged(slope: Column, offset: Column, own: Column, tall: Column) -> Column:
        residual = median(F.transform(own, lambda p: F.abs(p["y"] - slope * p["x"] - offset)))
        angle = F.degrees(F.atan(slope))
        fine = (F.size(own) >= ROW_BOXES) & (tall > 0) & (residual <= tall * ROW_RESIDUAL) & F.abs(angle).between(ROW_LEAST, ROW_MOST)
        return F.when(fine, angle).otherwise(F.lit(0.0))

    return once(points, lambda own: once(median(slopes(own)), lambda slope: once(median(F.transform(own, lambda p: p["y"] - slope * p["x"])), lambda offset: once(tall, lambda high: judged(slope, offset, own, high)))))


# The guide of a scan, in shares of a frame.
GUIDE_LEFT, GUIDE_WIDTH, GUIDE_ASPECT, GUIDE_MOST = 0.04, 0.92, 3.2, 0.82


def scan_guide(width: Column, height: Column) -> Column:
    """The guide of an upright frame as l, t, w, h."""
    h = F.least(F.lit(GUIDE_MOST), width * GUIDE_WIDTH / GUIDE_ASPECT / height)
    return F.struct(F.lit(GUIDE_LEFT).alias("l"), ((1 - h) / 2).alias("t"), F.lit(GUIDE_WIDTH).alias("w"), h.alias("h"))


def frame_rotation(sensor: Column, device: Column) -> Column:
    """By how much a sensor's frame is turned against the device, in quarter turns; null if one is no quarter turn."""
    quarter = lambda x: x.isin(0, 90, 180, 270)
    return F.when(quarter(sensor) & quarter(device), F.pmod(sensor - device, F.lit(360)))


FRAME_SIDE = (2, 4096)


def frame_issue(width: Column, height: Column, rotation: Column, format_: Column, planes: Column) -> Column:
    """Why a camera frame can't be read: 'dimensions', 'planes', 'plane' or null. ``planes``: structs of row_stride, pixel_stride
    and length in bytes; one of four channels for bgra8888, else three of one channel, the last two of half the size."""
    bgra = format_ == "bgra8888"
    channels = F.when(bgra, 4).otherwise(1)

    def short(p: Column, i: Column) -> Column:
        w, h = (F.when(i == 0, side).otherwise(F.floor((side + 1) / 2)) for side in (width, height))
        row = (w - 1) * p["pixel_stride"] + channels
        return (p["pixel_stride"] < channels) | (p["row_stride"] < row) | (p["length"] < (h - 1) * p["row_stride"] + row)

    sized = width.between(*FRAME_SIDE) & height.between(*FRAME_SIDE) & rotation.isin(0, 90, 180, 270)
    return F.when(~F.coalesce(sized, F.lit(False)), "dimensions").when(F.size(planes) != F.when(bgra, 1).otherwise(3), "planes").when(F.exists(F.transform(planes, short), lambda x: F.coalesce(x, F.lit(True))), "plane")


def chroma_index(x: Column, y: Column, row_stride: Column, pixel_stride: Column) -> Column:
    """The byte of a half-size plane that colours pixel (x, y)."""
    return F.floor(y / 2) * row_stride + F.floor(x / 2) * pixel_stride


def rotated(x: Column, y: Column, width: Column, height: Column, degrees: Column) -> Column:
    """Source pixel index of pixel (x, y) of an upright image from a sensor image turned by 0, 90, 180 or 270 degrees."""
    return F.when(degrees == 90, (height - 1 - x) * width + y).when(degrees == 180, (height - 1 - y) * width + (width - 1 - x)).when(degrees == 270, x * width + (width - 1 - y)).otherwise(y * width + x)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> Column:
    """BT.601 full-range YUV as rounded and clamped RGB."""
    def clamp(x: Column) -> Column:
        return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + 0.5))).cast("int")

    return F.struct(clamp(y + 1.402 * (v - 128)).alias("r"), clamp(y - 0.344136 * (u - 128) - 0.714136 * (v - 128)).alias("g"), clamp(y + 1.772 * (u - 128)).alias("b"))
