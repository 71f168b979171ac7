"""Boxes as STRUCT<x, y, w, h: DOUBLE> and what is computed from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))])


def scaled(b: Column, f: Column) -> Column:
    return box(b["x"] * f, b["y"] * f, b["w"] * f, b["h"] * f)


def css_to_image(b: Column, dpr: Column, scale: Column) -> Column:
    return scaled(b, dpr * scale)


def device_to_image(b: Column, scale: Column) -> Column:
    return scaled(b, scale)


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def intersection(a: Column, b: Column) -> Column:
    ix = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    iy = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(ix, F.lit(0.0)) * F.greatest(iy, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without overlap."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter <= 0) | (union <= 0), 0.0).otherwise(inter / F.nullif(union, F.lit(0.0)))


def centroid_distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] + a["w"] / 2 - (b["x"] + b["w"] / 2), a["y"] + a["h"] / 2 - (b["y"] + b["h"] / 2))


def clip(b: Column, width: Column, height: Column) -> Column:
    """The part inside the image and whether some was cut off; null if nothing is inside."""
    x1, y1 = F.greatest(b["x"], F.lit(0.0)), F.greatest(b["y"], F.lit(0.0))
    x2, y2 = F.least(b["x"] + b["w"], width.cast("double")), F.least(b["y"] + b["h"], height.cast("double"))
    inside = box(x1, y1, x2 - x1, y2 - y1)
    return F.when((x2 > x1) & (y2 > y1), F.struct(inside.alias("box"), (area(inside) < area(b) - 1e-6).alias("partial")))


def dilation(b: Column) -> Column:
    """Pixels by which a mask grows: 15 percent of its height, halves rounded up, 2 at least."""
    return F.greatest(F.lit(2.0), F.floor(b["h"] * 0.15 + 0.5).cast("double"))


def dilate(b: Column, width: Column, height: Column) -> Column:
    """A mask grown by its dilation to whole pixels, inside the image."""
    d = dilation(b)
    x1, y1 = F.greatest(F.lit(0), F.floor(b["x"] - d)), F.greatest(F.lit(0), F.floor(b["y"] - d))
    x2, y2 = F.least(width, F.ceil(b["x"] + b["w"] + d)), F.least(height, F.ceil(b["y"] + b["h"] + d))
    return box(x1, y1, F.greatest(x2 - x1, F.lit(0)), F.greatest(y2 - y1, F.lit(0)))
