"""Fusion of page elements and what a detector saw: a spatial join with one best partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.geometry import centroid_distance, clip, css_to_image, iou
from sparkveil.operators.areas import union_areas

ACCEPT, CONSIDER, NEAR = 0.5, 0.3, 24.0
# fixed values: roles that a kind of detection may be explained by
COMPATIBLE = {
    "control": ("textbox", "password", "button", "link", "checkbox", "radio", "combobox", "listbox", "slider", "switch", "tab", "menuitem", "option"),
    "text": ("text", "label", "heading", "listitem", "link", "button", "alert"),
    "media": ("image", "canvas", "video", "iframe", "document", "progressbar"),
    "icon": ("button", "link", "image", "checkbox", "switch", "menuitem"),
}


def compatible(kind: Column, role: Column) -> Column:
    out = F.lit(False)
    for k, roles in COMPATIBLE.items():
        out = F.when(kind == k, role.isin(*roles)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def candidates(dom: DataFrame, space: DataFrame) -> DataFrame:
    """Visible elements in image coordinates, cut to the image: page_id, pos, id, role, box."""
    met = dom.filter("visible").join(space, "page_id")
    box = clip(css_to_image(F.col("css_box"), F.col("dpr"), F.col("scale")), F.col("image_w"), F.col("image_h"))
    return met.withColumn("_c", box).filter("_c is not null").select("page_id", "pos", "id", "role", F.col("_c.box").alias("box"))


def fuse(dom: DataFrame, detections: DataFrame, space: DataFrame, accept: float = ACCEPT, consider: float = CONSIDER, near: float = NEAR) -> DataFrame:
    """Each detection (page_id, idx, box, kind, score) with dom_id, iou and via; via is null where nothing explains it.

    Only the element of largest overlap is tested (the first on the page, of equals): it is accepted
    by its overlap, or by a lesser one with a fitting role and near centres. The page is the equality key
    of the join; best partners are chosen by aggregation, so no window sorts a page's pairs.
    """
    c = candidates(dom, space).select("page_id", F.col("pos").alias("_pos"), F.col("id").alias("_id"), F.col("role").alias("_role"), F.col("box").alias("_box"))
    pairs = detections.select("page_id", "idx", "box").join(c, "page_id").withColumn("_iou", iou(F.col("box"), F.col("_box"))).filter("_iou > 0")
    best = pairs.groupBy("page_id", "idx").agg(F.max_by(F.struct("_id", "_role", "_box", "_iou"), F.struct("_iou", (-F.col("_pos")).alias("p"))).alias("b"))
    met = detections.join(best, ["page_id", "idx"], "left")
    close = (F.col("b._iou") >= consider) & compatible(F.col("kind"), F.col("b._role")) & (centroid_distance(F.col("box"), F.col("b._box")) <= near)
    via = F.when(F.col("b._iou") >= accept, "iou").when(close, "iou+centroid")
    return met.withColumn("via", via).withColumn("dom_id", F.when(F.col("via").isNotNull(), F.col("b._id"))).withColumn("iou", F.when(F.col("via").isNotNull(), F.col("b._iou"))).drop("b")


def structure_only(dom: DataFrame, space: DataFrame, fused: DataFrame) -> DataFrame:
    """Elements that no detection matched."""
    matched = fused.filter("via is not null").select("page_id", F.col("dom_id").alias("id")).distinct()
    return candidates(dom, space).join(matched, ["page_id", "id"], "left_anti").select("page_id", "id")


def explained_fraction(fused: DataFrame, space: DataFrame) -> DataFrame:
    """The part of each page's image that unexplained detections leave: page_id, unexplained and explained fraction."""
    covered = union_areas(fused.filter("via is null"), ["page_id"])
    met = space.join(covered, "page_id", "left")
    area = (F.col("image_w") * F.col("image_h")).cast("double")
    part = F.when(area > 0, F.coalesce(F.col("area"), F.lit(0.0)) / F.nullif(area, F.lit(0.0))).otherwise(0.0)
    return met.select("page_id", part.alias("unexplained_fraction"), (1 - part).alias("explained_fraction"))
