"""Boxes and points. A box is a struct with x, y, w, h, or four columns under a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in "xywh"}


def area(a: dict[str, Column]) -> Column:
    return a["w"] * a["h"]


def intersects(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Touching edges intersect."""
    return (a["x"] <= b["x"] + b["w"]) & (b["x"] <= a["x"] + a["w"]) & (a["y"] <= b["y"] + b["h"]) & (b["y"] <= a["y"] + a["h"])


def common_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    common = common_area(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def centre_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return F.hypot(a["x"] + a["w"] / 2 - b["x"] - b["w"] / 2, a["y"] + a["h"] / 2 - b["y"] - b["h"] / 2)


def region_type(b: dict[str, Column], screen_w: float = 1920.0, screen_h: float = 1080.0) -> Column:
    """What a text region's shape and place say it is; the first rule that holds."""
    ratio, wide, high, middle = b["w"] / b["h"], b["w"] / screen_w, b["h"] / screen_h, (b["y"] + b["h"] / 2) / screen_h
    return F.when((ratio > 5) & (high < 0.05), "text_field").when((ratio < 3) & (wide < 0.3) & (high < 0.1), "button").when((middle < 0.1) | (middle > 0.9), "menu_item").when((wide > 0.5) & (high > 0.3), "dialog").otherwise("label")


def rectangle_type(b: dict[str, Column], screen_w: float = 1920.0, screen_h: float = 1080.0) -> Column:
    """What a rectangle without text is; the first rule that holds."""
    ratio, share = b["w"] / b["h"], b["w"] * b["h"] / (screen_w * screen_h)
    return F.when((ratio > 2) & (ratio < 8) & (share < 0.05), "button").when(share > 0.2, "dialog").otherwise("general")


def layout_score(b: dict[str, Column], screen_w: float = 1920.0, screen_h: float = 1080.0) -> Column:
    """How much a box looks like a dialog: size, centre, aspect, margins; a dialog from 0.6."""
    size = (b["w"] >= 200) & (b["h"] >= 100) & (b["w"] <= screen_w * 0.8) & (b["h"] <= screen_h * 0.8)
    centre = (F.abs(b["x"] + b["w"] / 2 - screen_w / 2) <= screen_w * 0.2) & (F.abs(b["y"] + b["h"] / 2 - screen_h / 2) <= screen_h * 0.2)
    aspect = (b["w"] / b["h"]).between(0.8, 3.0)
    margins = (b["x"] >= 50) & (b["y"] >= 50) & (b["x"] + b["w"] <= screen_w - 50) & (b["y"] + b["h"] <= screen_h - 50)
    return sum((F.when(c, v).otherwise(0.0) for c, v in ((size, 0.4), (centre, 0.3), (aspect, 0.2), (margins, 0.1))), F.lit(0.0))
