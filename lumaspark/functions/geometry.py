"""Rectangles of the active picture area as ``STRUCT<x, y, width, height>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .transfer import col

# Fixed values of the crop detector.
EDGE_TOLERANCE = 2
GRID_STEP = 10
MIN_LINE_SHARE = 0.10
MIN_USABLE_SHARE = 0.05


def rect(x, y, width, height) -> Column:
    return F.struct(
        col(x).cast("int").alias("x"),
        col(y).cast("int").alias("y"),
        col(width).cast("int").alias("width"),
        col(height).cast("int").alias("height"),
    )


def right(r: Column) -> Column:
    return r["x"] + r["width"]


def bottom(r: Column) -> Column:
    return r["y"] + r["height"]


def area(r: Column) -> Column:
    return r["width"].cast("bigint") * r["height"].cast("bigint")


def rect_matches(a: Column, b: Column, tolerance: int = EDGE_TOLERANCE) -> Column:
    return (
        (F.abs(a["x"] - b["x"]) <= tolerance)
        & (F.abs(a["y"] - b["y"]) <= tolerance)
        & (F.abs(right(a) - right(b)) <= tolerance)
        & (F.abs(bottom(a) - bottom(b)) <= tolerance)
    )


def rect_union(r: Column) -> Column:
    """Aggregate: bounding rectangle of a group."""
    x, y = F.min(r["x"]), F.min(r["y"])
    return rect(x, y, F.max(right(r)) - x, F.max(bottom(r)) - y)


def scale_rect(r: Column, factor: int) -> Column:
    return rect(r["x"] * factor, r["y"] * factor, r["width"] * factor, r["height"] * factor)


def shrink_rect(r: Column, factor: int) -> Column:
    def down(v: Column) -> Column:
        return F.floor(v / factor)

    return rect(
        down(r["x"]),
        down(r["y"]),
        F.greatest(down(r["width"]), F.lit(2)),
        F.greatest(down(r["height"]), F.lit(2)),
    )
