"""Boxes and segments of a frame: which meet, how much they share, whether they cross."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.operators.cells import span_pairs

BOX = (("x1", "x2"), ("y1", "y2"))


def box_pairs(left: DataFrame, right: DataFrame, frame: str, cell: float) -> DataFrame:
    """Pairs of boxes (x1, y1, x2, y2) of a frame that touch or overlap, each once: frame, l_*, r_*.

    ``cell`` is about the side of a small box; boxes of any size are a few dyadic cells an axis. A crowded frame spreads over its cells.
    """
    return span_pairs(left, right, [frame], BOX, [cell, cell])


def box_iou(a: str = "l", b: str = "r") -> Column:
    """Shared area over joint area of two boxes; 0 when both are without area."""
    side = lambda axis: F.greatest(F.least(F.col(f"{a}_{axis}2"), F.col(f"{b}_{axis}2")) - F.greatest(F.col(f"{a}_{axis}1"), F.col(f"{b}_{axis}1")), F.lit(0.0))
    area = lambda p: (F.col(f"{p}_x2") - F.col(f"{p}_x1")) * (F.col(f"{p}_y2") - F.col(f"{p}_y1"))
    both = side("x") * side("y")
    joint = area(a) + area(b) - both
    return F.when(joint > 0, both / joint).otherwise(0.0)


def segments_cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether segments a-b and c-d share a point, ends and touching included."""
    turn = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    one, two = turn(ax, ay, bx, by, cx, cy), turn(ax, ay, bx, by, dx, dy)
    three, four = turn(cx, cy, dx, dy, ax, ay), turn(cx, cy, dx, dy, bx, by)
    meet = (F.greatest(F.least(ax, bx), F.least(cx, dx)) <= F.least(F.greatest(ax, bx), F.greatest(cx, dx))) & (
        F.greatest(F.least(ay, by), F.least(cy, dy)) <= F.least(F.greatest(ay, by), F.greatest(cy, dy)))
    return meet & (one * two <= 0) & (three * four <= 0)


def segment_crossings(left: DataFrame, right: DataFrame, frame: str, cell: float) -> DataFrame:
    """Pairs of segments (ax, ay, bx, by) of a frame that share a point: their bounding boxes meet first, then the segments are tested."""
    boxed = lambda df: df.withColumns({f"{x}{i}": f(F.col(f"a{x}"), F.col(f"b{x}")) for x in "xy" for i, f in ((1, F.least), (2, F.greatest))})
    ends = [F.col(f"{p}_{e}{x}") for p in "lr" for e in "ab" for x in "xy"]
    helper = [f"{p}_{x}{i}" for p in "lr" for x in "xy" for i in (1, 2)]
    return box_pairs(boxed(left), boxed(right), frame, cell).where(segments_cross(*ends)).drop(*helper)
