"""Frame safety scores over tables of ego states, boxes, future steps and map lines (keyed by scene and frame)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.text import let

FRAME = ("scene", "frame")


def box_corners(x: Column, y: Column, l: Column, w: Column, yaw: Column) -> Column:
    """Corners of an oriented rectangle: front left, front right, rear right, rear left."""
    c, s = F.cos(yaw), F.sin(yaw)
    corner = lambda dl, dw: F.array(x + l / 2 * dl * c - w / 2 * dw * s, y + l / 2 * dl * s + w / 2 * dw * c)
    return F.array(corner(1, 1), corner(1, -1), corner(-1, -1), corner(-1, 1))


def half_extent(l: Column, w: Column, yaw: Column) -> tuple[Column, Column]:
    """Half sizes of the axis-parallel envelope of an oriented rectangle."""
    c, s = F.abs(F.cos(yaw)), F.abs(F.sin(yaw))
    return l / 2 * c + w / 2 * s, l / 2 * s + w / 2 * c


def envelopes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    (ax, ay), (bx, by) = half_extent(a["l"], a["w"], a["yaw"]), half_extent(b["l"], b["w"], b["yaw"])
    return (F.abs(a["x"] - b["x"]) <= ax + bx) & (F.abs(a["y"] - b["y"]) <= ay + by)


def rectangles_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Exact overlap of oriented rectangles: no separating direction among the four edge directions."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    meet = F.lit(True)
    for one, other in ((a, b), (b, a)):
        c, s = F.cos(one["yaw"]), F.sin(one["yaw"])
        ct, st = F.abs(F.cos(other["yaw"] - one["yaw"])), F.abs(F.sin(other["yaw"] - one["yaw"]))
        meet = meet & (F.abs(dx * c + dy * s) <= one["l"] / 2 + other["l"] / 2 * ct + other["w"] / 2 * st)
        meet = meet & (F.abs(dy * c - dx * s) <= one["w"] / 2 + other["l"] / 2 * st + other["w"] / 2 * ct)
    return meet


def segment_meets_box(p: Column, q: Column, box: dict[str, Column]) -> Column:
    """Whether a segment touches an oriented rectangle (separating directions in the box frame)."""
    c, s = F.cos(box["yaw"]), F.sin(box["yaw"])
    local = lambda pt: (((pt[0] - box["x"]) * c + (pt[1] - box["y"]) * s), ((pt[1] - box["y"]) * c - (pt[0] - box["x"]) * s))
    (px, py), (qx, qy) = local(p), local(q)
    mx, my, dx, dy = (px + qx) / 2, (py + qy) / 2, (qx - px) / 2, (qy - py) / 2
    hx, hy = box["l"] / 2, box["w"] / 2
    apart = (F.abs(mx) > hx + F.abs(dx)) | (F.abs(my) > hy + F.abs(dy)) | (F.abs(dx * my - dy * mx) > hx * F.abs(dy) + hy * F.abs(dx))
    return ~apart


def _fields(prefix: str, names: Sequence[str] = ("x", "y", "l", "w", "yaw")) -> dict[str, Column]:
    return {n: F.col(prefix + n) for n in names}


def _ego(ego: DataFrame) -> DataFrame:
    return ego.select(*FRAME, *[F.col(c).alias(f"ego_{c}") for c in ("x", "y", "l", "w", "yaw", "vx", "vy")])


def collision(ego: DataFrame, boxes: DataFrame, exact: bool = False) -> DataFrame:
    """0 when any box of the frame meets the ego box, else 1; frames without boxes score 1."""
    meets = (rectangles_meet if exact else envelopes_meet)(_fields("ego_"), _fields(""))
    hits = boxes.join(_ego(ego), list(FRAME)).filter(meets).select(*FRAME).distinct().withColumn("_hit", F.lit(True))
    return ego.select(*FRAME).join(hits, list(FRAME), "left").select(*FRAME, F.when(F.col("_hit"), 0.0).otherwise(1.0).alias("collision"))


def overspeed(vx: Column, limit: Column, limit_type: Column) -> Column:
    """1 up to the limit in km/h, 0 above; null without a limit or for limit type 7."""
    absent = limit.isNull() | F.coalesce(limit_type == 7, F.lit(False))
    return F.when(~absent, F.when(vx * 3.6 <= limit, 1.0).otherwise(0.0))


def _line_hit(points: Column, types: Column | None, box: dict[str, Column]) -> Column:
    """Any segment of the line meets the box; with ``types`` only segments whose both ends have type 1 count."""
    def one(i: Column) -> Column:
        hit = segment_meets_box(F.get(points, i), F.get(points, i + 1), box)
        return hit if types is None else hit & (F.get(types, i) == 1) & (F.get(types, i + 1) == 1)

    return F.when(F.size(points) >= 2, F.exists(F.sequence(F.lit(0), F.size(points) - 2), one)).otherwise(False)


def _line_score(ego: DataFrame, lines: DataFrame, typed: bool, name: str, default: float | None) -> DataFrame:
    box = _fields("ego_")
    hit = _line_hit(F.col("points"), F.col("types") if typed else None, box)
    worst = lines.join(_ego(ego), list(FRAME)).groupBy(*FRAME).agg(F.max(hit).alias("_hit"))
    score = F.when(F.col("_hit"), 0.0).when(~F.col("_hit"), 1.0).otherwise(F.lit(default).cast("double"))
    return ego.select(*FRAME).join(worst, list(FRAME), "left").select(*FRAME, score.alias(name))


def solid_line(ego: DataFrame, dividers: DataFrame) -> DataFrame:
    """0 when a run of solid divider points crosses the ego box; null for frames without dividers."""
    return _line_score(ego, dividers, True, "solid_line", None)


def drivable_area(ego: DataFrame, boundaries: DataFrame) -> DataFrame:
    """0 when a boundary line crosses the ego box, else 1."""
    return _line_score(ego, boundaries, False, "drivable_area", 1.0)


def future_boxes(boxes: DataFrame, steps: DataFrame) -> DataFrame:
    """Future positions of the current boxes at 0.1 .. 1.0 s: last valid step of each time, size of the current box.

    A heading that turns by more than 10 degrees from the one before is replaced by it. ``steps`` has scene, frame,
    box_id, seq, relative_time, valid, x, y, yaw. At most ten steps per box are gathered.
    """
    key = [*FRAME, "box_id"]
    slot = F.rint(F.col("relative_time") * 10).cast("int")
    usable = steps.filter(F.col("valid")).withColumn("step", slot).filter(F.col("step").between(1, 10))
    last = usable.groupBy(*key, "step").agg(F.max_by(F.struct("relative_time", "x", "y", "yaw"), "seq").alias("s"))
    # boxes and tracks meet in one grouping: tables dealt by frame stay as they are, which a join on the box would not allow
    current = boxes.select(*key, F.struct("l", "w", F.col("yaw").alias("yaw0")).alias("box"))
    both = last.select(*key, F.struct("step", "s").alias("place")).unionByName(current, allowMissingColumns=True)
    met = both.na.drop(subset=key).groupBy(*key).agg(F.sort_array(F.collect_list("place")).alias("track"), F.collect_list("box").alias("boxes"))
    joined = met.filter(F.size("track") > 0).select(*key, "track", F.explode("boxes").alias("box")).select(*key, "track", "box.*")

    def fold(acc: Column, item: Column) -> Column:
        turn = item["s"]["yaw"] - acc["yaw"] + math.pi
        turn = F.abs(turn - 2 * math.pi * F.floor(turn / (2 * math.pi)) - math.pi)
        yaw = F.when(turn <= math.radians(10), item["s"]["yaw"]).otherwise(acc["yaw"])
        return F.struct(yaw.alias("yaw"), F.concat(acc["out"], F.array(yaw)).alias("out"))

    start = F.struct(F.col("yaw0").alias("yaw"), F.array().cast("array<double>").alias("out"))
    kept = joined.withColumn("yaws", F.aggregate("track", start, fold, lambda acc: acc["out"]))
    flat = kept.select(*FRAME, "box_id", "l", "w", F.posexplode("track").alias("_i", "t"), "yaws")
    return flat.select(*FRAME, "box_id", F.col("t.step").alias("step"), F.col("t.s.relative_time").alias("relative_time"),
                       F.col("t.s.x").alias("x"), F.col("t.s.y").alias("y"), "l", "w", F.get("yaws", F.col("_i")).alias("yaw"))


def time_to_collision(ego: DataFrame, future: DataFrame) -> DataFrame:
    """0 when the ego box moved at constant speed meets a future box envelope at any step, else 1."""
    moved = dict(_fields("ego_"))
    moved["x"] = F.col("ego_x") + F.col("ego_vx") * F.col("relative_time")
    moved["y"] = F.col("ego_y") + F.col("ego_vy") * F.col("relative_time")
    hits = future.join(_ego(ego), list(FRAME)).filter(envelopes_meet(moved, _fields(""))).select(*FRAME).distinct().withColumn("_hit", F.lit(True))
    return ego.select(*FRAME).join(hits, list(FRAME), "left").select(*FRAME, F.when(F.col("_hit"), 0.0).otherwise(1.0).alias("ttc"))


def project_on_line(line: Column, px: Column, py: Column) -> Column:
    """Distance along a polyline of its point nearest to (px, py); the first of equally near ones."""
    def segment(i: Column) -> Column:
        ends = F.struct(F.get(line, i).alias("a"), F.get(line, i + 1).alias("b"))
        sides = let(ends, lambda e: F.struct(e["a"][0].alias("x"), e["a"][1].alias("y"), (e["b"][0] - e["a"][0]).alias("dx"), (e["b"][1] - e["a"][1]).alias("dy")))
        return let(sides, lambda g: F.struct(g["x"].alias("x"), g["y"].alias("y"), g["dx"].alias("dx"), g["dy"].alias("dy"), F.sqrt(g["dx"] * g["dx"] + g["dy"] * g["dy"]).alias("n")))

    def nearest(g: Column) -> Column:
        along = F.when(g["n"] > 0, ((px - g["x"]) * g["dx"] + (py - g["y"]) * g["dy"]) / g["n"]).otherwise(0.0)
        return F.struct(g.alias("g"), F.least(F.greatest(along, F.lit(0.0)), g["n"]).alias("along"))

    def priced(s: Column) -> Column:
        g, share = s["g"], F.when(s["g"]["n"] > 0, s["along"] / s["g"]["n"]).otherwise(0.0)
        gap = let(share, lambda k: F.pow(px - g["x"] - g["dx"] * k, F.lit(2.0)) + F.pow(py - g["y"] - g["dy"] * k, F.lit(2.0)))
        return F.struct(g["n"].alias("n"), s["along"].alias("along"), gap.alias("gap"))

    def step(acc: Column, i: Column) -> Column:
        # bound values: interpreted lambdas would compute every repeated part again
        return let(let(let(segment(i), nearest), priced), lambda p: F.struct(
            (acc["done"] + p["n"]).alias("done"), F.least(p["gap"], acc["gap"]).alias("gap"),
            F.when(p["gap"] < acc["gap"], acc["done"] + p["along"]).otherwise(acc["at"]).alias("at")))

    start = F.struct(F.lit(0.0).alias("done"), F.lit(float("inf")).alias("gap"), F.lit(0.0).alias("at"))
    return F.aggregate(F.sequence(F.lit(0), F.size(line) - 2), start, step, lambda acc: acc["at"])


def progress(route: Column, ego_path: Column) -> Column:
    """Way made along the route between the first and last ego point, to 0.1; null for short lines or a step back."""
    first, last = F.element_at(ego_path, 1), F.element_at(ego_path, -1)
    way = project_on_line(route, last[0], last[1]) - project_on_line(route, first[0], first[1])
    return F.when((F.size(route) >= 2) & (F.size(ego_path) >= 2), let(way, lambda w: F.when(w >= 0, F.round(w, 1))))


def full_score(*scores: Column) -> Column:
    """Product of the scores that exist."""
    out = F.lit(1.0)
    for s in scores:
        out = out * F.coalesce(s, F.lit(1.0))
    return out
