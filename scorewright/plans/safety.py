"""Frame safety queries (L): orders are ego states, their line items are boxes, map lines and future steps."""


from pyspark.sql import functions as F

from scorewright.operators import safety as L
from scorewright.operators.skew import dealt, tasks_for
from scorewright.plans.catalog import query

c = F.col

# one frame per order; one box per part of an order (the smallest line of equal parts)
EGO = "SELECT o_custkey AS scene, o_orderkey AS frame, o_totalprice / 50000 AS x, o_orderkey % 7 * 1e0 AS y, 4.5e0 AS l, 2e0 AS w, 0e0 AS yaw, o_custkey % 20 * 1e0 AS vx, o_orderkey % 3 - 1e0 AS vy FROM {orders}"
BOXES = """SELECT scene, frame, l_partkey AS box_id, min(l_quantity) / 2 - 5 AS x, min(l_discount) * 100 AS y, 2e0 + min(l_suppkey) % 3 AS l, 1e0 + min(l_suppkey) % 2 AS w, min(l_tax) * 20 AS yaw
 FROM (SELECT o_custkey AS scene, o_orderkey AS frame, l_partkey, l_quantity, l_discount, l_suppkey, l_tax FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey) GROUP BY scene, frame, l_partkey"""


def _ego(t):
    return t.spark.sql(EGO, orders=t.orders)


def _boxes(t, by_frame=True):
    # dealt by order, then (``by_frame``) as the joins with the ego ask for it, before anything is multiplied
    tasks = tasks_for(t.lineitem)
    boxes = t.spark.sql(BOXES, orders=dealt(t.orders, ["o_orderkey"], tasks), lineitem=dealt(t.lineitem, ["l_orderkey"], tasks))
    return dealt(boxes, ["scene", "frame"], tasks if by_frame else None)


WITH = f"WITH ego AS ({EGO.format(orders='orders')}), box AS ({BOXES.format(orders='orders', lineitem='lineitem')})"
_EXT = lambda l, w, yaw: (f"({l} / 2 * abs(cos({yaw})) + {w} / 2 * abs(sin({yaw})))", f"({l} / 2 * abs(sin({yaw})) + {w} / 2 * abs(cos({yaw})))")


def _meet(ex, ey, bx, by, b="b"):
    hx, hy = _EXT(f"{b}.l", f"{b}.w", f"{b}.yaw")
    return f"abs({ex} - {bx}) <= e.l / 2 + {hx} AND abs({ey} - {by}) <= e.w / 2 + {hy}"


@query("l01_box_corners", f"{WITH} SELECT scene, frame, box_id, x + l / 2 * cos(yaw) - w / 2 * sin(yaw) AS x0, y + l / 2 * sin(yaw) + w / 2 * cos(yaw) AS y0, x - l / 2 * cos(yaw) + w / 2 * sin(yaw) AS x2, y - l / 2 * sin(yaw) - w / 2 * cos(yaw) AS y2 FROM box", "x0 y0 x2 y2")
def box_corners(t):
    b = _boxes(t, by_frame=False).withColumn("k", L.box_corners(*[c(n) for n in ("x", "y", "l", "w", "yaw")]))
    return b.select("scene", "frame", "box_id", *[F.get(F.get("k", F.lit(i)), F.lit(j)).alias(f"{n}{i}") for i in (0, 2) for j, n in enumerate("xy")])


@query("l02_collision", f"{WITH} SELECT e.scene, e.frame, CASE WHEN EXISTS (SELECT 1 FROM box b WHERE b.scene = e.scene AND b.frame = e.frame AND {_meet('e.x', 'e.y', 'b.x', 'b.y')}) THEN 0 ELSE 1 END AS collision FROM ego e", "collision")
def collision(t):
    return L.collision(_ego(t), _boxes(t))


# exact overlap of the axis-parallel ego box and a turned box: separating directions of both
_SAT = f"""{_meet('e.x', 'e.y', 'b.x', 'b.y')} AND abs((b.x - e.x) * cos(b.yaw) + (b.y - e.y) * sin(b.yaw)) <= b.l / 2 + e.l / 2 * abs(cos(b.yaw)) + e.w / 2 * abs(sin(b.yaw))
 AND abs((b.y - e.y) * cos(b.yaw) - (b.x - e.x) * sin(b.yaw)) <= b.w / 2 + e.l / 2 * abs(sin(b.yaw)) + e.w / 2 * abs(cos(b.yaw))"""


@query("l02_collision_exact", f"{WITH} SELECT e.scene, e.frame, CASE WHEN EXISTS (SELECT 1 FROM box b WHERE b.scene = e.scene AND b.frame = e.frame AND {_SAT}) THEN 0 ELSE 1 END AS collision FROM ego e", "collision")
def collision_exact(t):
    return L.collision(_ego(t), _boxes(t), exact=True)


@query("l03_overspeed", f"{WITH} SELECT scene, frame, CASE WHEN frame % 5 = 0 OR scene % 9 = 7 THEN NULL WHEN vx * 3.6 <= scene % 60 THEN 1.0 ELSE 0.0 END AS overspeed FROM ego", "overspeed")
def overspeed(t):
    limit = F.when(c("frame") % 5 != 0, (c("scene") % 60).cast("double"))
    return _ego(t).select("scene", "frame", L.overspeed(c("vx"), limit, c("scene") % 9).alias("overspeed"))


# a line of three points per box, typed 1 1 2 or 1 2 1
def _lines(t):
    point = lambda i: F.array(c("x") + i * 2.0, c("y") - i)
    types = F.when(c("box_id") % 2 == 0, F.array(F.lit(1), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(1)))
    return _boxes(t).select("scene", "frame", F.array(point(0), point(1), point(2)).alias("points"), types.alias("types"))


def _cross(i):
    px, py, qx, qy = f"(b.x + {2 * i} - e.x)", f"(b.y - {i} - e.y)", f"(b.x + {2 * i + 2} - e.x)", f"(b.y - {i + 1} - e.y)"
    mx, my, dx, dy = f"(({px} + {qx}) / 2)", f"(({py} + {qy}) / 2)", f"(({qx} - {px}) / 2)", f"(({qy} - {py}) / 2)"
    return f"(abs({mx}) <= e.l / 2 + abs({dx}) AND abs({my}) <= e.w / 2 + abs({dy}) AND abs({dx} * {my} - {dy} * {mx}) <= e.l / 2 * abs({dy}) + e.w / 2 * abs({dx}))"


@query("l04_solid_line", f"{WITH} SELECT e.scene, e.frame, CASE WHEN count(b.box_id) = 0 THEN NULL WHEN bool_or(b.box_id % 2 = 0 AND {_cross(0)}) THEN 0.0 ELSE 1.0 END AS solid_line FROM ego e LEFT JOIN box b USING (scene, frame) GROUP BY e.scene, e.frame", "solid_line")
def solid_line(t):
    return L.solid_line(_ego(t), _lines(t))


@query("l05_drivable_area", f"{WITH} SELECT e.scene, e.frame, CASE WHEN bool_or({_cross(0)} OR {_cross(1)}) THEN 0.0 ELSE 1.0 END AS drivable_area FROM ego e LEFT JOIN box b USING (scene, frame) GROUP BY e.scene, e.frame", "drivable_area")
def drivable_area(t):
    return L.drivable_area(_ego(t), _lines(t).drop("types"))


# three steps per box at 0.1, 0.2 and 0.3 s; the second one turns by half a radian for odd boxes, the third is invalid for some
def _steps(t):
    s = _boxes(t).select("scene", "frame", "box_id", "x", "y", c("yaw").alias("yaw0"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq"))
    turn = F.when((c("seq") == 2) & (c("box_id") % 2 == 1), 0.5).otherwise(c("seq") * 0.05)
    return s.select("scene", "frame", "box_id", "seq", (c("seq") / 10.0).alias("relative_time"), ((c("seq") < 3) | (c("box_id") % 3 > 0)).alias("valid"), (c("x") - c("seq") * 1.5).alias("x"), "y", (c("yaw0") + turn).alias("yaw"))


# kept heading: +.05; then odd boxes keep +.05 after the wide turn, others +.1; the third step is +.15 (within 10 degrees of both)
STEP = """, st AS (SELECT scene, frame, box_id, s AS step, s / 10.0 AS relative_time, x - s * 1.5 AS x, y, l, w, yaw + CASE s WHEN 1 THEN 0.05 WHEN 2 THEN CASE WHEN box_id % 2 = 1 THEN 0.05 ELSE 0.1 END ELSE 0.15 END AS yaw FROM box, (SELECT unnest([1, 2, 3]) AS s) WHERE s < 3 OR box_id % 3 > 0)"""


@query("l06_future_boxes", f"{WITH}{STEP} SELECT * FROM st", "relative_time x y l w yaw", "step")
def future_boxes(t):
    return L.future_boxes(_boxes(t), _steps(t))


@query("l07_time_to_collision", f"{WITH}{STEP} SELECT e.scene, e.frame, CASE WHEN EXISTS (SELECT 1 FROM st b WHERE b.scene = e.scene AND b.frame = e.frame AND {_meet('e.x + e.vx * b.relative_time', 'e.y + e.vy * b.relative_time', 'b.x', 'b.y')}) THEN 0 ELSE 1 END AS ttc FROM ego e", "ttc")
def time_to_collision(t):
    return L.time_to_collision(_ego(t), L.future_boxes(_boxes(t), _steps(t)))


# an L-shaped route (0, 0) (10, 0) (10, 10); the ego drives from (x, 1) to (11, y)
@query("l08_progress", f"{WITH}, p AS (SELECT scene, frame, least(greatest(x, 0), 10) AS a, 10 + least(greatest(y, 0), 10) AS b, sqrt(pow(x - least(greatest(x, 0), 10), 2) + 1) AS da, sqrt(pow(x - 10, 2) + pow(1 - least(greatest(1, 0), 10), 2)) AS db FROM ego) SELECT scene, frame, round(b - CASE WHEN db < da THEN 11 ELSE a END, 1) AS progress FROM p WHERE b - CASE WHEN db < da THEN 11 ELSE a END >= 0 UNION ALL SELECT scene, frame, NULL FROM p WHERE b - CASE WHEN db < da THEN 11 ELSE a END < 0", "progress")
def progress(t):
    route = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ((0, 0), (10, 0), (10, 10))])
    path = F.array(F.array(c("x"), F.lit(1.0)), F.array(F.lit(11.0), c("y")))
    return _ego(t).select("scene", "frame", L.progress(route, path).alias("progress"))


@query("l09_full_score", f"""{WITH}{STEP}, a AS (SELECT e.scene, e.frame, CASE WHEN EXISTS (SELECT 1 FROM box b WHERE b.scene = e.scene AND b.frame = e.frame AND {_meet('e.x', 'e.y', 'b.x', 'b.y')}) THEN 0 ELSE 1 END AS c1,
 CASE WHEN EXISTS (SELECT 1 FROM st b WHERE b.scene = e.scene AND b.frame = e.frame AND {_meet('e.x + e.vx * b.relative_time', 'e.y + e.vy * b.relative_time', 'b.x', 'b.y')}) THEN 0 ELSE 1 END AS c2, CASE WHEN e.frame % 5 = 0 OR e.scene % 9 = 7 THEN 1 WHEN e.vx * 3.6 <= e.scene % 60 THEN 1 ELSE 0 END AS c3 FROM ego e),
 s AS (SELECT e.scene, e.frame, CASE WHEN count(b.box_id) = 0 THEN 1 WHEN bool_or(b.box_id % 2 = 0 AND {_cross(0)}) THEN 0 ELSE 1 END AS c4, CASE WHEN bool_or({_cross(0)} OR {_cross(1)}) THEN 0 ELSE 1 END AS c5 FROM ego e LEFT JOIN box b USING (scene, frame) GROUP BY e.scene, e.frame)
 SELECT scene, frame, c1 * c2 * c3 * c4 * c5 AS "full" FROM a JOIN s USING (scene, frame)""", "full")
def full_score(t):
    ego, boxes, lines, keys = _ego(t), _boxes(t), _lines(t), ["scene", "frame"]
    limit = F.when(c("frame") % 5 != 0, (c("scene") % 60).cast("double"))
    speed = ego.select(*keys, L.overspeed(c("vx"), limit, c("scene") % 9).alias("overspeed"))
    all_scores = (L.collision(ego, boxes).join(L.time_to_collision(ego, L.future_boxes(boxes, _steps(t))), keys).join(speed, keys)
                  .join(L.solid_line(ego, lines), keys).join(L.drivable_area(ego, lines.drop("types")), keys))
    return all_scores.select(*keys, L.full_score(*[c(n) for n in ("collision", "ttc", "overspeed", "solid_line", "drivable_area")]).alias("full"))
