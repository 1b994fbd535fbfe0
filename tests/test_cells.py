"""Dyadic cells: covers, span, box and segment pairs against all pairs of small tables."""

import random
from collections import Counter

from pyspark.sql import functions as F

from scorewright.operators import boxes, cells, intervals


def test_cover_is_exact_and_short(spark):
    draw = random.Random(1)
    spans = [(a, a + draw.choice([0, 1, 2, 5, 63, 64, 700])) for a in (draw.randrange(-500, 500) for _ in range(300))] + [(5, 4), (-1024, 1023)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "i int, a long, b long")
    own, larger = {}, {}
    for r in cells.cells_of(df, F.col("a"), F.col("b"), F.lit(11)).collect():
        (larger if r.part else own).setdefault(r.i, []).append((r.level, r.no))
    for i, (a, b) in enumerate(spans):
        mine = own.get(i, [])
        held = sorted(x for k, no in mine for x in range(no << k, (no + 1) << k))
        assert held == list(range(a, b + 1)) and len(mine) <= 22
        up = {(k, no >> (k - level)) for level, no in mine for k in range(level + 1, 12)}
        assert sorted(larger.get(i, [])) == sorted(up)


def _spans(draw, n):
    rows = []
    for i in range(n):
        s = draw.choice([draw.uniform(-300, 300), float(draw.randrange(-40, 40) * 8)])
        rows.append((draw.choice("pq"), i, s, s + draw.choice([0.0, 1.0, 8.0, 31.9, 300.0, 5000.0, -3.0])))
    return rows + [("p", n, None, 5.0), ("q", n + 1, 5.0, None), (None, n + 2, 0.0, 1.0)]


def test_long_and_short_spans_meet_once(spark):
    draw = random.Random(2)
    left, right = _spans(draw, 120), _spans(draw, 130)
    frame = lambda rows: spark.createDataFrame(rows, "k string, id int, start double, end double")
    got = Counter((r.l_id, r.r_id) for r in intervals.overlap_join(frame(left), frame(right), "k", 8.0).collect())
    whole = lambda r: None not in r
    want = Counter((a[1], b[1]) for a in filter(whole, left) for b in filter(whole, right) if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3])
    assert got == want
    assert intervals.overlap_join(frame(left).where("false"), frame(right), "k", 8.0).count() == 0


def test_a_span_over_everything_adds_few_rows(spark):
    df = spark.createDataFrame([("k", 0.0, 1e9)], "k string, start double, end double")
    ends = [cells.bin_of(F.col(c), 1.0) for c in ("start", "end")]
    assert cells.cells_of(df, *ends, cells.top_level([(df, F.col("start"), F.col("end"))], 1.0)).count() < 120


def test_covered_equals_all_points(spark):
    draw = random.Random(3)
    spans = [r for r in _spans(draw, 150) if r[0]]
    points = [(draw.choice("pq"), draw.choice([draw.uniform(-300, 300), float(draw.randrange(-40, 40) * 8)])) for _ in range(40)] + [("p", None)]
    s, p = spark.createDataFrame(spans * 2, "key string, id int, start double, end double"), spark.createDataFrame(points, "key string, t double")
    got = sorted(r.id for r in intervals.covered(s, p, "key", 8.0).collect())
    want = sorted(a[1] for a in spans * 2 if None not in a and any(k == a[0] and t is not None and a[2] < t < a[3] for k, t in points))
    assert got == want


def test_boxes_and_segments_equal_all_pairs(spark):
    draw = random.Random(4)

    def some(n):
        out = []
        for i in range(n):
            x, y = draw.randrange(-60, 60) / 2, draw.randrange(-60, 60) / 2
            out.append((draw.choice("fg"), i, x, y, x + draw.choice([0, 0.5, 4, 9, 80]), y + draw.choice([0, 0.5, 4, 9, 80])))
        return out

    left, right = some(70), some(80)
    b = lambda rows: spark.createDataFrame([*rows, ("f", 999, None, 0.0, 1.0, 1.0)], "frame string, id int, x1 double, y1 double, x2 double, y2 double")
    got = Counter((r.l_id, r.r_id, r.iou) for r in boxes.box_pairs(b(left), b(right), "frame", 4.0).withColumn("iou", F.round(boxes.box_iou(), 9)).collect())
    want = Counter()
    for f, i, x1, y1, x2, y2 in left:
        for g, j, u1, v1, u2, v2 in right:
            if f == g and x1 <= u2 and u1 <= x2 and y1 <= v2 and v1 <= y2:
                both = (min(x2, u2) - max(x1, u1)) * (min(y2, v2) - max(y1, v1))
                joint = (x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - both
                want[i, j, round(both / joint, 9) if joint > 0 else 0.0] += 1
    assert got == want

    turned = lambda rows, flip: [(f, i, x1, y2 if flip and i % 2 else y1, x2, y1 if flip and i % 2 else y2) for f, i, x1, y1, x2, y2 in rows]
    one, two = turned(left, True), turned(right, False)
    seg = lambda rows: spark.createDataFrame(rows, "frame string, id int, ax double, ay double, bx double, by double")
    got = Counter((r.l_id, r.r_id) for r in boxes.segment_crossings(seg(one), seg(two), "frame", 4.0).collect())

    def cross(a, b):
        turn = lambda p, q, r: (lambda v: (v > 0) - (v < 0))((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
        p, q, r, s = a[2:4], a[4:6], b[2:4], b[4:6]
        on = lambda p, q, r: turn(p, q, r) == 0 and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
        proper = turn(p, q, r) * turn(p, q, s) < 0 and turn(r, s, p) * turn(r, s, q) < 0
        return proper or on(p, q, r) or on(p, q, s) or on(r, s, p) or on(r, s, q)

    assert got == Counter((a[1], b[1]) for a in one for b in two if a[0] == b[0] and cross(a, b))


def test_boxes_are_sent_to_few_cells(spark):
    """A few large boxes among small ones: about a cell for each size the other side has, not every level of both axes."""
    draw = random.Random(5)
    at = [(draw.uniform(0, 1000), draw.uniform(0, 1000), 400.0 if i % 300 == 0 else 6.0) for i in range(1500)]
    df = spark.createDataFrame([("f", x, y, x + n, y + n) for x, y, n in at], "frame string, x1 double, y1 double, x2 double, y2 double")
    one, two = (cells._leveled(df, side, ["frame"], boxes.BOX, [64.0, 64.0]) for side in "lr")
    assert cells._dealt(one, two, "l", 2).count() < 4 * len(at) and cells._dealt(two, one, "r", 2).count() < 4 * len(at)
    got = boxes.box_pairs(df, df, "frame", 64.0).count()
    assert got == sum(a[0] <= b[0] + b[2] and b[0] <= a[0] + a[2] and a[1] <= b[1] + b[2] and b[1] <= a[1] + a[2] for a in at for b in at)
