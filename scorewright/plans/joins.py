"""Join queries (H)."""

from pyspark.sql import functions as F

from scorewright.operators import boxes, intervals, joins
from scorewright.operators.skew import salted_join, tasks_for
from scorewright.plans.catalog import over, query
from scorewright.plans.score import _spans
from scorewright.plans.text import unit_sql

c = F.col
EPOCH = "epoch_us(ts) / 1e6 - 1704067200"


@query("h01_inner_equi", "SELECT o_orderkey, l_linenumber, l_partkey, l_quantity, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey", ints="l_linenumber")
def inner_equi(t):
    lines = t.lineitem.select(c("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    return lines.join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")


@query("h02_left_equi", "SELECT o_orderkey, o_custkey AS c_custkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey")
def left_equi(t):
    orders = t.orders.select("o_orderkey", c("o_custkey").alias("c_custkey"))
    return joins.lookup(orders, t.customer.filter("c_custkey % 3 > 0").select("c_custkey", "c_name"), ["c_custkey"]).select("o_orderkey", "c_custkey", "c_name")


@query("h03_left_semi", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def left_semi(t):
    big = t.lineitem.filter("l_quantity > 45").select(c("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey", "o_totalprice").join(big, "o_orderkey", "left_semi")


@query("h04_left_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def left_anti(t):
    done = t.orders.filter("o_totalprice > 300000").select(c("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(done, "c_custkey", "left_anti")


@query("h05_multi_way_inner", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def multi_way_inner(t):
    nations = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey"))
    return t.customer.join(nations, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("h06_one_of_many", f"SELECT o_orderkey, l_partkey, l_suppkey FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {unit_sql('l_orderkey', 'l_partkey')}, l_partkey, l_suppkey) = 1) ON o_orderkey = l_orderkey")
def one_of_many(t):
    choices = t.lineitem.select(c("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    return joins.one_of_many(t.orders.select("o_orderkey"), choices, "o_orderkey", "l_partkey")


@query("h07_first_match_lookup", """WITH f AS (SELECT l_orderkey AS k, min(l_suppkey) AS root FROM lineitem GROUP BY ALL) SELECT o_orderkey AS k, root, 'found' AS status FROM orders JOIN f ON o_orderkey = k
 UNION ALL SELECT o_orderkey, NULL, 'missing' FROM orders WHERE o_orderkey NOT IN (SELECT k FROM f)""", ints="root")
def first_match_lookup(t):
    found, missing = joins.first_match(t.orders.select(c("o_orderkey").alias("k")), t.lineitem.select(c("l_orderkey").alias("k"), c("l_suppkey").alias("root")), "k", "root", tasks_for(t.orders, t.lineitem))
    return found.select("k", "root", F.lit("found").alias("status")).unionByName(missing.select("k", F.lit(None).cast("bigint").alias("root"), F.lit("missing").alias("status")))


@query("h08_in_key_theta", f"""WITH d AS (SELECT user_id, event_id, event_type, {EPOCH} AS s, {EPOCH} + value * 20 AS e FROM events)
 SELECT a.user_id, a.event_id AS l_event_id, b.event_id AS r_event_id FROM d a JOIN d b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND a.s <= b.e AND b.s <= a.e""")
def in_key_theta(t):
    d = t.events.select("user_id", "event_id", "event_type", (F.unix_micros(c("ts").cast("timestamp")) / 1e6 - 1704067200).alias("start"), "value").withColumn("end", c("start") + c("value") * 20).drop("value")
    side = lambda kind: d.filter(c("event_type") == kind).drop("event_type")
    return intervals.overlap_join(side("click"), side("view"), "user_id", 7200.0).select("user_id", "l_event_id", "r_event_id")


# boxes of a supplier's lines; one in 300 covers a large part of the frame
BOXES = """l_suppkey AS frame, l_orderkey, l_linenumber, CAST(l_extendedprice / 100 AS DOUBLE) AS x1, CAST(l_partkey % 997 AS DOUBLE) AS y1,
 CAST(l_extendedprice / 100 AS DOUBLE) + CASE WHEN l_orderkey % 300 = 0 THEN 500.0 ELSE CAST(l_quantity / 4 AS DOUBLE) END AS x2, CAST(l_partkey % 997 AS DOUBLE) + CASE WHEN l_orderkey % 300 = 0 THEN 400.0 ELSE CAST(1 + l_linenumber AS DOUBLE) END AS y2"""
_SHARED = "(least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"


@query("h08_box_overlap", over("lineitem", BOXES, f"""SELECT a.frame, a.l_orderkey, a.l_linenumber, count(*) AS partners, max({_SHARED} / ({_AREA.format("a")} + {_AREA.format("b")} - {_SHARED})) AS best FROM d a JOIN d b
 ON a.frame = b.frame AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2 AND (a.l_orderkey, a.l_linenumber) <> (b.l_orderkey, b.l_linenumber) GROUP BY ALL"""), "best", "partners", 11)
def box_overlap(t):
    d = t.derive("lineitem", BOXES)
    pairs = boxes.box_pairs(d, d, "frame", 64.0).where((c("l_l_orderkey") != c("r_l_orderkey")) | (c("l_l_linenumber") != c("r_l_linenumber")))
    return pairs.groupBy("frame", c("l_l_orderkey").alias("l_orderkey"), c("l_l_linenumber").alias("l_linenumber")).agg(F.count(F.lit(1)).alias("partners"), F.max(boxes.box_iou()).alias("best"))


# whole coordinates, so that both engines find the same turns; roads of one kind against roads of the other
SEGMENTS = """l_suppkey AS frame, l_orderkey, l_linenumber, l_linenumber % 2 AS kind, l_partkey * 7 % 1009 AS ax, l_orderkey % 1013 AS ay,
 l_partkey * 7 % 1009 + l_linenumber * 9 - 30 AS bx, l_orderkey % 1013 + l_partkey % 61 - 30 AS by"""
_TURN = "sign(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"
_turn = lambda p, q, r: _TURN.format(p=p, q=q, r=r)


@query("h08_segment_crossing", over("lineitem", SEGMENTS, f"""SELECT l.l_orderkey AS left_order, l.l_linenumber AS left_line, r.l_orderkey AS right_order, r.l_linenumber AS right_line FROM d l JOIN d r ON l.frame = r.frame AND l.kind = 0 AND r.kind = 1
 AND greatest(least(l.ax, l.bx), least(r.ax, r.bx)) <= least(greatest(l.ax, l.bx), greatest(r.ax, r.bx)) AND greatest(least(l.ay, l.by), least(r.ay, r.by)) <= least(greatest(l.ay, l.by), greatest(r.ay, r.by))
 AND {_turn("l.a", "l.b", "r.a")} * {_turn("l.a", "l.b", "r.b")} <= 0 AND {_turn("r.a", "r.b", "l.a")} * {_turn("r.a", "r.b", "l.b")} <= 0"""))
def segment_crossing(t):
    d = t.derive("lineitem", SEGMENTS)
    pairs = boxes.segment_crossings(d.where("kind = 0"), d.where("kind = 1"), "frame", 32.0)
    return pairs.select(c("l_l_orderkey").alias("left_order"), c("l_l_linenumber").alias("left_line"), c("r_l_orderkey").alias("right_order"), c("r_l_linenumber").alias("right_line"))


@query("h09_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value FROM (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (k)", ints="left_value right_value")
def full_outer(t):
    side = lambda s, n: t.orders.filter(c("o_orderstatus") == s).groupBy(c("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(n))
    return side("F", "left_value").join(side("O", "right_value"), "k", "full")


@query("h10_cross_completeness", "SELECT s AS segment, n AS nation FROM (SELECT DISTINCT c_mktsegment AS s FROM customer), (SELECT DISTINCT c_nationkey AS n FROM customer) EXCEPT SELECT c_mktsegment, c_nationkey FROM customer WHERE c_acctbal > 8000")
def cross_completeness(t):
    named = t.customer.select(c("c_mktsegment").alias("segment"), c("c_nationkey").alias("nation"), "c_acctbal")
    return joins.missing_pairs(named, "segment", named, "nation", named.filter("c_acctbal > 8000"))


@query("h11_broadcast_map", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'UR' WHEN '5-LOW' THEN 'LO' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def broadcast_map(t):
    return joins.map_labels(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", {"1-URGENT": "UR", "5-LOW": "LO"})


@query("h11_salted_lookup", "SELECT l_suppkey, s_name, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL", "quantity", "n")
def salted_lookup(t):
    joined = salted_join(t.lineitem.select("l_suppkey", "l_quantity"), t.supplier.select(c("s_suppkey").alias("l_suppkey"), "s_name"), ["l_suppkey"], "left")
    return joined.groupBy("l_suppkey", "s_name").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("h12_alias_by_time", f"""WITH d AS (SELECT user_id, event_id, event_type, {EPOCH} AS s, value FROM events), f AS (SELECT user_id, s AS mid, 0 AS kind, 'frame' || event_id AS content FROM d WHERE event_type <> 'click'),
 b AS (SELECT user_id, s, s + value * 60 AS e, 'sub' || event_id AS content FROM d WHERE event_type = 'click'), w AS (SELECT user_id, content, CASE WHEN e - s < 1 THEN (s + e) / 2 - 0.5 ELSE s END AS s, CASE WHEN e - s < 1 THEN (s + e) / 2 + 0.5 ELSE e END AS e FROM b),
 k AS (SELECT user_id, (s + e) / 2 AS mid, 1 AS kind, content FROM w WHERE EXISTS (SELECT 1 FROM f WHERE f.user_id = w.user_id AND f.mid > w.s AND f.mid < w.e)), u AS (SELECT * FROM f UNION ALL SELECT * FROM k)
 SELECT user_id, kind, content, row_number() OVER (PARTITION BY user_id ORDER BY mid, kind, content) - 1 AS pos FROM u""", ints="kind pos")
def alias_by_time(t):
    d = _spans(t).join(t.events.select("event_id", "event_type"), "event_id").withColumnRenamed("qid", "user_id")
    frames = d.filter("event_type <> 'click'").select("user_id", c("s").alias("t"), F.concat(F.lit("frame"), c("event_id").cast("string")).alias("content"))
    subs = d.filter("event_type = 'click'").select("user_id", c("s").alias("start"), (c("s") + c("value") * 60).alias("end"), F.concat(F.lit("sub"), c("event_id").cast("string")).alias("content"))
    return intervals.merge_by_time(frames, subs, "user_id", 3600.0).select("user_id", "kind", "content", "pos")
