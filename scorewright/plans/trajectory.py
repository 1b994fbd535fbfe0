"""Trajectory queries (J); events of a user in time order stand in for the frames of a scene."""

from pyspark.sql import functions as F

from scorewright.functions import trajectory as J
from scorewright.plans.catalog import over, query

c = F.col
STEP = J.GRID_STEP
_Q = lambda v: f"CAST(least(greatest(ceil(({v} + 100) / {STEP} - 0.5), 0), 666) AS INT)"
_D = lambda i: f"CAST(CAST(-100 + {i} * CAST({STEP} AS DOUBLE) AS FLOAT) AS DOUBLE)"
VALUES = "l_orderkey * 1000000000 + l_partkey AS idx, l_suppkey, l_linenumber, l_extendedprice / 500 - 110 AS v, l_quantity * 4e0 - 101 AS w"


@query("j01_quantise", over("lineitem", VALUES, f"SELECT idx, l_suppkey, l_linenumber, '<bev_' || {_Q('v')} || '>' AS token FROM d"))
def quantise(t):
    return t.derive("lineitem", VALUES).select("idx", "l_suppkey", "l_linenumber", J.quantise(c("v")).alias("token"))


TOKENS = "l_orderkey * 1000000000 + l_partkey AS idx, l_suppkey, CASE l_suppkey % 4 WHEN 0 THEN '<bev_x>' WHEN 1 THEN concat('<bev_', CAST(l_partkey % 900 AS VARCHAR(9)), '>') ELSE concat('<bev_', CAST(l_suppkey AS VARCHAR(9)), '>') END AS token"


@query("j02_dequantise", over("lineitem", TOKENS, f"SELECT idx, l_suppkey, token, CASE WHEN i BETWEEN 0 AND 666 THEN {_D('i')} END AS v FROM (SELECT *, try_cast(regexp_extract(token, '<bev_(\\d+)>', 1) AS INT) AS i FROM d)"), "v")
def dequantise(t):
    return t.derive("lineitem", TOKENS).select("idx", "l_suppkey", "token", J.dequantise(c("token")).alias("v"))


POINTS = "o_orderkey AS idx, o_totalprice / 5000 - 50 AS x, o_custkey / 20e0 - 30 AS y, o_orderkey % 5 AS k"


def _path(x, y, n):
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array(x + i * 1.5, y - i * 0.7))


@query("j03_trajectory_tokens", over("orders", POINTS, f"SELECT idx, array_to_string(flatten(list_transform(range(1, 5 + k), lambda i: ['<bev_' || {_Q('(x + i * CAST(1.5 AS DOUBLE))')} || '>', '<bev_' || {_Q('(y - i * CAST(0.7 AS DOUBLE))')} || '>'])), '') AS tokens FROM d"))
def trajectory_tokens(t):
    path = _path(c("x"), c("y"), c("k").cast("int") + 4)
    return t.derive("orders", POINTS).select("idx", F.array_join(J.trajectory_tokens(path), "").alias("tokens"))


MIXED = "o_orderkey AS idx, o_custkey % 667 AS a, o_custkey % 700 AS b, o_orderkey % 667 AS e"


@query("j04_decode_trajectory", over("orders", MIXED, f"SELECT idx, 1 + CASE WHEN b < 667 THEN 1 ELSE 0 END AS n, {_D('a')} AS x, CASE WHEN b < 667 THEN {_D('b')} ELSE {_D('e')} END AS y FROM d"), "x y", "n")
def decode_trajectory(t):
    tok = lambda v: F.concat(F.lit("<bev_"), v.cast("string"), F.lit(">"))
    path = J.decode_trajectory(F.array(tok(c("a")), F.lit("junk"), tok(c("b")), tok(c("e")), F.lit("<bev_1>")))
    return t.derive("orders", MIXED).select("idx", path.alias("p")).select("idx", F.size("p").alias("n"), F.element_at("p", 1)[0].alias("x"), F.element_at("p", 1)[1].alias("y"))


ERR = "o_orderkey AS idx, o_totalprice / 5000 - 50 AS x, o_custkey / 20e0 - 30 AS y, o_orderkey % 5 AS k, o_custkey % 6 AS m"
_ERRS = "list_transform(range(1, CAST(least(k, m) AS BIGINT) + 1), lambda i: sqrt(pow(i * CAST(1.5 AS DOUBLE), 2) + pow(-i * CAST(0.7 AS DOUBLE) + 1, 2)))"


def _errors(t):
    df = t.derive("orders", ERR)
    n = lambda v: F.when(v > 0, F.sequence(F.lit(1), v.cast("int"))).otherwise(F.array().cast("array<int>"))
    pred = F.transform(n(c("k")), lambda i: F.array(c("x") + i * 1.5, c("y") - i * 0.7))
    gold = F.transform(n(c("m")), lambda i: F.array(c("x"), c("y") - 1))
    return df.select("idx", pred.alias("pred"), gold.alias("gold"))


@query("j05_ade_fde", over("orders", ERR, f", e AS (SELECT idx, {_ERRS} AS e FROM d) SELECT idx, CASE WHEN len(e) > 0 THEN list_avg(e) END AS ade, CASE WHEN len(e) > 0 THEN e[-1] END AS fde FROM e"), "ade fde")
def ade_fde(t):
    e = J.displacement(c("pred"), c("gold"))
    return _errors(t).select("idx", e["ade"].alias("ade"), e["fde"].alias("fde"))


@query("j06_mean_ade_fde", over("orders", ERR, f", e AS (SELECT idx, {_ERRS} AS e FROM d) SELECT avg(CASE WHEN len(e) > 0 THEN list_avg(e) END) AS mean_ade, avg(CASE WHEN len(e) > 0 THEN e[-1] END) AS mean_fde, count(*) FILTER (len(e) > 0) AS valid, count(*) AS total FROM e"), "mean_ade mean_fde", "valid total")
def mean_ade_fde(t):
    return J.mean_ade_fde(_errors(t), "pred", "gold")


STATUS = "event_id AS idx, user_id % 2 AS c0, user_id % 3 AS c1, user_id % 5 AS c2, value / 10 AS vx, value / 100 AS ay, event_id % 10 = 0 AS short"


@query("j07_split_status", over("events", STATUS, "SELECT idx, CASE WHEN NOT short THEN vx END AS vx, CASE WHEN NOT short THEN ay END AS ay, CASE WHEN NOT short THEN CASE WHEN c0 >= c1 AND c0 >= c2 THEN 'go left' WHEN c1 >= c2 THEN 'go straight' ELSE 'go right' END END AS command FROM d"), "vx ay")
def split_status(t):
    status = F.array(c("c0"), c("c1"), c("c2"), F.lit(0), c("vx"), F.lit(0.5), F.lit(0.1), c("ay"))
    df = t.derive("events", STATUS).withColumn("status", F.when(c("short"), F.slice(status, 1, 7)).otherwise(status)).withColumn("s", J.split_status(c("status")))
    return df.select("idx", F.get("s.velocity", F.lit(0)).alias("vx"), F.get("s.acceleration", F.lit(1)).alias("ay"), J.command_text(c("s.command")).alias("command"))


@query("j08_scene_window", """WITH o AS (SELECT *, row_number() OVER w - 1 AS start, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 j AS (SELECT a.user_id, a.start, b.start - a.start AS k, b.event_id, b.value FROM o a JOIN o b ON a.user_id = b.user_id AND b.start BETWEEN a.start AND a.start + 11 WHERE a.start + 11 < a.n)
 SELECT user_id, start, string_agg(event_id, ',' ORDER BY k) FILTER (k < 4) AS history, sum(value) FILTER (k >= 4) AS future_sum, max(event_id) FILTER (k = 4) AS target FROM j GROUP BY user_id, start""", "future_sum", "start target")
def scene_window(t):
    steps = J.target_steps(0.5, 0.5)
    out = J.scene_window(t.events.select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"], {"event_id": c("event_id"), "value": c("value")}, history=4, future=8, target=steps)
    return out.select("user_id", "start", F.array_join(F.transform("history_event_id", lambda x: x.cast("string")), ",").alias("history"),
                      F.aggregate("future_value", F.lit(0.0), lambda s, v: s + v).alias("future_sum"), c("target_event_id").alias("target"))


PROMPT = "event_id AS idx, user_id % 3 AS c1, CAST(CAST(value / 8 AS FLOAT) AS DOUBLE) AS vx, event_id % 16 / 8e0 AS vy, CAST(CAST(value / 64 AS FLOAT) AS DOUBLE) AS ax"


@query("j09_prompt_text", over("events", PROMPT, f"""SELECT idx, 'The ego vehicle history spans 4 frames. Predict the driving action and front camera view after 0.50 seconds. Current velocity: speed=' || printf('%.2f', sqrt(vx * vx + vy * vy)) || ' m/s, heading=' || printf('%.1f', degrees(atan2(vy, vx))) || ' deg. Current acceleration: ax='
 || printf('%.2f', ax) || ' m/s^2, ay=0.25 m/s^2. You plan to take the following action: ' || CASE WHEN c1 > 1 THEN 'go straight' ELSE 'go left' END || '. Recent trajectory (ego frame) tokens: <bev_' || {_Q('vx')} || '><bev_' || {_Q('vy')} || '>.' AS prompt FROM d"""))
def prompt_text(t):
    command = F.array(F.lit(1), c("c1"), F.lit(0), F.lit(0))
    text = J.prompt_text(F.lit(4), 0.5, F.array("vx", "vy"), F.array(c("ax"), F.lit(0.25)), command, F.array(F.array("vx", "vy")))
    return t.derive("events", PROMPT).select("idx", text.alias("prompt"))


@query("j10_clip_filter", "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT event_id, user_id FROM events JOIN n USING (user_id) WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) AND user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) AND n BETWEEN 60 AND 75")
def clip_filter(t):
    keep = t.customer.filter("c_nationkey < 20").select(c("c_custkey").alias("user_id"))
    drop = t.supplier.filter("s_nationkey < 5").select(c("s_suppkey").alias("user_id"))
    return J.clip_filter(t.events.select("event_id", "user_id"), "user_id", keep, drop, 60, 75)


@query("j11_inputs_targets", "SELECT event_id, user_id AS in_user, event_type AS in_type, value AS target_value FROM events")
def inputs_targets(t):
    df = J.inputs_targets(t.events, "event_id", ["user_id", "event_type"], ["value"])
    return df.select("event_id", c("inputs.user_id").alias("in_user"), c("inputs.event_type").alias("in_type"), c("targets.value").alias("target_value"))
