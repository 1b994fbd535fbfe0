"""Group-consistency queries (G)."""

from pyspark.sql import functions as F

from scorewright.operators import consistency as C
from scorewright.plans.catalog import over, query, sets_sql

CHOICE = """p_partkey AS idx, CASE WHEN p_partkey % 10 = 0 THEN 'E' WHEN p_partkey % 4 = 0 THEN 'A' WHEN p_partkey % 4 = 1 THEN 'B' ELSE 'C' END AS answer,
 p_name AS A, p_type AS B, CASE WHEN p_partkey % 17 = 0 THEN 'A or B' ELSE p_brand END AS C, CASE WHEN p_size % 2 = 0 THEN NULL ELSE concat('size ', CAST(p_size AS VARCHAR(9))) END AS D, p_size AS grp"""


@query("g01_circular_expand", over("part", CHOICE, """, b AS (SELECT *, list_filter([A, B, C, D], lambda x: x IS NOT NULL) AS t FROM d),
 f AS (SELECT *, len(t) AS k, ['A','B','C','D'][1:len(t)] AS used FROM b),
 g AS (SELECT *, (list_contains(used, answer) AND len(list_filter(t, lambda s: len(list_intersect(regexp_split_to_array(regexp_replace(s, '[^A-Za-z ]', ' ', 'g'), ' +'), used)) > 1 OR contains('ABCDEFGHIJKLMNOPQRSTUVWXYZ', s))) = 0) AS ok FROM f),
 i AS (SELECT *, unnest(range(0, CASE WHEN ok THEN k ELSE 1 END)) AS i FROM g)
 SELECT CAST(idx + i * 1000000 AS BIGINT) AS idx, CAST(idx AS BIGINT) AS g_index, CASE WHEN i = 0 THEN answer ELSE ['A','B','C','D'][(list_position(['A','B','C','D'], answer) - 1 - i + k) % k + 1] END AS answer,
 t[(0 + i) % k + 1] AS A, t[(1 + i) % k + 1] AS B, CASE WHEN k > 2 THEN t[(2 + i) % k + 1] END AS C, CASE WHEN k > 3 THEN t[(3 + i) % k + 1] END AS D, grp FROM i"""), ints="grp")
def circular_expand(t):
    return C.circular_expand(t.derive("part", CHOICE), "ABCD")


TURNS = "conv_id AS image, turn, turn - turn % 2 AS pair, role AS category, CASE WHEN length(text) % 3 = 0 THEN 0 ELSE 1 END AS score"


@query("g02_paired_product", over("conversations", TURNS, ", p AS (SELECT image, pair, product(score) AS p, count(*) AS n FROM d GROUP BY ALL) SELECT avg(p) * 100 AS paired, count(*) AS images FROM p WHERE n = 2"), "paired", "images")
def paired_product(t):
    df = t.derive("conversations", TURNS).withColumn("key", F.struct("image", "pair"))
    return C.paired_product(df, "key")


LINES = "l_orderkey % 5000 AS set_id, l_suppkey AS figure_id, l_linenumber AS question_id, l_returnflag AS category, l_linestatus AS l2_category, CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS score"


def _g3(dim, value, group):
    key = f"GROUP BY {group}" if group else ""
    g = f"{group}, " if group else ""
    sub = lambda cols: f"(SELECT {g}avg(ok) * 100 AS v FROM (SELECT {g}min(score) AS ok FROM d GROUP BY {g}{cols}) {key})"
    on = f"USING ({group})" if group else "ON true"
    return f"""SELECT '{dim}' AS dim, {value} AS value, r.v AS row_acc, f.v AS figure_acc, q.v AS question_acc FROM (SELECT {g}avg(score) * 100 AS v FROM d {key}) r
     JOIN {sub('set_id, figure_id, l2_category')} f {on} JOIN {sub('set_id, question_id, l2_category')} q {on}"""


@query("g03_all_correct_by_key", over("lineitem", LINES, _g3("overall", "'all'", "") + " UNION ALL " + _g3("category", "category", "category")), "row_acc figure_acc question_acc")
def all_correct_by_key(t):
    keys = {"figure_acc": ["set_id", "figure_id", "l2_category"], "question_acc": ["set_id", "question_id", "l2_category"]}
    return C.all_correct_by_key(t.derive("lineitem", LINES), keys, {"overall": [], "category": ["category"]})


# rotations of an order line group: the order key is the main index, the line number the rotation
ROTATED = "l_orderkey + 10000000000 * (l_linenumber - 1) AS idx, l_orderkey AS g_index, substr('ABCD', CAST(l_suppkey % 4 + 1 AS INTEGER), 1) AS answer, concat('The answer is ', substr('ABCD', CAST((l_suppkey + CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS INTEGER), 1), CASE WHEN l_partkey % 50 = 0 THEN ' or D' ELSE '.' END) AS prediction, l_returnflag, l_partkey"


def _letters():
    return F.create_map(*[F.lit(x) for c in "ABCD" for x in (c, f"option {c} text")])


@query("g04_circular_accuracy", over("lineitem", ROTATED, """, u AS (SELECT idx, min(answer) AS answer, min(prediction) AS prediction FROM d GROUP BY idx),
 s AS (SELECT idx, idx % 10000000000 AS g, CASE WHEN len(list_intersect(['A','B','C','D'], string_split(translate(prediction, '.', ' '), ' '))) = 1 AND list_contains(string_split(translate(prediction, '.', ' '), ' '), answer) THEN 1 ELSE 0 END AS hit FROM u),
 g AS (SELECT g, min(hit) AS hit, count(*) AS rotations FROM s GROUP BY g) SELECT s.idx, g.hit, g.rotations FROM s JOIN g ON s.idx = g.g"""), ints="idx hit rotations")
def circular_accuracy(t):
    rows = t.derive("lineitem", ROTATED).groupBy("idx", "g_index").agg(F.min("answer").alias("answer"), F.min("prediction").alias("prediction"))
    return C.circular_accuracy(rows.select("idx", "prediction"), rows.select("idx", "g_index", "answer"), _letters()).select("idx", "hit", "rotations")


PRED = "item_id AS idx, concat('Option ', substr('ABCD', CAST(length(text) % 4 + 1 AS INTEGER), 1), ' fits.') AS prediction"
GOLD = "item_id AS idx, substr('ABCD', CAST(item_id % 4 + 1 AS INTEGER), 1) AS answer, item_id % 5 AS kept"


@query("g05_vanilla_accuracy", f"WITH p AS (SELECT {PRED} FROM benchmark), g AS (SELECT {GOLD} FROM benchmark) SELECT p.idx, answer AS gold, substr(prediction, 8, 1) AS choice, CASE WHEN substr(prediction, 8, 1) = answer THEN 1 ELSE 0 END AS hit FROM p JOIN g USING (idx) WHERE kept > 0", ints="hit")
def vanilla_accuracy(t):
    out = C.vanilla_accuracy(t.derive("benchmark", PRED), t.derive("benchmark", GOLD).filter("kept > 0"), _letters())
    return out.select("idx", "gold", "choice", "hit")


PAIR = "concat('c', CAST(conv_id AS VARCHAR(20)), '_', CAST(turn AS VARCHAR(9))) AS idx, length(text) % 5 > 0 AS hit, turn"


@query("g06_pair_accuracy", over("conversations", PAIR, ", g AS (SELECT split_part(idx, '_', 1) AS k, min(CASE WHEN hit THEN 1 ELSE 0 END) AS ok, count(*) AS n FROM d GROUP BY k) SELECT avg(CASE WHEN ok = 1 AND n >= 2 THEN 1.0 ELSE 0 END) * 100 AS accuracy, count(*) AS groups, count(*) FILTER (ok = 1 AND n >= 2) AS right_groups FROM g"), "accuracy", "groups right_groups")
def pair_accuracy(t):
    return C.pair_accuracy(t.derive("conversations", PAIR), "idx", "hit")


QUADS = "o_orderkey - o_orderkey % 4 AS grp, o_orderkey % 4 AS pos, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS v"


@query("g07_quad_scores", over("orders", QUADS, """, q AS (SELECT grp, max(v) FILTER (pos = 0) AS a, max(v) FILTER (pos = 1) AS b, max(v) FILTER (pos = 2) AS c, max(v) FILTER (pos = 3) AS e, count(*) AS n FROM d GROUP BY grp),
 s AS (SELECT (CASE WHEN a = 1 AND b = 0 THEN 1 ELSE 0 END) + (CASE WHEN e = 1 AND c = 0 THEN 1 ELSE 0 END) AS q, (CASE WHEN a = 1 AND c = 0 THEN 1 ELSE 0 END) + (CASE WHEN e = 1 AND b = 0 THEN 1 ELSE 0 END) AS i,
 a + (1 - b) + (1 - c) + e AS bi FROM q WHERE n = 4) SELECT sum(q) / (2 * count(*)) AS question_acc, sum(i) / (2 * count(*)) AS image_acc, sum(bi) / (4 * count(*)) AS binary_acc, avg(CASE WHEN q = 2 AND i = 2 THEN 1.0 ELSE 0 END) AS group_acc, count(*) AS groups FROM s"""),
       "question_acc image_acc binary_acc group_acc", "groups")
def quad_scores(t):
    return C.quad_scores(t.derive("orders", QUADS), "grp", "pos", "v")


# the order and line number say the variant; copies of a variant number are told apart by the part key
VARIANTS = "l_orderkey AS qid, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS varid, CASE WHEN l_orderkey % 3 = 0 THEN 'algebra' ELSE 'graph' END AS subject, l_orderkey % 4 AS level, CASE WHEN l_quantity > 5 THEN 1 ELSE 0 END AS hit"


@query("g08_worst_case", over("lineitem", VARIANTS, f""", w AS (SELECT qid, min(hit) AS hit, arg_min(subject, varid) AS subject, arg_min(level, varid) AS level FROM d GROUP BY qid),
 a AS ({sets_sql({'overall': [], 'subject': ['subject'], 'level': ['level']}, 'avg(hit) AS acc, count(*) AS n')}), b AS ({sets_sql({'overall': [], 'subject': ['subject'], 'level': ['level']}, 'avg(hit) AS acc, count(*) AS n', source='w')})
 SELECT dim, CAST(value AS VARCHAR) AS value, acc, n, 'average' AS setting FROM a UNION ALL SELECT dim, CAST(value AS VARCHAR), acc, n, 'worst' FROM b"""), "acc", "n")
def worst_case(t):
    return C.worst_case(t.derive("lineitem", VARIANTS), "qid", "varid", ["subject", "level"])


FLIPS = "concat(lpad(CAST(o_orderkey % 3000 AS VARCHAR(9)), 8, '0'), CASE WHEN o_orderkey % 2 = 0 THEN '-flip' ELSE '' END, '-', CAST(o_orderkey % 3 AS VARCHAR(2))) AS qid, CASE WHEN o_totalprice > 60000 THEN 1 ELSE 0 END AS hit"


@query("g09_flip_circular", over("orders", FLIPS, """, k AS (SELECT 'vanilla' AS setting, qid AS key, hit FROM d UNION ALL SELECT 'flip_eval', replace(qid, '-flip', ''), hit FROM d
 UNION ALL SELECT 'circ_eval', CASE WHEN contains(qid, '-flip') THEN substr(qid, 1, 13) ELSE substr(qid, 1, 8) END, hit FROM d UNION ALL SELECT 'flip_circ_eval', substr(qid, 1, 8), hit FROM d),
 g AS (SELECT setting, key, min(hit) AS ok FROM k GROUP BY ALL) SELECT setting, avg(ok) AS acc, count(*) AS n FROM g GROUP BY setting"""), "acc", "n")
def flip_circular(t):
    return C.flip_circular(t.derive("orders", FLIPS))


TURNED = "l_orderkey AS idx, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 'size' ELSE 'height' END AS category, CASE WHEN l_quantity > 15 THEN 1 ELSE 0 END AS hit"


@query("g10_rotation_consistency", over("lineitem", TURNED, """, r AS (SELECT idx, category, min(hit) FILTER (l_linenumber = 1) AS a, min(hit) FILTER (l_linenumber = 2) AS b, min(hit) FILTER (l_linenumber = 3) AS c FROM d GROUP BY ALL),
 p AS (SELECT category, count(*) AS total_questions, avg(CASE WHEN a + b + c = 3 THEN 1.0 ELSE 0 END) AS hit_all, avg(CASE WHEN a + b + c = 0 THEN 1.0 ELSE 0 END) AS miss_all, avg(a) AS rot0, avg(b) AS rot90, avg(c) AS rot180 FROM r WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY category)
 SELECT * FROM p UNION ALL SELECT 'Average', floor(avg(total_questions)), round(avg(hit_all), 3), round(avg(miss_all), 3), round(avg(rot0), 3), round(avg(rot90), 3), round(avg(rot180), 3) FROM p"""), "hit_all miss_all rot0 rot90 rot180", "total_questions")
def rotation_consistency(t):
    one = lambda n: t.derive("lineitem", TURNED).filter(F.col("l_linenumber") == n).groupBy("idx", "category").agg(F.min("hit").alias("hit"))
    return C.rotation_consistency({"rot0": one(1), "rot90": one(2), "rot180": one(3)})


@query("g11_four_view_consistency", "WITH k AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 10) AS p, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT count(*) FILTER (p = 4) / (sum(n) / 4) * 100 AS consistency, sum(n) AS n FROM k", "consistency", "n")
def four_view_consistency(t):
    return C.four_view_consistency(t.lineitem.select("l_orderkey", (F.col("l_quantity") > 10).alias("ok")), "l_orderkey", "ok")


STEPPED = """l_orderkey AS id, concat(CASE WHEN l_orderkey % 2 = 0 THEN '2' ELSE '3' END, 'steps_', CASE WHEN l_linenumber = CASE WHEN l_orderkey % 2 = 0 THEN 3 ELSE 4 END THEN 'multi' ELSE CAST(l_linenumber AS VARCHAR(2)) END) AS step,
 l_linenumber, l_quantity > 15 AS ok"""


@query("g12_step_mastery", over("lineitem", STEPPED, """, p AS (SELECT id, step, bool_or(ok) AS ok FROM d GROUP BY ALL),
 w AS (SELECT a.id, a.n, a.ok AS s1, b.ok AS s2, c.ok AS s3, m.ok AS multi FROM (SELECT id, CAST(step[1] AS INT) AS n, ok FROM p WHERE step IN ('2steps_1', '3steps_1')) a
  LEFT JOIN p b ON b.id = a.id AND b.step = a.n || 'steps_2' LEFT JOIN p c ON c.id = a.id AND a.n = 3 AND c.step = '3steps_3' LEFT JOIN p m ON m.id = a.id AND m.step = a.n || 'steps_multi'),
 f AS (SELECT *, (s1 AND coalesce(s2, false) AND (n = 2 OR coalesce(s3, false))) AS all_right, (NOT s1 OR coalesce(NOT s2, false) OR coalesce(NOT s3, false)) AS any_wrong, (s1 OR coalesce(s2, false) OR coalesce(s3, false)) AS any_right,
  (NOT s1 AND coalesce(NOT s2, false) AND (n = 2 OR coalesce(NOT s3, false))) AS all_wrong FROM w),
 c AS (SELECT count(*) FILTER (all_right AND NOT multi) AS inadequate, count(*) FILTER (any_wrong AND NOT multi) AS insufficient, count(*) FILTER (any_right AND multi) AS mastery_loose, count(*) FILTER (all_right AND multi) AS mastery_strict,
  count(*) FILTER (all_wrong AND multi) AS rote_loose, count(*) FILTER (any_wrong AND multi) AS rote_strict, count(*) AS items FROM f)
 SELECT *, rote_loose / (rote_loose + mastery_loose) AS rote_loose_rate, rote_strict / (rote_strict + mastery_strict) AS rote_strict_rate,
  (items - 0.5 * inadequate - rote_loose - insufficient) / items AS score_loose, (items - 0.5 * inadequate - rote_strict - insufficient) / items AS score_strict FROM c"""),
       "inadequate insufficient mastery_loose mastery_strict rote_loose rote_strict rote_loose_rate rote_strict_rate score_loose score_strict", "items")
def step_mastery(t):
    return C.step_mastery(t.derive("lineitem", STEPPED), "id", "step", "ok")


@query("g13_concept_accuracy", """WITH t AS (SELECT p_partkey AS concept, p_brand AS root FROM part), s AS (SELECT l_partkey AS concept, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS hit FROM lineitem),
 c AS (SELECT concept, avg(hit) AS acc FROM s GROUP BY concept) SELECT root, avg(acc) AS acc, count(acc) AS concepts FROM t LEFT JOIN c USING (concept) GROUP BY root""", "acc", "concepts")
def concept_accuracy(t):
    steps = t.lineitem.select(F.col("l_partkey").alias("concept"), (F.col("l_quantity") > 25).cast("int").alias("hit"))
    return C.concept_accuracy(steps, t.part.select(F.col("p_partkey").alias("concept"), F.col("p_brand").alias("root")))


@query("g14_compare_with_auxiliary_runs", """WITH b AS (SELECT o_orderkey AS item, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS score FROM orders), a AS (SELECT l_orderkey AS item, 'run' || l_linenumber AS run, max(CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END) AS score FROM lineitem GROUP BY ALL),
 m AS (SELECT item, string_agg(run || '=' || score, ',' ORDER BY run) AS runs, count(*) AS n, sum(score) AS s FROM a GROUP BY item) SELECT b.item, b.score, coalesce(runs, '') AS runs, coalesce(s, 0) AS aux_sum FROM b LEFT JOIN m USING (item)""", ints="score aux_sum")
def compare_with_auxiliary_runs(t):
    base = t.orders.select(F.col("o_orderkey").alias("item"), (F.col("o_totalprice") > 250000).cast("int").alias("score"))
    aux = t.lineitem.groupBy(F.col("l_orderkey").alias("item"), F.concat(F.lit("run"), F.col("l_linenumber").cast("string")).alias("run")).agg(F.max((F.col("l_quantity") > 20).cast("int")).alias("score"))
    out = C.compare_with_auxiliary_runs(base, aux)
    entries = F.coalesce(F.map_entries("auxiliary"), F.array().cast("array<struct<key:string,value:int>>"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("item", "score", text.alias("runs"), F.aggregate(entries, F.lit(0), lambda s, e: s + e["value"]).alias("aux_sum"))
