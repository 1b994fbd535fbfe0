"""Report queries (F) over scored rows derived from the tables."""

from pyspark.sql import functions as F

from scorewright.operators import reports as R
from scorewright.plans.catalog import over, query, sets_sql

ORDERS = """o_orderkey AS idx, CASE WHEN o_custkey % 2 = 0 THEN 'dev' ELSE 'test' END AS split, o_orderpriority AS category,
 o_orderstatus AS l2_category, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS hit"""
L2C = {"overall": [], "l2_category": ["l2_category"], "category": ["category"]}


@query("f01_accuracy_report", over("orders", ORDERS, sets_sql(L2C, "avg(hit) AS acc, count(*) AS n", "split")), "acc", "n")
def accuracy_report(t):
    return R.accuracy_report(t.derive("orders", ORDERS))


WIDE = "1-URGENT 2-HIGH 3-MEDIUM 4-NONE 5-LOW".split()
SHORT_NAMES = {"all": "Overall", "4-NOT SPECIFIED": "4-NONE"}


@query("f01_accuracy_report_wide", over("orders", ORDERS, "SELECT split, avg(hit) AS Overall, " + ", ".join(
    f"avg(CASE WHEN category = '{c.replace('4-NONE', '4-NOT SPECIFIED')}' THEN hit END) AS \"{c}\"" for c in WIDE) + " FROM d GROUP BY split"), "Overall " + " ".join(WIDE))
def accuracy_report_wide(t):
    long = R.accuracy_report(t.derive("orders", ORDERS), names=SHORT_NAMES)
    return R.widen(long, ["split"], "value", "acc", ["Overall", *WIDE])


@query("f02_two_level_report", over("orders", ORDERS, """, a AS (SELECT * FROM d UNION ALL SELECT * REPLACE ('ALL' AS split) FROM d),
 c AS (SELECT split, category, avg(hit) AS acc FROM a GROUP BY ALL), m AS (SELECT DISTINCT split, l2_category, category FROM a)
 SELECT split, 'overall' AS dim, 'all' AS value, avg(hit) AS acc FROM a GROUP BY split
 UNION ALL SELECT split, 'category', category, acc FROM c
 UNION ALL SELECT split, 'l2_category', l2_category, avg(acc) FROM m JOIN c USING (split, category) GROUP BY split, l2_category"""), "acc")
def two_level_report(t):
    return R.two_level_report(t.derive("orders", ORDERS))


LINES = """CASE WHEN l_linenumber % 4 = 0 THEN 'Fig2Cap' WHEN l_linenumber % 4 = 1 THEN 'SubFig2Cap' WHEN l_linenumber % 4 = 2 THEN 'SubCap2Fig' ELSE 'Other' END AS setting,
 concat('S', CAST(l_suppkey % 9 AS VARCHAR(9))) AS subject, l_returnflag AS category, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS hit"""
SETTINGS = ["Fig2Cap", "SubFig2Cap", "SubCap2Fig"]
_CELLS = ", ".join(f"coalesce(avg(CASE WHEN setting = '{s}' THEN hit END), 0) AS \"{s}\"" for s in SETTINGS)


@query("f03_pivot_report", over("lineitem", LINES, f""", k AS (SELECT * FROM d WHERE setting <> 'Other'), p AS (
 SELECT subject, {_CELLS} FROM k GROUP BY subject UNION ALL SELECT 'CATEGORY_' || category, {_CELLS} FROM k GROUP BY category UNION ALL SELECT 'Overall', {_CELLS} FROM k)
 SELECT *, (Fig2Cap + SubFig2Cap + SubCap2Fig) / 3 AS "Avg" FROM p"""), "Fig2Cap SubFig2Cap SubCap2Fig Avg")
def pivot_report(t):
    return R.pivot_report(t.derive("lineitem", LINES), SETTINGS)


PARTS = """concat(p_type, '/', p_brand) AS category, CASE WHEN p_size % 3 = 0 THEN 'Color Attribute' WHEN p_size % 3 = 1 THEN 'Count/Small' ELSE 'Position' END AS l2_category,
 CASE WHEN p_size % 11 = 0 THEN -1 WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS score"""


@query("f04_task_tree_report", over("part", PARTS, """, f AS (SELECT split_part(category, '/', 1) AS task, split_part(category, '/', 2) AS subtask,
 CASE WHEN lower(l2_category) LIKE '%attribute%' THEN split_part(lower(l2_category), '/', 1) || '/attribute' ELSE lower(l2_category) END AS leaf, score FROM d WHERE score >= 0)
 SELECT task, subtask, leaf, sum(score) AS "right", count(*) AS total, avg(score) AS acc FROM f GROUP BY ROLLUP (task, subtask, leaf)"""), "right acc", "total")
def task_tree_report(t):
    return R.task_tree_report(t.derive("part", PARTS))


VQA = """item_id AS idx, CASE WHEN item_id % 2 = 0 THEN 'val' ELSE 'test' END AS split, length(text) % 4 AS a, item_id % 3 AS b, length(text) % 7 AS c"""


def _vqa(metric, expr):
    @query(f"f05_vqa_report_{metric}", over("benchmark", VQA, f""", m AS (SELECT split, [a / 4.0, b / 3.0, c / 7.0] AS v FROM d), h AS (SELECT split, {expr} AS h FROM m)
     SELECT 'split' AS dim, split AS value, avg(h) * 100 AS score, count(*) AS n FROM h GROUP BY split"""), "score", "n")
    def run(t):
        df = t.derive("benchmark", VQA).select("split", F.array(F.col("a") / 4.0, F.col("b") / 3.0, F.col("c") / 7.0).alias("match"))
        return R.vqa_report(df, "match", metric)


_vqa("mean", "list_avg(v)")
_vqa("max", "list_max(v)")
_vqa("anls", "CASE WHEN 1 - list_min(v) < 0.5 THEN 0.0 ELSE 1 - list_min(v) END")

LABELS = """doc_id AS idx, CASE WHEN doc_id % 3 = 0 THEN 'existence' WHEN doc_id % 3 = 1 THEN 'count,position' ELSE 'color' END AS category,
 CASE WHEN doc_id % 2 = 0 THEN 'VD' ELSE 'VS' END AS l2_category, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS answer,
 CASE WHEN toxic = 0 THEN 'Yes' ELSE 'No' END AS extracted, CASE WHEN quality = 1 - toxic THEN 1 ELSE 0 END AS score"""


@query("f06_default_rating", over("labels", LABELS, sets_sql({"overall": [], "category": ["category"], "l2_category": ["l2_category"]}, "avg(score) * 100 AS rating, count(*) AS n")), "rating", "n")
def default_rating(t):
    return R.default_rating(t.derive("labels", LABELS))


@query("f07_binary_f1_report", over("labels", LABELS, """, f AS (SELECT unnest(string_split(category, ',')) AS cat, answer = 'Yes' AS y, extracted = 'Yes' AS p, score FROM d),
 g AS (SELECT 'overall' AS dim, 'all' AS value, * FROM f UNION ALL SELECT 'category', cat, * FROM f),
 c AS (SELECT dim, value, avg(score) * 100 AS acc, sum(CASE WHEN y AND p THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN NOT y AND p THEN 1.0 ELSE 0 END) AS fp, sum(CASE WHEN y AND NOT p THEN 1.0 ELSE 0 END) AS fn FROM g GROUP BY dim, value),
 r AS (SELECT dim, value, acc, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END * 100 AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END * 100 AS recall FROM c)
 SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r"""), "acc precision recall f1")
def binary_f1_report(t):
    return R.binary_f1_report(t.derive("labels", LABELS))


REMAP = {"existence": "Existence", "color": "Attribute", "count,position": "Attribute"}


@query("f08_category_remap_rating", over("labels", LABELS, """, m AS (SELECT CASE category WHEN 'existence' THEN 'Existence' ELSE 'Attribute' END AS category, score FROM d),
 c AS (SELECT category, avg(score) * 100 AS rating FROM m GROUP BY category) SELECT * FROM c UNION ALL SELECT 'Avg ACC', avg(rating) FROM c"""), "rating")
def category_remap_rating(t):
    return R.category_remap_rating(t.derive("labels", LABELS), REMAP)


PAIRS = """o_orderstatus AS category, o_orderkey - o_orderkey % 2 AS image, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS score"""
GROUPS = {"perception": ["F", "O"], "reasoning": ["P"]}


@query("f09_sum_of_categories", over("orders", PAIRS, """, i AS (SELECT category, image, product(score) AS p, sum(score) AS s, count(*) AS n FROM d GROUP BY ALL),
 c AS (SELECT category, (sum(s) / sum(n) + avg(CASE WHEN n = 2 THEN p END)) * 100 AS score FROM i GROUP BY category)
 SELECT * FROM c UNION ALL SELECT CASE WHEN category = 'P' THEN 'reasoning' ELSE 'perception' END, sum(score) FROM c GROUP BY 1"""), "score")
def sum_of_categories(t):
    return R.sum_of_categories(t.derive("orders", PAIRS), GROUPS)


TAMPER = """CASE WHEN doc_id % 4 = 0 THEN 'original' WHEN doc_id % 4 = 1 THEN 'dropping' WHEN doc_id % 4 = 2 THEN 'masking' ELSE 'rotate' END AS kind,
 CASE WHEN doc_id % 3 = 0 THEN 'move' ELSE 'count' END AS task, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS answer, 1 - toxic AS score"""


def _confusion_sql(by):
    key = f"{by}, " if by else ""
    return over("labels", TAMPER, f""", p AS (SELECT *, answer = 'Yes' AS y, (answer = 'Yes') = (score = 1) AS g FROM d),
     k AS (SELECT DISTINCT {key} kind AS k FROM p WHERE kind <> 'original'),
     j AS (SELECT {'k.' + by + ',' if by else ''} k.k, y, g FROM k JOIN p ON (p.kind = k.k OR p.kind = 'original') {'AND p.' + by + ' = k.' + by if by else ''}),
     c AS (SELECT {key} k AS kind, count(*) FILTER (y AND g) AS tp, count(*) FILTER (NOT y AND g) AS fp, count(*) FILTER (y AND NOT g) AS fn, count(*) FILTER (NOT y AND NOT g) AS tn FROM j GROUP BY ALL),
     r AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM c),
     f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)
     SELECT * FROM f UNION ALL SELECT {key} 'overall', NULL, NULL, NULL, NULL, avg(accuracy), avg(precision), avg(recall), avg(f1) FROM f {'GROUP BY ' + by if by else ''}""")


@query("f10_confusion_report", _confusion_sql(""), "tp fp fn tn accuracy precision recall f1")
def confusion_report(t):
    return R.confusion_report(t.derive("labels", TAMPER))


@query("f10_confusion_report_by_task", _confusion_sql("task"), "tp fp fn tn accuracy precision recall f1")
def confusion_report_by_task(t):
    return R.confusion_report(t.derive("labels", TAMPER), by=["task"])


FETCHED = "o_orderpriority AS category, o_custkey % 3 = 0 AS prefetched, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS hit, o_custkey % 5 / 5e0 AS reason"
_RATES = "count(*) AS tot, count(*) FILTER (prefetched) AS prefetch, sum(hit) AS hit, count(*) FILTER (prefetched) / count(*) * 100 AS prefetch_rate, sum(hit) / count(*) * 100 AS acc"


@query("f11_hit_rate_report", over("orders", FETCHED, f"SELECT category AS subject, {_RATES} FROM d GROUP BY category UNION ALL SELECT 'Overall', {_RATES} FROM d"), "prefetch_rate acc", "tot prefetch hit")
def hit_rate_report(t):
    return R.hit_rate_report(t.derive("orders", FETCHED))


TOKENS = "doc_id, text, n_chars % 2 AS score"


@query("f12_multi_label_report", over("documents", TOKENS, """, l AS (SELECT score, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) = 3))) AS label FROM d)
 SELECT label, avg(score) AS mean_score, count(*) AS n FROM l GROUP BY label"""), "mean_score", "n")
def multi_label_report(t):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) == 3)
    return R.multi_label_report(t.derive("documents", TOKENS).withColumn("labels", words), "labels")


ANSWERABLE = """CASE WHEN o_orderkey % 4 = 0 THEN 'Not answerable' ELSE 'x' END AS gold, CASE WHEN o_custkey % 5 = 0 THEN 'Not answerable' ELSE 'x' END AS pred,
 CASE WHEN o_totalprice > 200000 THEN 1e0 ELSE 0e0 END AS score"""


@query("f13_positive_f1", over("orders", ANSWERABLE, """, r AS (SELECT avg(CASE WHEN gold <> 'Not answerable' THEN score END) AS recall, avg(CASE WHEN pred <> 'Not answerable' THEN score END) AS precision FROM d)
 SELECT *, 2 * recall * precision / (recall + precision) AS f1 FROM r"""), "recall precision f1")
def positive_f1(t):
    return R.positive_f1(t.derive("orders", ANSWERABLE), "gold", "pred")


JUDGED = "event_type AS kind, CASE WHEN user_id % 3 = 0 THEN 'night' ELSE 'day' END AS moment, CASE WHEN value < 20 THEN -1.0 WHEN value > 120 THEN 3.0 ELSE 1.0 END AS score"
COARSE = {"input": ["click", "signup"], "output": ["view", "night"]}


@query("f14_all_vs_valid", over("events", JUDGED, """, f AS (SELECT unnest([kind, moment]) AS value, score FROM d),
 c AS (SELECT 'input' AS value, score FROM d WHERE kind IN ('click', 'signup') UNION ALL SELECT 'output', score FROM d WHERE kind = 'view' OR moment = 'night')
 SELECT 'fine' AS dim, value, avg(greatest(score, 0)) AS mean_all, avg(CASE WHEN score >= 0 THEN score END) AS mean_valid FROM f GROUP BY value
 UNION ALL SELECT 'coarse', value, avg(greatest(score, 0)), avg(CASE WHEN score >= 0 THEN score END) FROM c GROUP BY value"""), "mean_all mean_valid")
def all_vs_valid(t):
    df = t.derive("events", JUDGED).withColumn("dims", F.array("kind", "moment")).withColumn("score", F.col("score").cast("double"))
    return R.all_vs_valid(df, "dims", COARSE)


VIDEO = """user_id AS qid, CASE WHEN value < 30 THEN 'short' WHEN value < 90 THEN 'medium' ELSE 'long' END AS duration, event_type AS domain,
 concat('u', CAST(user_id % 4 AS VARCHAR(9))) AS sub_category, event_id % 3 AS aud, CASE WHEN event_id % 7 = 0 THEN -1e0 ELSE event_id % 2 END AS score"""
_CUBE = {"duration:overall": ["duration"], "all:overall": [], "duration:domain": ["duration", "domain"], "duration:sub_category": ["duration", "sub_category"], "all:domain": ["domain"], "all:sub_category": ["sub_category"]}
_M = "avg(score) AS mean_score, count(*) AS n"


@query("f15_duration_cube", over("events", VIDEO, ", k AS (SELECT * FROM d WHERE score >= 0), a AS (SELECT *, unnest(CASE aud WHEN 0 THEN ['speech'] WHEN 1 THEN ['music', 'event'] ELSE ['music'] END) AS lab FROM k) "
       + sets_sql(_CUBE, _M, source="k") + " UNION ALL " + sets_sql({"duration:audio": ["duration", "lab"], "all:audio": ["lab"]}, _M, source="a")), "mean_score", "n")
def duration_cube(t):
    audio = F.when(F.col("aud") == 0, F.array(F.lit("speech"))).when(F.col("aud") == 1, F.array(F.lit("music"), F.lit("event"))).otherwise(F.array(F.lit("music")))
    return R.duration_cube(t.derive("events", VIDEO).withColumn("audio", audio), "duration", ["domain", "sub_category"], labels="audio")


BUCKETS = "event_type AS domain, concat('u', CAST(user_id % 4 AS VARCHAR(9))) AS sub_category, value * 15 AS duration, CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE event_id % 3 / 2.0 END AS score"
_BIN = "CASE " + " ".join(f"WHEN duration / 60 <= {(i + 1) * 10} THEN '{b}'" for i, b in enumerate(R.DURATION_BINS[:-1])) + " ELSE '60+' END"


@query("f16_bucketed_report", over("events", BUCKETS, f""", k AS (SELECT *, {_BIN} AS bin FROM d WHERE score <> -1), b AS (SELECT unnest({R.DURATION_BINS}) AS bin)
 SELECT 'overall' AS dim, 'all' AS value, round(avg(score), 4) AS mean_score FROM k UNION ALL SELECT 'domain', domain, round(avg(score), 4) FROM k GROUP BY domain
 UNION ALL SELECT 'sub_category', sub_category, round(avg(score), 4) FROM k GROUP BY sub_category
 UNION ALL SELECT 'duration', b.bin, coalesce(round(avg(score), 4), 0) FROM b LEFT JOIN k ON b.bin = k.bin GROUP BY b.bin"""), "mean_score")
def bucketed_report(t):
    return R.bucketed_report(t.derive("events", BUCKETS), ["domain", "sub_category"])


GROUND = """event_id - event_id % 3 AS qid, CASE event_id % 3 WHEN 0 THEN 'long_acc' WHEN 1 THEN 'clue_acc' ELSE 'miou' END AS task_mode,
 CASE WHEN (event_id - event_id % 3) % 4 = 0 THEN 'sport' ELSE 'news' END AS domain,
 CASE WHEN event_id % 11 = 0 THEN -1.0 WHEN event_id % 3 = 2 THEN user_id % 10 / 10.0 ELSE user_id % 2 END AS score"""
_T = [0.1, 0.2, 0.3, 0.4, 0.5]
_GR = "avg(la) AS la, avg(ca) AS ca, avg(mi) AS mi, count(mi) AS cm, count(*) FILTER (mi IS NOT NULL AND la IS NOT NULL) AS cb, " + ", ".join(
    f"count(*) FILTER (mi > {x}) AS r{i}, count(*) FILTER (mi > {x} AND la = 1) AS a{i}" for i, x in enumerate(_T))


@query("f17_grounding_report", over("events", GROUND, f""", q AS (SELECT qid, domain, max(score) FILTER (task_mode = 'long_acc') AS la, max(score) FILTER (task_mode = 'clue_acc') AS ca, max(score) FILTER (task_mode = 'miou') AS mi
 FROM d WHERE score <> -1 GROUP BY qid, domain), g AS ({sets_sql({'overall': [], 'domain': ['domain']}, _GR, source='q')})
 SELECT dim, value, round(la, 4) AS long_acc, round(ca, 4) AS clue_acc, round(mi, 4) AS miou, round(least(la, ca) / ca, 4) AS crr,
 round(({' + '.join(f'round(a{i} / cb, 4)' for i in range(5))}) / 5, 4) AS acc_at_iou, round(({' + '.join(f'round(r{i} / cm, 4)' for i in range(5))}) / 5, 4) AS rec_at_iou FROM g"""), "long_acc clue_acc miou crr acc_at_iou rec_at_iou")
def grounding_report(t):
    return R.grounding_report(t.derive("events", GROUND), ["domain"])


@query("f18_type_rating", "WITH d AS (SELECT p_type || '. ' || p_brand AS k, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS s FROM part) SELECT k AS type, sum(s) AS correct, count(*) AS total, avg(s) AS acc FROM d GROUP BY k UNION ALL SELECT 'overall', sum(s), count(*), avg(s) FROM d", "acc", "correct total")
def type_rating(t):
    return R.type_rating(t.derive("part", "p_type, p_brand, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS score"), F.concat_ws(". ", "p_type", "p_brand"))


SUBS = "p_type AS dim, p_brand AS task_type, CAST(p_size % 5 AS DOUBLE) AS success, CAST(5 AS DOUBLE) AS overall"


@query("f19_success_total_rollup", over("part", SUBS, """, r AS (SELECT 'row' AS level, dim || '. ' || task_type AS key, sum(success) AS success, sum(overall) AS total FROM d GROUP BY dim, task_type
 UNION ALL SELECT 'dim', dim, sum(success), sum(overall) FROM d GROUP BY dim UNION ALL SELECT 'task', task_type, sum(success), sum(overall) FROM d GROUP BY task_type
 UNION ALL SELECT 'overall', 'overall', sum(success), sum(overall) FROM d) SELECT *, round(success / total * 100, 2) AS acc FROM r"""), "success total acc")
def success_total_rollup(t):
    return R.success_total_rollup(t.derive("part", SUBS))


SOURCES = "concat('s', CAST(l_suppkey % 7 AS VARCHAR(9))) AS source, l_linestatus AS split, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS hit"


@query("f20_macro_over_sources", over("lineitem", SOURCES, ", c AS (SELECT split, source, avg(hit) AS acc FROM d GROUP BY ALL) SELECT * FROM c UNION ALL SELECT split, 'Overall', avg(acc) FROM c GROUP BY split"), "acc")
def macro_over_sources(t):
    return R.macro_over_sources(t.derive("lineitem", SOURCES))


SETS = "l_returnflag AS category, l_linestatus AS l2_category, CASE WHEN l_linenumber % 2 = 0 THEN 'AB' ELSE 'A' END AS answer, CASE WHEN l_suppkey % 3 = 0 THEN 'BA' ELSE 'A' END AS pred"


@query("f21_macro_and_micro", over("lineitem", SETS, """, s AS (SELECT category || '/' || l2_category AS task, CASE WHEN list_sort(list_distinct(string_split(answer, ''))) = list_sort(list_distinct(string_split(pred, ''))) THEN 1 ELSE 0 END AS hit FROM d),
 c AS (SELECT task, avg(hit) AS acc FROM s GROUP BY task) SELECT * FROM c UNION ALL SELECT 'Overall macro', avg(acc) FROM c UNION ALL SELECT 'Overall micro', avg(hit) FROM s"""), "acc")
def macro_and_micro(t):
    letters = lambda c: F.array_sort(F.array_distinct(F.split(c, "")))
    df = t.derive("lineitem", SETS)
    return R.macro_and_micro(df, F.concat_ws("/", "category", "l2_category"), letters("answer") == letters("pred"))


SUPER = {"General": ["1-URGENT", "2-HIGH"], "Reasoning": ["3-MEDIUM", "4-NOT SPECIFIED"], "Doc": ["5-LOW"]}


@query("f22_grouped_super_means", over("orders", ORDERS, """, c AS (SELECT category, avg(hit) AS acc FROM d GROUP BY category), u AS (SELECT 'overall' AS dim, 'all' AS value, avg(hit) AS acc FROM d UNION ALL SELECT 'dataset', category, acc FROM c
 UNION ALL SELECT 'group', CASE WHEN category IN ('1-URGENT', '2-HIGH') THEN 'General' WHEN category = '5-LOW' THEN 'Doc' ELSE 'Reasoning' END, avg(acc) FROM c GROUP BY 2) SELECT dim, value, round(acc * 100, 2) AS acc FROM u"""), "acc")
def grouped_super_means(t):
    return R.grouped_super_means(t.derive("orders", ORDERS), SUPER)


CYCLES = "concat('cycle', CAST(o_orderkey % 4 AS VARCHAR(9))) AS cycle, o_orderpriority AS category, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS hit"


@query("f23_cycle_report", over("orders", CYCLES, """, c AS (SELECT cycle, category AS type, avg(hit) AS accuracy FROM d GROUP BY ALL UNION ALL SELECT cycle, 'all', avg(hit) FROM d GROUP BY cycle)
 SELECT * FROM c UNION ALL SELECT 'Average', type, sum(accuracy) / (SELECT count(DISTINCT cycle) FROM d) FROM c GROUP BY type"""), "accuracy")
def cycle_report(t):
    return R.cycle_report(t.derive("orders", CYCLES))


@query("f24_score_sum_report", over("orders", ORDERS, """, g AS (SELECT CASE WHEN category IN ('1-URGENT', '2-HIGH') THEN 'General' WHEN category = '5-LOW' THEN 'Doc' ELSE 'Reasoning' END AS name, hit FROM d)
 SELECT name, sum(hit) AS score FROM g GROUP BY name UNION ALL SELECT 'Final Score', sum(hit) FROM g UNION ALL SELECT 'Final Score Norm', sum(hit) / 10 FROM g"""), "score")
def score_sum_report(t):
    return R.score_sum_report(t.derive("orders", ORDERS), SUPER)


@query("f25_relative_score", "WITH d AS (SELECT p_type AS category, p_size AS score, p_retailprice / 100 AS ref FROM part) " + sets_sql({"overall": [], "category": ["category"]}, "avg(score) / avg(ref) * 100 AS relative, avg(score) * 10 AS model_score, avg(ref) * 10 AS reference_score"), "relative model_score reference_score")
def relative_score(t):
    return R.relative_score(t.derive("part", "p_type AS category, p_size AS score, p_retailprice / 100 AS ref"), "score", "ref")


VERDICTS = "o_orderpriority AS type, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey % 5 - 2 END AS verdict, o_orderkey % 2 = 1 AS reverse"
_V = ", ".join(f"count(*) FILTER (v = {v}) AS {n}" for n, v in {"much_better": 2, "better": 1, "tie": 0, "worse": -1, "much_worse": -2}.items())


@query("f26_win_rate_reward", over("orders", VERDICTS, f", s AS (SELECT type, coalesce(CASE WHEN reverse THEN -verdict ELSE verdict END, 0) AS v FROM d), r AS ({sets_sql({'overall': [], 'type': ['type']}, _V + ', count(*) AS n', source='s')}) SELECT *, (100 * much_better + 50 * better - 50 * worse - 100 * much_worse) / n AS reward, (better + much_better) / n AS win_rate FROM r"), "reward win_rate", "much_better better tie worse much_worse n")
def win_rate_reward(t):
    return R.win_rate_reward(t.derive("orders", VERDICTS))


DUAL = """o_orderpriority AS task, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey % 5 - 2 END AS verdict, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice / 100000 END AS score,
 CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 10 / 2.0 END AS ref_score, o_orderkey % 3 <> 0 AS objective, o_orderkey % 2 AS side"""
MAIN = {"1-URGENT": "fast", "2-HIGH": "fast", "3-MEDIUM": "slow", "4-NOT SPECIFIED": "slow", "5-LOW": "slow"}
_S = ", ".join(f"count(*) FILTER (v = {v}) / count(v) AS share_{n}" for n, v in {"much_better": 2, "better": 1, "tie": 0, "worse": -1, "much_worse": -2}.items())


@query("f27_dual_judgement_merge", over("orders", DUAL, f""", b AS (SELECT task, verdict AS v, score, ref_score, objective FROM d WHERE side = 0 UNION ALL SELECT task, -verdict, ref_score, score, objective FROM d WHERE side = 1),
 m AS (SELECT *, CASE WHEN task IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END AS main FROM b)
 {sets_sql({'task': ['task'], 'main': ['main'], 'overall': []}, "count(v) / count(*) AS parse_ok, " + _S + ", count(*) FILTER (v > 0) / count(v) * 100 AS win_rate, sum(CASE v WHEN 2 THEN 100 WHEN 1 THEN 50 WHEN -1 THEN -50 WHEN -2 THEN -100 ELSE 0 END) / count(v) AS reward, count(*) FILTER (objective AND score IS NOT NULL) / count(*) FILTER (objective) AS obj_parse_ok, avg(score) FILTER (objective) AS obj_score, avg(ref_score) FILTER (objective) AS obj_ref_score", source='m')}"""),
       "parse_ok share_much_better share_better share_tie share_worse share_much_worse win_rate reward obj_parse_ok obj_score obj_ref_score")
def dual_judgement_merge(t):
    df = t.derive("orders", DUAL).withColumn("ref_score", F.col("ref_score").cast("double"))
    return R.dual_judgement_merge(df.filter("side = 0").drop("side"), df.filter("side = 1").drop("side"), MAIN)


MRA = """CASE o_orderkey % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'float' ELSE 'str' END AS kind,
 CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey % 5 AS VARCHAR(20)) WHEN 1 THEN CAST(o_custkey % 50 + 1 AS VARCHAR(20)) WHEN 2 THEN 'yes' ELSE 'table' END AS gold,
 CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey % 4 AS VARCHAR(20)) WHEN 1 THEN CASE WHEN o_custkey % 11 = 0 THEN 'far' ELSE CAST((o_custkey % 50 + 1) * (1 + o_custkey % 7 / 16.0) AS VARCHAR(20)) END WHEN 2 THEN CASE WHEN o_custkey % 3 = 0 THEN 'True.' ELSE 'No' END ELSE CASE WHEN o_custkey % 2 = 0 THEN 'Table' ELSE 'chair' END END AS pred"""


@query("f28_mean_relative_accuracy", over("orders", MRA, """, r AS (SELECT *, abs(try_cast(gold AS DOUBLE) - try_cast(pred AS DOUBLE)) / try_cast(gold AS DOUBLE) AS off FROM d)
 SELECT avg(CASE WHEN kind = 'str' AND gold IN ('yes', 'no') THEN CASE WHEN contains(lower(pred), gold) OR (gold = 'yes' AND contains(lower(pred), 'true')) OR (gold = 'no' AND contains(lower(pred), 'false')) THEN 1.0 ELSE 0.0 END END) AS yes_no_accuracy,
 avg(CASE WHEN kind = 'str' AND gold NOT IN ('yes', 'no') THEN CASE WHEN gold = lower(pred) THEN 1.0 ELSE 0.0 END END) AS choice_accuracy,
 avg(CASE WHEN kind = 'int' THEN CASE WHEN try_cast(gold AS INT) = try_cast(pred AS INT) THEN 1.0 ELSE 0.0 END END) AS count_accuracy,
 avg(CASE WHEN kind = 'float' THEN len(list_filter([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5], lambda x: coalesce(off < x, false))) / 10.0 END) AS mean_relative_accuracy FROM r"""),
       "yes_no_accuracy choice_accuracy count_accuracy mean_relative_accuracy")
def mean_relative_accuracy(t):
    return R.mean_relative_accuracy(t.derive("orders", MRA))


LEVELS = "concat('L', CAST(p_size % 5 AS VARCHAR(9))) AS level, CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS score, p_partkey % 13 = 0 AS format_error"


@query("f29_level_report", over("part", LEVELS, sets_sql({"overall": [], "level": ["level"]}, "sum(score) AS correct, count(*) AS total, count(*) FILTER (format_error) AS format_errors, avg(score) AS acc")), "correct acc", "total format_errors")
def level_report(t):
    return R.level_report(t.derive("part", LEVELS))


FIELDS = """concat(l_returnflag, l_linestatus) AS task, l_orderkey AS query, l_linenumber AS field, CASE WHEN l_quantity > 45 THEN -1.0 ELSE l_quantity / 50.0 END AS score, l_tax + 0.5 AS weight"""


def _fields(how, agg):
    @query(f"f30_field_weighted_score_{how}", over("lineitem", FIELDS, f""", q AS (SELECT task, query, coalesce({agg}, -1.0) AS q FROM d GROUP BY task, query),
     t AS (SELECT task, sum(greatest(q, 0)) AS s, count(*) AS n FROM q GROUP BY task)
     SELECT task, s / n AS mean_score, n AS queries FROM t UNION ALL SELECT 'macro', avg(s / n), sum(n) FROM t UNION ALL SELECT 'micro', sum(s) / sum(n), sum(n) FROM t"""), "mean_score", "queries")
    def run(t):
        return R.field_weighted_score(t.derive("lineitem", FIELDS), how)


_fields("mean", "sum(score * weight) FILTER (score >= 0) / sum(weight) FILTER (score >= 0)")
_fields("min", "min(score) FILTER (score >= 0)")


@query("f31_attribute_breakdown", over("orders", ORDERS, sets_sql({"overall": [], "split": ["split"], "category": ["category"], "l2_category": ["l2_category"]}, "avg(hit) AS acc, count(*) AS n")), "acc", "n")
def attribute_breakdown(t):
    return R.attribute_breakdown(t.derive("orders", ORDERS), ["split", "category", "l2_category"])


NANS = "CASE WHEN event_id % 5 = 0 THEN -1.0 ELSE value / 500 END AS reality, CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE user_id / 200.0 END AS aesthetics"


@query("f32_nan_safe_mean", over("events", NANS, ", m AS (SELECT avg(nullif(reality, -1)) AS r, avg(nullif(aesthetics, -1)) AS a FROM d) SELECT (r + a) / 2 * 100 AS overall, r * 100 AS reality, a * 100 AS aesthetics FROM m"), "overall reality aesthetics")
def nan_safe_mean(t):
    return R.nan_safe_mean(t.derive("events", NANS), ["reality", "aesthetics"])


CASES = "p_type AS category, CASE p_size % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'choice' ELSE 'blank' END AS form, CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS hit"


@query("f33_case_report", over("part", CASES, sets_sql({"overall": [], "category": ["category"], "form": ["form"], "form_category": ["form", "category"]}, "count(*) AS total, sum(hit) AS correct, avg(hit) AS acc")), "correct acc", "total")
def case_report(t):
    return R.case_report(t.derive("part", CASES))


@query("f34_single_accuracy", "SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS accuracy, count(*) AS n FROM orders", "accuracy", "n")
def single_accuracy(t):
    return R.single_accuracy(t.orders, F.col("o_orderstatus") == "F")


@query("f35_count_histogram", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type", ints="count")
def count_histogram(t):
    return R.count_histogram(t.events, "event_type")


@query("f36_mode_of_group", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type AS mode_value, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1", ints="n")
def mode_of_group(t):
    return R.mode_of_group(t.events, "user_id", "event_type")


RADAR = "p_brand, CAST(avg(p_size) AS DOUBLE) AS size, avg(p_retailprice) / 20 AS price"


def _radar(log):
    f, m = ("ln", 1.005) if log else ("", 1.25)
    scaled = lambda c: f"({f}({c}) - CASE WHEN m_{c} + span / 2 < 100 THEN m_{c} - span / 2 ELSE 100 - span END) / span * 100 AS {c}"

    @query(f"f37_radar_normalise_{'log' if log else 'linear'}", f"""WITH d AS (SELECT {RADAR} FROM part GROUP BY p_brand), e AS (SELECT (min({f}(size)) + max({f}(size))) / 2 AS m_size, (min({f}(price)) + max({f}(price))) / 2 AS m_price,
     greatest(max({f}(size)) - min({f}(size)), max({f}(price)) - min({f}(price))) * {m} AS span FROM d) SELECT p_brand, {scaled('size')}, {scaled('price')} FROM d, e""", "size price")
    def run(t):
        df = t.part.groupBy("p_brand").agg(F.avg("p_size").alias("size"), (F.avg("p_retailprice") / 20).alias("price"))
        return R.radar_normalise(df, ["size", "price"], log)


_radar(False)
_radar(True)


@query("f38_running_mean", "SELECT event_id, user_id, ts, value, sum(value) OVER w AS running_sum, count(*) OVER w AS running_count, avg(value) OVER w AS running_avg FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "running_sum running_avg", "running_count", digits=9)
def running_mean(t):
    return R.running_mean(t.events.select("event_id", "user_id", "ts", "value"), ["ts", "event_id"], "value", ["user_id"])


STEPS = """l_orderkey AS item, CASE WHEN l_returnflag = 'A' THEN 'recall' ELSE 'precision' END AS side, CASE l_linenumber % 3 WHEN 0 THEN 'Video' WHEN 1 THEN 'logic' ELSE 'background' END AS step_type,
 CASE WHEN l_quantity > 20 THEN 'Matched' WHEN l_returnflag = 'A' THEN 'Unmatched' WHEN l_quantity > 8 THEN 'Wrong' ELSE 'Redundant' END AS judgment"""


@query("f39_step_precision_recall", over("lineitem", STEPS, """, p AS (SELECT item, side, step_type AS metric, judgment FROM d UNION ALL SELECT item, side, 'overall', judgment FROM d),
 v AS (SELECT metric, side, count(*) FILTER (judgment = 'Matched') / nullif(count(*) FILTER (judgment = 'Matched' OR judgment = CASE side WHEN 'precision' THEN 'Wrong' ELSE 'Unmatched' END), 0) AS v FROM p GROUP BY item, side, metric),
 m AS (SELECT metric, coalesce(avg(v) FILTER (side = 'precision'), 0) AS precision, coalesce(avg(v) FILTER (side = 'recall'), 0) AS recall FROM v WHERE v > 0 GROUP BY metric)
, e AS (SELECT item, count(*) FILTER (judgment <> 'Redundant') / count(*) AS e FROM d WHERE side = 'precision' GROUP BY item)
 SELECT *, 2 * precision * recall / (precision + recall) AS f1, CASE WHEN metric = 'overall' THEN (SELECT avg(e) FROM e) END AS efficiency FROM m"""), "precision recall f1 efficiency")
def step_precision_recall(t):
    return R.step_precision_recall(t.derive("lineitem", STEPS))


STAGES = "doc_id AS qid, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id + quality) % 3 END AS step_1, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE toxic END AS step_2"


@query("f40_staged_judgement", over("labels", STAGES, """ SELECT *, CAST(CASE WHEN step_1 IN (0, 1) THEN step_1 WHEN step_1 = 2 AND step_2 IN (0, 1) THEN step_2 ELSE -1 END AS DOUBLE) AS score,
 CASE WHEN step_1 IN (0, 1) THEN 'step_1' WHEN step_1 = 2 AND step_2 IN (0, 1) THEN 'step_2' ELSE 'failed' END AS stage FROM d"""), "score", "step_1 step_2")
def staged_judgement(t):
    return R.staged_judgement(t.derive("labels", STAGES))


COMBINED = "source, lang, CASE WHEN n_chars % 2 = 0 THEN 'maths' ELSE 'physics' END AS topic, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS hit"


@query("f41_combined_label_report", over("documents", COMBINED, sets_sql({"source": ["source"], "combined": ["lang", "topic"], "part": ["topic"], "overall": []}, "avg(hit) * 100 AS acc, count(*) AS n")), "acc", "n")
def combined_label_report(t):
    return R.combined_label_report(t.derive("documents", COMBINED), ["lang", "topic"])


@query("f42_companion_score", over("orders", FETCHED, f"""SELECT category AS subject, {_RATES} FROM d GROUP BY category UNION ALL SELECT 'Overall', {_RATES} FROM d
 UNION ALL SELECT category || '_RP', count(*), 0, 0, 0.0, avg(reason) * 100 FROM d GROUP BY category UNION ALL SELECT 'Overall_RP', count(*), 0, 0, 0.0, avg(reason) * 100 FROM d"""), "prefetch_rate acc", "tot prefetch hit")
def companion_score(t):
    return R.companion_score(t.derive("orders", FETCHED), "reason")


# each passage is asked in four rotations; the length of its text decides whether and in which one the answer is wrong
TURNED = """WITH r AS (SELECT item_id, length(text) AS n, i FROM benchmark, (SELECT unnest(range(4)) AS i) x),
 d AS (SELECT item_id + 10000000000 * i AS idx, item_id AS g_index, concat('length ', CAST(n % 3 AS VARCHAR(9))) AS category, substr('ABCD', CAST((item_id + 4 - i) % 4 + 1 AS INTEGER), 1) AS answer,
  substr('ABCD', CAST((item_id + 4 - i + CASE WHEN n % 5 = 0 AND n % 4 = i THEN 1 ELSE 0 END) % 4 + 1 AS INTEGER), 1) AS said FROM r)"""


@query("entry_circular_accuracy", TURNED + """, g AS (SELECT g_index, category, min(CASE WHEN answer = said THEN 1.0 ELSE 0.0 END) AS hit FROM d GROUP BY ALL)
 SELECT 'none' AS split, 'overall' AS dim, 'all' AS value, avg(hit) AS acc, count(*) AS n FROM g UNION ALL SELECT 'none', 'category', category, avg(hit), count(*) FROM g GROUP BY category""", "acc", "n")
def entry_circular_accuracy(t):
    """Predictions joined with rotated answers, the choice extracted by name, scored by rotation groups and reported by category."""
    from scorewright.evaluate import Spec, evaluate
    rotated = t.benchmark.select("item_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    letter = lambda shift: F.get(F.split(F.lit("A,B,C,D"), ","), ((F.col("item_id") + 4 - F.col("i") + shift) % 4).cast("int"))
    wrong = F.when((F.col("n") % 5 == 0) & (F.col("n") % 4 == F.col("i")), 1).otherwise(0)
    options = F.create_map(*[F.lit(x) for a in "ABCD" for x in (a, f"passage {a} text")])
    idx = (F.col("item_id") + F.lit(10**10) * F.col("i")).alias("idx")
    answers = rotated.select(idx, F.col("item_id").alias("g_index"), F.concat(F.lit("length "), (F.col("n") % 3).cast("string")).alias("category"), letter(0).alias("answer"), options.alias("options"))
    predictions = rotated.select(idx, F.concat(F.lit("The answer is "), letter(wrong), F.lit(".")).alias("prediction"))
    return evaluate(predictions, answers, Spec(extract="infer", extract_from=("prediction", "options"), grouping="circular"))


@query("entry_accuracy_by_source", """WITH d AS (SELECT lang, source, doc_id, CASE WHEN n_chars % 2 = 0 THEN text ELSE lower(text) END AS prediction, text AS answer FROM documents)
 SELECT lang, source, avg(CASE WHEN prediction = answer THEN 1.0 ELSE 0.0 END) AS acc, count(*) AS n FROM d GROUP BY lang, source""", "acc", "n")
def entry_accuracy_by_source(t):
    from scorewright.functions.score import exact
    df = t.derive("documents", "lang, source, doc_id, CASE WHEN n_chars % 2 = 0 THEN text ELSE lower(text) END AS prediction, text AS answer")
    hit = exact(F.col("prediction"), F.col("answer"), ignore_case=False)
    return df.withColumn("hit", hit).groupBy("lang", "source").agg(F.avg("hit").alias("acc"), F.count(F.lit(1)).alias("n"))
