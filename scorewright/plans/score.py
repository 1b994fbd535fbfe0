"""Row score queries (D) over prediction and answer pairs derived from the tables."""

from pyspark.sql import functions as F

from scorewright.functions import score as S
from scorewright.functions.text import words
from scorewright.operators import intervals, line_match, matching
from scorewright.operators.skew import spread, tasks_for
from scorewright.plans.catalog import over, query
from scorewright.plans.text import ACCENTS, map_sql, normalise_sql, plain, quoted

c = F.col
ARR = lambda *names: F.array(*[c(n) for n in names])


def scored(name, table, select, sql, column, cte="", doubles="score", **kw):
    """A query of ``idx`` and one score."""
    @query(name, over(table, select, f"{cte} SELECT idx, {sql} AS score FROM d"), doubles, **kw)
    def run(t):
        return t.derive(table, select, deal=True).select("idx", column().alias("score"))


PASS = f"item_id AS idx, CASE item_id % 3 WHEN 0 THEN upper({plain('text')}) WHEN 1 THEN concat('  ', {plain('text')}, ' ') ELSE concat(text, '.') END AS pred, {plain('text')} AS gold"
scored("d01_exact", "benchmark", PASS, "CASE WHEN lower(trim(pred)) = lower(trim(gold)) THEN 1.0 ELSE 0 END", lambda: S.exact(c("pred"), c("gold")))

# each document is asked for one passage by position, over all passages; passages occur inside some documents


@query("d02_contains_answer", """WITH g AS (SELECT item_id, text FROM benchmark), p AS (SELECT doc_id AS idx, text AS pred, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents)
 SELECT idx, CASE WHEN contains(lower(replace(trim(pred), chr(10), ' ')), lower(replace(trim(g.text), chr(10), ' '))) OR contains(lower(replace(trim(pred), chr(10), ' ')), lower(replace(trim(g.text || '.'), chr(10), ' '))) THEN 1.0 ELSE 0 END AS score,
 CASE WHEN contains(replace(replace(trim(pred), chr(10), ' '), ' ', ''), replace(replace(trim(g.text), chr(10), ' '), ' ', '')) THEN 1.0 ELSE 0 END AS formula FROM p JOIN g USING (item_id)""", "score formula")
def contains_answer(t):
    gold = t.benchmark.select("item_id", c("text").alias("gold"))
    items = t.benchmark.agg(F.count(F.lit(1))).scalar()
    df = t.documents.select(c("doc_id").alias("idx"), c("text").alias("pred"), (c("doc_id") % items).alias("item_id")).join(gold, "item_id")
    golds = F.array(c("gold"), F.concat("gold", F.lit(".")))
    return df.select("idx", S.contains_answer(c("pred"), golds).alias("score"), S.contains_answer(c("pred"), F.array(F.trim("gold")), formula=True).alias("formula"))


VOTES = "o_orderkey AS idx, concat('w', CAST(o_custkey % 3 AS VARCHAR(9))) AS pred, concat('w', CAST(o_orderkey % 3 AS VARCHAR(9))) AS a, concat('w', CAST(o_orderkey % 2 AS VARCHAR(9))) AS b, 'w1' AS e, concat('w', CAST(o_custkey % 2 AS VARCHAR(9))) AS f"
_SAME = "len(list_filter([a, b, e, f], lambda g: g = pred))"


@query("d03_consensus", over("orders", VOTES, "SELECT idx, " + ", ".join(f"least(1.0, ({_SAME} - CASE WHEN {g} = pred THEN 1 ELSE 0 END) / 3) AS m{i}" for i, g in enumerate("abef")) + " FROM d"), "m0 m1 m2 m3")
def consensus(t):
    df = t.derive("orders", VOTES).withColumn("m", S.consensus(c("pred"), ARR("a", "b", "e", "f")))
    return df.select("idx", *[F.get("m", F.lit(i)).alias(f"m{i}") for i in range(4)])


NORM = "item_id AS idx, concat(text, ' The one') AS pred, concat(text, ' 1!') AS a, text AS b"


@query("d03_vqa_consensus", over("benchmark", NORM, f"SELECT idx, CASE WHEN {normalise_sql('pred')} = {normalise_sql('a')} THEN 0 ELSE 0 END + least(1.0, (CASE WHEN {normalise_sql('pred')} = {normalise_sql('b')} THEN 1 ELSE 0 END) / 3) AS m0, least(1.0, (CASE WHEN {normalise_sql('pred')} = {normalise_sql('a')} THEN 1 ELSE 0 END) / 3) AS m1 FROM d"), "m0 m1")
def vqa_consensus(t):
    df = t.derive("benchmark", NORM).withColumn("m", S.vqa_consensus(c("pred"), ARR("a", "b")))
    return df.select("idx", F.get("m", F.lit(0)).alias("m0"), F.get("m", F.lit(1)).alias("m1"))


@query("d04_default_vqa", over("benchmark", NORM, f"SELECT idx, CASE WHEN {normalise_sql('pred')} = {normalise_sql('a')} THEN 1.0 ELSE 0 END AS m0, CASE WHEN {normalise_sql('pred')} = {normalise_sql('b')} THEN 1.0 ELSE 0 END AS m1 FROM d"), "m0 m1")
def default_vqa(t):
    df = t.derive("benchmark", NORM).withColumn("m", S.default_vqa(c("pred"), ARR("a", "b")))
    return df.select("idx", F.get("m", F.lit(0)).alias("m0"), F.get("m", F.lit(1)).alias("m1"))


TURNS = f"concat(CAST(conv_id AS VARCHAR(20)), ':', CAST(turn AS VARCHAR(20))) AS idx, {plain('text')} AS gold, concat(' ', upper(substr({plain('text')}, 1, 30)), replace(substr({plain('text')}, 31), 'e', CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'e' END)) AS pred"
_FOLD = lambda x: f"array_to_string(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> ''), ' ')"
_LONG = "greatest(length(gold), length(pred))"


@query("d05_edit_ratio", over("conversations", TURNS, f"SELECT idx, CASE WHEN {_LONG} = 0 THEN 0.0 ELSE levenshtein({_FOLD('gold')}, {_FOLD('pred')}) / {_LONG} END AS score FROM d"), "score")
def edit_ratio(t):
    return t.derive("conversations", TURNS, deal=True).select("idx", S.edit_ratio(c("gold"), c("pred")).alias("score"))


SHORT = f"concat(CAST(conv_id AS VARCHAR(20)), ':', CAST(turn AS VARCHAR(20))) AS idx, {plain('text')} AS gold, replace({plain('text')}, CASE WHEN conv_id % 2 = 0 THEN 'e' ELSE ' ' END, CASE WHEN turn % 2 = 0 THEN '' ELSE 'xx' END) AS pred"
_A = f"CASE WHEN {_LONG} = 0 THEN 1.0 ELSE 1 - levenshtein(gold, pred) / {_LONG} END"


@query("d06_anls", over("conversations", SHORT, f"SELECT idx, CASE WHEN {_A} <= 0.5 THEN 0 ELSE {_A} END AS score, CASE WHEN {_A} < 0.5 THEN 0 ELSE {_A} END AS strict FROM d"), "score strict")
def anls(t):
    return t.derive("conversations", SHORT, deal=True).select("idx", S.anls(c("gold"), c("pred")).alias("score"), S.anls(c("gold"), c("pred"), strict=True).alias("strict"))


NUMBERS = """o_orderkey AS idx, CASE o_orderkey % 5 WHEN 0 THEN concat(CAST(o_custkey % 90 AS VARCHAR(9)), '%') WHEN 1 THEN 'Paris' ELSE CAST(o_custkey % 50 AS VARCHAR(9)) END AS pred,
 CASE o_orderkey % 5 WHEN 0 THEN CAST((o_custkey % 90 + 3) / 100e0 AS VARCHAR(30)) WHEN 1 THEN 'paris' ELSE CAST(o_custkey % 50 + o_orderkey % 4 AS VARCHAR(9)) END AS gold"""
_NUM = lambda x: f"CASE WHEN ends_with({x}, '%') THEN try_cast(rtrim({x}, '%') AS DOUBLE) / 100 ELSE try_cast({x} AS DOUBLE) END"


def _relaxed(base, other):
    return f"CASE WHEN {_NUM(base)} IS NOT NULL AND {_NUM(other)} IS NOT NULL AND {_NUM(base)} <> 0 THEN CASE WHEN abs({_NUM(other)} - ({_NUM(base)})) / abs({_NUM(base)}) <= 0.05 THEN 1.0 ELSE 0 END ELSE CASE WHEN lower(pred) = lower(gold) THEN 1.0 ELSE 0 END END"


@query("d07_relaxed_number", over("orders", NUMBERS, f"SELECT idx, {_relaxed('pred', 'gold')} AS score, {_relaxed('gold', 'pred')} AS by_gold FROM d"), "score by_gold")
def relaxed_number(t):
    return t.derive("orders", NUMBERS).select("idx", S.relaxed_number(c("pred"), c("gold")).alias("score"), S.relaxed_number(c("pred"), c("gold"), denominator="gold").alias("by_gold"))


CLOSE = "o_orderkey AS idx, CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(o_custkey % 90 + 1 AS VARCHAR(9)), '%') WHEN 1 THEN 'n/a' ELSE CAST((o_custkey % 90 + 1) * (1 + o_orderkey % 3 / 128e0) AS VARCHAR(30)) END AS pred, CAST(CASE WHEN o_custkey % 2 = 0 THEN (o_custkey % 90 + 1) / 100e0 ELSE o_custkey % 90 + 1e0 END AS VARCHAR(30)) AS gold"


@query("d08_close_number", over("orders", CLOSE, """, n AS (SELECT idx, try_cast(rtrim(pred, '%') AS DOUBLE) AS p, CAST(gold AS DOUBLE) AS g FROM d)
 SELECT idx, CASE WHEN p IS NOT NULL AND (abs(g / 100 - p) <= 0.01 * greatest(abs(g / 100), abs(p)) OR abs(g - p) <= 0.01 * greatest(abs(g), abs(p)) OR abs(g * 100 - p) <= 0.01 * greatest(abs(g * 100), abs(p))) THEN 1.0 ELSE 0 END AS score FROM n"""), "score")
def close_number(t):
    return t.derive("orders", CLOSE).select("idx", S.close_number(c("gold"), c("pred")).alias("score"))


TYPED = """o_orderkey AS idx, CASE o_orderkey % 4 WHEN 0 THEN 'Int' WHEN 1 THEN 'Float' WHEN 2 THEN 'Str' ELSE 'List' END AS kind, CASE o_orderkey % 4 WHEN 2 THEN CASE WHEN o_custkey % 3 = 0 THEN 'page 4' ELSE '"Red Apple" (big)' END ELSE CAST(o_custkey % 20 + 1 AS VARCHAR(9)) END AS gold,
 CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(o_custkey % 20 + o_custkey % 2 + 1 AS VARCHAR(9)), '.4') WHEN 1 THEN CAST(o_custkey % 20 + o_custkey % 3 + 1 AS VARCHAR(9)) WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 'red apples' ELSE 'Page 4' END ELSE '7' END AS pred,
 CASE WHEN o_custkey % 2 = 0 THEN 'green tea' ELSE '12' END AS g1, CASE WHEN o_custkey % 5 = 0 THEN 'green pea' ELSE '12' END AS p1"""


@query("d09_typed_score", over("orders", TYPED, """ SELECT idx, CASE kind WHEN 'Int' THEN CASE WHEN CAST(gold AS INT) = floor(CAST(pred AS DOUBLE)) THEN 1.0 ELSE 0 END WHEN 'Float' THEN CASE WHEN gold = pred OR abs(CAST(gold AS DOUBLE) - CAST(pred AS DOUBLE)) <= 0.01 * greatest(CAST(gold AS DOUBLE), CAST(pred AS DOUBLE)) THEN 1.0 ELSE 0 END
  WHEN 'Str' THEN CASE WHEN gold = 'page 4' THEN CASE WHEN lower(pred) = 'page 4' THEN 1.0 ELSE 0 END WHEN pred = 'red apples' THEN 0.9 ELSE 0 END
  ELSE CASE WHEN g1 = '12' OR p1 = '12' THEN CASE WHEN g1 = p1 THEN 1.0 ELSE 0 END ELSE 1 - 1 / 9 END END AS score FROM d"""), "score")
def typed_score(t):
    # the lists hold one changing and one fixed text
    df = t.derive("orders", TYPED)
    return df.select("idx", S.typed_score(c("gold"), c("pred"), c("kind"), F.array(c("g1"), F.lit("zz")), F.array(F.lit("zz"), c("p1"))).alias("score"))


scored("d10_numeric_equal", "orders", NUMBERS, "CASE WHEN lower(pred) = lower(gold) OR coalesce(abs(try_cast(pred AS DOUBLE) - try_cast(gold AS DOUBLE)) < 1e-6, false) THEN 1.0 ELSE 0 END", lambda: S.numeric_equal(c("pred"), c("gold")))

WORDS = f"item_id AS idx, {plain('text')} AS pred, split_part(text, ' ', 3) AS a, concat(split_part(text, ' ', 5), 'x') AS b, split_part(text, ' ', 4) AS e"
_AN = normalise_sql("pred")
_HAS = lambda g: f"({normalise_sql(g)} = '' OR contains(' ' || {_AN} || ' ', ' ' || {normalise_sql(g)} || ' '))"


@query("d11_word_match", over("benchmark", WORDS, f"SELECT idx, CASE WHEN {_HAS('b')} OR {_HAS('e')} THEN 1.0 ELSE 0 END AS score, CASE WHEN {_HAS('b')} THEN 1.0 WHEN {_HAS('a')} THEN 0.5 WHEN {_HAS('e')} THEN 1 / 3 ELSE 0 END AS rank FROM d"), "score rank")
def word_match(t):
    df = t.derive("benchmark", WORDS)
    return df.select("idx", S.word_match(c("pred"), ARR("b", "e")).alias("score"), S.reciprocal_rank(c("pred"), ARR("b", "a", "e")).alias("rank"))


LISTS = "o_orderkey AS idx, o_custkey % 2 AS p0, o_custkey % 3 AS p1, o_custkey % 5 AS p2, o_orderkey % 2 AS g0, o_orderkey % 3 AS g1, o_orderkey % 5 AS g2, o_orderkey % 4 AS g3"
scored("d12_aligned_list_accuracy", "orders", LISTS, "(CASE WHEN p0 = g0 THEN 1 ELSE 0 END + CASE WHEN p1 = g1 THEN 1 ELSE 0 END + CASE WHEN p2 = g2 THEN 1 ELSE 0 END) / 4", lambda: S.aligned_list_accuracy(ARR("p0", "p1", "p2"), ARR("g0", "g1", "g2", "g3")))

_TOK = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
BAGS = "doc_id AS idx, text AS gold, lower(text) AS pred"
BAG_SQL = f"""g AS (SELECT idx, w, count(*) AS n FROM (SELECT idx, unnest({_TOK('gold')}) AS w FROM d) GROUP BY ALL), p AS (SELECT idx, w, count(*) AS n FROM (SELECT idx, unnest({_TOK('pred')}) AS w FROM d) GROUP BY ALL),
 o AS (SELECT idx, sum(least(coalesce(g.n, 0), coalesce(p.n, 0))) AS rgt, sum(coalesce(g.n, 0)) AS gold_tokens, sum(coalesce(p.n, 0)) AS pred_tokens FROM g FULL JOIN p USING (idx, w) GROUP BY idx)"""


@query("d13_bag_overlap", over("documents", BAGS, f", {BAG_SQL} SELECT idx, coalesce(rgt, 0) AS \"right\", coalesce(gold_tokens, 0) AS gold_tokens, coalesce(pred_tokens, 0) AS pred_tokens FROM d LEFT JOIN o USING (idx)"), ints="right gold_tokens pred_tokens")
def bag_overlap(t):
    return matching.bag_overlap(t.derive("documents", BAGS, deal=True), "idx", words(c("gold")), words(c("pred")))


MEMBER = "doc_id AS idx, text AS gold, lower(text) AS pred"
scored("d14_token_f1", "documents", MEMBER, f"(SELECT CASE WHEN z.h = 0 OR z.h IS NULL THEN 0.0 ELSE 2 * (z.h / z.g) * (z.h / z.p) / (z.h / z.g + z.h / z.p) END FROM (SELECT len(list_filter({_TOK('pred')}, lambda w: list_contains({_TOK('gold')}, w))) AS h, len({_TOK('gold')}) AS g, len({_TOK('pred')}) AS p) z)", lambda: S.token_f1(c("gold"), c("pred")))

_SETS = lambda x: f"list_distinct({_TOK(x)})"


@query("d15_set_scores", over("conversations", TURNS, f""", s AS (SELECT idx, {_SETS('gold')} AS g, {_SETS('pred')} AS p, {_SETS('lower(gold)')} AS gl, {_SETS('lower(pred)')} AS pl FROM d)
 SELECT idx, len(list_intersect(p, g)) / (len(p) + len(g) - len(list_intersect(p, g))) AS jaccard, len(list_intersect(pl, gl)) / (len(pl) + len(gl) - len(list_intersect(pl, gl))) AS jaccard_ci,
 CASE WHEN list_sort(pl) = list_sort(gl) THEN 1.0 ELSE 0 END AS equal_ci, CASE WHEN list_sort(p) = list_sort(g) THEN 1.0 ELSE 0 END AS equal, len(list_intersect(p, g)) / len(p) AS precision FROM s"""), "jaccard jaccard_ci equal_ci equal precision")
def set_scores(t):
    df = t.derive("conversations", TURNS).select("idx", F.array_distinct(words(c("gold"))).alias("g"), F.array_distinct(words(c("pred"))).alias("p"))
    g, p = c("g"), c("p")
    return df.select("idx", S.jaccard(p, g).alias("jaccard"), S.jaccard(p, g, True).alias("jaccard_ci"), S.set_equality(p, g, True).alias("equal_ci"), S.set_equality(p, g).alias("equal"), S.set_precision(p, g).alias("precision"))


@query("d16_sequence_scores", over("conversations", TURNS, f""", s AS (SELECT idx, {_TOK('gold')} AS g, {_TOK('pred')} AS p FROM d), f AS (SELECT idx, g, p, list_position(list_transform(range(1, least(len(g), len(p)) + 1), lambda i: g[i] = p[i]), false) AS miss FROM s)
 SELECT idx, CASE WHEN g = p THEN 1.0 ELSE 0 END AS equal, CASE WHEN list_transform(g, lambda x: lower(x)) = list_transform(p, lambda x: lower(x)) THEN 1.0 ELSE 0 END AS equal_ci, CASE WHEN coalesce(miss, 0) > 0 THEN miss - 1 ELSE least(len(g), len(p)) END / len(g) AS prefix,
 CASE WHEN len(g) <> len(p) THEN 0 ELSE len(list_filter(range(1, len(g) + 1), lambda i: lower(g[i]) = lower(p[i]))) / len(g) END AS accuracy FROM f"""), "equal equal_ci prefix accuracy")
def sequence_scores(t):
    df = t.derive("conversations", TURNS).select("idx", words(c("gold")).alias("g"), words(c("pred")).alias("p"))
    g, p = c("g"), c("p")
    return df.select("idx", S.sequence_equality(p, g).alias("equal"), S.sequence_equality(p, g, True).alias("equal_ci"), S.prefix_ratio(p, g).alias("prefix"), S.sequence_accuracy(p, g).alias("accuracy"))


DICTS = "p_partkey AS idx, p_brand AS gb, p_type AS gt, CASE WHEN p_size % 3 = 0 THEN 'Brand#1' ELSE p_brand END AS pb, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END AS pt, p_size % 5 AS extra"


@query("d17_dictionary_scores", over("part", DICTS, """ SELECT idx, CASE WHEN gb = pb AND gt = pt AND extra > 0 THEN 1.0 ELSE 0 END AS equal, (CASE WHEN gb = pb THEN 1 ELSE 0 END + CASE WHEN gt = pt THEN 1 ELSE 0 END) / 2 AS recall,
 (CASE WHEN gb = pb THEN 1 ELSE 0 END + CASE WHEN gt = pt THEN 1 ELSE 0 END) / (1 + CASE WHEN pt IS NULL THEN 0 ELSE 1 END + CASE WHEN extra = 0 THEN 1 ELSE 0 END) AS precision,
 (CASE WHEN gb = pb THEN 1 ELSE 1 / 3 END + CASE WHEN gt = pt THEN 1 ELSE 0 END) / (2 + CASE WHEN extra = 0 THEN 1 ELSE 0 END) AS mean_jaccard FROM d"""), "equal recall precision mean_jaccard")
def dictionary_scores(t):
    df = t.derive("part", DICTS)
    gold = F.create_map(F.lit("brand"), c("gb"), F.lit("type"), c("gt"))
    pred = F.map_filter(F.create_map(F.lit("brand"), c("pb"), F.lit("type"), c("pt"), F.lit("note"), F.when(c("extra") == 0, "n")), lambda _, v: v.isNotNull())
    lists = lambda m: F.transform_values(m, lambda k, v: F.when(k == "brand", F.array(v, F.lit("common"))).otherwise(F.array(v)))
    return df.select("idx", S.dict_equality(pred, gold).alias("equal"), S.dict_key_recall(pred, gold).alias("recall"), S.dict_precision(pred, gold).alias("precision"), S.dict_mean(lists(pred), lists(gold), S.jaccard).alias("mean_jaccard"))


DBOX = "l_orderkey * 100 + l_linenumber AS idx, l_partkey, l_suppkey, l_quantity AS q, l_tax * 100 AS k"


@query("d17_dictionary_box_overlap", """WITH d AS (SELECT l_quantity AS q, l_tax * 100 AS k, l_orderkey * 100 + l_linenumber AS idx, l_partkey, l_suppkey FROM lineitem),
 s AS (SELECT idx, l_partkey, l_suppkey, greatest(0, least(q + 10, q + k + 10) - (q + k)) * 10 AS i FROM d) SELECT idx, l_partkey, l_suppkey, (i / (200 - i) + 1.0) / 3 AS score FROM s""", "score")
def dictionary_box_overlap(t):
    # boxes 10 wide and high; the predicted car box is shifted by k, the second key has equal boxes, the third is missing
    box = lambda x: F.array(F.array(x, F.lit(0.0), x + 10, F.lit(10.0)))
    gold = F.create_map(F.lit("car"), box(c("q")), F.lit("bus"), box(c("k")), F.lit("dog"), box(c("k")))
    pred = F.create_map(F.lit("car"), box(c("q") + c("k")), F.lit("bus"), box(c("k")))
    return t.derive("lineitem", DBOX, deal=True).select("idx", "l_partkey", "l_suppkey", S.dict_mean(pred, gold, S.boxes_mean_iou).alias("score"))


STRINGS = "p_partkey AS idx, p_name AS gold, CASE p_size % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN concat('the ', p_name, 's') WHEN 3 THEN p_name ELSE '(B). x' END AS pred, CASE WHEN p_size % 5 = 4 THEN 'B' ELSE p_name END AS letter_gold, p_type AS alt"
_SQ = lambda x: f"lower(translate({x}, ' -.', ''))"
_BARE = lambda x: f"lower(trim(regexp_replace(regexp_replace({x}, '(?i)\\b(the|an|a)\\b', '', 'g'), '\\s+', ' ', 'g')))"
_NEAR = f"1 - levenshtein({_BARE('pred')}, {_BARE('gold')}) / greatest(length({_BARE('pred')}), length({_BARE('gold')}))"


@query("d18_string_matches", over("part", STRINGS, f"""SELECT idx, CASE WHEN letter_gold = 'B' OR pred = letter_gold THEN 1.0 ELSE 0 END AS exact, CASE WHEN lower(pred) = lower(gold) THEN 1.0 ELSE 0 END AS exact_ci, CASE WHEN {_SQ('pred')} = {_SQ('gold')} THEN 1.0 ELSE 0 END AS simple,
 CASE WHEN {_NEAR} >= 0.9 THEN {_NEAR} ELSE 0 END AS near, CASE WHEN {_SQ('pred')} IN ({_SQ('gold')}, {_SQ('alt')}) THEN 1.0 ELSE 0 END AS multi FROM d"""), "exact exact_ci simple near multi")
def string_matches(t):
    p, g = c("pred"), c("gold")
    return t.derive("part", STRINGS).select("idx", S.exact_string(p, c("letter_gold")).alias("exact"), S.exact(p, g).alias("exact_ci"), S.simple_string(p, g).alias("simple"), S.near_string(p, g).alias("near"), S.multi_reference(p, ARR("gold", "alt")).alias("multi"))


@query("d18_positive_int", over("orders", "o_orderkey AS idx, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE CAST(o_custkey % 5 - 2 AS VARCHAR(9)) END AS pred, CAST(o_orderkey % 4 - 1 AS VARCHAR(9)) AS gold", "SELECT idx, CASE WHEN pred = 'x' THEN 0 WHEN CAST(gold AS INT) <= 0 AND CAST(pred AS INT) <= 0 THEN -1 WHEN gold = pred THEN 1 ELSE 0 END AS score FROM d"), "score")
def positive_int(t):
    df = t.derive("orders", "o_orderkey AS idx, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE CAST(o_custkey % 5 - 2 AS VARCHAR(9)) END AS pred, CAST(o_orderkey % 4 - 1 AS VARCHAR(9)) AS gold")
    return df.select("idx", S.positive_int(c("pred"), c("gold")).alias("score"))


@query("d18_damerau_similarity", over("part", STRINGS, "SELECT idx, 1 - damerau_levenshtein(pred, gold) / greatest(length(pred), length(gold)) AS score FROM d"), "score")
def damerau_similarity(t):
    return t.derive("part", STRINGS).select("idx", S.damerau_similarity(c("pred"), c("gold")).alias("score"))


@query("d19_numeric_scores", """WITH d AS (SELECT vec_id AS idx, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS g, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 1.25) AS p FROM embeddings),
 m AS (SELECT idx, g, p, list_avg(list_transform(range(1, len(g) + 1), lambda i: pow(p[i] - g[i], 2))) AS mse FROM d) SELECT idx, mse, 1 - least(sqrt(mse), 0.1) / 0.1 AS rmse, greatest(0, 1 - abs((p[1] - g[1]) / g[1])) AS relative FROM m""", "mse rmse relative")
def numeric_scores(t):
    df = t.embeddings.select(c("vec_id").alias("idx"), F.transform("embedding", lambda x: x.cast("double")).alias("g"))
    df = df.withColumn("p", F.transform("g", lambda x: x * 1.25))
    return df.select("idx", S.mean_square(c("p"), c("g")).alias("mse"), S.normalised_rmse(c("p"), c("g")).alias("rmse"), S.relative_difference(F.get("p", F.lit(0)), F.get("g", F.lit(0))).alias("relative"))


GENERAL = "o_orderkey AS idx, CASE o_orderkey % 5 WHEN 0 THEN concat('x = ', CAST(o_custkey % 90 + 1 AS VARCHAR(9)), '%') WHEN 1 THEN concat('$', CAST(o_custkey % 90 + 1.004 AS VARCHAR(20))) WHEN 2 THEN concat('\\\\boxed{', CAST(o_custkey % 90 + 2 AS VARCHAR(9)), '}') WHEN 3 THEN 'Red-box' ELSE 'n' END AS pred, CASE WHEN o_orderkey % 5 = 0 THEN CAST((o_custkey % 90 + 1) / 100e0 AS VARCHAR(20)) WHEN o_orderkey % 5 = 3 THEN 'red box' ELSE CAST(o_custkey % 90 + 1 AS VARCHAR(9)) END AS gold"
GENERAL_SQL = GENERAL.replace("\\\\boxed", "\\boxed")


@query("d19_general_number", over("orders", GENERAL_SQL, """, n AS (SELECT *, CASE WHEN starts_with(pred, 'x = ') THEN try_cast(rtrim(substr(pred, 5), '%') AS DOUBLE) / 100 WHEN starts_with(pred, '$') THEN try_cast(substr(pred, 2) AS DOUBLE) WHEN contains(pred, 'boxed') THEN try_cast(regexp_extract(pred, '\\{(.*)\\}', 1) AS DOUBLE) END AS p, try_cast(gold AS DOUBLE) AS g FROM d)
 SELECT idx, CASE WHEN p IS NOT NULL AND g IS NOT NULL THEN CASE WHEN abs(p - g) <= abs(g) * 0.01 THEN 1.0 ELSE 0 END WHEN pred = 'Red-box' THEN 1.0 ELSE 0 END AS score FROM n"""), "score")
def general_number(t):
    return t.derive("orders", GENERAL).select("idx", S.general_number(S.boxed(c("pred")), S.boxed(c("gold"))).alias("score"))


GEO = "c_custkey AS idx, c_acctbal / 200 AS lat1, c_nationkey * 7e0 AS lon1, c_acctbal / 200 + c_custkey % 5 * 0.3e0 AS lat2, c_nationkey * 7e0 + c_custkey % 3 * 0.5e0 AS lon2"
scored("d20_geo_proximity", "customer", GEO, "exp(-(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))) / 100)", lambda: S.geo_proximity(c("lat1"), c("lon1"), c("lat2"), c("lon2")))

POINTS = "o_orderkey AS idx, o_custkey % 100 / 100e0 AS x, o_orderkey % 100 / 100e0 AS y, o_custkey % 7 / 50e0 AS e"
scored("d21_coordinate_sequence", "orders", POINTS, "CASE WHEN idx % 10 = 0 THEN 0 ELSE (exp(-10 * e / sqrt(2)) + exp(-10 * sqrt(2) * e / sqrt(2))) / 2 END",
       lambda: S.coordinate_sequence(F.when(c("idx") % 10 == 0, F.array(F.array("x", "y"))).otherwise(F.array(F.array(c("x") + c("e"), c("y")), F.array(c("y") - c("e"), c("x") + c("e")))), F.array(F.array("x", "y"), F.array("y", "x"))))

BOX = "l_orderkey * 1000000000 + l_partkey AS idx, l_linenumber, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS dx, l_quantity / 2 AS w, 10e0 AS h"
_IW = "greatest(0, least(x + w, x + dx + w) - greatest(x, x + dx))"


@query("d22_box_iou", over("lineitem", BOX, f", i AS (SELECT *, {_IW} * h AS i FROM d) SELECT idx, l_linenumber, i / (2 * w * h - i) AS score, CASE WHEN x + dx + w / 2 BETWEEN x AND x + w THEN 1.0 ELSE 0 END AS centre FROM i"), "score centre")
def box_iou(t):
    gold = [c("x"), c("y"), c("x") + c("w"), c("y") + c("h")]
    pred = [c("x") + c("dx"), c("y"), c("x") + c("dx") + c("w"), c("y") + c("h")]
    return t.derive("lineitem", BOX).select("idx", "l_linenumber", S.box_iou(pred, gold).alias("score"), S.centre_in_box(pred, gold).alias("centre"))


CLICK = "o_orderkey AS idx, o_custkey % 600 AS x, o_custkey % 300 AS y, 100 + o_custkey % 50 AS w, 40 AS h, 800 AS iw, 600 AS ih, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 600 + o_orderkey % 160) / 800e0 ELSE o_custkey % 600 + o_orderkey % 160 + 2e0 END AS px, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 300 + 20) / 600e0 ELSE o_custkey % 300 + 20e0 END AS py"
_RX = "CASE WHEN px > 1 OR py > 1 THEN px / iw ELSE px END"
_RY = "CASE WHEN px > 1 OR py > 1 THEN py / ih ELSE py END"


@query("d23_click_in_box", over("orders", CLICK, f"SELECT idx, CASE WHEN {_RX} BETWEEN x / iw AND (x + w - 1) / iw AND {_RY} BETWEEN y / ih AND (y + h - 1) / ih THEN 1.0 ELSE 0 END AS score FROM d"), "score")
def click_in_box(t):
    box = S.relative_box(*[c(n) for n in ("x", "y", "w", "h", "iw", "ih")])
    return t.derive("orders", CLICK).select("idx", S.click_in_box(c("px"), c("py"), box, c("iw"), c("ih")).alias("score"))


@query("d24_point_distance_to_box", over("orders", CLICK, """, b AS (SELECT idx, CASE WHEN px > 1 OR py > 1 THEN px / iw ELSE px END AS px, CASE WHEN px > 1 OR py > 1 THEN py / ih ELSE py END AS py, x / iw AS a, y / ih AS b, (x + w - 1) / iw AS e, (y + h - 1) / ih AS f FROM d),
 s AS (SELECT idx, sqrt(pow(greatest(0, abs(px - (a + e) / 2) - (e - a) / 2), 2) + pow(greatest(0, abs(py - (b + f) / 2) - (f - b) / 2), 2)) AS distance FROM b) SELECT * FROM s WHERE distance > 0"""), "distance")
def point_distance_to_box(t):
    box = S.relative_box(*[c(n) for n in ("x", "y", "w", "h", "iw", "ih")])
    df, pixels = t.derive("orders", CLICK), (c("px") > 1) | (c("py") > 1)
    df = df.withColumns({"px": F.when(pixels, c("px") / c("iw")).otherwise(c("px")), "py": F.when(pixels, c("py") / c("ih")).otherwise(c("py"))})
    return df.select("idx", S.point_distance_to_box(c("px"), c("py"), box).alias("distance")).filter("distance > 0").orderBy(F.desc("distance"), "idx")


_EPOCH = "epoch_us(ts) / 1e6 - 1704067200"


def _spans(t):
    return t.events.select(c("user_id").alias("qid"), "event_id", "value", (F.unix_micros(c("ts").cast("timestamp")) / 1e6 - 1704067200).alias("s"))


@query("d25_interval_iou", f"""WITH d AS (SELECT user_id AS qid, {_EPOCH} AS s, value FROM events), m AS (SELECT qid, s AS t, 1 AS g, 0 AS p FROM d UNION ALL SELECT qid, s + value * 200, -1, 0 FROM d UNION ALL SELECT qid, s + 5000, 0, 1 FROM d UNION ALL SELECT qid, s + 5000 + value * 250, 0, -1 FROM d),
 w AS (SELECT qid, t, sum(g) OVER z AS gd, sum(p) OVER z AS pd, coalesce(lead(t) OVER (PARTITION BY qid ORDER BY t), t) - t AS len FROM m WINDOW z AS (PARTITION BY qid ORDER BY t))
 SELECT qid, sum(CASE WHEN gd > 0 AND pd > 0 THEN len ELSE 0 END) / sum(CASE WHEN gd > 0 OR pd > 0 THEN len ELSE 0 END) AS iou FROM w GROUP BY qid""", "iou")
def interval_iou(t):
    d = _spans(t)
    gold = d.select("qid", c("s").alias("start"), (c("s") + c("value") * 200).alias("end"))
    pred = d.select("qid", (c("s") + 5000).alias("start"), (c("s") + 5000 + c("value") * 250).alias("end"))
    return intervals.interval_iou(gold, pred, "qid")


ROWIV = "event_id AS idx, value AS v, user_id % 20 * 1e0 AS u"


@query("d25_interval_array_iou", over("events", ROWIV, """, m AS (SELECT idx, v AS a1, v + 12 AS a2, u AS b1, u + 25 AS b2, least(u + 5, 1000) AS c1 FROM d), o AS (SELECT *, greatest(0, least(a2, b2) - greatest(a1, b1)) AS cut FROM m) SELECT idx, cut / (12 + 25 - cut) AS score FROM o"""), "score")
def interval_array_iou(t):
    # two overlapping parts merge to [v, v + 12], three to [u, u + 25]
    a = F.array(F.array(c("v") + 4, c("v") + 12), F.array(c("v"), c("v") + 6))
    b = F.array(F.array(c("u"), c("u") + 9), F.array(c("u") + 20, c("u") + 25), F.array(c("u") + 8, c("u") + 20))
    return t.derive("events", ROWIV).select("idx", S.interval_array_iou(a, b).alias("score"))


COUNTED = "o_orderkey AS idx, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey % 6 END AS pred, o_orderkey % 5 AS gold, o_custkey % 4 + 2 AS images"
scored("d26_graded_count_score", "orders", COUNTED, "(SELECT CASE WHEN pred IS NULL THEN 0 WHEN pred = gold THEN 100 WHEN z.p < 1 THEN 100 * (1 - z.p) ELSE 0 END FROM (SELECT (4 / images) * pow(abs(pred - gold) / CASE WHEN greatest(gold - 1, images - gold) <= 0 THEN 1 ELSE greatest(gold - 1, images - gold) END, 0.1) AS p) z)", lambda: S.graded_count_score(c("pred"), c("gold"), c("images")))

GRP = "o_orderkey AS idx, CASE o_orderkey % 4 WHEN 0 THEN '(A) cat' WHEN 1 THEN '(A) or (B)' WHEN 2 THEN 'B) dog' ELSE '(B' END AS pred, CASE WHEN o_custkey % 2 = 0 THEN '(A)' ELSE '(B) dog' END AS gold"
scored("d27_single_option_match", "orders", GRP, "CASE WHEN len(regexp_extract_all(pred, '\\([A-Z]\\)')) <= 1 AND trim(split_part(pred, ')', 1)) = trim(split_part(gold, ')', 1)) THEN 1.0 ELSE 0 END", lambda: S.single_option_match(c("pred"), c("gold")))
CRPE = "o_orderkey AS idx, CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B. Dog' WHEN 2 THEN 'it is a DOG' ELSE 'E' END AS pred, CASE WHEN o_custkey % 2 = 0 THEN 'A. Cat' ELSE 'B. Dog' END AS gold"
scored("d28_first_char_or_phrase", "orders", CRPE, "CASE WHEN length(pred) = 1 OR regexp_matches(pred, '^[A-D]') THEN CASE WHEN pred[1] = gold[1] THEN 1.0 ELSE 0 END WHEN contains(lower(pred), lower(substr(gold, 5))) THEN 1.0 ELSE 0 END", lambda: S.first_char_or_phrase(c("gold"), c("pred")))
PAIRED = "o_orderkey AS idx, CASE o_orderkey % 5 WHEN 0 THEN '(A) walking' WHEN 1 THEN 'A. walking' WHEN 2 THEN 'B' WHEN 3 THEN 'there are three people' ELSE '(B) 3' END AS pred, CASE WHEN o_custkey % 2 = 0 THEN '(A) walking.' ELSE '(B) 3' END AS gold"
_PO = "CASE WHEN contains(split_part(lower(gold), ' ', 1), replace(split_part(lower(pred), ' ', 1), '.', '')) OR contains(split_part(lower(pred), ' ', 1), split_part(lower(gold), ' ', 1)) {} THEN 1.0 ELSE 0 END"


@query("d29_option_pair_match", over("orders", PAIRED, f"SELECT idx, {_PO.format('')} AS score, {_PO.format('OR contains(lower(pred), CASE WHEN gold = ' + quoted('(B) 3') + ' THEN ' + quoted('three') + ' ELSE ' + quoted('walking') + ' END)')} AS with_digits, CASE WHEN pred = 'B' OR contains(pred, 'B.') OR pred = '(B) 3' THEN 1.0 ELSE 0 END AS line FROM d"), "score with_digits line")
def option_pair_match(t):
    return t.derive("orders", PAIRED).select("idx", S.option_pair_match(c("pred"), c("gold")).alias("score"), S.option_pair_match(c("pred"), c("gold"), digits=True).alias("with_digits"), S.choice_or_line_match(c("pred"), F.lit("B"), F.lit("(B) 3")).alias("line"))


SHAPES = "o_orderkey AS idx, CASE o_orderkey % 7 WHEN 0 THEN 'None' WHEN 1 THEN 'three' WHEN 2 THEN '4' WHEN 3 THEN 'suv car' WHEN 4 THEN '0' WHEN 5 THEN 'Yes' ELSE 'sedan' END AS pred, CASE o_custkey % 5 WHEN 0 THEN 'No' WHEN 1 THEN '3' WHEN 2 THEN 'Yes' WHEN 3 THEN 'minivan' ELSE 'truck' END AS gold"
SYNONYMS = {"suv": "car", "minivan": "car", "sedan": "car", "truck": "truck"}
scored("d30_category_equal", "orders", SHAPES, f"(SELECT CASE WHEN lower(z.p) = lower(gold) OR (z.p = '0' AND gold = 'No') OR coalesce(MAP {{'three': '3'}}[lower(z.p)] = gold, false) OR (lower(gold) = 'yes' AND regexp_matches(z.p, '^[1-9]$')) OR coalesce({map_sql(SYNONYMS)}[split_part(lower(z.p), ' ', 1)] = {map_sql(SYNONYMS)}[split_part(lower(gold), ' ', 1)], false) THEN 1.0 ELSE 0 END FROM (SELECT CASE WHEN lower(pred) = 'none' THEN 'no' ELSE pred END AS p) z)",
       lambda: S.category_equal(c("pred"), c("gold"), SYNONYMS))
scored("d31_closeness", "events", "event_id AS idx, value / 500 AS gold, user_id / 200e0 AS pred", "greatest(0, (0.5 - abs(gold - pred)) / 0.5)", lambda: S.closeness(c("gold"), c("pred")))


@query("d32_penalised_fact_score", "WITH d AS (SELECT l_orderkey AS idx, avg(l_discount * 10) AS s, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT idx, s * CASE WHEN n > 10 THEN 1 ELSE exp(1 - 10 / n) END AS score FROM d", "score")
def penalised_fact_score(t):
    facts = t.lineitem.groupBy(c("l_orderkey").alias("idx")).agg(F.avg(c("l_discount") * 10).alias("s"), F.count(F.lit(1)).alias("n"))
    return facts.select("idx", (c("s") * S.fact_penalty(c("n"))).alias("score"))


NGRAM = "concat(CAST(conv_id AS VARCHAR(20)), ':', CAST(turn AS VARCHAR(20))) AS idx, concat(split_part({0}, ' ', 3), ' ', split_part({0}, ' ', 4), ' ', split_part({0}, ' ', 6)) AS needle, {0} AS hay".format(plain("text"))


_NGRAMS = f""", k AS (SELECT idx, needle, {_TOK('needle')} AS w, {_TOK('hay')} AS h FROM d), n AS (SELECT *, len(w) AS n FROM k),
 g AS (SELECT idx, needle, w, i, h[i:i + n - 1] AS g FROM (SELECT *, unnest(range(1, greatest(len(h) - n + 2, 1))) AS i FROM n)), f AS (SELECT *, array_to_string(g, ' ') AS t FROM g WHERE len(list_intersect(g, w)) > 0)"""
_BEST = """, b AS (SELECT idx, g, sim FROM s QUALIFY row_number() OVER (PARTITION BY idx ORDER BY sim DESC, i) = 1),
 j AS (SELECT k.idx, coalesce(b.g, []) AS g, k.w, coalesce(sim, 0) AS sim, len(list_intersect(coalesce(b.g, []), k.w)) AS c FROM k LEFT JOIN b USING (idx)),
 m AS (SELECT idx, sim AS max_sim, array_to_string(g, ' ') AS best, coalesce(c / nullif(len(list_distinct(g)), 0), 0) AS precision, coalesce(c / nullif(len(list_distinct(w)), 0), 0) AS recall, CASE WHEN len(g) = 0 THEN 0 ELSE c / (len(list_distinct(g)) + len(list_distinct(w)) - c) END AS jaccard, CASE WHEN len(g) > 0 AND g = w THEN 1.0 ELSE 0 END AS exact FROM j)
 SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m"""
_EDITED = f""", s AS (SELECT *, 1 - levenshtein(lower(needle_f), lower(t)) / greatest(length(needle), length(t)) AS sim FROM (SELECT *, array_to_string({_TOK('needle')}, ' ') AS needle_f FROM f))"""
# spans of two texts, each cut by its longest common block; a block's length is the longest run of equal characters from its two starts
_CUT = """SELECT z.*, i, j, coalesce(nullif(list_position(list_transform(range(least(ah - i, bh - j)), lambda q: substr(a, i + q + 1, 1) = substr(b, j + q + 1, 1)), false), 0) - 1, least(ah - i, bh - j)) AS size
   FROM (SELECT *, unnest(range(bl, bh)) AS j FROM (SELECT *, unnest(range(al, ah)) AS i FROM z)) z WHERE substr(a, i + 1, 1) = substr(b, j + 1, 1)
   QUALIFY row_number() OVER (PARTITION BY a, b, al, ah, bl, bh ORDER BY size DESC, i, j) = 1"""
_BLOCKS = f""", z AS (SELECT a, b, 0::BIGINT AS al, length(a)::BIGINT AS ah, 0::BIGINT AS bl, length(b)::BIGINT AS bh FROM (SELECT DISTINCT t AS a, needle AS b FROM f)
   UNION ALL SELECT a, b, x.al, x.ah, x.bl, x.bh FROM (SELECT a, b, unnest([{{'al': al, 'ah': i, 'bl': bl, 'bh': j}}, {{'al': i + size, 'ah': ah, 'bl': j + size, 'bh': bh}}]) AS x FROM ({_CUT})) WHERE x.al < x.ah AND x.bl < x.bh),
 y AS (SELECT a, b, sum(size) AS size FROM ({_CUT}) GROUP BY ALL), s AS (SELECT f.*, coalesce(2 * size / (length(t) + length(needle)), 0) AS sim FROM f LEFT JOIN y ON y.a = t AND y.b = needle)"""


@query("d33_best_ngram_match", over("conversations", NGRAM, _NGRAMS + _EDITED + _BEST), "max_sim precision recall f1 jaccard exact")
def best_ngram_match(t):
    return matching.best_ngram_match(t.derive("conversations", NGRAM), "idx", "needle", "hay", words, similarity="edit")


@query("d33_best_ngram_match_blocks", over("conversations", NGRAM, _NGRAMS + _BLOCKS + _BEST).replace("WITH d", "WITH RECURSIVE d", 1), "max_sim precision recall f1 jaccard exact")
def best_ngram_match_blocks(t):
    return matching.best_ngram_match(t.derive("conversations", NGRAM), "idx", "needle", "hay", words)


TABLE = "o_orderkey AS idx, CASE WHEN o_custkey % 2 = 0 THEN '1,200' ELSE '\"Blue Sky\" (note)' END AS a, CASE WHEN o_custkey % 3 = 0 THEN '2001-3-05' ELSE 'x' END AS b, CASE WHEN o_orderkey % 2 = 0 THEN '1200.0' ELSE 'blue sky.' END AS e, CASE WHEN o_orderkey % 3 = 0 THEN '2001-03-05' ELSE 'X[1]' END AS f"
scored("d34_table_lists_equal", "orders", TABLE, "CASE WHEN ((a = '1,200') = (e = '1200.0')) AND ((b = '2001-3-05') = (f = '2001-03-05')) THEN 1.0 ELSE 0 END", lambda: S.table_lists_equal(ARR("f", "e", "f"), ARR("a", "b")))
CELLS = """o_orderkey AS idx, o_orderkey % 4 AS kind, o_custkey % 50 AS k, CASE o_orderkey % 4 WHEN 0 THEN concat('$', CAST(o_custkey % 50 AS VARCHAR(9)), ' million dollars.') WHEN 1 THEN concat(CAST(o_custkey % 50 AS VARCHAR(9)), ' Thousand shares')
 WHEN 2 THEN concat(CAST(o_custkey % 50 AS VARCHAR(9)), ' %') ELSE CAST(o_custkey % 50 + 1 AS VARCHAR(9)) END AS pred,
 CASE o_orderkey % 4 WHEN 0 THEN concat('(', CAST(o_custkey % 50 AS VARCHAR(9)), ',000,000) (note)') WHEN 2 THEN concat('0.', lpad(CAST(o_custkey % 50 AS VARCHAR(9)), 2, '0')) ELSE CAST(o_custkey % 50 AS VARCHAR(9)) END AS gold"""


@query("d34_finance_table_equal", over("orders", CELLS, "SELECT idx, CASE WHEN kind IN (0, 2) OR (kind = 1 AND k = 0) THEN 1.0 ELSE 0 END AS exact, CASE WHEN kind < 3 THEN 1.0 ELSE 0 END AS relaxed FROM d"), "exact relaxed")
def finance_table_equal(t):
    return t.derive("orders", CELLS).select("idx", S.finance_scores(c("pred"), c("gold")).alias("s")).select("idx", "s.exact", "s.relaxed")


TEQ = "o_orderkey AS idx, CASE o_orderkey % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'float' ELSE 'text' END AS kind, concat(CAST(o_custkey % 4 AS VARCHAR(9)), CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '' END) AS pred, CAST(o_orderkey % 4 AS VARCHAR(9)) AS gold"
scored("d35_typed_equal", "orders", TEQ, "CASE WHEN CASE kind WHEN 'integer' THEN NOT contains(pred, '.') AND pred = gold WHEN 'float' THEN CAST(pred AS DOUBLE) = CAST(gold AS DOUBLE) ELSE pred = gold END THEN 1.0 ELSE 0 END", lambda: S.typed_equal(c("pred"), c("gold"), c("kind")))
scored("d36_line_edit_similarity", "conversations", SHORT, f"levenshtein(gold, pred) / nullif({_LONG}, 0)", lambda: S.line_edit_similarity(c("gold"), c("pred")))


@query("d37_reading_order_error", """WITH g AS (SELECT conv_id, list(turn ORDER BY turn) AS gold, list(turn ORDER BY length(text), turn) AS pred FROM conversations GROUP BY conv_id),
 s AS (SELECT conv_id, array_to_string(gold, '') AS a, array_to_string(pred, '') AS b FROM g) SELECT conv_id, levenshtein(a, b) / greatest(length(a), length(b)) AS score FROM s""", "score")
def reading_order_error(t):
    lists = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("gold"), F.transform(F.sort_array(F.collect_list(F.struct(F.length("text").alias("n"), "turn"))), lambda s: s["turn"]).alias("pred"))
    return lists.select("conv_id", S.reading_order_error(c("gold"), c("pred")).alias("score"))


def _lines(t):
    gold = spread(t.documents).select(c("doc_id").alias("page"), F.posexplode(F.split(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), "\n")).alias("pos", "line")).filter("length(line) > 0")
    pred = gold.select("page", (1000 - c("pos")).alias("pos"), F.when(c("pos") % 3 == 0, F.replace("line", F.lit("th"), F.lit("t"))).when(c("pos") % 3 == 1, F.concat("line", F.lit(" zz"))).otherwise(c("line")).alias("line"))
    return gold, pred


@query("d38_greedy_line_match", """WITH g AS (SELECT doc_id AS page, i - 1 AS pos, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g'), chr(10)) AS l FROM documents)) WHERE length(l[i]) > 0),
 p AS (SELECT page, 1000 - pos AS pos, CASE WHEN pos % 3 = 0 THEN replace(line, 'th', 't') WHEN pos % 3 = 1 THEN line || ' zz' ELSE line END AS line FROM g),
 gd AS (SELECT DISTINCT page, line FROM g), pd AS (SELECT DISTINCT page, line FROM p),
 k AS (SELECT page, gd.line AS gl, pd.line AS pl, CASE WHEN gd.line = pd.line THEN 0 ELSE levenshtein(gd.line, pd.line) / greatest(length(gd.line), length(pd.line)) END AS cost FROM gd JOIN pd USING (page)),
 m AS (SELECT a.page, a.gl, a.pl, a.cost FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page, gl ORDER BY cost, pl) = 1) a JOIN (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page, pl ORDER BY cost, gl) = 1) b ON a.page = b.page AND a.gl = b.gl AND a.pl = b.pl),
 gc AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY pos) AS copy FROM g), pc AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY pos) AS copy FROM p)
 SELECT gc.page, gc.pos, gc.line AS gold_line, pc.line AS pred_line, pc.pos AS pred_pos, CASE WHEN pc.pos IS NULL THEN 1.0 ELSE m.cost END AS edit FROM gc LEFT JOIN m ON m.page = gc.page AND m.gl = gc.line LEFT JOIN pc ON pc.page = gc.page AND pc.line = m.pl AND pc.copy = gc.copy""", "edit", "pos pred_pos")
def greedy_line_match(t):
    gold, pred = _lines(t)
    return line_match.greedy_line_match(gold, pred, "page")


KIE_GOLD = "SELECT o_orderkey AS file, 'status' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT l_orderkey, 'item', CAST(l_quantity AS INT)::VARCHAR FROM lineitem"
KIE_PRED = "SELECT o_orderkey AS file, 'status' AS field, CASE WHEN o_custkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS value FROM orders UNION ALL SELECT l_orderkey, 'item', CAST(CASE WHEN l_suppkey % 5 = 0 THEN l_quantity + 1 ELSE l_quantity END AS INT)::VARCHAR FROM lineitem WHERE l_linenumber < 6"
KIE_SQL = f"""g AS (SELECT file, field, value, count(*) AS g FROM ({KIE_GOLD}) GROUP BY ALL), p AS (SELECT file, field, value, count(*) AS p FROM ({KIE_PRED}) GROUP BY ALL),
 m AS (SELECT file, field, sum(least(coalesce(g, 0), coalesce(p, 0))) AS tp, sum(coalesce(g, 0) - least(coalesce(g, 0), coalesce(p, 0))) AS fn, sum(coalesce(p, 0) - least(coalesce(g, 0), coalesce(p, 0))) AS fp FROM g FULL JOIN p USING (file, field, value) GROUP BY file, field)"""


def fields(t):
    status = lambda v: t.orders.select(c("o_orderkey").alias("file"), F.lit("status").alias("field"), v.alias("value"))
    items = lambda df, q: df.select(c("l_orderkey").alias("file"), F.lit("item").alias("field"), q.cast("int").cast("string").alias("value"))
    gold = status(c("o_orderstatus")).unionByName(items(t.lineitem, c("l_quantity")))
    wrong = F.when(c("l_suppkey") % 5 == 0, c("l_quantity") + 1).otherwise(c("l_quantity"))
    pred = status(F.when(c("o_custkey") % 3 == 0, "F").otherwise(c("o_orderstatus"))).unionByName(items(t.lineitem.filter("l_linenumber < 6"), wrong))
    return matching.field_match(gold, pred, tasks_for(t.orders, t.lineitem))


@query("d39_field_match_kie", f"WITH {KIE_SQL} SELECT * FROM m", ints="tp fn fp")
def field_match_kie(t):
    return fields(t)


@query("d40_pixel_error", """WITH d AS (SELECT vec_id AS idx, list_transform(embedding, lambda x: (CAST(x AS DOUBLE) + 1) * 127) AS g, list_transform(embedding, lambda x: floor((CAST(x AS DOUBLE) + 1) * 127)) AS p FROM embeddings),
 m AS (SELECT idx, list_avg(list_transform(range(1, len(g) + 1), lambda i: pow(p[i] - g[i], 2))) AS mse, list_avg(list_transform(range(1, len(g) + 1), lambda i: abs(p[i] - g[i]))) AS mae FROM d) SELECT idx, mse, 20 * log10(255 / sqrt(mse)) AS psnr, mae FROM m""", "mse psnr mae")
def pixel_error(t):
    df = t.embeddings.select(c("vec_id").alias("idx"), F.transform("embedding", lambda x: (x.cast("double") + 1) * 127).alias("g"))
    e = S.pixel_error(c("g"), F.transform("g", lambda x: F.floor(x)))
    return df.select("idx", e["mse"].alias("mse"), e["psnr"].alias("psnr"), e["mae"].alias("mae"))


scored("d41_single_interval_iou", "events", "event_id AS idx, value AS s1, value + user_id % 7 AS e1, user_id * 1e0 AS s2, user_id + value AS e2", "CASE WHEN greatest(e1, e2) = least(s1, s2) THEN 0 ELSE greatest(0, least(e1, e2) - greatest(s1, s2)) / (greatest(e1, e2) - least(s1, s2)) END", lambda: S.single_interval_iou(c("s1"), c("e1"), c("s2"), c("e2")))


@query("d42_document_similarity", """WITH g AS (SELECT item_id, text FROM benchmark), r AS (SELECT item_id, '```latex' || replace(text, 'the', 'te') || '```' AS pred FROM benchmark WHERE item_id % 4 > 0),
 f AS (SELECT g.item_id, translate(g.text, ' ' || chr(10), '') AS a, translate(split_part(pred, '```', 2), ' ' || chr(10), '') AS b FROM g LEFT JOIN r USING (item_id)) SELECT item_id, coalesce(1 - levenshtein(a, b) / greatest(length(a), length(b)), 0) AS score FROM f""", "score")
def document_similarity(t):
    answers = t.benchmark.filter("item_id % 4 > 0").select("item_id", F.concat(F.lit("```latex"), F.replace("text", F.lit("the"), F.lit("te")), F.lit("```")).alias("pred"))
    return t.benchmark.join(answers, "item_id", "left").select("item_id", S.document_similarity(c("text"), c("pred")).alias("score"))


FACT = "doc_id AS idx, CASE doc_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'It is false' WHEN 2 THEN 'true or false' ELSE NULL END AS pred, CAST(quality AS VARCHAR(2)) AS gold"


@query("d43_true_false_table_fact", over("labels", FACT, """, s AS (SELECT CASE idx % 4 WHEN 0 THEN CASE WHEN gold = '1' THEN 1.0 ELSE 0 END WHEN 1 THEN CASE WHEN gold = '0' THEN 1.0 ELSE 0 END WHEN 2 THEN NULL ELSE 0.0 END AS score FROM d)
 SELECT round((sum(score) + 1e-9) / (count(*) + 1e-9), 8) * 100 AS accuracy, count(*) - count(score) AS manual FROM s"""), "accuracy", "manual")
def true_false_table_fact(t):
    s = t.derive("labels", FACT).select(S.true_false_fact(c("pred"), c("gold")).alias("score"))
    return s.agg((F.round((F.sum("score") + 1e-9) / (F.count(F.lit(1)) + 1e-9), 8) * 100).alias("accuracy"), (F.count(F.lit(1)) - F.count("score")).alias("manual"))


RULES = {
    "paragraph_count": (("paragraph_count", 1, 3), "len(par) BETWEEN 1 AND 3"),
    "sentence_count": (("sentence_count", 2, 12), "len(sen) BETWEEN 2 AND 12"),
    "word_count": (("word_count", 50, 200), "len(list_filter(regexp_split_to_array(regexp_replace(text, '[^\\p{L}\\p{N}_\\s.-]', '', 'g'), '\\s+'), lambda w: w <> '')) BETWEEN 50 AND 200"),
    "without_substrings": (("without_substrings", "der", "the"), "NOT (contains(text, 'der') OR contains(text, 'the'))"),
    "begins_with": (("begins_with", "The"), "starts_with(regexp_replace(text, '^\\s+', ''), 'The')"),
    "ends_with": (("ends_with", "."), "ends_with(regexp_replace(text, '\\s+$', ''), '.')"),
    "sentences_end_with": (("sentences_end_with", "."), "len(list_filter(sen, lambda s: NOT ends_with(s, '.'))) = 0"),
    "paragraphs_begin_with": (("paragraphs_begin_with", "A"), "len(list_filter(par, lambda s: NOT starts_with(s, 'A'))) = 0"),
    "total_keyword_count": (("total_keyword_count", ["and", "that"], 1, 9), "len(regexp_extract_all(lower(plain), '\\b(?:and|that)\\b')) BETWEEN 1 AND 9"),
    "no_arabic_number": (("no_arabic_number",), "NOT regexp_matches(text, '[0-9]') OR (regexp_matches(text, '[0-9]') AND NOT regexp_matches(regexp_replace(plain, '[.]', 'x', 'g'), '\\b[0-9][0-9,]*%?(?:[^\\w]|$)'))"),
}


def _plain(t):
    # letters with accents are word letters to one engine only: the check texts spell them with a plain x
    return spread(t.documents).select(c("doc_id").alias("idx"), F.translate("text", ACCENTS, "x" * len(ACCENTS)).alias("text"))


_D44 = f"""WITH d AS (SELECT doc_id AS idx, translate(text, '{ACCENTS}', '{'x' * len(ACCENTS)}') AS text FROM documents), l AS (SELECT idx, text, text AS plain, trim(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), chr(10)), ' ' || chr(10)) AS z FROM d),
 p AS (SELECT *, list_filter(regexp_split_to_array(z, '\\n\\s*\\n'), lambda x: trim(x) <> '') AS par, list_filter(string_split(regexp_replace(regexp_replace(z, '([.!?])\\s+', '\\1' || chr(1), 'g'), '([.!?][\"'')\\]])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS sen FROM l)"""
SQL_RULES = [r for r in RULES if r != "no_arabic_number"]


@query("d44_text_constraint", f"{_D44} SELECT idx, {', '.join(f'{RULES[r][1]} AS {r}' for r in SQL_RULES)} FROM p")
def text_constraint(t):
    from scorewright.operators.constraints import rules_held
    return rules_held(_plain(t), "text", {r: RULES[r][0] for r in SQL_RULES}).drop("text")


@query("d44_number_constraints")
def number_constraints(t):
    from scorewright.operators.constraints import rules_held
    df = _plain(t)
    rules = [("percent_precision", 2), ("number_precision", 0), ("no_arabic_number",), ("words_per_paragraph", 1, 400), ("sentences_per_paragraph", 1, 20), ("paragraphs_end_with", "."), ("sentences_begin_with", "A"),
             ("each_keyword_count", ["and"], 0, 40), ("sentences_per_listed_paragraph", [[1, 40]])]
    return rules_held(df, "text", {r[0]: r for r in rules}).drop("text")


@query("d45_constraint_score", f"""{_D44}, s AS (SELECT idx, CASE WHEN {RULES['word_count'][1]} AND {RULES['ends_with'][1]} THEN 1.0 ELSE 0 END AS a, CASE WHEN {RULES['without_substrings'][1]} THEN 1.0 ELSE 0 END AS b, CASE WHEN {RULES['sentence_count'][1]} AND {RULES['paragraph_count'][1]} THEN 1.0 ELSE 0 END AS e FROM p)
 SELECT idx, (a + b + e) / 3 AS score FROM s""", "score")
def constraint_score(t):
    from scorewright.operators.constraints import constraint_score as total
    constraints = {"length": ["word_count", "ends_with"], "words": ["without_substrings"], "shape": ["sentence_count", "paragraph_count"]}
    return total(_plain(t), "idx", "text", {k: [RULES[r][0] for r in rules] for k, rules in constraints.items()})
