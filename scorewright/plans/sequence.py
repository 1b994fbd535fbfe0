"""Token sequence queries (K): ids come from word lengths and hashes of the table texts."""

from pyspark.sql import functions as F

from scorewright.functions import sequence as K
from scorewright.functions.text import words
from scorewright.operators.skew import ranked
from scorewright.plans.catalog import over, query
from scorewright.plans.text import unit_sql

c = F.col
SP = {"bos": 1, "eos": 2, "pad": 0, "soi": 3, "eoi": 4, "t2i": 5, "mmu": 6, "r2i": 7, "drive": 8, "header_end": 9, "action_sep": 10, "future_sep": 11}
TEXT = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
_W = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"

VOC = "SELECT token, row_number() OVER (ORDER BY token) + 99 AS id FROM (SELECT DISTINCT lower(unnest({})) AS token FROM benchmark)".format(_W("text"))


def vocabulary(t):
    tokens = t.benchmark.select(F.explode(words(F.lower("text"))).alias("token")).distinct()
    return ranked(tokens, ["token"], name="_place").select("token", (c("_place") + 100).cast("bigint").alias("id"))


@query("k01_register_tokens", f"WITH v AS ({VOC}), n AS (SELECT DISTINCT p_name AS token FROM part UNION SELECT 'the') SELECT token, id FROM v UNION ALL SELECT token, (SELECT max(id) FROM v) + row_number() OVER (ORDER BY token) FROM n WHERE token NOT IN (SELECT token FROM v)", ints="id")
def register_tokens(t):
    tokens = t.part.select(c("p_name").alias("token")).unionByName(t.spark.createDataFrame([("the",)], "token string"))
    return K.register_tokens(vocabulary(t), tokens)


@query("k02_encode_decode", f"WITH v AS ({VOC}), d AS (SELECT doc_id, w, i FROM (SELECT doc_id, unnest({_W('lower(text)')}) AS w, generate_subscripts({_W('lower(text)')}, 1) AS i FROM documents)) SELECT doc_id, string_agg(coalesce(id, 0), ',' ORDER BY i) AS ids, string_agg(CASE WHEN id IS NULL THEN '?' ELSE w END, ' ' ORDER BY i) AS back FROM d LEFT JOIN v ON v.token = w GROUP BY doc_id")
def encode_decode(t):
    v = vocabulary(t)
    # dealt by id before the words are cut, as whole texts
    documents = t.documents.select("doc_id", "text").where("doc_id is not null").repartition("doc_id")
    ids = K.encode(documents.select("doc_id", words(F.lower("text")).alias("tokens")), "doc_id", "tokens", v)
    return K.decode(ids, "doc_id", "ids", v, keep=True).select("doc_id", TEXT(c("ids")).alias("ids"), F.array_join("tokens", " ", "?").alias("back"))


# ids of a row: word length + 20 of each word, with a header end wherever a word has three letters
_IDS = f"list_transform({_W('text')}, lambda w: CASE WHEN length(w) = 3 THEN 9 ELSE length(w) + 20 END)"
ROWS = "conv_id * 1000000 + turn AS idx, text"


def _rows(t):
    ids = F.transform(words(c("text")), lambda w: F.when(F.length(w) == 3, 9).otherwise(F.length(w) + 20))
    return t.derive("conversations", ROWS).select("idx", ids.alias("ids"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (c("idx") % 50 + i).cast("int")).alias("image"))


_IMG = "list_transform(range(0, 4), lambda i: idx % 50 + i)"
_BASE = over("conversations", ROWS, f", i AS (SELECT idx, CASE WHEN len(x) > 0 AND x[1] = 1 THEN x ELSE list_concat([1], x) END AS x, {_IMG} AS img FROM (SELECT idx, {_IDS} AS x FROM d))")
_REP = lambda v, n: f"list_transform(range(0, greatest(0, {n})), lambda q: {v})"
_STR = lambda a: f"array_to_string({a}, ',')"


def _show(df, struct, *names):
    return df.withColumn("s", struct).select("idx", *[TEXT(c(f"s.{n}")).alias(n) for n in names])


_T2I = _BASE + f""", b AS (SELECT idx, img, CASE WHEN {unit_sql('idx', seed='2')} < 0.1 THEN [5, 1, 2] ELSE list_concat([5], x, [2]) END AS b FROM i), g AS (SELECT *, greatest(41 - len(b), 0) AS gap FROM b),
 f AS (SELECT *, CASE WHEN len(b) <= 41 THEN list_concat({_REP(0, 'gap')}, b) ELSE list_concat(b[1:40], [2]) END AS f FROM g)"""


@query("k03_text_to_image", _T2I + f" SELECT idx, {_STR('list_concat(f, [3], img, [4])')} AS ids, {_STR('list_concat(' + _REP(0, 'gap') + ', ' + _REP(1, '41 - gap + 6') + ')')} AS mask, {_STR('list_transform(list_concat(f, [3], list_transform(img, lambda x: CASE WHEN x % 2 = 0 THEN -100 ELSE x END), [4]), lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels FROM f")
def text_to_image(t):
    from scorewright.operators.skew import unit_hash
    labels = F.transform("image", lambda x: F.when(x % 2 == 0, -100).otherwise(x))
    return _show(_rows(t), K.text_to_image(c("ids"), c("image"), labels, SP, 40, unit_hash(c("idx"), seed="2") < 0.1), "ids", "mask", "labels")


_GEN = _T2I.replace(f"CASE WHEN {unit_sql('idx', seed='2')} < 0.1 THEN [5, 1, 2] ELSE list_concat([5], x, [2]) END", "list_concat([5], x, [2])")


@query("k04_generation", _GEN + f" SELECT idx, {_STR('list_concat(f, [3], img, [4])')} AS ids, {_STR('list_concat(' + _REP(0, 'gap') + ', ' + _REP(1, '41 - gap + 6') + ')')} AS mask FROM f")
def generation(t):
    return _show(_rows(t), K.text_to_image(c("ids"), c("image"), None, SP, 40), "ids", "mask")


_LM = _BASE + f", b AS (SELECT idx, img, list_concat(x, [2]) AS b FROM i), f AS (SELECT idx, img, CASE WHEN len(b) <= 48 THEN list_concat(b, {_REP(2, '48 - len(b)')}) ELSE b[1:48] END AS f FROM b)"


@query("k05_lm", _LM + f" SELECT idx, {_STR('f')} AS ids, {_STR(_REP(1, 'len(f)'))} AS mask, {_STR('f')} AS labels FROM f")
def lm(t):
    return _show(_rows(t), K.lm(c("ids"), SP, 48), "ids", "mask", "labels")


_HE = "coalesce(len(f) - list_position(list_reverse(f), 9), -1)"


@query("k06_chat", _LM + f", h AS (SELECT *, CASE WHEN list_contains(f, 9) THEN {_HE} + 1 ELSE 0 END AS p FROM f) SELECT idx, {_STR('f')} AS ids, {_STR('list_concat(' + _REP(1, 'p') + ', ' + _REP(0, 'len(f) - p') + ')')} AS mask, {_STR('f')} AS labels FROM h")
def chat(t):
    return _show(_rows(t), K.chat(c("ids"), SP, 48), "ids", "mask", "labels")


_CLOSED = _BASE + f", b AS (SELECT idx, img, list_concat(x, [2]) AS b FROM i), f AS (SELECT idx, img, CASE WHEN len(b) <= 40 THEN list_concat(b, {_REP(2, '40 - len(b)')}) ELSE list_concat(b[1:39], [2]) END AS f FROM b), h AS (SELECT *, CASE WHEN list_contains(f, 9) THEN {_HE} ELSE -1 END AS e FROM f)"


@query("k07_image_question", _CLOSED + f" SELECT idx, {_STR('list_concat([6, 3], img, [4], f)')} AS ids, {_STR('list_concat(' + _REP(1, '7 + e + 1') + ', ' + _REP(0, '40 - e - 1') + ')')} AS mask, {_STR('list_concat(' + _REP(-100, '7') + ', f)')} AS labels FROM h")
def image_question(t):
    return _show(_rows(t), K.image_question(c("image"), c("ids"), SP, 40), "ids", "mask", "labels")


@query("k08_image_question_generation", _CLOSED + f" SELECT idx, {_STR('list_concat([6, 3], img, [4], f)')} AS ids, {_STR('list_concat(' + _REP(1, '7 + e + 1') + ', ' + _REP(0, '40 - e - 1') + ')')} AS mask FROM h")
def image_question_generation(t):
    return _show(_rows(t), K.image_question(c("image"), c("ids"), SP, 40, labels=False), "ids", "mask")


@query("k09_reasoning_to_image", _CLOSED + f", p AS (SELECT *, CASE WHEN e >= 0 THEN e + 1 ELSE 40 END AS p FROM h) SELECT idx, {_STR('list_concat([7], f, [3], img, [4])')} AS ids, {_STR('list_concat(' + _REP(1, 'p + 1') + ', ' + _REP(0, '40 - p') + ', [1], [0, 0, 0, 0], [1])')} AS mask FROM p")
def reasoning_to_image(t):
    return _show(_rows(t), K.reasoning_to_image(c("image"), c("ids"), SP, 40), "ids", "mask")


@query("k10_driving", _CLOSED + f" SELECT idx, {_STR('list_concat([8, 3], img, [4], f, [10], [31, 32, 33], [11, 3], img, [4])')} AS ids, {_STR('list_concat(' + _REP(1, '48') + ', ' + _REP(0, '10') + ')')} AS mask, {_STR('list_concat(' + _REP(-100, '48') + ', [31, 32, 33], [11, 3], img, [4])')} AS labels FROM h")
def driving(t):
    return _show(_rows(t), K.driving(c("image"), c("ids"), K.ids_of([31, 32, 33]), SP, 40, c("image")), "ids", "mask", "labels")


@query("k11_join_history", "WITH d AS (SELECT vec_id AS idx, label AS n, vec_id % 90 AS v FROM embeddings), j AS (SELECT idx, flatten(list_transform(range(0, n % 4 + 1), lambda i: CASE WHEN i = 0 THEN [v, v + 1] ELSE [77, v + i * 2, v + i * 2 + 1] END)) AS j FROM d) SELECT idx, array_to_string(list_concat(list_transform(range(0, greatest(0, 11 - len(j))), lambda q: 0), j), ',') AS history FROM j")
def join_history(t):
    frames = F.transform(F.sequence(F.lit(0), c("label") % 4), lambda i: F.array((c("vec_id") % 90 + i * 2).cast("int"), (c("vec_id") % 90 + i * 2 + 1).cast("int")))
    joined = t.embeddings.select(c("vec_id").alias("idx"), K.join_history(frames, 77).alias("j"))
    longest = joined.agg(F.greatest(F.max(F.size("j")), F.lit(11))).scalar()
    return joined.withColumn("longest", longest).select("idx", TEXT(K.left_pad(c("j"), c("longest"), 0)).alias("history"))


TIMES = "event_id AS idx, user_id / 200e0 AS t"


@query("k12_mask_schedule", over("events", TIMES, "SELECT idx, cos(t * pi() * 0.5) AS cosine, least(greatest(1 - t, 1e-6), 1) AS linear, least(greatest(1 - pow(t, 3), 1e-6), 1) AS pow3, least(greatest((1 / (1 + exp(-3.0)) - 1 / (1 + exp(-(t * 6 - 3)))) / (1 / (1 + exp(-3.0)) - 1 / (1 + exp(3.0))), 1e-6), 1) AS sigmoid FROM d"), "cosine linear pow3 sigmoid")
def mask_schedule(t):
    return t.derive("events", TIMES).select("idx", *[K.mask_schedule(c("t"), m).alias(m) for m in ("cosine", "linear", "pow3", "sigmoid")])


_POS = "(('0x' || substr(md5('0:' || idx || ':' || (i - 1)), 1, 8))::UBIGINT * 65536 + i - 1)"


@query("k13_mask_tokens", _BASE + f""", h AS (SELECT idx, x, list_transform(x, lambda v, i: {_POS}) AS h, CAST(greatest(round_even(len(x) * (idx % 10 / 10.0), 0), 1) AS INT) AS k FROM i),
 m AS (SELECT idx, x, list_transform(h, lambda z: z <= list_sort(h)[k]) AS m FROM h) SELECT idx, array_to_string(list_transform(x, lambda v, i: CASE WHEN m[i] THEN 999 ELSE v END), ',') AS ids, array_to_string(list_transform(x, lambda v, i: CASE WHEN m[i] THEN v ELSE -100 END), ',') AS labels FROM m""")
def mask_tokens(t):
    df = _rows(t).withColumn("x", K.with_bos(c("ids"), 1)).withColumn("m", K.random_mask(c("x"), c("idx") % 10 / 10.0, c("idx")))
    return _show(df, K.mask_tokens(c("x"), c("m"), 999), "ids", "labels")


@query("k13_rectangle_mask", """WITH d AS (SELECT vec_id AS idx, label % 10 / 10.0 AS p, vec_id % 7 / 7.0 AS u0, vec_id % 5 / 5.0 AS u1, vec_id % 3 / 3.0 AS u2 FROM embeddings), k AS (SELECT *, CAST(greatest(round_even(64 * p, 0), 1) AS INT) AS k FROM d),
 h AS (SELECT *, least(ceil(k / 8) + floor(u0 * (least(8, k) - ceil(k / 8) + 1)), 8) AS h FROM k), w AS (SELECT *, least(ceil(k / h), 8) AS w FROM h), o AS (SELECT *, floor(u1 * (8 - h + 1)) AS t, floor(u2 * (8 - w + 1)) AS l FROM w)
 SELECT idx, array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN i // 8 BETWEEN t AND t + h - 1 AND i % 8 BETWEEN l AND l + w - 1 THEN 1 ELSE 0 END), '') AS mask FROM o""")
def rectangle_mask(t):
    df = t.embeddings.select(c("vec_id").alias("idx"), "label", F.slice("embedding", 1, 64).alias("ids"))
    u = [c("idx") % n / float(n) for n in (7, 5, 3)]
    mask = K.rectangle_mask(c("ids"), c("label") % 10 / 10.0, 8, u)
    return df.select("idx", F.array_join(F.transform(mask, lambda m: m.cast("int").cast("string")), "").alias("mask"))


_U = "(('0x' || substr(md5('0:' || idx || ':' || (i - 1)), 1, 8))::UBIGINT / 4294967296.0)"


@query("k14_noise_by_rate", _LM + f", h AS (SELECT *, CASE WHEN list_contains(f, 9) THEN {_HE} + 1 ELSE 0 END AS p, 0.999 * (idx % 10 / 10.0) + 0.001 AS r FROM f) SELECT idx, array_to_string(list_transform(f, lambda v, i: CASE WHEN i > p AND {_U} < r THEN 999 ELSE v END), ',') AS ids, r AS rate, greatest(len(f) - p, 1) AS answer_length FROM h", "rate", "answer_length")
def noise_by_rate(t):
    df = _rows(t).withColumn("c", K.chat(c("ids"), SP, 48)).withColumn("n", K.noise_by_rate(c("c.ids"), c("c.mask"), c("idx") % 10 / 10.0, c("idx"), 999))
    return df.select("idx", TEXT(c("n.ids")).alias("ids"), c("n.rate").alias("rate"), c("n.answer_length").alias("answer_length"))


@query("k15_answer_regions", _BASE + ", s AS (SELECT idx, list_concat(x, CASE WHEN idx % 3 = 0 THEN [5] ELSE [10] END, [31, 32], CASE WHEN idx % 2 = 0 THEN list_concat([11, 3], img, [4]) ELSE [] END) AS s, len(x) AS n FROM i) SELECT idx, array_to_string(list_transform(s, lambda v, i: CASE WHEN idx % 3 > 0 AND i > n + 1 AND i <= n + 3 THEN 1 ELSE 0 END), '') AS action, array_to_string(list_transform(s, lambda v, i: CASE WHEN idx % 3 > 0 AND idx % 2 = 0 AND i > n + 3 THEN 1 ELSE 0 END), '') AS future FROM s")
def answer_regions(t):
    sep = F.when(c("idx") % 3 == 0, K.ids_of([5])).otherwise(K.ids_of([10]))
    tail = F.when(c("idx") % 2 == 0, F.concat(K.ids_of([11, 3]), c("image"), K.ids_of([4]))).otherwise(F.array().cast("array<int>"))
    df = _rows(t).withColumn("s", F.concat(K.with_bos(c("ids"), 1), sep, K.ids_of([31, 32]), tail)).withColumn("r", K.answer_regions(c("s"), 10, 11, F.size("image")))
    bits = lambda n: F.array_join(F.transform(c(f"r.{n}"), lambda x: x.cast("int").cast("string")), "").alias(n)
    return df.select("idx", bits("action"), bits("future"))


@query("k16_loss_weight", over("events", TIMES, "SELECT idx, 1 - (1 - idx % 2) * ((1 - t) * 0.7) AS weight FROM d"), "weight")
def loss_weight(t):
    return t.derive("events", TIMES).select("idx", K.loss_weight(c("t"), c("idx") % 2).alias("weight"))


@query("k17_average_by_mask_bucket", "WITH d AS (SELECT user_id % 85 / 100.0 AS share, value FROM events), b AS (SELECT unnest(range(0, 10)) AS bucket), g AS (SELECT CAST(greatest(ceil(share * 10) - 1, 0) AS INT) AS bucket, avg(value) AS m FROM d GROUP BY 1) SELECT b.bucket, coalesce(m, 0) AS mean_value FROM b LEFT JOIN g USING (bucket)", "mean_value", "bucket")
def average_by_mask_bucket(t):
    return K.average_by_mask_bucket(t.events.select((c("user_id") % 85 / 100.0).alias("share"), "value"), "share", "value")


@query("k18_entropy", """WITH d AS (SELECT vec_id AS idx, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS e FROM embeddings), p AS (SELECT idx, list_transform(e, lambda x: x / list_sum(e)) AS p FROM d) SELECT idx, -list_sum(list_transform(p, lambda x: x * ln(x))) AS entropy FROM p""", "entropy")
def entropy(t):
    return t.embeddings.withColumn("p", K.softmax(c("embedding"))).select(c("vec_id").alias("idx"), K.entropy(c("p")).alias("entropy"))


PAIR = "doc_id, concat(substr(text, 1, 30), CASE doc_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN chr(10) ELSE '' END) AS context, substr(text, 31) AS continuation"


@query("k19_encode_pair", over("documents", PAIR, "SELECT doc_id, regexp_replace(context, '\\s+$', '') AS context, regexp_extract(context, '\\s*$', 0) || continuation AS continuation FROM d"))
def encode_pair(t):
    p = K.encode_pair(c("context"), c("continuation"))
    return t.derive("documents", PAIR).select("doc_id", p["context"].alias("context"), p["continuation"].alias("continuation"))


@query("k20_cut_at_stop", "SELECT doc_id, split_part(split_part(text, ' the', 1), chr(10) || 'A', 1) AS text FROM documents")
def cut_at_stop(t):
    return t.documents.select("doc_id", K.cut_at_stop(c("text"), [" the", "\nA"]).alias("text"))
