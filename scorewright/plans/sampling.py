"""Sampling, mixing and ordering queries (I)."""

from pyspark.sql import Window, functions as F

from scorewright.operators import intervals, sampling as P
from scorewright.operators.skew import ranked, side_by_side
from scorewright.plans.catalog import over, query
from scorewright.plans.text import unit_sql

c = F.col


@query("i01_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {unit_sql('doc_id', seed='5')}, doc_id) - 1 AS pos FROM documents", ints="pos")
def shuffle(t):
    return P.shuffled(t.documents.select("doc_id"), "doc_id", seed="5")


@query("i02_repeat_epochs", f"SELECT doc_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY {unit_sql('epoch', 'doc_id')}, doc_id) - 1 AS pos FROM documents, (SELECT unnest([0, 1, 2]) AS epoch)", ints="epoch pos")
def repeat_epochs(t):
    return P.repeat_epochs(t.documents.select("doc_id"), "doc_id", 3)


@query("i02_resample_shards", f"""WITH s AS (SELECT DISTINCT source FROM documents), p AS (SELECT source, row_number() OVER (ORDER BY md5(source), source) - 1 AS i, count(*) OVER () AS n FROM s)
 SELECT draw, source FROM (SELECT i AS draw, {unit_sql('i', seed='0')} AS u FROM range(500) r(i)) x JOIN p ON p.i = floor(u * p.n)""", ints="draw")
def resample_shards(t):
    return P.resample_shards(t.documents.select("source").distinct(), "source", 500)


WEIGHTS = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}


def _mix_sql(choice):
    return f"""WITH s AS (SELECT i AS step, {unit_sql('i', seed='9')} AS u FROM range((SELECT count(*) FROM documents)) r(i)), p AS (SELECT step, {choice} AS lang FROM s), k AS (SELECT step, lang, row_number() OVER (PARTITION BY lang ORDER BY step) - 1 AS turn FROM p),
     d AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {unit_sql('doc_id', seed='9')}, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT step, lang, doc_id FROM k JOIN d USING (lang) WHERE d.i = k.turn % d.n"""


@query("i03_mix_sources", _mix_sql("CASE WHEN u < 0.4 THEN 'en' WHEN u < 0.7 THEN 'de' WHEN u < 0.9 THEN 'fr' ELSE 'es' END"), ints="step")
def mix_sources(t):
    return P.mix_sources(t.documents.select("lang", "doc_id"), "lang", "doc_id", WEIGHTS, t.documents.count(), seed="9")


@query("i03_mix_sources_two_level", _mix_sql("CASE WHEN u < 0.125 THEN 'en' WHEN u < 0.5 THEN 'de' WHEN u < 0.875 THEN 'fr' ELSE 'es' END"), ints="step")
def mix_sources_two_level(t):
    tasks = {"en": "caption", "de": "chat", "fr": "chat", "es": "caption"}
    return P.mix_sources(t.documents.select("lang", "doc_id"), "lang", "doc_id", {"en": 1.0, "de": 2.0, "fr": 2.0, "es": 1.0}, t.documents.count(), seed="9", tasks=tasks, task_weights={"caption": 1.0, "chat": 3.0})


def _sources(t):
    return {"page": (t.pages.select("page_id"), "page_id", "page_id"), "item": (t.benchmark.select("item_id"), "item_id", "item_id"), "doc": (t.documents.select("doc_id"), "doc_id", "doc_id")}


_Z = "WITH n AS (SELECT (SELECT count(*) FROM pages) AS a, (SELECT count(*) FROM benchmark) AS b, (SELECT count(*) FROM documents) AS c), p AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS i FROM pages), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark), d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)"


@query("i04_zip_sources_cycle", _Z + " SELECT pos, page_id AS page, item_id AS item, doc_id AS doc FROM (SELECT unnest(range(0, (SELECT greatest(a, b, c) FROM n))) AS pos) z, n JOIN p ON true JOIN b ON true JOIN d ON true WHERE p.i = z.pos % n.a AND b.i = z.pos % n.b AND d.i = z.pos % n.c", ints="pos")
def zip_sources_cycle(t):
    return P.zip_sources(_sources(t), "max_size_cycle")


@query("i04_zip_sources_shortest", _Z + " SELECT p.i AS pos, page_id AS page, item_id AS item, doc_id AS doc FROM p JOIN b USING (i) JOIN d USING (i)", ints="pos")
def zip_sources_shortest(t):
    return P.zip_sources(_sources(t), "min_size")


@query("i05_batch", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents) SELECT source, i // 16 AS batch, string_agg(doc_id, ',' ORDER BY i) AS items FROM r GROUP BY source, i // 16 HAVING count(*) = 16", ints="batch")
def batch(t):
    out = P.batch(t.documents.select("source", "doc_id"), "doc_id", "doc_id", 16, by=["source"])
    return out.select("source", "batch", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


FRAMES = "event_id AS idx, user_id * 7 + 3 AS total, 25e0 AS rate"
VIDEO_ROWS = 1 << 14
_TEXT = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


@query("i07_sample_frames", over("events", FRAMES, """SELECT idx, array_to_string(list_transform(range(1, 9), lambda i: CAST(floor(i * (total / 9)) AS INT)), ',') AS spaced,
 array_to_string(list_transform(range(0, CAST(floor(total / rate * 2) AS BIGINT)), lambda i: CAST(floor(i * (rate / 2)) AS INT)), ',') AS at_rate FROM d"""))
def sample_frames(t):
    # the positions of a video are hundreds of times its row: those of alike videos are written side by side
    videos = side_by_side(t.derive("events", FRAMES), ["rate", "total", "idx"], VIDEO_ROWS)
    return videos.select("idx", _TEXT(P.frame_positions(c("total"), 8)).alias("spaced"), _TEXT(P.frames_at_rate(c("total"), c("rate"), 2.0)).alias("at_rate"))


@query("i08_subsample_uniform", over("events", FRAMES, "SELECT idx, array_to_string(CASE WHEN total <= 16 THEN range(0, total) ELSE list_transform(range(0, 16), lambda i: CAST(floor(i * total / 16) AS BIGINT)) END, ',') AS picks FROM d"))
def subsample_uniform(t):
    return t.derive("events", FRAMES).select("idx", _TEXT(P.subsample_positions(c("total"), 16)).alias("picks"))


@query("i09_sample_by_interval", """WITH d AS (SELECT user_id AS video, event_id, CAST(event_id * 10 AS DOUBLE) AS s, event_id * 10 + value / 3 AS e FROM events), k AS (SELECT *, round_even(s * 2, 0) AS a, round_even(e * 2, 0) AS b FROM d),
 t AS (SELECT video, sum(b - a) AS total FROM k GROUP BY video), n AS (SELECT *, CASE WHEN 32 >= total THEN b - a ELSE greatest(1, floor(32 * ((b - a) / total))) END AS n FROM k JOIN t USING (video)),
 i AS (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS i FROM n WHERE n > 0) SELECT video, event_id, CASE WHEN 32 >= total THEN a + i ELSE floor(a + (b - a) / n / 2 + (b - a) / n * i) END AS frame FROM i""", ints="frame")
def sample_by_interval(t):
    d = t.events.select(c("user_id").alias("video"), "event_id", (c("event_id") * 10).cast("double").alias("start"), (c("event_id") * 10 + c("value") / 3).alias("end"))
    return intervals.sample_by_interval(d, "video", 32, 2.0).select("video", "event_id", "frame")


@query("i10_drop_condition", f"SELECT doc_id, CASE WHEN {unit_sql('doc_id', seed='4')} < 0.1 THEN '' ELSE text END AS text FROM documents")
def drop_condition(t):
    return t.documents.select("doc_id", P.drop_condition(c("text"), c("doc_id"), 0.1, seed="4").alias("text"))


@query("i11_sort", "SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders", ints="pos")
def sort(t):
    return ranked(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_totalprice", "o_orderkey"], name="pos").drop("o_totalprice")


@query("i12_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_k(t):
    return P.top_k(t.orders.select("o_orderkey", "o_totalprice"), 50, F.desc("o_totalprice"), c("o_orderkey"))


@query("i13_union", "SELECT 'orders' AS kind, o_orderpriority AS name, count(*) AS n, NULL AS quantity FROM orders GROUP BY 2 UNION ALL SELECT 'lines', l_returnflag, count(*), sum(l_quantity) FROM lineitem GROUP BY 2", "quantity", "n")
def union(t):
    a = t.orders.groupBy(c("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("orders"))
    b = t.lineitem.groupBy(c("l_returnflag").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")).withColumn("kind", F.lit("lines"))
    return a.unionByName(b, allowMissingColumns=True)


@query("i14_intersect_except", """SELECT 'both' AS side, o_custkey AS k FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
 UNION ALL SELECT 'missing', o_custkey FROM (SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def intersect_except(t):
    keys = lambda cond: t.orders.filter(cond).select(c("o_custkey").alias("k"))
    both = P.common_keys(keys("o_orderstatus = 'F'"), keys("o_orderstatus = 'O'"), "k")
    missing = P.missing_keys(keys("true"), keys("o_totalprice > 300000"), "k")
    return both.select(F.lit("both").alias("side"), "k").unionByName(missing.select(F.lit("missing").alias("side"), "k"))


@query("i15_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct(t):
    return t.part.select("p_brand", "p_type").distinct()


@query("i16_windows", "SELECT event_id, row_number() OVER w - 1 AS pos, lag(event_type) OVER w AS before, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "around", "pos")
def windows(t):
    from scorewright.operators.skew import with_halo
    placed = ranked(t.events.select("event_id", "user_id", "ts", "event_type", "value"), ["ts", "event_id"], ["user_id"], name="pos")
    w = Window.partitionBy("user_id", "_chunk").orderBy("pos")
    out = with_halo(placed, "pos", 2, 2).withColumn("before", F.lag("event_type").over(w)).withColumn("around", F.sum("value").over(w.rowsBetween(-2, 2)))
    return out.filter("_own").select("event_id", "pos", "before", "around")
