"""Dictionary coding against a plain look-up."""

import random

from pyspark.sql import functions as F

from scorewright.functions import sequence as K


def test_encode_and_decode_equal_a_plain_lookup(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    vocabulary = {w: i + 10 for i, w in enumerate(words) if i % 3}
    rows = [(n, [draw.choice(words) if draw.random() < 0.6 else "w1" for _ in range(draw.randrange(200))]) for n in range(60)]
    rows += [(100, []), (101, None), (102, [None, "w1", None, "none"]), (103, ["w2"] * 500 + words)]
    df = spark.createDataFrame(rows, "k int, tokens array<string>")
    v = spark.createDataFrame([*vocabulary.items(), (None, 7), ("w1", 9_000)], "token string, id int")
    ids = K.encode(df, "k", "tokens", v)
    got = {r.k: r.ids for r in ids.collect()}
    want = {k: None if t is None else [vocabulary.get(w, 0) for w in t] for k, t in rows}
    assert got == want
    names = {i: w for w, i in vocabulary.items()} | {9_000: "w1"}
    back = {r.k: r.tokens for r in K.decode(ids, "k", "ids", v.where("token is not null")).collect()}
    assert back == {k: None if t is None else [names.get(i) for i in t] for k, t in want.items()}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, ["a"])], "k int, tokens array<string>")
    v = spark.createDataFrame([], "token string, id int")
    assert K.encode(df, "k", "tokens", v).first().ids == [0]
    assert K.encode(df.where("k > 1"), "k", "tokens", v).count() == 0


def test_a_row_sends_distinct_elements(spark):
    df = spark.range(10).select("id", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("a"), (i * 0 + F.col("id")).cast("string"))).alias("tokens"))
    v = spark.createDataFrame([("a1", 1)], "token string, id int")
    plan = K.encode(df, "id", "tokens", v)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "array_distinct" in plan and plan.count("Range") == 1
