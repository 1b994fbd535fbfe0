"""Inputs beyond the limits that operators once had."""

import random

from pyspark.sql import functions as F

from scorewright.evaluate import Spec, evaluate
from scorewright.functions.score import finance_scores, lcs_length
from scorewright.functions.text import is_label_phrase, normalise_punctuation
from scorewright.operators import consistency, intervals, joins, reports
from scorewright.operators.skew import ranked, salted_join


def test_circular_keys_above_a_million(spark):
    rows = [(g + 10**8 * i, g, "ABCD"[(g + i) % 4]) for g in (5, 1_000_005) for i in range(4)]
    answers = spark.createDataFrame(rows, "idx long, g_index long, answer string")
    predictions = answers.select("idx", F.when((F.col("g_index") == 5) & (F.col("idx") > 5), "Z").otherwise(F.col("answer")).alias("prediction"))
    out = {r.idx: (r.hit, r.rotations) for r in consistency.circular_accuracy(predictions, answers).collect()}
    assert out == {5: (0, 4), 1_000_005: (1, 4)}
    report = evaluate(predictions, answers.withColumn("category", F.col("g_index").cast("string")), Spec(grouping="circular"))
    assert {r.value: r.acc for r in report.collect()} == {"all": 0.5, "5": 0.0, "1000005": 1.0}


def test_missing_pairs_of_a_long_list(spark):
    names = spark.range(120_000).select(F.concat(F.lit("d"), "id").alias("d"))
    left = spark.createDataFrame([("m1",), ("m2",)], "m string")
    done = left.crossJoin(names).where("m = 'm1' OR d <> 'd7'").where("d <> 'd119999'")
    assert {(r.m, r.d) for r in joins.missing_pairs(left, "m", names, "d", done).collect()} == {("m1", "d119999"), ("m2", "d119999"), ("m2", "d7")}


def test_every_full_stop_goes(one):
    assert one(lambda t: normalise_punctuation(t), t="a." * 50 + " 1.5") == "a" * 50 + " 1.5"
    assert one(lambda t: normalise_punctuation(t, after_digit=True), t="a. 3. 1.5") == "a 3 1.5"
    assert one(is_label_phrase, text="12. 34.") is True and one(is_label_phrase, text="12. word") is False


def test_report_names_with_slashes_and_nulls(spark):
    rows = [("x/y", "g/1", 1), ("x/z", "g/1", 0), (None, "g/2", 1)]
    out = {(r.split, r.dim, r.value): r.acc for r in reports.two_level_report(spark.createDataFrame(rows, "category string, l2_category string, hit int")).collect()}
    assert out[("ALL", "category", "x/y")] == 1.0 and out[("ALL", "category", "x/z")] == 0.0 and out[("ALL", "category", None)] == 1.0
    assert out[("ALL", "l2_category", "g/1")] == 0.5 and out[("none", "overall", "all")] == 2 / 3
    sums = reports.success_total_rollup(spark.createDataFrame([("a/b", "t/u", 1, 2), ("a/b", "v", 1, 1)], "dim string, task_type string, success int, overall int"))
    assert {(r.level, r.key, r.acc) for r in sums.collect()} == {("row", "a/b. t/u", 50.0), ("row", "a/b. v", 100.0), ("dim", "a/b", 66.67), ("task", "t/u", 50.0), ("task", "v", 100.0), ("overall", "overall", 66.67)}


def test_equal_spans_all_stay(spark):
    spans = spark.createDataFrame([("k", 1.0, 9.0, "a"), ("k", 1.0, 9.0, "a"), ("k", 3.0, 4.0, "b"), ("k", 20.0, 30.0, "c")], "key string, start double, end double, content string")
    points = spark.createDataFrame([("k", 2.0), ("k", 3.0), ("k", 4.0), ("k", 20.0)], "key string, t double")
    assert sorted(r.content for r in intervals.covered(spans, points, "key", 5.0).collect()) == ["a", "a"]


def test_text_order(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcß日", k=rng.randrange(1, 9))) for _ in range(3000)}, key=lambda w: w.encode())
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        from scorewright.operators.skew import _bucketed
        assert _bucketed(df, ["w"], 64).select("_bucket").distinct().count() > 40
        got = {r.w: r.p for r in ranked(df, ["w"], name="p").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {w: i for i, w in enumerate(words)}


def test_hot_and_null_keys_of_a_join(spark):
    big = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("k"))
    small = spark.createDataFrame([(1, "one"), (3, "three"), (None, "null")], "k long, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = salted_join(big, small, ["k"], how, rows=3000), big.join(small, "k", how)
        want = want.select(got.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_longest_common_subsequence(spark):
    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(6)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(90))], [rng.choice("abcd") for _ in range(rng.randrange(90))]) for _ in range(80)]
    got = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", lcs_length("a", "b").alias("n")).collect()
    assert all(r.n == plain(r.a, r.b) for r in got)


def test_finance_cells(one):
    score = lambda p, g: tuple(one(lambda p, g: finance_scores(p, g), p=p, g=g))
    assert score("$5 million", "5,000,000") == (1.0, 1.0)
    assert score("5 thousand shares", "5") == (0.0, 1.0)
    assert score("12 %", "0.12") == (1.0, 1.0)
    assert score("north", "south") == (0.0, 0.0)


def test_python_batches_are_bounded(spark):
    from scorewright.session import configure
    # a batch of 10,000 whole texts with their token lists is more than a worker should hold
    assert int(configure(spark).conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_cider_shuffles_grams_once(spark):
    """Token lists are shuffled to be counted, not their grams; a gram of a key goes to its frequency in one row."""
    import re

    from scorewright.operators.corpus_metrics import cider
    text = lambda i: f"a b c d e{i} f g{i}".split()
    pred = spark.createDataFrame([(i, text(i)) for i in range(6)] + [(6, ["x"])], "id long, tokens array<string>")
    refs = spark.createDataFrame([(i, r, text(i) if r else text(i)[:5]) for i in range(7) for r in (0, 1)], "id long, ref int, tokens array<string>")
    out = cider(pred, refs, "id")
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(id#\d+L?, n#\d+, gram#\d+", plan)
    got = {r.id: r.cider for r in out.collect()}
    assert got.keys() == set(range(7)) and got[6] == 0 and all(0 < got[i] <= 10 for i in range(6)) and len({round(got[i], 9) for i in range(6)}) == 1
