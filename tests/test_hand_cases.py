"""Small literal cases for extraction, scores, sequences, trajectories and safety."""

import math

import pytest
from pyspark.sql import functions as F

from scorewright.functions import extract as E
from scorewright.functions import score as S
from scorewright.functions import sequence as K
from scorewright.functions import text as X
from scorewright.functions import trajectory as J
from scorewright.operators import safety as L


def options():
    return F.create_map(*[F.lit(x) for c in "ABCD" for x in (c, f"text of {c}")])


@pytest.mark.parametrize("answer, want", [("The answer is B.", "B"), ("A or B", None), ("(C)", "C"), ("Z", "Z"), ("Cannot determine the answer", "Z"), ("Failed to obtain answer via API.", None)])
def test_infer_option(one, answer, want):
    assert one(lambda a: E.infer_option(a, options()), a=answer) == want


@pytest.mark.parametrize("answer, want", [("yes, no doubt", "Unknown"), ("Yes!", "Yes"), ("it is no.", "No"), ("yesterday", "Unknown")])
def test_yes_no(one, answer, want):
    assert one(lambda a: E.yes_no(a), a=answer) == want


@pytest.mark.parametrize("answer, want", [("DBAC", "DBAC"), ("ABCC", None), ("First A, second B, third C, fourth D", "ABCD"), ("step 1: D step 2: C step 3: B step 4: A", "DCBA")])
def test_sequence_answer(one, answer, want):
    assert one(lambda a: E.infer_sequence(a), a=answer) == want


@pytest.mark.parametrize("answer, want", [("two hundred and five", [205.0]), ("3 or four", [3.0, 4.0]), ("zero", []), ("one thousand", [1000.0])])
def test_numbers(one, answer, want):
    assert one(lambda a: E.numbers(a), a=answer) == want


def test_json_objects(one):
    assert one(lambda a: E.json_objects(a), a='x {"a": 1} {bad} {"b": {"c": 2}}') == ['{"a": 1}', '{"b": {"c": 2}}']


def test_fused_openings_are_kept(one):
    assert one(lambda a: E.first_letter(a), a="The best option is B") == "B"
    assert one(lambda a: E.first_letter(a), a="Best answer: C") == "B"


def test_edit_ratio(one):
    assert one(lambda g, p: S.edit_ratio(g, p), g="abc", p="abd") == pytest.approx(1 / 3)


def test_consensus(one):
    got = one(lambda p: S.consensus(p, F.array(F.lit("x"), F.lit("x"), F.lit("x"), F.lit("y"))), p="x")
    assert got == pytest.approx([2 / 3, 2 / 3, 2 / 3, 1.0])


def test_relaxed_number(one):
    assert one(lambda p, g: S.relaxed_number(p, g), p="95", g="100") == 0.0
    assert one(lambda p, g: S.relaxed_number(p, g, denominator="gold"), p="95", g="100") == 1.0


def test_interval_arrays(one):
    a = lambda *xs: F.array(*[F.array(F.lit(float(s)), F.lit(float(e))) for s, e in xs])
    assert one(lambda: S.interval_array_iou(a((0, 10)), a((5, 15), (12, 20)))) == pytest.approx(0.25)


def test_count_score(one):
    assert one(lambda: S.graded_count_score(F.lit(3), F.lit(3), F.lit(2))) == 100.0


@pytest.mark.parametrize("a, b, want", [("ab", "ba", 0.5), ("ca", "abc", 1 - 2 / 3), ("", "", 1.0), ("kitten", "sitting", 1 - 3 / 7)])
def test_damerau(one, a, b, want):
    assert one(lambda x, y: S.damerau_similarity(x, y), x=a, y=b) == pytest.approx(want)


def test_periods_beyond_the_limit_stay(one):
    text = ".".join("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ")
    assert one(lambda t: X.normalise_punctuation(t, max_periods=32), t=text).count(".") == 3
    assert one(lambda t: X.normalise_punctuation(t, None), t=text).count(".") == 0


def test_document_cleaning(one):
    assert one(lambda t: X.clean_document_text(t), t="```markdown\nＡＢ　1 ！\n```") == "AB1"


@pytest.mark.parametrize("value, want", [(0.0, 333), (-100.0, 0), (1000.0, 666), (-1000.0, 0)])
def test_quantise(one, value, want):
    assert one(lambda v: J.quantise_index(v), v=value) == want


def test_grid_is_the_nearest_bin(spark):
    import numpy as np
    grid = np.arange(-100.0, 100.0 + 1e-6, 0.3, dtype=np.float32)
    values = np.linspace(-101, 101, 20011)
    want = [int(np.argmin(np.abs(grid - float(np.clip(v, grid[0], grid[-1]))))) for v in values]
    got = [r.i for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(J.quantise_index(F.col("v")).alias("i")).collect()]
    assert sum(a != b for a, b in zip(got, want)) == 0
    back = spark.range(667).select(J.dequantise(F.concat(F.lit("<bev_"), F.col("id"), F.lit(">"))).alias("v")).collect()
    assert [r.v for r in back] == pytest.approx([float(x) for x in grid])


def test_displacement(one):
    path = lambda *ps: F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ps])
    got = one(lambda: J.displacement(path((0, 0), (3, 4)), path((0, 0), (0, 0))))
    assert (got["ade"], got["fde"]) == (2.5, 5.0)


def test_chat_mask(one):
    sp = {"bos": 1, "eos": 2, "header_end": 9}
    got = one(lambda: K.chat(K.ids_of([1, 9, 5, 9, 6]), sp, 8))
    assert got["ids"] == [1, 9, 5, 9, 6, 2, 2, 2]
    assert got["mask"] == [1, 1, 1, 1, 0, 0, 0, 0]


def test_full_score(one):
    assert one(lambda: L.full_score(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.0))) == 0.0


def test_exact_overlap_is_stricter(one):
    box = lambda **k: {n: F.lit(float(v)) for n, v in k.items()}
    a, b = box(x=0, y=0, l=2, w=2, yaw=0), box(x=2.2, y=2.2, l=4, w=0.2, yaw=-math.pi / 4)
    assert one(lambda: L.envelopes_meet(a, b)) is True
    assert one(lambda: L.rectangles_meet(a, b)) is False


def test_progress(one):
    line = lambda *ps: F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ps])
    assert one(lambda: L.progress(line((0, 0), (10, 0), (10, 10)), line((2, 1), (11, 5)))) == 13.0
    assert one(lambda: L.progress(line((0, 0), (10, 0)), line((5, 0), (2, 0)))) is None


def test_token_f1_of_long_texts_equals_counting_and_is_not_quadratic(spark):
    import random
    import time

    from scorewright.functions.score import token_f1

    draw = random.Random(7)
    some = lambda n: " ".join(f"w{draw.randrange(n)}" for _ in range(n))
    rows = [("a b a", "a a c"), ("", "a"), ("a", ""), (None, "a"), ("a", None), ("b", "a"), ("é é z", "z é")] + [(some(40), some(40)) for _ in range(20)]

    def counted(g, p):
        g, p = (g or "").split(), (p or "").split()
        found = sum(w in g for w in p)
        return 2 * (found / len(g)) * (found / len(p)) / (found / len(g) + found / len(p)) if found else 0.0

    frame = lambda pairs: spark.createDataFrame(pairs, "g string, p string").select(token_f1(F.col("g"), F.col("p")).alias("v"))
    assert [round(r.v, 9) for r in frame(rows).collect()] == [round(counted(*r), 9) for r in rows]
    start = time.time()
    words = " ".join(f"w{i}" for i in range(100_000))
    assert frame([(words, words.upper())]).first().v == 0.0
    assert time.time() - start < 15


def test_token_f1_of_many_tokens_in_one_task(spark):
    import time

    from scorewright.functions.score import token_f1

    # 4 million tokens: sorted in a lambda they took a minute and more of one core
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda i: F.concat(F.lit("w"), (i * 7919 % 60_007).cast("string"))), " ")
    df = spark.range(40, numPartitions=1).select(words.alias("g")).select("g", F.concat("g", F.lit(" more")).alias("p")).localCheckpoint()
    start = time.time()
    assert df.select(token_f1(F.col("g"), F.col("p")).alias("v")).agg(F.count_if(F.abs(F.col("v") - 2 / (1 + 50_001 / 50_000)) < 1e-9)).first()[0] == 40
    assert time.time() - start < 25


def test_repeated_parts_are_worked_out_once(spark):
    # the plan names the regular expressions of a cell once, and the values of a mean once
    df = spark.createDataFrame([("2001-3-05",)], "x string")
    shown = df.select(S.table_value(F.col("x")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert shown.count("(?<!^)\\[") == 2
    means = spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(S.array_mean(F.transform("v", lambda x: x + 41)).alias("m"))
    assert means._jdf.queryExecution().analyzed().toString().count("41") == 1
    assert means.first()["m"] == 42.5


def test_array_box_iou(one):
    assert one(lambda a, b: S.array_box_iou(a, b), a=[0.0, 0.0, 2.0, 2.0], b=[1.0, 0.0, 3.0, 2.0]) == pytest.approx(1 / 3)
    assert one(lambda a, b: S.array_box_iou(a, b), a=[0.0, 0.0, 0.0, 0.0], b=[0.0, 0.0, 0.0, 0.0]) == 0.0
