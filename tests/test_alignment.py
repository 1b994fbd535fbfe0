"""Batched alignments against plain tables and the standard library."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from scorewright.functions import score as S
from scorewright.functions.alignment import damerau_distances, edit_distance_of, matched_characters


def pairs(rng, n, letters, high):
    text = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(high)))
    out = []
    for _ in range(n):
        a = text()
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            if rng.random() < 0.5 and len(b) > i + 1:
                b[i], b[i + 1] = b[i + 1], b[i]
            else:
                b[i : i + rng.randrange(2)] = rng.choice(letters) * rng.randrange(3)
        out.append((a, "".join(b)) if rng.random() < 0.6 else (a, text()))
    return out


def test_matching_blocks_equal_the_library():
    rng = random.Random(3)
    some = pairs(rng, 1500, "abc ", 30) + pairs(rng, 60, "abcdefgh é日", 320) + [("", ""), ("a", ""), ("", "b"), ("x" * 300, "x" * 300), ("ab" * 150, "ba" * 150), ("q" + "x" * 250, "x" * 250 + "q")]
    got = matched_characters(some)
    for (a, b), m in zip(some, got):
        assert sum(x.size for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) == m, (a, b)


def full_table(a, b):
    """Unrestricted distance from every pair of earlier places, by definition."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            for k in range(1, i):
                for n in range(1, j):
                    if a[k - 1] == b[j - 1] and a[i - 1] == b[n - 1]:
                        best = min(best, d[k - 1, n - 1] + (i - k - 1) + 1 + (j - n - 1))
            d[i, j] = best
    return d[len(a), len(b)]


def test_damerau_equals_full_table():
    rng = random.Random(4)
    some = pairs(rng, 400, "abc", 11) + pairs(rng, 100, "abé日", 14) + [("", ""), ("a", ""), ("ca", "abc"), ("ab", "ba"), ("aXb", "bYa")]
    assert damerau_distances(some).tolist() == [full_table(a, b) for a, b in some]
    assert damerau_distances([("a" * 3_000 + "xy", "a" * 3_000 + "yx"), ("p" * 900, "q" * 1_000)]).tolist() == [1, 1_000]


def test_list_distance_equals_table(spark):
    rng = random.Random(5)
    rows = [([rng.choice(["a", "b", "é", "", None, "long one"]) for _ in range(rng.randrange(9))], [rng.choice(["a", "b", "é", "", None, "other"]) for _ in range(rng.randrange(9))]) for _ in range(300)]
    rows += [([], []), (None, []), ([], None), ([str(i) for i in range(3_000)], [str(i) for i in range(1, 3_001)])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", S.list_edit_distance(F.col("a"), F.col("b")).alias("d")).collect()

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    for r in got:
        want = None if r.a is None or r.b is None else 2 if len(r.a) == 3_000 else table(r.a, r.b)
        assert r.d == want
    numbers = spark.createDataFrame([([1, 2, 3], [1, 3, 4, 5])], "a array<int>, b array<int>").select(S.reading_order_error(F.col("a"), F.col("b")).alias("e")).first()
    assert numbers.e == pytest.approx(3 / 4)


def test_edit_distance_is_the_table_one(spark):
    draw = random.Random(5)
    text = lambda n: "".join(draw.choices("ab é\U0001f600", k=n))
    rows = [(text(draw.randrange(0, 90)), text(draw.randrange(0, 90))) for _ in range(300)] + [("", ""), ("", "abc"), (None, "a"), ("a", None), ("x" * 200, "y" * 70), ("abcdef" * 30, "abdef" * 31)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select(S.edit_distance("a", "b").alias("d"), F.levenshtein("a", "b").alias("l"), S.edit_ratio(F.col("a"), F.col("b")).alias("r"), S.edit_ratio(F.col("a"), F.col("b"), F.levenshtein).alias("s")).collect():
        assert r["d"] == r["l"] and r["r"] == r["s"]


def test_edit_distance_of_long_texts_fills_no_table():
    # a table of these would have 1.6 thousand million cells
    a, b = "abcd" * 10_000, "abce" * 10_000
    assert edit_distance_of(a, b) == 10_000
