"""Hot keys and ties: results must be whole and equal to the plain form."""

import random

import pytest
from pyspark.sql import Window, functions as F

from scorewright.operators import intervals, line_match, matching, sampling, skew
from scorewright.operators.joins import missing_pairs
from scorewright.operators.skew import ordered, ranked, salted_join, with_halo
from scorewright.session import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    # key 0 holds over half of the rows and the time 5 is shared by a third of them
    rows = [(i, 0 if rng.random() < 0.6 else rng.randrange(1, 30), 5.0 if rng.random() < 0.35 else float(rng.randrange(100)), rng.randrange(10)) for i in range(20000)]
    return spark.createDataFrame(rows, "id long, k int, t double, v int").repartition(6).cache()


def test_positions_sums_and_next_rows(events):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = events.select("id", (F.row_number().over(w) - 1).alias("p"), F.sum("v").over(w).alias("s"), F.lead("id").over(w).alias("n"))
    got = ordered(events, ["t", "id"], ["k"], position="p", sums={"s": "v"}, following={"n": "id"}).select("id", "p", "s", "n")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_global_positions_have_no_gaps(events):
    got = ranked(events, ["t", "id"], name="p", total="n").agg(F.min("p"), F.max("p"), F.count_distinct("p"), F.max("n")).first()
    assert tuple(got) == (0, 19999, 20000, 20000)


def test_no_bucket_keeps_a_frequent_value_whole(events):
    from scorewright.operators.skew import _bucketed
    top = _bucketed(events, ["t", "id"], 32).groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert top < 20000 * 0.1


def test_halo_windows(events):
    placed = ranked(events, ["t", "id"], ["k"], name="p")
    w = Window.partitionBy("k", "_chunk").orderBy("p").rowsBetween(-2, 3)
    got = with_halo(placed, "p", 2, 3, chunk_rows=500).withColumn("s", F.sum("v").over(w)).filter("_own").select("id", "s")
    want = events.select("id", F.sum("v").over(Window.partitionBy("k").orderBy("t", "id").rowsBetween(-2, 3)).alias("s"))
    assert got.exceptAll(want).isEmpty() and got.count() == 20000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, events, how):
    small = spark.createDataFrame([(k, f"n{k}") for k in range(0, 25)], "k int, name string")
    big = events.select("id", "k").unionByName(events.select((F.col("id") + 20000).alias("id"), F.lit(0).alias("k")))
    got, want = salted_join(big, small, ["k"], how), big.join(small, "k", how).select(salted_join(big, small, ["k"], how).columns)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_interval_sweep_against_brute_force(spark):
    rng = random.Random(1)
    make = lambda: [(k, float(s), float(s + rng.randrange(0, 9))) for k in ("a", "b") for s in [rng.randrange(60) for _ in range(25)]]
    gold, pred = make(), make()
    cover = lambda rows, k: {x / 2 for kk, s, e in rows if kk == k for x in range(int(s * 2), int(e * 2))}
    frame = lambda rows: spark.createDataFrame(rows, "k string, start double, end double")
    got = {r.k: r.iou for r in intervals.interval_iou(frame(gold), frame(pred), "k").collect()}
    for k in ("a", "b"):
        g, p = cover(gold, k), cover(pred, k)
        assert got[k] == pytest.approx(len(g & p) / len(g | p))


def test_overlap_join_against_brute_force(spark):
    rng = random.Random(2)
    rows = lambda n: [(0, i, float(s), float(s + rng.randrange(0, 30))) for i, s in enumerate(rng.randrange(300) for _ in range(n))]
    left, right = rows(60), rows(60)
    frame = lambda r: spark.createDataFrame(r, "k int, id int, start double, end double")
    got = {(r.l_id, r.r_id) for r in intervals.overlap_join(frame(left), frame(right), "k", 13.0).collect()}
    assert got == {(a[1], b[1]) for a in left for b in right if a[2] <= b[3] and b[2] <= a[3]}


def test_components_against_brute_force(spark):
    ensure_checkpoint_dir(spark)
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(0, i) for i in range(500, 600)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in matching.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_every_line_meets_its_cheapest_partner(spark, monkeypatch):
    monkeypatch.setattr(line_match, "BLOCK", 7)
    rng = random.Random(5)
    words = ["the", "quick", "brown", "fox", "jumps", "aaaa", "aaaaaaaaaaaaaaaaaaaa", "é日", "over"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))

    def touched(s):
        s = list(s)
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(s) + 1)
            s[i : i + rng.randrange(2)] = rng.choice(["", "z", "the", "a"])
        return "".join(s) or "z"

    gold = [(p, i, line()) for p in range(4) for i in range(40)]
    pred = [(p, 100 - i, touched(x)) for p, i, x in gold if p < 3 and rng.random() < 0.9] + [(p, 200 + i, line()) for p in range(1, 4) for i in range(5)]
    gold += [(7, 90, "the quick brown fox jumps"), (9, 0, "alone"), (1, 91, " "), (1, 92, "  ")]
    pred += [(7, 290, "teh qiuck brwon fox jmups"), (8, 0, "alone"), (1, 291, " ")]
    frame = lambda r: spark.createDataFrame(r, "page int, pos int, line string")
    got = {(r.page, r.side, r.line): (r.cost, r.other) for r in line_match.best_partners(frame(gold), frame(pred), "page").collect()}
    cost = lambda a, b: 0.0 if a == b else edits(a, b) / max(len(a), len(b))
    want = {}
    for p in range(10):
        g, q = {x for k, _, x in gold if k == p}, {x for k, _, x in pred if k == p}
        if g and q:
            want |= {(p, "g", a): min((cost(a, b), b) for b in q) for a in g} | {(p, "p", b): min((cost(a, b), a) for a in g) for b in q}
    assert got == want
    match = {(r.page, r.gold_line): r.pred_line for r in line_match.greedy_line_match(frame(gold), frame(pred), "page").collect()}
    assert match[(7, "the quick brown fox jumps")] == "teh qiuck brwon fox jmups"


def test_texts_with_a_common_beginning_use_all_buckets(spark):
    rng = random.Random(9)
    keys = [f"https://example.com/a/very/long/common/beginning/{rng.randrange(10**9):09d}" for _ in range(20_000)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, n int").repartition(8)
    sizes = [r["count"] for r in skew._bucketed(df, ["k"], 64).groupBy("_bucket").count().collect()]
    assert len(sizes) >= 60 and max(sizes) <= 3 * len(keys) / 64
    # one text on a third of the rows, with nulls and empty texts around: positions stay exact and the frequent text is cut by the second column
    rows = [(rng.choice([None, "", "z", "same", "same", "é"]) if rng.random() < 0.6 else k, i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k string, n int").repartition(8)
    got = [(r.k, r.n) for r in ranked(df, ["k", "n"], name="at").orderBy("at").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    sizes = [r["count"] for r in skew._bucketed(df, ["k", "n"], 64).groupBy("_bucket").count().collect()]
    assert max(sizes) <= 4 * len(keys) / 64


def test_missing_pairs(spark):
    left = spark.createDataFrame([("m1",), ("m2",)], "m string")
    right = spark.createDataFrame([("d1",), ("d2",)], "d string")
    done = spark.createDataFrame([("m1", "d1")], "m string, d string")
    assert {(r.m, r.d) for r in missing_pairs(left, "m", right, "d", done).collect()} == {("m1", "d2"), ("m2", "d1"), ("m2", "d2")}


def test_resampling_draws_known_shards(spark):
    shards = spark.createDataFrame([(f"s{i}",) for i in range(7)], "shard string")
    got = sampling.resample_shards(shards, "shard", 300).collect()
    assert len(got) == 300 and {r.shard for r in got} == {f"s{i}" for i in range(7)}
