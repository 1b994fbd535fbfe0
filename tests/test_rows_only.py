"""Operators without a check statement, against plain Python on small inputs."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from scorewright.evaluate import Spec, evaluate
from scorewright.functions import extract as E
from scorewright.functions import score as S
from scorewright.functions.text import words
from scorewright.operators import corpus_metrics, matching
from scorewright.registry import SCORERS, report, score
from scorewright.sources import media, records
from scorewright.streaming import stream


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_rouge_l(spark):
    rows = [(1, "the cat sat down", "the cat lay down"), (1, "the cat sat down", "a cat sat"), (2, "x", "y z")]
    df = spark.createDataFrame(rows, "k int, p string, r string").select("k", words(F.col("p")).alias("p"), words(F.col("r")).alias("r"))
    got = {r.k: r.rouge_l for r in corpus_metrics.rouge_l(df, "k", "p", "r").collect()}
    p = max(lcs(a.split(), b.split()) / len(a.split()) for k, a, b in rows if k == 1)
    r = max(lcs(a.split(), b.split()) / len(b.split()) for k, a, b in rows if k == 1)
    assert got[1] == pytest.approx((1 + 1.44) * p * r / (r + 1.44 * p)) and got[2] == 0.0


def test_bleu_forms_agree(spark):
    rows = [(1, "the cat the cat on the mat", ["the cat is on the mat", "a cat on the mat"]), (2, "one two three four five", ["one two three four six"])]
    df = spark.createDataFrame(rows, "id int, p string, rs array<string>")
    pred = df.select("id", words(F.col("p")).alias("tokens"))
    refs = df.select("id", F.posexplode("rs").alias("ref", "x")).select("id", "ref", words(F.col("x")).alias("tokens"))
    a = corpus_metrics.bleu(pred, refs, "id").first()
    b = corpus_metrics.bleu_rows(df.select(words(F.col("p")).alias("p"), F.transform("rs", words).alias("rs")), "p", "rs").first()
    assert list(a) == pytest.approx(list(b))


def test_best_ngram_by_matching_blocks(spark):
    needle, hay = "red wine glass", "a red wine gloss and a blue wine glass set"
    df = spark.createDataFrame([(1, needle, hay), (2, needle, "nothing here at all")], "k int, n string, h string")
    got = {r.k: r for r in matching.best_ngram_match(df, "k", "n", "h", words).collect()}
    toks = hay.split()
    grams = [toks[i:i + 3] for i in range(len(toks) - 2) if set(toks[i:i + 3]) & set(needle.split())]
    best = max(grams, key=lambda g: difflib.SequenceMatcher(None, " ".join(g), needle).ratio())
    assert got[1].best == " ".join(best) and got[2].max_sim == 0.0 and got[2].best == ""


@pytest.mark.parametrize("text, places, want", [("1,234.50 and 2.25%", 2, True), ("3 cats", 2, False), ("3 cats", 0, True), ("1.5e10", 1, True)])
def test_number_precision(one, text, places, want):
    assert one(lambda t: S.text_constraint("number_precision", t, places), t=text) is want


@pytest.mark.parametrize("text, want", [("no digits", True), ("in 1,000 ways", False), ("room B12", True), ("5% off", False)])
def test_no_arabic_number(one, text, want):
    assert one(lambda t: S.text_constraint("no_arabic_number", t), t=text) is want


def test_sentence_rules(one):
    text = "One is here. Two? Three!\n\nFour stands alone."
    assert one(lambda t: F.size(S.sentences(t)), t=text) == 4
    assert one(lambda t: S.text_constraint("sentences_per_listed_paragraph", t, [[3, 3], [1, 1]]), t=text) is True
    assert one(lambda t: S.text_constraint("percent_precision", t, 2), t="10.25 % and 3%") is False


def test_registry_and_evaluate(spark):
    answers = spark.createDataFrame([(i, "ABCD"[i % 4], "x" if i < 6 else "y") for i in range(12)], "idx int, answer string, category string")
    predictions = spark.createDataFrame([(i, f"The answer is {'ABCD'[i % 4] if i % 3 else 'D'}.") for i in range(12)], "idx int, prediction string")
    options = F.create_map(*[F.lit(x) for c in "ABCD" for x in (c, f"text {c}")])
    out = evaluate(predictions, answers, Spec(scorer="exact", report="accuracy_report", extract=lambda df: E.infer(F.col("prediction"), options)))
    got = {(r.dim, r.value): r.acc for r in out.collect()}
    hits = [1.0 if i % 3 or i % 4 == 3 else 0.0 for i in range(12)]
    assert got[("overall", "all")] == pytest.approx(sum(hits) / 12)
    assert got[("category", "x")] == pytest.approx(sum(hits[:6]) / 6)
    near = score(spark.createDataFrame([("ab", "ba")], "a string, b string"), "damerau_similarity", "a", "b").first()["score"]
    assert near == 0.5 and "json_objects" in SCORERS
    assert report(out.withColumn("hit", F.lit(1)), "count_histogram", value="dim").count() == 2


def test_folders_and_files(spark, tmp_path):
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "1.jpg").write_bytes(b"img")
    (tmp_path / "cat" / "1.caption").write_text(" a cat \n")
    (tmp_path / "cat" / "2.caption").write_text("no image")
    (tmp_path / "labels").write_text("cat: house cat\ndog: big dog")
    got = media.read_image_triplets(spark, str(tmp_path / "cat")).collect()
    assert [(r.base, r.caption.strip(), r.short_caption) for r in got] == [("1", "a cat", "")]
    rows = media.read_labelled_folders(spark, str(tmp_path), str(tmp_path / "labels")).collect()
    assert [(r.label, r.description) for r in rows] == [("cat", "house cat")]
    (tmp_path / "ids.json").write_text('["a/b/t1", "t2"]')
    assert [r.id for r in records.read_id_list(spark, str(tmp_path / "ids.json")).collect()] == ["t1", "t2"]


def test_stream_scores_an_index_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write = lambda rows: spark.createDataFrame(rows, "idx int, prediction string, answer string").write.mode("append").parquet(src)
    schema = "idx int, prediction string, answer string"
    for rows in ([(1, "a", "a"), (2, "b", "c")], [(2, "c", "c"), (3, "d", "d")]):
        write(rows)
        df = stream.stream_score(stream.read_files(spark, src, schema), "idx", S.exact(F.col("prediction"), F.col("answer")))
        stream.append_batches(df, out, str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(out).groupBy("idx").count().collect()
    assert sorted((r.idx, r["count"]) for r in got) == [(1, 1), (2, 1), (3, 1)]


def test_stream_state_goes_on_between_runs(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "scene int, ts int, x double"
    for rows in ([(1, 1, 0.0), (2, 1, 5.0)], [(1, 2, 1.0)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        df = stream.stream_latest_frame(stream.read_files(spark, src, schema), "scene", ["ts"])
        stream.snapshot_batches(df, out, str(tmp_path / "state")).awaitTermination()
    got = stream.latest_batch(spark, out).collect()
    assert sorted((r.scene, r.ts, r.x) for r in got) == [(1, 2, 1.0), (2, 1, 5.0)]


def test_flags_without_words(one):
    assert one(lambda t: S.has_word(t, F.lit("")), t="any text") is True
    assert re.search(r"\b\b", "any text")
