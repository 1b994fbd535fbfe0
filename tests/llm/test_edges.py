"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest

from corpus_pipeline import STAGES
from scorewright.llm.decontaminate import contaminated
from scorewright.llm.html_text import extract_text
from scorewright.llm.language_model import language_scores
from scorewright.llm.line_dedup import line_dedup
from scorewright.llm.mixing import mixed
from scorewright.llm.near_duplicates import near_duplicates
from scorewright.llm.neighbours import nearest_vectors
from scorewright.llm.quality import quality
from scorewright.llm.token_counts import token_counts
from scorewright.llm.toxicity import toxicity

LONG = " ".join(f"w{i % 997}" for i in range(20_000))
PASSAGE = " ".join(f"item{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, size long, copies int, n_lines int, root long, held_out int"
ROWS = [
    (1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, LONG),
    (None, "a row that has no id at all but words"), (None, None), (7, f"before\n{PASSAGE}\nafter"), (8, f"{PASSAGE}\nother words"), (9, "one two"), (10, "one two"),
    (11, "bad0 " * 3 + "fine words"), (12, "Éa ß 日本 <|endoftext|> x"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 9 else f"s{(i or 0) % 3}", 0, 9.0, 1, 2, 3, 4, 5, 6) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (5, 1, 0), (7, 0, 0), (8, None, None), (None, 1, 1), (11, 0, 1), (9, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (4, "one two"), (None, "no id words of a benchmark item here")], "item_id long, text string")


def test_token_counts(docs):
    out = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    rows = out.collect()
    assert len(rows) == len(ROWS) and "text" not in out.columns
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    assert [r.over_limit for r in rows if r.doc_id in (5, 6)] == [True, True]


def test_near_duplicates(docs):
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(3, 1, True)] * 2
    assert by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)]
    assert by[5][0][1] == by[6][0][1] == 5 and by[6][0][2] is False
    assert by[10] == [(1, 9, False)]
    assert sorted(by[None], key=str) == [(0, None, False), (6, None, False)]
    # one of each distinct row stays, and one of each of three groups
    assert len({r.row_key for r in rows if r.stays}) == len({(i, t or "") for i, t in ROWS}) - 3


def test_line_dedup(docs):
    out = line_dedup(docs)
    rows = {(r.doc_id, r.n_chars): r for r in out.collect()}
    assert out.count() == len(ROWS) and set(docs.columns) | {"n_removed"} == set(out.columns)
    assert rows[(7, 0)].text == f"before\n{PASSAGE}\nafter" and rows[(8, 0)].text == "other words" and rows[(8, 0)].n_removed == 1
    assert rows[(6, 0)].text == "" and rows[(5, 0)].text == LONG
    assert rows[(2, 0)].text is None and rows[(2, 0)].n_lines == 0 and rows[(4, 0)].text == " \t\n "


def test_decontaminate(docs, benchmark):
    rows = {(r.doc_id, r.item_id): r for r in contaminated(docs, benchmark).collect()}
    assert set(rows) == {(7, 1), (8, 1), (9, 4), (10, 4)}
    assert rows[(7, 1)].start_word == 1 and rows[(8, 1)].start_word == 0 and rows[(7, 1)].similarity == 1.0


def test_scores(docs, labels):
    for out in (toxicity(docs, labels), quality(docs, labels), toxicity(docs, labels.limit(0)), quality(docs, labels.limit(0))):
        rows = out.collect()
        assert len(rows) == len(ROWS) and out.columns.count("score") == 1
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in rows)
        assert all(r.held_out for r in rows if r.doc_id is None)


def test_language_scores(docs):
    rows = language_scores(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (2, 3, 4))
    assert len({(r.n_tokens, r.base_score, r.score) for r in rows if r.doc_id == 1}) == 1
    assert all(r.score <= 0 and r.base_score <= 0 for r in rows)


def test_mixing(docs):
    rows = mixed(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["size"] == 0 and r.taken == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert all(r.taken <= 3 * r["size"] for r in rows)


def test_nearest_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [0.0, 2.0]), (8, None), (200, [0.0, 0.0]), (9, [float("nan"), 1.0]), (300, [float("inf"), 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, block int")
    out = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest_vectors(vectors).collect()}
    assert out == {(0, 1): (5, 0.0), (0, 2): (100, 0.0), (0, 3): (7, 5**0.5), (100, 1): (0, 0.0), (100, 2): (5, 0.0), (100, 3): (7, 5**0.5)}
    assert nearest_vectors(vectors.limit(0)).count() == 0


def test_html(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "<article><p>Fish &amp;  chips are good to eat.</p><p>Twice a day.</p></article><nav>x</nav>"), (4, "<p>" + "word " * 50_000 + "</p>")]
    pages = spark.createDataFrame([(i, "u", h, "clash", 3) for i, h in rows], "page_id long, url string, html string, text string, n_chars int")
    out = {r.page_id: r for r in extract_text(pages).collect()}
    assert out[1].text == out[2].text == "" and out[3].text == "Fish & chips are good to eat.\nTwice a day."
    assert out[4].n_chars == 50_000 * 5 - 1


def test_empty_tables(spark, labels, benchmark):
    none = frame(spark).limit(0)
    for out in (token_counts(none, public_tokenizers.path("byte_bpe_50k.json")), near_duplicates(none), line_dedup(none), contaminated(none, benchmark), toxicity(none, labels),
                quality(none, labels), language_scores(none), mixed(none)):
        assert out.count() == 0
    assert contaminated(frame(spark), benchmark.limit(0)).count() == 0


def test_stages(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(STAGES):
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            assert set(docs.columns) <= set(out.columns), name
            assert k == len(STAGES) - 1 or out.columns == docs.columns
            n = out.count()
            assert (n > 0) == (rows is docs)
    kept = {r.doc_id for r in STAGES[3][1](spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i, _ in ROWS} - {7, 8, 9, 10}
