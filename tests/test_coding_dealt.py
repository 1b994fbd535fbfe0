"""Dictionary coding: rows are dealt by key once, and a dictionary of any size gives the same codes."""

import pytest

from scorewright.functions import sequence as K
from scorewright.operators import coding


def _rows(spark):
    rows = [(n, [f"w{(n * 7 + i * i) % 50}" if i % 11 else None for i in range(n % 40)]) for n in range(200)] + [(900, None), (901, [])]
    vocabulary = [(f"w{i}", i + 10) for i in range(0, 50, 2)]
    return rows, dict(vocabulary), spark.createDataFrame(rows, "k int, tokens array<string>"), spark.createDataFrame(vocabulary, "token string, id int")


def test_a_small_dictionary_leaves_elements_where_their_row_is(spark):
    _, _, df, v = _rows(spark)
    plan = K.encode(df, "k", "tokens", v)._jdf.queryExecution().executedPlan().toString()
    # once a row is taken apart, nothing is shuffled any more
    assert "Generate" in plan and "Exchange" not in plan.split("Generate")[0] and "SortMergeJoin" not in plan


def test_a_large_dictionary_gives_the_same(spark, monkeypatch):
    rows, known, df, v = _rows(spark)
    want = {k: t if t is None else [known.get(w, 0) for w in t] for k, t in rows}
    for most in (3, 100):
        monkeypatch.setattr(coding, "SENT_ENTRIES", most)
        ids = K.encode(df, "k", "tokens", v)
        assert {r.k: r.ids for r in ids.collect()} == want
        names = {i: w for w, i in known.items()}
        got = {r.k: (r.ids, r.tokens) for r in K.decode(ids, "k", "ids", v, keep=True).collect()}
        assert got == {k: (t, t if t is None else [names.get(i) for i in t]) for k, t in want.items()}


def test_two_rows_of_one_key_are_an_error(spark):
    df = spark.createDataFrame([(1, ["a"]), (1, ["b"])], "k int, tokens array<string>")
    with pytest.raises(Exception, match="two rows have the same k"):
        K.encode(df, "k", "tokens", spark.createDataFrame([("a", 1)], "token string, id int")).collect()
