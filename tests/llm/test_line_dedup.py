"""Line dedup against its check statement on many small corpora with permuted, repeated and overlapping windows."""

import duckdb
import numpy as np

from scorewright.llm.line_dedup import line_dedup
from scorewright.llm.queries import ORACLE


def corpora(n):
    """Documents of few different lines, so that the same lines stand in many orders; lines carry their corpus, so corpora do not meet."""
    rng = np.random.default_rng(21)
    docs = []
    for c in range(n):
        lines = [f"c{c} line{k} " + "w " * int(rng.integers(0, 9)) for k in range(int(rng.integers(3, 7)))] + ["", f"c{c}"]
        for d in range(int(rng.integers(2, 6))):
            parts = [lines[i] for i in rng.integers(0, len(lines), rng.integers(1, 30))]
            if d and rng.random() < 0.7:
                # a run of an earlier document, whole or with its lines in another order
                old = docs[-1][1].split("\n")
                a = int(rng.integers(0, len(old)))
                run = old[a : a + int(rng.integers(1, 15))]
                parts[len(parts) // 2 : len(parts) // 2] = run if rng.random() < 0.5 else list(rng.permutation(run))
            docs.append((len(docs), "\n".join(parts)))
    return docs


def test_equals_comparison_of_all_places(spark):
    docs = corpora(220)
    got = line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_words=12).select("doc_id", "n_lines", "n_removed", "text").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    want = con.execute("SELECT doc_id, n_lines, n_removed, text FROM (" + ORACLE["op3_line_dedup"].replace("words >= 50", "words >= 12") + ")").fetchall()
    assert sum(r[2] > 0 for r in want) > 100
    assert sorted(map(tuple, got)) == sorted(want)


def test_behind_a_permuted_window(spark):
    line = lambda c: f"{c} {c}1 {c}2"
    text = lambda order: "\n".join(map(line, order))
    docs = [(1, text("ACBD")), (2, text("ABCD")), (3, text("ABCD"))]
    got = {r.doc_id: r.n_removed for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_words=12).collect()}
    assert got == {1: 0, 2: 0, 3: 4}
