"""Benchmark passages against a comparison of all windows."""

import collections
import random

import pytest

from scorewright.llm.decontaminate import contaminated


def shingles(words):
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def every_start(docs, items):
    """The best window at 0.75 or more of each document and item over all starts, ties to one that lines up, then to the smaller."""
    parts = lambda x: [tuple(x[i : i + 5]) for i in range(max(len(x) - 4, 1))]
    out = {}
    for d, text in docs:
        for i, item in items:
            w, v = text.split(), item.split()
            best, end = (0.0, False, 0), len(w) - len(v)
            places = {min(p - q, end) if p > q else 0 for p, a in enumerate(parts(w)) for q, b in enumerate(parts(v)) if a == b}
            for start in range(max(len(w) - len(v), 0) + 1):
                a, b = shingles(w[start : start + len(v)]), shingles(v)
                low = (a & b).total()
                best = max(best, (low / (a.total() + b.total() - low), start in places, -start))
            if best[0] >= 0.75:
                out[d, i] = (-best[2], pytest.approx(best[0]))
    return out


def found(spark, docs, items):
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in rows}


def test_passages_that_do_not_line_up(spark):
    rng = random.Random(5)
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    item = [f"w{i}" for i in range(100)]
    refrain = ("la la la la la la so " * 6).split() + [f"v{i}" for i in range(60)]
    items = [(1, " ".join(item)), (2, " ".join(refrain)), (3, " ".join(item[:40])), (4, " ".join(f"w{i}" for i in range(60, 100)))]
    parts = [item[50:] + item[:50], item[33:66] + item[66:] + item[:33], item[:20] + item[60:] + item[20:60], item[:50] + ["x"] + item[50:], item[:30] + item[34:],
             item[3:95], refrain, refrain[42:] + refrain[:42], ["la"] * 120, item[:25] + fill(50) + item[25:]]
    docs = [(k, " ".join(fill(rng.randrange(80)) + p + fill(rng.randrange(80)))) for k, p in enumerate(parts)]
    docs += [(100 + k, " ".join(p)) for k, p in enumerate(parts)]
    want = every_start(docs, items)
    assert want[0, 1][1] == 0.92 and len(want) > 15
    assert found(spark, docs, items) == want


def test_a_repeated_shingle_that_differs(spark):
    """Prints count each occurrence as an element of its own, so one long repeat does not outweigh all other shingles."""
    body = lambda k: [f"b{k}_{i}" for i in range(268)]
    items = [(k, " ".join(body(k) + ["."] * 44)) for k in range(6)]
    docs = [(k, " ".join(body(k) + ["_"] * 44)) for k in range(6)]
    got = found(spark, docs, items)
    assert set(got) == {(k, k) for k in range(6)} and got == every_start(docs, items)
