"""Lines of a page paired in one row: against every pair priced, and without tables written beside."""

import os
import random
from collections import Counter

from scorewright.functions.alignment import edit_distance_of, few_edits
from scorewright.operators import line_match
from scorewright.session import ensure_checkpoint_dir

ROWS = "page long, pos int, line string"


def brute(gold, pred):
    def cost(a, b):
        return 0.0 if a == b else edit_distance_of(a, b) / max(len(a), len(b))

    out = []
    for page in {g[0] for g in gold}:
        gs, ps = ([r for r in rows if r[0] == page] for rows in (gold, pred))
        texts = lambda rows: {r[2] for r in rows if r[2] is not None}
        best = lambda line, others: min(((cost(line, o), o) for o in others), default=(None, None))
        copies, taken = Counter(), sorted((r for r in ps if r[2] is not None), key=lambda r: r[1])
        for _, pos, line in sorted(gs, key=lambda r: (r[1], r[2] or "")):
            c, partner = best(line, texts(ps)) if line is not None and page is not None else (None, None)
            same = [r for r in taken if r[2] == partner] if partner is not None and best(partner, texts(gs))[1] == line else []
            hit = same[copies[line]] if copies[line] < len(same) else None
            copies[line] += 1
            out.append((page, pos, line, hit and hit[2], hit and hit[1], round(c, 9) if hit else 1.0))
    return sorted(out, key=repr)


def some(seed, pages):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choice("abé ") for _ in range(draw.randrange(9)))
    gold = [(p, i, draw.choice(["x y z", text(), text(), None])) for p in pages for i in range(draw.randrange(14))]
    def edited(line):
        return line if line is None or draw.random() < 0.4 else line.replace("a", draw.choice(["", "b", "aa"])) + draw.choice(["", "z"])

    return gold, [(p, 50 - i, edited(line)) for p, i, line in gold if draw.random() < 0.9] + [(p, 60, text()) for p in pages]


def matched(spark, gold, pred):
    rows = line_match.greedy_line_match(spark.createDataFrame(gold, ROWS), spark.createDataFrame(pred, ROWS), "page").collect()
    return sorted(((r.page, r.pos, r.gold_line, r.pred_line, r.pred_pos, round(r.edit, 9)) for r in rows), key=repr)


def test_few_edits_equal_the_distance_up_to_their_limit():
    draw = random.Random(11)
    text = lambda n: "".join(draw.choice("abé") for _ in range(draw.randrange(n)))
    for _ in range(4_000):
        a, most = text(60), draw.randrange(9)
        b = text(60) if draw.random() < 0.2 else "".join(draw.choice(["", c, c, c, c, c, c, c, c, c + "x", "y"]) for c in a) + draw.choice(["", " zz"])
        want = edit_distance_of(a, b)
        assert few_edits(a, b, most) == (want if want <= most else None)


def test_pages_equal_every_pair_priced(spark):
    gold, pred = some(3, [*range(25), None])
    gold.append((99, 1, "only gold"))
    assert matched(spark, gold, pred) == brute(gold, pred)


def test_large_pages_go_by_joins(spark, monkeypatch):
    monkeypatch.setattr(line_match, "PAGE_PAIRS", 60)
    gold, pred = some(5, [1, 2, 3, 4, None])
    assert max(Counter(g[0] for g in gold).values()) > 8
    # nulls and empty lines aside: both ways give the same rows
    gold, pred = ([r for r in rows if r[2]] for rows in (gold, pred))
    assert matched(spark, gold, pred) == brute(gold, pred)


def test_pages_write_no_tables_beside_and_shuffle_a_line_once(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    held = set(os.listdir(folder))
    gold, pred = some(7, range(10))
    df = line_match.greedy_line_match(spark.createDataFrame(gold, ROWS), spark.createDataFrame(pred, ROWS), "page")
    assert df.count() == len(gold) and set(os.listdir(folder)) == held
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
