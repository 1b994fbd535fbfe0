"""Near duplicates where many texts share most of themselves: against all pairs, with and without rounds of leaders."""

import random

import pytest

from scorewright.llm import near_duplicates as module


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            i = len(sets[a] & sets[b])
            if sets[a] and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5_000)}"
    passages = [[word() for _ in range(60)] for _ in range(3)]
    # parts of the first passage as passages of their own
    passages += [passages[0][:52], passages[0][6:], passages[0][:40] + passages[1][:14]]
    rows = []
    for i in range(420):
        held = list(rng.choice(passages))
        tail = [word() for _ in range(rng.randrange(0, 34))]
        text = held + tail if rng.random() < 0.5 else tail + held
        if rng.random() < 0.2:
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    for i in range(420, 470):
        base = rows[rng.randrange(420)][1].split()
        base[rng.randrange(len(base))] = word()
        rows.append((i, " ".join(base)))
    return rows


@pytest.mark.parametrize("rounds", [3, 0])
def test_equals_all_pairs(spark, monkeypatch, rounds):
    monkeypatch.setattr(module, "LEADER_ROUNDS", rounds)
    rows = corpus(rounds)
    got = {r.doc_id: r.component_id for r in module.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = groups(rows)
    assert len(set(want.values())) > 20
    # sketches find two sets at similarity 0.75 with a chance of 0.9999; at the default size nothing may be missing here
    assert got == want
