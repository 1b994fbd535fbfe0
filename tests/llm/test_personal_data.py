"""Personal data: patterns against plain regular expressions, the tagger's gradient and decoding against enumeration, windows and their settlement, held-out forms."""

import hashlib
import itertools
import re

import numpy as np
import pytest

from scorewright.llm import personal_data as module
from scorewright.llm.personal_data import KINDS, WINDOW, base_spans, counted, found, luhn, personal_data, reconciled, trained, windows
from scorewright.llm.tagger import CLASSES, Tagger, classes, tags


def by_patterns(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), 0))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1]))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_patterns():
    rng = np.random.default_rng(5)
    pieces = ["a", "B.c", "@", "x@y.z", ".", "-", "+", "%", " ", "1", "255", "256.", "1.2.3.4", "007", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+", "(", ")", "é", "\n", "日", "12"]
    for _ in range(4_000):
        text = "".join(pieces[i] for i in rng.integers(0, len(pieces), rng.integers(1, 14)))
        assert base_spans(text) == by_patterns(text), text
    for _ in range(4_000):
        text = "".join("@.a1-+ 5("[i] for i in rng.integers(0, 9, rng.integers(1, 25)))
        assert base_spans(text) == by_patterns(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000, "7" * 2_000_000, "a@" * 500_000, "+1" * 500_000, "1.2." * 300_000, "a." * 500_000 + "@" + "b" * 500_000, "1 " * 700_000):
        assert len(base_spans(text)) <= len(text) // 7


def test_windows_cover_every_trigger():
    rng = np.random.default_rng(6)
    for _ in range(300):
        text = "".join("ab1@ "[i] for i in rng.choice(5, rng.integers(0, 400), p=[0.45, 0.45, 0.02, 0.02, 0.06]))
        base = base_spans(text)
        got = windows(text, base)
        last = max(0, -(-(len(text) - WINDOW) // 48))
        want = [k * 48 for k in range(last + 1) if re.search("[0-9@]", text[k * 48 : k * 48 + WINDOW])]
        assert [w[0] for w in got] == want
        for start, piece, labels in got:
            held = [(a - start, b - start, k) for a, b, k in base if a < start + len(piece) and b > start]
            clean = all(a >= 0 and b <= len(piece) for a, b, _ in held) and all(x[1] <= y[0] for x, y in zip(held, held[1:]))
            assert labels == (",".join(f"{a}:{b}:{k}" for a, b, k in held) if clean else None)


def test_gradient():
    tagger = Tagger(2, hidden=3, dtype=np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, CLASSES, (4, 7)), np.stack([tags(s, 7) for s in ([(1, 3, 0), (4, 6, 1)], [], [(0, 7, 1)], [(2, 3, 0)])])
    _, grad = tagger.loss(x, y)
    for name, p in tagger.params.items():
        for _ in range(8):
            i = tuple(rng.integers(0, s) for s in p.shape)
            i = (i[0], int(x[0, 0]), i[2]) if name == "x" else i
            held, ends = p[i], []
            for step in (1e-5, -1e-5):
                p[i] = held + step
                ends.append(tagger.loss(x, y)[0])
            p[i] = held
            assert grad[name][i] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6)


def test_likelihood_and_decoding_equal_enumeration():
    rng = np.random.default_rng(1)
    tagger = Tagger(1, hidden=4, dtype=np.float64)
    tagger.params = {k: v * 4 for k, v in tagger.params.items()}
    x = rng.integers(0, CLASSES, (6, 6))
    e = tagger.emissions(x)
    move = tagger.params["t"] + tagger.barred
    paths = list(itertools.product(range(3), repeat=6))
    for i, held in enumerate(tagger.decode(x)):
        score = {p: sum(e[t, i, p[t]] for t in range(6)) + tagger.first[p[0]] + sum(move[a, b] for a, b in zip(p, p[1:])) for p in paths}
        best = max(score, key=score.get)
        assert tags([s[:3] for s in held], 6).tolist() == list(best)
        for start, end, _, margin in held:
            without = list(best)
            without[start:end] = [0] * (end - start)
            if end == 6 or best[end] == 0:
                assert margin == pytest.approx(score[best] - score[tuple(without)])
        y = tags([(1, 4, 0)], 6)
        total = np.log(sum(np.exp(np.float64(s)) for s in score.values()))
        assert tagger.loss(x[i : i + 1], y[None])[0] == pytest.approx(total - score[tuple(y.tolist())])


def test_settlement_is_the_best_of_all_sets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        spans = [(int(a), int(a + n), int(k), float(m)) for a, n, k, m in zip(rng.integers(0, 30, 8), rng.integers(1, 9, 8), rng.integers(0, 4, 8), rng.integers(1, 50, 8))]
        base = [(int(a), int(a + 3), 0) for a in rng.integers(0, 30, rng.integers(0, 3))]
        base.sort()
        margin = {}
        for *s, m in spans:
            margin[tuple(s)] = max(m, margin.get(tuple(s), 0))
        free = [s for s in margin if all(s[1] <= a or s[0] >= b for a, b, _ in base)]
        best = 0.0
        for n in range(len(free) + 1):
            for some in itertools.combinations(sorted(free), n):
                if all(x[1] <= y[0] for x, y in zip(some, some[1:])):
                    best = max(best, sum(margin[s] for s in some))
        got = sorted(reconciled(spans, base))
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:])) and set(got) <= set(free) and sum(margin[s] for s in got) == best


TALK = "they wrote to us about the matter and we answered in the course of the same week, as usual. "


def examples():
    rng = np.random.default_rng(8)
    out = []
    for i in range(160):
        a = int(rng.integers(0, 40))
        card = "411111111111" + f"{i:03d}"
        data = [f"name.{i}@mail{i % 9}.example.com", f"{i}.{(i * 7) % 256}.3.{i % 99}", card + next(str(c) for c in range(10) if luhn(card + str(c))), f"+1 ({200 + i}) 555-{1000 + i}"][i % 4]
        text = (TALK[:a] + data + " " + TALK)[:WINDOW]
        out.append((text, base_spans(text)))
        out.append((f"in {1900 + i} there were {i * 13} of them, {TALK}"[:WINDOW], []))
    return out


def test_held_out_forms():
    tagger = trained(examples())
    rng = np.random.Generator(np.random.PCG64(77))
    hits, wrong, n = 0, 0, 200

    def spans(text):
        base = base_spans(text)
        return base, found(tagger, [(s, w, s + WINDOW < len(text)) for s, w, _ in windows(text, base)], base)

    for i in range(n):
        data, harmless = module._written(i % 4, rng), module._harmless(rng)
        base, added = spans(TALK + data + " " + TALK)
        reach = sum(min(b, len(TALK) + len(data)) - max(a, len(TALK)) for a, b, _ in base + added)
        hits += reach >= 0.8 * len(data)
        wrong += bool(spans(TALK + harmless + " " + TALK)[1])
    assert hits >= 0.75 * n and wrong <= 0.02 * n


def test_table_and_edges(spark):
    long = ("words without any of it " * 3_000) + "name@mail.example.com " + "9" * 300_000
    texts = [t for t, _ in examples()] + [None, "", " \t\n", long, long, "é日 name@mail.example.com é", "4111 1111 1111 1111", "a" * 200 + "@b.c"]
    rows = [(i if i % 7 else None, t, "x", 1, "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int, scan string").repartition(4)
    out = counted(personal_data(df)).collect()
    assert len(out) == len(rows) and {r.scan for r in out} == {"y"}
    for r in out:
        want = by_patterns(r.text or "") if len(r.text or "") < 10_000 else base_spans(r.text)
        listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for *_, k in want) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r.spans.split(",")) and len(r.spans.split(",")) - (not r.spans) == len(want) + r.n_added
    none = spark.createDataFrame([(1, "no data at 5 o'clock"), (2, None)], "doc_id long, text string")
    assert [(r.spans, r.n_added) for r in counted(personal_data(none, keep_text=False)).collect()] == [("", 0)] * 2
    assert counted(personal_data(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_classes_of_any_text():
    assert classes(["", "a1@日\ud800"], 6).shape == (2, 6)
