"""Conversation repair against plain search over all edits and against plain loops over whole conversations."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from scorewright.llm import conversations as module
from scorewright.llm.conversations import damaged, repair_report, solve, transition

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def fits(initials):
    return re.fullmatch(r"(s?(ua)+)?", initials) is not None


def search(rows):
    """(cost, audit, repaired) of the cheapest edits of (role, text, fault) rows, by trying every string of edits row by row."""
    best = {"": (0, "", ())}  # keyed by the last initial of what is left
    def insert(states):
        for _ in range(4):
            for last, (cost, audit, out) in list(states.items()):
                role = {"u": "user", "a": "assistant"}[NEXT[last]]
                new = (cost + 3, audit + "I", out + (role + ":",))
                if role[0] not in states or new < states[role[0]]:
                    states[role[0]] = new
        return states
    for role, text, fault in rows:
        step = {}
        for last, (cost, audit, out) in insert(dict(best)).items():
            options = [(last, cost + 4, audit + "D", out)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                to = {"u": "user", "a": "assistant"}[NEXT[last]]
                options.append((to[0], cost + 3 + more, audit + "R", out + (f"{to}:{text}",)))
                if (role[:1] == "s" and last == "") or role[:1] == NEXT[last]:
                    options.append((role[0], cost + more, audit + "K", out + (f"{role}:{text}",)))
            for key, *value in options:
                if key not in step or tuple(value) < step[key]:
                    step[key] = tuple(value)
        best = step
    ends = [v for k, v in insert(best).items() if k in ("", "a")]
    cost, audit, out = min(ends)
    return cost, audit, "\n".join(out)


def letter(role, fault):
    if fault in ("blank", "duplicate"):
        return "d"
    own = role[:1] if role[:1] in ("s", "u", "a") and role[:1] else "o"
    return own.upper() if fault == "truncated" else own


def audit_of(edits, tail):
    return ("".join(edits) + tail).translate(str.maketrans("UAXY", "IIRR"))


def test_all_short_sequences():
    rows = [("system", ""), ("user", ""), ("assistant", ""), ("tool", ""), ("user", "blank"), ("system", "truncated"), ("assistant", "truncated"), ("user", "truncated"), ("tool", "truncated")]
    for n in range(4):
        for chosen in itertools.product(rows, repeat=n):
            text = "".join(letter(r, f) for r, f in chosen)
            cost, edits, tail, _ = solve(text)
            want, audit, _ = search([(r, "t", f) for r, f in chosen])
            assert (cost, audit_of(edits, tail)) == (want, audit), chosen


def exhaustive(rows):
    """Cheapest edits by trying all strings of up to two insertions at every gap: no programme at all."""
    best = None
    gaps = ["", "I", "II"]
    for chosen in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            initials, cost, audit, legal = "", 0, "", True
            for gap, (role, fault), e in zip(chosen, [*rows, ("", "")], [*edits, ""]):
                for _ in gap:
                    initials += NEXT.get(initials[-1:], "u")
                    cost += 3
                audit += gap + e
                if e == "D":
                    cost += 4
                elif e:
                    legal &= fault not in ("blank", "duplicate")
                    cost += 3 * (fault == "truncated") + 3 * (e == "R")
                    initials += NEXT.get(initials[-1:], "u") if e == "R" else role[0]
            if legal and fits(initials) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_search_equals_trying_everything():
    kinds = [("system", ""), ("user", ""), ("assistant", ""), ("tool", ""), ("user", "blank"), ("assistant", "truncated")]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert search([(r, "", f) for r, f in rows])[:2] == exhaustive(list(rows))


def test_long_runs_and_chunks():
    rng = np.random.default_rng(3)
    for _ in range(60):
        text = "".join(s * int(n) for s, n in zip(rng.choice(list("suaoSUAOd"), 12), rng.integers(1, 40, 12)))
        cost, edits, tail, _ = solve(text)
        names = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "d": "user"}
        rows = [(names[c.lower()], "", "blank" if c == "d" else "truncated" if c.isupper() else "") for c in text]
        assert (cost, audit_of(edits, tail)) == search(rows)[:2]
        # the same in two pieces
        cut = len(text) // 2
        after = np.minimum((transition(text[cut:]) + np.array([0, 6, 3, 0])[None, :]).min(1), 1 << 60)
        head = solve(text[:cut], tuple(after.tolist()), 0)
        rest = solve(text[cut:], None, head[3])
        assert head[0] == cost and audit_of(head[1], head[2]) + audit_of(rest[1], rest[2]) == audit_of(edits, tail)
    # further copies of a row are written as a number
    assert solve("u3a")[0] == solve("uddda")[0] == 12 and audit_of(*solve("u3a")[1:3]) == "KDDDK" and solve("u3a")[1] == ["KDDD", "K"]
    # a run of any length takes as many steps as its length has binary digits
    assert transition("u" + str(1 << 40))[0].tolist()[2] == 4 << 40


def plain(rows):
    """The report by loops over the rows of each conversation."""
    found = {}
    for conv, turn, role, text in rows:
        held = found.setdefault(conv, [])
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        held.extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = {}
    for conv, held in found.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in held:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        cost, audit, text = search([(r, t, f) for (_, r, t), f in zip(held, faults)])
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def cases():
    rng = np.random.default_rng(11)
    roles = ["system", "user", "assistant", "tool", "", "User", None]
    texts = ["one.", "two?", "cut off", "", " \t\n", "end!  \n", "é.", None, "x" * 70 + ".", "x" * 70 + "?"]
    rows = []
    for conv in range(120):
        for turn in range(int(rng.integers(1, 9))):
            rows.append((conv, int(turn * rng.integers(1, 3)), roles[rng.choice(7, p=[0.1, 0.4, 0.3, 0.05, 0.05, 0.05, 0.05])], texts[rng.integers(10)]))
    # one long conversation, repeated rows, null turns and ids, equal turns
    rows += [(500, i, ["user", "assistant"][(i // 3) % 2], f"line {i % 40}" + "."[: i % 2]) for i in range(900)]
    rows += [(501, 4, "user", "again.")] * 30 + [(501, i, "user", "again.") for i in range(200)]
    rows += [(502, None, "user", "no turn."), (502, None, "assistant", "none."), (502, None, None, None), (None, 1, "user", "no id."), (None, 2, "assistant", "none."), (None, None, None, None)]
    # long ones whose last turn is missing
    rows += [(510 + j, i, ["user", "assistant"][(i + (i > 30)) % 2], f"turn {i}.") for j in range(9) for i in range(60 + j)]
    rows += [(503, 7, "user", f"t{i}.") for i in range(50)] + [(504, -(1 << 62), "user", "a."), (504, 1 << 62, "assistant", "b.")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, n int, part int, cost string"


@pytest.mark.parametrize("chunk,share", [(4_096, 200_000), (16, 100), (1, 40)])
def test_equals_loops(spark, monkeypatch, chunk, share):
    monkeypatch.setattr(module, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(module, "RANGE_ROWS", share)
    rows = cases()
    df = spark.createDataFrame([(*r, 5, 6, "x") for r in rows], SCHEMA).repartition(7)
    got = {r[0]: tuple(r)[1:] for r in repair_report(df, damaged(df)).collect()}
    want = plain(rows)
    want = {k: (None if v[0] >= 1 << 63 else v[0], *v[1:]) for k, v in want.items()}
    assert {k for k in want if got.get(k) != want[k]} == set() and set(got) == set(want)


def test_empty_and_dropped(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair_report(df, damaged(df)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "a.", 1, 2, "x")], SCHEMA)
    assert [tuple(r) for r in repair_report(df, damaged(df)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
