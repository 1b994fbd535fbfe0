"""Repair of role order in conversations at the least cost: a run-length dynamic programme over role and fault symbols."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from scorewright.llm.tables import saved

CHUNK_ROWS = 4_096  # distinct rows of a conversation whose programme one call solves
RANGE_ROWS = 200_000  # rows of a sorted range, which one task holds
SOLID = r"[^\x20\x09-\x0D]"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# States are what the repaired roles end in: nothing, system, user, assistant. Only the first and the last may be the end.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_FAR = 1 << 60
_ADDED = (_USER, _USER, _ASSISTANT, _USER)  # state after a user or assistant turn that fits
_KEPT = {"s": (_SYSTEM, None, None, None), "u": (_USER, _USER, None, _USER), "a": (None, None, _ASSISTANT, None), "o": (None,) * 4}
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)  # turns missing at the end of a conversation


def _choices(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of one row in one state, in the order of the edits' letters, insertions apart."""
    found = [("D", DELETE, state)]
    if symbol != "d":
        more = TRUNCATED if symbol.isupper() else 0
        kept = _KEPT[symbol.lower()][state]
        if kept is not None:
            found.append(("K", more, kept))
        found.append(("R", REROLE + more, _ADDED[state]))
    return found


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), _FAR)


@lru_cache(None)
def _power(symbol: str, k: int) -> np.ndarray:
    """Min-plus transition of 2**k rows of one symbol, insertions before each of them included."""
    if k:
        half = _power(symbol, k - 1)
        return _product(half, half)
    step = np.full((4, 4), _FAR, np.int64)
    for state in range(4):
        here = state
        for added in range(4):
            for _, cost, to in _choices(symbol, here):
                step[state, to] = min(step[state, to], added * INSERT + cost)
            here = _ADDED[here]
    return step


def _before(symbol: str, n: int, after: np.ndarray) -> np.ndarray:
    """Costs to go, by state, before a run of ``n`` equal symbols, from those after it."""
    k = 0
    while n:
        if n & 1:
            after = np.minimum((_power(symbol, k) + after[None, :]).min(1), _FAR)
        n, k = n >> 1, k + 1
    return after


def _runs(sequence: str) -> list[tuple[str, int]]:
    """Runs of a chunk, written as a letter for each row, with the number of its further copies (all to be deleted) behind it."""
    runs: list[tuple[str, int]] = []
    for symbol, copies in re.findall(r"([a-zA-Z])(\d*)", sequence):
        for s, n in ((symbol, 1), ("d", int(copies or 0))):
            if n and runs and runs[-1][0] == s:
                runs[-1] = (s, runs[-1][1] + n)
            elif n:
                runs.append((s, n))
    return runs


def transition(sequence: str) -> np.ndarray:
    """Min-plus transition of a whole chunk."""
    total = np.full((4, 4), _FAR, np.int64)
    np.fill_diagonal(total, 0)
    for symbol, n in _runs(sequence):
        k = 0
        while n:
            if n & 1:
                total = _product(total, _power(symbol, k))
            n, k = n >> 1, k + 1
    return total


def solve(sequence: str, after: tuple[int, ...] | None = None, state: int = _START) -> tuple[int, list[str], str, int]:
    """(cost, edits of each row, edits at the end, last state) of a chunk entered in ``state``; ``after`` are the costs to go beyond it by state.

    Without ``after`` the conversation ends with the chunk. Among the cheapest edits the letters are the least: from a row and a state each letter leads to
    one state only, so taking the least letter that keeps the least cost is exact. Edits are written K, D, X and Y (role made user or assistant), with
    U and A for turns inserted before them.
    """
    ends = after is None
    costs = _END if ends else np.array(after, np.int64)
    runs = _runs(sequence)
    behind = [costs]
    for symbol, n in reversed(runs):
        behind.append(_before(symbol, n, behind[-1]))
    behind.reverse()
    total = int(behind[0][state])
    edits: list[str] = []
    for (symbol, n), last in zip(runs, behind[1:]):
        if symbol == "d":
            edits.append("D" * n)
            continue
        inner = [last]
        for _ in range(n):
            inner.append(_before(symbol, 1, inner[-1]))
        for i in range(n, 0, -1):
            here, then, letters = inner[i], inner[i - 1], ""
            while True:
                goal = here[state]
                options = [("I", INSERT + here[_ADDED[state]], _ADDED[state])]
                options += [(e, cost + then[to], to) for e, cost, to in _choices(symbol, state)]
                edit, _, to = min(o for o in options if o[1] == goal)
                letters += {"I": " UA"[to - 1], "R": " XY"[to - 1]}.get(edit, edit)
                state = to
                if edit != "I":
                    break
            edits.append(letters)
    # runs of deletions hold further copies of a row too: each row takes its own first
    flat: list[str] = []
    for e in edits:
        flat.extend(e if e[0] == "D" else [e])
    rows, at = [], 0
    for _, copies in re.findall(r"([a-zA-Z])(\d*)", sequence):
        size = 1 + int(copies or 0)
        rows.append("".join(flat[at : at + size]))
        at += size
    tail = ""
    while ends and costs[state]:
        state = _ADDED[state]
        tail += " UA"[state - 1]
    return total, rows, tail, state


@lru_cache(20_000)
def _solved(sequence: str, after: tuple[int, ...] | None, state: int) -> tuple[int, list[str], str, int]:
    """Short conversations repeat their symbols."""
    return solve(sequence, after, state)


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n) of the rows that are left: by crc32(conv_id:turn) % 20, 0 drops a row, 1 empties its text, 2 takes out its
    full stops, exclamation and question marks, 3 doubles it (n = 2), 4 makes its role user. Nulls read as one space, but a null turn or id stays null."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown(conv_id), F.lit(":"), shown(turn)).cast("binary")) % 20
    made = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), fault.alias("fault"))
    return rows.where("fault > 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), made.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("n"))


def _chunks(rows: DataFrame) -> DataFrame:
    """One row per chunk of a conversation, (conv_id, part, sub): its rows in order, their symbols, and what is counted of them.

    Equal rows are one with a count, so a row repeated without end is short. Conversations are cut by sorted ranges of all rows (``part``), and
    ranges by rows and bytes (``sub``), so one that holds most of the rows is dealt to as many tasks as it needs.
    """
    ids = F.col("conv_id")
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum(F.col("n").cast("long")).alias("n"))
    order = [F.col("turn").asc_nulls_first(), F.col("role")]
    rows = rows.repartitionByRange(parts, ids.asc_nulls_first(), *order, F.substring("text", 1, 64)).withColumn("part", F.spark_partition_id())
    rows = saved(rows.withColumn("blank", ~F.col("text").rlike(SOLID)).withColumn("print", F.md5("text")))  # the part of a row is settled here
    # texts that occur at several turns: later ones repeat the first
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    again = rows.where("not blank").groupBy(ids.alias("g_id"), F.col("role").alias("g_role"), F.col("print").alias("g_print"))
    again = again.agg(F.count("*").alias("g_n"), F.min(at).alias("g_first")).where("g_n > 1").drop("g_n")
    rows = rows.join(again, ids.eqNullSafe(F.col("g_id")) & (F.col("role") == F.col("g_role")) & (F.col("print") == F.col("g_print")), "left")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(F.col("blank"), "blank").when(F.coalesce(at > F.col("g_first"), F.lit(False)), "duplicate").when(cut, "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    place = Window.partitionBy("part", "conv_id").orderBy(*order, "text")
    rows = rows.select("part", "conv_id", "turn", "role", "text", "n", fault.alias("fault"), letter.alias("letter"))
    weight = F.sum(1 + F.octet_length("text") / F.lit(2_048)).over(place)
    rows = rows.select("*", (F.row_number().over(place) - 1).alias("pos"), F.lag("letter").over(place).alias("prior"), F.lag("turn").over(place).alias("prior_turn"), F.floor(weight / CHUNK_ROWS).cast("long").alias("sub"))
    blank, duplicate, truncated = (F.col("fault") == f for f in ("blank", "duplicate", "truncated"))
    symbol = F.when(blank | duplicate, "d").when(truncated, F.upper("letter")).otherwise(F.col("letter"))
    code = F.concat(symbol, F.when(F.col("n") > 1, (F.col("n") - 1).cast("string")).otherwise(""))
    fits = F.col("prior").isNull() | F.concat("prior", "letter").isin("su", "ua", "au")
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("prior_turn"))
    ones = lambda c: F.sum(F.when(c, 1).otherwise(0))
    made = rows.groupBy("part", "conv_id", "sub").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "text", code.alias("code"), "letter"))).alias("rows"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), ones(new_turn).alias("turns"),
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank"), F.sum(F.when(blank, 0).when(duplicate, F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        ones(truncated).alias("truncated"), F.sum(F.col("n") - F.when(fits, 1).otherwise(0)).alias("illegal"))
    made = made.withColumn("sequence", F.array_join(F.transform("rows", lambda x: x.code), ""))
    return saved(made.withColumn("head", F.element_at("rows", 1).letter).withColumn("last", F.element_at("rows", -1).letter))


_STEP = pa.struct([("cost", pa.int64()), ("edits", pa.list_(pa.string())), ("tail", pa.string()), ("state", pa.int32())])


@F.arrow_udf(ArrayType(LongType()))
def _transition(sequence: pa.Array) -> pa.Array:
    return pa.array([transition(s).ravel().tolist() for s in sequence.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(ArrayType(ArrayType(LongType())))
def _after(steps: pa.Array) -> pa.Array:
    """Costs to go behind each chunk of a conversation, from the transitions of its chunks; none behind the last."""
    found = []
    for matrices in steps.to_pylist():
        after = [_END]
        for m in reversed(matrices[1:]):
            after.append(np.minimum((np.array(m, np.int64).reshape(4, 4) + after[-1][None, :]).min(1), _FAR))
        found.append([v.tolist() for v in reversed(after[1:])] + [None])
    return pa.array(found, pa.list_(pa.list_(pa.int64())))


@F.arrow_udf(ArrayType(IntegerType()))
def _last_states(sequence: pa.Array, after: pa.Array) -> pa.Array:
    """The state in which a chunk is left, for each state in which it can be entered."""
    return pa.array([[solve(s, a, state)[3] for state in range(4)] for s, a in zip(sequence.to_pylist(), after.to_pylist())], pa.list_(pa.int32()))


@F.arrow_udf(ArrayType(IntegerType()))
def _entered(maps: pa.Array) -> pa.Array:
    """The state in which each chunk of a conversation is entered."""
    found = []
    for states in maps.to_pylist():
        entered = [_START]
        for m in states[:-1]:
            entered.append(m[entered[-1]])
        found.append(entered)
    return pa.array(found, pa.list_(pa.int32()))


@F.arrow_udf(StructType().add("cost", "long").add("edits", ArrayType(StringType())).add("tail", "string").add("state", IntegerType()))
def _solution(sequence: pa.Array, after: pa.Array, state: pa.Array) -> pa.Array:
    rows = zip(sequence.to_pylist(), after.to_pylist(), state.to_pylist())
    steps = [_solved(s, tuple(a) if a else None, b or _START) if len(s) < 64 else solve(s, a, b or _START) for s, a, b in rows]
    return pa.array([dict(zip(("cost", "edits", "tail", "state"), step)) for step in steps], _STEP)


def _by_chunk(rows: DataFrame, column: str, make, name: str) -> DataFrame:
    """(conv_id, part, sub, name): ``make`` over the values of ``column`` in the order of the chunks, dealt back to them."""
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "sub", column))).alias("v"))
    whole = whole.withColumn("made", make(F.transform("v", lambda x: x[column])))
    return whole.select("conv_id", F.explode(F.arrays_zip("v", "made")).alias("x")).select("conv_id", "x.v.part", "x.v.sub", F.col("x.made").alias(name))


def _meet(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the chunk, a null id being an id like others."""
    right = right.select(F.col("conv_id").alias("__id"), F.col("part").alias("__part"), F.col("sub").alias("__sub"), *[c for c in right.columns if c not in ("conv_id", "part", "sub")])
    on = left["conv_id"].eqNullSafe(F.col("__id")) & (left["part"] == F.col("__part")) & (left["sub"] == F.col("__sub"))
    return left.join(right, on, how).drop("__id", "__part", "__sub")


def repaired(rows: DataFrame) -> DataFrame:
    """Chunks of conversations, (conv_id, part, sub), with the edits of their rows and the repaired turns.

    ``rows`` are (conv_id, turn, role, text, n), each counting n times. A conversation of several chunks is solved in four steps: the transition of each
    chunk, the costs to go behind it, the state it is left in from every state, and the state it is entered in; then every chunk stands alone.
    """
    chunks = _chunks(rows)
    many = chunks.groupBy(F.col("conv_id").alias("m_id")).agg(F.count("*").alias("m_n")).where("m_n > 1").drop("m_n")
    long = chunks.select("conv_id", "part", "sub", "sequence").join(many, F.col("conv_id").eqNullSafe(F.col("m_id")), "left_semi")
    after = _by_chunk(long.withColumn("step", _transition("sequence")), "step", _after, "after")
    long = _meet(long, after, "inner")
    state = _by_chunk(long.withColumn("states", _last_states("sequence", "after")), "states", _entered, "entered")
    plan = saved(_meet(long.drop("sequence"), state, "inner"))
    solved = _meet(chunks, plan, "left").withColumn("solution", _solution("sequence", "after", "entered"))
    turn = lambda role, text: F.concat(role, F.lit(":"), text)

    def made(x: Column, edit: Column) -> Column:
        """The repaired turn, or none, of one letter of an edit."""
        return F.when(edit == "K", turn(x.role, x.text)).when(edit == "X", turn(F.lit("user"), x.text)).when(edit == "Y", turn(F.lit("assistant"), x.text)).when(edit == "U", "user:").when(edit == "A", "assistant:")

    letters = lambda c: F.filter(F.split(c, ""), lambda y: y != "")
    edits = F.col("solution.edits")
    kept = F.flatten(F.zip_with("rows", edits, lambda x, e: F.transform(letters(e), lambda y: made(x, y))))
    tail = F.transform(letters(F.col("solution.tail")), lambda y: F.when(y == "U", "user:").otherwise("assistant:"))
    audit = F.translate(F.concat(F.array_join(edits, ""), F.col("solution.tail")), "UAXY", "IIRR")
    return solved.select("*", F.filter(F.concat(kept, tail), lambda t: t.isNotNull()).alias("turns_left"), audit.alias("audit"), F.col("solution.cost").alias("cost"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) of turns sorted by conversation: a digest is read on from batch to batch, so no conversation is held whole."""
    held, digest, kind = None, None, None
    for batch in batches:
        ids, out, kind = batch.column(0).to_pylist(), ([], []), batch.schema.field(0).type
        for i, text in zip(ids, batch.column(1).to_pylist()):
            if digest is not None and i == held:
                digest.update(b"\n")
            else:
                if digest is not None:
                    out[0].append(held), out[1].append(digest.hexdigest())
                held, digest = i, hashlib.sha256()
            digest.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.string())], ["conv_id", "sha"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], kind), pa.array([digest.hexdigest()])], ["conv_id", "sha"])


def repair_report(conversations: DataFrame, rows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every id of ``conversations``, as ``rows`` hold them.

    ``rows`` are (conv_id, turn, role, text, n), such as ``damaged`` gives: in the order of their turns, nulls first, equal turns by role and text, and a
    row with n > 1 stands n times. Each row has one fault at most: blank (no character but white space), duplicate (role and text seen earlier),
    truncated (its last such character is no full stop, exclamation or question mark). gaps counts the turns missing between the first and the last;
    illegal the neighbours whose role initials are not su, ua or au. Edits cost: keep 0, give the role user or assistant 3, delete 4, insert an
    empty turn of user or assistant 3, and 3 for a truncated row that stays; blank and duplicate rows have to go. The cheapest edits after which the
    role initials read s?(ua)+ or nothing are made; audit holds their initials, of equally cheap ones the least. An id without rows
    has zeros, an empty audit and the digest of nothing. A null id is an id. Columns beside the named ones are not read. Counts beyond a long are null.

    An answer is one row: the audit of a conversation grows with it, and its digest is read in order. All else is done by chunks of bounded size.
    """
    ids = conversations.select(F.col(conv_id).alias("conv_id")).distinct()
    done = repaired(rows)
    done = saved(done.drop("rows", "sequence", "solution", "after", "entered"))
    chunk = Window.partitionBy("conv_id").orderBy("part", "sub")
    narrow = done.withColumn("size", F.count("*").over(Window.partitionBy("conv_id")))
    narrow = narrow.select("*", F.lag("part").over(chunk).alias("p_part"), F.lag("last").over(chunk).alias("p_last"), F.lag("high").over(chunk).alias("p_high"), F.row_number().over(chunk).alias("at"))
    # a range starts without knowing the row before it
    cut = F.col("p_part").isNotNull() & (F.col("p_part") != F.col("part"))
    clash = F.when(cut & ~F.concat("p_last", "head").isin("su", "ua", "au"), 1).otherwise(0)
    same = F.when(cut & (F.col("p_high") == F.col("low")), 1).otherwise(0)
    total = narrow.groupBy("conv_id").agg(
        (F.max("high").cast("decimal(38,0)") - F.min("low") + 1 - F.sum(F.col("turns") - same)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + clash).alias("illegal"), F.max(F.when(F.col("at") == 1, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda x: x.audit), "").alias("audit"))
    total = total.select("conv_id", F.coalesce(F.expr("try_cast(gaps AS BIGINT)"), F.when(F.col("gaps").isNull(), F.lit(0))).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    # texts of conversations in one piece are hashed where they are; the turns of the others are read in order
    one = narrow.where("size = 1").select("conv_id", F.sha2(F.array_join("turns_left", "\n"), 256).alias("sha"))
    several = narrow.where("size > 1").select("conv_id", "at", F.posexplode("turns_left").alias("i", "turn"))
    kind = done.schema["conv_id"].dataType.simpleString()
    several = several.repartition("conv_id").sortWithinPartitions("conv_id", "at", "i").select("conv_id", "turn").mapInArrow(_hashed, f"conv_id {kind}, sha string")
    found = total.select(F.col("conv_id").alias("t_id"), *total.columns[1:])
    shas = one.unionByName(several).select(F.col("conv_id").alias("s_id"), "sha")
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("t_id")), "left").join(shas, F.col("conv_id").eqNullSafe(F.col("s_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    counts = [zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("t_id").isNull() & F.col("blank").isNull(), 0).otherwise(F.col("gaps")).cast("long").alias("gaps")
    return out.select("conv_id", gaps, *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
