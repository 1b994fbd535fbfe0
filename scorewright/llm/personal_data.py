"""Personal data in texts: spans by pattern, and more by a character-level LSTM-CRF that learns from them."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from scorewright.llm.tables import saved, small_batches
from scorewright.llm.tagger import Tagger, classes, tags

KINDS = ("email", "ip", "card", "phone")
WINDOW = 96
STRIDE = 48  # a span of up to so many characters lies whole in a window
MAX_WINDOWS = 1_500  # windows with spans, and as many without, that the tagger learns from
TRAINED = 3_000  # windows it sees in an epoch, rewritten copies included
EPOCHS = 8
MARGIN = 4.0  # log odds a span needs over no span
_BLOCK = 512

# The patterns of the base spans.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile("[0-9@]")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, int]]:
    """A match is the longest run of local characters before an ``@``, up to the match before, with a domain behind: each text position is read once."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done, 0))
        else:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points: the leftmost matches of each kind that do not overlap, failing ones dropped; by start, then kind."""
    found = _emails(text)
    if _DIGITS.search(text):
        found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def windows(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str, str | None]]:
    """(start, text, labels) of the overlapping windows that hold a digit or an ``@``; without either no span can be. Labels are base spans within, or
    none where the window cuts one or two overlap."""
    starts: list[int] = []
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    for m in _TRIGGER.finditer(text):
        for k in range(max(0, (m.start() - WINDOW) // STRIDE + 1), min(last, m.start() // STRIDE) + 1):
            if not starts or k > starts[-1]:
                starts.append(k)
    found, first = [], 0
    for k in starts:
        start, end = k * STRIDE, min(len(text), k * STRIDE + WINDOW)
        while first < len(base) and base[first][0] < start and base[first][1] <= start:
            first += 1
        held, whole, reach = [], True, start
        for a, b, kind in base[first:]:
            if a >= end:
                break
            if b > start:
                whole &= a >= reach and b <= end
                reach = max(reach, b)
                held.append(f"{a - start}:{b - start}:{kind}")
        found.append((start, text[start:end], ",".join(held) if whole else None))
    return found


# ---- rewriting of labelled windows, so that the tagger meets other forms of the same data


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _one(rng: np.random.Generator, *options: str) -> str:
    return options[rng.integers(len(options))]


def _letters(rng: np.random.Generator, low: int, high: int) -> str:
    return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(low, high)))


def _written(kind: int, rng: np.random.Generator) -> str:
    """Data of a kind in one of many forms."""
    if kind == 0:
        name = _letters(rng, 2, 10) + _one(rng, "", "." + _letters(rng, 2, 8), "_" + _number(rng, 2), "." + _number(rng, 2), _number(rng, 3))
        return name + _one(rng, "@", " @ ", "(@)", "[@]", " [@] ", "@ ") + _letters(rng, 2, 10) + _one(rng, "", _number(rng, 1), "-" + _letters(rng, 2, 5)) + "." + _one(rng, "com", "org", "de", "example.com", "co.uk")
    if kind == 1:
        return _one(rng, ".", ".", " . ", "[.]", "(.)", ". ").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        digits = _number(rng, 15)
        digits += next(str(c) for c in range(10) if luhn(digits + str(c)))
        return _one(rng, "", "-", " ", ".", "/", "  ", "_", " ", " - ").join(digits[i : i + 4] for i in range(0, 16, 4))
    area, a, b, gap = _number(rng, 3), _number(rng, 3), _number(rng, 4), _one(rng, "-", ".", " ", "/")
    return _one(rng, f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}{gap}{a}{gap}{b}", f"1{gap}{area}{gap}{a}{gap}{b}", f"+{_number(rng, 2)}{gap}{_number(rng, 2)}{gap}{a}{gap}{b}", f"00{_number(rng, 2)} {area} {a}{b}")


def _harmless(rng: np.random.Generator) -> str:
    """Digits and signs that are no personal data."""
    n = lambda k: _number(rng, k)
    mixed = "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, rng.integers(8, 40)))
    return _one(rng, mixed, f'token = "{mixed}"', f"20{n(2)}-0{n(1)}-1{n(1)}", f"{n(2)}.{n(2)}.20{n(2)}", f"{n(2)}:{n(2)}:{n(2)}", f"${n(1)},{n(3)}.{n(2)}", n(rng.integers(1, 9)), f"{n(1)}.{n(5)}", f"v{n(1)}.{n(1)}.{n(2)}",
                f"{n(2)}-{n(2)}", f"#{n(5)}", f"@{_letters(rng, 3, 9)}", f"{n(1)},{n(3)},{n(3)}", f"{n(2)} %", f"{n(4)}/{n(2)}", f"{n(1)}.{n(1)}.{n(1)}", f"{_letters(rng, 2, 6)}{n(3)}")


def _rewritten(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A labelled window with its spans written anew: mostly in another form of their kind, at times as another kind or as something harmless."""
    out, made, at = "", [], 0
    for start, end, kind in spans:
        out += text[at:start]
        at, pick = end, rng.random()
        new = _harmless(rng) if pick < 0.25 else _written(kind if pick < 0.7 else int(rng.integers(len(KINDS))), rng)
        if pick >= 0.25:
            made.append((len(out), len(out) + len(new), kind if pick < 0.7 else -1))
            if pick >= 0.7:
                made[-1] = (*made[-1][:2], _kind_of(new))
        out += new
    out = (out + text[at:])[:WINDOW]
    return out, [(a, min(b, len(out)), k) for a, b, k in made if a < len(out)]


def _kind_of(text: str) -> int:
    digits = len(_DIGITS.findall(text))
    return 0 if "@" in text else 2 if digits == 16 else 3 if digits > 9 and ("+" in text or re.search(r"[0-9]{3}[^0-9]{1,2}[0-9]{3,4}", text)) else 1


def trained(examples: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 4) -> Tagger:
    """A tagger fitted to labelled windows and to rewritten copies of them."""
    rng = np.random.Generator(np.random.PCG64(seed))
    seen = list(examples)
    held = [e for e in examples if e[1]]
    while held and len(seen) < TRAINED:
        seen.append(_rewritten(*held[len(seen) % len(held)], rng))
    tagger = Tagger(len(KINDS))
    tagger.train(classes([t for t, _ in seen], WINDOW), np.stack([tags(s, WINDOW) for _, s in seen]), EPOCHS, batch=64)
    return tagger


# ---- decoding


def plausible(text: str, kind: int) -> bool:
    """What a span of a kind must hold, whatever its form: an ``@`` and a dot; four numbers up to 255; 12 to 19 digits with their check digit; 7 to 15 digits."""
    if kind == 0:
        return re.search(r"[^\s@]\W*@\W*[^\s@]+\.", text) is not None
    numbers = re.findall("[0-9]+", text)
    digits = "".join(numbers)
    if kind == 1:
        return len(numbers) == 4 and all(len(p) < 4 and int(p) < 256 for p in numbers)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def reconciled(spans: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """One set of spans of a whole text from those of all its windows: of spans that do not overlap each other nor a base span, those with the largest
    sum of margins. A span seen in two windows counts with the larger margin."""
    best: dict[tuple[int, int, int], float] = {}
    for *span, margin in spans:
        best[tuple(span)] = max(margin, best.get(tuple(span), 0.0))
    # base spans by start, with the furthest end so far, to look up an overlap
    starts, reach = [s for s, _, _ in base], []
    for _, end, _ in base:
        reach.append(max(end, reach[-1] if reach else 0))
    free = [s for s in best if not ((i := bisect_right(starts, s[1] - 1)) and reach[i - 1] > s[0])]
    free.sort(key=lambda s: (s[1], s))
    ends, total, taken = [s[1] for s in free], [0.0], []
    for i, s in enumerate(free):
        before = bisect_right(ends, s[0], 0, i)
        taken.append(total[before] + best[s] > total[-1])
        total.append(max(total[-1], total[before] + best[s]))
    kept, i = [], len(free)
    while i:
        if taken[i - 1]:
            kept.append(free[i - 1])
            i = bisect_right(ends, free[i - 1][0], 0, i - 1)
        else:
            i -= 1
    return kept


def found(tagger: Tagger, pieces: list[tuple[int, str, bool]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the tagger adds to a text, from its windows (start, text, whether the text goes on behind)."""
    spans = []
    for at in range(0, len(pieces), _BLOCK):
        block = pieces[at : at + _BLOCK]
        for (start, text, more), held in zip(block, tagger.decode(classes([p[1] for p in block], WINDOW))):
            for a, b, kind, margin in held:
                b = min(b, len(text))
                # a span at a cut edge may go on beyond it
                cut = (a == 0 and start > 0) or (b == len(text) and more)
                if a < b and not cut and margin >= MARGIN and _TRIGGER.search(text, a, b) and plausible(text[a:b], kind):
                    spans.append((start + a, start + b, kind, margin))
    return reconciled(spans, base)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("added", pa.bool_())])
_SPANS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("kind", IntegerType()).add("added", "boolean"))
_PIECE = pa.struct([("start", pa.int32()), ("text", pa.string()), ("labels", pa.string())])


@F.arrow_udf(StructType().add("base", ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("kind", IntegerType()))).add("size", IntegerType()).add("windows", ArrayType(StructType().add("start", IntegerType()).add("text", StringType()).add("labels", StringType()))))
def _scanned(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        base = base_spans(text or "")
        out.append({"base": [dict(zip(("start", "end", "kind"), s)) for s in base], "size": len(text or ""), "windows": [dict(zip(("start", "text", "labels"), w)) for w in windows(text or "", base)]})
    kind = pa.struct([("base", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))), ("size", pa.int32()), ("windows", pa.list_(_PIECE))])
    return pa.array(out, kind)


def _examples(scanned: DataFrame) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most MAX_WINDOWS different labelled windows with spans and as many without, by a hash of their text."""
    w = scanned.select(F.explode("scan.windows").alias("w")).where("w.labels is not null").select("w.text", "w.labels").distinct()
    rank = F.xxhash64("text", "labels")
    rows = [r for some in (w.where("labels <> ''"), w.where("labels = ''")) for r in some.orderBy(rank, "text", "labels").limit(MAX_WINDOWS).collect()]
    return [(r["text"], [tuple(map(int, s.split(":"))) for s in r["labels"].split(",")] if r["labels"] else []) for r in rows]


def personal_data(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``spans`` added: an array of (start, end, kind, added), by start, then kind; offsets in code points, the end exclusive.

    Spans found by pattern (email addresses, IPv4 addresses, card and phone numbers; ``added`` is false) teach a tagger: a character-level bidirectional
    LSTM with CRF transitions, which reads overlapping windows of every text that hold a digit or an ``@``, the least that any span holds. What
    it finds beyond the patterns is added when its log odds reach MARGIN, its digits make sense for the kind, and it lies within a window; windows
    that disagree are settled for the whole text by the largest sum of margins among spans that overlap neither each other nor a pattern's.
    At most MAX_WINDOWS windows with spans and as many without are learned from; where no text has a span, none is added. A null or empty text has
    no spans. Repeated rows give repeated results; a column of ``docs`` named spans is replaced.
    """
    kept = [c for c in docs.columns if c != "spans" and (keep_text or c != text)]
    whole = F.col(text).cast("string")
    seen = F.when(whole.rlike("[0-9@]"), whole)  # other texts have nothing to find
    with small_batches(docs.sparkSession):
        scanned = saved(docs.select(F.struct(*kept).alias("row"), _scanned(seen).alias("scan")))
    examples = _examples(scanned)
    tagger = trained(examples) if any(s for _, s in examples) else None

    @F.arrow_udf(_SPANS)
    def settled(scans: pa.Array) -> pa.Array:
        out = []
        for scan in scans.to_pylist():
            base = [(s["start"], s["end"], s["kind"]) for s in scan["base"]]
            pieces = [(w["start"], w["text"], w["start"] + WINDOW < scan["size"]) for w in scan["windows"]]
            added = found(tagger, pieces, base) if tagger else []
            spans = sorted([(*s, False) for s in base] + [(*s, True) for s in added], key=lambda s: (s[0], s[2], s[1]))
            out.append([dict(zip(("start", "end", "kind", "added"), s)) for s in spans])
        return pa.array(out, pa.list_(_SPAN))

    return scanned.select("row.*", settled(F.col("scan")).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def counted(found: DataFrame) -> DataFrame:
    """The spans of each row as numbers: n_email, n_ip, n_card, n_phone and base_sha256 of those found by pattern, ``spans`` as a list of all, n_added."""
    base = F.filter("spans", lambda s: ~s.added)
    of = lambda k: F.size(F.filter(base, lambda s: s.kind == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    added = F.size(F.filter("spans", lambda s: s.added)).cast("long").alias("n_added")
    kept = [c for c in found.columns if c not in ("spans", "base_sha256", "n_added", *(f"n_{k}" for k in KINDS))]
    return found.select(*kept, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), added)
