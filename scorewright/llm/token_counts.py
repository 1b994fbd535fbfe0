"""Token counts by byte-pair merging with a heap of ranks over a linked list of symbols."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from scorewright.llm.tables import bounded_batches

CACHE_ENTRIES = 1_000_000
# The white space and the split pattern of byte-level byte-pair vocabularies.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(c): b for c, b in [*zip(own, own), *((256 + i, b) for i, b in enumerate(rest))]}


class _Cache(dict):
    """Counts by word, each with ``lead`` before it. A word that ends in a full stop or comma is looked up without it."""

    def __init__(self, counter: Counter, entries: int, lead: str):
        super().__init__()
        self.counter, self.entries, self.lead = counter, entries, lead

    def __missing__(self, word: str) -> int:
        pieces = self.counter.pieces(self.lead + word)
        if len(pieces) == 2 and pieces[1] in (".", ","):
            return self[word[:-1]] + 1
        n = sum(map(self.counter.merged, pieces))
        if len(self) >= self.entries:
            self.clear()
        self[word] = n
        return n


class Counter:
    """Counts tokens of whole texts; ``cache`` holds the counts of recent words and is emptied when full."""

    def __init__(self, vocabulary: str, entries: int = CACHE_ENTRIES):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = _byte_letters(), spec["model"]["vocab"]
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = ids[letter]
        self.rank: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[left] << 20 | ids[right]] = r
            self.merges.append((ids[left], ids[right], ids[left + right]))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_strings = special
        self.pieces = regex.compile(PIECE).findall
        self.heads, self.tails = _Cache(self, entries, ""), _Cache(self, entries, " ")

    def merged(self, piece: str) -> int:
        """Symbols of a piece left after merging: pop the lowest-ranked adjacent pair, first from the left, until none has a rank."""
        symbols = [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]
        n, rank, merges = len(symbols), self.rank.get, self.merges
        # one integer per entry: the rank, then the place of the left symbol
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank(a << 20 | b)) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        symbols.append(-1)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            a, b, new = merges[top >> 32]
            if symbols[i] != a or symbols[j] != b:
                continue  # one side was merged meanwhile
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank(new << 20 | symbols[k])) is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] << 20 | new)) is not None:
                heappush(heap, r << 32 | h)
        return left

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if " ".join(text.split()) != text.replace("\n", " "):
            # white space other than one space or one line feed between two words: the pattern on the whole text
            return sum(map(self.merged, self.pieces(text)))
        # a single space belongs to the word after it, a single line feed is a token of its own
        head, tail, total = self.heads.__getitem__, self.tails.__getitem__, -1
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            total += head(first) + 1 + sum(map(tail, rest))
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and any(s in text for s in self.special_strings):
            return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))
        return self._plain(text)


_counters: dict[tuple[str, int], Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024, entries: int = CACHE_ENTRIES) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``) in place of the text.

    ``vocabulary`` is the path of a byte-level merge table (tokenizers .json) that every executor can open. Counts are those of the whole
    text; special strings inside texts are one token each. A null or empty text has 0 tokens. Repeated rows give repeated results; other
    columns pass through, except that one named like a result is replaced. Each Python worker keeps counts of at most ``entries`` words.
    """
    bounded_batches(docs.sparkSession)
    results = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c != text and c not in results]
    source = docs.select(*kept, F.col(text).alias("n_tokens"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    schema = docs.select(*kept).schema.add("n_tokens", "long").add("n_bytes", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get((vocabulary, entries))
        if counter is None:
            counter = _counters[(vocabulary, entries)] = Counter(vocabulary, entries)
        for batch in batches:
            at = batch.schema.get_field_index("n_tokens")
            counts = pa.array([counter.count(t) for t in batch.column(at).to_pylist()], pa.int64())
            yield batch.set_column(at, "n_tokens", counts)

    counted = source.mapInArrow(run, schema)
    return counted.select(*kept, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
