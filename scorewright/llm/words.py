"""Vectorised word, shingle and prefix hashes of Arrow text batches (numpy, one pass over the UTF-8 bytes).

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. The hash of a byte range is a polynomial over random byte values
modulo 2**64, read off a running sum, so any range costs two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240229))
_FOLDED = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_FOLDED[65:91] = _FOLDED[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = np.full(n, _STEP if kind == "up" else _BACK, np.uint64)
        base[0] = 1
        _powers[kind] = np.multiply.accumulate(base)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of one slice of texts: ``start``/``end`` byte offsets, ``first[i]:first[i+1]`` are the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            before[1:] = ~solid[:-1]
            after[:-1] = ~solid[1:]
        self.start = np.flatnonzero(solid & (before | edge[:-1]))
        self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_FOLDED[data] * _power("up", max(n, 1))[:n], out=self._sum[1:])

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * _power("down", len(self.data) + 1)[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.range_hash(self.start, self.end)

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are longer than ``size`` bytes, and the hash of the first ``size`` bytes of each of those."""
        longer = self.end - self.start > size
        start = self.start[longer]
        return longer, mix(self.range_hash(start, start + size) + np.uint64(size))


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, Words]]:
    """The texts of a batch in slices of bounded size: (row of the first text, its words). Nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` hashes, whatever text they belong to."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + len(out)]
    return mix(out + np.uint64(n))


def shingle_sets(texts: pa.Array | pa.ChunkedArray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text, its distinct shingles as sorted 63-bit hashes; a shorter text with words has one shingle, the whole sequence."""
    for _, words in slices(texts):
        hashes = words.hashes()
        runs = grams(hashes, size) >> np.uint64(1)
        first = words.first
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1]).view(np.int64)
            elif b > a:
                yield (grams(hashes[a:b], b - a) >> np.uint64(1)).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.ListArray:
    """An Arrow list column from one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))
