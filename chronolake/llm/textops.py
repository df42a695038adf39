"""Array code over Arrow batches of texts: word borders and word hashes of many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are worked on at once; a longer document stands alone.
STEP_BYTES = 1 << 20

_blank = np.zeros(256, bool)
_blank[[0x20, *range(9, 14)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self, base: np.uint64):
        self.base, self.known = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            more = np.full(max(n, 1 << 16), self.base, np.uint64)
            more[0] = 1
            self.known = np.cumprod(more, dtype=np.uint64)
        return self.known[:n]


_up, _down = _Powers(BASE), _Powers(BASE_INVERSE)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for all pairs at once, by differences of a prefix polynomial modulo 2**64."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _up.upto(n), out=prefix[1:], dtype=np.uint64)
    raw = (prefix[ends] - prefix[starts]) * _down.upto(n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Words:
    """Words of some documents: hashes, byte borders in `data`, and the documents' first words in `first`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        if lower:
            data = _lower[data]
        self.data, self.offsets = data, offsets
        n = len(data)
        blank = _blank[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = True
            before[1:], after[:-1] = blank[:-1], blank[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            before[inner] = True
            after[inner - 1] = True
        self.starts = np.flatnonzero(~blank & before)
        self.ends = np.flatnonzero(~blank & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = run_hashes(data.astype(np.uint64) + np.uint64(1), self.starts, self.ends) if n else np.zeros(0, np.uint64)

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def steps(texts: pa.Array, lower: bool = False, step: int = STEP_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words); a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words; with fewer words, of the whole sequence; without words none."""
    n = len(word_hashes)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = out * BASE + word_hashes[j : j + n - k + 1]
    return mix(out + np.uint64(k))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
