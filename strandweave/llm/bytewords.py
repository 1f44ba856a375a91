"""Words of many texts at once, as 64-bit hashes, straight from Arrow's string buffers.

A word is a run of bytes outside a separator class; A-Z are folded to a-z.  The hash is
a polynomial over random byte codes, finished by a mixer: equal words always get equal
hashes, and two of n different words meet with probability about n*n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_ROLL = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of plain words: space and the ASCII controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Separators that also take punctuation away: all ASCII but letters and digits.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = False
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False

_powers_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers_cache or len(_powers_cache[0]) < n:
        size = max(n, 1 << 20)
        _powers_cache[:] = []
        for base in (_P, _P_INV):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers_cache.append(np.multiply.accumulate(a))
    return _powers_cache[0], _powers_cache[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def spans(raw: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; a word never crosses a text's boundary."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~separators[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = off[1:][off[1:] > 0] - 1
    after[ends] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """Hash of each span of bytes, in order and not overlapping; bytes go through ``table`` first."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw))
    value = _CODES[table][raw]
    value *= up[: len(raw)]
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts, ends
    last = edges[-1] == len(raw)
    sums = np.add.reduceat(value, edges[:-1] if last else edges)[0::2]
    return mix(sums * down[starts])


def words(raw: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and for each text where its words begin (one longer than the texts)."""
    starts, ends = spans(raw, off, separators)
    return hash_spans(raw, starts, ends), np.searchsorted(starts, off)


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and where each text's begin.

    A text of fewer than k words, but at least one, has one: its whole sequence.
    """
    count = np.diff(at)
    many = np.maximum(count - k + 1, 0)
    short = (count > 0) & (count < k)
    out_at = np.concatenate([[0], np.cumsum(np.where(short, 1, many))])
    out = np.empty(out_at[-1], np.uint64)
    if len(h) >= k:
        rolled = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            rolled += h[i : i + len(rolled)] * _ROLL[i]
        owner = np.repeat(np.arange(len(count)), many)
        src = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + at[:-1][owner]
        dst = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + out_at[:-1][owner]
        out[dst] = mix(rolled[src])
    for i in np.flatnonzero(short):
        part = h[at[i] : at[i + 1]]
        out[out_at[i]] = mix(np.array([(part * _ROLL[10 : 10 + len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))], np.uint64))[0]
    return out, out_at


def pieces(column, limit: int = 4 << 20):
    """Slices (first row, raw, offsets) of a string column, of about ``limit`` bytes; a longer text stands alone."""
    raw, off = text_bytes(column)
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, raw[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last
