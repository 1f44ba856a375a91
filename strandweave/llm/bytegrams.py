"""Hashed byte trigrams of whole texts: square roots of counts, scaled to length 1."""

from __future__ import annotations

import numpy as np

from .bytewords import LOWER, text_bytes

_SAME = np.arange(256, dtype=np.uint8)
#: Letters as they are; every other ASCII byte a space.
LETTERS = LOWER.copy()
LETTERS[[i for i in range(128) if not chr(i).isalpha()]] = 32


def features(column, bits: int, table: np.ndarray = _SAME, limit: int = 1 << 20, most: int = 256):
    """(first row, float32 matrix) by slices of a string column; a text without trigrams is a row of zeros."""
    raw, off = text_bytes(column)
    width, first, n = 1 << bits, 0, len(off) - 1
    while first < n:
        last = min(first + most, max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1))
        b = table[raw[off[first] : off[last]]].astype(np.uint32)
        at = off[first : last + 1] - off[first]
        rows = last - first
        if len(b) > 2:
            h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - bits)
            owner = np.repeat(np.arange(rows), np.diff(at))
            inside = owner[:-2] == owner[2:]
            x = np.bincount(owner[:-2][inside] * width + h[inside], minlength=rows * width).reshape(rows, width)
        else:
            x = np.zeros((rows, width))
        x = np.sqrt(x, dtype=np.float32)
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
        yield first, x
        first = last
