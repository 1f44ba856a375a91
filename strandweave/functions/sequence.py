"""Column functions on nucleotide sequences and on the directions of a bidirected graph."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..storage import ship

ALPHABET, COMPLEMENT = "ACGT", "TGCA"


def rc(seq: Column) -> Column:
    """Reverse complement of an A, C, G, T sequence."""
    return F.translate(F.reverse(seq), ALPHABET, COMPLEMENT)


def canonical(seq: Column) -> Column:
    return F.least(seq, rc(seq))


def strand(seq: Column) -> Column:
    """f if the sequence is strictly smaller than its reverse complement, else r."""
    return F.when(seq < rc(seq), F.lit("f")).otherwise(F.lit("r"))


def flip(direction: Column) -> Column:
    return F.translate(direction, "fr", "rf")


def oriented(seq: Column, direction: Column) -> Column:
    return F.when(direction == "f", seq).otherwise(rc(seq))


def overlap_concat(a: Column, b: Column, k: int) -> Column:
    """b appended to a where they overlap by k - 1 bases; an error if they do not."""
    checked = F.when(F.right(a, F.lit(k - 1)) == F.left(b, F.lit(k - 1)), F.lit(True)).otherwise(F.raise_error(F.lit("sequences do not overlap")).cast("boolean"))
    return F.when(checked, F.concat(a, F.substring(b, k, 2**31 - 1)))


#: Of each letter from A to T, its bases, and how many these are.
_FIRST, _SECOND, _WIDTH = np.zeros(256, np.uint8), np.zeros(256, np.uint8), np.ones(256, np.int64)
for _i, _c in enumerate(range(ord("A"), ord("U"))):
    _FIRST[_c] = ord(ALPHABET[_i // 5])
    if _i % 5:
        _SECOND[_c], _WIDTH[_c] = ord(ALPHABET[_i % 5 - 1]), 2
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[np.frombuffer(ALPHABET.encode(), np.uint8)] = range(4)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values one after another, and their lengths; nulls have none."""
    values = [b"" if v is None else v.encode() for v in column.to_pylist()]
    return np.frombuffer(b"".join(values), np.uint8), np.array([len(v) for v in values], np.int64)


def _texts(data: np.ndarray, lens: np.ndarray) -> list[str]:
    text, ends = data.tobytes().decode(), np.cumsum(lens).tolist()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _pack(seq: pa.Array) -> pa.Array:
    data, lens = _bytes(seq)
    half = (lens + 1) // 2
    of = np.repeat(np.arange(len(lens)), half)
    within = 2 * (np.arange(len(of)) - (np.cumsum(half) - half)[of])
    at = (np.cumsum(lens) - lens)[of] + within
    pair = within + 1 < lens[of]
    digit = _DIGIT[data]
    return pa.array(_texts(65 + 5 * digit[at] + np.where(pair, 1 + digit[np.where(pair, at + 1, at)], 0).astype(np.uint8), half), pa.string())


def _unpack(packed: pa.Array) -> pa.Array:
    data, lens = _bytes(packed)
    width = _WIDTH[data]
    end = np.cumsum(width)
    out = np.zeros(end[-1] if len(end) else 0, np.uint8)
    out[end - width] = _FIRST[data]
    two = width == 2
    out[end[two] - 1] = _SECOND[data[two]]
    ends = np.append(0, end)[np.append(0, np.cumsum(lens))]
    return pa.array([t if ok else None for t, ok in zip(_texts(out, np.diff(ends)), packed.is_valid().to_pylist(), strict=True)], pa.string())


def _vectorised(f: Callable[[pa.Array], pa.Array]) -> Callable[[Column], Column]:
    """A column function that works on a batch at once."""

    def run(column: pa.Array) -> pa.Array:
        return f(column)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


def pack(seq: Column) -> Column:
    """Two bases a letter from A to T: a pair xy is letter 5x + 1 + y, a last odd base x is letter 5x; null is as if empty."""
    ship(SparkSession.getActiveSession())
    return _vectorised(_pack)(seq)


def unpack(packed: Column) -> Column:
    ship(SparkSession.getActiveSession())
    return _vectorised(_unpack)(packed)


def mate_basename(read: Column) -> Column:
    """A mate's name without its _1 or _2; empty for other reads."""
    return F.regexp_extract(read, r"^(.*)_[12]$", 1)


def wiggle(insert_len: int, least: int = 30, scaled: bool = False) -> float:
    """Distance tolerance of a bundle: the least, or a tenth of the insert over sqrt(10) if ``scaled``."""
    return max(0.1 * insert_len / 10**0.5, least) if scaled else least


def branch_type(deg_f: Column, deg_r: Column, tandem: Column, seq: Column) -> Column:
    """single, tip, dead, non, half or full, with _tandem and _palindrome appended where they hold."""
    kind = (
        F.when(deg_f + deg_r == 0, "single").when(deg_f + deg_r == 1, "tip").when((deg_f == 0) | (deg_r == 0), "dead")
        .when((deg_f == 1) & (deg_r == 1), "non").when((deg_f == 1) | (deg_r == 1), "half").otherwise("full")
    )
    return F.concat(kind, F.when(tandem, "_tandem").otherwise(""), F.when(seq == rc(seq), "_palindrome").otherwise(""))
