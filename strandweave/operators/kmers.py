"""Windows of reads as numbers: two bits a base, so that a K-mer is a long and its order that of its letters.

Each task turns its reads into arrays of codes; what is shuffled is one long a window, and
letters are written out only for what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import ship

#: The longest window that fits a long.
WIDEST = 31
#: Bases that are worked on at once; a longer read is taken alone.
HELD = 500_000
#: Codes of four bases on the other strand.
TURNED = [sum((3 - (i >> s & 3)) << 6 - s for s in (6, 4, 2, 0)) for i in range(256)]
#: Letters of four bases, by their code.
FOURS = ["".join("ACGT"[i >> s & 3] for s in (6, 4, 2, 0)) for i in range(256)]
_BASE = np.zeros(256, np.int64)
_BASE[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def fits(k: int) -> bool:
    """Whether a K-mer with the base after it is a long."""
    return k + 1 <= WIDEST


def _both(base: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of w bases, and of their reverse complements; from those of half the width."""
    if w == 1:
        return base, 3 - base
    h = w // 2
    f, r = _both(base, h)
    f, r = f[:-h] << 2 * h | f[h:], r[:-h] | r[h:] << 2 * h
    if w % 2:
        f, r = f[:-1] << 2 | base[w - 1 :], r[:-1] | (3 - base[w - 1 :]) << 2 * (w - 1)
    return f, r


class Part:
    """Some reads of at least w bases, one after another, and their windows of w bases."""

    def __init__(self, lens: np.ndarray, text: bytes, w: int):
        self.base = _BASE[np.frombuffer(text, np.uint8)]
        n = lens - (w - 1)
        self.first = np.cumsum(n) - n
        self.of = np.repeat(np.arange(len(lens)), n)
        self.pos = np.arange(len(self.of)) - self.first[self.of]
        self.at = (np.cumsum(lens) - lens)[self.of] + self.pos
        f, r = _both(self.base, w)
        self.f, self.r = f[self.at], r[self.at]


def parts(batches: Iterator[pa.RecordBatch], w: int) -> Iterator[tuple[pa.Array, Part]]:
    """The names of so many reads as are worked on at once, and their windows."""
    for batch in batches:
        seq = [s.encode() for s in batch["seq"].to_pylist()]
        lens, i = np.array([len(s) for s in seq], np.int64), 0
        ends = np.cumsum(lens)
        while i < len(seq):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HELD, "right")))
            ok = np.flatnonzero(lens[i:j] >= w) + i
            if len(ok):
                yield batch["read"].take(pa.array(ok)), Part(lens[ok], b"".join(seq[x] for x in ok), w)
            i = j


def canonical_codes(reads: DataFrame, w: int) -> DataFrame:
    """(code) of every window of w bases, the smaller of the two strands' ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, p in parts(batches, w):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p.f, p.r))], ["code"])

    ship(reads.sparkSession)
    return reads.select("read", "seq").mapInArrow(run, "code long")


def _repeats(p: Part, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of k + 1 bases, whether a K-mer in it occurred in its read before, and how many such there are up to it."""
    kmer = np.insert(p.f >> 2, p.first[1:], p.f[p.first[1:] - 1] & 4**k - 1) if len(p.first) > 1 else p.f >> 2
    kmer = np.append(kmer, p.f[-1] & 4**k - 1)
    n = np.diff(np.append(p.first, len(p.f))) + 1
    of = np.repeat(np.arange(len(n)), n)
    key = of << 2 * k | kmer if 2 * k + int(len(n)).bit_length() < 63 else np.unique(np.stack([of, kmer]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    some = order[np.union1d(same, same + 1)]  # K-mers that are there twice
    some = some[np.lexsort((some, key[some]))]
    seen = np.zeros(len(kmer), bool)
    seen[some[1:][key[some[1:]] == key[some[:-1]]]] = True
    here = np.arange(len(p.f)) + p.of  # a read has one K-mer more than steps
    repeat = (seen[here] | seen[here + 1]).astype(np.int64)
    total = np.cumsum(repeat)
    return repeat, total - (total - repeat)[p.first][p.of]


def _surplus(read: list[str], code: np.ndarray, turned: np.ndarray, u: np.ndarray, v: np.ndarray, of: np.ndarray, cap: int) -> np.ndarray | None:
    """Rows of edges that come so often here that neither end can need them: at each the first ``cap`` names stay."""
    ordered = np.sort(code)
    if len(code) <= 2 * cap or not (often := ordered[2 * cap :] == ordered[: -2 * cap]).any():
        return None
    drop = np.zeros(len(code), bool)
    rows = np.flatnonzero(np.isin(code, np.unique(ordered[2 * cap :][often])))
    rows = rows[np.argsort(code[rows], kind="stable")]
    for group in np.split(rows, np.flatnonzero(code[rows[1:]] != code[rows[:-1]]) + 1):
        drop[group] = True
        for end in (False, True):
            number = np.where(turned[group] == end, u[group], v[group])
            names = [f"{read[o]}c{c}" if c else read[o] for o, c in zip(of[group], number, strict=True)]
            last = sorted(set(names))[:cap][-1]
            drop[group[[x <= last for x in names]]] = False
    return drop


def _ported(p: Part, k: int, of_read: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct canonical K-mers of windows of k bases, how often each is there, its ports (see ``ported``), and the smallest of its reads' numbers."""
    ahead, behind = np.zeros(len(p.f), np.int64), np.zeros(len(p.f), np.int64)
    more, some = np.ones(len(p.f), bool), np.ones(len(p.f), bool)
    more[np.append(p.first[1:], len(p.f)) - 1] = False
    some[p.first] = False
    ahead[more] = 1 << p.base[p.at[more] + k]
    behind[some] = 1 << 3 - p.base[p.at[some] - 1]
    ports = np.where(p.f > p.r, behind | ahead << 4, ahead | behind << 4)
    code = np.minimum(p.f, p.r)
    order = np.argsort(code)
    code = code[order]
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[at], np.diff(np.append(at, len(code))), np.bitwise_or.reduceat(ports[order], at), np.minimum.reduceat(of_read[p.of][order], at)


PORTED = "code long, cov long, ports int"


def _number(read: str | None) -> int:
    """A number for a read, the same for both its mates."""
    name = read or ""
    return crc32((name[:-2] if name.endswith(("_1", "_2")) else name).encode()) & 0x7FFFFFFF


def ported(reads: DataFrame, k: int, origins: bool = False) -> DataFrame:
    """(code, cov, ports, turned) of each canonical K-mer: its occurrences, its edges as eight bits, and the code of its other strand, by one shuffle.

    Bit b says that base b follows the K-mer, bit 4 + b that it follows its reverse
    complement.  ``origins`` adds the smallest number of a read that has it, which
    neighbours in a chain mostly share, for ``runs.merge``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, p in parts(batches, k):
            of_read = np.array([_number(x) for x in names.to_pylist()] if origins else [0] * len(names), np.int32)
            code, cov, ports, origin = _ported(p, k, of_read)
            cells = {"code": code, "cov": cov, "ports": ports.astype(np.int32)} | ({"origin": origin} if origins else {})
            yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in cells.items()})

    ship(reads.sparkSession)
    each = reads.select("read", "seq").mapInArrow(run, PORTED + (", origin int" if origins else ""))
    found = [F.sum("cov").alias("cov"), F.bit_or("ports").alias("ports")] + ([F.min("origin").alias("origin")] if origins else [])
    return each.groupBy("code").agg(*found).withColumn("turned", turned_code(F.col("code"), k))


STEPS = "read string, pos int, code long, u int, v int, near int, far int"


def tagged_steps(reads: DataFrame, k: int, cap: int = 0) -> DataFrame:
    """(read, pos, code, u, v, near, far): each step between neighbouring windows, and the chunk numbers of its ends.

    ``code`` is that of the step's k + 1 bases on the strand where it is smaller.  The ends
    of an edge are 1, where that strand begins, and 2, where the other does; a step goes
    from ``near`` to ``far``.  An edge that is its own mirror has one end.  With a cap,
    steps that can't be among the first ``cap`` names of either end may be left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, p in parts(batches, k + 1):
            repeat, upto = _repeats(p, k)
            u, v, code, turned = 2 * upto - repeat, 2 * upto, np.minimum(p.f, p.r), p.f > p.r
            near = 1 + turned
            far = np.where(p.f == p.r, near, 3 - near)
            numbers = [pa.array(x.astype(np.int32)) for x in (u, v, near, far)]
            cells = [names.take(pa.array(p.of)), pa.array(p.pos.astype(np.int32)), pa.array(code), *numbers]
            out = pa.RecordBatch.from_arrays(cells, [f.split(" ")[0] for f in STEPS.split(", ")])
            if cap > 0 and names.null_count == 0 and (drop := _surplus(names.to_pylist(), code, turned, u, v, p.of, cap)) is not None:
                out = out.filter(pa.array(~drop))
            yield out

    ship(reads.sparkSession)
    return reads.select("read", "seq").mapInArrow(run, STEPS)


def _listed(values: list, kind: str) -> Column:
    """A table as a constant of few expressions, however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _quad(code: Column, i: int) -> Column:
    """Where a table of four bases has those before the last 4i ones."""
    return (F.shiftright(code, 8 * i).bitwiseAND(F.lit(255)) + 1).cast("int")


def letters(code: Column, w: int) -> Column:
    """The w bases of a code; few expressions, as a method of many is never compiled."""
    return F.lpad(F.translate(F.conv(code.cast("string"), 10, 4), "0123", "ACGT"), w, "A")


def spelled(code: Column, w: int) -> Column:
    """The same letters, joined from those of four bases: in a fourth of the time, by more expressions; for rows with which little else is done."""
    table = _listed(FOURS, "string")
    return F.right(F.concat(*[F.element_at(table, _quad(code, i)) for i in reversed(range(-(-w // 4)))]), F.lit(w))


def turned_letters(code: Column, w: int) -> Column:
    """The w bases on the other strand."""
    return F.rpad(F.reverse(F.translate(F.conv(code.cast("string"), 10, 4), "0123", "TGCA")), w, "T")


#: Letters of two bases, by their code, and of a last odd one, as ``pack`` writes them.
PAIRS, ODD = "BCDEGHIJLMNOQRST", "AFKP"


def packed(code: Column, w: int) -> Column:
    """The w bases of a code, packed two a letter."""
    pairs = F.translate(F.lpad(F.hex(F.shiftright(code, 2 * (w % 2))), w // 2, "0"), "0123456789ABCDEF", PAIRS)
    return F.concat(pairs, F.translate(code.bitwiseAND(F.lit(3)).cast("string"), "0123", ODD)) if w % 2 else pairs


def packed_code(name: Column, w: int) -> Column:
    """The code of w packed bases; any other text is an error."""
    pairs = F.conv(F.translate(F.left(name, F.lit(w // 2)), PAIRS, "0123456789ABCDEF"), 16, 10).cast("long")
    code = F.shiftleft(pairs, 2).bitwiseOR(F.translate(F.right(name, F.lit(1)), ODD, "0123").cast("long")) if w % 2 else pairs
    fits = name.rlike(f"^[{PAIRS}]{{{w // 2}}}" + (f"[{ODD}]$" if w % 2 else "$"))
    return F.when(fits, code).otherwise(F.raise_error(F.concat(F.lit(f"not {w} packed bases: "), name)).cast("long"))


def turned_code(code: Column, w: int) -> Column:
    """The code of the other strand."""
    table, (whole, rest) = _listed(TURNED, "long"), divmod(w, 4)
    out = F.shiftright(F.element_at(table, _quad(code, whole)), 8 - 2 * rest) if rest else F.lit(0).cast("long")
    for i in range(whole):
        out = out.bitwiseOR(F.shiftleft(F.element_at(table, _quad(code, i)), 2 * w - 8 * (i + 1)))
    return out


def code_of(seq: Column) -> Column:
    """The code of at most 31 bases; null for other letters."""
    return F.when(seq.rlike("^[ACGT]+$"), F.conv(F.translate(seq, "ACGT", "0123"), 4, 10).cast("long"))
