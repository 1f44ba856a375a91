"""Best-two-fit packing of documents' token ids into sequences of fixed capacity.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so the
plan is made from the histogram of lengths: a bin is filled greedily with the largest
length that fits and is left; then its smallest piece is taken out if two unpacked ones
together fill the widened gap more tightly.  A bin's pattern is repeated as often as the
counts of its lengths allow, which is just what filling such bins one by one would do.
The plan's size depends on the capacity, not on the corpus.  Pieces find their bins by
their number among the pieces of equal length, counted by task and summed over tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encode_column
from .cluster import Workspace, trimmed

PIECES = "part int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def best_two_fit(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Bins as (lengths in their order, how many such bins), for counts[length]; the capacity is the largest length."""
    left = np.array(counts, np.int64)
    capacity = len(left) - 1
    plan: list[tuple[list[int], int]] = []
    while True:
        open_ = left.copy()
        lengths = np.flatnonzero(open_[1:]) + 1
        if len(lengths) == 0:
            return plan
        pattern, gap = [], capacity
        while gap:
            lengths = lengths[(lengths <= gap) & (open_[lengths] > 0)]
            if len(lengths) == 0:
                break
            take = int(lengths[-1])
            pattern.append(take)
            open_[take] -= 1
            gap -= take
        if gap and len(pattern) > 1:
            smallest = pattern[-1]
            wide = gap + smallest
            some = np.flatnonzero(open_[1:wide]) + 1
            if len(some):
                # for each first length, the largest other one that still fits
                at = np.searchsorted(some, wide - some, "right") - 1
                ok = (at >= 0) & ((some[at] != some) | (open_[some] > 1))
                same = (at > 0) & ~ok
                at = np.where(same, at - 1, at)
                ok |= same
                total = np.where(ok, some + some[at], 0)
                best = int(total.argmax())
                if total[best] > smallest:
                    pattern[-1:] = sorted((int(some[best]), int(some[at[best]])), reverse=True)
        used, uses = np.unique(pattern, return_counts=True)
        times = int((left[used] // uses).min())
        left[used] -= uses * times
        plan.append((pattern, times))


def _cut(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for first, ids, at in encode_column(batch.column("text"), path):
                ids = np.insert(ids.astype("<u4"), at[1:], end_id)
                at = at + np.arange(len(at))
                size = np.diff(at)
                n_pieces = -(-size // capacity)
                head = size - (n_pieces - 1) * capacity  # the first piece takes what the full ones leave
                doc = np.repeat(np.arange(len(size)), n_pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                run_start = np.searchsorted(ranked, ranked)
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - run_start
                nth += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                a, b = (at[:-1][doc] + start).tolist(), (at[:-1][doc] + start + length).tolist()
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(a, b, strict=True)]
                body = [bytes(data[4 * x : 4 * y]) for x, y in zip(a, b, strict=True)] if with_ids else [None] * len(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(doc), part, np.int32)),
                        pa.array(nth),
                        pa.array([keys[first + d] for d in doc.tolist()], pa.int64()),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start.astype(np.int64)),
                        pa.array(length.astype(np.int64)),
                        pa.array(crc, pa.int64()),
                        pa.array(body, pa.binary()),
                    ],
                    names=["part", "nth", "doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return run


def _tables(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: where its runs begin among the pieces of that length, and each run's first bin, uses a bin and offsets."""
    by: dict[int, list[tuple[int, int, list[int]]]] = {}
    first_bin = 0
    for pattern, times in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for length in pattern:
            offsets.setdefault(length, []).append(at)
            at += length
        for length, places in offsets.items():
            by.setdefault(length, []).append((first_bin, times, places))
        first_bin += times
    out = {}
    for length, runs in by.items():
        uses = np.array([len(p) for _, _, p in runs])
        begin = np.concatenate([[0], np.cumsum(uses * np.array([t for _, t, _ in runs]))])
        offset = np.concatenate([np.array(p) for _, _, p in runs])
        out[length] = (begin, np.array([b for b, _, _ in runs]), uses, np.cumsum(uses) - uses, offset)
    return out


def _place(plan: list[tuple[list[int], int]]):
    tables = _tables(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            sequence, offset = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
            for x in np.unique(length).tolist():
                begin, bins, uses, at, places = tables[x]
                here = np.flatnonzero(length == x)
                run_ = np.searchsorted(begin, nth[here], "right") - 1
                inside = nth[here] - begin[run_]
                sequence[here] = bins[run_] + inside // uses[run_]
                offset[here] = places[at[run_] + inside % uses[run_]]
            keep = [c for c in batch.schema.names if c not in ("part", "nth")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Packs every whole text; one row per piece.

    Columns: doc_id, piece, start (the document's ids before it), length, ids_crc32, ids
    (little-endian unsigned 32-bit, if ``with_ids``), sequence_id, offset.  The end id
    follows each document, so a null or empty text is one piece of it.  Only documents
    above the capacity are cut; their first piece takes the remainder.  Rows with equal
    or null ids are packed each on its own.  Other columns are ignored; an empty table
    gives no rows.
    """
    work = Workspace(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = PIECES if with_ids else PIECES.removesuffix(", ids binary")
    cut = rows.mapInArrow(trimmed(_cut(tokenizer, end_id, capacity, with_ids)), PIECES)
    cut = work.put(cut if with_ids else cut.drop("ids"), "pieces")
    by_task = work.put(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    plan = best_two_fit(counts)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut.join(base, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("base")).drop("base")
    out = schema.removeprefix("part int, nth long, ") + ", sequence_id long, offset long"
    order = [c.split(" ")[0] for c in schema.split(", ")]
    return numbered.select(*order).mapInArrow(trimmed(_place(plan)), out)
