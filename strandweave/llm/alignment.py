"""Alignment of two tokenizers over a corpus: which tokens of one cover which of the other, and how often.

Both tokenizers cut the same bytes, so a document's links, its pairs of tokens whose byte
ranges overlap, are the stretches between neighbouring ends of either side.  A chunk of
text keeps its documents' links as numbers of its distinct id pairs, and deals these, with
their counts, by the stripe of their B id.  A stripe's task adds all parcels into one dense
block of counts (``np.add.at``); a row's maximum is its B id's best link.  The number of
stripes and the size of a block come from the vocabularies, never from the corpus.  Many
partitions of text are first summed in slots.  Each chunk's pairs then meet their stripe's
counts once more, and the answers go where the chunk's links are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, slices
from .bytewords import text_bytes
from .cluster import Workspace, shuffle_partitions, trimmed

#: B ids of a stripe, as bits; a block has so many rows, and a column for each A id.
STRIPE_BITS = 8
ROW_BITS = 32 - STRIPE_BITS
#: Text of a chunk; a longer document is a chunk of its own.
CHUNK = 4 << 20
#: Partitions of text, or slots before them, that one slot sums.
FAN = 256

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
CHUNKS = "part int, chunk long, stripe int, pairs binary, doc_id array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in _COUNTS) + ", groups_sha256 array<string>, entries array<bigint>, links binary"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass
class Aligned:
    """``documents``: a row per document.  ``pairs``: (a_id, b_id, n, best) for every linked pair of ids."""

    documents: DataFrame
    pairs: DataFrame


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: the high bytes, mostly zero, lie together and compress away."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _pack(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending codes as differences, and their counts."""
    return len(codes).to_bytes(8, "little") + _planes(np.diff(codes, prepend=np.uint32(0))) + _planes(counts)


def _unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(b[:8], "little")
    return np.cumsum(_numbers(b[8 : 8 + 4 * n], np.uint32), dtype=np.uint32), _numbers(b[8 + 4 * n :], np.uint64)


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all ids, and how many each has; one place is left for a separator."""
    width = len(str(max(size - 1, 0)))
    text = np.char.ljust(np.arange(size).astype(f"S{width + 1}"), width + 1, b" ")
    table = np.ascontiguousarray(text).view(np.uint8).reshape(size, width + 1)
    return table, (table != 32).sum(axis=1)


class _Linker:
    """Tokens, groups and links of slices of text."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = encoder(a_path), encoder(b_path)
        width = max(self.a.vocab_size, self.b.vocab_size)
        self.digits, self.width = _digits(width)

    def _written(self, a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as ``a1,a2|b1;``, one after another, and where each ends."""
        n_groups = int(a_group[-1]) + 1
        a_to, b_to = np.searchsorted(a_group, np.arange(1, n_groups + 1)), np.searchsorted(b_group, np.arange(1, n_groups + 1))
        at_a = np.arange(len(a_ids)) + np.concatenate([[0], b_to[:-1]])[a_group]
        at_b = np.arange(len(b_ids)) + a_to[b_group]
        ids, mark = np.empty(len(a_ids) + len(b_ids), np.int64), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a_ids, b_ids
        mark[at_a[a_to - 1]], mark[at_b[b_to - 1]] = ord("|"), ord(";")
        size = self.width[ids]
        cells = self.digits[ids]
        cells[np.arange(len(ids)), size] = mark
        text = cells[np.arange(cells.shape[1]) <= size[:, None]].tobytes()
        return text, np.cumsum(size + 1)[at_b[b_to - 1]]

    def chunk(self, raw: np.ndarray, off: np.ndarray) -> dict:
        """Columns by document, (codes, counts) of the distinct pairs in order of (b, a), and their numbers by document."""
        n = len(off) - 1
        out = {c: np.zeros(n, np.int64) for c in (*_COUNTS, "entries")} | {"groups_sha256": [""] * n, "codes": np.zeros(0, np.uint64), "counts": np.zeros(0, np.uint64), "links": b""}
        filled = np.flatnonzero(np.diff(off) > 0)
        spaced = np.insert(raw, off[filled], 0x20)
        at = np.concatenate([[0], np.cumsum(np.diff(off)[filled] + 1)])
        tokens, good = [], np.ones(len(filled), bool)
        for side in (self.a, self.b):
            ids, begin = side.encode(spaced, at)
            good &= side.spells(ids, begin, spaced, at)
            tokens.append((ids, begin))
        if not good.any():
            return out
        doc = filled[good]
        (a_ids, a_at), (b_ids, b_at) = ((ids[np.repeat(good, np.diff(begin))], np.concatenate([[0], np.cumsum(np.diff(begin)[good])])) for ids, begin in tokens)
        ends = np.cumsum(np.diff(at)[good])
        kind = np.zeros(int(ends[-1]) + 1, np.uint8)
        kind[np.cumsum(self.a.n_bytes[a_ids])] |= 1
        kind[np.cumsum(self.b.n_bytes[b_ids])] |= 2
        kind[0] = 0
        place = np.flatnonzero(kind)
        kind = kind[place]
        both = np.cumsum(kind == 3)
        in_a, in_b, group = (np.cumsum(flag) - flag for flag in ((kind & 1).astype(np.int64), (kind >> 1).astype(np.int64), (kind == 3).astype(np.int64)))
        link_to = np.searchsorted(place, ends) + 1
        group_to = both[link_to - 1]
        for name, to in (("n_a", a_at[1:]), ("n_b", b_at[1:]), ("n_groups", group_to), ("n_links", link_to)):
            out[name][doc] = np.diff(to, prepend=0)
        text, group_ends = self._written(a_ids, b_ids, group[(kind & 1) > 0], group[kind > 1])
        text_to = group_ends[group_to - 1].tolist()
        for i, first, last in zip(doc.tolist(), [0, *text_to[:-1]], text_to, strict=True):
            out["groups_sha256"][i] = hashlib.sha256(text[first : last - 1]).hexdigest()
        code = b_ids[in_b].astype(np.uint64) << np.uint64(ROW_BITS) | a_ids[in_a].astype(np.uint64)
        codes, number = np.unique(code, return_inverse=True)
        out["codes"], out["counts"] = codes, np.bincount(number).astype(np.uint64)
        owner = np.repeat(np.arange(len(doc)), np.diff(link_to, prepend=0))
        own, times = np.unique(owner * len(codes) + number, return_counts=True)
        owner, number = own // len(codes), own % len(codes)
        out["entries"][doc] = np.bincount(owner, minlength=len(doc))
        step = np.diff(number, prepend=0)
        step[np.flatnonzero(np.diff(owner, prepend=-1))] = number[np.flatnonzero(np.diff(owner, prepend=-1))]
        out["links"] = _planes(step.astype(np.uint32)) + _planes(times.astype(np.uint32))
        return out


def _links(a_path: str, b_path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        linker = _Linker(a_path, b_path)
        stripes = -(-linker.b.vocab_size >> STRIPE_BITS) + 1
        for batch in batches:
            keys = batch.column("doc_id")
            raw, off = text_bytes(batch.column("text"))
            for first, last in slices(raw, off, CHUNK):
                got = linker.chunk(raw[off[first] : off[last]], off[first : last + 1] - off[first])
                chunk = part << 32 | made
                made += 1
                stripe = (got["codes"] >> np.uint64(32)).astype(np.int64)
                here = np.unique(stripe)
                lo, hi = np.searchsorted(stripe, here), np.searchsorted(stripe, here, "right")
                code = got["codes"].astype(np.uint32)  # the row within the stripe, and the A id
                parcels = [_pack(code[x:y], got["counts"][x:y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                n = len(parcels)
                by_doc = [pa.array([None] * n + [got[c].tolist()], pa.list_(pa.int64())) for c in _COUNTS]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * (n + 1), pa.int32()),
                        pa.array([chunk] * (n + 1), pa.int64()),
                        pa.array([*here.tolist(), stripes], pa.int32()),
                        pa.array([*parcels, None], pa.binary()),
                        pa.array([None] * n + [keys[first:last].to_pylist()], pa.list_(pa.int64())),
                        *by_doc,
                        pa.array([None] * n + [got["groups_sha256"]], pa.list_(pa.string())),
                        pa.array([None] * n + [got["entries"].tolist()], pa.list_(pa.int64())),
                        pa.array([None] * n + [got["links"]], pa.binary()),
                    ],
                    names=[c.split(" ")[0] for c in CHUNKS.split(", ")],
                )

    return run


def _sums(a_size: int) -> Callable:
    """Adds the parcels of one stripe and slot after another into a dense block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros((1 << STRIPE_BITS, a_size), np.int64)
        now = None

        def done() -> pa.RecordBatch:
            row, column = np.nonzero(block)
            packed = _pack((row << ROW_BITS | column).astype(np.uint32), block[row, column].astype(np.uint64))
            top = block.max(axis=1).tobytes()
            block[row, column] = 0
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([packed], pa.binary()), pa.array([top], pa.binary())], names=["stripe", "slot", "pairs", "top"])

        for batch in batches:
            for key, parcel in zip(zip(batch.column("stripe").to_pylist(), batch.column("slot").to_pylist(), strict=True), batch.column("pairs"), strict=True):
                if now is not None and key != now:
                    yield done()
                now = key
                codes, counts = _unpack(parcel.as_buffer().to_pybytes())
                np.add.at(block, (codes >> ROW_BITS, codes & ((1 << ROW_BITS) - 1)), counts.astype(np.int64))
        if now is not None:
            yield done()

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each parcel of pairs, after its stripe's block: twice each pair's count, plus one for the best of its B id."""
    codes = value = None
    for batch in batches:
        chunks, stripes, out = [], [], []
        for chunk, stripe, pairs, top in zip(batch.column("chunk").to_pylist(), batch.column("stripe").to_pylist(), batch.column("pairs"), batch.column("top"), strict=True):
            own, counts = _unpack(pairs.as_buffer().to_pybytes())
            if chunk is None:
                codes, value = own, 2 * counts + (counts == np.frombuffer(top.as_py(), np.uint64)[own >> ROW_BITS])
            else:
                chunks.append(chunk)
                stripes.append(stripe)
                out.append(_planes(value[np.searchsorted(codes, own)]))
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(stripes, pa.int32()), pa.array(out, pa.binary())], names=["chunk", "stripe", "answer"])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's answers come by stripe, its links last."""
    held: list[np.ndarray] = []
    for batch in batches:
        for i in range(batch.num_rows):
            answer = batch.column("answer")[i]
            if answer.is_valid:
                held.append(_numbers(answer.as_buffer().to_pybytes(), np.uint64).astype(np.int64))
                continue
            value = np.concatenate(held) if held else np.zeros(0, np.int64)
            held = []
            entries = batch.column("entries")[i].values.to_numpy()
            packed = batch.column("links")[i].as_buffer().to_pybytes()
            half = len(packed) // 2
            step, times = _numbers(packed[:half], np.uint32).astype(np.int64), _numbers(packed[half:], np.uint32).astype(np.int64)
            to = np.cumsum(entries)
            # steps begin anew in each document
            run = np.concatenate([[0], np.cumsum(step)])
            value = value[run[1:] - np.repeat(run[to - entries], entries)]
            sums = [np.diff(np.concatenate([[0], np.cumsum(x * times)])[to], prepend=0) for x in (value & 1, value >> 1)]
            plain = [batch.column(c)[i].values for c in ("doc_id", *_COUNTS)]
            yield pa.RecordBatch.from_arrays([*plain, *map(pa.array, sums), batch.column("groups_sha256")[i].values], names=[c.split(" ")[0] for c in DIGEST.split(", ")])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for stripe, pairs, top in zip(batch.column("stripe").to_pylist(), batch.column("pairs"), batch.column("top"), strict=True):
            codes, counts = _unpack(pairs.as_buffer().to_pybytes())
            row = codes >> ROW_BITS
            best = counts == np.frombuffer(top.as_py(), np.uint64)[row]
            columns = [pa.array((codes & ((1 << ROW_BITS) - 1)).astype(np.int64)), pa.array(row.astype(np.int64) + (stripe << STRIPE_BITS)), pa.array(counts.astype(np.int64)), pa.array(best)]
            yield pa.RecordBatch.from_arrays(columns, names=["a_id", "b_id", "n", "best"])


def align(docs: DataFrame, a_tokenizer: str, b_tokenizer: str) -> Aligned:
    """Aligns byte-level tokenizer A with piece tokenizer B over every whole text of docs(doc_id, text).

    A reads a space and the text, B the text, to which it adds the space itself; control
    strings in texts are plain text.  ``documents`` has (doc_id, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256): groups lie between byte offsets where tokens
    of both sides end; a link is a pair of tokens whose bytes overlap; a link counts as best
    if no A id is linked with its B id more often, ties included; count_sum adds up how
    often each link's ids are linked in all texts.  Texts null or empty, and texts that the
    ids of one side don't spell byte by byte, have zeros and an empty string, and no links.
    Rows with equal or null ids count each on its own; other columns are ignored; a long
    text is a chunk of its own, in memory as a whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "alignment")
    a_size = encoder(a_tokenizer).vocab_size
    if a_size > 1 << ROW_BITS:
        raise ValueError(f"at most {1 << ROW_BITS} A ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    chunks = work.put(texts.mapInArrow(trimmed(_links(a_tokenizer, b_tokenizer)), CHUNKS), "chunks")
    width = shuffle_partitions(spark)
    slot = F.floor(F.col("part") / FAN).cast("long").alias("slot")
    parcels = chunks.where("pairs is not null").select("chunk", "stripe", slot, "pairs")
    level, slots = parcels.select("stripe", "slot", "pairs"), (chunks.agg(F.max("part")).first()[0] or 0) // FAN + 1
    last = slots
    for k in range(64):
        dealt = level.repartition(width, "stripe", "slot").sortWithinPartitions("stripe", "slot")
        blocks = work.put(dealt.mapInArrow(trimmed(_sums(a_size)), "stripe int, slot long, pairs binary, top binary"), f"blocks{k}")
        if last == 1:
            break
        last = -(-last // FAN)
        level = blocks.select("stripe", F.floor(F.col("slot") / FAN).cast("long").alias("slot"), "pairs")
    # a stripe's block before its parcels, once a slot
    none = F.lit(None).cast("long").alias("chunk")
    asked = blocks.select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"), none, "pairs", "top")
    asked = asked.union(parcels.select("stripe", "slot", "chunk", "pairs", F.lit(None).cast("binary").alias("top")))
    asked = asked.repartition(width, "stripe", "slot").sortWithinPartitions("stripe", "slot", F.asc_nulls_first("chunk"))
    answers = asked.mapInArrow(trimmed(_answers), "chunk long, stripe int, answer binary")
    own = chunks.where("pairs is null").drop("part", "pairs").withColumn("answer", F.lit(None).cast("binary"))
    met = answers.unionByName(own, allowMissingColumns=True).repartition(width, "chunk").sortWithinPartitions("chunk", "stripe")
    return Aligned(met.mapInArrow(trimmed(_scores), DIGEST), blocks.select("stripe", "pairs", "top").mapInArrow(trimmed(_listed), "a_id long, b_id long, n long, best boolean"))
