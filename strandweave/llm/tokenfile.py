"""Token-id files: frequency-ranked ids, byte-aligned lengths, control bytes apart from data.

Every id is replaced by its rank in the corpus' frequency order (ties to the smaller id),
so common ids take one byte, others two, three or four.  Four lengths share a control
byte (two bits each, first id in the lowest bits); control bytes and data bytes are kept
in two separate streams.  A file set is

* ``ranks``: one row, the ids by rank;
* ``blocks``: rows (part, block, start_in_part, doc_ids, counts, n_ids, control, data), in
  Parquet so that any store Spark reaches can hold them.  ``part`` numbers range
  partitions in ascending document order, ``block`` the blocks inside one.

Decoding looks the control bytes up in a 256 x 4 table of lengths, sums them to byte
places, and gathers the data bytes with numpy; there is no loop over ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_column, encoder
from .cluster import Workspace, shuffle_partitions, trimmed

#: Ids in a block, about; one document is never split.
BLOCK_IDS = 1 << 17
LENGTHS = np.stack([(np.arange(256) >> (2 * k) & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)


def pack_ids(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of a block of ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    padded[: len(ranks)] = length - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    bytes4 = ranks.view(np.uint8).reshape(-1, 4)
    data = bytes4[np.arange(4) < length[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks of a block, by table lookup."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    place = np.cumsum(length, dtype=np.int64) - length
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[place].astype(np.uint32)
    for k in (1, 2, 3):
        long = np.flatnonzero(length > k)
        if len(long) == 0:
            break
        out[long] |= raw[place[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_CODED = "part int, block long, start_in_part long, doc_ids array<long>, counts array<long>, ids binary"


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for first, ids, at in encode_column(batch.column("text"), path):
                width = "<u2" if ids.dtype == np.uint16 and end_id < 65536 else "<u4"
                ids = np.insert(ids.astype(width, copy=False), at[1:], end_id)
                at = at + np.arange(len(at))
                a, n = 0, len(at) - 1
                while a < n:
                    b = max(a + 1, int(np.searchsorted(at, at[a] + BLOCK_IDS, "right")) - 1)
                    body = ids[at[a] : at[b]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part], pa.int32()),
                            pa.array([block], pa.int64()),
                            pa.array([start], pa.int64()),
                            pa.array([keys[first + a : first + b]], pa.list_(pa.int64())),
                            pa.array([np.diff(at[a : b + 1]).tolist()], pa.list_(pa.int64())),
                            pa.array([body.tobytes()], pa.binary()),
                        ],
                        names=["part", "block", "start_in_part", "doc_ids", "counts", "ids"],
                    )
                    start, block, a = start + len(body), block + 1, b

    return run


def _width(body: bytes, counts) -> str:
    return "<u2" if len(body) == 2 * sum(counts) else "<u4"


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for body, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True):
                total += np.bincount(np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return run


def _write_blocks(rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            control, data, n_ids = [], [], []
            for body, counts in zip(batch.column("ids").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                c, d = pack_ids(rank_of[np.frombuffer(body, _width(body, counts))])
                control.append(c)
                data.append(d)
                n_ids.append(sum(counts))
            keep = [batch.column(c) for c in ("part", "block", "start_in_part", "doc_ids", "counts")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(n_ids, pa.int64()), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                names=["part", "block", "start_in_part", "doc_ids", "counts", "n_ids", "control", "data"],
            )

    return run


_BLOCKS = "part int, block long, start_in_part long, doc_ids array<long>, counts array<long>, n_ids long, control binary, data binary"


def write_token_file(docs: DataFrame, tokenizer: str, out: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text and writes the file set under the folder ``out``.

    Rows are ordered by ascending doc_id (nulls first), ties by text; repeated ids keep
    their rows.  A null or empty text gives the end id alone.  Other columns are ignored.
    The end id must be below the vocabulary's size.  An empty table gives no blocks.
    """
    spark = docs.sparkSession
    size = encoder(tokenizer).vocab_size
    work = Workspace(spark, "tokenfile")
    # sorted through a range exchange, whose samples only need the ids; one task codes one range
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text"))
    coded = work.put(ordered.mapInArrow(trimmed(_encode(tokenizer, end_id)), _CODED), "coded")
    counted = coded.select("ids", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # at most one row for each id of the vocabulary
    found = counted.mapInArrow(trimmed(_count(size)), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(size, np.int64)
    for r in found:
        total[r["id"]] = r["n"]
    by_rank = np.lexsort((np.arange(size), -total))
    rank_of = np.empty(size, np.uint32)
    rank_of[by_rank] = np.arange(size, dtype=np.uint32)
    spark.createDataFrame([(by_rank.tolist(),)], "ids array<int>").coalesce(1).write.mode("overwrite").parquet(f"{out}/ranks")
    coded.mapInArrow(trimmed(_write_blocks(rank_of)), _BLOCKS).write.mode("overwrite").parquet(f"{out}/blocks")
    work.drop()


def _decode(id_of: np.ndarray, begin: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of[unpack_ids(row["control"], row["data"], row["n_ids"])]
                yield row, begin[row["part"]] + row["start_in_part"], ids

    return run


def read_token_file(spark: SparkSession, path: str, per_document=None, schema: str = "doc_id long, start long, ids array<int>") -> DataFrame:
    """One row per document: its id, the number of ids before it in the file set, and what ``per_document(ids)`` makes of its ids (by default the ids)."""
    from pyspark.sql.types import _parse_datatype_string

    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    id_of = np.array(spark.read.parquet(f"{path}/ranks").first()[0], "<u4")
    # one row for each range partition
    sizes = dict(blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    begin, at = {}, 0
    for part in sorted(sizes):
        begin[part] = at
        at += sizes[part]
    names = [f.name for f in _parse_datatype_string(schema).fields]
    make = per_document or (lambda ids: (ids.tolist(),))
    blocks_of = _decode(id_of, begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, start, ids in blocks_of(batches):
            counts = np.array(row["counts"], np.int64)
            ends = np.cumsum(counts)
            made = [make(ids[e - c : e]) for e, c in zip(ends.tolist(), row["counts"], strict=True)]
            columns = [row["doc_ids"], (start + ends - counts).tolist(), *zip(*made, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) if k != 0 else pa.array(c, pa.int64()) for k, c in enumerate(columns)], names=names)

    return blocks.mapInArrow(trimmed(run), schema)


def digest(ids: np.ndarray) -> tuple[int, int]:
    """Number of ids, and the crc32 of them as little-endian unsigned 32-bit integers."""
    return len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


DIGEST_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
