"""Chat formatting by columnar byte assembly.

Each turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts every
``<``, backslashes, ``|`` gets one more backslash, so no control string of the template can
occur there, and removing one backslash gives the original back; a role's own line feeds
are written ``\\n`` after its backslashes are doubled.  The loss mask covers the escaped
text of the learning role's turns, as spans of code points of the formatted text.

Turns are dealt out by (conversation, turn) ranges, so one huge conversation spreads over
tasks; a batch's turns are assembled into one preallocated buffer with numpy: lengths of
all segments, cumulative offsets, one scatter per segment kind.  A conversation that lies
in several batches comes as several fragments, in the order of ``fragment``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import text_bytes
from .cluster import Workspace, shuffle_partitions, trimmed

OPEN, FEED, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
FORMATTED = "conv_id long, fragment long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"
#: Bytes of text assembled at once, about; a longer turn stands alone.
SLICE = 4 << 20


def escape_text(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\1\\|")


def escape_role(column: pa.Array) -> pa.Array:
    doubled = pc.replace_substring(escape_text(column), "\\", "\\\\")
    return pc.replace_substring(doubled, "\n", "\\n")


def unescape_text(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    plain = re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", role)
    return unescape_text(plain)


def _scatter(out: np.ndarray, to: np.ndarray, raw: np.ndarray, off: np.ndarray) -> None:
    """Copies every text's bytes to its place."""
    length = np.diff(off)
    out[np.arange(len(raw)) + np.repeat(to - off[:-1], length)] = raw


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of turns one after another, where each turn begins (one more than turns), and where its text begins and ends."""
    role_raw, role_off = text_bytes(escape_role(roles))
    text_raw, text_off = text_bytes(escape_text(texts))
    n = len(role_off) - 1
    size = np.empty((n, 5), np.int64)
    size[:, 0], size[:, 2], size[:, 4] = len(OPEN), len(FEED), len(CLOSE)
    size[:, 1], size[:, 3] = np.diff(role_off), np.diff(text_off)
    ends = np.cumsum(size.reshape(-1)).reshape(n, 5)
    begins = ends - size
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, fixed in ((0, OPEN), (2, FEED), (4, CLOSE)):
        out[begins[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    _scatter(out, begins[:, 1], role_raw, role_off)
    _scatter(out, begins[:, 3], text_raw, text_off)
    return out, np.append(begins[:, 0], len(out)), begins[:, 3], ends[:, 3]


def _format(learn: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragment = TaskContext.get().partitionId() << 40
        for batch in batches:
            _, off = text_bytes(batch.column("text"))
            first, n = 0, batch.num_rows
            while first < n:
                last = max(first + 1, int(np.searchsorted(off, off[first] + SLICE, "right")) - 1)
                part = batch.slice(first, last - first)
                conv, roles = part.column("conv_id"), part.column("role")
                out, turn_at, text_at, text_to = assemble(roles, part.column("text"))
                keys = conv.fill_null(0).to_numpy(zero_copy_only=False)
                null = conv.is_null().to_numpy(zero_copy_only=False)
                new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])]))
                bounds = np.append(new, len(keys))
                points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
                learned = pc.equal(roles, learn).to_numpy(zero_copy_only=False)
                base = np.repeat(points[turn_at[new]], np.diff(bounds))
                mask_at, mask_to = points[text_at] - base, points[text_to] - base
                ends = np.cumsum(learned)
                spans = np.concatenate([[0], ends[bounds[1:] - 1]])
                body = pa.LargeStringArray.from_buffers(len(new), pa.py_buffer(turn_at[bounds].astype(np.int64).tobytes()), pa.py_buffer(out))
                lists = [pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.array(m[learned], pa.int64())) for m in (mask_at, mask_to)]
                yield pa.RecordBatch.from_arrays(
                    [conv.take(pa.array(new)), pa.array(np.arange(len(new)) + fragment), pa.array(np.diff(bounds)), body.cast(pa.string()), *lists],
                    names=["conv_id", "fragment", "n_turns", "formatted", "loss_starts", "loss_ends"],
                )
                fragment += len(new)
                first = last

    return run


def format_conversations(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """Formatted conversations from rows (conv_id, turn, role, text).

    Turns are ordered by turn, then role, then text; repeated rows stay.  Null roles and
    texts count as empty, a null turn comes first, rows of a null conv_id are one
    conversation.  Other columns are ignored; an empty table gives no rows.
    """
    Workspace(turns.sparkSession, "chat")  # ships the package
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    keys = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(shuffle_partitions(turns.sparkSession), "conv_id", "turn").sortWithinPartitions(*keys)
    return dealt.select("conv_id", "role", "text").mapInArrow(trimmed(_format(learn)), FORMATTED)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from the formatted text alone."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("formatted text does not follow the template")
        out.append((unescape_role(m[1]), unescape_text(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("formatted text does not follow the template")
    return out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: list = []

    def close():
        conv, n, turns, chars, loss, size = state
        cells = [conv, n, turns.hexdigest(), chars, loss.hexdigest(), size]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=[f.split(" ")[0] for f in DIGEST.split(", ")])

    for batch in batches:
        for row in batch.to_pylist():
            if not state or state[0] != row["conv_id"]:
                if state:
                    yield close()
                state[:] = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = row["formatted"]
            for role, said in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True):
                learned = unescape_text(text[a:b])
                state[3] += len(learned)
                state[4].update(learned.encode())
            state[5] += len(text)
    if state:
        yield close()


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from the formatted text and its mask, per conversation.

    A hash over a whole conversation is one sequential pass, so its fragments meet in one
    task; they are streamed, only one is held.
    """
    met = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "fragment")
    return met.mapInArrow(trimmed(_digest), DIGEST)
