"""Threads of a graph of coded K-mers as numbers: steps meet by their edge's code, what they say of nodes by the node's.

A step is shuffled as two longs, its edge's code and a tag with its read's number and
chunk; a name that is no number goes along as it is.  Edges' and nodes' own rows are dealt
with the steps, not joined with them.  Tasks sort what they get by code and work on whole
edges or nodes with numpy; letters are written for what is left.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import ship, shuffle_partitions
from . import kmers
from .runs import letters, turned

TAGGED = "code long, tag long, name string"
#: Tags from here down are rows of an edge or a node itself.
OWN = -(1 << 62)
#: Bits of a chunk's number beside that of its read.
CHUNK = 26
#: Rows that are worked on at once.
HELD = 60_000
_NUMBER = re.compile("0|[1-9][0-9]{0,9}")
_WAY = pa.array(["r", "f"])


def _unnamed() -> Column:
    return F.lit(None).cast("string").alias("name")


def _numbers(names: pa.Array) -> np.ndarray:
    """Reads' names as numbers, -1 for those that are none or too large."""
    numbers = [int(x) if x is not None and _NUMBER.fullmatch(x) else -1 for x in names.to_pylist()]
    return np.array([x if x < 1 << 32 else -1 for x in numbers], np.int64)


def _steps(k: int, cap: int) -> Callable:
    """(code, tag, name) of each step between neighbouring windows, see ``kmers.tagged_steps``.

    A tag is the read's number, then 31 bits: its chunk at the far end (CHUNK), whether it
    was one less at the near end, near (2) and far (2).  Where that has no room it is
    -1 - these bits, and the name goes along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, p in kmers.parts(batches, k + 1):
            repeat, upto = kmers._repeats(p, k)
            u, v, code, back = 2 * upto - repeat, 2 * upto, np.minimum(p.f, p.r), p.f > p.r
            near = 1 + back
            far = np.where(p.f == p.r, near, 3 - near)
            held = v << 5 | repeat << 4 | near << 2 | far
            number = _numbers(names)[p.of]
            fits = (number >= 0) & (v < 1 << CHUNK)
            tag = np.where(fits, number << CHUNK + 5 | held, -1 - held)
            name = pa.nulls(len(tag), pa.string()) if fits.all() else names.take(pa.array(p.of, mask=fits))
            out = pa.RecordBatch.from_arrays([pa.array(code), pa.array(tag), name.cast(pa.string())], ["code", "tag", "name"])
            if cap > 0 and names.null_count == 0 and (drop := kmers._surplus(names.to_pylist(), code, back, u, v, p.of, cap)) is not None:
                out = out.filter(pa.array(~drop))
            yield out

    return run


def _own(k: int, every: bool) -> Callable:
    """(code, tag) of the ends of edges of rows(code, ports, turned): OWN, 1 and 2 added for a branching end, and 4 and 8 for one that is there, if ``every`` one is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, ports, back = (batch[c].to_numpy() for c in ("code", "ports", "turned"))
            for start, side in ((code, ports & 15), (back, ports >> 4)):
                forked = side & side - 1 != 0
                for base in range(4):
                    some = (side >> base & 1 == 1) & (forked | every)
                    way = start[some] << 2 | base
                    other = turned(way, k + 1)
                    end = 1 + (way > other)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(way, other)), pa.array(OWN + end * forked[some] + 4 * end * every)], ["code", "tag"])

    return run


def _dealt(df: DataFrame) -> DataFrame:
    """Rows dealt by code and sorted by it in each task; a number of partitions is given, so that no code is parted later."""
    return df.repartition(shuffle_partitions(df.sparkSession), "code").sortWithinPartitions("code")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches that hold all rows of their codes, and about HELD rows or more."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= HELD and held[0]["code"][0] != batch["code"][-1]:
            rows = pa.concat_batches(held)
            code = rows["code"].to_numpy()
            cut = int(np.searchsorted(code, code[-1]))  # where the last code, which may go on, begins
            yield rows.slice(0, cut)
            held, n = [rows.slice(cut)], len(code) - cut
    if n:
        yield pa.concat_batches(held)


def _texts(ids: np.ndarray) -> pa.Array:
    """Names of threads by number."""
    number, chunk = pa.array(ids >> CHUNK).cast(pa.string()), ids & (1 << CHUNK) - 1
    if not chunk.any():
        return number
    more = pc.binary_join_element_wise(number, pa.array(chunk).cast(pa.string()), "c")
    return pc.if_else(pa.array(chunk == 0), number, more)


class _Names:
    """Threads' names as ids: equal ids for equal names, within a batch."""

    def __init__(self, ids: np.ndarray, texts: Callable[[], pa.Array] | None):
        """``texts`` are the names of those that are no numbers, elsewhere null, if there are any."""
        self.ids, self.known = ids, None
        if texts is not None:
            each = pc.if_else(pa.array(ids >= 0), _texts(np.maximum(ids, 0)), texts())
            coded = each.dictionary_encode()
            self.known = coded.dictionary
            self.ids = coded.indices.fill_null(len(self.known)).to_numpy().astype(np.int64)

    def texts(self, ids: np.ndarray) -> pa.Array:
        if self.known is None:
            return _texts(ids)
        return self.known.take(pa.array(ids, mask=ids == len(self.known)))

    def numbers(self, ids: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Ids that hold beyond the batch, and names where they are -1."""
        if self.known is None:
            return ids, pa.nulls(len(ids), pa.string())
        return np.full(len(ids), -1), self.texts(ids)


def _first(names: _Names, ids: np.ndarray, group: np.ndarray, cap: int) -> np.ndarray:
    """Which of the distinct ids, sorted by group, are among the first ``cap`` names of their group."""
    keep = np.ones(len(ids), bool)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(ids) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(ids)))
    for at, n in zip(begin[size > cap], size[size > cap], strict=True):
        text = [b"" if x is None else b"\1" + x.encode() for x in names.texts(ids[at : at + n]).to_pylist()]  # a missing name comes first
        keep[at + np.array(sorted(range(n), key=text.__getitem__)[cap:])] = False
    return keep


def _threads(batch: pa.RecordBatch, cap: int, forked: bool) -> tuple[np.ndarray, np.ndarray, _Names, np.ndarray]:
    """Code, end and name's id of each thread of some whole edges, sorted by code and end."""
    code, tag = batch["code"].to_numpy(), batch["tag"].to_numpy()
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    group = np.cumsum(np.append(False, code[1:] != code[:-1]))
    ends = np.full(len(first), 0 if forked else 3)
    if forked:
        own = np.flatnonzero(tag <= OWN + 15)
        for end in (1, 2):
            ends[group[own[tag[own] - OWN & end > 0]]] |= end
    some = np.flatnonzero((tag > OWN + 15) & (ends[group] > 0))
    tag, group = tag[some], group[some]
    plain = tag >= 0
    held = np.where(plain, tag & (1 << CHUNK + 5) - 1, -1 - tag)
    v, asked = held >> 5, ends[group]
    u, near, far = v - (held >> 4 & 1), held >> 2 & 3, held & 3
    a, b = np.flatnonzero(asked & near), np.flatnonzero(asked & far)
    row, end, chunk = np.append(a, b), np.append(near[a], far[b]), np.append(u[a], v[b])
    ids = np.where(plain[row], tag[row] >> CHUNK + 5 << CHUNK | chunk, -1)

    def texts() -> pa.Array:
        name = batch["name"].take(pa.array(some[row]))
        return pc.if_else(pa.array(chunk == 0), name, pc.binary_join_element_wise(name, pa.array(chunk).cast(pa.string()), "c"))

    names = _Names(ids, None if plain.all() else texts)
    place = group[row] << 1 | end - 1
    order = np.lexsort((names.ids, place))
    place, ids = place[order], names.ids[order]
    new = np.append(True, (place[1:] != place[:-1]) | (ids[1:] != ids[:-1]))[: len(ids)]
    place, ids = place[new], ids[new]
    keep = _first(names, ids, place, cap)
    place, ids = place[keep], ids[keep]
    return code[first][place >> 1], 1 + (place & 1), names, ids


def _known_at_both(code: np.ndarray, end: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Threads known at either end of an edge, at both; an edge that is its own mirror has one."""
    order = np.lexsort((ids, code))
    code, end, ids = code[order], end[order], ids[order]
    new = np.append(True, (code[1:] != code[:-1]) | (ids[1:] != ids[:-1]))[: len(ids)]
    code, end, ids = code[new], end[new], ids[new]
    two = code != turned(code, k + 1)
    return np.append(code, code[two]), np.append(np.where(two, 1, end), np.full(int(two.sum()), 2)), np.append(ids, ids[two])


def _way(code: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """The k + 1 bases of an edge, read from an end."""
    return np.where(end == 1, code, turned(code, k + 1))


def _port(way: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The node where some k + 1 bases begin, and its port there."""
    start = way >> 2
    back = turned(start, k)
    return np.minimum(start, back), (way & 3) + np.where(start <= back, 0, 4)


def _next(start: np.ndarray, base: np.ndarray, k: int) -> tuple[pa.Array, pa.Array]:
    """Direction and letters of the K-mer that follows another."""
    v = (start << 2 | base) & 4**k - 1
    back = turned(v, k)
    return _WAY.take(pa.array((v < back).astype(np.int8))), letters(np.minimum(v, back), k)


def _spelled(way: np.ndarray, k: int) -> list[pa.Array]:
    """Node, direction, the next one's direction and the next node of some k + 1 bases."""
    node, port = _port(way, k)
    return [letters(node, k), _WAY.take(pa.array((port < 4).astype(np.int8))), *_next(way >> 2, way & 3, k)]


class Threads:
    """The threads of reads over the edges of a graph, given as rows(code, cov, ports, turned); ``forked`` are (code, ends) in their place, None for all ends."""

    def __init__(self, good: DataFrame, k: int, cap: int, rows: DataFrame | None = None, forked: DataFrame | None = None):
        ship(good.sparkSession)
        self.k, self.cap, self.rows, self.forked = k, cap, rows, rows is not None or forked is not None
        self.plain = good.select("read", "seq").mapInArrow(_steps(k, cap), TAGGED)
        if rows is not None:
            self.steps = self._beside()
        else:
            self.steps = self.plain if forked is None else self.plain.union(forked.select("code", (F.lit(OWN) + F.col("ends")).alias("tag"), _unnamed()))

    def _beside(self, every: bool = False) -> DataFrame:
        """The steps, and the ends of edges that branch, or every one."""
        own = self.rows.select("code", "ports", "turned").mapInArrow(_own(self.k, every), "code long, tag long")
        return self.plain.union(own.select("code", "tag", _unnamed()))

    def _run(self, make: Callable, schema: str, both: bool = False) -> DataFrame:
        """What is made of (code, end, names, ids) of some whole edges, with threads of ``both`` ends at both."""
        k, cap, forked, columns = self.k, self.cap, self.forked, [f.split(" ")[0] for f in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _whole(batches):
                code, end, names, ids = _threads(batch, cap, forked)
                if both:
                    code, end, ids = _known_at_both(code, end, ids, k)
                yield pa.RecordBatch.from_arrays(make(code, end, names, ids), columns)

        return _dealt(self.steps).mapInArrow(run, schema)

    def spelled(self, both: bool = False) -> DataFrame:
        """(node_id, sdir, ddir, dst, read)"""
        k = self.k
        return self._run(lambda code, end, names, ids: [*_spelled(_way(code, end, k), k), names.texts(ids)], "node_id string, sdir string, ddir string, dst string, read string", both)

    def ports(self) -> DataFrame:
        """(code, port, read) by the code of a thread's node and its port."""
        k = self.k

        def make(code, end, names, ids):
            node, port = _port(_way(code, end, k), k)
            return [pa.array(node), pa.array(port.astype(np.int32)), names.texts(ids)]

        return self._run(make, "code long, port int, read string")

    def counts(self) -> DataFrame:
        """(code, port, reads): how many threads there are at a node's ports."""
        k = self.k

        def make(code, end, names, ids):
            at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (end[1:] != end[:-1]))[: len(code)])
            node, port = _port(_way(code[at], end[at], k), k)
            return [pa.array(node), pa.array(port.astype(np.int32)), pa.array(np.diff(np.append(at, len(code))))]

        return self._run(make, "code long, port int, reads long")

    def checked(self) -> DataFrame:
        """(edges_ok, edges_repeated, threads_ok, threads_bad, lone): counts of some edges, as seen from their ends, and of threads; or the code of a node that an edge, seen from its other end alone, leads to."""
        k, cap, columns = self.k, self.cap, ["edges_ok", "edges_repeated", "threads_ok", "threads_bad", "lone"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _whole(batches):
                each, tag = batch["code"].to_numpy(), batch["tag"].to_numpy()
                code, group = np.unique(each, return_inverse=True)
                own = np.flatnonzero(tag <= OWN + 15)
                there = np.stack([np.bincount(group[own], weights=tag[own] - OWN & bit > 0, minlength=len(code)) for bit in (4, 8)]).astype(np.int64)
                whole = (there > 0).all(axis=0) | (code == turned(code, k + 1)) & (there[0] > 0)
                of, end, _, _ = _threads(batch, cap, True)
                known = int((there[end - 1, np.searchsorted(code, of)] > 0).sum())
                sums = [there[:, whole].sum(), np.maximum(there - 1, 0).sum(), known, len(of) - known]
                yield pa.RecordBatch.from_arrays([*(pa.array([int(x)]) for x in sums), pa.nulls(1, pa.int64())], columns)
                for at in (0, 1):
                    some = np.flatnonzero(~whole & (there[at] > 0))
                    far = np.repeat(_port(_way(code[some], 2 - at, k), k)[0], there[at, some])
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(len(far), pa.int64())] * 4, pa.array(far)], columns)

        return _dealt(self._beside(every=True)).mapInArrow(run, ", ".join(f"{c} long" for c in columns))

    def marks(self, both: bool = True) -> DataFrame:
        """(code, tag, name) by the code of a thread's node: its name's id above its port, or -1 - its port beside its name."""
        k = self.k

        def make(code, end, names, ids):
            node, port = _port(_way(code, end, k), k)
            number, name = names.numbers(ids)
            return [pa.array(node), pa.array(np.where(number >= 0, number << 3 | port, -1 - port)), name]

        return self._run(make, TAGGED, both)


def _spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, _Names, np.ndarray]:
    """Some whole nodes' codes and ports, as bits; and the node's place, pair of ports (4 f + r) and name's id of each read over exactly two ports of a node, on opposite sides."""
    code, tag = batch["code"].to_numpy(), batch["tag"].to_numpy()
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    group = np.cumsum(np.append(False, code[1:] != code[:-1]))
    own = tag <= OWN + 255
    ports = np.zeros(len(first), np.int64)
    ports[group[own]] = tag[own] - OWN
    some = np.flatnonzero(~own)
    tag, group = tag[some], group[some]
    plain = tag >= 0
    port = np.where(plain, tag & 7, -1 - tag)
    names = _Names(np.where(plain, tag >> 3, -1), None if plain.all() else lambda: batch["name"].take(pa.array(some)))
    order = np.lexsort((names.ids << 3 | port, group))
    group, ids, port = group[order], names.ids[order], port[order]
    at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (ids[1:] != ids[:-1]))[: len(ids)])
    two = at[np.diff(np.append(at, len(ids))) == 2]
    two = two[(port[two] < 4) & (port[two + 1] >= 4)]
    return code[first], ports, group[two], port[two] << 2 | port[two + 1] & 3, names, ids[two]


def _weights(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and ports of some whole nodes, and how many reads join each pair of their ports."""
    code, ports, node, pair, _, _ = _spans(batch)
    return code, ports, np.bincount(node << 4 | pair, minlength=16 * len(code)).reshape(-1, 16)


def _pairs(code: np.ndarray, pair: np.ndarray, k: int) -> list[pa.Array]:
    """Letters of a node and of what follows it at a pair of its ports."""
    return [letters(code, k), *_next(code, pair >> 2, k), *_next(turned(code, k), pair & 3, k)]


PAIR = "node_id string, fd string, fn string, rd string, rn string"


def port_pair_weights(marks: DataFrame, k: int) -> DataFrame:
    """(node_id, fd, fn, rd, rn, weight): how many reads join each pair of ports."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            code, _, weight = _weights(batch)
            node, pair = np.nonzero(weight)
            yield pa.RecordBatch.from_arrays([*_pairs(code[node], pair, k), pa.array(weight[node, pair])], [f.split(" ")[0] for f in f"{PAIR}, weight".split(", ")])

    return _dealt(marks).mapInArrow(run, f"{PAIR}, weight long")


def port_pair_reads(marks: DataFrame, k: int) -> DataFrame:
    """The same with the names of these reads, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            code, _, node, pair, names, ids = _spans(batch)
            place = node << 4 | pair
            text = names.texts(ids)
            by = pa.table({"place": place, "text": text.cast(pa.binary())}).sort_by([("place", "ascending"), ("text", "ascending")])
            place, text = by["place"].to_numpy(), by["text"].combine_chunks()
            at = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
            ends = np.append(at, len(place))
            if text.null_count:  # a missing name counts, and is not written
                there = np.append(0, np.cumsum(text.is_valid().to_numpy(zero_copy_only=False)))
                text, lists = text.drop_null(), there[ends]
            else:
                lists = ends
            reads = pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), text.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*_pairs(code[place[at] >> 4], place[at] & 15, k), pa.array(np.diff(ends)), reads], [f.split(" ")[0] for f in f"{PAIR}, weight, reads".split(", ")])

    return _dealt(marks).mapInArrow(run, f"{PAIR}, weight long, reads array<string>")


def judged(marks: DataFrame, rows: DataFrame, k: int, min_weight: int) -> DataFrame:
    """(code, ports, covered, pairs) of each node of ``kmers.ported`` rows: its ports that enough reads join with one of the other side, and its pairs of ports that any joins (bit 4 f + r)."""
    bit = 1 << np.arange(16)
    both = np.array([1 << (i >> 2) | 16 << (i & 3) for i in range(16)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            code, ports, weight = _weights(batch)
            covered = np.bitwise_or.reduce(np.where(weight >= max(min_weight, 1), both, 0), axis=1) & ports
            pairs = ((weight > 0) * bit).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(code), *(pa.array(x.astype(np.int32)) for x in (ports, covered, pairs))], ["code", "ports", "covered", "pairs"])

    own = rows.select("code", (F.lit(OWN) + F.col("ports")).alias("tag"), _unnamed())
    return _dealt(marks.union(own)).mapInArrow(run, "code long, ports int, covered int, pairs int")


def edges_with_reads(nodes: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(node_id, edges): the edges (sdir, ddir, dst, reads) of nodes(code, ports), in order, with their numbers of threads, given as (code, port, reads)."""
    kind = "array<struct<sdir:string,ddir:string,dst:string,reads:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            code, tag = batch["code"].to_numpy(), batch["tag"].to_numpy()
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            group = np.cumsum(np.append(False, code[1:] != code[:-1]))
            own = tag < 0
            ports, reads = np.zeros(len(first), np.int64), np.zeros((len(first), 8), np.int64)
            ports[group[own]] = tag[own] - OWN
            reads[group[~own], tag[~own] & 7] = tag[~own] >> 3
            node, port = np.nonzero(ports[:, None] >> np.arange(8) & 1)
            start = np.where(port < 4, code[first][node], turned(code[first][node], k))
            v = (start << 2 | port & 3) & 4**k - 1
            back = turned(v, k)
            order = np.lexsort((np.minimum(v, back), v >= back, port >= 4, node))
            node, port = node[order], port[order]
            some, size = np.unique(node, return_counts=True)
            cells = [_WAY.take(pa.array((port < 4).astype(np.int8))), *_next(start[order], port & 3, k), pa.array(reads[node, port])]
            edges = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.StructArray.from_arrays(cells, ["sdir", "ddir", "dst", "reads"]))
            yield pa.RecordBatch.from_arrays([letters(code[first][some], k), edges], ["node_id", "edges"])

    own = nodes.select("code", (F.lit(OWN) + F.col("ports")).alias("tag"))
    seen = counts.select("code", F.shiftleft("reads", 3).bitwiseOR(F.col("port")).alias("tag"))
    return _dealt(own.union(seen)).mapInArrow(run, f"node_id string, edges {kind}")


def _tandem(code: np.ndarray, ports: np.ndarray, k: int) -> np.ndarray:
    """Whether a node has an edge to itself."""
    back, out = turned(code, k), np.zeros(len(code), bool)
    for here, side in ((code, ports & 15), (back, ports >> 4)):
        for to in (code, back):
            last = to & 3
            out |= ((here << 2 | last) & 4**k - 1 == to) & (side >> last & 1 == 1)
    return out


KINDS = pa.array(["straight", "tandem", "deadend", "xcut", "open"])
_BITS = np.array([i.bit_count() for i in range(256)])


def _kinds(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """Which of KINDS nodes are, see ``threads.node_classes``."""
    code, ports, covered = (batch[c].to_numpy() for c in ("code", "ports", "covered"))
    f, r = _BITS[ports & 15], _BITS[ports >> 4]
    return np.select([(f <= 1) & (r <= 1), _tandem(code, ports, k), (f == 0) | (r == 0), covered == ports], range(4), 4)


def node_classes(seen: DataFrame, k: int) -> DataFrame:
    """(node_id, kind, half, ports, covered) of ``judged`` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, ports = _kinds(batch, k), batch["ports"].to_numpy()
            half = (kind >= 3) & (np.minimum(_BITS[ports & 15], _BITS[ports >> 4]) == 1)
            cells = [letters(batch["code"].to_numpy(), k), KINDS.take(pa.array(kind)), pa.array(half), pa.array(_BITS[ports]), pa.array(_BITS[batch["covered"].to_numpy()])]
            yield pa.RecordBatch.from_arrays(cells, ["node_id", "kind", "half", "ports", "covered"])

    return seen.mapInArrow(run, "node_id string, kind string, half boolean, ports long, covered long")


def threadible(seen: DataFrame, k: int) -> DataFrame:
    """Those ``judged`` nodes that are to be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_kinds(batch, k) == 3))

    return seen.mapInArrow(run, seen.schema)


def independent(splitters: DataFrame, k: int) -> DataFrame:
    """Stored splitters(code, ports, …) without a splitting neighbour of a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, ports = batch["code"].to_numpy(), batch["ports"].to_numpy()
            for start, side in ((code, ports & 15), (turned(code, k), ports >> 4)):
                for base in range(4):
                    some = side >> base & 1 == 1
                    v = (start[some] << 2 | base) & 4**k - 1
                    to = np.minimum(v, turned(v, k))
                    less = to < code[some]
                    yield pa.RecordBatch.from_arrays([pa.array(to[less]), pa.array(code[some][less])], ["to", "code"])

    near = splitters.select("code", "ports").mapInArrow(run, "to long, code long")
    late = near.join(splitters.select(F.col("code").alias("to")), "to", "left_semi").select("code")
    return splitters.join(late, "code", "left_anti")


def copies(chosen: DataFrame, k: int) -> DataFrame:
    """(code, copy, of): the copies each of ``judged`` nodes becomes when it is split, numbered from 1, and how many.

    As ``threads.split_pairs``: every pair of ports that any read joins; where one side has
    one port only, every pair with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, ports, pairs = (batch[c].to_numpy() for c in ("code", "ports", "pairs"))
            f, r = ports & 15, ports >> 4
            half = (_BITS[f] == 1) | (_BITS[r] == 1)
            every = sum(((f >> i & 1) & (r >> j & 1)) << (4 * i + j) for i in range(4) for j in range(4))
            n = np.array([x.bit_count() for x in np.where(half, pairs | every, pairs).tolist()], np.int64)
            of = np.repeat(np.arange(len(code)), n)
            copy = np.arange(len(of)) - (np.cumsum(n) - n)[of] + 1
            yield pa.RecordBatch.from_arrays([pa.array(code[of]), pa.array(copy), pa.array(n[of])], ["code", "copy", "of"])

    return chosen.mapInArrow(run, "code long, copy long, of long")
