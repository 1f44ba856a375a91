"""Chains of a graph of coded K-mers, from runs that tasks find.

Along a chain all K-mers are in the same reads but where a read begins or ends.  K-mers are
therefore dealt by the smallest number of a read they are in (``kmers.ported``): each task
merges the runs it sees, and few links between runs are left to be ranked.  A run is known
by its first K-mer as it is read; an end of a run by the run as it is read towards that
end (``out``) and from it (``in``), each named by the first K-mer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace, ship, shuffle_partitions
from . import kmers, ranking

RUNS = "head long, tail long, n int, cov long, seq string, low long, low_at int, low_fwd boolean, left int, right int"
MET = "a_in long, a_out long, b_in long, b_out long, ends int, chained boolean"
#: K-mers that a task merges at once.
HELD = 400_000
_BITS = np.array([i.bit_count() for i in range(16)])
_BASE = np.array([max(i.bit_length() - 1, 0) for i in range(16)], np.int64)
_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def turned(code: np.ndarray, w: int) -> np.ndarray:
    """The codes of the other strand."""
    x = ~code.astype(np.uint64)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = (x >> np.uint64(shift)) & np.uint64(mask) | (x & np.uint64(mask)) << np.uint64(shift)
    return (x.byteswap() >> np.uint64(64 - 2 * w)).astype(np.int64)


def letters(code: np.ndarray, w: int) -> pa.Array:
    """The w bases of each code."""
    text = np.empty((len(code), w), np.uint8)
    for i in range(w):
        text[:, i] = _LETTERS[code >> 2 * (w - 1 - i) & 3]
    return pa.StringArray.from_buffers(len(code), pa.py_buffer(np.arange(len(code) + 1, dtype=np.int32) * w), pa.py_buffer(text.tobytes()))


def _led(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pointers lead that say what is before each, how far that is, and the smallest on the way; a ring's lead nowhere."""
    at, here = before.copy(), np.arange(len(before))
    root, rank, least = at == here, (at != here).astype(np.int64), np.minimum(here >> 1, at >> 1)
    for _ in range(len(before).bit_length() + 1):
        more = ~root[at]
        if not more.any():
            break
        rank, least, at = np.where(more, rank + rank[at], rank), np.where(more, np.minimum(least, least[at]), least), np.where(more, at[at], at)
    return at, rank, least


def _merged(code: np.ndarray, cov: np.ndarray, ports: np.ndarray, k: int) -> pa.RecordBatch:
    """The runs of some K-mers: those linked by the only edge of both that are both here, a ring cut before its smallest K-mer read forward."""
    order = np.argsort(code)
    code, cov, ports = code[order], cov[order], ports[order].astype(np.int64)
    back, side, n = turned(code, k), (ports & 15, ports >> 4), len(code)
    ahead = np.full(2 * n, -1)  # of K-mer i read forward, 2i, and back, 2i + 1
    for o, (start, other) in enumerate(((code, back), (back, code))):
        base = _BASE[side[o]]
        v, rv = start << 2 & 4**k - 1 | base, (3 - base) << 2 * k - 2 | other >> 2
        to, forward = np.minimum(v, rv), v < rv
        i = np.minimum(np.searchsorted(code, to), n - 1)
        there = np.where(forward, side[1][i], side[0][i])
        ok = (_BITS[side[o]] == 1) & (code[i] == to) & (i != np.arange(n)) & (_BITS[there] == 1)
        ahead[o::2] = np.where(ok, 2 * i + ~forward, -1)
    here = np.arange(2 * n)
    before = np.where(ahead[here ^ 1] >= 0, ahead[here ^ 1] ^ 1, here)
    at, rank, least = _led(before)
    ring = before[at] != at
    if ring.any():
        first = 2 * np.unique(least[ring])
        last = before[first] ^ 1
        before[first], before[last] = first, last
        at, rank, _ = _led(before)
    forward = at[::2] >> 1 <= at[1::2] >> 1  # a run and its mirror are the same; of their first K-mers the smaller one counts
    state = 2 * np.arange(n) + ~forward
    head, place = at[state], rank[state]
    line = np.lexsort((place, head))
    first = np.flatnonzero(np.append(True, head[line][1:] != head[line][:-1]))
    size = np.diff(np.append(first, n))
    last = first + size - 1
    read = np.where(forward, code, back)
    begin, end = line[first], line[last]
    low = np.minimum.reduceat(line, first)
    offset = np.append(0, np.cumsum(size + k - 1))
    text = np.empty(offset[-1], np.uint8)
    for j in range(k):
        text[offset[:-1] + j] = _LETTERS[read[begin] >> 2 * (k - 1 - j) & 3]
    text[np.repeat(offset[:-1], size) + place[line] + k - 1] = _LETTERS[read[line] & 3]
    cells = [
        pa.array(read[begin]), pa.array(read[end]), pa.array(size.astype(np.int32)), pa.array(np.add.reduceat(cov[line], first)),
        pa.StringArray.from_buffers(len(first), pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(text.tobytes())),
        pa.array(code[low]), pa.array(place[low].astype(np.int32)), pa.array(forward[low]),
        pa.array(np.where(forward[begin], side[1][begin], side[0][begin]).astype(np.int32)), pa.array(np.where(forward[end], side[0][end], side[1][end]).astype(np.int32)),
    ]
    return pa.RecordBatch.from_arrays(cells, [f.split(" ")[0] for f in RUNS.split(", ")])


def _runs(k: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([batch[c].to_numpy() for c in ("code", "cov", "ports")])
            n += batch.num_rows
            if n >= most:
                yield _merged(*map(np.concatenate, zip(*held, strict=True)), k)
                held, n = [], 0
        if n:
            yield _merged(*map(np.concatenate, zip(*held, strict=True)), k)

    return run


def _ends(k: int) -> Callable:
    """(code, a, b) of each edge at each end of runs: b if the strand that leaves there is not the one of the code, and in it ``out``, which end it is and whether the edge is its only one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, tail, left, right = (batch[c].to_numpy() for c in ("head", "tail", "left", "right"))
            for end, leaves, out, ports in ((0, tail, head, right), (1, turned(head, k), turned(tail, k), left)):
                own = out << 2 | end << 1 | (_BITS[ports] == 1)
                for base in range(4):
                    some = ports >> base & 1 == 1
                    way = leaves[some] << 2 | base
                    back = turned(way, k + 1)
                    other = way > back
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(way, back)), pa.array(own[some], mask=other), pa.array(own[some], mask=~other)], ["code", "a", "b"])

    return run


def _judged(k: int) -> Callable:
    """Edges with both their ends; bits 0 and 1 of ``ends`` tell which ends of their runs; one that is its own mirror has its end twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, one = batch["code"].to_numpy(), batch["b"].is_null().to_numpy(zero_copy_only=False)
            a, b = batch["a"].to_numpy(), batch["b"].fill_null(0).to_numpy()
            a_in, b_in = turned(code >> 2, k), code & 4**k - 1
            b, b_in = np.where(one, a, b), np.where(one, a_in, b_in)
            a_out, b_out, a_end, b_end = a >> 2, b >> 2, a >> 1 & 1, b >> 1 & 1
            same = np.where(a_end == 0, a_out, a_in) == np.where(b_end == 0, b_out, b_in)
            chained = (a & b & 1 == 1) & ~same
            yield pa.RecordBatch.from_arrays([*map(pa.array, (a_in, a_out, b_in, b_out, (a_end | b_end << 1).astype(np.int32), chained))], [f.split(" ")[0] for f in MET.split(", ")])

    return run


def merge(rows: DataFrame, k: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The runs of ``kmers.ported`` rows, and the edges at their ends, each with both its ends."""
    ship(rows.sparkSession)
    by = "origin" if "origin" in rows.columns else "code"
    dealt = rows.select("code", "cov", "ports", by).repartition(shuffle_partitions(rows.sparkSession), by).sortWithinPartitions(by)
    runs = work.put(dealt.select("code", "cov", "ports").mapInArrow(_runs(k, HELD), RUNS), "runs")
    ends = runs.select("head", "tail", "left", "right").mapInArrow(_ends(k), "code long, a long, b long")
    met = ends.groupBy("code").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return runs, work.put(met.mapInArrow(_judged(k), MET), "met")


def run_of(end: str) -> Column:
    """The run of an edge's end ``a`` or ``b``."""
    return F.when(F.col("ends").bitwiseAND(F.lit(1 if end == "a" else 2)) == 0, F.col(f"{end}_out")).otherwise(F.col(f"{end}_in"))


def chains(runs: DataFrame, met: DataFrame, k: int, work: Workspace) -> DataFrame:
    """(head, chain, ahead, base, first, total): of each run that is linked, its chain's first K-mer, whether it is read as the chain is, and how many K-mers are before it; of a ring the place of its smallest K-mer, where it is cut, and its K-mers.

    A chain and its mirror are the same; the one with the smaller first K-mer is kept.
    """
    canon = lambda c: F.least(F.col(c), kmers.turned_code(F.col(c), k))
    links = met.where("chained").select("*", run_of("a").alias("a"), run_of("b").alias("b"))
    none = F.lit(None).cast("long")
    row = lambda at, own, to, far: F.struct(F.col(at).alias("at"), F.col(own).alias("own"), to.alias("to"), far.alias("far"))
    each = F.array(row("b_in", "b", F.col("a_out"), F.col("a")), row("a_out", "a", none, none), row("a_in", "a", F.col("b_out"), F.col("b")), row("b_out", "b", none, none))
    p = links.select(F.explode(each).alias("e")).select("e.*").groupBy("at").agg(*[F.max(c).alias(c) for c in ("own", "to", "far")])
    p = work.put(p, "ends")
    linked = runs.drop("seq").join(p.select(F.col("own").alias("head")).distinct(), "head", "left_semi")
    linked = work.put(linked.select("head", kmers.turned_code(F.col("tail"), k).alias("back"), "n", "low", "low_at", "low_fwd"), "linked")
    p = p.join(linked.select(F.col("head").alias("own"), "low"), "own").join(linked.select(F.col("head").alias("far"), "n"), "far", "left")
    done = F.col("to").isNull()
    first = work.put(p.select("at", F.coalesce("to", "at").alias("to"), F.coalesce("n", F.lit(0)).cast("long").alias("rank"), done.alias("done"), "low"), "pointers")
    ptr, lows = ranking.rank(first, met.where("chained").count(), k, work, "ptr")
    ptr = ptr.select("at", "to", "rank", "done", "low")
    closed = None
    if lows is not None:
        # a ring begins with the run of its smallest K-mer, read so that this one is read forward
        begin = linked.join(lows.select("low"), "low", "left_semi").select(
            "low", F.when(F.col("low_fwd"), F.col("head")).otherwise(F.col("back")).alias("start"), F.when(F.col("low_fwd"), F.col("back")).otherwise(F.col("head")).alias("mirror"),
            F.when(F.col("low_fwd"), F.col("low_at")).otherwise(F.col("n") - 1 - F.col("low_at")).cast("long").alias("first"),
        )
        begin = work.put(begin, "begin")
        ring = first.join(ptr.where("not done").select("at").distinct(), "at", "left_semi").drop("done")
        ring = ring.join(begin.select(F.col("start").alias("at"), F.lit(True).alias("here")), "at", "left").join(begin.select(F.col("mirror").alias("to"), F.lit(True).alias("there")), "to", "left")
        head = F.coalesce("here", "there", F.lit(False))
        again = work.put(ring.select("at", F.when(head, F.col("at")).otherwise(F.col("to")).alias("to"), F.when(head, 0).otherwise(F.col("rank")).cast("long").alias("rank"), head.alias("done"), "low"), "again")
        opened, lows = ranking.rank(again, again.count(), k, work, "cut-ptr")
        if lows is not None:
            raise RuntimeError("rings left after cutting")
        ptr = ptr.where("done").union(opened.select(*ptr.columns))
        closed = begin.select(F.col("start").alias("to"), F.col("low").alias("ring"), "first")
    at = lambda c, name: ptr.select(F.col("at").alias(c), F.col("to").alias(f"{name}_to"), F.col("rank").alias(f"{name}_rank"))
    both = linked.select("head", "back", "n").join(at("head", "f"), "head").join(at("back", "r"), "back")
    both = both.withColumns({"f_head": canon("f_to"), "r_head": canon("r_to")})
    ahead, chain = F.col("f_head") < F.col("r_head"), F.least("f_head", "r_head")
    if closed is not None:
        for d in "fr":
            both = both.join(closed.select(F.col("to").alias(f"{d}_to"), F.col("ring").alias(f"{d}_ring"), F.col("first").alias(f"{d}_first")), f"{d}_to", "left")
        ring = F.coalesce("f_ring", "r_ring")
        ahead, chain = F.when(ring.isNull(), ahead).otherwise(F.col("f_ring").isNotNull()), F.coalesce(ring, chain)
    start = none if closed is None else F.coalesce("f_first", "r_first")
    out = both.select("head", chain.alias("chain"), ahead.alias("ahead"), F.when(ahead, F.col("f_rank")).otherwise(F.col("r_rank")).alias("base"), start.alias("first"), "n")
    if closed is None:
        return work.put(out.drop("n").withColumn("total", none), "chains")
    total = out.where("first is not null").groupBy("chain").agg(F.sum("n").alias("total"))
    return work.put(out.drop("n").join(total, "chain", "left").select("head", "chain", "ahead", "base", "first", "total"), "chains")


def places(runs: DataFrame, k: int) -> DataFrame:
    """(code, head, pos, n, fwd) of each K-mer of runs(head, seq): its run, its place there, the run's K-mers, and whether it is read forward."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.rename_columns(["read", "seq"])
            for heads, p in kmers.parts(iter([text]), k):
                n = np.diff(np.append(p.first, len(p.f)))[p.of]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p.f, p.r)), heads.take(pa.array(p.of)), pa.array(p.pos), pa.array(n), pa.array(p.f < p.r)], ["code", "head", "pos", "n", "fwd"])

    return runs.select("head", "seq").mapInArrow(run, "code long, head long, pos long, n long, fwd boolean")


def named(edges: DataFrame, k: int) -> DataFrame:
    """edges(src, sdir, ddir, dst) between codes of either strand, directions as whether they are forward, in letters and as seen from both ends; one that is its own mirror once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way = pa.array(["r", "f"])
        for batch in batches:
            src, dst = (np.minimum(x, turned(x, k)) for x in (batch["src"].to_numpy(), batch["dst"].to_numpy()))
            sdir, ddir = (batch[c].to_numpy(zero_copy_only=False) for c in ("sdir", "ddir"))
            more = ~((src == dst) & (sdir != ddir))
            cells = [(src, sdir, ddir, dst), (dst[more], ~ddir[more], ~sdir[more], src[more])]
            for u, s, d, v in cells:
                yield pa.RecordBatch.from_arrays([letters(u, k), way.take(pa.array(s.astype(np.int8))), way.take(pa.array(d.astype(np.int8))), letters(v, k)], ["src", "sdir", "ddir", "dst"])

    ship(edges.sparkSession)
    return edges.select("src", "sdir", "ddir", "dst").mapInArrow(run, "src string, sdir string, ddir string, dst string")
