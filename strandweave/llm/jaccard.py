"""N-gram Jaccard join: size-aware, heavy-light, exact.

A document's set holds its distinct k-word shingles.  Documents with equal sets are one
class; classes link when the Jaccard similarity of their sets reaches ``num/den``.

* **Small sets** (size up to a boundary): every subset of the overlap's size is
  enumerated; two linked small sets share one of them.
* **Large sets**: shingles are put into one global order, rare ones first; a set's
  prefix goes to inverted lists, and large sets scan the lists they stand in.  Linked
  sets always share a prefix shingle.  Small sets that can link with large ones stand in
  these lists too.

The boundary minimises the estimated cost: subsets to enumerate against list entries to
scan.  The order comes from a fixed-size count sketch over the shingles of all documents;
any order gives the same links, a good one keeps common passages out of the prefixes.

Candidates are cut down by an exact bound from 1024-bit parity maps and verified on full
sets.  Short lists give all their pairs.  A long list first links its members with a
central one; only members that are then still in different components are compared
further, and the last pass takes every such pair, so that no link between components is
lost.  Links are reported as a spanning set: they connect just what all links connect.

Hot groups are split.  A task posts a class once, however many copies it reads.  Entries
of a shingle that the sketch shows to be frequent are spread over buckets by class, and
their list counts as long wherever they meet.  Long lists are worked on in blocks of
members, dealt anew in every central round; the last pass takes every pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import mix, pieces, shingles, words
from .cluster import Workspace, shuffle_partitions, trimmed
from .components import components

#: Counters of the order's sketch, and slices it is shipped in.  Fixed; 4 MB broadcast.
SKETCH, SLICES = 1 << 22, 32
#: Bits of a parity map: the one every class has, and the one of classes that are verified.
BITS, WIDE_BITS = 1024, 8192
#: Largest set size considered for enumeration.
SMALL = 16
#: Lists up to this length give all their pairs at once; longer ones go through central members.
LIST = 24
#: Pairs that may be broadcast: 16 bytes each.
FEW_PAIRS = 200_000
#: Rounds with central members before the exhaustive one.
CENTRAL_ROUNDS = 3
#: Members of a long list that meet in one group.
BLOCK = 8192
#: Level of the sketch (65,536 documents) from which a shingle's entries are spread.
HOT = 128
#: Class keys a task remembers to have sent; beyond that it forgets, and receivers drop what comes twice.
REMEMBERED = 1 << 20


def least_overlap(n, m, num: int, den: int):
    """Smallest intersection that links sets of sizes n and m."""
    return -(-num * (n + m) // (num + den))


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def text_key(text: Column) -> Column:
    """A text's hash; with its doc_id, a document's name."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _parity(h: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Rows of bits/8 bytes: the parity of the number of shingles at each bit."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    flat = np.bincount(owner * bits + (h >> np.uint64(20)).astype(np.int64) % bits, minlength=n * bits)
    return np.packbits((flat & 1).astype(np.uint8).reshape(n, bits), axis=1)


def _distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles sorted and without repeats."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(at) - 1))])


def _sets(column, k: int):
    """(first row, shingles, where each text's begin) of slices of a text column."""
    for first, raw, off in pieces(column, 1 << 20):
        h, at = words(raw, off)
        yield (first, *_distinct(*shingles(h, at, k)))


def _class_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hash of each set; 0 for an empty one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return mix(sums[at[1:]] - sums[at[:-1]] + (np.diff(at)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_SURVEYED = "doc_id long, text_key long, n long, key long, bits binary, small binary, slice int, counts binary"


def _survey(k: int):
    """Per document its set's size, key, parity map (and the set, if small); at a task's end its part of the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        names = [f.split(" ")[0] for f in _SURVEYED.split(", ")]
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text_key")
            for first, h, at in _sets(batch.column("text"), k):
                np.add.at(counts, (h >> np.uint64(42)).astype(np.int64), 1)
                n = np.diff(at)
                small = [h[a:b].tobytes() if 0 < b - a <= SMALL else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                bits = [r.tobytes() for r in _parity(h, at, BITS)]
                rows = len(n)
                cells = [ids.slice(first, rows), texts.slice(first, rows), n, _class_keys(h, at).view(np.int64), bits, small, [None] * rows, [None] * rows]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=names)
        width = SKETCH // SLICES
        if counts.any():
            parts = [counts[i * width : (i + 1) * width].tobytes() for i in range(SLICES)]
            cells = [[None] * SLICES] * 6 + [list(range(SLICES)), parts]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=names)

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the tasks' counts slice by slice, and keeps eight levels a doubling."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, body in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(body, np.uint32)
            total[k] = total[k] + part if k in total else part.astype(np.uint64)
    for k, counts in total.items():
        level = np.minimum(np.ceil(8 * np.log2(1 + counts.astype(np.float64))), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "level"])


def _in_order(h: np.ndarray, at: np.ndarray, level: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first want[i] shingles of each set in the global order (level, then hash), and whose they are."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    # hashes ascend inside a set already, so a stable sort by level orders ties by hash
    order = np.argsort(owner * 256 + level[(h >> np.uint64(42)).astype(np.int64)], kind="stable")
    place = np.arange(len(h)) - at[:-1][owner]
    keep = place < want[owner]
    return h[order][keep], owner[keep]


def _costs(level: np.ndarray, num: int, den: int):
    """For small sets: their number by size, and the list entries their prefixes would scan by the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, scans = np.zeros(SMALL + 1, np.int64), np.zeros(SMALL + 1)
        for batch in batches:
            for body in batch.column("small").to_pylist():
                h = np.frombuffer(body, np.uint64)
                lengths = np.sort(np.exp2(level[(h >> np.uint64(42)).astype(np.int64)] / 8.0))
                sizes[len(h)] += 1
                scans[len(h)] += lengths[: prefix_length(len(h), num, den)].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SMALL + 1)), pa.array(sizes), pa.array(scans)], names=["n", "sets", "scanned"])

    return run


def overlaps(n: int, boundary: int, num: int, den: int) -> list[int]:
    """Overlap sizes by which a small set of size n can link with another small set."""
    low, high = -(-num * n // den), min(boundary, den * n // num)
    return sorted({least_overlap(n, m, num, den) for m in range(low, high + 1)})


def choose_boundary(sets: dict[int, int], scanned: dict[int, float], num: int, den: int) -> int:
    """The size up to which enumeration costs less than scanning."""

    def cost(x: int) -> float:
        subsets = sum(sets.get(n, 0) * sum(comb(n, c) for c in overlaps(n, x, num, den)) for n in range(1, x + 1))
        bridges = sum(scanned.get(n, 0.0) for n in range(1, x + 1) if den * n >= num * (x + 1))
        return subsets + bridges + sum(scanned.get(n, 0.0) for n in range(x + 1, SMALL + 1))

    return min(range(SMALL + 1), key=lambda x: (cost(x), x))


def _unsent(key: np.ndarray, sent: set[int]) -> np.ndarray:
    """Which rows are the first of their class in this task."""
    new = np.zeros(len(key), bool)
    for i, x in enumerate(key.tolist()):
        if x not in sent:
            new[i] = True
            sent.add(x)
    if len(sent) > REMEMBERED:
        sent.clear()
    return new


def _post(k: int, level: np.ndarray, boundary: int, buckets: int, num: int, den: int, hot: int):
    """Packed list entries (token, class, size) by bucket.

    The lowest bit is set in subset tokens, the next one in hot shingles' tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for _, h, at in _sets(batch.column("text"), k):
                n, key = np.diff(at), _class_keys(h, at)
                new = _unsent(key, sent) & (n > 0)
                scans = new & ((n > boundary) | (den * n >= num * (boundary + 1)))
                token, owner = _in_order(h, at, level, np.where(scans, prefix_length(n, num, den), 0))
                often = level[(token >> np.uint64(42)).astype(np.int64)].astype(np.int64)
                spread = np.where(often >= hot, np.exp2(np.maximum(often - hot, 0) / 8.0 + 1).astype(np.uint64), np.uint64(1))
                held.append((mix(token) & ~np.uint64(3) | (often >= hot).astype(np.uint64) << np.uint64(1), key[owner], n[owner], key[owner] % spread))
                for i in np.flatnonzero(new & (n <= boundary)).tolist():
                    own = h[at[i] : at[i + 1]]
                    for c in overlaps(len(own), boundary, num, den):
                        some = np.array(list(combinations(own.tolist(), c)), np.uint64)
                        token = mix(mix(some).sum(axis=1, dtype=np.uint64) + np.uint64(c)) & ~np.uint64(3) | np.uint64(1)
                        held.append((token, np.full(len(token), key[i]), np.full(len(token), len(own)), np.zeros(len(token), np.uint64)))
            token, key, n, salt = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64),) * 4
            bucket = ((token >> np.uint64(33)) + salt).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            token, key, n = token[order], key[order], n[order].astype(np.uint32)
            some, begin = np.unique(bucket[order], return_index=True)
            ends = np.append(begin, len(token))[1:]
            bodies = [(token[a:b].tobytes(), key[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
            columns = list(zip(*bodies, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(list(c), pa.binary()) for c in columns)], names=["bucket", "tokens", "keys", "sizes"])

    return run


_FOUND = "token long, a long, an long, b long, bn long"


def _scan_lists(boundary: int, num: int, den: int):
    """Pairs of short lists (a, b); members of long lists (token, a)."""

    def one(token: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((key, n, token))
        token, key, n = token[order], key[order], n[order]
        same = np.ones(len(token), bool)
        same[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, n = token[same], key[same], n[same]  # copies of a class
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(begin, len(token)))
        # other entries of a hot token lie elsewhere
        is_long = (length > LIST) | (token[begin] & np.uint64(2)).astype(bool)
        out: list[np.ndarray] = []
        small_ok = (token & np.uint64(1)).astype(bool)
        for d in range(1, LIST):  # each short list's pairs at distance d
            left = np.flatnonzero(np.repeat(~is_long & (length > d), length))
            left = left[left + d < len(token)]
            left = left[token[left] == token[left + d]]
            left = left[num * n[left + d] <= den * n[left]]  # sizes ascend
            left = left[small_ok[left] | (n[left + d] > boundary)]
            out.append(np.stack([key[left], n[left], key[left + d], n[left + d]]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((4, 0), np.uint64)
        long = np.repeat(is_long, length)
        t = np.concatenate([np.zeros(pairs.shape[1], bool), np.ones(int(long.sum()), bool)])
        columns = [np.concatenate([p, x]) for p, x in zip(pairs, (key[long], n[long], key[long], n[long]), strict=True)]
        tokens = pa.array(np.concatenate([np.zeros(pairs.shape[1], np.uint64), token[long]]).view(np.int64), mask=~t)
        a, an, b, bn = (c.astype(np.uint64).view(np.int64) for c in columns)
        yield pa.RecordBatch.from_arrays([tokens, pa.array(a), pa.array(an), pa.array(b, mask=t), pa.array(bn, mask=t)], names=["token", "a", "an", "b", "bn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close():
            return one(*(np.frombuffer(b"".join(x), d) for x, d in zip(zip(*held, strict=True), (np.uint64, np.uint64, np.uint32), strict=True)))

        for batch in batches:
            for bucket, *body in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tokens", "keys", "sizes")), strict=True):
                if now is not None and bucket != now:
                    yield from close()
                    held = []
                now = bucket
                held.append(body)
        if held:
            yield from close()

    return run


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _maps(column) -> np.ndarray:
    body = column.to_pylist()
    return np.frombuffer(b"".join(body), np.uint64).reshape(len(body), -1)


def _may_link(n, m, differ, num: int, den: int):
    """Whether sets of these sizes can link, given that at least ``differ`` shingles are in one only."""
    return (n + m - differ) // 2 >= least_overlap(n, m, num, den)


def _bound(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            differ = _hamming(_maps(batch.column("abits")), _maps(batch.column("bbits")))
            n, m = batch.column("an").to_numpy(), batch.column("bn").to_numpy()
            keep = pa.array(_may_link(n, m, differ, num, den))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(differ / (n + m))], names=["a", "b", "apart"]).filter(keep)

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("aset").to_pylist(), batch.column("bset").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * shared >= num * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _sets_of(k: int, wanted: np.ndarray):
    """Sets of the documents whose id may be wanted, by a bitmap of hashed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, sent = len(wanted) * 8, set()
        for batch in batches:
            at = (mix(batch.column("doc_id").fill_null(0).to_numpy().astype(np.uint64)) % np.uint64(size)).astype(np.int64)
            batch = batch.filter(pa.array((wanted[at >> 3] >> (at & 7) & 1).astype(bool)))
            for _, h, where in _sets(batch.column("text"), k):
                keys = _class_keys(h, where)
                new = pa.array(_unsent(keys, sent))
                keys = keys.view(np.int64)
                bodies = [h[a:b].tobytes() for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
                wide = [r.tobytes() for r in _parity(h, where, WIDE_BITS)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(bodies, pa.binary()), pa.array(wide, pa.binary())], names=["key", "body", "wide"]).filter(new)

    return run


#: Bits of the bitmap of wanted documents: 2 MB; what it lets through in vain is dropped by the join.
WANTED = 1 << 24


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = np.zeros(WANTED // 8, np.uint8)
    for batch in batches:
        at = (mix(batch.column("rep").to_numpy().astype(np.uint64)) % np.uint64(WANTED)).astype(np.int64)
        np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))
    width = len(marks) // SLICES
    if marks.any():
        yield pa.RecordBatch.from_arrays([pa.array(list(range(SLICES)), pa.int32()), pa.array([marks[i * width : (i + 1) * width].tobytes() for i in range(SLICES)], pa.binary())], names=["slice", "marks"])


def _merge_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, body in zip(batch.column("slice").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            part = np.frombuffer(body, np.uint8)
            total[k] = total[k] | part if k in total else part
    for k, marks in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([marks.tobytes()], pa.binary())], names=["slice", "marks"])


def _open_pairs(central: bool, num: int, den: int):
    """Of each block of a long list: pairs of members in different components that the parity maps don't rule out.

    With ``central``, only those of the member nearest to a spread of the others, and of
    the most central one outside its component.  Otherwise those of every member; where
    two blocks meet, of every member of the one with every member of the other.
    """

    def one(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, n, group, other = (rows.column(c).to_numpy() for c in ("a", "an", "component", "other"))
        maps = _maps(rows.column("bits"))
        if central:
            spread = np.linspace(0, len(n) - 1, min(64, len(n))).astype(int)
            near = np.zeros(len(n), np.int64)
            for s in spread.tolist():
                near += _hamming(maps, maps[s])
            tries = [int(near.argmin())]
            rest = np.flatnonzero(group != group[tries[0]])
            if len(rest):
                tries.append(int(rest[near[rest].argmin()]))
        else:
            tries = np.flatnonzero(~other).tolist()
        across = np.flatnonzero(other)
        for i in tries:
            others = np.arange(len(n)) if central else across if len(across) else np.arange(i + 1, len(n))
            others = others[group[others] != group[i]]
            others = others[(num * np.maximum(n[others], n[i]) <= den * np.minimum(n[others], n[i]))]
            others = others[_may_link(n[others], n[i], _hamming(maps[others], maps[i]), num, den)]
            if len(others):
                x = np.full(len(others), key[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, key[others])), pa.array(np.maximum(x, key[others]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("token", "lo", "hi")], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)])) if len(at) else []
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                if now is not None and (at[a] != now).any():
                    yield from one(pa.Table.from_batches(held))
                    held = []
                now = at[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from one(pa.Table.from_batches(held))

    return run


def _in_blocks(members: DataFrame, central: bool, deal: int) -> DataFrame:
    """Members(token, a, an, component, bits, members) with the blocks (lo, hi) they meet in; ``other`` marks those of hi.

    In central rounds a member is in its own block only, dealt anew by ``deal``; else each
    block meets itself and every other one.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("a", F.lit(deal)), blocks))
    met = F.col("block") if central else F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    dealt = dealt.withColumn("met", met)
    lo, hi = F.least("block", "met"), F.greatest("block", "met")
    return dealt.select("token", lo.alias("lo"), hi.alias("hi"), "a", "an", "component", "bits", (F.col("block") > F.col("met")).alias("other"))


def similar_documents(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, set_key, text_key, first.

    ``component_id`` is the smallest doc_id reachable by links, itself included; ``first``
    marks one set of each component under its smallest doc_id, and every row with an empty
    set; texts of that set and id that differ in case or white space only, by ``text_key``,
    are first together.  A null,
    empty or wordless text has an empty set and links with nothing; fewer than k words
    are one shingle, the whole sequence.  Repeated doc_ids and a null one are rows of
    their own sets; a null is never a component's name unless all its members are null.
    Texts of any length are read whole.  Other columns are ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = shuffle_partitions(spark)

    surveyed = work.put(rows.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(trimmed(_survey(k)), _SURVEYED), "surveyed")
    described = surveyed.where("slice is null")
    sliced = surveyed.where("slice is not null").select("slice", "counts").repartition(min(SLICES, parts), "slice")
    level = np.zeros(SKETCH, np.uint8)
    width = SKETCH // SLICES
    for r in sliced.mapInArrow(trimmed(_add_slices), "slice int, level binary").collect():  # the sketch's fixed size
        level[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["level"], np.uint8)
    classes = described.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = work.put(classes, "classes")
    costs = described.where("small is not null").select("small").mapInArrow(trimmed(_costs(level, num, den)), "n long, sets long, scanned double")
    by_size = costs.groupBy("n").agg(F.sum("sets").alias("sets"), F.sum("scanned").alias("scanned")).collect()  # SMALL + 1 rows at most
    boundary = choose_boundary({r["n"]: r["sets"] for r in by_size}, {r["n"]: r["scanned"] for r in by_size}, num, den)

    total = described.agg(F.sum("n")).first()[0] or 0
    buckets = max(2 * parts, total // 4_000_000)
    posted = rows.select("text").mapInArrow(trimmed(_post(k, level, boundary, buckets, num, den, HOT)), "bucket int, tokens binary, keys binary, sizes binary")
    met = posted.repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = work.put(met.mapInArrow(trimmed(_scan_lists(boundary, num, den)), _FOUND), "found")
    work.tidy()

    pairs = found.where("token is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    maps = classes.select("key", "n", "bits")

    def bounded(p: DataFrame) -> DataFrame:
        """Pairs that the parity maps don't rule out."""
        p = p.join(maps.select(F.col("key").alias("a"), F.col("n").alias("an"), F.col("bits").alias("abits")), "a")
        p = p.join(maps.select(F.col("key").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bbits")), "b")
        return p.select("a", "b", "an", "bn", "abits", "bbits").mapInArrow(trimmed(_bound(num, den)), "a long, b long, apart double")

    pairs = work.put(bounded(pairs), "pairs")
    members = found.where("token is not null").select("token", "a", "an")
    open_ = work.put(members.join(maps.select(F.col("key").alias("a"), "bits"), "a"), "open")
    work.drop("found")

    # full sets of the classes that any pair or long list may ask for
    asked = pairs.select("a").union(pairs.select("b")).union(open_.select("a")).distinct().withColumnRenamed("a", "key")
    wanted = work.put(asked.join(classes.select("key", "rep"), "key"), "wanted")
    marks = np.zeros(WANTED // 8, np.uint8)
    width = len(marks) // SLICES
    marked = wanted.select(F.coalesce("rep", F.lit(0).cast("long")).alias("rep")).mapInArrow(trimmed(_mark), "slice int, marks binary").repartition(min(SLICES, parts), "slice")
    for r in marked.mapInArrow(trimmed(_merge_marks), "slice int, marks binary").collect():  # the bitmap's fixed size
        marks[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["marks"], np.uint8)
    bodies = rows.mapInArrow(trimmed(_sets_of(k, marks)), "key long, body binary, wide binary") if marks.any() else spark.createDataFrame([], "key long, body binary, wide binary")
    bodies = work.put(bodies.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]), "bodies", codec="lz4")
    work.tidy()

    def verified(p: DataFrame, name: str) -> DataFrame | None:
        """Pairs whose full sets reach the similarity; none if there are no pairs.

        Wide parity maps go first: they leave few pairs that fail, and are a fraction of the
        sets.  Few pairs, by a count, are broadcast, so that only what they name is moved.
        """
        p = work.put(p, name)

        def with_both(p: DataFrame, column: str) -> DataFrame | None:
            n = p.count()
            if n == 0:
                return None
            at_a = bodies.select(F.col("key").alias("a"), F.col(column).alias("x"), (F.octet_length("body") / 8).cast("long").alias("an"))
            at_b = bodies.select(F.col("key").alias("b"), F.col(column).alias("y"), (F.octet_length("body") / 8).cast("long").alias("bn"))
            if n <= FEW_PAIRS:
                return at_a.join(F.broadcast(p), "a").join(at_b.join(F.broadcast(p.select("b").distinct()), "b", "left_semi"), "b")
            return p.join(at_a, "a").join(at_b, "b")

        maps = with_both(p, "wide")
        if maps is None:
            return None
        close = maps.select("a", "b", "an", "bn", F.col("x").alias("abits"), F.col("y").alias("bbits")).mapInArrow(trimmed(_bound(num, den)), "a long, b long, apart double")
        both = with_both(work.put(close.select("a", "b"), f"{name}-close"), "body")
        if both is None:
            return None
        return both.select("a", "b", F.col("x").alias("aset"), F.col("y").alias("bset")).mapInArrow(trimmed(_verify(num, den)), "a long, b long")

    group = work.put(wanted.select(F.col("key").alias("node"), F.col("key").alias("component")), "group0")
    step = 0

    def merged(group: DataFrame, links: DataFrame | None) -> DataFrame:
        """The grouping after more links: components of the components they join."""
        nonlocal step
        if links is None:
            return group
        joined = work.put(named_ends(links, group), f"ends{step}")
        if joined.limit(1).count() == 0:
            return group
        moved = components(joined, "ga", "gb")
        step += 1
        to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
        after = work.put(group.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), f"group{step}")
        work.drop(f"group{step - 1}", f"ends{step - 1}")
        return after

    def named_ends(p: DataFrame, group: DataFrame) -> DataFrame:
        """Pairs whose ends are not in one component yet, with the components."""
        p = p.join(group.select(F.col("node").alias("a"), F.col("component").alias("ga")), "a")
        p = p.join(group.select(F.col("node").alias("b"), F.col("component").alias("gb")), "b")
        return p.where("ga != gb").select("a", "b", "ga", "gb")

    # first each class with its likeliest partner, then only pairs that still join components
    first = pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("near")).select("near.a", "b")
    group = merged(group, verified(first, "asked0"))
    group = merged(group, verified(named_ends(pairs, group).select("a", "b"), "asked1"))
    central = CENTRAL_ROUNDS
    for r in range(CENTRAL_ROUNDS + 1) if open_.limit(1).count() else ():
        labelled = open_.join(group.withColumnRenamed("node", "a"), "a")
        mixed = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo != hi").select("token", "members")
        mixed = work.put(mixed, f"mixed{r}")
        if mixed.limit(1).count() == 0:  # every list lies in one component
            break
        left = _in_blocks(labelled.join(mixed, "token"), central > 0, r)
        left = left.repartition(parts, "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "an", "a")
        more = left.mapInArrow(trimmed(_open_pairs(central > 0, num, den)), "a long, b long").distinct()
        before = step
        group = merged(group, verified(more, f"asked{r + 2}"))
        if central == 0:
            break
        central = central - 1 if step > before else 0  # nothing won: on to every pair
    work.drop("bodies", "pairs", "open")

    # names: a component of classes is called by its least document
    named = classes.select("key", "rep").join(group.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = named.join(least, "component")
    # several classes of a component may have its least document's id
    one = of_class.where(F.col("rep").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("key").alias("first_key"))
    of_class = of_class.join(one, "component").select("key", "component_id", (F.col("key") == F.col("first_key")).alias("wins"))
    ids = described.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("set_key"))
    out = ids.join(of_class.withColumnRenamed("key", "set_key"), "set_key", "left")
    first = (F.col("n_shingles") == 0) | (F.col("wins") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "set_key", "text_key", first.alias("first"))
