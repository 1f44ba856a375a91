"""Hierarchical Pitman-Yor language model over words, with seating sampled by Gibbs.

The context of a word is the word before it (a text's end before its first word).  Every
context is a restaurant; all of them share one parent, the restaurant of single words,
whose base is uniform over the V known words and one slot for all unknown ones.  A
context restaurant's tables are the parent's customers.

A Gibbs sweep seats all customers of every dish again.  Predictions and parents depend on
the numbers of tables alone, so the sizes are summed out: the tables of a dish are drawn
at once from their exact odds given all other dishes, by generalized Stirling numbers.
Beyond ``FEW`` customers these get too many; there the sizes are kept, and whole tables are
split and merged with the odds of all customers that move.  The predictive probability is
averaged over the samples after burn-in and summed over a text.

What is distributed, and how.  Texts are packed into chunks with a dictionary each.
Words live in slices by hash, pairs of words in buckets by hash; rows of a hot context
therefore spread over all buckets, and chunks send each distinct pair once.  Tables of
different pairs depend on each other only through sums by word, so buckets sweep in
parallel between two exchanges of these sums, holding the parent's state fixed meanwhile.
A pair seen once has one table and needs no sampling; it only adds to the sums.  Nothing
that grows with the corpus is broadcast or collected; slices and buckets get more with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mix, pieces, words
from .cluster import Workspace, shuffle_partitions, trimmed
from .tokenfile import pack_ids, unpack_ids

#: Text bytes of a chunk, about.
CHUNK = 8 << 20
#: Words of all chunks' dictionaries that a slice has, and tokens of a bucket, about.
SLICE, BUCKET = 250_000, 1_500_000
#: Customers of a dish whose tables are drawn at once; in larger ones tables are split and merged.
FEW = 1024
#: Splits and merges that a sweep tries besides those that follow the tables to expect.
MOVES = 16
BURN_IN, SAMPLES = 1, 2
STRENGTH, TOP_STRENGTH, TOP_DISCOUNT = 1.0, 1.0, 0.8
END = np.uint64(0x1F0A3D5C7B9E2461)

PARCEL = "kind int, dest long, sender long, a binary, b binary, c binary, d binary"
_NAMES = ["kind", "dest", "sender", "a", "b", "c", "d"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]


def planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as byte planes, without the planes above the largest: much alike in each, so the store's codec shrinks them."""
    x = np.ascontiguousarray(x).reshape(-1).astype(np.uint64)
    p = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return p.to_bytes(1, "little") + len(x).to_bytes(8, "little") + x.view(np.uint8).reshape(-1, 8)[:, :p].T.tobytes()


def arr(body: bytes | None, kind) -> np.ndarray:
    """What ``planes`` packed."""
    if not body:
        return np.zeros(0, kind)
    p, n = body[0], int.from_bytes(body[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :p] = np.frombuffer(body, np.uint8, offset=9).reshape(p, n).T
    return out.view(np.uint64).reshape(-1).astype(kind)


def count_of(body: bytes) -> int:
    return int.from_bytes(body[1:9], "little")


def parcels(rows: list[tuple]) -> pa.RecordBatch:
    full = [(*r, *[None] * (7 - len(r))) for r in rows]
    cells = [[planes(x) if isinstance(x, np.ndarray) else x for x in c] for c in zip(*full, strict=True)] or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _TYPES, strict=True)], names=_NAMES)


def delivered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Parcels by destination, from rows sorted by (dest, kind, sender)."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["dest"] != now:
                yield now, held
                held = []
            now = row["dest"]
            held.append(row)
    if held:
        yield now, held


def deliver(df: DataFrame, parts: int, work) -> DataFrame:
    """Sends parcels to their destinations, where ``work(dest, rows)`` yields lists of parcels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dest, rows in delivered(batches):
            for out in work(dest, rows):
                yield parcels(out)

    return dealt(df, parts).mapInArrow(trimmed(run), PARCEL)


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """Parcels sorted by (dest, kind, sender); destinations are numbers in a row, and go round the partitions."""
    by = df.select(*_NAMES).repartitionById(parts, F.pmod(F.col("dest") + F.shiftright("dest", 32), F.lit(parts)).cast("int"))
    return by.sortWithinPartitions("dest", "kind", "sender")


def joined(rows: list[dict], field: str, kind) -> np.ndarray:
    return np.concatenate([arr(r[field], kind) for r in rows]) if rows else np.zeros(0, kind)


# ---- chunks and names

_CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, sizes array<long>, control binary, data binary, by_rank binary, hashes binary, counts binary"


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, size, held_back = TaskContext.get().partitionId() << 32, 0, []

    def close() -> pa.RecordBatch:
        streams, sizes, ids, held = (list(x) for x in zip(*held_back, strict=True))
        sizes, held = np.concatenate(sizes), np.concatenate(held)
        hashes, tokens = np.unique(np.concatenate(streams), return_inverse=True)
        counts = np.bincount(tokens, np.repeat(~held, sizes), minlength=len(hashes)).astype(np.uint32)
        # tokens by local frequency rank take one or two bytes each
        by_rank = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")
        rank = np.empty(len(by_rank), np.uint32)
        rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        control, data = pack_ids(rank[tokens])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([chunk], pa.int64()),
                pa.array([[i for part in ids for i in part]], pa.list_(pa.int64())),
                pa.array([held.tolist()], pa.list_(pa.bool_())),
                pa.array([sizes.tolist()], pa.list_(pa.int64())),
                *(pa.array([x], pa.binary()) for x in (control, data, planes(by_rank), hashes.tobytes(), planes(counts))),
            ],
            names=[f.split(" ")[0] for f in _CHUNKS.split(", ")],
        )

    for batch in batches:
        for first, raw, off in pieces(batch.column("text"), 1 << 20):
            h, at = words(raw, off)
            n = len(at) - 1
            stream = np.insert(h, at[1:], END)  # every text is followed by its end
            held = batch.column("held").slice(first, n).to_numpy(zero_copy_only=False)
            held_back.append((stream, np.diff(at) + 1, batch.column("doc_id").slice(first, n).to_pylist(), held))
            size += len(raw)
            if size >= CHUNK:
                yield close()
                chunk, size, held_back = chunk + 1, 0, []
    if held_back:
        yield close()


def _to_slices(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "hashes", "counts")), strict=True):
                hashes, counts = np.frombuffer(hashes, np.uint64), arr(counts, np.uint32)
                yield parcels([(0, s, chunk, hashes[a:b], counts[a:b]) for s, a, b in ranges(hashes, 64 - bits, 1 << bits)])

    return run


def ranges(keys: np.ndarray, shift: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(slice, first, last) of sorted keys by their upper bits."""
    cut = np.searchsorted(keys, np.array([s << shift for s in range(1, n)], keys.dtype))
    edges = [0, *cut.tolist(), len(keys)]
    return ((s, edges[s], edges[s + 1]) for s in range(n) if edges[s + 1] > edges[s])


def _name(bits: int, dest: int, rows: list[dict]) -> Iterator[list[tuple]]:
    """A slice numbers its words and answers every chunk with their ids and counts over all training texts."""
    hashes, which = np.unique(joined(rows, "a", np.uint64), return_inverse=True)
    if len(hashes) >= 1 << (32 - bits):
        raise ValueError("more distinct words than ids")
    counts = np.bincount(which, joined(rows, "b", np.uint32), minlength=len(hashes)).astype(np.int64)
    ids = (np.arange(len(hashes)) + (dest << (32 - bits))).astype(np.uint32)
    yield [(1, dest, dest, np.array([(counts > 0).sum(), counts.sum()], np.int64))]
    at = 0
    for r in rows:
        n = count_of(r["a"])
        mine = which[at : at + n]
        at += n
        yield [(0, r["sender"], dest, ids[mine], counts[mine])]


def _chunk_parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's tokens and, packed into one field, its documents."""
    for batch in batches:
        for row in batch.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            ids = np.array([0 if i is None else i for i in row["doc_ids"]], np.int64)
            null = np.array([i is None for i in row["doc_ids"]], bool)
            flags = np.array(row["held"], bool) + 2 * null
            docs = np.concatenate([sizes, ids.view(np.uint64).astype(np.int64), flags])
            yield parcels([(-1, row["chunk"], 0, planes(docs), row["control"], row["data"], row["by_rank"])])


class Texts:
    """A chunk with its words' ids and counts, and its distinct pairs."""

    def __init__(self, rows: list[dict]):
        body = rows[0]
        self.sizes, self.ids, flags = arr(body["a"], np.int64).reshape(3, -1)
        self.held, self.null = (flags & 1).astype(bool), (flags & 2).astype(bool)
        names = [r for r in rows if r["kind"] == 0]  # in slice order, which is the dictionary's
        self.word_ids, self.word_counts = joined(names, "a", np.uint32), joined(names, "b", np.int64)
        self.tokens = arr(body["d"], np.uint32)[unpack_ids(body["b"], body["c"], int(self.sizes.sum()))]
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        if len(before):
            before[0] = self.tokens[-1]  # an end, as at every other text's start
        # local numbers order as ids do, since both follow the hashes
        key, self.pair = np.unique(before.astype(np.uint64) << np.uint64(32) | self.tokens, return_inverse=True)
        self.u, self.w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair keys, their order by bucket, and where each bucket begins."""
        key = self.word_ids[self.u].astype(np.uint64) << np.uint64(32) | self.word_ids[self.w]
        bucket = (mix(key) % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return key, order, np.searchsorted(bucket[order], np.arange(n + 1))


def _pairs(n: int, dest: int, rows: list[dict]) -> Iterator[list[tuple]]:
    """A chunk sends each distinct pair, with its count in training texts, to the pair's bucket."""
    text = Texts(rows)
    count = np.bincount(text.pair, ~text.held[text.owner], minlength=len(text.u)).astype(np.uint32)
    key, order, edge = text.buckets(n)
    for b in range(n):
        mine = order[edge[b] : edge[b + 1]]
        if len(mine):
            yield [(0, b, dest, key[mine], count[mine])]


def word_parts(bits: int, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    return ranges(ids, 32 - bits, 1 << bits)


def sums_by_word(u: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of pairs, and their tables as context and as dish."""
    ids, which = np.unique(np.concatenate([u, w]), return_inverse=True)
    return ids, np.bincount(which[: len(u)], t, minlength=len(ids)).astype(np.int64), np.bincount(which[len(u) :], t, minlength=len(ids)).astype(np.int64)


def split_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _meet(bits: int, dest: int, rows: list[dict]) -> Iterator[list[tuple]]:
    """A bucket adds up its pairs.

    Parcels: 0, to every chunk, its pairs' class (unseen, once, more) and the place of
    the latter; 1, to itself, the pairs seen more than once; 2, to the slices, the
    tables of pairs seen once; 3, how many pairs were seen once and twice.
    """
    key, which = np.unique(joined(rows, "a", np.uint64), return_inverse=True)
    count = np.bincount(which, joined(rows, "b", np.uint32), minlength=len(key)).astype(np.int64)
    many = count > 1
    place = np.cumsum(many) - 1
    level = np.minimum(count, 2).astype(np.uint8)
    at = 0
    for r in rows:
        n = count_of(r["a"])
        mine = which[at : at + n]
        at += n
        yield [(0, r["sender"], dest, level[mine], place[mine][level[mine] == 2].astype(np.uint32))]
    yield [(1, dest, dest, key[many], count[many])]
    u, w = split_key(key[count == 1])
    ids, tu, tw = sums_by_word(u, w, np.ones(len(u)))
    yield [(2, s, dest, ids[a:b], tu[a:b], tw[a:b]) for s, a, b in word_parts(bits, ids)]
    yield [(3, 0, dest, np.array([(count == 1).sum(), (count == 2).sum()], np.int64))]


def _fix(dest: int, rows: list[dict]) -> Iterator[list[tuple]]:
    """A slice adds up the tables of pairs seen once, which never change."""
    ids, which = np.unique(joined(rows, "a", np.uint32), return_inverse=True)
    tu, tw = (np.bincount(which, joined(rows, f, np.int64), minlength=len(ids)).astype(np.int64) for f in ("b", "c"))
    yield [(2, dest, -1, ids, tu, tw)]


# ---- seating


def seat(c: np.ndarray, alpha: np.ndarray, d: float, rng: np.random.Generator, parent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First seating of c customers of each dish: flat table sizes, and tables a dish.

    Customers come in strides of a quarter of those seated, so that a dish takes a number
    of steps logarithmic in its customers.
    ``alpha`` is the weight of a new table.  With the dish's probability in the parent
    restaurant, a dish gets no more tables than one of customers without end would get:
    one, and a negative binomial number.
    """
    tables = np.ones(len(c), np.int64)
    seated = np.ones(len(c), np.int64)
    rows = np.flatnonzero(seated < c)
    while len(rows):
        stride = np.minimum(np.maximum(seated[rows] // 4, 1), c[rows] - seated[rows])
        opens = alpha[rows] / (alpha[rows] + seated[rows] - d * tables[rows])
        tables[rows] += rng.binomial(stride, np.clip(opens, 0.0, 1.0))
        seated[rows] += stride
        rows = rows[seated[rows] < c[rows]]
    if parent is not None:
        shape = alpha / parent / d + 1
        rows = np.flatnonzero(shape * parent / (1 - parent) < c)
        tables[rows] = np.minimum(tables[rows], 1 + rng.negative_binomial(shape[rows], 1 - parent[rows]))
    owner = np.repeat(np.arange(len(c)), tables)
    first = np.cumsum(tables) - tables
    # later tables have Sibuya sizes, as at customers without end, or one customer where these are too few
    sizes = np.minimum(rng.geometric(np.maximum(rng.beta(d, 1 - d, len(owner)), 1e-9)), c[owner])
    sizes[first] = 0
    later = np.bincount(owner, sizes, minlength=len(c)).astype(np.int64)
    sizes[(later >= c)[owner]] = 1
    sizes[first] = c - np.where(later >= c, tables - 1, later)
    return sizes, tables


_STIRLING: dict[float, np.ndarray] = {}


def log_stirling(d: float) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers: weights of n <= ``FEW`` customers (rows) at t tables (columns)."""
    if d not in _STIRLING:
        s = np.full((FEW + 1, FEW + 1), -np.inf)
        s[1, 1] = 0.0
        t = np.arange(1, FEW + 1)
        for n in range(1, FEW):
            s[n + 1, 1 : n + 1] = s[n, 1 : n + 1] + np.log(n - d * t[:n])
            s[n + 1, 2 : n + 2] = np.logaddexp(s[n + 1, 2 : n + 2], s[n, 1 : n + 1])
        if len(_STIRLING) > 3:
            _STIRLING.clear()
        _STIRLING[d] = s
    return _STIRLING[d]


def draw_tables(c: np.ndarray, parent: np.ndarray, outside: np.ndarray, strength: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c <= ``FEW`` customers, from their exact odds.

    ``outside``: tables of the restaurant that other dishes have; ``parent``: the dish's
    probability in the parent restaurant.
    """
    s, out = log_stirling(d), np.ones(len(c), np.int64)
    kind = np.ceil(np.log2(c)).astype(np.int64)
    for k in np.unique(kind[kind > 0]).tolist():
        rows, places = np.flatnonzero(kind == k), 1 << k
        opened = np.arange(places)
        for a in range(0, len(rows), block := max(1, (1 << 18) // places)):
            mine = rows[a : a + block]
            p = np.log((strength + d * (outside[mine][:, None] + opened)) * parent[mine][:, None])
            np.cumsum(p, axis=1, out=p)
            p += s[c[mine], 1 : places + 1]
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            np.cumsum(p, axis=1, out=p)
            out[mine] = (p <= (rng.random(len(mine)) * p[:, -1])[:, None]).sum(axis=1) + 1
    return out


def by_owner(owners: list[np.ndarray], flats: list[np.ndarray]) -> np.ndarray:
    """Flat sizes of several groups of dishes as one, by dish."""
    owner, flat = np.concatenate(owners), np.concatenate(flats)
    return flat[np.argsort(owner, kind="stable")]


def gibbs(c: np.ndarray, sizes: np.ndarray, tables: np.ndarray, parent: np.ndarray, outside: np.ndarray, strength: float, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One sweep over all dishes: returns sizes and tables anew.  ``sizes`` are flat, of the dishes of more than ``FEW`` customers."""
    tables, few = tables.copy(), np.flatnonzero(c <= FEW)
    tables[few] = draw_tables(c[few], parent[few], outside[few], strength, d, rng)
    many = np.flatnonzero(c > FEW)
    if len(many) == 0:
        return sizes, tables
    at = np.cumsum(tables[many]) - tables[many]
    times = rounds(c[many], parent[many], outside[many], strength, d)
    order = np.argsort(-times, kind="stable")
    owners, parts = [], []
    # dishes of like need share a matrix
    kind = np.ceil(np.log2(np.maximum(times, tables[many]))).astype(np.int64)
    for k in np.unique(kind).tolist():
        rows = order[kind[order] == k]
        for a in range(0, len(rows), block := max(1, (1 << 20) >> k)):
            mine = rows[a : a + block]
            dish = many[mine]
            t = tables[dish]
            grid = np.zeros((len(mine), int(t.max()) + 1), np.int64)
            owner = np.repeat(np.arange(len(mine)), t)
            column = np.arange(len(owner)) - np.repeat(np.cumsum(t) - t, t)
            grid[owner, column] = sizes[at[mine][owner] + column]
            grid = split_merge(grid, t, times[mine], parent[dish], outside[dish], strength, d, rng)
            tables[dish] = t
            owners.append(np.repeat(dish, t))
            parts.append(grid[grid > 0])
    return by_owner(owners, parts), tables


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers above 0, by Stirling's series from 8 on."""
    x = np.asarray(x, np.float64)
    y = x + 8
    low = np.log(np.multiply.reduce([x + i for i in range(8)]))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def split_odds(m: np.ndarray, d: float) -> np.ndarray:
    """Weight of all ways to seat m >= 2 customers at two tables over that of one table (generalized Stirling numbers)."""
    m = np.asarray(m, np.float64)
    rest = log_gamma(m - 2 * d) - log_gamma(m - d) + log_gamma(1 - d) - log_gamma(2 - 2 * d)
    return (1 - (1 - 2 * d) * np.exp(rest)) / d


def split_sizes(m: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """The smaller part of m >= 2 customers who sit down at two tables: a Sibuya number, given that the other part makes m."""
    out = np.ones(len(m), np.int64)
    rows = np.flatnonzero(m > 2)
    while len(rows):
        n = m[rows]
        a = rng.geometric(np.maximum(rng.beta(d, 1 - d, len(rows)), 1e-15))
        half = n - n // 2
        fits = 2 * a <= n
        b = np.where(fits, n - a, half)
        keep = np.exp(log_gamma(b - d) - log_gamma(b + 1) - log_gamma(half - d) + log_gamma(half + 1))
        done = fits & (rng.random(len(rows)) < np.where(2 * a == n, 0.5, 1.0) * keep)
        out[rows[done]] = a[done]
        rows = rows[~done]
    return out


def rounds(c: np.ndarray, parent: np.ndarray, outside: np.ndarray, strength: float, d: float) -> np.ndarray:
    """Splits and merges that a sweep tries: twice the tables to expect, whatever the seating is, and ``MOVES`` more."""
    tables, n = np.ones(len(c)), np.ones(len(c), np.int64)
    rows = np.flatnonzero(n < c)
    while len(rows):
        stride = np.minimum(np.maximum(n[rows] // 4, 1), c[rows] - n[rows])
        opens = (strength + d * (outside[rows] + tables[rows])) * parent[rows]
        tables[rows] += stride * opens / (opens + n[rows] - d * tables[rows])
        n[rows] += stride
        rows = rows[n[rows] < c[rows]]
    endless = 1 + ((strength + d * outside) / d + 1) * parent / (1 - parent)  # of customers without end
    return MOVES + 2 * np.ceil(np.minimum(tables, endless)).astype(np.int64)


def split_merge(sizes: np.ndarray, tables: np.ndarray, times: np.ndarray, parent: np.ndarray, outside: np.ndarray, strength: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """Splits a random table, or merges two, ``times`` times a dish, by Metropolis and Hastings; returns sizes, perhaps wider.

    The first ``tables`` places of a dish hold its sizes; ``times`` must not grow from dish to dish.
    """
    known = split_odds(np.arange(2, 4096), d)
    for m in range(int(times.max(initial=0))):
        k = int(np.searchsorted(-times, -m))  # dishes that have moves left
        if int(tables[:k].max()) == sizes.shape[1]:
            sizes = np.concatenate([sizes, np.zeros_like(sizes)], axis=1)
        rows, t = np.arange(k), tables[:k]
        u = rng.random((4, k))
        i = (u[0] * t).astype(np.int64)
        j = (i + 1 + (u[1] * (t - 1)).astype(np.int64)) % t
        split = u[2] < 0.5
        whole = sizes[rows, i] + np.where(split, 0, sizes[rows, j])
        able = np.where(split, whole > 1, t > 1)
        rows, i, j, t, split, whole = (x[able] for x in (rows, i, j, t, split, whole))
        odds = known[np.minimum(whole, 4095) - 2]
        big = whole > 4095
        if big.any():
            odds[big] = split_odds(whole[big], d)
        fewer = np.where(split, t, t - 1)
        odds *= (strength + d * (outside[rows] + fewer)) * parent[rows] * 2 / (fewer + 1)
        done = u[3][able] * np.where(split, 1.0, odds) < np.where(split, odds, 1.0)
        some = done & split
        if some.any():
            r = rows[some]
            part = split_sizes(whole[some], d, rng)
            sizes[r, i[some]] -= part
            sizes[r, t[some]] = part
            tables[r] += 1
        some = done & ~split
        if some.any():
            r, last = rows[some], t[some] - 1
            sizes[r, i[some]] = whole[some]
            # the last table takes the free place, unless it is the free one or the merged one
            sizes[r, j[some]] = sizes[r, last]
            sizes[r, last] = 0
            tables[r] -= 1
    return sizes


def resized(old: np.ndarray, c: np.ndarray, sizes: np.ndarray, tables: np.ndarray, alpha: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The seating of ``old`` customers of each dish after random ones left, or others came, so that there are c."""
    at = np.cumsum(tables) - tables
    out = sizes.copy()
    more = np.maximum(c - old, 0)
    fresh = rng.binomial(more, np.clip(alpha / (alpha + old - d * tables), 0.0, 1.0))
    left = np.where(c < old, old - c, more - fresh)
    rest = np.where(c < old, old.astype(np.float64), old - d * tables)
    rows, place = np.flatnonzero(left > 0), 0
    while len(rows):
        n = sizes[at[rows] + place]
        leave = c[rows] < old[rows]
        go = np.zeros(len(rows), np.int64)
        go[leave] = -rng.hypergeometric(n[leave], (rest[rows] - n)[leave].astype(np.int64), left[rows][leave])
        join = ~leave
        last = place + 1 == tables[rows]
        go[join] = np.where(last, left[rows], rng.binomial(left[rows], np.clip((n - d) / np.maximum(rest[rows], 1e-9), 0.0, 1.0)))[join]
        out[at[rows] + place] += go
        left[rows] -= np.abs(go)
        rest[rows] -= np.where(leave, n, n - d)
        place += 1
        rows = rows[(left[rows] > 0) & (place < tables[rows])]
    owner = np.repeat(np.arange(len(c)), tables)[out > 0]
    owner = np.concatenate([owner, np.repeat(np.arange(len(c)), fresh)])
    flat = np.concatenate([out[out > 0], np.ones(int(fresh.sum()), np.int64)])
    return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(c)).astype(np.int64)


class Top:
    """The word restaurant's totals: enough, with a word's customers and tables, for its probability."""

    def __init__(self, vocabulary: int, customers: int, tables: int):
        self.base = 1.0 / (vocabulary + 1)
        self.customers, self.tables = customers, tables

    def probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        fresh = (TOP_STRENGTH + TOP_DISCOUNT * self.tables) * self.base
        return (np.maximum(customers - TOP_DISCOUNT * tables, 0) + fresh) / (TOP_STRENGTH + self.customers)


def _words(bits: int, base: float, known_tables: int, step: int, dest: int, rows: list[dict]) -> Iterator[list[tuple]]:
    """A slice adds up its words' tables over all contexts, seats them in the word restaurant, and answers the buckets.

    Parcels: 0, to every bucket, (customers, tables, tables as a context) of its words;
    1, to itself, the same of all its words; 2, its totals; 3, to itself, the seating,
    which the next step goes on from.
    """
    before = [r for r in rows if r["kind"] == 3]
    rows = [r for r in rows if r["kind"] != 3]
    ids, which = np.unique(joined(rows, "a", np.uint32), return_inverse=True)
    tu, customers = (np.bincount(which, joined(rows, f, np.int64), minlength=len(ids)).astype(np.int64) for f in ("b", "c"))
    rng = np.random.default_rng([step, dest])
    tables = np.zeros(len(ids), np.int64)
    some = np.flatnonzero(customers > 0)
    if len(some):
        c = customers[some]
        parent = np.full(len(c), base)
        alpha = (TOP_STRENGTH + TOP_DISCOUNT * known_tables) * parent
        t, many, go_on = np.ones(len(c), np.int64), c > FEW, np.zeros(len(c), bool)
        owners, flats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if before:  # of the same words, since a pair never loses its last table
            old, sizes, t = (arr(before[0][f], np.int64) for f in ("a", "b", "c"))
            go_on = many & (old > FEW)
            sizes = sizes[np.repeat(go_on[old > FEW], t[old > FEW])]
            flat, t[go_on] = resized(old[go_on], c[go_on], sizes, t[go_on], alpha[go_on], TOP_DISCOUNT, rng)
            owners.append(np.repeat(np.flatnonzero(go_on), t[go_on]))
            flats.append(flat)
        fresh = many & ~go_on
        flat, t[fresh] = seat(c[fresh], alpha[fresh], TOP_DISCOUNT, rng, parent[fresh])
        sizes = by_owner([*owners, np.repeat(np.flatnonzero(fresh), t[fresh])], [*flats, flat])
        t = np.minimum(t, c)
        sizes, t = gibbs(c, sizes, t, parent, np.maximum(known_tables - t, 0).astype(np.float64), TOP_STRENGTH, TOP_DISCOUNT, rng)
        tables[some] = t
        yield [(3, dest, -2, c, sizes, t)]
    at = 0
    for r in rows:
        n = count_of(r["a"])
        mine = which[at : at + n]
        at += n
        if r["sender"] >= 0:
            yield [(0, r["sender"], dest, customers[mine], tables[mine], tu[mine])]
    yield [(1, dest, -1, ids, customers, tables, tu)]
    yield [(2, 0, dest, np.array([customers.sum(), tables.sum()], np.int64))]


def _state_sums(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key, count = arr(row["a"], np.uint64), arr(row["b"], np.int64)
                t = arr(row["d"], np.int64) if row["d"] is not None else np.ones(len(count), np.int64)
                ids, tu, tw = sums_by_word(*split_key(key), t)
                yield parcels([(1, s, row["dest"], ids[a:b], tu[a:b], tw[a:b]) for s, a, b in word_parts(bits, ids)])

    return run


def _sweep_bucket(top: Top, d: float, step: int, dest: int, rows: list[dict]) -> Iterator[list[tuple]]:
    """A bucket seats the customers of its pairs again, given the sums by word."""
    state = [r for r in rows if r["kind"] == 1][0]
    answers = [r for r in rows if r["kind"] == 2]  # in slice order, as the words are
    key, c = arr(state["a"], np.uint64), arr(state["b"], np.int64)
    u, w = split_key(key)
    ids = np.unique(np.concatenate([u, w]))
    customers, tables, tu = (joined(answers, f, np.int64) for f in ("a", "b", "c"))
    rng = np.random.default_rng([step, dest, 1])
    iu, iw = np.searchsorted(ids, u), np.searchsorted(ids, w)
    parent = top.probability(customers[iw], tables[iw])
    if state["d"] is None:
        old, many = np.ones(len(c), np.int64), c > FEW
        t = old.copy()
        sizes, t[many] = seat(c[many], (STRENGTH + d * tu[iu[many]]) * parent[many], d, rng, parent[many])
    else:
        sizes, t = arr(state["c"], np.int64), arr(state["d"], np.int64)
        old = t
    outside = np.maximum(tu[iu] - old, 0).astype(np.float64)
    sizes, t = gibbs(c, sizes, t, parent, outside, STRENGTH, d, rng)
    yield [(1, dest, dest, key, c, sizes, t)]


def _pair_answers(samples: int, dest: int, rows: list[dict]) -> Iterator[list[tuple]]:
    """A bucket answers chunks with the counts and sampled tables of their pairs seen more than once."""
    states = [r for r in rows if r["kind"] < samples]
    count = arr(states[0]["b"], np.int64)
    tables = np.stack([arr(r["d"], np.int64) for r in states])
    for r in rows:
        if r["kind"] == 99:
            mine = arr(r["b"], np.uint32)
            yield [(2, r["sender"], dest, count[mine], tables[:, mine].astype(np.uint32))]


def _word_answers(samples: int, dest: int, rows: list[dict]) -> Iterator[list[tuple]]:
    """A slice answers chunks with their words' customers and tables in every sample."""
    states = [r for r in rows if r["kind"] < samples]
    ids = arr(states[0]["a"], np.uint32) if states else np.zeros(0, np.uint32)
    values = np.stack([np.stack([arr(r[f], np.int64) for f in ("b", "c", "d")]) for r in states]) if states else np.zeros((samples, 3, 0), np.int64)
    for r in rows:
        if r["kind"] == 99:
            asked = arr(r["a"], np.uint32)
            at = np.searchsorted(ids, asked)
            at[at == len(ids)] = 0
            seen = ids[at] == asked if len(ids) else np.zeros(len(asked), bool)
            found = np.where(seen, values[:, :, at], 0) if len(ids) else np.zeros((samples, 3, len(asked)), np.int64)
            yield [(3, r["sender"], dest, found)]


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(n: int, vocabulary: int, total: int, tops: list[Top], d: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in delivered(batches):
            text = Texts(rows)
            kinds = {k: [r for r in rows if r["kind"] == k] for k in (1, 2, 3)}
            values = np.concatenate([arr(r["a"], np.int64).reshape(len(tops), 3, -1) for r in kinds[3]], axis=2)
            key, order, edge = text.buckets(n)
            level = np.zeros(len(key), np.uint8)
            count = np.zeros(len(key), np.int64)
            tables = np.zeros((len(tops), len(key)), np.int64)
            for r in kinds[1]:
                level[order[edge[r["sender"]] : edge[r["sender"] + 1]]] = arr(r["a"], np.uint8)
            count[:] = level
            tables[:] = level > 0
            for r in kinds[2]:
                mine = order[edge[r["sender"]] : edge[r["sender"] + 1]]
                mine = mine[level[mine] == 2]
                count[mine] = arr(r["a"], np.int64)
                tables[:, mine] = arr(r["b"], np.uint32).reshape(len(tops), -1)
            context = text.word_counts[text.u].astype(np.float64)  # a word is followed as often as it occurs
            p = np.zeros(len(key))
            for s, top in enumerate(tops):
                parent = top.probability(values[s, 0], values[s, 1])[text.w]
                own = np.maximum(count - d * tables[s], 0) + (STRENGTH + d * values[s, 2][text.u]) * parent
                p += np.where(context > 0, own / (STRENGTH + context), parent)
            logp = np.log10(p / len(tops))
            c = text.word_counts
            base = np.log10((c + 0.1) / (total + 0.1 * (vocabulary + 1)))
            docs = len(text.sizes)
            add = partial(np.bincount, text.owner, minlength=docs)
            columns = [
                pa.array(text.ids, pa.int64(), mask=text.null), pa.array(text.held), pa.array(text.sizes),
                pa.array(add(weights=(c > 0)[text.tokens]).astype(np.int64)), pa.array(np.full(docs, total, np.int64)),
                pa.array(add(weights=base[text.tokens])), pa.array(add(weights=logp[text.pair])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in _SCORES.split(", ")])

    return run


def score(docs: DataFrame, held_out: F.Column, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """Scores every row of docs(doc_id, text) by a model of those for which ``held_out`` is not true.

    Words are runs outside ASCII white space, A-Z folded; each text has one more token,
    its end.  A null text is empty.  Columns: doc_id, held_out, n_tokens, n_known (tokens
    seen in training), train_tokens, base_score (smoothed single words, log10), score
    (the model's log10 probability).  Perplexity is 10 ** (-score / n_tokens).  Repeated
    rows are scored, and learned, each.  With no training text every probability is 1;
    an empty table gives no rows.  Very long texts are scored whole;
    other columns are ignored.

    Buckets, and slices of words, are drawn beside one another, each against the sums of
    the step before, so that this is parallel Gibbs sampling: the seating within a bucket
    follows its odds exactly, what other buckets do comes to it one step late.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lm")
    parts = shuffle_partitions(spark)
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = work.put(rows.mapInArrow(trimmed(_chunk), _CHUNKS), "chunks")
    entries, tokens = chunks.agg(F.sum(F.octet_length("hashes") / 8), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    if not entries:
        return spark.createDataFrame([], _SCORES)
    # slices and buckets follow the corpus alone, so that each stays within a task's memory and parcels are no more than need be
    bits = int(np.ceil(np.log2(max(2.0, entries / SLICE))))
    buckets = max(2, -(-int(tokens) // BUCKET))

    def put(df: DataFrame, name: str) -> DataFrame:
        # a file a kind, all open at once: else each task sorts its parcels again, only for their kind
        before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0")
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "8")
        try:
            df.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(work.path(name))
        finally:
            spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", before)
        return spark.read.schema(PARCEL).parquet(work.path(name))

    def of_kind(df: DataFrame, kind: int, as_kind: int | None = None) -> DataFrame:
        some = df.where(F.col("kind") == kind)
        return some if as_kind is None else some.withColumn("kind", F.lit(as_kind))

    asked = chunks.select("chunk", "hashes", "counts").mapInArrow(trimmed(_to_slices(bits)), PARCEL)
    names = put(deliver(asked, parts, partial(_name, bits)), "names")
    vocabulary, total = np.sum([arr(r["a"], np.int64) for r in of_kind(names, 1).select("a").collect()], axis=0).tolist()  # a row a slice
    names = of_kind(names, 0)
    chunks = chunks.drop("hashes", "counts")
    texts = chunks.mapInArrow(trimmed(_chunk_parcels), PARCEL).select(*_NAMES).union(names.select(*_NAMES))

    sent = deliver(texts, parts, partial(_pairs, buckets))
    met = put(deliver(sent, parts, partial(_meet, bits)), "met")
    once, twice = np.sum([arr(r["a"], np.int64) for r in of_kind(met, 3).select("a").collect()], axis=0).tolist()  # a row a bucket
    discount = float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.95))
    fixed = put(deliver(of_kind(met, 2), parts, _fix), "fixed")
    work.drop("met/kind=2")
    work.tidy()
    state = of_kind(met, 1)

    known_tables, kept_words, kept_pairs, tops = vocabulary, [], [], []
    for step in range(burn_in + samples + 1):
        sums = state.mapInArrow(trimmed(_state_sums(bits)), PARCEL)
        sums = sums.select(*_NAMES).union(fixed.select(*_NAMES))
        if step:
            sums = sums.union(of_kind(moved, 3).select(*_NAMES))
        moved = put(deliver(sums, parts, partial(_words, bits, 1.0 / (vocabulary + 1), known_tables, step)), f"words{step}")
        if step:
            work.drop(f"words{step - 1}" if step - 1 <= burn_in else f"words{step - 1}/kind=3")
        customers, known_tables = np.sum([arr(r["a"], np.int64) for r in of_kind(moved, 2).select("a").collect()] or [[0, 0]], axis=0).tolist()  # a row a slice
        top = Top(vocabulary, customers, known_tables)
        if step > burn_in:
            kept_words.append(of_kind(moved, 1))
            kept_pairs.append(state)
            tops.append(top)
        if step == burn_in + samples:
            break
        done = f"state{step}" if step <= burn_in and step else None
        state = put(deliver(state.select(*_NAMES).union(of_kind(moved, 0, 2).select(*_NAMES)), parts, partial(_sweep_bucket, top, discount, step)), f"state{step + 1}")
        if done:  # not a sample
            work.drop(done)
        work.tidy()

    def with_samples(kept: list[DataFrame], questions: DataFrame) -> DataFrame:
        out = questions.withColumn("kind", F.lit(99)).select(*_NAMES)
        for k, df in enumerate(kept):
            out = out.union(df.withColumn("kind", F.lit(k)).select(*_NAMES))
        return out

    # chunks' questions, turned around: from chunk to bucket or slice
    of_pairs = of_kind(met, 0).select("kind", F.col("sender").alias("dest"), F.col("dest").alias("sender"), F.lit(None).cast("binary").alias("a"), "b", "c", "d")
    of_words = names.select("kind", F.col("sender").alias("dest"), F.col("dest").alias("sender"), "a", F.lit(None).cast("binary").alias("b"), "c", "d")
    pair_answers = put(deliver(with_samples(kept_pairs, of_pairs), parts, partial(_pair_answers, samples)), "pair_answers")
    word_answers = put(deliver(with_samples(kept_words, of_words), parts, partial(_word_answers, samples)), "word_answers")
    work.drop("fixed")
    work.tidy()
    levels = of_kind(met, 0, 1).withColumn("b", F.lit(None).cast("binary"))
    everything = texts
    for df in (levels, pair_answers, word_answers):
        everything = everything.union(df.select(*_NAMES))
    return dealt(everything, parts).mapInArrow(trimmed(_score(buckets, vocabulary, total, tops, discount)), _SCORES)
