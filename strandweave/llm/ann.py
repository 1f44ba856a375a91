"""Nearest neighbours by inner product: inverted lists scanned by adaptive dimensions.

Vectors are dealt to bands by norm, so that one of huge norm does not blunt the tests of
the others.  Within a band of largest norm R, x/R gets one more component that makes its
length 1, and a query is scaled to length 1: then distance * distance = 2 - 2 * score / (R * |query|).
Vectors are rotated by a random orthogonal matrix, dealt to the lists of the nearest
centroid of their band, and stored in chunks, transposed in column blocks.  Lists grow in
number with the square root of the vectors.

Chunks stand on shelves.  A query goes once to each shelf that holds a list it probes, and
scans these one after another, keeping its k best.  Blocks of columns are added for all
candidates of a chunk at once; after each block a hypothesis test on the partial distance,
scaled up to all dimensions, abandons those that can hardly come below the k-th best.
Survivors are scored exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import Workspace, shuffle_partitions, trimmed

#: Vectors the lists are fitted on, at most, but two a list; all vectors are indexed.
SAMPLE = 32_768
#: Vectors of a chunk, chunks of a shelf at most, queries held at a shelf at once, queries of a block, columns of a block.
CHUNK, SHELF, HELD, QUERIES, COLUMNS = 1024, 64, 16_384, 256, 16
#: Lists that are put in order, and chunks that are pointed at, at once.
RANKED = 1 << 22
#: Pairs of query and candidate that are worth a shelf of their own, while there are idle partitions.
PAIRS = 4_000_000
#: Standard deviations the test allows for; larger is surer and slower.
EPSILON = 2.1
#: Share of candidates below which they are looked at one by one.
SPARSE = 0.08


def rotation(dims: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 4) -> np.ndarray:
    """Centres of x; many are found in two levels, those of one coarse cell in a row."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    if k > 512:
        coarse = k_means(x, int(k**0.5), rounds, seed)
        home = nearest(x, coarse, 1)[:, 0]
        parts = [x[home == c] for c in range(len(coarse))]
        return np.concatenate([k_means(p, max(1, round(k * len(p) / len(x))), rounds, seed + 1) for p in parts if len(p)])
    centres = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        found, first, n = np.unique(near[order], return_index=True, return_counts=True)
        centres[found] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    out = []
    half = (centres * centres).sum(axis=1) / 2
    step = max(1, (1 << 24) // max(1, len(centres)))
    for a in range(0, len(x), step):
        d = half - x[a : a + step] @ centres.T
        out.append(d.argmin(axis=1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def lifted(x: np.ndarray, radius: float) -> np.ndarray:
    """x / radius, with one more component that makes its length 1."""
    y = x.astype(np.float64) / radius
    rest = np.sqrt(np.maximum(1 - (y * y).sum(axis=1), 0))
    return np.concatenate([y, rest[:, None]], axis=1).astype(np.float32)


def lengths(x: np.ndarray) -> np.ndarray:
    """Norms, also of components whose squares no double can hold."""
    x = np.abs(x.astype(np.float64))
    most = np.maximum(x.max(axis=1), np.finfo(np.float64).tiny)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1))


@dataclass
class Lists:
    """The index without its vectors: what tasks need to deal vectors and to aim queries."""

    dims: int
    kind: str  # of the original components
    turn: np.ndarray
    radius: dict[int, float]  # by band
    of_band: dict[int, np.ndarray]  # a band's lists
    centres: np.ndarray
    by_list: np.ndarray  # a list's radius

    def matrix(self, column: pa.Array | list[bytes]) -> np.ndarray:
        bodies = column if isinstance(column, list) else column.to_pylist()
        return np.frombuffer(b"".join(bodies), self.kind).reshape(-1, self.dims)

    def turned(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries scaled to length 1 and rotated, and their lengths."""
        q, length = q.astype(np.float64), lengths(q)
        return (q / length[:, None]).astype(np.float32) @ self.turn[: self.dims], length

    def order(self, turned: np.ndarray) -> np.ndarray:
        """All lists by the inner product to expect there, largest first."""
        half = (self.centres * self.centres).sum(axis=1) / 2
        hope = self.by_list.astype(np.float32) * (0.5 - half + turned @ self.centres.T)
        return np.argsort(-hope, axis=1, kind="stable")

    def home(self, x: np.ndarray, band: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for b in np.unique(band).tolist():
            rows, lists = np.flatnonzero(band == b), self.of_band[b]
            out[rows] = lists[nearest(lifted(x[rows], self.radius[b]) @ self.turn, self.centres[lists], 1)[:, 0]]
        return out


def fit(x: np.ndarray, band: np.ndarray, counts: dict[int, int], radius: dict[int, float], dims: int, kind: str, lists: int) -> Lists:
    """Lists for every band, as many as its share of all vectors; a band that the sample missed has one."""
    turn, n = rotation(dims + 1), sum(counts.values())
    centres, of_band, by_list, at = [], {}, [], 0
    for b in sorted(counts, reverse=True):
        mine = x[band == b]
        some = lifted(mine, radius[b]) @ turn if len(mine) else turn[-1:]
        k = max(1, min(round(lists * counts[b] / n), len(some) // 2))
        found = k_means(some, k)
        centres.append(found)
        of_band[b] = np.arange(at, at + len(found))
        by_list += [radius[b]] * len(found)
        at += len(found)
    return Lists(dims, kind, turn, radius, of_band, np.concatenate(centres).astype(np.float32), np.array(by_list))


def choose_probes(lists: Lists, x: np.ndarray, band: np.ndarray, q: np.ndarray, k: int, recall: float) -> int:
    """Fewest lists to probe that find ``recall`` of the sample's own k nearest, by brute force over the sample."""
    home, ranks = lists.home(x, band), []
    turned, _ = lists.turned(q)
    every = x.astype(np.float64)
    for row, order in zip(q.astype(np.float64), lists.order(turned), strict=True):
        d = -(every @ row)
        d[(x == row).all(axis=1)] = np.inf  # the query itself
        near = np.argpartition(d, min(k, len(x)) - 1)[:k]
        near = near[np.isfinite(d[near])]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ranks.append(place[home[near]])
    ranks = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, np.int64)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1


def _usable(kind: str):
    """Rows (id, v) whose vector is neither null nor zero, all components there and finite: id, body, dims, norm, band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat = v.flatten()  # components of vectors that are there
            x = flat.to_numpy(zero_copy_only=False).astype(kind, copy=False)
            n = np.where(v.is_valid().to_numpy(zero_copy_only=False), v.value_lengths().fill_null(0).to_numpy(), 0)
            at = np.concatenate([[0], np.cumsum(n)])
            missing = np.concatenate([[0], np.cumsum(~np.isfinite(x) | flat.is_null().to_numpy(zero_copy_only=False))])
            rows = np.flatnonzero((missing[at[1:]] == missing[at[:-1]]) & (n > 0) & batch.column("id").is_valid().to_numpy(zero_copy_only=False))
            norm, body = np.zeros(len(rows)), []
            for d in np.unique(n[rows]).tolist():
                some = np.flatnonzero(n[rows] == d)
                norm[some] = lengths(x[at[rows[some]][:, None] + np.arange(d)])
            rows, norm = rows[norm > 0], norm[norm > 0]
            body = [x[at[i] : at[i + 1]].tobytes() for i in rows.tolist()]
            band = np.floor(np.log2(norm) + 0.5).astype(np.int32)
            cells = [batch.column("id").take(pa.array(rows)), pa.array(body, pa.binary()), pa.array(n[rows].astype(np.int32)), pa.array(norm), pa.array(band)]
            yield pa.RecordBatch.from_arrays(cells, names=["id", "body", "dims", "norm", "band"])

    return run


def _deal(lists: Lists):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = lists.home(lists.matrix(batch.column("body")), batch.column("band").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), batch.column("id"), batch.column("body")], names=["list", "id", "body"])

    return run


def _chunks(lists: Lists, first: np.ndarray):
    """Chunks of rows that come sorted by (list, salt, id, body): number, ids, original vectors, rotated ones transposed.

    Rows of one id and one vector lie side by side, and only the first is kept.
    """

    def close(key: tuple, rows: list) -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows], np.int64)
        x = lists.matrix([r[1] for r in rows])
        columns = np.ascontiguousarray((lifted(x, float(lists.by_list[key[0]])) @ lists.turn).T)
        cells = [pa.array([int(first[key[0]]) + key[1]], pa.int64()), pa.array([key[0]], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, x, columns))]
        return pa.RecordBatch.from_arrays(cells, names=["chunk", "list", "ids", "original", "columns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for *k, i, body in zip(*(batch.column(c).to_pylist() for c in ("list", "salt", "id", "body")), strict=True):
                if rows and k != key:
                    yield close(key, rows)
                    rows = []
                key = k
                if not rows or rows[-1] != (i, body):
                    rows.append((i, body))
        if rows:
            yield close(key, rows)

    return run


def _aim(lists: Lists, size: np.ndarray, first: np.ndarray, shelf: int, probes: int, enough: int):
    """A query's row for each shelf that holds lists it probes, with a bit for each of the shelf's chunks.

    Only the probed lists' ranges of chunks are written out, so that the work goes with
    what is probed and not with all chunks of the index.
    """
    pieces, shelves = np.diff(first), -(-int(first[-1]) // shelf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = lists.matrix(batch.column("body")), batch.column("id")
            for a in range(0, len(x), step := max(1, RANKED // len(size))):
                part = x[a : a + step]
                order = lists.order(lists.turned(part)[0])
                held = np.cumsum(size[order], axis=1)
                n = np.maximum(probes, (held < enough).sum(axis=1) + 1)
                owner, rank = np.nonzero(np.arange(order.shape[1]) < n[:, None])
                probed = order[owner, rank]
                asked = np.bincount(owner, pieces[probed], minlength=len(part)).astype(np.int64)
                body = [r.tobytes() for r in part]
                for some in np.split(np.arange(len(part)), np.flatnonzero(np.diff(np.cumsum(asked) // RANKED)) + 1):
                    mine = slice(*np.searchsorted(owner, [some[0], some[-1] + 1]))
                    count = pieces[probed[mine]]
                    chunk = np.repeat(first[:-1][probed[mine]] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    key, row = np.unique(np.repeat(owner[mine], count) * shelves + chunk // shelf, return_inverse=True)
                    query, place = key // shelves, key % shelves
                    bits = np.zeros((len(key), shelf), bool)
                    bits[row, chunk % shelf] = True
                    cells = [
                        pa.array(place), ids.take(pa.array(query + a)),
                        pa.array([body[i] for i in query.tolist()], pa.binary()), pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(cells, names=["shelf", "id", "body", "bits"])

    return run


def scan(q: np.ndarray, columns: np.ndarray, most: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance * distance) that the tests leave, for queries (rows) and candidates (columns: dims x n).

    ``most``: what each query's squared distances must not exceed.
    """
    dims = len(columns)
    part, left, done = None, None, 0
    row = at = None
    while done < dims:
        to = min(done + COLUMNS, dims)
        x, v = columns[done:to], q[:, done:to]
        if row is None:
            step = (v * v).sum(axis=1)[:, None] + (x * x).sum(axis=0) - 2 * (v @ x)
            part = step if part is None else part + step
            limit = most if to == dims else most * ((1 + epsilon / np.sqrt(to)) ** 2 * to / dims)
            keep = part <= (limit + 1e-5)[:, None]
            left = keep if left is None else left & keep
            if to == dims or left.mean() < SPARSE:
                row, at = np.nonzero(left)
                part = part[row, at]
        else:
            part = part + ((x[:, at] - v.T[:, row]) ** 2).sum(axis=0)
            limit = most if to == dims else most * ((1 + epsilon / np.sqrt(to)) ** 2 * to / dims)
            keep = part <= (limit + 1e-5)[row]
            row, at, part = row[keep], at[keep], part[keep]
        done = to
    return row, at, part


class Best:
    """The k best of each query so far: scores and ids, best first; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        some = np.unique(query)
        at = np.concatenate([np.repeat(some, k), query])
        score, ids = np.concatenate([self.score[some].reshape(-1), score]), np.concatenate([self.id[some].reshape(-1), ids])
        order = np.lexsort((ids, -score, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, some)[np.searchsorted(some, at)]
        order, rank, at = order[rank < k], rank[rank < k], at[rank < k]
        self.score[at, rank], self.id[at, rank] = score[order], ids[order]


def _search(lists: Lists, k: int):
    """The k best of a shelf for each of its queries, from rows sorted by (place, chunk), queries first."""

    def answers(ids: np.ndarray, best: Best) -> pa.RecordBatch:
        row, rank = np.nonzero(best.score > -np.inf)
        cells = [pa.array(ids[row]), pa.array(best.id[row, rank]), pa.array(best.score[row, rank])]
        return pa.RecordBatch.from_arrays(cells, names=["query_id", "vec_id", "score"])

    def visit(asked: dict, chunk: dict, best: Best) -> None:
        bit = chunk["bit"]
        rows = np.flatnonzero(asked["bits"][:, bit >> 3] >> (7 - (bit & 7)) & 1)
        ids = np.frombuffer(chunk["ids"], np.int64)
        x = np.frombuffer(chunk["original"], lists.kind).reshape(-1, lists.dims)
        columns = np.frombuffer(chunk["columns"], np.float32).reshape(lists.dims + 1, -1)
        radius = float(lists.by_list[chunk["list"]])
        for a in range(0, len(rows), QUERIES):
            mine = rows[a : a + QUERIES]
            reach = asked["length"][mine] * radius
            most = np.minimum(2 - 2 * best.score[mine, -1] / reach, 5.0)  # all distances are at most 4
            row, at, near = scan(asked["turned"][mine], columns, most.astype(np.float32))
            own = ids[at] == asked["ids"][mine][row]
            row, at, near = row[~own], at[~own], near[~own]
            if len(ids) > 2 * k and len(row) > 4 * k * len(mine):  # many are left: only the k nearest, and what rounding may hide, are scored
                order = np.lexsort((near, row))
                row, at, near = row[order], at[order], near[order]
                first = np.searchsorted(row, np.arange(len(mine) + 1))
                kth = np.minimum(first[:-1] + k, first[1:]) - 1
                cut = np.where(first[1:] > first[:-1], near[np.maximum(kth, 0)], 0) + 2e-5
                keep = near <= cut[row]
                row, at = row[keep], at[keep]
            for b in range(0, len(row), 1 << 16):
                r, c = row[b : b + (1 << 16)], at[b : b + (1 << 16)]
                score = (x[c].astype(np.float64) * asked["original"][mine[r]].astype(np.float64)).sum(axis=1)
                best.add(mine[r], score, ids[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, waiting, asked, best = None, [], None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["place"] != place:
                    if asked:
                        yield answers(asked["ids"], best)
                    place, waiting, asked = row["place"], [], None
                if row["chunk"] is None:
                    # a repeated query asks once, in all lists that a copy probes: rounding may choose a list more for one of them
                    if waiting and waiting[-1][:2] == (row["id"], row["body"]):
                        bits = np.frombuffer(waiting.pop()[2], np.uint8) | np.frombuffer(row["bits"], np.uint8)
                        waiting.append((row["id"], row["body"], bits.tobytes()))
                    else:
                        waiting.append((row["id"], row["body"], row["bits"]))
                    continue
                if not asked and waiting:
                    original = lists.matrix([w[1] for w in waiting])
                    turned, length = lists.turned(original)
                    bits = np.frombuffer(b"".join(w[2] for w in waiting), np.uint8).reshape(len(waiting), -1)
                    asked = {"ids": np.array([w[0] for w in waiting], np.int64), "original": original, "turned": turned, "length": length, "bits": bits}
                    best, waiting = Best(len(bits), k), []
                if asked:
                    visit(asked, row, best)
        if asked:
            yield answers(asked["ids"], best)

    return run


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of vectors(vec_id, embedding), itself (the same vec_id) left out.

    The measure is the inner product in double precision on the original vectors; ties go
    to the smaller vec_id.  Rows with a null vec_id take no part, nor do null, zero or
    non-finite vectors, nor those whose length is not the most frequent one.  Rows of one
    vec_id and one vector count once; a query id with several vectors asks for all of them.
    The number of lists to probe is the least that reaches ``recall`` on the sample the
    lists are fitted on, against brute force; more are probed until they hold enough
    vectors, so that a query only has fewer than k neighbours if there are no more.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "ann")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    both = {df.schema["embedding"].dataType.simpleString() for df in (vectors, queries)}
    kind = "float" if both == {"array<float>"} else "double"
    code = "f4" if kind == "float" else "f8"
    parts = shuffle_partitions(spark)

    def ready(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
        return work.put(rows.mapInArrow(trimmed(_usable(code)), "id long, body binary, dims int, norm double, band int"), name)

    rows, asked = ready(vectors, "vectors"), ready(queries, "queries")
    shapes = rows.groupBy("dims", "band").agg(F.count("*").alias("n"), F.max("norm").alias("radius")).collect()  # a row a band
    if not shapes:
        return empty
    sizes: dict[int, int] = {}
    for r in shapes:
        sizes[r["dims"]] = sizes.get(r["dims"], 0) + r["n"]
    dims, n = max(sizes.items(), key=lambda e: (e[1], -e[0]))
    counts = {r["band"]: r["n"] for r in shapes if r["dims"] == dims}
    radius = {r["band"]: r["radius"] * (1 + 1e-12) for r in shapes if r["dims"] == dims}
    rows, asked = rows.where(F.col("dims") == dims), asked.where(F.col("dims") == dims)

    number = max(1, int(n**0.5))
    wanted = max(SAMPLE, 2 * number)
    draw = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < min(1.0, wanted / n)).select("id", "body", "band").limit(2 * wanted).toArrow().sort_by([("id", "ascending")])
    x = np.frombuffer(b"".join(sample["body"].to_pylist()), code).reshape(-1, dims)
    band = sample["band"].to_numpy()
    lists = fit(x, band, counts, radius, dims, code, max(1, min(number, len(x) // 8 if n <= SAMPLE else number)))
    tried = x[np.linspace(0, len(x) - 1, min(256, len(x))).astype(int)] if len(x) else x
    probes = choose_probes(lists, x, band, tried, k, recall)

    dealt = work.put(rows.select("id", "body", "band").mapInArrow(trimmed(_deal(lists)), "list int, id long, body binary"), "dealt")
    listed = work.put(dealt.groupBy("list").agg(F.count("*").alias("n")), "listed")  # one row a list
    size, held = np.zeros(len(lists.centres), np.int64), listed.toArrow()
    size[held["list"].to_numpy()] = held["n"].to_numpy()
    first = np.concatenate([[0], np.cumsum(-(-size // CHUNK))])
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK).cast("long")).cast("int")
    salted = dealt.join(F.broadcast(listed), "list").select("list", "id", "body", salt.alias("salt")).repartition(parts, "list", "salt").sortWithinPartitions("list", "salt", "id", "body")
    chunks = work.put(salted.mapInArrow(trimmed(_chunks(lists, first)), "chunk long, list int, ids binary, original binary, columns binary"), "chunks")
    work.drop("dealt", "vectors")

    total = int(first[-1])
    pairs = asked.count() * n * min(1.0, probes / len(size))
    shelf = min(SHELF, -(-total // max(1, min(parts, int(pairs // PAIRS)))))
    aimed = work.put(asked.select("id", "body").mapInArrow(trimmed(_aim(lists, size, first, shelf, probes, k + 1)), "shelf long, id long, body binary, bits binary"), "aimed")
    busy = {r["shelf"]: r["count"] for r in aimed.groupBy("shelf").count().collect()}  # one row a shelf
    if not busy:
        return empty
    # a shelf that many queries visit stands several times, each for some of them
    begin, places = {}, 0
    for s in sorted(busy):
        begin[s], places = places, places + -(-busy[s] // HELD)
    copies = spark.createDataFrame([(s, begin[s], -(-busy[s] // HELD)) for s in sorted(busy)], "shelf long, begin long, copies long")
    come = aimed.join(F.broadcast(copies), "shelf").select(
        (F.col("begin") + F.pmod(F.xxhash64("id"), "copies")).alias("place"), F.lit(None).cast("long").alias("chunk"), "id", "body", "bits",
        F.lit(None).cast("int").alias("list"), F.lit(None).cast("int").alias("bit"), *(F.lit(None).cast("binary").alias(c) for c in ("ids", "original", "columns")),
    )
    stand = chunks.withColumn("shelf", F.floor(F.col("chunk") / shelf).cast("long")).join(F.broadcast(copies), "shelf").select(
        F.explode(F.sequence("begin", F.col("begin") + F.col("copies") - 1)).alias("place"), "chunk", F.lit(None).cast("long").alias("id"),
        F.lit(None).cast("binary").alias("body"), F.lit(None).cast("binary").alias("bits"), "list", (F.col("chunk") % shelf).cast("int").alias("bit"), "ids", "original", "columns",
    )
    met = come.union(stand).repartitionById(places, F.col("place").cast("int")).sortWithinPartitions("place", F.asc_nulls_first("chunk"), "id", "body")
    near = met.mapInArrow(trimmed(_search(lists, k)), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
