"""List ranking over pointers of oriented nodes.

A pointer (node_id, dir, to_id, to_dir, rank, done, low) says that going back ``rank``
nodes from (node_id, dir) leads to (to_id, to_dir), which is a head if ``done``; ``low`` is
the smallest id on the way.  Three steps, so that little is left for joins over all nodes:

* pointers are dealt so that neighbours mostly meet, and each task contracts the runs it
  sees: they then lead to the run's first node;
* only those first nodes are ranked further, by pointer doubling on joins, as long as
  they are many; once they are few, by a count, one task finishes;
* every other pointer takes one last jump.

What then has no head is a ring.  Runs of K-mers that fit a long (runs.py) are pointers (at,
to, rank, done, low) of numbers instead: an oriented run is its first K-mer as it is read,
and what goes back over a run goes back over all its K-mers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import canonical, flip, oriented
from ..storage import Workspace, ship, shuffle_partitions

POINTERS = "node_id string, dir string, to_id string, to_dir string, rank long, done boolean, low string"
CODED = "at long, to long, rank long, done boolean, low long"
#: Open pointers that one task finishes: some 100 bytes each.
FEW = 500_000
#: Pointers that a task contracts at once.
HELD = 200_000
#: Bases of the pieces whose smallest hash says where a link is dealt.
MINIMIZER = 8


def _columns(names: list[str]) -> tuple[list[str], list[str], str]:
    """The columns that say where a pointer is, and where it leads, and the schema."""
    return (["at"], ["to"], CODED) if "at" in names else (["node_id", "dir"], ["to_id", "to_dir"], POINTERS)


def _names(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.split(", ")]


def _jumped(table: pa.Table) -> pa.Table:
    """All jumps over pointers in the table; a ring's pointers stay, but know its smallest node."""
    n = table.num_rows
    own, ahead, schema = _columns(table.column_names)
    key, to = (table[names[0]] if len(names) == 1 else pc.binary_join_element_wise(*map(table.column, names), "") for names in (own, ahead))
    done = table["done"].to_numpy()
    target = pc.index_in(to, value_set=key.combine_chunks()).to_numpy(zero_copy_only=False)
    here = np.arange(n)
    at = np.where(np.isnan(target.astype(np.float64)) | done, here, np.nan_to_num(target.astype(np.float64), nan=0)).astype(np.int64)
    root = at == here  # heads, and pointers that leave the table: a ring reaches none, though its jumps may lead back to where they began
    rank, names = table["rank"].to_numpy(), pc.unique(table["low"])
    names = names.take(pc.sort_indices(names))
    low = pc.index_in(table["low"], value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    way, least = rank.copy(), low.copy()
    for _ in range(max(1, int(n).bit_length()) + 1):
        more = ~root[at]
        if not more.any():
            break
        way = np.where(more, way + way[at], way)
        least = np.where(more, np.minimum(least, least[at]), least)
        at = np.where(more, at[at], at)
    ring = ~root[at]
    end = np.where(ring, here, at)
    moved = (end != here) & ~ring
    new_rank = np.where(moved, way + rank[end], rank)
    new_low = np.where(ring, least, np.where(moved, np.minimum(least, low[end]), low))
    cells = [*map(table.column, own), *(table[c].take(pa.array(end)) for c in ahead), pa.array(new_rank), pa.array(done[end]), names.take(pa.array(new_low))]
    return pa.table(dict(zip(_names(schema), cells, strict=True)))


def _contract(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield from _jumped(pa.Table.from_batches(held)).to_batches()
                held, n = [], 0
        if held:
            yield from _jumped(pa.Table.from_batches(held)).to_batches()

    return run


def _meeting(pointers: DataFrame, k: int) -> Column:
    """The smallest hash of the pieces of what a node and the one before it share, where ids spell their K-mers."""
    shared = F.left(oriented(F.col("node_id"), F.col("dir")), F.lit(k - 1))
    places = F.sequence(F.lit(1), F.greatest(F.length(shared) - (MINIMIZER - 1), F.lit(1)))
    return F.array_min(F.transform(places, lambda i: F.xxhash64(canonical(F.substr(shared, i, F.lit(MINIMIZER))))))


def _dealt(pointers: DataFrame, k: int) -> DataFrame:
    """Pointers where most of them meet those they lead to."""
    n = shuffle_partitions(pointers.sparkSession)
    if "at" not in pointers.columns:
        return pointers.repartition(n, _meeting(pointers, k))
    m = min(MINIMIZER, k - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = np.arange(4**m)
        back = sum((3 - (piece >> 2 * i & 3)) << 2 * (m - 1 - i) for i in range(m))
        value = np.minimum(piece, back) * 0x9E3779B1 % 2**32  # an order in which no run of one base comes first
        for batch in batches:
            shared = batch["at"].to_numpy() >> 2
            deal = value[shared & 4**m - 1]
            for i in range(1, k - m):
                deal = np.minimum(deal, value[shared >> 2 * i & 4**m - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(deal)], [*batch.schema.names, "deal"])

    ship(pointers.sparkSession)
    return pointers.mapInArrow(run, CODED + ", deal long").repartition(n, "deal").drop("deal")


def _reached(pointers: DataFrame) -> tuple[list[str], DataFrame]:
    """The columns where pointers lead, and pointers as what is met there: (…, next…, more, there, next_low)."""
    own, to, _ = _columns(pointers.columns)
    return to, pointers.select(
        *[F.col(a).alias(b) for a, b in zip(own, to, strict=True)], *[F.col(c).alias(f"next_{c}") for c in to], F.col("rank").alias("more"), F.col("done").alias("there"), F.col("low").alias("next_low")
    )


def _double(open_: DataFrame, ahead: DataFrame, low: Column | None = None) -> DataFrame:
    """One doubling: every open pointer jumps over the pointer it leads to."""
    to, reached = _reached(ahead)
    own = _columns(open_.columns)[0]
    return open_.join(reached, to).select(
        *own, *[F.col(f"next_{c}").alias(c) for c in to], (F.col("rank") + F.col("more")).alias("rank"), F.col("there").alias("done"), (F.least("low", "next_low") if low is None else low).alias("low")
    )


def _ring_lows(ring: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The pointers of many ring nodes, doubled until every one knows the smallest node."""
    total, k = None, 0
    ring = work.put(ring, f"{name}-ring0")
    while True:
        s = ring.agg(F.sum(F.xxhash64(*_columns(ring.columns)[0], "low").cast("decimal(38,0)"))).first()[0]
        if s == total:
            return ring
        total, k = s, k + 1
        ring = work.put(_double(ring, ring), f"{name}-ring{k}")
        work.drop(f"{name}-ring{k - 1}")


def rank(pointers: DataFrame, links: int, k: int, work: Workspace, name: str) -> tuple[DataFrame, DataFrame | None]:
    """All pointers of so many links led to their heads, and (low) of each ring, if there are any: its smallest node."""
    few, (own, to, schema) = FEW, _columns(pointers.columns)
    at = lambda df: df.select(*[F.col(b).alias(a) for a, b in zip(own, to, strict=True)]).distinct()
    if 4 * links <= few:  # each link is there both ways, and an end has a pointer even where it is a head
        all_ = work.put(pointers.coalesce(1).mapInArrow(_contract(few + HELD), schema), f"{name}0")
        lows = all_.where("not done").select("low").distinct()
        return all_, lows if lows.limit(1).count() else None
    first = work.put(_dealt(pointers, k).mapInArrow(_contract(HELD), schema), f"{name}0")
    ends = at(first.where("not done"))
    now = work.put(first.join(ends, own, "left_semi").select(*_names(schema)), f"{name}-ends0")
    done, open_, step = now.where("done"), now.where("not done"), 0
    left = open_.count()
    while left > few:
        step += 1
        # a pointer is stored again only as long as it is open, and once when it is done
        wanted = at(open_)
        ahead = done.union(open_).join(wanted, own, "left_semi").select(*_names(schema))
        now = work.put(_double(open_, ahead), f"{name}-ends{step}")
        done, open_ = done.union(now.where("done")), now.where("not done")
        after = open_.count()
        if after == left:  # a chain always has some node whose reach just covers the way to its head
            break
        left = after
    lows = None
    if 0 < left <= few:
        wanted = at(open_)
        near = done.join(wanted, own, "left_semi").select(*_names(schema))
        last = work.put(open_.union(near).coalesce(1).mapInArrow(_contract(4 * few + HELD), schema), f"{name}-last")
        done, open_ = done.union(last.join(near.select(*own), own, "left_anti").where("done").select(*_names(schema))), last.where("not done")
        if open_.limit(1).count():
            lows = open_.select("low").distinct()
    elif left:
        open_ = _ring_lows(open_, work, name)
        lows = open_.select("low").distinct()
    ranked = done.union(open_)
    jumped = _double(first.where("not done"), ranked, F.col("low"))
    return first.where("done").union(jumped), lows


def pointers(links: DataFrame) -> DataFrame:
    """Each oriented node of the links with the one before it, or itself and done if it is a head."""
    ends = links.select(F.col("src").alias("node_id"), F.col("sdir").alias("dir")).union(links.select("dst", "ddir"))
    members = ends.union(ends.select("node_id", flip(F.col("dir")))).distinct()
    before = links.select(F.col("dst").alias("node_id"), F.col("ddir").alias("dir"), F.col("src").alias("to_id"), F.col("sdir").alias("to_dir"))
    p = members.join(before, ["node_id", "dir"], "left")
    return p.select(
        "node_id", "dir", F.coalesce("to_id", "node_id").alias("to_id"), F.coalesce("to_dir", "dir").alias("to_dir"),
        F.when(F.col("to_id").isNull(), 0).otherwise(1).cast("long").alias("rank"), F.col("to_id").isNull().alias("done"), F.col("node_id").alias("low"),
    )
