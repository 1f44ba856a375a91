"""Connected components with alternating large-star and small-star steps on DataFrames.

Few links, by a count, are joined in one task instead, which saves the rounds.

Each step is one aggregation by node (partial sums first) and one join of edges with the
node minima, which adaptive execution splits where a hub's edges meet.  A step's edges
go to the shared folder, the step before is dropped, and nothing is collected but two counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Workspace, trimmed

#: Links up to this number, by a count, meet in one task: 16 bytes each.
FEW_LINKS = 200_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of one task's links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = sorted((root(a), root(b)))
            up[b] = a
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def _star(edges: DataFrame, low: DataFrame) -> DataFrame:
    return edges.join(low, "u").select("u", "v", "m")


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Nulls, self-links and repeated links have no effect; an empty table gives no rows.
    """
    spark = edges.sparkSession
    work = Workspace(spark, "components")
    plain = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = work.put(plain.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "e0")  # u > v
    if now.schema["u"].dataType.simpleString() == "bigint" and now.count() <= FEW_LINKS:
        return now.coalesce(1).mapInArrow(trimmed(_union_find), "node long, component long")
    for k in range(1, max_rounds + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is hung on the least one around
        large = _star(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.put(large, f"l{k}")
        # small star: a node and its smaller neighbours are hung on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(large, low)
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v"))).distinct()
        after = work.put(hung, f"e{k}")
        # stars, if no node with a parent has another or is one itself
        ends = after.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(after.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        wrong = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0")
        settled = wrong.limit(1).count() == 0
        work.drop(f"l{k}", f"e{k - 1}")
        now = after
        if settled:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
