"""Short repeats resolved by the reads that run through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import flip
from ..storage import Workspace
from .graph import Graph, live_threads, mirrored, symmetrised, with_degrees
from .live import TABLES, without

__all__ = ["independent", "node_classes", "port_pair_weights", "spanning_reads", "split", "split_pairs", "split_rows", "symmetrised", "threadible"]

PORT = ["fd", "fn", "rd", "rn"]


def spanning_reads(threads: DataFrame) -> DataFrame:
    """(node_id, read, fd, fn, rd, rn): reads over exactly two ports of a node, on opposite sides."""
    port = F.struct("sdir", "ddir", "dst")
    by = threads.groupBy("node_id", "read").agg(F.count("*").alias("n"), F.min(port).alias("a"), F.max(port).alias("b"))
    two = by.where("n = 2 and a.sdir = 'f' and b.sdir = 'r'")
    return two.select("node_id", "read", F.col("a.ddir").alias("fd"), F.col("a.dst").alias("fn"), F.col("b.ddir").alias("rd"), F.col("b.dst").alias("rn"))


def port_pair_weights(threads: DataFrame) -> DataFrame:
    """(node_id, fd, fn, rd, rn, weight): how many reads join each pair of ports."""
    return spanning_reads(threads).groupBy("node_id", *PORT).agg(F.count("*").alias("weight"))


def _at(df: DataFrame, nodes: DataFrame | None, end: str) -> DataFrame:
    return df if nodes is None else df.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi").select(*df.columns)


def node_classes(graph: Graph, threads: DataFrame, min_weight: int, among: DataFrame | None = None) -> DataFrame:
    """(node_id, kind, half, ports, covered): what the reads decide about each node, of all or ``among``(node_id).

    ``covered`` counts the ports that enough reads join with one of the other side.  A node
    with at most one edge on each side is ``straight``; else one with a self-edge is a
    ``tandem``, one without edges on a side a ``deadend``, one whose ports are all covered
    an ``xcut``, to be split, and any other ``open``.  ``half`` marks the last two kinds
    where one side has a single edge.
    """
    edges = _at(graph.edges, among, "src")
    enough = port_pair_weights(_at(threads, among, "node_id")).where(F.col("weight") >= min_weight)
    ports = enough.select(F.col("node_id").alias("src"), F.lit("f").alias("sdir"), F.col("fd").alias("ddir"), F.col("fn").alias("dst"))
    ports = ports.union(enough.select("node_id", F.lit("r"), "rd", "rn")).distinct()
    covered = edges.join(ports, ["src", "sdir", "ddir", "dst"], "left_semi").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("covered"))
    d = with_degrees(_at(graph.nodes, among, "node_id").select("node_id"), edges).join(covered, "node_id", "left")
    n, seen = F.col("deg_f") + F.col("deg_r"), F.coalesce("covered", F.lit(0).cast("long"))
    kind = (
        F.when((F.col("deg_f") <= 1) & (F.col("deg_r") <= 1), "straight").when(F.col("tandem"), "tandem").when((F.col("deg_f") == 0) | (F.col("deg_r") == 0), "deadend")
        .when(seen == n, "xcut").otherwise("open")
    )
    half = kind.isin("xcut", "open") & (F.least("deg_f", "deg_r") == 1)
    return d.select("node_id", kind.alias("kind"), half.alias("half"), n.alias("ports"), seen.alias("covered"))


def threadible(graph: Graph, threads: DataFrame, min_weight: int, among: DataFrame | None = None) -> DataFrame:
    """(node_id) of nodes to split, of all or ``among``(node_id): branching, edges on both sides, no self-edge, every port joined by enough reads."""
    return node_classes(graph, threads, min_weight, among).where("kind = 'xcut'").select("node_id")


def independent(graph: Graph, splitters: DataFrame, seed: int | None = None) -> DataFrame:
    """Splitters that come before all their splitting neighbours; only these split in a round.

    The order is that of ids, or with a seed a random one that is the same on every
    machine: a line of neighbours whose ids ascend takes a round each by ids, but with a
    new seed each round about the logarithm of its length.
    """
    order = (lambda c: F.struct(F.lit(0), c)) if seed is None else (lambda c: F.struct(F.xxhash64(c, F.lit(seed)), c))
    s = splitters.select("node_id")
    near = graph.edges.where("src != dst").join(s.withColumnRenamed("node_id", "src"), "src", "left_semi").join(s.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    least = near.groupBy(F.col("src").alias("node_id")).agg(F.min(order(F.col("dst"))).alias("least"))
    return s.join(least, "node_id", "left").where(F.col("least").isNull() | (order(F.col("node_id")) < F.col("least"))).select("node_id")


def split_pairs(graph: Graph, threads: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node_id, fd, fn, rd, rn, copy): the copies each chosen node becomes, numbered from 1.

    Every pair of ports that any read joins; where one side has one port only, every pair
    with it.
    """
    seen = port_pair_weights(_at(threads, chosen, "node_id")).select("node_id", *PORT)
    e = _at(graph.edges, chosen, "src")
    f = e.where("sdir = 'f'").select(F.col("src").alias("node_id"), F.col("ddir").alias("fd"), F.col("dst").alias("fn"))
    r = e.where("sdir = 'r'").select(F.col("src").alias("node_id"), F.col("ddir").alias("rd"), F.col("dst").alias("rn"))
    half = with_degrees(chosen, e).where("deg_f = 1 or deg_r = 1").select("node_id")
    pairs = seen.union(half.join(f, "node_id").join(r, "node_id").select("node_id", *PORT)).distinct()
    return pairs.withColumn("copy", F.row_number().over(W.partitionBy("node_id").orderBy(*PORT)))


def split_rows(graph: Graph, threads: DataFrame, chosen: DataFrame, work: Workspace, name: str = "split") -> Graph:
    """The rows that take the place of all rows naming a chosen node; read starts are dropped.

    A neighbour's threads over the old link follow the copy if there is only one for it;
    a copy's own threads are there as seen from both ends.
    """
    pairs = work.put(split_pairs(graph, threads, chosen), f"{name}-pairs")
    named = F.concat("node_id", F.lit("_"), F.col("copy").cast("string"))
    count = pairs.groupBy("node_id").agg(F.count("*").alias("n"))
    copies = pairs.join(count, "node_id").join(graph.nodes, "node_id").select(named.alias("new"), "node_id", *PORT, "seq", (F.col("cov") / F.col("n")).alias("cov"))
    copies = work.put(copies, f"{name}-copies")
    ports = copies.select("new", "node_id", F.lit("f").alias("sdir"), F.col("fd").alias("ddir"), F.col("fn").alias("dst"))
    ports = ports.union(copies.select("new", "node_id", F.lit("r"), "rd", "rn"))
    own = ports.select(F.col("new").alias("src"), "sdir", "ddir", "dst")
    edges = own.union(mirrored(own)).distinct()
    # threads: inside copies by their own reads, at neighbours where the copy is certain
    spans = spanning_reads(_at(threads, chosen, "node_id")).join(copies.select("node_id", "new", *PORT), ["node_id", *PORT])
    inside = spans.select(F.col("new").alias("node_id"), F.lit("f").alias("sdir"), F.col("fd").alias("ddir"), F.col("fn").alias("dst"), "read")
    inside = inside.union(spans.select("new", F.lit("r"), "rd", "rn", "read"))
    sure = ports.groupBy("node_id", "sdir", "ddir", "dst").agg(F.count("*").alias("n"), F.min("new").alias("new")).where("n = 1")
    to = sure.select(F.col("node_id").alias("dst"), flip(F.col("sdir")).alias("ddir"), flip(F.col("ddir")).alias("sdir"), F.col("dst").alias("node_id"), "new")
    beside = threads.join(chosen.select(F.col("node_id").alias("dst")), "dst", "left_semi").join(to, ["node_id", "sdir", "ddir", "dst"])
    beside = beside.select("node_id", "sdir", "ddir", F.col("new").alias("dst"), "read")
    nodes = copies.select(F.col("new").alias("node_id"), "seq", "cov")
    return Graph(nodes, edges, inside.union(beside).distinct(), graph.starts.limit(0))


def split(graph: Graph, threads: DataFrame, chosen: DataFrame, label: str = "split") -> Graph:
    """Replaces each chosen node by its copies."""
    work = Workspace(graph.nodes.sparkSession, label)
    chosen = work.put(chosen, "chosen")
    new = split_rows(graph, threads, chosen, work)
    old = Graph(graph.nodes, graph.edges, threads, graph.starts)
    rows = {t: without(getattr(old, t), chosen, t).union(getattr(new, t).select(*getattr(old, t).columns)) for t in TABLES}
    return Graph(rows["nodes"], rows["edges"], live_threads(rows["threads"].distinct(), rows["edges"]), rows["starts"]).saved(work, "out")
