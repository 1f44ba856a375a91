"""Mate paths carried out: every way a path runs through a node becomes copies of that node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import flip
from .graph import Graph, mirrored, with_degrees
from .live import TABLES, without
from .mates import path_links

__all__ = ["passes", "split", "splitters"]

LINK = ["sdir", "ddir", "dst"]
PASS = ["node_id", "a", "steps", "b"]


def _port(sdir: Column, ddir: Column, dst: Column) -> Column:
    return F.struct(sdir.alias("sdir"), ddir.alias("ddir"), dst.alias("dst"))


def _ports(rows: DataFrame, *own: Column) -> DataFrame:
    """One row a port of passes, with ``own`` ones besides the two outer ones, under the columns of edges."""
    port = F.explode(F.filter(F.concat(F.array("a", "b"), *own), lambda x: x.isNotNull()))
    return rows.withColumn("port", port).withColumns({c: F.col(f"port.{c}") for c in LINK}).drop("port")


def passes(graph: Graph, paths: DataFrame) -> DataFrame:
    """(node_id, a, steps, b): the ways that paths run through inner nodes, each once.

    ``a`` and ``b`` are the ports (sdir, ddir, dst) where a path comes in and goes out, as
    edges of the node; ``steps`` are the node's self-edges (sdir, ddir) taken in between.  A
    path's hops fall into runs, a hop from another node and the self-hops after it.  A path
    read backwards is the same, and one that passes a node twice with others in between
    gives two.  Passes over an edge that the graph lacks are left out.
    """
    order = W.partitionBy("start", "dest").orderBy("hop")
    hops = path_links(paths).withColumn("run", F.sum((F.col("src") != F.col("dst")).cast("int")).over(order))
    runs = hops.groupBy("start", "dest", "run").agg(
        F.min_by(F.struct("src", *LINK), "hop").alias("come"),
        F.sort_array(F.collect_list(F.when(F.col("src") == F.col("dst"), F.struct("hop", "sdir", "ddir")))).alias("own"),
    )  # run 0 has the self-hops that begin a path: nothing comes in there
    runs = runs.withColumn("go", F.lead("come").over(W.partitionBy("start", "dest").orderBy("run"))).where("run > 0 and go is not null")
    come, go = _port(flip(F.col("come.ddir")), flip(F.col("come.sdir")), F.col("come.src")), _port(F.col("go.sdir"), F.col("go.ddir"), F.col("go.dst"))
    step = lambda x, y: F.struct(x.alias("sdir"), y.alias("ddir"))
    there = F.struct(come.alias("a"), F.transform("own", lambda s: step(s["sdir"], s["ddir"])).alias("steps"), go.alias("b"))
    back = F.struct(go.alias("a"), F.transform(F.reverse("own"), lambda s: step(flip(s["ddir"]), flip(s["sdir"]))).alias("steps"), come.alias("b"))
    each = runs.select(F.col("come.dst").alias("node_id"), F.least(there, back).alias("way")).select("node_id", "way.*").distinct()
    own = F.transform("steps", lambda s: _port(s["sdir"], s["ddir"], F.col("node_id")))
    ports = _ports(each, own).select("node_id", *LINK, *PASS[1:])
    known = graph.edges.withColumnRenamed("src", "node_id").join(ports.select("node_id", *LINK), ["node_id", *LINK], "left_semi")  # few of all edges
    lost = ports.join(known, ["node_id", *LINK], "left_anti")
    return each.join(lost.select(*PASS).distinct(), PASS, "left_anti").select(*PASS)


def splitters(graph: Graph, ways: DataFrame) -> DataFrame:
    """(node_id) of nodes with a pass that have several edges on a side."""
    nodes = ways.select("node_id").distinct()
    near = graph.edges.join(nodes.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return with_degrees(nodes, near).where("deg_f > 1 or deg_r > 1").select("node_id")


def copies(graph: Graph, ways: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node_id, a, steps, b, before): the passes of chosen nodes, then one with no ``b`` for each port without a pass.

    A pass with m steps is a line of m + 1 copies, numbered from ``before`` + 1.  A self-edge
    that no pass takes goes with its node.
    """
    mine = ways.join(chosen, "node_id", "left_semi").select(*PASS)
    edges = graph.edges.join(chosen.withColumnRenamed("node_id", "src"), "src", "left_semi").where("src != dst")
    used = _ports(mine).select(F.col("node_id").alias("src"), *LINK).distinct()
    spare = edges.join(used, ["src", *LINK], "left_anti").select(F.col("src").alias("node_id"), F.struct(*LINK).alias("a"))
    rows = mine.unionByName(spare, allowMissingColumns=True).withColumn("steps", F.coalesce("steps", F.array().cast("array<struct<sdir:string,ddir:string>>")))
    line = W.partitionBy("node_id").orderBy(F.col("b").isNull(), "a", "steps", "b")
    size = F.size("steps") + 1
    return rows.withColumn("before", (F.sum(size).over(line) - size).cast("int"))


def split(graph: Graph, ways: DataFrame, chosen: DataFrame) -> Graph:
    """Puts copies in the place of chosen nodes, no two of which are neighbours.

    The copies of plain passes share the coverage, that of all passes; those of lines, and
    of ports that no pass uses, have 1.  Threads are dropped, and read starts of chosen nodes.
    """
    rows = copies(graph, ways, chosen)
    n = rows.groupBy("node_id").agg(F.count("b").alias("n"))
    name = lambda i: F.concat("node_id", F.lit("_"), i.cast("string"))
    share = F.when(F.col("b").isNotNull() & (F.size("steps") == 0), F.col("cov") / F.col("n")).otherwise(F.lit(1.0))
    each = rows.join(n, "node_id").join(graph.nodes, "node_id").withColumn("i", F.explode(F.sequence(F.lit(1), F.size("steps") + 1)))
    nodes = each.select(name(F.col("before") + F.col("i")).alias("node_id"), "seq", share.alias("cov"))
    link = lambda src, port, dst: F.struct(src.alias("src"), port["sdir"].alias("sdir"), port["ddir"].alias("ddir"), dst.alias("dst"))
    first, last = name(F.col("before") + 1), name(F.col("before") + F.size("steps") + 1)
    ends = F.filter(F.array(link(first, F.col("a"), F.col("a.dst")), link(last, F.col("b"), F.col("b.dst"))), lambda x: x["dst"].isNotNull())
    inner = F.transform("steps", lambda s, i: link(name(F.col("before") + i + 1), s, name(F.col("before") + i + 2)))
    own = rows.select(F.explode(F.concat(ends, inner)).alias("e")).select("e.*")
    new = {"nodes": nodes, "edges": own.union(mirrored(own)).distinct(), "threads": graph.threads.limit(0), "starts": graph.starts.limit(0)}
    kept = Graph(graph.nodes, graph.edges, graph.threads.limit(0), graph.starts)
    return Graph(*(without(getattr(kept, t), chosen, t).union(new[t].select(*getattr(kept, t).columns)) for t in TABLES))
