"""The graph as normalised tables, and the small steps that all operators share."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import flip
from ..storage import Workspace
from .coded import Coded
from .marks import Threads

NODES = "node_id string, seq string, cov double"
EDGES = "src string, sdir string, ddir string, dst string"
THREADS = "node_id string, sdir string, ddir string, dst string, read string"
STARTS = "node_id string, read string, rc boolean, off int"


@dataclass(frozen=True)
class Graph:
    """nodes(node_id, seq, cov), edges(src, sdir, ddir, dst) with both mirrored rows,
    threads(node_id, sdir, ddir, dst, read) and read_starts(node_id, read, rc, off).

    A graph of K-mers may have its nodes and edges ``coded``, too, for what a node's row tells,
    and the same threads ``numbered``.
    """

    nodes: DataFrame
    edges: DataFrame
    threads: DataFrame
    starts: DataFrame
    coded: Coded | None = None
    numbered: Threads | None = None

    def saved(self, work: Workspace, name: str) -> "Graph":
        """The same graph from storage, its lineage cut."""
        return Graph(*(work.put(getattr(self, t), f"{name}-{t}") for t in ("nodes", "edges", "threads", "starts")))

    def edges_from(self, nodes: DataFrame) -> DataFrame:
        """Edges of nodes(node_id)."""
        if self.coded is not None:
            return self.coded.edges_from(nodes)
        return self.edges.join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi").select("src", "sdir", "ddir", "dst")

    def without(self, victims: DataFrame) -> "Graph":
        """Drops nodes (node_id), every link to them, and the threads over those links."""
        edges = self.edges
        for end in ("src", "dst"):
            edges = edges.join(victims.select(F.col("node_id").alias(end)), end, "left_anti")
        edges = edges.select("src", "sdir", "ddir", "dst")
        return replace(
            self, coded=None, numbered=None, nodes=self.nodes.join(victims, "node_id", "left_anti"), edges=edges, threads=live_threads(self.threads, edges), starts=self.starts.join(victims, "node_id", "left_anti")
        )


def short(name: Column) -> Column:
    """A K-mer's letters in half the room, any other text as it is: equal for equal texts only."""
    number = F.conv(F.concat(F.lit("1"), F.translate(name, "ACGT", "0123")), 4, 36)
    return F.when(name.rlike("^[ACGT]{1,30}$"), F.concat(F.lit("#"), number)).otherwise(F.concat(F.lit("!"), name))


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), flip(F.col("ddir")).alias("sdir"), flip(F.col("sdir")).alias("ddir"), F.col("src").alias("dst"))


def live_threads(threads: DataFrame, edges: DataFrame) -> DataFrame:
    """Threads whose edge exists."""
    keys = ["node_id", "sdir", "ddir", "dst"]
    return threads.join(edges.withColumnRenamed("src", "node_id"), keys, "left_semi").select(*keys, "read")


def symmetrised(graph: Graph) -> DataFrame:
    """Threads known at either end of an edge, at both; only for edges that exist.

    Threads meet the ports of their node, a few, in one row, so that they are dealt by the
    node alone: what then counts or joins by node and more needs no other shuffle.
    """
    port = F.concat("sdir", "ddir", "dst")
    t = graph.threads.select("node_id", "sdir", "ddir", "dst", "read")
    there = t.select(F.col("dst").alias("node_id"), flip(F.col("ddir")).alias("sdir"), flip(F.col("sdir")).alias("ddir"), F.col("node_id").alias("dst"), "read")
    ports = graph.edges.groupBy(F.col("src").alias("node_id")).agg(F.collect_set(port).alias("ports"))
    known = t.union(there).join(ports, "node_id").where(F.array_contains("ports", port))
    return known.select("node_id", "sdir", "ddir", "dst", "read").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, deg_f, deg_r, tandem) of nodes with any edge."""
    return edges.groupBy(F.col("src").alias("node_id")).agg(
        F.count_if(F.col("sdir") == "f").alias("deg_f"), F.count_if(F.col("sdir") == "r").alias("deg_r"), F.max(F.col("src") == F.col("dst")).alias("tandem")
    )


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    joined = nodes.join(degrees(edges), "node_id", "left")
    return joined.withColumns({"deg_f": F.coalesce("deg_f", zero), "deg_r": F.coalesce("deg_r", zero), "tandem": F.coalesce("tandem", F.lit(False))})


def sided(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, seq, cov, deg_f, deg_r, tandem, fd, fn, rd, rn): degrees, and the edge of a side that has just one; one shuffle of the edges."""
    on = lambda d: F.col("sdir") == d
    at = edges.groupBy(F.col("src").alias("node_id")).agg(
        F.count_if(on("f")).alias("deg_f"), F.count_if(on("r")).alias("deg_r"), F.max(F.col("src") == F.col("dst")).alias("tandem"),
        *[F.min(F.when(on(d), F.col(c))).alias(f"{d}{n}") for d in "fr" for c, n in (("ddir", "d"), ("dst", "n"))],
    )
    zero, joined = F.lit(0).cast("long"), nodes.select("node_id", "seq", "cov").join(at, "node_id", "left")
    joined = joined.withColumns({"deg_f": F.coalesce("deg_f", zero), "deg_r": F.coalesce("deg_r", zero), "tandem": F.coalesce("tandem", F.lit(False))})
    return joined.withColumns({f"{d}{n}": F.when(F.col(f"deg_{d}") == 1, F.col(f"{d}{n}")) for d in "fr" for n in "dn"})


def sole_links(edges: DataFrame) -> DataFrame:
    """Edges that are the only one of their source in their direction."""
    one = edges.groupBy("src", "sdir").agg(F.count("*").alias("n"), F.min("ddir").alias("ddir"), F.min("dst").alias("dst"))
    return one.where("n = 1").select("src", "sdir", "ddir", "dst")


def compressible_links(edges: DataFrame) -> DataFrame:
    """Links that are the sole one at both ends and do not lead back to the same node."""
    sole = sole_links(edges)
    return sole.where("src != dst").join(mirrored(sole), ["src", "sdir", "ddir", "dst"], "left_semi")
