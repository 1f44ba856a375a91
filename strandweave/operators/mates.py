"""Mate pairs: distances, bundles, and the search for the path between two unique contigs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import flip, mate_basename
from ..params import Params
from ..storage import Workspace
from . import kmers
from .graph import Graph

PATH = "array<struct<sdir:string,ddir:string,node:string>>"
#: Ends a step of a path that is written as a text; before any letter of an id, so that texts are in the order of paths.
END = "\u0001"


def unique_contigs(graph: Graph, p: Params) -> DataFrame:
    fits = F.col("cov").between(p.min_unique_cov, p.max_unique_cov)
    if graph.coded is not None:  # all have k letters, which are written for those that fit alone
        k = graph.coded.k
        some = graph.coded.where(fits & F.lit(k >= p.min_unique_len)).rows
        return some.select(kmers.spelled(F.col("code"), k).alias("node_id"), F.lit(k).alias("len"), F.col("cov").cast("double").alias("cov"))
    return graph.nodes.where(fits & (F.length("seq") >= p.min_unique_len)).select("node_id", F.length("seq").alias("len"), "cov")


def mate_ends(graph: Graph, p: Params) -> DataFrame:
    """(base, read, ctg, rc, off, len): read starts of mates on unique contigs."""
    s = graph.starts.withColumn("base", mate_basename(F.col("read"))).where("base != ''")
    return s.join(unique_contigs(graph, p), "node_id").select("base", "read", F.col("node_id").alias("ctg"), "rc", "off", "len")


def _pairs(ends: DataFrame) -> DataFrame:
    cols = ["read", "ctg", "rc", "off", "len"]
    a = ends.select("base", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = ends.select("base", *[F.col(c).alias(f"b_{c}") for c in cols])
    return a.join(b, "base").where("a_read < b_read")


def internal_distances(ends: DataFrame) -> DataFrame:
    """One row: pairs inside one contig, sum and sum of squares of their distances, and pairs on the same strand."""
    d1 = F.when(F.col("a_rc"), F.col("a_off")).otherwise(F.col("a_len") - F.col("a_off"))
    d = F.when(F.col("a_rc") & ~F.col("b_rc"), d1 - F.col("b_off") + 1).when(~F.col("a_rc") & F.col("b_rc"), F.col("b_off") - (F.col("a_len") - d1) + 1).cast("long")
    same = _pairs(ends).where("a_ctg = b_ctg").select(d.alias("d"))
    zero = F.lit(0).cast("long")
    return same.agg(F.count("d").alias("n"), F.coalesce(F.sum("d"), zero).alias("sum_d"), F.coalesce(F.sum(F.col("d") * F.col("d")), zero).alias("sum_d2"), F.count_if(F.col("d").isNull()).alias("invalid"))


def linking_edges(ends: DataFrame, p: Params) -> DataFrame:
    """(src, sdir, ddir, dst, dist): gaps that pairs on two contigs imply, as seen from both."""
    to_end = lambda s: F.when(F.col(f"{s}_rc"), F.col(f"{s}_off")).otherwise(F.col(f"{s}_len") - F.col(f"{s}_off"))
    x = _pairs(ends).where("a_ctg != b_ctg").withColumn("dist", (F.lit(p.insert_len) - to_end("a") - to_end("b")).cast("long"))
    d = lambda c, yes, no: F.when(F.col(c), yes).otherwise(no)
    here = x.select(F.col("a_ctg").alias("src"), d("a_rc", "r", "f").alias("sdir"), d("b_rc", "f", "r").alias("ddir"), F.col("b_ctg").alias("dst"), "dist")
    there = x.select(F.col("b_ctg").alias("src"), d("b_rc", "r", "f").alias("sdir"), d("a_rc", "f", "r").alias("ddir"), F.col("a_ctg").alias("dst"), "dist")
    return here.union(there)


def bundles(links: DataFrame) -> DataFrame:
    """(src, sdir, ddir, dst, weight, dist): links of the same ends together, their mean gap cut to a whole number."""
    mean = F.sum("dist") / F.count("*")
    return links.groupBy("src", "sdir", "ddir", "dst").agg(F.count("*").alias("weight"), mean.cast("long").alias("dist"))


def seeds(bundled: DataFrame, k: int) -> DataFrame:
    return bundled.select(
        F.col("src").alias("start"), F.col("dst").alias("dest"), F.col("sdir").alias("start_dir"), F.col("ddir").alias("exp_dir"), F.col("dist").alias("exp_dist"),
        F.col("src").alias("cur"), F.col("sdir").alias("cur_dir"), F.lit(1 - k).cast("long").alias("cur_dist"), F.lit("").alias("path"),
    )


def counted(frontier: DataFrame) -> DataFrame:
    """Ends of equal state as one row: how many paths lead there (``paths``, 2 standing for more) and the smallest of them.

    What becomes of an end depends on where it is and how far it came, not on its path, and
    two paths are as ambiguous as a thousand.  So a frontier has no more rows than states,
    where its paths double at every bubble they pass.
    """
    state = [c for c in frontier.columns if c not in ("path", "paths")]
    one = F.col("paths") if "paths" in frontier.columns else F.lit(1)
    return frontier.groupBy(*state).agg(F.least(F.sum(one), F.lit(2)).cast("long").alias("paths"), F.min("path").alias("path"))


def hop(frontier: DataFrame, graph: Graph, p: Params, first: bool) -> DataFrame:
    """One step of the search, with the state of each reached end: found, short, long, invalid, toolong or active.

    The distance is measured at the end of the current node; leaving it over an edge enters
    the next one with the overlap taken back.
    """
    e = graph.edges if graph.coded is None else graph.edges_from(frontier.select(F.col("cur").alias("node_id")))
    known = ["len"] if "len" in e.columns else []
    e = e.select(F.col("src").alias("cur"), F.col("sdir").alias("cur_dir"), F.col("ddir").alias("in_dir"), F.col("dst").alias("next"), *known)
    x = frontier.join(e, ["cur", "cur_dir"])
    if not first:
        x = x.where("next != start")
    if known:  # edges that know how long what they lead to is
        pass
    elif graph.coded is None:
        x = x.join(graph.nodes.select(F.col("node_id").alias("next"), F.length("seq").cast("long").alias("len")), "next")
    else:  # all nodes are K-mers
        x = x.withColumn("len", F.lit(p.k).cast("long"))
    x = x.withColumn("path", F.concat("path", "cur_dir", "in_dir", "next", F.lit(END)))
    here, late = F.col("next") == F.col("dest"), F.col("cur_dist") > F.col("exp_dist") + 2 * p.wiggle
    state = (
        F.when(here & (F.col("cur_dist") < F.col("exp_dist") - p.wiggle), "short").when(here & late, "long").when(here & (F.col("in_dir") != F.col("exp_dir")), "invalid").when(here, "found")
        .when(late, "toolong").otherwise("active")
    )
    x = x.withColumn("state", state).withColumn("walked", F.when(F.col("state") == "active", F.col("cur_dist") + F.col("len") - (p.k - 1)).otherwise(F.col("cur_dist")))
    carried = ["path", "paths"] if "paths" in frontier.columns else ["path"]
    return x.select("start", "dest", "start_dir", "exp_dir", "exp_dist", F.col("next").alias("cur"), F.col("in_dir").alias("cur_dir"), F.col("walked").alias("cur_dist"), *carried, "state")


def _steps(path: Column) -> Column:
    """The steps of a path that is carried as a text, a fourth of their room."""
    each = F.filter(F.split(path, END), lambda x: x != "")
    return F.transform(each, lambda x: F.struct(F.substring(x, 1, 1).alias("sdir"), F.substring(x, 2, 1).alias("ddir"), F.substr(x, F.lit(3)).alias("node"))).cast(PATH)


def search_paths(graph: Graph, bundled: DataFrame, p: Params, label: str = "hops") -> tuple[DataFrame, list[dict[str, int]]]:
    """(start, dest, start_dir, exp_dir, path, paths, dist) of the paths found, counted by hop and end, and the counts of states by hop.

    A pair of contigs with two paths already is ambiguous, and is not followed any further.
    """
    work = Workspace(graph.nodes.sparkSession, label)
    if graph.coded is None:  # lengths meet the edges once, not once a hop
        lens = graph.nodes.select(F.col("node_id").alias("dst"), F.length("seq").cast("long").alias("len"))
        graph = replace(graph, edges=work.put(graph.edges.join(lens, "dst").select("src", "sdir", "ddir", "dst", "len"), "ways"))
    frontier, found, metrics = work.put(counted(seeds(bundled, p.k)), "seeds"), None, []
    for h in range(1, p.max_frontier + 1):
        reached = work.put(counted(hop(frontier, graph, p, h == 1)), f"hop{h}")
        metrics.append({r["state"]: r["count"] for r in reached.groupBy("state").count().collect()})  # six states
        new = reached.where("state = 'found'").select("start", "dest", "start_dir", "exp_dir", _steps(F.col("path")).alias("path"), "paths", F.col("cur_dist").alias("dist"))
        found = new if found is None else found.union(new)
        settled = found.groupBy("start", "dest").agg(F.sum("paths").alias("n")).where("n > 1").select("start", "dest")
        frontier = reached.where("state = 'active'").drop("state").join(settled, ["start", "dest"], "left_anti")
        if not metrics[-1].get("active"):
            break
    return found, metrics


def sure_paths(found: DataFrame) -> DataFrame:
    """Paths of pairs with just one, the one of fewest hops at each end that is reached (ties to fewer bases, then to the start)."""
    one = found.groupBy("start", "dest").agg(F.sum("paths").alias("n"), F.first(F.struct("start_dir", "exp_dir", "path", "dist")).alias("f")).where("n = 1")
    one = one.select("start", "dest", "f.*")
    best = one.groupBy("dest", "exp_dir").agg(F.min(F.struct(F.size("path").alias("hops"), "dist", "start", "start_dir", "path")).alias("b"))
    return best.select("b.start", "dest", "b.start_dir", "exp_dir", "b.path")


def path_links(paths: DataFrame) -> DataFrame:
    """(start, dest, hop, src, sdir, ddir, dst): the edges a path uses, in order."""
    each = paths.select("start", "dest", "path", F.posexplode("path").alias("hop", "step"))
    before = F.when(F.col("hop") == 0, F.col("start")).otherwise(F.element_at("path", F.greatest("hop", F.lit(1))).getField("node"))
    return each.select("start", "dest", "hop", before.alias("src"), F.col("step.sdir").alias("sdir"), F.col("step.ddir").alias("ddir"), F.col("step.node").alias("dst"))


def dead_links(graph: Graph, paths: DataFrame) -> DataFrame:
    """Edges that compete with a path's first or last edge at the unique contigs it joins, as seen from both ends."""
    used = path_links(paths)
    ends = used.where("src = start and hop = 0").select("src", "sdir", "ddir", "dst")
    last = used.groupBy("start", "dest").agg(F.max(F.struct("hop", "src", "sdir", "ddir", "dst")).alias("l")).select("l.*")
    ends = ends.union(last.select(F.col("dst"), flip(F.col("ddir")), flip(F.col("sdir")), F.col("src"))).distinct()
    beside = graph.edges.join(ends.select("src", "sdir").distinct(), ["src", "sdir"], "left_semi").join(ends, ["src", "sdir", "ddir", "dst"], "left_anti").select("src", "sdir", "ddir", "dst")
    return beside.union(beside.select("dst", flip(F.col("ddir")), flip(F.col("sdir")), "src")).distinct()


def clean_links(graph: Graph, dead: DataFrame) -> Graph:
    edges = graph.edges.join(dead, ["src", "sdir", "ddir", "dst"], "left_anti").select("src", "sdir", "ddir", "dst")
    return Graph(graph.nodes, edges, graph.threads.limit(0), graph.starts)
