"""Compaction: every unbranched chain becomes one node, by list ranking.

Oriented nodes point to the one before them over compressible links (ranking.py); what has
no head is a ring, which is cut before its smallest node read forward, and ranked again.
A graph of coded K-mers is merged from runs that tasks find (runs.py).
Only nodes in chains change; where a graph was compact before, only links at nodes touched
since can have become compressible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import canonical, flip, oriented, rc
from ..storage import Workspace
from . import kmers, ranking, runs
from .build import compressible
from .graph import Graph, compressible_links, mirrored, sole_links
from .live import TABLES, Live, next_version, touching, without

#: Nodes of a chain that are gathered in one row.
BLOCK = 4096


def links_near(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Compressible links at nodes(node_id), as seen from both ends."""
    at = lambda n: n.select(F.col("node_id").alias("src"))
    sole = sole_links(edges.join(at(nodes), "src", "left_semi")).where("src != dst")
    far = sole.select(F.col("dst").alias("node_id")).distinct()
    back = mirrored(sole_links(edges.join(at(far), "src", "left_semi")))
    near = sole.join(back, ["src", "sdir", "ddir", "dst"], "left_semi").select("src", "sdir", "ddir", "dst")
    return near.union(mirrored(near)).distinct()


def chains(links: DataFrame, n: int, k: int, work: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """(node_id, dir, chain, rank) of every node of the n links in the orientation that is kept, and the links inside chains.

    A chain and its mirror are the same; the one with the smaller head is kept.  ``chain``
    is the head's id.
    """
    ptr, lows = ranking.rank(ranking.pointers(links), n, k, work, f"{name}-ptr")
    if lows is not None:
        low = work.put(lows.select(F.col("low").alias("dst"), F.lit("f").alias("ddir")), f"{name}-lows")
        cut = links.join(low, ["dst", "ddir"]).select("src", "sdir", "ddir", "dst")
        cut = cut.union(cut.select("dst", flip(F.col("ddir")), flip(F.col("sdir")), "src"))
        # only the ring's own link: nothing else leads to that end, the link being sole
        links = work.put(links.join(cut, ["src", "sdir", "ddir", "dst"], "left_anti"), f"{name}-cut")
        # what has a head keeps its rank: only rings' nodes are ranked again
        rings = work.put(ptr.where("not done").select(F.col("node_id").alias("src")).distinct(), f"{name}-rings")
        again = work.put(links.join(rings, "src", "left_semi").select("src", "sdir", "ddir", "dst"), f"{name}-again")
        opened, lows = ranking.rank(ranking.pointers(again), again.count(), k, work, f"{name}-cut-ptr")
        if lows is not None:
            raise RuntimeError("rings left after cutting")
        ptr = ptr.where("done").select(*opened.columns).union(opened)
    heads = ptr.select("node_id", "dir", F.col("to_id").alias("head"), F.col("to_dir").alias("head_dir"), "rank")
    # the tail of a chain is the head of its mirror
    mirror = heads.select("node_id", flip(F.col("dir")).alias("dir"), F.col("head").alias("tail"))
    kept = heads.join(mirror, ["node_id", "dir"]).where("head < tail or (head = tail and head_dir = 'f')")
    return kept.select("node_id", "dir", F.col("head").alias("chain"), "rank"), links


def compact_coded(graph: Graph, work: Workspace) -> Graph:
    """Every chain of a graph of K-mers merged: tasks merge the runs they see, what is between runs meets by codes, and letters are written for what is left."""
    k, t = graph.coded.k, graph.threads
    parts, met = runs.merge(graph.coded.rows, k, work)
    where = runs.chains(parts, met, k, work)
    name = lambda c: kmers.letters(F.col(c), k)
    each = parts.select("head", "n", "cov", "seq").join(where, "head", "left")
    # nodes: a run adds what is beyond the K - 1 bases it shares with the one before it, and all K-mers weigh the same
    alone = each.where("chain is null").select(canonical(F.left("seq", F.lit(k))).alias("node_id"), "seq", (F.col("cov") / F.col("n")).alias("cov"))
    read = F.when(F.col("ahead"), F.col("seq")).otherwise(rc(F.col("seq")))
    piece = F.when(F.col("base") == 0, read).otherwise(F.substr(read, F.lit(k)))
    line = lambda by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "piece"))), lambda x: x["piece"]), "").alias("piece")
    linked = each.where("chain is not null").select("chain", F.floor(F.col("base") / BLOCK).alias("block"), "base", piece.alias("piece"), "cov", "n", "first", "total")
    sums = [F.sum("cov").alias("cov"), F.sum("n").alias("n"), F.max("first").alias("first"), F.max("total").alias("total")]
    blocks = linked.groupBy("chain", "block").agg(line("base"), *sums)
    whole = blocks.groupBy("chain").agg(line("block"), *sums)
    # a ring is turned so that its smallest K-mer comes first
    turn, size = F.col("first").cast("int"), F.col("total").cast("int")
    ring = F.concat(F.substr("piece", turn + 1, size - turn), F.left("piece", turn))
    ring = F.concat(ring, F.left(F.repeat(ring, F.ceil(F.lit(k - 1) / size).cast("int")), F.lit(k - 1)))
    nodes = alone.union(whole.select(name("chain"), F.when(F.col("first").isNull(), F.col("piece")).otherwise(ring), F.col("cov") / F.col("n")))
    # edges outside chains, and those that rings are cut at
    outer = met.where("not chained").select("ends", runs.run_of("a").alias("src"), runs.run_of("b").alias("dst"))
    outer = outer.withColumns({"sdir": F.col("ends").bitwiseAND(F.lit(1)) == 0, "ddir": F.col("ends").bitwiseAND(F.lit(2)) != 0})
    for node, d in (("src", "sdir"), ("dst", "ddir")):
        at = where.select(F.col("head").alias(node), "chain", "ahead")
        outer = outer.join(at, node, "left").withColumns({d: F.col(d) == F.coalesce("ahead", F.lit(True)), node: F.coalesce("chain", node)}).drop("chain", "ahead")
    cut = where.where("first is not null").select("chain").distinct()
    edges = outer.select("src", "sdir", "ddir", "dst").union(cut.select(F.col("chain").alias("src"), F.lit(True), F.lit(True), F.col("chain").alias("dst")))

    def placed(codes: DataFrame) -> DataFrame:
        """Chain, strand and place there of K-mers that others ask for."""
        at = runs.places(parts, k).join(codes.distinct(), "code", "left_semi").join(where, "head", "left")
        forward = F.coalesce("ahead", F.lit(True))
        rank = F.coalesce("base", F.lit(0)) + F.when(forward, F.col("pos")).otherwise(F.col("n") - 1 - F.col("pos"))
        rank = F.when(F.col("first").isNull(), rank).otherwise((rank - F.col("first") + F.col("total")) % F.col("total"))
        head = F.least("head", kmers.turned_code(F.col("head"), k))
        return at.select("code", F.coalesce("chain", head).alias("chain"), (F.col("fwd") == forward).alias("fwd"), rank.alias("rank"))

    starts = graph.starts.withColumn("code", kmers.code_of(F.col("node_id")))
    starts = starts.join(placed(starts.select("code")), "code", "left")
    forward = F.coalesce("fwd", F.lit(True))
    off = F.coalesce("rank", F.lit(0)) + F.when(forward, F.col("off")).otherwise(k - 1 - F.col("off"))
    starts = starts.select(F.coalesce(name("chain"), "node_id").alias("node_id"), "read", (F.col("rc") == forward).alias("rc"), off.cast("int").alias("off"))
    moved = runs.named(edges, k)
    if t.isEmpty():
        return Graph(nodes, moved, t, starts).saved(work, "out")
    # threads over links inside chains go, the others follow their ends
    t = t.withColumns({"u": kmers.code_of(F.col("node_id")), "v": kmers.code_of(F.col("dst"))})
    codes = t.select(F.explode(F.array("u", "v")).alias("code"))
    at = work.put(placed(codes), "threaded")
    for code, node, d in (("u", "node_id", "sdir"), ("v", "dst", "ddir")):
        here = at.select(F.col("code").alias(code), F.col("chain").alias(f"{code}_chain"), "fwd", F.col("rank").alias(f"{code}_rank"))
        t = t.join(here, code, "left").withColumns({d: F.when(F.coalesce("fwd", F.lit(True)), F.col(d)).otherwise(flip(F.col(d))), node: F.coalesce(name(f"{code}_chain"), node)}).drop("fwd")
    step = F.when(F.col("sdir") == "f", 1).otherwise(-1)
    inner = (F.col("u_chain") == F.col("v_chain")) & (F.col("sdir") == F.col("ddir")) & (F.col("v_rank") == F.col("u_rank") + step)
    t = t.where(~F.coalesce(inner, F.lit(False)))
    return Graph(nodes, moved, t.select(*graph.threads.columns).distinct(), starts).saved(work, "out")


def merged(graph: Graph, where: DataFrame, links: DataFrame, k: int) -> Graph:
    """The rows that take the place of all rows naming nodes of ``where``; coverage is the mean over a chain's K-mers."""
    n = F.length("seq") - (k - 1)
    parts = graph.nodes.join(where, "node_id").select("chain", "rank", "node_id", "dir", oriented(F.col("seq"), F.col("dir")).alias("seq"), "cov")
    piece = F.when(F.col("rank") == 0, F.col("seq")).otherwise(F.substring("seq", k, 2**31 - 1))
    # blocks of ranks first, then the blocks: no row gathers more than BLOCK pieces, or a chain's blocks
    line = lambda by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "piece"))), lambda x: x["piece"]), "").alias("piece")
    parts = parts.withColumn("block", F.floor(F.col("rank") / BLOCK))
    blocks = parts.withColumn("piece", piece).groupBy("chain", "block").agg(line("rank"), F.sum(F.col("cov") * n).alias("cov"), F.sum(n).alias("n"))
    whole = blocks.groupBy("chain").agg(line("block"), (F.sum("cov") / F.sum("n")).alias("cov")).withColumnRenamed("piece", "seq")
    nodes = whole.select(F.col("chain").alias("node_id"), "seq", "cov")
    # a node in its kept orientation is the chain read forward; nodes outside stay as they are
    at = lambda node, d, to: where.select(F.col("node_id").alias(node), F.col("dir").alias(f"{d}_kept"), F.col("chain").alias(to))
    side = lambda d: F.when(F.col(f"{d}_kept").isNull(), F.col(d)).when(F.col(d) == F.col(f"{d}_kept"), "f").otherwise("r")

    def moved(df: DataFrame, src: str) -> DataFrame:
        df = df.join(at(src, "sdir", "a"), src, "left").join(at("dst", "ddir", "b"), "dst", "left")
        return df.withColumns({src: F.coalesce("a", src), "dst": F.coalesce("b", "dst"), "sdir": side("sdir"), "ddir": side("ddir")})

    outer = touching(graph.edges, where, "edges").join(links, ["src", "sdir", "ddir", "dst"], "left_anti")
    edges = moved(outer, "src").select("src", "sdir", "ddir", "dst").distinct()
    inner = links.withColumnRenamed("src", "node_id")
    kept = touching(graph.threads, where, "threads").join(inner, ["node_id", "sdir", "ddir", "dst"], "left_anti")
    threads = moved(kept, "node_id").select("node_id", "sdir", "ddir", "dst", "read").distinct()
    sums = parts.groupBy("chain", "block").agg(F.sum(n).alias("n"))
    ahead = lambda by, at: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("chain", "block", ahead(["chain"], "block").alias("ahead"))
    base = parts.select("chain", "block", "rank", "node_id", "dir", F.length("seq").alias("len"), n.alias("n")).withColumn("within", ahead(["chain", "block"], "rank"))
    base = base.join(sums, ["chain", "block"]).select("chain", "node_id", "dir", "len", (F.col("ahead") + F.col("within")).alias("base"))
    shifted = graph.starts.join(base, "node_id")
    forward = F.col("dir") == "f"
    starts = shifted.select(
        F.col("chain").alias("node_id"), "read", F.when(forward, F.col("rc")).otherwise(~F.col("rc")).alias("rc"),
        (F.col("base") + F.when(forward, F.col("off")).otherwise(F.col("len") - 1 - F.col("off"))).cast("int").alias("off"),
    )
    return Graph(nodes, edges, threads, starts)


def settle(live: Live, k: int) -> int:
    """Merges all chains of a graph under change; how many nodes went into chains."""
    near, graph, work = live.look("compact"), live.view(), live.work
    name = live.name("links")
    links = work.put(compressible_links(graph.edges) if near is None else links_near(graph.edges, near), name)
    n = links.count()
    if n == 0:
        return 0
    where, inner = chains(links, n, k, work, name)
    where = work.put(where.withColumn("chain", next_version(F.col("chain"))), f"{name}-where")
    n = where.count()
    live.replace(f"{name}-where", n, merged(graph, where, inner, k), "chains")
    return n


def compact(graph: Graph, k: int, label: str = "compact") -> Graph:
    """The graph, stored, with every chain merged."""
    work = Workspace(graph.nodes.sparkSession, label)
    if graph.coded is not None:
        return compact_coded(graph, work)
    links = work.put(compressible(graph), "links")
    n = links.count()
    if n == 0:
        return graph.saved(work, "out")
    where, inner = chains(links, n, k, work, "links")
    where = work.put(where, "where")
    new = merged(graph, where, inner, k)
    return Graph(*(without(getattr(graph, t), where, t).union(getattr(new, t).select(*getattr(graph, t).columns)) for t in TABLES)).saved(work, "out")
