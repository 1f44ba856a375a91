"""Error correction: tips, bubbles, low coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import flip, oriented
from ..params import Params
from ..storage import Workspace
from . import build
from .graph import Graph, live_threads, sided


def _of(df: DataFrame, nodes: DataFrame | None, end: str) -> DataFrame:
    """Rows whose ``end`` is one of nodes(node_id); all, if there is none."""
    return df if nodes is None else df.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi").select(*df.columns)


def _sides(graph: Graph, among: DataFrame | None) -> DataFrame:
    """The nodes, all or ``among``, with what ``sided`` tells."""
    if among is None and graph.coded is not None:
        return graph.coded.sides()
    return sided(_of(graph.nodes, among, "node_id"), _of(graph.edges, among, "src"))


def tip_candidates(graph: Graph, p: Params, among: DataFrame | None = None) -> DataFrame:
    """(node_id, len, deg) of short nodes with at most one edge, of all or ``among``(node_id)."""
    return _tips(graph, p, among).select("node_id", "len", "deg")


def _tips(graph: Graph, p: Params, among: DataFrame | None) -> DataFrame:
    """Tip candidates with their one edge: the neighbour's side it is at, and how the tip is entered from there."""
    d = _sides(graph, among).where((F.length("seq") <= p.tip_len) & (F.col("deg_f") + F.col("deg_r") <= 1))
    enters = F.when(F.col("deg_f") == 1, "r").when(F.col("deg_r") == 1, "f")
    return d.select("node_id", F.length("seq").alias("len"), (F.col("deg_f") + F.col("deg_r")).alias("deg"), F.coalesce("fn", "rn").alias("nbr"), flip(F.coalesce("fd", "rd")).alias("side"), enters.alias("enters"))


def tip_victims(graph: Graph, p: Params, among: DataFrame | None = None) -> DataFrame:
    """(node_id) of the tips to drop.

    Islands go, and tips on themselves.  Where all edges of a node's side are tips, the
    longest stays: ties to the edge entering forward, then to the smaller id.  With
    ``among``, only tips among these nodes are known; a tip spared before is merged with
    what it hangs on, so that no other is left once its round is over.
    """
    work = Workspace(graph.nodes.sparkSession, "tips")
    tips = work.put(_tips(graph, p, among), "tips")  # a few of all nodes: what follows reads them alone
    at = tips.where("deg = 1 and node_id != nbr")
    hubs = at.select(F.col("nbr").alias("node_id")).distinct()
    degree = graph.edges_from(hubs).groupBy(F.col("src").alias("nbr"), F.col("sdir").alias("side")).agg(F.count("*").alias("degree"))
    # partial sums and maxima by side: the best is found without gathering a hub's tips
    best = at.groupBy("nbr", "side").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("len")).alias("l"), "enters", "node_id")).alias("best"))
    spared = best.join(degree, ["nbr", "side"]).where("n = degree").select("nbr", "side", F.col("best.node_id").alias("node_id"))
    return tips.select("node_id").join(spared.select("node_id"), "node_id", "left_anti")


def remove_tips(graph: Graph, p: Params) -> tuple[Graph, DataFrame]:
    victims = tip_victims(graph, p)
    return graph.without(victims), victims


def bubble_candidates(graph: Graph, p: Params, among: DataFrame | None = None) -> DataFrame:
    """Short nodes with one edge on each side, read from the smaller neighbour to the larger.

    Columns: node_id, minor, minor_dir (direction in which minor is left), major,
    major_dir (in which major is entered), dir (in which the node is read), seq, cov.
    """
    x = _sides(graph, among).where(F.length("seq") < p.bubble_len).where("deg_f = 1 and deg_r = 1 and not tandem")
    ahead = F.col("fn") >= F.col("rn")
    way = F.when(ahead, "f").otherwise("r")
    return x.select(
        "node_id", F.least("fn", "rn").alias("minor"), flip(F.when(ahead, F.col("rd")).otherwise(F.col("fd"))).alias("minor_dir"),
        F.greatest("fn", "rn").alias("major"), F.when(ahead, F.col("fd")).otherwise(F.col("rd")).alias("major_dir"), way.alias("dir"),
        oriented(F.col("seq"), way).alias("seq"), "cov",
    )


def bubble_pairs(graph: Graph, p: Params, among: DataFrame | None = None) -> DataFrame:
    """(keep, pop, ucov, vcov): parallel candidates within the edit rate, the one with more coverage (then the smaller id) first.

    Candidates share both ports, so a group has no more members than paths between two
    nodes; lengths are compared before the edit distance is computed.  With ``among``, only
    groups with one of these nodes are looked at.
    """
    c = bubble_candidates(graph, p, among)
    if among is not None:
        port = c.select(F.col("minor").alias("src"), F.col("minor_dir").alias("sdir")).distinct()
        beside = graph.edges.join(port, ["src", "sdir"], "left_semi").select(F.col("dst").alias("node_id"))
        c = bubble_candidates(graph, p, beside.union(among.select("node_id")).distinct())
    ports = ["minor", "minor_dir", "major", "major_dir"]
    # only candidates that share their ports go on: hashes of ports are counted, and a few are left
    shared = c.groupBy(F.xxhash64(*ports).alias("h")).count().where("count > 1").select("h")
    work = Workspace(graph.nodes.sparkSession, "ports")
    shared = work.put(shared, "shared")
    c = work.put(c.withColumn("h", F.xxhash64(*ports)).join(shared, "h", "left_semi").drop("h"), "beside")
    u = c.select(*ports, F.col("node_id").alias("keep"), F.col("seq").alias("useq"), F.col("cov").alias("ucov"))
    v = c.select(*ports, F.col("node_id").alias("pop"), F.col("seq").alias("vseq"), F.col("cov").alias("vcov"))
    most = F.floor(F.greatest(F.length("useq"), F.length("vseq")) * F.lit(p.bubble_rate)).cast("int")
    both = u.join(v, ports).where("ucov > vcov or (ucov = vcov and keep < pop)").where(F.abs(F.length("useq") - F.length("vseq")) <= most)
    return both.where(F.levenshtein("useq", "vseq") <= most).select("keep", "pop", "ucov", "vcov")


def greedy_pops(pairs: DataFrame, work: Workspace) -> DataFrame:
    """(keep, pop) in greedy order: a node still there pops all later ones like it, each once, by its first.

    Rounds instead of a sequential pass: nodes that no undecided earlier node can pop
    stay; what is like one of them goes.
    """
    pairs = work.put(pairs, "pairs")
    done, k = None, 0
    left = pairs
    while left.limit(1).count():
        stays = left.select(F.col("keep").alias("node")).distinct().join(left.select(F.col("pop").alias("node")), "node", "left_anti")
        hit = left.join(stays.withColumnRenamed("node", "keep"), "keep", "left_semi")
        hit = work.put(hit, f"hit{k}")
        done = hit if done is None else done.union(hit)
        gone = hit.select(F.col("pop").alias("node")).distinct()
        left = left.join(gone.withColumnRenamed("node", "keep"), "keep", "left_anti").join(gone.withColumnRenamed("node", "pop"), "pop", "left_anti")
        # pairs of nodes that stay are settled, too
        left = left.join(stays.withColumnRenamed("node", "keep"), "keep", "left_anti").select(*pairs.columns)
        k += 1
        left = work.put(left, f"left{k}")
    if done is None:
        return pairs
    first = done.groupBy("pop").agg(F.min(F.struct((-F.col("ucov")).alias("c"), "keep")).alias("m"))
    return first.select(F.col("m.keep").alias("keep"), "pop")


def pop_bubbles(graph: Graph, p: Params, label: str = "bubbles", among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node_id) that is popped, and the nodes(node_id, seq, cov) that popped any, with the coverage that went to them.

    A node that pops another stays, so the coverage goes no further.
    """
    work = Workspace(graph.nodes.sparkSession, label)
    pops = work.put(greedy_pops(bubble_pairs(graph, p, among), work), "pops")
    n = F.length("seq") - (p.k - 1)
    extra = pops.join(graph.nodes.select(F.col("node_id").alias("pop"), (F.col("cov") * n).alias("extra")), "pop").groupBy(F.col("keep").alias("node_id")).agg(F.sum("extra").alias("extra"))
    kept = graph.nodes.join(extra, "node_id").select("node_id", "seq", ((F.col("cov") * n + F.col("extra")) / n).alias("cov"))
    return pops.select(F.col("pop").alias("node_id")), work.put(kept, "kept")


def low_coverage_victims(graph: Graph, p: Params) -> DataFrame:
    return graph.nodes.where((F.length("seq") <= p.low_cov_len) & (F.col("cov") < p.low_cov)).select("node_id")


def remove_low_coverage(graph: Graph, p: Params) -> tuple[Graph, DataFrame]:
    victims = low_coverage_victims(graph, p)
    if graph.coded is not None:
        kept = graph.coded if graph.coded.k > p.low_cov_len else graph.coded.where(F.col("cov") >= p.low_cov)
        edges = build.edges_of(kept.inner(), kept.k)
        return Graph(kept.nodes(), edges, None if graph.threads is None else live_threads(graph.threads, edges), graph.starts.join(victims, "node_id", "left_anti")), victims
    return graph.without(victims), victims


def unroll_tandems(graph: Graph, p: Params) -> tuple[Graph, DataFrame]:
    """Nodes with one self-edge and at most two others are doubled along it.

    ff: the sequence twice; fr: followed by its reverse complement; rf: preceded by it,
    read backwards.  The self-edge goes, coverage halves, read starts are dropped, and for
    the palindromic kinds the first of two other edges (ff, fr, rr, rf; then by id) moves to the other side.
    """
    e = graph.edges.withColumn("et", F.concat("sdir", "ddir"))
    own = e.where("src = dst and et != 'rr'").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n"), F.min("et").alias("et")).where("n = 1")
    rank = F.when(F.col("et") == "ff", 0).when(F.col("et") == "fr", 1).when(F.col("et") == "rr", 2).otherwise(3)
    others = e.where("src != dst").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("others"), F.min(F.struct(rank.alias("o"), F.col("dst").alias("v"), F.col("sdir").alias("x"), F.col("ddir").alias("y"))).alias("port"))
    one = own.join(others, "node_id", "left").where("coalesce(others, 0) <= 2").select("node_id", "et", F.coalesce("others", F.lit(0)).alias("others"), "port")
    s, back = F.col("seq"), oriented(F.col("seq"), F.lit("r"))
    longer = F.when(F.col("et") == "ff", F.concat(s, F.substring(s, p.k, 2**31 - 1))).when(F.col("et") == "fr", F.concat(s, F.substring(back, p.k, 2**31 - 1)))
    longer = longer.otherwise(oriented(F.concat(back, F.substring(s, p.k, 2**31 - 1)), F.lit("r")))
    nodes = graph.nodes.join(one.select("node_id", "et"), "node_id", "left").select(
        "node_id", F.when(F.col("et").isNull(), s).otherwise(longer).alias("seq"), F.when(F.col("et").isNull(), F.col("cov")).otherwise(F.col("cov") / 2).alias("cov")
    )
    edges = graph.edges.join(one.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst")), ["src", "dst"], "left_anti")
    turned = one.where("et != 'ff' and others = 2").select(F.col("node_id").alias("src"), F.col("port.x").alias("sdir"), F.col("port.y").alias("ddir"), F.col("port.v").alias("dst"))
    both = turned.withColumn("at", F.lit("src")).union(turned.select("dst", flip(F.col("ddir")), flip(F.col("sdir")), "src", F.lit("dst")))
    moved = edges.join(both, ["src", "sdir", "ddir", "dst"], "left").select(
        "src", F.when(F.col("at") == "src", flip(F.col("sdir"))).otherwise(F.col("sdir")).alias("sdir"),
        F.when(F.col("at") == "dst", flip(F.col("ddir"))).otherwise(F.col("ddir")).alias("ddir"), "dst",
    )
    moved = moved.distinct()
    done = one.select("node_id")
    return Graph(nodes, moved, live_threads(graph.threads, moved), graph.starts.join(done, "node_id", "left_anti")), done
