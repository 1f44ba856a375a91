"""From reads to the de Bruijn graph: cleaning, windows, nodes, edges, read starts, threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import canonical, flip, oriented, rc, strand
from ..params import Params
from . import kmers
from .coded import Coded
from .graph import Graph, compressible_links, degrees
from .marks import Threads


def judged_reads(reads: DataFrame, p: Params) -> DataFrame:
    """reads(read, seq) trimmed and in upper case, with fate: good, short or skipped.

    Terminal Ns go; a read with any other letter left is skipped; one of at most k bases
    is short.  A null sequence counts as empty, a null name stays one.
    """
    seq = F.upper(F.coalesce("seq", F.lit("")))
    if p.trim5 or p.trim3:
        seq = F.substr(seq, F.lit(p.trim5 + 1), F.greatest(F.length(seq) - p.trim5 - p.trim3, F.lit(0)))
    seq = F.when(F.contains(seq, F.lit("N")), F.regexp_replace(seq, "^N+|N+$", "")).otherwise(seq)
    fate = F.when(F.col("seq").rlike("[^ACGT]"), "skipped").when(F.length("seq") <= p.k, "short").otherwise("good")
    return reads.select("read", seq.alias("seq")).withColumn("fate", fate)


def clean_reads(reads: DataFrame, p: Params) -> DataFrame:
    return judged_reads(reads, p).where("fate = 'good'").select("read", "seq")


def cleaning_columns() -> list[Column]:
    """Aggregates over judged reads: how many are good, short and skipped, and the good ones' bases."""
    of = lambda fate: F.count_if(F.col("fate") == fate)
    good_bp = F.coalesce(F.sum(F.when(F.col("fate") == "good", F.length("seq"))), F.lit(0))
    return [of("good").alias("reads_good"), of("short").alias("reads_short"), of("skipped").alias("reads_skipped"), good_bp.alias("reads_goodbp")]


def cleaning_counters(reads: DataFrame, p: Params) -> DataFrame:
    return judged_reads(reads, p).agg(*cleaning_columns())


def _windows(good: DataFrame, k: int) -> DataFrame:
    """(read, b, rb, n, pos) of every window of k bases: the read and its reverse complement as bytes, where a slice costs no scan."""
    whole = good.select("read", F.col("seq").cast("binary").alias("b"), rc(F.col("seq")).cast("binary").alias("rb"), F.length("seq").alias("n"))
    return whole.select("read", "b", "rb", "n", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("pos"))


def _at(k: int, shift: int = 0) -> tuple[Column, Column]:
    """The K-mer at ``shift`` from a window's position, and its reverse complement."""
    pos = F.col("pos") + shift
    return F.substr("b", pos + 1, F.lit(k)), F.substr("rb", F.col("n") - pos - (k - 1), F.lit(k))


def kmer_windows(good: DataFrame, k: int) -> DataFrame:
    """(read, pos, kmer) of every window of the reads."""
    return _windows(good, k).select("read", "pos", _at(k)[0].cast("string").alias("kmer"))


def kmer_spectrum(good: DataFrame, k: int) -> DataFrame:
    """Occurrences of each canonical K-mer; partial counts are made before the shuffle."""
    if kmers.fits(k):
        counted = kmers.canonical_codes(good, k).groupBy("code").agg(F.count("*").alias("cnt"))
        return counted.select(kmers.letters(F.col("code"), k).alias("kmer"), "cnt")
    counted = _windows(good, k).select(F.least(*_at(k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("cnt"))
    return counted.select(F.col("kmer").cast("string").alias("kmer"), "cnt")


def nodes(good: DataFrame, k: int) -> DataFrame:
    spectrum = kmer_spectrum(good, k)
    return spectrum.select(F.col("kmer").alias("node_id"), F.col("kmer").alias("seq"), F.col("cnt").cast("double").alias("cov"))


def _step(k: int) -> list[Column]:
    """src, sdir, ddir and dst, the ids as bytes, of the step from a window to the next."""
    (u, ru), (v, rv) = _at(k), _at(k, 1)
    way = lambda x, rx: F.when(x < rx, F.lit("f")).otherwise(F.lit("r"))
    return [F.least(u, ru).alias("src"), way(u, ru).alias("sdir"), way(v, rv).alias("ddir"), F.least(v, rv).alias("dst")]


def _named(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ("src", "dst")})


def steps(good: DataFrame, k: int) -> DataFrame:
    """(read, pos, src, sdir, ddir, dst) for each two neighbouring windows."""
    return _named(_windows(good, k + 1).select("read", "pos", *_step(k)))


def _both_ends(df: DataFrame, *more: tuple[str, str, str]) -> DataFrame:
    """Each step as seen from its two ends; ``more`` are (name, column here, column at the mirror)."""
    here = F.struct(F.col("src"), F.col("sdir"), F.col("ddir"), F.col("dst"), *[F.col(a).alias(n) for n, a, _ in more])
    there = F.struct(
        F.col("dst").alias("src"), flip(F.col("ddir")).alias("sdir"), flip(F.col("sdir")).alias("ddir"), F.col("src").alias("dst"), *[F.col(b).alias(n) for n, _, b in more]
    )
    return df.select(F.explode(F.array(here, there)).alias("e")).select("e.*")


def _spelled(coded: DataFrame, k: int) -> DataFrame:
    """Steps given as ``code`` as windows of k + 1 bases, with their reverse complements, beside what else is there."""
    w, rw = kmers.letters(F.col("code"), k + 1), kmers.turned_letters(F.col("code"), k + 1)
    return coded.withColumns({"b": w.cast("binary"), "rb": rw.cast("binary"), "n": F.lit(k + 1), "pos": F.lit(0)})


def edges(good: DataFrame, k: int) -> DataFrame:
    """All edges with their mirrors, by one shuffle of the distinct ones.

    Of an edge and its mirror the one from the smaller node is made distinct; a link of a
    node to itself that is its own mirror comes once.
    """
    if kmers.fits(k):
        return edges_of(edge_codes(good, k), k)
    return _mirrored(_windows(good, k + 1).select(*_step(k)), True)


def edges_of(codes: DataFrame, k: int) -> DataFrame:
    """Edges, with their mirrors, of distinct (code)."""
    return _mirrored(_spelled(codes, k).select(*_step(k)), False)


def _mirrored(s: DataFrame, again: bool) -> DataFrame:
    """Steps turned to the smaller node, made distinct if they may come ``again``, and their mirrors."""
    turn = (F.col("src") > F.col("dst")) | (F.col("src") == F.col("dst")) & (F.col("sdir") == "r") & (F.col("ddir") == "r")
    pick = lambda here, there: F.when(turn, there).otherwise(here)
    one = s.select(
        F.least("src", "dst").alias("src"), pick(F.col("sdir"), flip(F.col("ddir"))).alias("sdir"),
        pick(F.col("ddir"), flip(F.col("sdir"))).alias("ddir"), F.greatest("src", "dst").alias("dst"),
    )
    one = one.distinct() if again else one
    ends = F.struct("src", "sdir", "ddir", "dst")
    mirror = F.struct(F.col("dst").alias("src"), flip(F.col("ddir")).alias("sdir"), flip(F.col("sdir")).alias("ddir"), F.col("src").alias("dst"))
    alone = (F.col("src") == F.col("dst")) & (F.col("sdir") != F.col("ddir"))
    return one.select(F.explode(F.when(alone, F.array(ends)).otherwise(F.array(ends, mirror))).alias("e")).select(
        F.col("e.src").cast("string").alias("src"), "e.sdir", "e.ddir", F.col("e.dst").cast("string").alias("dst")
    )


def _tag(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.col("read"), F.lit("c"), n.cast("string"))).otherwise(F.col("read"))


def _tagged(good: DataFrame, k: int) -> DataFrame:
    """Steps (read, pos, src, sdir, ddir, dst, utag, vtag) with their chunk tags, in one pass over the windows."""
    u, ru = _at(k)
    # a window takes the next one's last base along, if there is one
    win = _windows(good, k).select("read", "pos", "n", F.substr("b", F.col("pos") + 1, F.lit(k + 1)).alias("w"), u.alias("u"))
    seen = F.row_number().over(W.partitionBy("read", "u").orderBy("pos")) > 1
    ranked = win.withColumn("again", seen.cast("int"))
    order = W.partitionBy("read").orderBy("pos")
    ahead = F.lead("again").over(order)  # null at the last window, which begins no step
    step = ranked.withColumn("repeat", F.when(ahead.isNotNull(), F.greatest("again", ahead)))
    step = step.withColumn("upto", F.sum("repeat").over(order.rowsBetween(W.unboundedPreceding, 0))).where("repeat is not null")
    return step.select(
        "read", F.col("pos").alias("at"), _tag(2 * F.col("upto") - F.col("repeat")).alias("utag"), _tag(2 * F.col("upto")).alias("vtag"),
        F.col("w").alias("b"), rc(F.col("w").cast("string")).cast("binary").alias("rb"), F.lit(k + 1).alias("n"), F.lit(0).alias("pos"),
    )


def chunk_tags(good: DataFrame, k: int) -> DataFrame:
    """(read, pos, utag, vtag): names of a read that change after each repeat inside it.

    A step is a repeat if either of its windows occurred in the read before, or both are
    equal.  The chunk number rises by one before each end of such a step is named; while
    it is 0 the name has no suffix.
    """
    if kmers.fits(k):
        return kmers.tagged_steps(good, k).select("read", "pos", _tag(F.col("u")).alias("utag"), _tag(F.col("v")).alias("vtag"))
    return _tagged(good, k).select("read", F.col("at").alias("pos"), "utag", "vtag")


def read_starts(good: DataFrame, k: int, cap: int) -> DataFrame:
    """(node_id, read, rc, off) of the reads' first windows; the first ``cap`` a node by name."""
    first = F.substring("seq", 1, k)
    start = good.select(canonical(first).alias("node_id"), "read", (strand(first) == "r").alias("rc"))
    start = start.withColumn("off", F.when(F.col("rc"), k - 1).otherwise(0))
    order = W.partitionBy("node_id").orderBy("read", "rc")
    return start.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")


def edge_codes(good: DataFrame, k: int) -> DataFrame:
    """(code) of each edge, where its bases fit a long."""
    return kmers.canonical_codes(good, k + 1).distinct()


def _branching(codes: DataFrame, k: int) -> DataFrame:
    """(code, ends): edges with a branching end; ``ends`` has 1 and 2 added for those of ``tagged_steps`` that branch."""
    way = codes.select(F.explode(F.array("code", kmers.turned_code(F.col("code"), k + 1))).alias("way"))
    # the bases that follow a K-mer, as bits
    ahead = way.groupBy(F.shiftright("way", 2).alias("port")).agg(F.bit_or(F.element_at(F.array(*map(F.lit, (1, 2, 4, 8))), F.col("way").bitwiseAND(F.lit(3)).cast("int") + 1)).alias("bases"))
    forked = ahead.where(F.bit_count("bases") > 1).select("port", "bases", F.explode(F.array(*map(F.lit, range(4)))).alias("last"))
    forked = forked.where(F.element_at(F.array(*[F.col("bases").bitwiseAND(F.lit(1 << i)) for i in range(4)]), F.col("last") + 1) > 0)
    back = forked.select(F.shiftleft("port", 2).bitwiseOR(F.col("last").cast("long")).alias("way")).withColumn("back", kmers.turned_code(F.col("way"), k + 1))
    return back.groupBy(F.least("way", "back").alias("code")).agg(F.bit_or(F.when(F.col("way") <= F.col("back"), 1).otherwise(2)).alias("ends"))


def coded(rows: DataFrame, k: int, threads: DataFrame | None, starts: DataFrame, numbered: Threads | None = None) -> Graph:
    """The graph of stored rows(code, cov, ports, turned): its nodes and edges are read off them; with its threads ``numbered``, too, if they are."""
    c = Coded(rows, k)
    return Graph(c.nodes(), c.edges(), numbered.spelled() if threads is None and numbered else threads, starts, c, numbered)


def compressible(graph: Graph) -> DataFrame:
    """Links that are the sole one at both ends and do not lead back to the same node."""
    if graph.coded is None:
        return compressible_links(graph.edges)
    return edges_of(graph.coded.sole(), graph.coded.k).where("src != dst")


def port_threads(good: DataFrame, rows: DataFrame, k: int, cap: int) -> DataFrame:
    """(code, port, read): the threads of ``edge_threads`` by the code of their node and its port, as ``kmers.ported`` numbers them."""
    return Threads(good, k, cap, rows).ports()


def edge_threads(good: DataFrame, k: int, cap: int, all_nodes: bool = False, graph_edges: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(node_id, sdir, ddir, dst, read): chunk tags of the reads over each edge at its branching ends, the first ``cap`` by name.

    The reads' own edges say what branches, or their K-mers' ``rows``, if they are given; for K-mers too long for codes edges may be given.
    """
    if kmers.fits(k):
        if all_nodes or rows is not None:
            return Threads(good, k, cap, None if all_nodes else rows).spelled()
        return Threads(good, k, cap, forked=_branching(edge_codes(good, k), k)).spelled()
    tagged = _named(_tagged(good, k).select("utag", "vtag", *_step(k)))
    ends = _both_ends(tagged, ("read", "utag", "vtag")).withColumnRenamed("src", "node_id").distinct()
    if not all_nodes:
        degree = (graph_edges if graph_edges is not None else edges(good, k)).groupBy(F.col("src").alias("node_id"), "sdir").count().where("count > 1")
        ends = ends.join(degree, ["node_id", "sdir"], "left_semi")
    order = W.partitionBy("node_id", "sdir", "ddir", "dst").orderBy("read")
    return ends.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select("node_id", "sdir", "ddir", "dst", "read")


def build(reads: DataFrame, p: Params) -> Graph:
    good = clean_reads(reads, p)
    e = edges(good, p.k)
    return Graph(nodes(good, p.k), e, edge_threads(good, p.k, p.max_threads, p.record_all_threads, e), read_starts(good, p.k, p.max_read_starts))


def degree_table(graph: Graph) -> DataFrame:
    return degrees(graph.edges)
