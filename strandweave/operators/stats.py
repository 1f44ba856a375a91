"""Contig statistics: lengths by cut-off, N50, the largest contigs, branch types, K-mer histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import branch_type
from .graph import Graph, with_degrees

# The length cut-offs that the statistics are reported for.
CUTOFFS = [
    1, 50, 100, 250, 500,
    1000, 5000, 10000, 15000, 20000,
    25000, 30000, 35000, 40000, 50000,
    75000, 100000, 125000, 150000, 200000,
    250000, 500000, 750000, 1000000,
]
#: Contigs below this length take no part in N50 and the list of the largest.
N50_LEAST = 100


def measured(graph: Graph) -> DataFrame:
    """(node_id, len, deg, cov)."""
    d = with_degrees(graph.nodes, graph.edges)
    return d.select("node_id", F.length("seq").cast("long").alias("len"), (F.col("deg_f") + F.col("deg_r")).alias("deg"), "cov")


def by_length(m: DataFrame) -> DataFrame:
    """One row a length: all sums that the reports need.  Lengths are few, so what follows is small."""
    return m.groupBy("len").agg(F.count("*").alias("n"), F.sum("deg").alias("deg"), F.sum("cov").alias("cov"))


def _running(lengths: DataFrame) -> DataFrame:
    """Contigs of at least N50_LEAST by length, with number and bases of those at least as long.

    One row a distinct length goes through the single ordered window.
    """
    order = W.orderBy(F.desc("len")).rowsBetween(W.unboundedPreceding, 0)
    big = lengths.where(F.col("len") >= N50_LEAST).select("len", "n", (F.col("len") * F.col("n")).alias("bases"))
    return big.withColumn("sum_n", F.sum("n").over(order)).withColumn("sum_bases", F.sum("bases").over(order))


def _reach(running: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """For each target of bases: the length at which the running sum reaches it, and how many contigs that takes."""
    hit = targets.join(running, F.col("sum_bases") >= F.col("target")).groupBy(key, "target").agg(F.max(F.struct("len", "n", "bases", "sum_n", "sum_bases")).alias("h"))
    before_n, before_bases = F.col("h.sum_n") - F.col("h.n"), F.col("h.sum_bases") - F.col("h.bases")
    # a target that is reached already still takes the contig that is looked at first
    more = F.greatest(F.ceil((F.col("target") - before_bases) / F.col("h.len")), F.lit(1))
    return hit.select(key, F.col("h.len").alias("n50"), (before_n + more).cast("long").alias("n50_count"))


def cutoff_stats(m: DataFrame) -> DataFrame:
    """(cutoff, cnt, total, mean_len, mean_deg, mean_cov, n50, n50_count) for cut-offs with any contig; means weighted by length."""
    lengths = by_length(m)
    spark = m.sparkSession
    cuts = F.broadcast(spark.createDataFrame([(c,) for c in CUTOFFS], "cutoff long"))
    at = lengths.join(cuts, F.col("len") >= F.col("cutoff"))
    s = at.groupBy("cutoff").agg(
        F.sum("n").alias("cnt"), F.sum(F.col("len") * F.col("n")).alias("total"), F.sum(F.col("deg") * F.col("len")).alias("deg"), F.sum(F.col("cov") * F.col("len")).alias("cov")
    )
    n50 = _reach(_running(lengths), s.select("cutoff", F.expr("total div 2").alias("target")), "cutoff")
    zero = F.lit(0).cast("long")
    return s.join(n50, "cutoff", "left").select(
        "cutoff", "cnt", "total", (F.col("total") / F.col("cnt")).alias("mean_len"), (F.col("deg") / F.col("total")).alias("mean_deg"), (F.col("cov") / F.col("total")).alias("mean_cov"),
        F.coalesce("n50", zero).alias("n50"), F.coalesce("n50_count", zero).alias("n50_count"),
    )


def top_contigs(m: DataFrame, k: int = 10) -> DataFrame:
    """(rank, len, running) of the k largest contigs."""
    top = m.where(F.col("len") >= N50_LEAST).select("len").orderBy(F.desc("len")).limit(k)
    order = W.orderBy(F.desc("len"))
    return top.withColumn("rank", F.row_number().over(order)).withColumn("running", F.sum("len").over(order.rowsBetween(W.unboundedPreceding, 0))).select("rank", "len", "running")


def global_n50(m: DataFrame, genome: int) -> DataFrame:
    """One row (n50, n50_count) against a genome's size; null and the number of contigs if half of it is not reached."""
    running = _running(by_length(m))
    target = m.sparkSession.createDataFrame([(0, genome // 2)], "g int, target long")
    hit = target.select("g").join(_reach(running, target, "g"), "g", "left")
    total = running.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    return hit.crossJoin(total).select("n50", F.coalesce("n50_count", "all").alias("n50_count"))  # one row by one row


def branch_types(graph: Graph) -> DataFrame:
    """(type, len, cnt, len_share, cnt_share), shares in percent of the total."""
    d = with_degrees(graph.nodes, graph.edges)
    t = d.groupBy(branch_type(F.col("deg_f"), F.col("deg_r"), F.col("tandem"), F.col("seq")).alias("type")).agg(F.sum(F.length("seq")).alias("len"), F.count("*").alias("cnt"))
    every = W.partitionBy()  # a row a type
    return t.select("type", "len", "cnt", (100 * F.col("len") / F.sum("len").over(every)).alias("len_share"), (100 * F.col("cnt") / F.sum("cnt").over(every)).alias("cnt_share"))


def frequency_histogram(spectrum: DataFrame) -> DataFrame:
    return spectrum.groupBy(F.col("cnt").alias("frequency")).agg(F.count("*").alias("kmers"))


def tag_repeats(coords: DataFrame, query: str) -> DataFrame:
    """Each alignment row with the number of rows of its query; counted first, so that no query's rows are gathered."""
    return coords.join(coords.groupBy(query).agg(F.count("*").alias("copies")), query)
