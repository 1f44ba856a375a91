"""Graphs whose nodes carry their edges as bits, against the same graphs as plain tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandweave.functions.sequence import pack
from strandweave.operators import build, compact, correct, inspect, kmers, mates, ranking
from strandweave.operators.graph import compressible_links, sided
from strandweave.params import Params
from strandweave.plans import assembly
from strandweave.sources import sinks
from strandweave.storage import Workspace

READS = [("a", "ACGTTGCAACGTAGGA"), ("b", "ACGTTGCATTTTTTTTTGGGCCC"), ("c", "TTGACCATGGTCAATTGACC"), ("d", "CCCCCCCCCC"), ("e", "ACGTAGCTACGTAGGATCC"), ("f", "GGATCCTACGTA")]


@pytest.fixture(params=[3, 5, 7])
def both(spark, request):
    """The graph with bits, and without."""
    k = request.param
    p = Params(k=k, low_cov=2.0, bubble_rate=0.4)
    good = build.clean_reads(spark.createDataFrame(READS, "read string, seq string"), p)
    rows = Workspace(spark, "bits").put(kmers.ported(good, k), "rows")
    graph = build.coded(rows, k, None, build.read_starts(good, k, 9))
    return graph, replace(graph, nodes=build.nodes(good, k), edges=build.edges(good, k), coded=None), p, good


def _rows(df):
    return sorted(map(str, df.collect()))


def test_same_graph(both):
    graph, plain, p, _ = both
    for table in ("nodes", "edges"):
        assert _rows(getattr(graph, table)) == _rows(getattr(plain, table))
    assert _rows(graph.coded.sides()) == _rows(sided(plain.nodes, plain.edges).select(*graph.coded.sides().columns))
    assert _rows(build.compressible(graph)) == _rows(compressible_links(plain.edges))
    some = plain.nodes.where("node_id < 'AG'").select("node_id")
    assert _rows(graph.edges_from(some)) == _rows(plain.edges_from(some))


def test_same_corrections(both):
    graph, plain, p, _ = both
    for f in (correct.tip_candidates, correct.tip_victims, correct.bubble_candidates, correct.bubble_pairs):
        assert _rows(f(graph, p)) == _rows(f(plain, p)), f.__name__
    for low_cov_len in (p.low_cov_len, p.k - 1):
        q = replace(p, low_cov_len=low_cov_len)
        a, b = correct.remove_low_coverage(graph, q)[0], correct.remove_low_coverage(replace(plain, threads=build.edge_threads(both[3], p.k, 9)), q)[0]
        assert _rows(a.nodes) == _rows(b.nodes)
        assert _rows(a.edges) == _rows(b.edges)
        assert _rows(a.starts) == _rows(b.starts)


def test_same_hops(both, spark):
    graph, plain, p, _ = both
    bundled = plain.edges.selectExpr("src", "sdir", "'f' as ddir", "'AAA' as dst", "1L as weight", "9L as dist")
    for first in (True, False):
        assert _rows(mates.hop(mates.seeds(bundled, p.k), graph, p, first)) == _rows(mates.hop(mates.seeds(bundled, p.k), plain, p, first))


def test_a_node_is_read_off_its_row(both):
    """Degrees, tips and bubble candidates ask for no shuffle."""
    graph, _, p, _ = both
    for df in (graph.nodes, graph.edges, correct.tip_candidates(graph, p), correct.bubble_candidates(graph, p)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_same_check_and_details(both, spark):
    """A faulty edge, a missing node, a repeated edge and a thread without an edge are found; a chosen node's edges alone are dealt."""
    graph, plain, p, good = both
    threads = build.edge_threads(good, p.k, 9).localCheckpoint()
    graph, plain = replace(graph, threads=threads), replace(plain, threads=threads)
    one = inspect.check_graph(graph, p.k).collect()
    assert one == inspect.check_graph(plain, p.k).collect()
    first = plain.edges.limit(1)
    bad = spark.createDataFrame([("AAA~1", "f", "f", "CCC"), ("A" * p.k, "f", "f", "none")], plain.edges.schema)
    nodes = plain.nodes.union(spark.createDataFrame([("AAA~1", "A" * p.k, 1.0), ("CCC", "C" * p.k, 1.0), ("AAAAAAAAAAA", "A" * p.k, 1.0)], plain.nodes.schema)).distinct()
    lost = spark.createDataFrame([("AAA", "f", "r", "none", "x")], threads.schema)
    if p.k > 3:
        nodes = nodes.union(spark.createDataFrame([("A" * p.k, "A" * p.k, 1.0)], nodes.schema)).dropDuplicates(["node_id"])
        faulty = inspect.check_graph(replace(plain, nodes=nodes, edges=plain.edges.union(first).union(bad), threads=threads.union(lost)), p.k).first()
        was = one[0]
        assert (faulty["edges_bad"] - was["edges_bad"], faulty["edges_missing"], faulty["edges_repeated"], faulty["threads_bad"], faulty["threads_ok"]) == (1, 1, 1, 1, was["threads_ok"])
    full = lambda g: inspect.details(g, types=["full", "half"], fields=("edges",))
    assert _rows(full(graph)) == _rows(full(plain))
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert dealt(full(graph)) < dealt(full(plain))


def test_same_messages(both, tmp_path):
    graph, plain, p, good = both
    plain = replace(plain, threads=build.edge_threads(good, p.k, 9))
    lines = sinks.coded_messages(graph.coded, build.port_threads(good, graph.coded.rows, p.k, 9), graph.starts)
    assert _rows(lines) == _rows(sinks.node_messages(plain))
    lines.write.text(str(tmp_path / "lines"), compression="gzip")
    back = sinks.read_node_messages(good.sparkSession, str(tmp_path / "lines"), p.k)
    for table in ("nodes", "edges", "threads", "starts"):
        assert _rows(getattr(back, table)) == _rows(getattr(plain, table))


def test_messages_keep_what_they_part(spark, tmp_path):
    """A read's name may hold colons; a node that is no K-mer is an error where only K-mers are expected."""
    good = spark.createDataFrame([("run:1:7", "ACGTTGCAACGTAGGA"), ("run:1:8", "ACGTTGCATTTTTTT")], "read string, seq string")
    g = build.build(good, Params(k=5))
    sinks.node_messages(g).write.text(str(tmp_path / "lines"))
    back = sinks.read_node_messages(spark, str(tmp_path / "lines"))
    assert _rows(back.threads) == _rows(g.threads) and g.threads.count()
    assert _rows(back.starts) == _rows(g.starts)
    with pytest.raises(Exception, match="not 7 packed bases"):
        sinks.read_node_messages(spark, str(tmp_path / "lines"), 7).nodes.collect()


@pytest.mark.parametrize("w", [3, 4, 15, 30, 31])
def test_packed_codes(spark, w):
    seqs = ["A" * w, "T" * w, ("ACGT" * 8)[:w], ("GATTACA" * 5)[:w]]
    x = spark.createDataFrame([(s,) for s in seqs], "seq string").withColumn("code", kmers.code_of(F.col("seq")))
    x = x.withColumn("name", kmers.packed(F.col("code"), w))
    assert x.where(F.col("name") != pack(F.col("seq"))).count() == 0
    assert x.where(kmers.packed_code(F.col("name"), w) != F.col("code")).count() == 0


@pytest.mark.parametrize("few", [500_000, 4])
def test_same_chains(both, monkeypatch, few):
    """Chains and rings found by codes are those found by names, with all that hangs on them."""
    graph, plain, p, good = both
    monkeypatch.setattr(ranking, "FEW", few)
    threads = build.edge_threads(good, p.k, 9)
    seen = []
    monkeypatch.setattr(compact, "compact_coded", lambda *a, f=compact.compact_coded: seen.append(1) or f(*a))
    a, b = compact.compact(replace(graph, threads=threads), p.k), compact.compact(replace(plain, threads=threads), p.k)
    assert seen
    for table in ("nodes", "edges", "threads", "starts"):
        assert _rows(getattr(a, table)) == _rows(getattr(b, table).select(*getattr(a, table).columns)), table


@pytest.mark.parametrize("all_threads", [False, True])
def test_assembly_begins_with_codes(spark, tmp_path, monkeypatch, all_threads):
    """The first stage of an assembly stores the compact graph of its reads, found by codes."""
    reads = spark.createDataFrame([*READS, ("short", "ACG"), ("bad", "ACGTNACGTACGT")], "read string, seq string")
    p = Params(k=7, max_threads=9, record_all_threads=all_threads)
    seen = []
    monkeypatch.setattr(compact, "compact_coded", lambda *a, f=compact.compact_coded: seen.append(1) or f(*a))
    job = assembly.Assembly(spark, p, str(tmp_path))
    a, b = job.run(reads, stop="buildInitial"), compact.compact(build.build(reads, p), 7)
    assert len(seen) == 1
    for table in ("nodes", "edges", "threads", "starts"):
        assert _rows(getattr(a, table)) == _rows(getattr(b, table).select(*getattr(a, table).columns)), table
    assert {r.counter: r.value for r in job.counters("buildInitial").collect()} | {"reads_good": 6, "reads_short": 1, "reads_skipped": 1} == {r.counter: r.value for r in job.counters("buildInitial").collect()}
