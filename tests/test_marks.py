"""Threads as numbers, against those as letters."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import build, inspect, kmers, marks, threads
from strandweave.operators.graph import Graph, symmetrised
from strandweave.params import Params
from strandweave.sources import sinks
from strandweave.storage import Workspace

from .test_kmers import some_reads

#: Names that are numbers, look like a number's chunk, are too large, or none.
NAMES = [lambda i: str(i), lambda i: f"r{i}", lambda i: [f"{i + 4}c2", str(10**12 + i), f"0{i}", f"ß{i}", str(i)][i % 5]]


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(params=[(3, 4, 0), (5, 250, 1), (5, 3, 2), (15, 250, 0), (15, 250, 2)], ids=str)
def both(spark, request, monkeypatch):
    """The graph with its threads as numbers, and as letters."""
    k, cap, named = request.param
    monkeypatch.setattr(marks, "HELD", 50)
    reads = [(NAMES[named](i), s) for i, s in enumerate(some_reads(k, k) * 2)]
    good = build.clean_reads(spark.createDataFrame(reads, "read string, seq string"), Params(k=k)).repartition(3)
    good = Workspace(spark, "good").put(good, "good")
    graph = build.coded(Workspace(spark, "bits").put(kmers.ported(good, k), "rows"), k, None, build.read_starts(good, k, 9), None)
    numbered = build.coded(graph.coded.rows, k, None, graph.starts, marks.Threads(good, k, cap, graph.coded.rows))
    monkeypatch.setattr(kmers, "fits", lambda _: False)
    plain = Graph(graph.nodes, build.edges(good, k), build.edge_threads(good, k, cap).localCheckpoint(), graph.starts)
    return numbered, plain, k, good


def test_same_threads(both):
    graph, plain, k, good = both
    columns = plain.threads.columns
    assert _rows(graph.threads.select(columns)) == _rows(plain.threads)
    assert _rows(graph.numbered.spelled(both=True).select(columns)) == _rows(symmetrised(plain).select(columns))


def test_same_decisions(both):
    """Weights, names, classes, what is split first, and into how many copies."""
    graph, plain, k, good = both
    pairs = symmetrised(plain).localCheckpoint()
    assert _rows(marks.port_pair_weights(graph.numbered.marks(), k)) == _rows(threads.port_pair_weights(pairs))
    assert _rows(inspect.pair_reads(graph)) == _rows(inspect.pair_reads(plain).select(inspect.pair_reads(graph).columns))
    for least in (1, 2):
        seen = marks.judged(graph.numbered.marks(), graph.coded.rows, k, least).localCheckpoint()
        assert _rows(marks.node_classes(seen, k)) == _rows(threads.node_classes(plain, pairs, least))
        named = lambda df: df.select(kmers.letters(F.col("code"), k).alias("node_id"))
        chosen = threads.threadible(plain, pairs, least).localCheckpoint()
        splitters = marks.threadible(seen, k).localCheckpoint()
        assert _rows(named(splitters)) == _rows(chosen)
        first = threads.independent(plain, chosen).localCheckpoint()
        some = marks.independent(splitters, k).localCheckpoint()
        assert _rows(named(some)) == _rows(first)
        copies = marks.copies(some, k)
        assert _rows(named(copies).withColumn("copy", F.lit(1))) == _rows(threads.split_pairs(plain, pairs, first).select("node_id", F.lit(1).alias("copy")))
        assert copies.where("copy < 1 or copy > of").count() == 0 and copies.select("code", "copy").distinct().count() == copies.count()


def test_same_check_and_details(both, spark):
    """Counts, lists of edges with their threads, and edges that lead to nodes that are not there, or not back."""
    graph, plain, k, good = both
    assert inspect.check_graph(graph, k).collect() == inspect.check_graph(plain, k).collect()
    details = lambda g: inspect.details(g, types=["full", "half", "tip"], fields=("edges",))
    assert _rows(details(graph)) == _rows(details(plain).select(details(graph).columns))
    # a node goes, another one forgets its edges
    codes = [r.code for r in graph.coded.rows.where("ports != 0").orderBy("code").limit(9).collect()]
    rows = graph.coded.rows.where(F.col("code") != codes[1]).withColumn("ports", F.when(F.col("code") == codes[-1], 0).otherwise(F.col("ports")))
    rows = Workspace(spark, "faulty").put(rows, "rows")
    t = marks.Threads(good, k, graph.numbered.cap, rows)
    faulty = build.coded(rows, k, None, graph.starts, t)
    a = inspect.check_graph(faulty, k).first()
    b = inspect.check_graph(Graph(faulty.nodes, faulty.edges, t.spelled().localCheckpoint(), graph.starts), k).first()
    assert a == b and a.edges_missing > 0


def test_a_step_is_two_numbers(spark):
    """Where names are numbers only codes and tags are dealt, once for what concerns edges, and once more for nodes."""
    k = 5
    good = spark.createDataFrame([(str(i), s) for i, s in enumerate(some_reads(1, k)) if len(s) > k], "read string, seq string")
    rows = Workspace(spark, "bits").put(kmers.ported(good, k), "rows")
    t = marks.Threads(good, k, 250, rows)
    assert t.steps.where("name is not null").count() == 0
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert dealt(t.spelled(both=True)) == 1
    assert dealt(marks.node_classes(marks.judged(t.marks(), rows, k, 2), k)) == 2


def test_missing_names_are_one(spark):
    """Reads without a name count as one name, which is not written."""
    good = spark.createDataFrame([(None, "ACGTTGCAACGTAGGA"), (None, "ACGTTGCAACGTAGGA"), ("1", "ACGTTGCATTTTTTTTTGGG"), ("2", "CCGTTGCAACGTAGGA")], "read string, seq string")
    rows = Workspace(spark, "bits").put(kmers.ported(good, 5), "rows")
    t = marks.Threads(good, 5, 9, rows)
    found = t.spelled().collect()
    assert len(found) == len(set(found)) and any(r.read is None for r in found) and any(r.read == "1" for r in found)
    pairs = marks.port_pair_reads(t.marks(), 5).collect()
    assert all(0 <= r.weight - len(r.reads) <= 1 for r in pairs)


def test_messages_are_read_once(both, tmp_path):
    """Lines name what plain ones do; one pass over them, without a shuffle, gives the rows of all four tables."""
    graph, plain, k, good = both
    lines = sinks.coded_messages(graph.coded, graph.numbered.ports(), graph.starts).localCheckpoint()
    assert _rows(lines) == _rows(sinks.node_messages(plain))
    lines.write.text(str(tmp_path / "lines"))
    rows = sinks.coded_message_rows(good.sparkSession, str(tmp_path / "lines"), k)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()} == {t[:-1]: getattr(plain, t).count() for t in ("nodes", "edges", "threads", "starts")}
