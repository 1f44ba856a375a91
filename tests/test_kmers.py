"""Windows as numbers, against those as letters."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import build, kmers, threads

from . import sequential as S
from .test_graph import graph_of, reads_df


def some_reads(seed, k):
    """Reads with repeats inside, on both strands, and steps that are their own mirrors."""
    rng = random.Random(seed)
    word = ["".join(rng.choices("ACGT", k=rng.randint(k - 1, 2 * k))) for _ in range(6)]
    reads = ["".join(rng.choice([w, S.rc(w)]) for w in rng.choices(word, k=rng.randint(2, 9))) for _ in range(60)]
    return [*reads, "A" * (3 * k), word[0] + S.rc(word[0]), "AC" * k, "ACGT"[: k // 2]]


@pytest.mark.parametrize(("k", "cap", "held"), [(3, 4, 10**6), (5, 250, 50), (15, 2, 400), (29, 250, 10**6)])
def test_codes_give_what_letters_give(spark, monkeypatch, k, cap, held):
    monkeypatch.setattr(kmers, "HELD", held)
    good = reads_df(spark, [s for s in some_reads(k, k) if len(s) > k])
    of = lambda: [sorted(map(tuple, f.collect())) for f in (build.nodes(good, k), build.edges(good, k), build.chunk_tags(good, k), build.edge_threads(good, k, cap), build.edge_threads(good, k, cap, True))]
    assert kmers.fits(k)
    coded = of()
    monkeypatch.setattr(kmers, "fits", lambda _: False)
    assert coded == of()
    assert all(len(rows) > 20 for rows in coded)


def test_steps_are_shuffled_once(spark):
    """Tags need no exchange, and threads one of the steps, by their edges' codes."""
    good = reads_df(spark, some_reads(1, 5))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(build.chunk_tags(good, 5)).replace("BroadcastExchange", "")
    dealt = [line for line in plan(build.edge_threads(good, 5, 250)).splitlines() if "Exchange hashpartitioning" in line]
    # distinct edges, the bases after each K-mer, branching edges, and the steps to these
    assert len(dealt) == 4 and not any("read" in line for line in dealt)


def test_rows_left_out_are_those_no_end_can_need(spark):
    """An edge that all reads of a task share keeps each end's first names there, and little more."""
    good = reads_df(spark, ["ACGGTCATTG"] * 300 + ["CAATGACCGT"] * 300).coalesce(1)
    left = kmers.tagged_steps(good, 5, 4).groupBy("code").count().agg(F.max("count")).first()[0]
    assert left <= 8
    assert sorted(map(tuple, build.edge_threads(good, 5, 4, True).collect())) == sorted(
        (r.node_id, r.sdir, r.ddir, r.dst, n) for r in build.edges(good, 5).withColumnRenamed("src", "node_id").collect() for n in ("r0", "r1", "r10", "r100")
    )


def test_threads_are_dealt_by_node_once(spark):
    """Both ends' threads and the ports of their nodes meet by node; weights need no other exchange."""
    g = graph_of(spark, [("x", "ACG", 1.0)], [("x", "f", "f", "y"), ("x", "r", "f", "z")], [("x", "f", "f", "y", "a"), ("z", "r", "f", "x", "a"), ("x", "f", "r", "y", "b")])
    w = threads.port_pair_weights(threads.symmetrised(g))
    assert [tuple(r) for r in w.collect()] == [("x", "f", "y", "f", "z", 1)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = threads.port_pair_weights(threads.symmetrised(g))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
