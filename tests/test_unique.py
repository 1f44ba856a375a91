"""Unique contigs of a graph with bits, against those of the same graph as plain tables."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandweave.operators import build, kmers, mates
from strandweave.params import Params
from strandweave.storage import Workspace

READS = [("a_1", "ACGTTGCAACGTAGGA"), ("a_1", "ACGTTGCAACGTAGGA"), ("a_2", "TTGACCATGGTCAATTGACC"), (None, "GGATCCTACGTA"), ("b_1", None), ("b_2", ""), ("c_1", "ACG"), ("c_2", "TTTTTTTTTTTT")]


def graphs(spark, k):
    good = build.clean_reads(spark.createDataFrame(READS, "read string, seq string"), Params(k=k))
    graph = build.coded(Workspace(spark, "unique").put(kmers.ported(good, k), "rows"), k, None, build.read_starts(good, k, 9))
    return graph, replace(graph, nodes=build.nodes(good, k), coded=None)


@pytest.mark.parametrize("k", [3, 5, 7])
def test_same_contigs(spark, k):
    graph, plain = graphs(spark, k)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for low, high, least in ((1.0, 3.0, k), (2.0, 2.0, k - 1), (0.0, 1.5, k), (1.0, 3.0, k + 1), (4.0, 99.0, 0), (3.0, 1.0, 0)):
        p = Params(k=k, min_unique_cov=low, max_unique_cov=high, min_unique_len=least)
        got = mates.unique_contigs(graph, p)
        assert got.dtypes == mates.unique_contigs(plain, p).dtypes
        assert rows(got) == rows(mates.unique_contigs(plain, p))
        assert rows(mates.mate_ends(graph, p)) == rows(mates.mate_ends(plain, p))
    assert mates.unique_contigs(graph, Params(k=k, max_unique_cov=2.0)).count()


def test_letters_are_written_for_what_fits(spark):
    """Nodes are chosen by their numbers, and no letter is looked up alone."""
    plan = mates.unique_contigs(graphs(spark, 5)[0], Params(k=5, min_unique_cov=1.0, max_unique_cov=3.0))._jdf.queryExecution().optimizedPlan().toString()
    chosen = next(line for line in plan.splitlines() if "Filter" in line)
    assert "cov" in chosen and "length(" not in chosen and "conv(" not in chosen
    assert "translate(" not in plan


@pytest.mark.parametrize("w", [1, 3, 4, 5, 15, 16, 31])
def test_spelled(spark, w):
    rng = random.Random(w)
    codes = [0, 4**w - 1, *(rng.randrange(4**w) for _ in range(50))]
    df = spark.createDataFrame([(c,) for c in [*codes, None]], "code long")
    got = df.select("code", kmers.spelled(F.col("code"), w), kmers.letters(F.col("code"), w)).collect()
    assert all(b == c for _, b, c in got)
    assert {r[0]: r[1] for r in got if r[0] is not None} == {c: "".join("ACGT"[c >> 2 * i & 3] for i in reversed(range(w))) for c in codes}
