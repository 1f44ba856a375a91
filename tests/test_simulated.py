"""Simulated reads, against cutting every fragment from its text."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions.sequence import rc
from strandweave.sources import reads as sources


def genome(spark):
    rng = random.Random(1)
    dna = "".join(rng.choices("ACGT", k=60))
    plain = [("a", dna), ("a", dna), (None, dna[:25]), ("b", None), ("c", ""), ("d", "ACGTACG"), ("e", "ACGTACGT"), ("f", "acgtNNRY-ACGTTT\nA"), ("", "A" * 20)]
    other = [("é", "ACGTé𝄞TTGACAGGTé"), ("g", "éééééé𝄞"), ("h", "Ａ" * 9)]
    broken = spark.range(1).select(F.lit("i").alias("name"), F.expr("cast(X'41434754C341F09F434754414347E9A354' as string)").alias("seq"))
    return spark.createDataFrame(plain + other, "name string, seq string").union(broken)


def by_text(genome, length, insert):
    span = insert or length
    at = genome.where(F.length("seq") >= span).select("*", F.explode(F.sequence(F.lit(1), F.length("seq") - span + 1)).alias("start"))
    reads = at.select(F.concat("name", F.lit("."), F.col("start").cast("string")).alias("read"), F.substr("seq", "start", F.lit(span)).alias("seq"))
    if not insert:
        return reads
    two = reads.where(F.length("seq") >= 2 * length)
    one = two.select(F.concat("read", F.lit("_1")).alias("read"), F.substring("seq", 1, length).alias("seq"))
    return one.union(two.select(F.concat("read", F.lit("_2")).alias("read"), rc(F.right("seq", F.lit(length)))))


def as_bytes(reads):
    return sorted(reads.select("read", F.hex(F.encode("read", "utf-8")), F.hex(F.col("seq").cast("binary"))).collect(), key=str)


@pytest.mark.parametrize(("length", "insert"), [(3, 8), (4, 8), (8, 8), (1, 2), (5, 0), (8, 0)])
def test_odd_genomes(spark, length, insert):
    some = genome(spark)
    got = sources.simulated(some, length, insert)
    assert got.columns == ["read", "seq"]
    assert as_bytes(got) == as_bytes(by_text(some, length, insert))
    assert bool(got.count()) == (insert == 0 or insert >= 2 * length)


def test_a_sequence_is_turned_before_it_is_cut(spark):
    """What lies below the starts has the sequence turned whole, and starts are cut from bytes."""
    reads = sources.simulated(spark.createDataFrame([("a", "ACGT")], "name string, seq string"), 36, 100)
    plan = reads._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode(sequence(", 1)
    assert "cast(translate(reverse(seq" in below
    assert "cast(substr(b#" in above and "cast(substr(rb#" in above


def test_mates_without_ends_are_turned(spark):
    reads = spark.createDataFrame([("a", "AACCGGTTAC"), (None, "AACCGG"), ("b", "AACCG"), ("c", None)], "read string, seq string")
    assert sorted(map(tuple, sources.mates_of(reads, 3).collect()), key=str) == sorted([("a_1", "AAC"), ("a_2", "GTA"), (None, "AAC"), (None, "CCG")], key=str)
