"""Packed sequences, a batch at once."""

import time

from pyspark.sql import functions as F

from strandweave.functions import sequence as Q


def test_pack_takes_time_in_line_with_length(spark):
    """A null, which counts as empty, odd and even lengths; half a million bases in one value, which took time with the square of its length."""
    long = "ACGTTGCAAC" * 50_000 + "G"
    some = [None, "", "A", "T", "AC", "TTT", "ACGTACG", long]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(some)], "i int, s string").repartition(3)
    began = time.monotonic()
    rows = {r["i"]: r for r in df.select("i", "s", Q.pack(F.col("s")).alias("p")).select("i", "s", "p", Q.unpack(F.col("p")).alias("u")).collect()}
    assert time.monotonic() - began < 60
    assert [rows[i]["u"] for i in range(len(some))] == ["", *some[1:]]
    assert [rows[i]["p"] for i in range(7)] == ["", "", "A", "P", "C", "TP", "COCK"]
    assert len(rows[7]["p"]) == 250_001
