"""Reads from files and tables, and simulated ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import rc
from ..storage import Workspace, ship

READS = "read string, seq string"
_OTHER = bytes(i for i in range(256) if i not in b"ACGT")


def read_sfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines ``name<TAB>sequence``; returns (reads, invalid lines), the latter not of exactly two fields."""
    line = spark.read.text(path).withColumn("f", F.split("value", "\t", -1))
    good = line.where(F.size("f") == 2).select(F.element_at("f", 1).alias("read"), F.element_at("f", 2).alias("seq"))
    return good, line.where(F.size("f") != 2).select("value")


def clean_name(header):
    """The header's first word, with ``[\\s:#-./]`` as underscores."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(header, "^[@>]", ""), r"\s"), 1), r"[\s:#\-./]", "_")


def read_fasta(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Records ``>name`` with one or many sequence lines."""
    text = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^(#[^\n]*\n|\\s)*>?", "")
    head = F.regexp_extract(record, r"^([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_extract(record, r"(?s)^[^\n]*\n(.*)$", 1), r"(?m)^#.*$|\s", "")
    out = text.select(F.concat(clean_name(head), F.lit(suffix)).alias("read"), F.upper(body).alias("seq"))
    return out.where("read != '' or seq != ''")


def read_fastq(spark: SparkSession, path: str, suffix: str = "") -> tuple[DataFrame, DataFrame]:
    """Four-line records ``@name``; returns (reads, malformed records).  Qualities are dropped.

    The file is split where a line begins with ``@``, so that large files stay splittable.
    A quality line that begins so comes as a part of its own, of one line, and its record
    lacks only that line.
    """
    part = spark.read.option("lineSep", "\n@").text(path)
    line = F.split(F.regexp_replace(F.regexp_replace("value", "^@", ""), "\\s+$", ""), "\r?\n")
    x = part.select(line.alias("l")).where(F.size("l") > 1)
    at = lambda i: F.try_element_at("l", F.lit(i))
    fits = F.coalesce(at(3).startswith("+") & ((F.size("l") == 3) | (F.size("l") == 4) & (F.length(at(2)) == F.length(at(4)))), F.lit(False))
    reads = x.select(F.concat(clean_name(at(1)), F.lit(suffix)).alias("read"), F.upper(at(2)).alias("seq"), fits.alias("fits"))
    return reads.where("fits").select("read", "seq"), reads.where("not fits").select("read", "seq")


def renumbered(reads: DataFrame) -> DataFrame:
    """Names replaced by hexadecimal numbers in the order of names; only counts of partitions are gathered."""
    # stored, so that the two uses below see the same partitions
    ordered = Workspace(reads.sparkSession, "names").put(reads.repartitionByRange("read").withColumn("part", F.spark_partition_id()), "ordered")
    ordered = ordered.withColumn("n", F.row_number().over(W.partitionBy("part").orderBy("read", "seq")))
    before = ordered.groupBy("part").count().withColumn("base", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    return ordered.join(F.broadcast(before), "part").select(F.hex(F.col("n") + F.col("base")).alias("read"), "seq")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of few files dealt over all cores, as its reads become many windows; a scan of enough partitions stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def from_text(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Reads derived from any text column: its letters A, C, G and T in upper case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq = [x.as_buffer().to_pybytes().translate(None, _OTHER).decode() for x in batch["seq"]]
            yield pa.RecordBatch.from_arrays([batch["read"], pa.array(seq, batch["seq"].type)], ["read", "seq"])

    ship(df.sparkSession)
    upper = df.select(F.col(key).cast("string").alias("read"), F.upper(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("seq"))
    return upper.mapInArrow(run, "read string, seq string")


def mates_of(reads: DataFrame, length: int, end: Column | None = None) -> DataFrame:
    """Two mates a read of at least twice the length: its beginning, and its end reverse-complemented, named _1 and _2.

    ``end`` has the second mates where they are at hand.
    """
    ok = reads.where(F.length("seq") >= 2 * length)
    one = F.struct(F.concat("read", F.lit("_1")).alias("read"), F.substring("seq", 1, length).alias("seq"))
    two = F.struct(F.concat("read", F.lit("_2")).alias("read"), (rc(F.right("seq", F.lit(length))) if end is None else end).alias("seq"))
    return ok.select(F.explode(F.array(one, two)).alias("m")).select("m.*")


def simulated(genome: DataFrame, length: int = 36, insert: int = 0) -> DataFrame:
    """Reads from every start position of genome(name, seq); with an insert size, both mates of each fragment.

    Names are ``name.start`` with starts from 1, and _1 and _2 for mates.  A sequence is
    turned once, and cut as bytes, where a slice costs no scan; one of other than ASCII
    letters, whose letters are not bytes, fragment by fragment.
    """
    span = insert if insert > 0 else length
    whole = genome.where(F.length("seq") >= span).select(
        "name", "seq", F.col("seq").cast("binary").alias("b"), rc(F.col("seq")).cast("binary").alias("rb"),
        F.length("seq").alias("n"), (~F.col("seq").rlike(r"[^\x00-\x7F]")).alias("ascii"),
    )
    at = whole.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - span + 1)).alias("start"))
    cut = lambda b, start, n: F.substr(b, start, F.lit(n)).cast("string")
    name = F.concat("name", F.lit("."), F.col("start").cast("string"))
    fragment = F.when(F.col("ascii"), cut("b", F.col("start"), span)).otherwise(F.substr("seq", F.col("start"), F.lit(span)))
    if insert <= 0:
        return at.select(name.alias("read"), fragment.alias("seq"))
    turned = F.when(F.col("ascii"), cut("rb", F.col("n") - F.col("start") - (span - 2), length)).otherwise(rc(F.right(fragment, F.lit(length))))
    return mates_of(at.select(name.alias("read"), fragment.alias("seq"), turned.alias("end")), length, F.col("end"))
