"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns
the documents it keeps, with their columns; the last returns packed pieces.  Stages are
written as Parquet and read again, so a lost executor costs one stage at most.

1. ``quality``: documents that the co-trained classifier scores below 0.5 go.
2. ``language``: documents without a recognisable language go: no letters at all, or a
   probability below 0.3.
3. ``near_duplicates``: of each group linked by a Jaccard similarity of 0.75 or more on
   five-word shingles, the document with the smallest id stays, whatever other texts have
   that id (rows of one id and one text are one document; of several texts of that id in
   the group one stays; documents without words are no duplicates of each other).
4. ``decontamination``: documents that hold a benchmark item go.
5. ``packing``: the rest as token sequences of at most 1024, each piece with its sequence.

Decisions are made on rows, never by ``doc_id`` alone: rows that share an id, or have
none, stand or fall by their own texts.  Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import jaccard, langid, leaks, packing, quality
from strandweave.llm.cluster import Workspace
from strandweave.llm.registry import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_QUALITY, LEAST_LANGUAGE = 0.5, 0.3


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), LEAST_QUALITY)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    return langid.recognised(docs, model, LEAST_LANGUAGE) if model.families else docs


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    group = jaccard.similar_documents(docs, k=5, num=75, den=100).select("doc_id", "text_key", "set_key", "first")
    group = Workspace(spark, "near-duplicates").put(group, "group")
    # of texts that differ in case or white space only, under one id, one stays
    several = group.where("first and set_key is not null").groupBy("doc_id", "set_key").agg(F.min("text_key").alias("least"), F.max("text_key").alias("most")).where("least != most")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("set_key") == F.col("set"))
    later = group.join(several.select(F.col("doc_id").alias("id"), F.col("set_key").alias("set"), "least"), same).where("text_key != least")
    gone = group.where("not first").select("doc_id", "text_key").union(later.select("doc_id", "text_key")).withColumnRenamed("doc_id", "gone_id").distinct()
    keyed = docs.withColumn("text_key", jaccard.text_key(F.col("text")))
    kept = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (keyed["text_key"] == gone["text_key"]), "left_anti").select(*docs.columns)
    # only if a document has several rows are they made one
    repeated = group.where("first and set_key is not null").groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count() > 0
    if not repeated:
        return kept
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return kept.where(worded).dropDuplicates(["doc_id", "text"]).union(kept.where(~worded))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), capacity=1024, end_id=2, with_ids=False)


STAGES = [
    ("quality", drop_low_quality),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; each stage is stored in the shared folder."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = work.put(stage(spark, docs, sf_dir), name)
    return docs


#: Classifiers and packing are beyond SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
