"""The corpus pipeline: toxicity, language, near-duplicates, mixing to target weights, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all its predecessor kept; each result
is written as Parquet to the shared folder and read again, so a stage never recomputes another and a
lost executor costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import common, language_id, mixing, near_dedup, packing, toxicity

#: Ids that are broadcast to take rows out; a larger set is joined by a shuffle.
BROADCAST_IDS = 250_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts toxic go.  The model learns the labelled documents
    of the contract's training fold.  Null and empty texts are not toxic and stay; rows stay as often
    as they come; an empty table gives an empty one."""
    labels = common.table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or in none of the languages learned, go;
    with no language to learn from, all go."""
    models = language_id.fit(docs.where(~F.coalesce(language_id.held_out(), F.lit(False))))
    return language_id.accepted(docs, models)


def row_key():
    """Names a document by id and text, in the order of ids, rows without an id last: one id may be on several texts."""
    order = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.coalesce(order, F.lit("null")), F.lpad(F.hex(F.xxhash64("text")), 16, "0"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least id.

    An id may be on several texts, and a row without an id is named by its text; exact repeats of a
    row count as one.  Texts without a word are near nothing and all stay."""
    keyed = docs.withColumn("row_key", row_key())
    found = near_dedup.near_duplicates(keyed, key="row_key")
    found = common.Tables(spark, "groups").put("found", found.select("row_key", "kept"))
    dropped = found.where("not kept").select("row_key").distinct()
    again = found.where("kept").groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_key")

    def bounded(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids

    out = bounded(dropped.unionByName(again))
    single = keyed.join(out, "row_key", "left_anti")
    # Rows that repeat a kept document: one of them stays.
    repeated = keyed.join(bounded(again), "row_key", "left_semi").dropDuplicates(["row_key"])
    return single.unionByName(repeated).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken.

    Texts without a word are taken 0 times; rows without a source are a source of their own; repeated
    rows are taken alike; an empty table gives an empty one."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences: the result of the pipeline.

    A null text is an empty one, which is its end id alone; repeated rows and rows without an id are
    documents of their own; an empty table gives no piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Models, hashes and packing are not SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    tables = common.Tables(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tables.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
