"""A snapshot on disk: tables, and one JSON document that other tools read."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from notewright.config import DEFAULT_PROFILE, NORMALIZATION_RULE
from notewright.functions.text import trim_spaces
from notewright.functions.vectors import normalize_l2

NOTES = "id string, source_chat string, source_msg_id long, title string, body string, hash string, embedding_id string, embedding array<float>, cluster_id string, tags array<string>, created_at timestamp, updated_at timestamp, duplicate_of string"
CLUSTERS = "id string, name string, slug string, centroid array<float>, note_ids array<string>, created_at timestamp, updated_at timestamp"
HEADER = "schema_version int, model_id string, model_hash string, model_profile string, normalization_rule string, vector_dimension int, last_run_utc timestamp"
FIELDS = ("schema_version", "model_id", "model_hash", "model_profile", "normalization_rule", "vector_dimension", "last_run_utc", "notes", "clusters", "run_metadata")


def save_tables(notes: DataFrame, clusters: DataFrame, path: str) -> None:
    notes.write.mode("overwrite").parquet(f"{path}/notes")
    clusters.write.mode("overwrite").parquet(f"{path}/clusters")


def load_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(NOTES).parquet(f"{path}/notes"), spark.read.schema(CLUSTERS).parquet(f"{path}/clusters")


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Header, notes and clusters of a JSON snapshot.

    Fields that the format does not have are refused at every level, and so is anything after the
    document.  Vectors are normalized again, blank rule and
    profile get their defaults, and a body that differs from its hash fails when it is read.
    """
    with_text = spark.read.text(path, wholetext=True)
    faults = with_text.select(_fault("value").alias("f")).where("f is not null").collect()
    if faults:
        raise ValueError(faults[0].f)
    names = with_text.select(F.explode(F.json_object_keys("value")).alias("k")).where(~F.col("k").isin(*FIELDS))
    parts = with_text.select(F.from_json("value", "notes array<string>, clusters array<string>").alias("d"))
    for part, ddl in (("notes", NOTES), ("clusters", CLUSTERS)):
        keys = parts.select(F.explode(f"d.{part}").alias("row")).select(F.explode(F.json_object_keys("row")).alias("k"))
        names = names.unionByName(keys.where(~F.col("k").isin(*[x.split(" ")[0] for x in ddl.split(", ")])).select(F.concat(F.lit(f"{part}."), "k").alias("k")))
    names = names.distinct().limit(20).collect()
    if names:
        raise ValueError(f"unknown fields {sorted(r.k for r in names)}")
    schema = HEADER + f", notes array<struct<{_struct(NOTES)}>>, clusters array<struct<{_struct(CLUSTERS)}>>, run_metadata string"
    doc = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    blank = lambda c, default: F.coalesce(F.nullif(trim_spaces(F.col(c)), F.lit("")), F.lit(default))
    header = doc.select("schema_version", "model_id", "model_hash", blank("model_profile", DEFAULT_PROFILE).alias("model_profile"), blank("normalization_rule", NORMALIZATION_RULE).alias("normalization_rule"), "vector_dimension", "last_run_utc")
    notes = doc.select(F.inline("notes")).withColumn("embedding", normalize_l2(F.col("embedding")))
    sound = F.when(F.sha2("body", 256) == F.col("hash"), F.col("body")).otherwise(F.raise_error(F.concat(F.lit("body differs from its hash: "), "id")))
    clusters = doc.select(F.inline("clusters")).withColumn("centroid", normalize_l2(F.col("centroid")))
    return header, notes.withColumn("body", sound), clusters


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split(" ", 1) for x in ddl.split(", ")))


def document_lines(header: dict, notes: DataFrame, clusters: DataFrame, run_metadata: dict) -> Iterator[str]:
    """The JSON document in parts; notes and clusters are sorted by id.  It is one file by nature, so
    its rows pass through the driver, one at a time."""
    indented = lambda value, by: json.dumps(value, indent=2, ensure_ascii=False).replace("\n", "\n" + " " * by)

    def rows(df: DataFrame) -> Iterator[str]:
        first = True
        for r in df.orderBy("id").select(F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})).toLocalIterator():
            yield ("" if first else ",") + "\n    " + indented(json.loads(r[0]), 4)
            first = False
        yield "]" if first else "\n  ]"

    yield "{"
    for name, value in header.items():
        yield f"\n  {json.dumps(name)}: {indented(value, 2)},"
    yield '\n  "notes": ['
    yield from rows(notes)
    yield ',\n  "clusters": ['
    yield from rows(clusters)
    yield f',\n  "run_metadata": {indented(run_metadata, 2)}\n}}\n'


def document(header: dict, notes: DataFrame, clusters: DataFrame, run_metadata: dict) -> str:
    return "".join(document_lines(header, notes, clusters, run_metadata))


@F.pandas_udf(StringType())
def _fault(text: pd.Series) -> pd.Series:
    """What keeps a text from being one JSON document: null, or in words."""

    def fault(t: str) -> str | None:
        try:
            json.loads(t)
        except json.JSONDecodeError as e:
            return f"data after the document at {e.pos}" if e.msg == "Extra data" else str(e)
        return None

    return text.map(fault)
