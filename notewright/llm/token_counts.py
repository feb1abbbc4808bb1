"""Operator 5: how many tokens each whole text has."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import common, tokens

TOKEN_LIMIT = 512


def count_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", limit: int = TOKEN_LIMIT, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Adds up the tokens of every whole text by the whole-token shortcut (see :mod:`tokens`).

    One narrow pass, no shuffle.  Returns ``key, n_bytes, n_tokens, over_limit``; other columns of
    ``docs`` are not read, so their names cannot clash.  Null and empty texts have 0 bytes and 0
    tokens, null keys stay null, repeated rows give repeated rows, an empty table an empty result.
    Texts of any length are handled whole, a few at a time.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    path = tokens.vocabulary_path(vocabulary)
    whole = spark.sparkContext.broadcast(tokens.whole_tokens(path))  # bounded by the vocabulary

    def counted(batch: pa.RecordBatch) -> dict[str, object]:
        chunks = tokens.worker_chunks(tokens.vocabulary_path(vocabulary), whole.value, ids=False)
        return {"key": batch.column(0), "n_bytes": batch.column(1), "n_tokens": chunks.texts(common.texts_of(batch.column(2)))}

    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("key", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    out = rows.mapInArrow(common.by_batch(counted, schema), f"key {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
