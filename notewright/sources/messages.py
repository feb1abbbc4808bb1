"""Messages: wire records to canonical rows, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from notewright.functions.text import trim_spaces


def scan_history(records: DataFrame, after_id: int = 0, most: int | None = 5000) -> DataFrame:
    """The newest ``most`` records with an id over ``after_id`` (and over 0), newest first.

    The bound on the id is a predicate that reaches the file scan; the limit is a top-n, not a sort.
    """
    rows = records.where(F.col("source_msg_id") > max(0, after_id)).orderBy(F.col("source_msg_id").desc())
    return rows if most is None else rows.limit(most)


def map_wire(wire: DataFrame) -> DataFrame:
    """Wire columns (epoch seconds, forward header, peers, media) to record columns."""
    label = F.when(F.col("fwd_peer_kind").isin("user", "chat", "channel"), F.concat_ws(":", "fwd_peer_kind", F.col("fwd_peer_id").cast("string")))
    return wire.where("variant = 'message'").select(
        "source_chat", "source_msg_id", F.timestamp_seconds("date_epoch").alias("date_utc"), F.lit("message").alias("kind"), "text",
        F.coalesce(not_blank(F.col("fwd_name")), not_blank(F.col("fwd_author")), F.when(F.col("fwd_peer_id").isNotNull(), label)).alias("forwarded_from"),
        F.when(F.col("reply_to") > 0, F.col("reply_to")).alias("reply_to_source_msg_id"),
        F.when(F.col("edit_epoch") > 0, F.timestamp_seconds("edit_epoch")).alias("edited_at_utc"),
        F.when(F.col("media") != "empty", F.col("media")).alias("media_kind"), "is_outgoing",
    )


def not_blank(text: Column) -> Column:
    return F.nullif(trim_spaces(text), F.lit(""))


def content_filter(records: DataFrame, include_all: bool = False) -> DataFrame:
    """Plain messages; unless all are wanted, only those with text and without media."""
    kept = F.col("kind") == "message"
    return records.where(kept if include_all else kept & (trim_spaces(F.col("text")) != "") & F.col("media_kind").isNull())


def violations(messages: DataFrame) -> DataFrame:
    """Rows that break a rule, with the first rule they break."""
    rules = [
        ("chat is blank", F.coalesce(trim_spaces(F.col("source_chat")), F.lit("")) == ""),
        ("id is not positive", ~F.coalesce(F.col("source_msg_id") > 0, F.lit(False))),
        ("date is missing", F.col("date_utc").isNull() | (F.unix_seconds("date_utc") == 0)),
        ("edited before date", F.coalesce(F.col("edited_at_utc") < F.col("date_utc"), F.lit(False))),
        ("reply id is not positive", F.coalesce(F.col("reply_to_source_msg_id") <= 0, F.lit(False))),
    ]
    found = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules])
    return messages.withColumn("rule", found).where("rule is not null").select("source_chat", "source_msg_id", "rule")


def validated(messages: DataFrame) -> DataFrame:
    """The messages; evaluating them fails at the first row that breaks a rule."""
    bad = violations(messages).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].source_chat}:{bad[0].source_msg_id}: {bad[0].rule}")
    return messages


def latest_versions(records: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One row for each message: the last edited, then the last dated, then the first to arrive."""
    order = W.partitionBy("source_chat", "source_msg_id").orderBy(F.col("edited_at_utc").desc_nulls_last(), F.col("date_utc").desc(), F.col(arrival).asc())
    return records.withColumn("version", F.row_number().over(order)).where("version = 1").drop("version")


def parse_target(raw: Column) -> Column:
    """A chat's address as struct<kind, id, access_hash, username>, with kind null if it is none."""
    text = trim_spaces(raw)
    prefix = F.lower(trim_spaces(F.regexp_extract(text, r"^([^:]*):", 1)))
    payload = trim_spaces(F.regexp_extract(text, r"(?s)^[^:]*:(.*)$", 1))
    has_prefix = text.contains(":")

    def number(x: Column) -> Column:
        return F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("bigint"))

    def built(kind, id_=None, access=None, name=None) -> Column:
        as_long = lambda v: F.lit(None).cast("long") if v is None else v.cast("long")
        return F.struct(
            (F.lit(kind) if isinstance(kind, str) or kind is None else kind).cast("string").alias("kind"), as_long(id_).alias("id"),
            as_long(access).alias("access_hash"), F.lit(None).cast("string").alias("username") if name is None else name.alias("username"),
        )

    def chat(x: Column) -> Column:
        n, channel = number(x), number(trim_spaces(F.regexp_extract(x, r"(?s)^-100(.*)$", 1)))
        return F.when(n > 0, built("chat", n)).when(n.isNotNull() & (channel > 0), built("channel_peer_id", channel)).otherwise(built(None))

    def named(x: Column) -> Column:
        return F.when(x != "", built("username", name=x)).otherwise(built(None))

    def hashed(kind: str) -> Column:
        id_, access = number(trim_spaces(F.regexp_extract(payload, r"(?s)^([^:]*):", 1))), number(trim_spaces(F.regexp_extract(payload, r"(?s)^[^:]*:(.*)$", 1)))
        return F.when((id_ > 0) & access.isNotNull(), built(kind, id_, access)).otherwise(built(None))

    return (
        F.when(text == "", built(None))
        .when(text.startswith("@"), named(trim_spaces(F.substr(text, F.lit(2)))))
        .when(has_prefix & (prefix == "username"), named(trim_spaces(F.regexp_replace(payload, "^@", ""))))
        .when(has_prefix & (prefix == "chat"), chat(payload))
        .when(has_prefix & (prefix == "user"), hashed("user"))
        .when(has_prefix & (prefix == "channel"), hashed("channel"))
        .when(number(text).isNotNull(), chat(text))
        .otherwise(named(text))
    )
