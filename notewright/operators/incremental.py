"""Merging newly fetched messages with the notes of the previous snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.functions import text as T

COLUMNS = ("source_chat", "source_msg_id", "date_utc", "text", "edited_at_utc")


def new_messages(fetched: DataFrame, previous: DataFrame) -> DataFrame:
    """Fetched messages that no previous note stands for."""
    keyed = fetched.withColumn("note_id", T.note_id(F.col("source_chat"), F.col("source_msg_id")))
    return keyed.join(previous.select(F.col("id").alias("note_id")), "note_id", "left_anti")


def rebuilt(previous: DataFrame, fetched: DataFrame, text: str = "body") -> DataFrame:
    """Previous notes as messages: as fetched again, else from body, title or id, with their vector.

    With ``text="source"`` the heading and additions that rendering put into a body are taken off
    again, so that a run over a rebuilt note renders the same body.
    """
    again = fetched.select(F.concat_ws(":", "source_chat", F.col("source_msg_id").cast("string")).alias("id"), F.col("text").alias("new_text"), F.col("date_utc").alias("new_date"), F.col("edited_at_utc").alias("new_edit"))
    filled = lambda c: F.nullif(T.trim_spaces(F.col(c)), F.lit(""))
    plain = filled("body")
    if text == "source":
        inner = F.regexp_replace(F.col("body"), r"\A# [^\n]*(?:\n\n|\z)", "")
        inner = F.regexp_replace(inner, r"(?s)(?:\A|\n\n)## Additions\n\n- .*\z", "")
        plain = F.coalesce(F.nullif(T.trim_spaces(inner), F.lit("")), plain)
    out = previous.join(again, "id", "left")
    return out.select(
        "source_chat", "source_msg_id", F.coalesce("new_date", "created_at").alias("date_utc"),
        F.coalesce("new_text", plain, filled("title"), "id").alias("text"), F.col("new_edit").alias("edited_at_utc"), "embedding",
    )


def merged(previous: DataFrame, fetched: DataFrame, encode, text: str = "body") -> DataFrame:
    """Previous notes with the vectors that they have, and new messages encoded; ``encode`` adds
    ``embedding`` to messages.  Known messages are not encoded again."""
    fresh = encode(new_messages(fetched, previous).select(*COLUMNS))
    return rebuilt(previous, fetched, text).unionByName(fresh.select(*COLUMNS, "embedding"))
