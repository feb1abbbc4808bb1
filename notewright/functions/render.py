"""The texts that a snapshot is written as."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from notewright.functions.text import rfc3339


#: What stands between a text and those of its duplicates.
ADDITIONS = "\n\n## Additions\n\n"


def bullet(text: Column) -> Column:
    return F.concat(F.lit("- "), F.replace(text, F.lit("\n"), F.lit("\n  ")))


def master_body(title: Column, text: Column, additions: Column) -> Column:
    """A heading, the text, and what duplicates add."""
    head = F.concat(F.lit("# "), title, F.when(text != "", F.concat(F.lit("\n\n"), text)).otherwise(""))
    more = F.concat(F.lit(ADDITIONS), F.array_join(F.transform(additions, bullet), "\n"))
    return F.concat(head, F.when(F.size(additions) > 0, more).otherwise(""))


def quote_text(text: str) -> str:
    """In double quotes; printable characters stay, others are escaped."""
    short = {'"': '\\"', "\\": "\\\\", "\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}
    out = []
    for c in text:
        n = ord(c)
        if c in short:
            out.append(short[c])
        elif c == " " or c.isprintable():
            out.append(c)
        else:
            out.append(f"\\x{n:02x}" if n < 128 else f"\\u{n:04x}" if n < 0x10000 else f"\\U{n:08x}")
    return '"' + "".join(out) + '"'


@F.pandas_udf(StringType())
def quoted(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else quote_text(t))


def literal_block(body: Column) -> Column:
    return F.array_join(F.transform(F.split(body, "\n"), lambda x: F.when(x != "", F.concat(F.lit("  "), x)).otherwise("")), "\n")


def tag_list(tags: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(tags, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", "), F.lit("]"))


def note_markdown(c) -> Column:
    """A note's file from its columns; ``c`` maps a name to a column."""
    fields = [
        ("id", c("id")), ("source_chat", quoted(c("source_chat"))), ("source_msg_id", c("source_msg_id").cast("string")),
        ("title", quoted(c("title"))), ("body", F.concat(F.lit("|-\n"), literal_block(c("body")))), ("hash", c("hash")),
        ("embedding_id", c("embedding_id")), ("cluster_id", c("cluster_id")), ("tags", tag_list(c("tags"))),
        ("created_at", rfc3339(c("created_at"))), ("updated_at", rfc3339(c("updated_at"))), ("duplicate_of", quoted(c("duplicate_of"))),
    ]
    lines = [x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit("\n"))]
    return F.concat(F.lit("---\n"), *lines, F.lit("---\n"), c("body"))
