"""Text functions on columns: normal form, hash, ids, titles, slugs.

All are built-in expressions, but for the Unicode normal form and the exact title, which Spark has no
function for: these are Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The code points with the property White_Space, as a character class of both regex
#: dialects in use.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TITLE_LENGTH = 72
#: Latin spellings of Cyrillic letters.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
EMPTY_SLUG = "cluster-untitled"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def trim_spaces(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def normalize_text(text: Column) -> Column:
    """Line ends as \\n, NFC, no spaces or tabs at line ends, runs of blank lines as one, none at the
    start or end.  Indents stay.  Null stays null."""
    lines = F.split(F.regexp_replace(nfc(F.regexp_replace(text, "\r\n", "\n")), "\r", "\n"), "\n")
    clean = F.transform(lines, lambda x: F.when(x.rlike(rf"\A{SPACE}*\z"), "").otherwise(F.regexp_replace(x, r"[ \t]+\z", "")))
    joined = F.regexp_replace(F.array_join(clean, "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(joined, r"\A\n+|\n+\z", "")


def exact_hash(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def note_id(chat: Column, msg_id: Column) -> Column:
    """``chat:id``; null unless the chat is not blank and the id over 0."""
    good = (trim_spaces(chat) != "") & (msg_id > 0)
    return F.when(good, F.concat_ws(":", chat, msg_id.cast("string")))


def title_of(normalized: str | None, msg_id: int) -> str:
    """The first line that holds more than markers, in short.

    Quote signs and list markers go from its start; then, until nothing changes, full stops and colons
    from its end and equal emphasis signs from both ends.
    """
    for line in (normalized or "").split("\n"):
        rest = line.strip(SPACES)
        while rest:
            cut = _after_marker(rest)
            if cut is None:
                break
            rest = cut.strip(SPACES) if rest[0] == ">" else cut.lstrip(SPACES)
        while True:
            shorter = rest.rstrip(".:")
            while len(shorter) > 2 and shorter[0] == shorter[-1] and shorter[0] in "*_~":
                shorter = shorter[1:-1]
            shorter = shorter.strip(SPACES)
            if shorter == rest:
                break
            rest = shorter
        if rest:
            return rest[:TITLE_LENGTH]
    return f"untitled-{msg_id}"


def _after_marker(text: str) -> str | None:
    """What follows a quote sign or list marker at the start; None without one."""
    if text[0] == ">":
        return text[1:]
    digits = len(text) - len(text.lstrip("0123456789"))
    end = 1 if text[0] in "-*+" else digits + 1 if digits and text[digits : digits + 1] in (".", ")") and digits < len(text) else 0
    if not end or text[end : end + 1] not in ("", " ", "\t"):
        return None
    return text[end:]


@F.pandas_udf(StringType())
def derive_title(normalized: pd.Series, msg_id: pd.Series) -> pd.Series:
    return pd.Series([title_of(t, i) for t, i in zip(normalized, msg_id, strict=True)], dtype=object)


def slugify(name: Column) -> Column:
    """Lower-case ASCII letters and digits, Cyrillic spelled in Latin, all else as single hyphens."""
    upper = {k.upper(): v for k, v in CYRILLIC.items()}
    single = {k: v for k, v in (CYRILLIC | upper).items() if len(v) == 1}
    out = F.translate(name, "".join(single) + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(single.values()) + "abcdefghijklmnopqrstuvwxyz")
    for k, v in (CYRILLIC | upper).items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", EMPTY_SLUG).otherwise(out)


def numeric_suffix(note: Column) -> Column:
    """The positive number after the last colon, else null: the sort key of notes."""
    n = F.nullif(F.regexp_extract(note, r":([0-9]+)$", 1), F.lit("")).try_cast("bigint")
    return F.when(n > 0, n)


def safe_stem(stem: Column) -> Column:
    """Fit for a file name: no white space around, not empty, no path parts or control characters."""
    control = r"[\x{00}-\x{1F}\x{7F}-\x{9F}]"
    return (trim_spaces(stem) == stem) & ~stem.isin("", ".", "..") & ~stem.rlike(r"[/\\]") & ~stem.rlike(control)


def managed_path(path: Column) -> Column:
    """Whether a file of the vault is one of those that materialisation writes, and may remove."""
    topic = path.startswith("topics/")
    sidecar = path.startswith("_meta/embeddings/") & path.endswith(".json")
    index = topic & path.endswith("/index.md")
    note = topic & path.endswith(".md") & F.element_at(F.split(path, "/"), -1).contains(":")
    return sidecar | index | note


def masked_phone(phone: Column) -> Column:
    return F.when(F.length(phone) > 4, F.concat(F.lit("***"), F.right(phone, F.lit(4)))).otherwise(phone)


def rfc3339(ts: Column) -> Column:
    """UTC, to the second, whatever the session's time zone."""
    plain = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_seconds(ts).cast("decimal(18,6)"))
    return F.concat(F.replace(plain.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
