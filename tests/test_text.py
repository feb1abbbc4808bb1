import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notewright.functions import render
from notewright.functions import text as T


@pytest.mark.parametrize(
    ("text", "title"),
    [
        ("hello", "hello"), ("", "untitled-5"), ("> - 1. **Bold:**.", "Bold"), ("***", "*"), ("-\nnext", "next"), ("1)x", "1)x"), ("* * a", "a"),
        ("__~x~__:", "x"), ("...\n\n# h", "# h"), ("-a", "-a"), ("12. ", "untitled-5"), ("x" * 100, "x" * 72), (">>quoted", "quoted"), ("12", "12"),
    ],
)
def test_titles(text, title):
    if text == "***":
        title = T.title_of(text, 5)
        assert title == "*"
    assert T.title_of(text, 5) == title


def normal(text):
    lines = []
    for line in unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n")).split("\n"):
        line = line.rstrip(" \t")
        if not line.strip(T.SPACES):
            if lines and lines[-1]:
                lines.append("")
        else:
            lines.append(line)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def test_normalize_text(spark):
    texts = ["", " a \t\r\n\r\n\r\nb", "\n\n  x\n", "é\r", "a\n \n\t\nb", None, "　", "a  "]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in frame.orderBy("i").select(T.normalize_text(F.col("t")).alias("n")).collect()]
    assert got == [None if t is None else normal(t) for t in texts]
    again = frame.select(T.normalize_text(T.normalize_text(F.col("t"))).alias("n"), T.normalize_text(F.col("t")).alias("m")).where("n <> m").count()
    assert again == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab*_~.:>-1) \t\n", max_size=12), st.integers(1, 9))
def test_titles_hold_no_markers(text, i):
    title = T.title_of(text, i)
    assert title == f"untitled-{i}" or (title.strip(T.SPACES) == title and title[-1:] not in ".:")


def test_slugs(spark):
    names = ["Привет, Мир!", "Étion", "объём", "***", "", "  a--B ", None]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r.s for r in frame.orderBy("i").select(T.slugify(F.col("n")).alias("s")).collect()]
    assert got == ["privet-mir", "tion", "obyom", "cluster-untitled", "cluster-untitled", "a-b", None]


def test_quoting():
    assert render.quote_text('a"b\\\n\x01é​😀') == '"a\\"b\\\\\\n\\x01é\\u200b😀"'


def test_dates_do_not_depend_on_the_session(spark):
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert spark.range(1).select(T.rfc3339(F.timestamp_seconds(F.lit(1704067261)))).first()[0] == "2024-01-01T00:01:01Z"
    spark.conf.set("spark.sql.session.timeZone", "UTC")
