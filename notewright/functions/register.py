"""The engine's functions under their names in Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from notewright.functions import text as T

_SPACE = T.SPACE.replace("\\", "\\\\")


def slug_sql(name: str) -> str:
    """The expression of :func:`notewright.functions.text.slugify` in SQL."""
    both = T.CYRILLIC | {k.upper(): v for k, v in T.CYRILLIC.items()}
    single = {k: v for k, v in both.items() if len(v) == 1}
    out = f"translate({name}, '{''.join(single)}ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{''.join(single.values())}abcdefghijklmnopqrstuvwxyz')"
    for k, v in both.items():
        if len(v) != 1:
            out = f"replace({out}, '{k}', '{v}')"
    out = f"regexp_replace(regexp_replace({out}, '[^a-z0-9]+', '-'), '^-+|-+$', '')"
    return f"if({out} = '', '{T.EMPTY_SLUG}', {out})"


def register(spark: SparkSession) -> None:
    """Makes ``normalize_text``, ``derive_title``, ``slugify`` and ``dot`` callable in SQL of this session."""
    spark.udf.register("nfc_text", T.nfc)
    spark.udf.register("derive_title", T.derive_title)
    lines = "split(regexp_replace(nfc_text(regexp_replace(t, '\\r\\n', '\\n')), '\\r', '\\n'), '\\n')"
    clean = f"transform({lines}, x -> if(x rlike '\\\\A{_SPACE}*\\\\z', '', regexp_replace(x, '[ \\\\t]+\\\\z', '')))"
    body = f"regexp_replace(regexp_replace(array_join({clean}, '\\n'), '\\n{{3,}}', '\\n\\n'), '\\\\A\\n+|\\n+\\\\z', '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(t STRING) RETURNS STRING RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION slugify(t STRING) RETURNS STRING RETURN {slug_sql('t')}")
    least = "least(size(a), size(b))"
    products = f"zip_with(slice(a, 1, {least}), slice(b, 1, {least}), (x, y) -> x * y)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate({products}, 0.0D, (s, x) -> s + x)")
