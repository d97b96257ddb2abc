"""The library's scalar functions under SQL names, and tokenized views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import catalog as C


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """Temporary SQL functions; all are plain SQL expressions, so that the optimizer sees through them.

    ``pii_tokens(text)``: tokens of a text in order; ``pii_label(label)``: the
    label as it stands in tokens; ``pii_token(label, value)``: the token of a value.
    """
    pairs = ", ".join(f"{_text(k)}, {_text(v)}" for k, v in C.LABEL_NORM.items())
    label = f"substring(coalesce(try_element_at(map({pairs}), label), upper(label)), 1, {C.TOKEN_LABEL_CHARS})"
    create = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{create} pii_tokens(text STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(text, {_text(C.TOKEN_REGEX)}, 0)")
    spark.sql(f"{create} pii_label(label STRING) RETURNS STRING RETURN {label}")
    spark.sql(f"{create} pii_token(label STRING, value STRING) RETURNS STRING "
              f"RETURN concat('[', {label}, '_', substring(md5(cast(value AS BINARY)), 1, {C.TOKEN_ID_CHARS}), ']')")


def tokenized_view(spark: SparkSession, source: str, view: str, text: str = "text", **options) -> None:
    """A temporary view ``view``: the columns of ``source`` with ``tokenized`` and ``entities`` added."""
    from ..operators.tokenize import tokenize

    tokenize(spark.table(source), text, **options).createOrReplaceTempView(view)
