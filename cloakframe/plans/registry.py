"""Registered queries: one per operator, each over whole tables, most with a SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import spread
from . import texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame, with the SQL that must give the same rows."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = plain(sql)
        return fn

    return register


def plain(sql: str) -> str:
    """Table names as they are."""
    for table in TABLES:
        sql = sql.replace("{" + table + "}", table)
    return sql


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rel(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Rows of a statement over ``{table}`` names, written in the SQL both engines share."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", f"parquet.`{folder}/{name}.parquet`")
    return spark.sql(sql)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source", "text"))


def customer_texts(spark: SparkSession, folder: str, expression: str, *more: str) -> DataFrame:
    """Customers are dealt out before their texts are made, so that texts are not shuffled."""
    numbers = spark.sql(texts.NUMBERS, customer=spread(table(spark, folder, "customer").select("c_custkey", "c_nationkey")))
    return numbers.selectExpr("c_custkey as id", f"{texts.flat(expression)} as text", *more)


def joined(column, sep: str = ","):
    return F.array_join(column, sep)
