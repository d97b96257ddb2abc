"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its smallest node.

    Only minima per node are shuffled and every round is written out, so neither
    nodes nor links gather anywhere.
    """
    current = C.staged(_ordered(edges.select("a", "b")))
    state = _state(current)
    for _ in range(rounds):
        current = C.staged(_small(_large(current)))
        found = _state(current)
        if found == state:
            break
        state = found
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are hung on its smallest one (itself included)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return _ordered(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")))


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are hung on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    hung = edges.join(least, "a")
    return _ordered(hung.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b"))))
