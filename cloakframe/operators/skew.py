"""Joins and positions that stay spread out when one key holds much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS = 1000
HOT_ROWS = 1_000_000
SALTS = 32
PLAIN_JOIN_BYTES = 4 << 30


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input too small to be split that far by the scan.

    Inputs with at least one full split per core are left alone, so at scale
    this adds no shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(str(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    return df.repartition(cores) if estimated_bytes(df) < cores * split else df


def hot_keys(df: DataFrame, keys: list[str], min_rows: int = HOT_ROWS, limit: int = HOT_KEYS) -> DataFrame:
    """The largest keys.  At most ``limit`` rows, so the result is safe to broadcast.

    Counting is partially aggregated before its shuffle.  Keys past the limit
    hold less than 1/limit of the rows each and need no salt.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    return counts.orderBy(F.desc("_n"), *keys).limit(limit).select(*keys)


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, hot: DataFrame, salts: int = SALTS
) -> DataFrame:
    """Equi-join whose hot left keys are cut into ``salts`` parts.

    Only right rows with a hot key are repeated, once per part.  Supports
    ``inner``, ``left``, ``left_semi`` and ``left_anti``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    part = F.pmod(F.xxhash64(*[c for c in left.columns]), F.lit(salts)).cast("int")
    tagged = left.join(marked, keys, "left").withColumn("_part", F.when(F.col("_hot"), part).otherwise(F.lit(0)))
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(marked, keys, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return tagged.drop("_hot").join(repeated, [*keys, "_part"], how).drop("_part")


def lookup_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
    plain_bytes: int = PLAIN_JOIN_BYTES, min_rows: int = HOT_ROWS, salts: int = SALTS,
) -> DataFrame:
    """Join a long left side to a keyed right side.

    A left side estimated below ``plain_bytes`` is joined directly and the
    planner chooses the strategy; above it hot keys are counted and salted.
    """
    if estimated_bytes(left) < plain_bytes:
        return left.join(right, keys, how)
    return salted_join(left, right, keys, how, hot_keys(left, keys, min_rows), salts)


def running_totals(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, amount: Column, out: str
) -> DataFrame:
    """Per key, the sum of ``amount`` over all earlier rows, without one task per key.

    ``bucket`` must rise with ``order``.  Rows are numbered inside a
    (key, bucket) group; group sums, one row per group, give the offsets.
    """
    tagged = df.withColumn("_bucket", bucket).withColumn("_amount", amount)
    sums = tagged.groupBy(*keys, "_bucket").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return (
        local.join(offsets, [*keys, "_bucket"], "left")
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_amount", "_offset", "_inside")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
