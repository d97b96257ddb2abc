"""Mixing sources to target weights by Poisson replication (operator 2).

A source of amount ``a`` (UTF-8 bytes plus one per row) with weight ``w`` of
the mixture is repeated at the mean rate ``repeats * total * w / a``.  Each
document inverts the Poisson distribution of that mean at a number hashed from
the seed and its id, appears that often, and the copies are shuffled globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SEED = "mix-1"
ALPHA = 0.7
SMALL = 10_000  # sources up to this number are broadcast (a few hundred bytes each)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA,
                 repeats: float = 1.0, source: str = "source") -> DataFrame:
    """One row per source ('' for NULL): its mean repetition rate.

    Without ``weights`` a source weighs its amount to the power ``alpha``.
    Sources that ``weights`` does not name get rate 0.  Weights are scaled to
    sum to one over the sources that occur.
    """
    amount = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + F.lit(1)
    name = F.coalesce(F.col(source), F.lit("")).alias("mix_source")
    sums = C.staged(docs.select(name, amount.alias("amount")).groupBy("mix_source").agg(F.sum("amount").alias("amount")))
    if weights is None:
        weight = F.pow(F.col("amount").cast("double"), F.lit(float(alpha)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        weight = F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, _: k == F.col("mix_source"))), F.lit(0)), F.lit(0.0))
    rows = sums.withColumn("weight", weight)
    whole = rows.agg(F.sum("amount").alias("a"), F.sum("weight").alias("w")).first()
    total, heft = float(whole["a"] or 0), float(whole["w"] or 0)
    if not heft:
        return rows.select("mix_source", "amount", F.lit(0.0).alias("rate"))
    rate = F.lit(repeats * total) * (F.col("weight") / F.lit(heft)) / F.col("amount")
    return rows.select("mix_source", "amount", rate.alias("rate"))


def poisson_steps(rate):
    """The distribution function at 0, 1, 2, ... until nothing is left of 52 bits."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")

    def step(acc, k):
        log = acc["log"] + F.log(rate) - F.log(k)
        sum_ = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), sum_.alias("sum"), F.concat(acc["out"], F.array(sum_)).alias("out"))

    first = F.exp(-rate)
    start = F.struct((-rate).alias("log"), first.alias("sum"), F.array(first).alias("out"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["out"]).otherwise(F.array(F.lit(1.0)))


def replicated(docs: DataFrame, rates: DataFrame, seed: str = SEED, source: str = "source") -> DataFrame:
    """Every document as often as its draw says, with ``copy`` (from 1) and ``place`` (order of the global shuffle).

    Rows that share a doc_id are drawn alike; those without one are drawn by a
    hash of the row.  A NULL source is a value like any other.  Columns of the input named like the two new ones stay, the
    new ones then get an underscore more.
    """
    copy, place, steps, key = (C.free(docs, n) for n in ("copy", "place", "mix_steps", "mix_key"))
    table = rates.select(F.col("mix_source").alias(key), poisson_steps(F.col("rate")).alias(steps))
    if rates.count() <= SMALL:
        table = F.broadcast(table)
    drawn = docs.withColumn(key, F.coalesce(F.col(source), F.lit(""))).join(table, key)
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null|"), row.cast("string")))
    number = C.md5_unit(seed, ident)
    times = F.size(F.filter(F.col(steps), lambda c: c <= number))
    rows = drawn.withColumn(copy, times).filter(F.col(copy) > 0)
    rows = rows.select(*docs.columns, ident.alias(key), F.explode(F.sequence(F.lit(1), F.col(copy))).alias(copy))
    order = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key), F.col(copy).cast("string")).cast("binary")), 1, 15)
    rows = rows.withColumn(place, F.conv(order, 16, 10).cast("bigint")).drop(key)
    return rows.repartition(C.partitions(docs.sparkSession), place).sortWithinPartitions(place)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, repeats: float = 1.0,
        seed: str = SEED, source: str = "source") -> DataFrame:
    return replicated(docs, source_rates(docs, weights, alpha, repeats, source), seed, source)


def op2_mixing(spark, folder: str) -> DataFrame:
    """All documents mixed to amounts to the power 0.7: one row per copy, in shuffled order."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.col("copy").cast("bigint").alias("copy"), "place", "text")


ORACLE = f"""
with sums as (select coalesce(source, '') as s, sum(coalesce(strlen(text), 0) + 1) as amount from documents group by 1),
whole as (select sum(amount) as a, sum(pow(amount, {ALPHA})) as w from sums),
rates as (select s, a * (pow(amount, {ALPHA}) / w) / amount as rate from sums, whole),
steps as (select s, list_transform(range(0, cast(ceil(rate + 12 * sqrt(rate) + 41) as bigint)), lambda k:
  list_sum(list_transform(range(0, k + 1), lambda i: exp(i * ln(rate) - rate - lgamma(i + 1))))) as cdf from rates),
drawn as (select doc_id, source, text, cdf,
  cast(('0x' || md5('{SEED}|' || coalesce(cast(doc_id as varchar), 'null'))[1:13]) as bigint) / 4503599627370496.0 as u
  from documents join steps on s = coalesce(source, '')),
copies as (select doc_id, source, text, unnest(range(1, len(list_filter(cdf, lambda c: c <= u)) + 1)) as copy from drawn)
select doc_id, source, copy, cast(('0x' || md5('{SEED}|' || coalesce(cast(doc_id as varchar), 'null') || '|' ||
  cast(copy as varchar))[1:15]) as bigint) as place, text from copies"""
