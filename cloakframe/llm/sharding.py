"""Shards of nearly equal size by sampled splitters (operator 7, native).

The order key of a row is the MD5 of its text, its id and a hash of its other
columns, so equal texts are neighbours.  Splitters are quantiles of a
size-weighted sample of keys; ranges that turn out overfull are sampled again
and subdivided.  Exact range sizes give each range its offset, and running
sums inside the ranges cut the shards to within one document of equal bytes.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHARDS = 8
RANGE_BYTES = 32 << 20
MAX_RANGES = 4096
PER_RANGE = 16  # sampled keys per range: the driver gets at most MAX_RANGES * PER_RANGE short strings at a time
OVERFULL = 2.0
ROUNDS = 4


def _size():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + F.lit(1)


def _key(columns: list[str]):
    rest = F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in columns])), 16, "0")
    ident = F.lpad(F.coalesce(F.hex(F.col("doc_id")), F.lit("")), 16, "0")
    return F.concat(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), ident, rest)


def _sample(keys: DataFrame, total: int, wanted: int) -> list[str]:
    """About ``wanted`` keys, each row drawn in proportion to its size by a hash of its key."""
    unit = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    drawn = keys.filter(unit < F.col("size") * F.lit(wanted / total)).select("key")
    return sorted(r[0] for r in drawn.distinct().limit(8 * MAX_RANGES * PER_RANGE).collect())


def _quantiles(sample: list[str], parts: int) -> list[str]:
    return [sample[i * len(sample) // parts] for i in range(1, parts)] if sample else []


def range_of(key, splitters: list[str]):
    """How many splitters are at or before the key; they are looked up among those with the same first two digits."""
    lists: list[list[str]] = [[] for _ in range(256)]
    for s in splitters:
        lists[int(s[:2], 16)].append(s)
    before = [0, *accumulate(len(x) for x in lists)][:256]
    if not splitters:
        return F.lit(0)
    arrays = ", ".join("split('" + ",".join(x) + "', ',')" if x else "cast(array() as array<string>)" for x in lists)
    first = F.conv(F.substring(key, 1, 2), 16, 10).cast("int")
    near = F.get(F.expr(f"array({arrays})"), first)
    return F.get(_numbers(before), first).cast("int") + F.size(F.filter(near, lambda s: s <= key))


def _numbers(values: list[int]):
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _sums(keys: DataFrame, splitters: list[str]) -> list[tuple[int, int]]:
    """(bytes, rows) of every range; as many rows as there are ranges reach the driver."""
    out = [(0, 0)] * (len(splitters) + 1)
    grouped = keys.groupBy(range_of(F.col("key"), splitters).alias("r")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    for row in grouped.collect():
        out[row["r"]] = (row["b"], row["n"])
    return out


def splitters_of(keys: DataFrame, total: int, range_bytes: int = RANGE_BYTES) -> tuple[list[str], list[tuple[int, int]]]:
    """Range boundaries and the exact sizes between them."""
    parts = int(min(MAX_RANGES, max(4 * SHARDS, total // range_bytes)))
    splitters = sorted(set(_quantiles(_sample(keys, total, parts * PER_RANGE), parts)))
    sums = _sums(keys, splitters)
    for _ in range(ROUNDS):
        full = [i for i, (b, n) in enumerate(sums) if b > OVERFULL * total / parts and n > 1]
        if not full or len(splitters) >= 2 * MAX_RANGES:
            break
        inside = keys.filter(F.get(_numbers([int(i in full) for i in range(len(sums))]), range_of(F.col("key"), splitters)) == 1)
        excess = sum(sums[i][0] for i in full)
        sample = _sample(inside, excess, int(PER_RANGE * max(2, parts * excess / total)))
        more = set()
        for i in full:
            low = bisect.bisect_left(sample, splitters[i - 1]) if i else 0
            high = bisect.bisect_left(sample, splitters[i]) if i < len(splitters) else len(sample)
            more.update(_quantiles(sample[low:high], int(2 * parts * sums[i][0] / total) + 1))
        if not more - set(splitters):
            break
        splitters = sorted(set(splitters) | more)
        sums = _sums(keys, splitters)
    return splitters, sums


def shard(docs: DataFrame, shards: int = SHARDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All rows with ``size``, ``shard`` and ``slot`` (gapless from 0 in every shard, in key order).

    Sizes of shards differ by no more than the largest two documents.  Fully
    equal rows are interchangeable.  A NULL text has size 1 and the key of an
    empty one.  Columns of the input with a new column's name stay; the new
    one gets an underscore more.
    """
    size, slot, number, key, part, start, index = (
        C.free(docs, n) for n in ("size", "slot", "shard", "shard_key", "shard_part", "shard_start", "shard_index"))
    bare = docs.select(_key(docs.columns).alias("key"), _size().alias("size"))
    keys = C.staged(bare)
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return docs.select("*", _size().alias(size), F.lit(0).alias(number), F.lit(0).cast("bigint").alias(slot))
    splitters, sums = splitters_of(keys, total, range_bytes)
    bytes_before = [0, *accumulate(b for b, _ in sums)]
    rows_before = [0, *accumulate(n for _, n in sums)]

    def placed(rows: DataFrame, key: str, size: str) -> DataFrame:
        order = Window.partitionBy(part).orderBy(key)
        running = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
        here = rows.withColumns({
            start: F.get(_numbers(bytes_before), F.col(part)) + running,
            index: F.get(_numbers(rows_before), F.col(part)) + F.row_number().over(order) - 1,
        })
        return here.withColumn(number, F.floor(F.col(start) * shards / F.lit(total)).cast("int"))

    # A shard begins in the range that holds its first byte or, if a document straddles it, in the next one with rows.
    used = [r for r, (_, n) in enumerate(sums) if n]
    holders = [bisect.bisect_right([bytes_before[r] for r in used], -(-s * total // shards)) - 1 for s in range(shards)]
    edges = sorted({used[min(i + k, len(used) - 1)] for i in holders for k in (0, 1)})
    near = keys.withColumn(part, range_of(F.col("key"), splitters)).filter(F.col(part).isin(*edges))
    firsts = {r[0]: r[1] for r in placed(near, "key", "size").groupBy(number).agg(F.min(index)).collect()}
    counted, known = [0] * shards, rows_before[-1]
    for s in reversed(range(shards)):  # an empty shard begins where the next one does
        known = min(known, firsts.get(s, known))
        counted[s] = known
    counted[0] = 0
    full = docs.select("*", _key(docs.columns).alias(key), _size().alias(size)).withColumn(part, range_of(F.col(key), splitters))
    out = placed(full, key, size)
    return out.withColumn(slot, F.col(index) - F.get(_numbers(counted), F.col(number))).drop(key, part, start, index)


def op7_sharding(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return shard(docs).select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                              F.lit(None).cast("int").alias("grown_shard"))
