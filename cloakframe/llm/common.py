"""Helpers the training-data operators share: staged tables, and byte-level words of whole Arrow columns."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches  # noqa: F401

CHUNK_BYTES = 1 << 21  # texts are worked on in runs of about this many bytes; a longer text is a run of its own
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where none is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write a result once to the shared folder and read it back: no second evaluation, lost executors cost no rework."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def md5_unit(*parts) -> Column:
    """A number in [0, 1) from the parts, the same in every engine with MD5 (52 bits)."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


# --- bytes of a column -------------------------------------------------------------------------------------------


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; NULL rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; every range has at least one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def chunked(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each run of a column."""
    data, offsets = text_bytes(column)
    for a, b in runs(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for chunks of the usual size."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    size = max(n, CHUNK_BYTES + 1)

    def table(base: int) -> np.ndarray:
        out = np.empty(size, np.uint64)
        out[0], done = 1, 1
        while done < size:
            step = min(done, size - done)
            np.multiply(out[:step], np.uint64(pow(base, done, 1 << 64)), out=out[done : done + step])
            done += step
        return out

    made = [table(_BASE), table(pow(_BASE, -1, 1 << 64))]
    if size <= 4 * CHUNK_BYTES:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the polynomial hash of any substring; one entry more than there are bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


def pieces(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of kept bytes; runs never cross rows."""
    n = len(keep)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, keep[:-1]
    starts = np.flatnonzero(keep & (border[:-1] | ~before))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, keep[1:]
    ends = np.flatnonzero(keep & (border[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def counts_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def triples(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of three words in a row of the same text, and the index of the first word."""
    if len(words) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(rows[2:] == rows[:-2])
    a, b, c = words[at], words[at + 1], words[at + 2]
    return mix(a + mix(b + np.uint64(_ODD)) * np.uint64(3) + mix(c + np.uint64(_BASE)) * np.uint64(5)), at


def grams(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row of the same text, and the index of the first word."""
    if width == 3:
        return triples(words, rows)
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(rows[width - 1 :] == rows[:n])
    out = words[at]
    for k in range(1, width):
        out = out * np.uint64(_BASE) + mix(words[at + k] + np.uint64(k))
    return mix(out), at


def squeezed(data: bytes) -> bytes:
    """Zstandard with the length in front; large blobs travel smaller than under the shuffle's own codec."""
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def restored(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def columns_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)
