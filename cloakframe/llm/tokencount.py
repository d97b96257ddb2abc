"""Token counts by a broadcast table of frequent pre-tokens and worker caches (operator 12).

Texts are cut, by bytes, into units that the tokenizer never joins: letters,
single digits, contractions and other signs between white space.  What is not
plain ASCII, or could hold a special token, stays a whole unit from white space
to white space.  A unit's length in tokens comes from the first of: a compact
hash table of units that are frequent in a sample, broadcast to all tasks; a
cache that lives as long as its Python worker; the tokenizer itself.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048  # tokens
SAMPLE_ROWS = 4096  # expected rows of the sample that fills the table
SAMPLE_BYTES = 8192  # texts of more bytes are not sampled, so the sample is at most about 32 MB
ENTRIES = 1 << 16  # units of the table
UNIT_BYTES = 64  # longer units are neither listed nor cached
CACHED = 1 << 18  # units that a worker keeps

_LETTER = C.byte_table(bytes(range(65, 91)) + bytes(range(97, 123)))
_DIGIT = C.byte_table(bytes(range(48, 58)))
_ONE = C.byte_table(b"stmd")  # 's 't 'm 'd
_TWO = {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}


def vocabulary(name: str = VOCABULARY) -> str:
    """The file of a public tokenizer, wherever the package that brings it lies on this machine; a path stands for itself."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary(name))
    made.no_truncation()
    made.no_padding()
    return made


def tokens_of(units: list[str], name: str = VOCABULARY) -> list[int]:
    """The tokenizer's own counts."""
    return [len(e.ids) for e in _tokenizer(name).encode_batch(units, add_special_tokens=False)]


# --- units -------------------------------------------------------------------------------------------------------


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts, ends and rows of the units; whole units keep their case."""
    space = C.SPACE[data]
    starts, ends, rows = C.pieces(~space, offsets)
    odd = data >= 0x80
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # "<|" may begin a special token
    odd[1:] |= odd[:-1] & (data[:-1] == 60)
    whole = np.append(0, np.cumsum(odd))
    whole = whole[ends] > whole[starts]
    # 0: outside, 1: letters, 2: digits, 3: others; a unit ends where this changes and after every digit
    kind = np.where(_LETTER[data], 1, np.where(_DIGIT[data], 2, 3)).astype(np.int8)
    kind[space] = 0
    inside = np.repeat(whole, ends - starts)
    kind[np.flatnonzero(~space)[inside]] = 0
    low = np.where(kind > 0, C.LOWER[data], data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    edge[1:] |= kind == 2
    # An apostrophe that opens a run of signs and stands before s, t, m, d, re, ve or ll takes these letters.
    mark = np.flatnonzero(edge[:-1] & (data == 39) & (kind == 3))
    mark = mark[mark + 1 < len(data)]
    mark = mark[edge[mark + 1] & (kind[mark + 1] == 1) & ~np.isin(mark + 1, offsets)]
    taken = _ONE[low[mark + 1]].astype(np.int64)
    second = np.minimum(mark + 2, len(data) - 1)
    joined = (mark + 2 < len(data)) & ~edge[mark + 2]
    pair = np.zeros(len(mark), bool)
    for x, y in _TWO:
        pair |= joined & (low[mark + 1] == x) & (low[second] == y)
    taken[pair] = 2
    mark, taken = mark[taken > 0], taken[taken > 0]
    edge[mark + 1] = False
    edge[mark + 1 + taken] = True
    first = np.flatnonzero(edge[:-1])
    last = np.append(first[1:], len(data))[: len(first)]
    plain = kind[first] > 0 if len(first) else np.empty(0, bool)
    first, last = first[plain], last[plain]
    row = np.searchsorted(offsets, first, "right") - 1
    return low, np.append(first, starts[whole]), np.append(last, ends[whole]), np.append(row, rows[whole])


# --- the table ---------------------------------------------------------------------------------------------------


class Lengths:
    """An open-addressing hash table from units to token counts, in four flat arrays."""

    def __init__(self, units: list[bytes], counts: list[int]):
        size = 1 << max(4, (2 * len(units)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.frombuffer(b"".join(units), np.uint8)
        self.ends = np.append(0, np.cumsum([len(u) for u in units])).astype(np.int64)
        self.counts = np.array(counts, np.int32)
        self.slots = np.full(size, -1, np.int32)
        self.probes = 0
        hashes = self.hashes(self.keys, self.ends[:-1], self.ends[1:]) if units else np.empty(0, np.uint64)
        for k, h in enumerate(hashes):
            step = 0
            while self.slots[(int(h) + step) & int(self.mask)] >= 0:
                step += 1
            self.slots[(int(h) + step) & int(self.mask)] = k
            self.probes = max(self.probes, step + 1)

    @staticmethod
    def hashes(data, starts, ends) -> np.ndarray:
        return C.substring_hashes(C.prefix_sums(data), starts, ends)

    def find(self, data, starts, ends, hashes) -> np.ndarray:
        """Counts of the units, -1 where one is not listed; every hit is compared byte by byte."""
        out = np.full(len(starts), -1, np.int64)
        size, live = ends - starts, np.arange(len(starts))
        for step in range(self.probes):
            entry = self.slots[((hashes[live] + np.uint64(step)) & self.mask).astype(np.int64)]
            live, entry = live[entry >= 0], entry[entry >= 0]
            same = self.ends[entry + 1] - self.ends[entry] == size[live]
            at, model = live[same], entry[same]
            begin = np.cumsum(size[at]) - size[at]
            inside = np.arange(int(size[at].sum())) - np.repeat(begin, size[at])
            differ = data[np.repeat(starts[at], size[at]) + inside] != self.keys[np.repeat(self.ends[model], size[at]) + inside]
            bad = np.add.reduceat(differ, begin) > 0 if len(begin) else np.empty(0, bool)
            out[at[~bad]] = self.counts[model[~bad]]
            live = live[out[live] < 0]
        return out


_CACHES: dict[str, dict[bytes, int]] = {}


def _missing(data, starts, ends, hashes, name: str) -> np.ndarray:
    """Counts of units that the table lacks, from this worker's cache or the tokenizer."""
    cache = _CACHES.setdefault(name, {})
    keys = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
    unknown = list({k for k in keys if k not in cache})
    made: dict[bytes, int] = {}
    for a, b in C.runs(np.cumsum([0, *(len(k) for k in unknown)]), 1 << 20):
        made.update(zip(unknown[a:b], tokens_of([k.decode("utf-8", "replace") for k in unknown[a:b]], name)))
    out = np.array([made[k] if k in made else cache[k] for k in keys], np.int64)
    if len(cache) + len(made) > CACHED:
        cache.clear()
    cache.update((k, n) for k, n in made.items() if len(k) <= UNIT_BYTES)
    return out


def count_column(texts, table: Lengths, name: str = VOCABULARY):
    """(first row, end row, bytes, tokens) of each part of a column."""
    for a, b, data, offsets in C.chunked(texts):
        low, starts, ends, rows = units(data, offsets)
        hashes = Lengths.hashes(low, starts, ends)
        found = table.find(low, starts, ends, hashes)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            found[miss] = _missing(low, starts[miss], ends[miss], hashes[miss], name)
        yield a, b, np.diff(offsets), np.bincount(rows, found, b - a).astype(np.int64)


# --- Spark -------------------------------------------------------------------------------------------------------


def frequent_units(docs: DataFrame, name: str = VOCABULARY, rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> Lengths:
    """The table of at most ``entries`` units that are most frequent in about ``rows`` short documents.

    The sample is drawn by chance from texts of at most ``SAMPLE_BYTES`` bytes;
    it decides which units are looked up fast, never what a text counts.
    """
    short = docs.select("text").filter(F.octet_length("text") <= SAMPLE_BYTES)
    share = min(1.0, rows / max(1, docs.count()))

    def count(batches):
        times: dict[bytes, int] = {}
        for batch in batches:
            for _, _, data, offsets in C.chunked(batch.column(0)):
                low, starts, ends, _ = units(data, offsets)
                fit = ends - starts <= UNIT_BYTES
                for a, b in zip(starts[fit].tolist(), ends[fit].tolist()):
                    unit = low[a:b].tobytes()
                    times[unit] = times.get(unit, 0) + 1
        best = sorted(times, key=lambda u: (-times[u], u))[:entries]
        yield C.columns_batch(unit=pa.array(best, pa.binary()), tokens=pa.array(tokens_of([u.decode("utf-8", "replace") for u in best], name), pa.int32()))

    found = short.sample(share, seed=12).repartition(1).mapInArrow(count, "unit binary, tokens int").collect()
    return Lengths([bytes(r["unit"]) for r in found], [r["tokens"] for r in found])


def count_tokens(docs: DataFrame, name: str = VOCABULARY, limit: int = LIMIT, table: Lengths | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document, as the tokenizer counts the whole text.

    Without begin, end or added special tokens, truncation or padding; strings
    of special tokens inside a text count as the tokenizer takes them by default.
    NULL texts are empty (0 bytes, 0 tokens).  Each row counts for itself,
    whatever its id; other columns are not read.  Nothing is shuffled; a task
    holds about ``C.CHUNK_BYTES`` of text at a time, a longer text alone.
    ``table`` comes from the documents where none is given (one more pass over a
    bounded sample, and a count of the rows).
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_units(docs, name) if table is None else table)

    def work(batches):
        for batch in batches:
            for a, b, size, tokens in count_column(batch.column(1), shared.value, name):
                yield C.columns_batch(doc_id=batch.column(0).slice(a, b - a), n_bytes=size, n_tokens=tokens, over_limit=tokens > limit)

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op12_tokencount(spark, folder: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{folder}/documents.parquet"))
