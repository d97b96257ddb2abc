"""Runs of periodic words by an enhanced suffix array (operator 11).

Words that are found too rarely for a run cut a text to stretches; the
stretches of many texts go through one suffix array, each closed by an id of
its own so that nothing matches across.  Inverse array and common prefixes make
it an enhanced one.  Every LCP interval of depth ``d`` is asked, for the
suffixes of all its children but the largest, whether the suffix ``d`` words
further or before lies in the interval and goes on differently: a branching
square of period ``d``.  Squares that end at one word are merged, the smaller
period first, and rotated to the left into a run.  Intervals come from nearest
smaller values; no tree is built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 6
EXPONENT = 4
CELLS = 1 << 20  # entries of a comparison or of an expansion at a time
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start:long,length:long,period:long>>"


# --- enhanced suffix array of whole numbers ----------------------------------------------------------------------


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse by prefix doubling; only suffixes that still tie are sorted again.

    Equal prefixes must end before the array does: the last id is found once.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    slots, key, at, width = np.arange(n), ids[order], order, 1
    while True:
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(first, slots, 0))
        tied = ~(first & np.append(first[1:], True))
        slots = slots[tied]
        if not len(slots):
            return order, rank
        at = order[slots]
        key = rank[at] * n + rank[at + width]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        width *= 2


def agreeing(ids: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many ids agree from ``a`` and ``b`` on, in steps of 1 or -1; the ids at both ends are found once."""
    out = np.zeros(len(a), np.int64)
    live, width = np.arange(len(a)), 4
    while len(live):
        reach, more = np.arange(width) * step, []
        for k in range(0, len(live), max(1, CELLS // width)):
            part = live[k : k + max(1, CELLS // width)]
            gone = out[part] * step
            same = ids.take((a[part] + gone)[:, None] + reach, mode="clip") == ids.take((b[part] + gone)[:, None] + reach, mode="clip")
            whole = same.all(axis=1)
            out[part] += np.where(whole, width, same.argmin(axis=1))
            more.append(part[whole])
        live, width = np.concatenate(more), min(2 * width, CELLS)
    return out


def common_prefixes(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Per place of the suffix array, how many ids its suffix shares with the one before.

    Only suffixes whose preceding id differs from their neighbour's are
    compared (their prefixes sum to n log n at most); from there, each next
    position shares one id less.
    """
    n = len(ids)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    head = (at == 0) | (before <= 0)
    head[~head] = ids[at[~head] - 1] != ids[before[~head] - 1]
    shared = np.zeros(n, np.int64)
    compared = np.flatnonzero(head & (before >= 0))
    shared[compared] = agreeing(ids, compared, before[compared], 1)
    source = np.maximum.accumulate(np.where(head, at, 0))
    return (shared[source] - (at - source))[order]


def _next_smaller(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first later index whose value is smaller; the last value must be smaller than all."""
    mins, here, want = [values], at + 1, values[at]
    levels = np.zeros(len(at), np.int64)
    live, level = np.arange(len(at)), 0
    while len(live):
        live = live[mins[level][here[live]] >= want[live]]
        here[live] += 1 << level
        level += 1
        levels[live] = level
        if len(live):
            wide = mins[-1].copy()
            step = 1 << (level - 1)
            np.minimum(wide[:-step], mins[-1][step:], out=wide[:-step])
            mins.append(wide)
    for level in range(len(mins) - 1, -1, -1):
        live = np.flatnonzero(levels > level)
        live = live[mins[level][here[live]] >= want[live]]
        here[live] += 1 << level
    return here


def small_children(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first place, end, interval's first place, its end, its depth) of all children but one largest per LCP interval."""
    at = np.flatnonzero(lcp > 0)
    n, values = len(lcp), lcp.astype(np.int32)
    right = _next_smaller(np.append(values, -1), at)
    left = n - 1 - _next_smaller(np.append(values[::-1], -1), n - 1 - at)
    depth = lcp[at]
    by = np.lexsort((at, depth, left))
    at, left, right, depth = at[by], left[by], right[by], depth[by]
    first = np.ones(len(at), bool)
    first[1:] = (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])
    last = np.append(first[1:], True)
    ends = np.where(last, right, np.append(at[1:], 0))
    lead = np.flatnonzero(first)
    start, end = np.concatenate([at, left[lead]]), np.concatenate([ends, at[lead]])
    number = np.concatenate([np.cumsum(first) - 1, np.arange(len(lead))])
    by = np.lexsort((end - start, number))
    small = by[:-1][number[by[1:]] == number[by[:-1]]]  # the last of an interval is a largest child
    of = lead[number[small]]
    return start[small], end[small], left[of], right[of], depth[of]


def branching_squares(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of every square that the next id ends, in order of end, then period; once each."""
    order, rank = suffix_order(ids)
    start, end, low, high, depth = small_children(common_prefixes(ids, order))
    sums, found = np.append(0, np.cumsum(end - start)), []
    for a, b in C.runs(sums, CELLS):
        size = end[a:b] - start[a:b]
        which = np.repeat(np.arange(a, b), size)
        i = order[np.arange(sums[b] - sums[a]) + np.repeat(start[a:b] - (sums[a:b] - sums[a]), size)]
        d, lo, hi = depth[which], low[which], high[which]
        other = rank[i + d]
        met = np.flatnonzero((other >= lo) & (other < hi))
        x, p = i[met], d[met]
        met = ids[x + p] != ids[x + 2 * p]
        found.append(np.stack([x[met] + 2 * p[met], p[met]]))
        met = np.flatnonzero((i >= d) & (ids[i] != ids[i + d]))
        x, p = i[met], d[met]
        other = rank[x - p]
        met = (other >= lo[met]) & (other < hi[met])
        found.append(np.stack([x[met] + p[met], p[met]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends, periods = np.concatenate(found, axis=1)
    by = np.lexsort((periods, ends))
    ends, periods = ends[by], periods[by]
    new = np.ones(len(ends), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (periods[1:] != periods[:-1])
    return ends[new], periods[new]


def merged_runs(ids: np.ndarray, min_words: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of an array whose first and last ids are found once."""
    ends, periods = branching_squares(ids)
    out = []
    while len(ends):
        first = np.ones(len(ends), bool)
        first[1:] = ends[1:] != ends[:-1]
        e, p = ends[first], periods[first]
        length = 2 * p + agreeing(ids, e - 2 * p - 1, e - p - 1, -1)
        chosen = length >= np.maximum(min_words, exponent * p)
        out.append(np.stack([e - length, length, p])[:, chosen])
        of = np.cumsum(first) - 1
        # A square that the run of a divisor of its period covers repeats the smaller period.
        rest = ~first & ~((periods % p[of] == 0) & (2 * periods <= length[of]))
        ends, periods = ends[rest], periods[rest]
    found = np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)
    return tuple(found[:, np.lexsort((found[2], found[0]))])


# --- words of texts ----------------------------------------------------------------------------------------------


def _numbers(data, starts, ends, hashes, stretch) -> np.ndarray:
    """Numbers of words, equal for equal words of a stretch only; equal hashes are compared byte by byte."""
    size = ends - starts
    _, first, number = np.unique(C.mix(hashes ^ C.mix(stretch.astype(np.uint64) + np.uint64(1))), return_index=True, return_inverse=True)
    model = first[number]
    if np.array_equal(size, size[model]) and np.array_equal(stretch, stretch[model]):
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        if np.array_equal(data[np.repeat(starts, size) + inside], data[np.repeat(starts[model], size) + inside]):
            return number
    known: dict = {}
    return np.array([known.setdefault((s, data[a:b].tobytes()), len(known)) for a, b, s in zip(starts, ends, stretch)], np.int64)


def _often(keys: np.ndarray, times: int) -> np.ndarray:
    order = np.argsort(keys)
    edge = np.flatnonzero(np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]]))
    count = np.diff(np.append(edge, len(keys)))
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(count >= times, count)
    return out


def word_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, min_words: int = MIN_WORDS,
              exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs among words, numbered through all texts; no run crosses texts.

    Each word of a run is found ``exponent`` times in it.  So words that are
    rarer in their text, and then in what is left between such words, cut the
    text without touching a run or the words beside it that could extend it.
    """
    hashes = C.substring_hashes(C.prefix_sums(data), starts, ends)
    where, stretch = np.arange(len(starts)), rows
    for _ in range(3):
        if not len(where):
            break
        where_kept = _often(C.mix(hashes[where] ^ C.mix(stretch.astype(np.uint64) + np.uint64(1))), exponent)
        where, text = where[where_kept], rows[where[where_kept]]
        edge = np.ones(len(where), bool)
        edge[1:] = (where[1:] != where[:-1] + 1) | (text[1:] != text[:-1])
        begin = np.flatnonzero(edge)
        size = np.diff(np.append(begin, len(where)))
        long_enough = np.repeat(size >= min_words, size)
        where, stretch = where[long_enough], (np.cumsum(edge) - 1)[long_enough]
    if not len(where):
        none = np.empty(0, np.int64)
        return none, none, none
    _, stretch = np.unique(stretch, return_inverse=True)
    number = _numbers(data, starts[where], ends[where], hashes[where], stretch)
    n, closes = len(where), int(stretch[-1]) + 1
    ids = np.empty(n + closes + 1, np.int64)
    place = np.arange(n) + stretch + 1
    closing = np.append(place[np.flatnonzero(np.diff(stretch))], place[-1]) + 1
    ids[0], ids[place], ids[closing] = n + closes, number, n + np.arange(closes)
    word = np.zeros(len(ids), np.int64)
    word[place] = where
    start, length, period = merged_runs(ids, min_words, exponent)
    return word[start], length, period


def _joined(data, starts, ends, rows, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words of ``n`` texts, one blank between them, and the offsets of the texts."""
    last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.empty(0, bool)
    size = ends - starts + ~last
    after = np.cumsum(size)
    from_ = np.arange(int(size.sum())) + np.repeat(starts - (after - size), size)
    out = data.take(from_, mode="clip") if len(from_) else np.empty(0, np.uint8)
    out[after[~last] - 1] = 32
    return out, np.append(0, np.cumsum(np.bincount(rows, size, n).astype(np.int64)))


def _runs_of(texts, min_words: int, exponent: int):
    """(first row, end row, runs, collapsed texts) of each part of a column."""
    for a, b, data, offsets in C.chunked(texts):
        n = b - a
        starts, ends, rows = C.pieces(~C.SPACE[data], offsets)
        start, length, period = word_runs(data, starts, ends, rows, min_words, exponent)
        drop = np.zeros(len(starts) + 1, np.int64)
        np.add.at(drop, start + period, 1)
        np.add.at(drop, start + length, -1)
        kept = np.cumsum(drop[:-1]) == 0
        text, cuts = _joined(data, starts[kept], ends[kept], rows[kept], n)
        row = rows[start]
        first_word = np.searchsorted(rows, row)
        values = pa.StructArray.from_arrays([pa.array(x) for x in (start - first_word, length, period)], fields=list(_RUN))
        each = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), values)
        collapsed = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(text)])
        yield a, b, each, collapsed


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, ``runs`` (start, length and period in words, by start, then period) and ``collapsed`` of every document.

    A run is a stretch of words with smallest period q, of at least
    ``max(min_words, exponent * q)`` words (``exponent`` whole, 2 or more), that
    no neighbouring word extends.  ``collapsed`` keeps the words that no run
    holds after its first q words, joined by one blank.

    Every row is a document of its own: NULL and repeated ids and equal rows do
    not meet.  A NULL, empty or blank text has no runs and collapses to an empty
    one.  Nothing is shuffled; a task holds about ``C.CHUNK_BYTES`` of text at a
    time, a longer text alone.  Columns beside doc_id and text are not read.
    """
    if exponent < 2:
        raise ValueError("a run repeats at least twice")

    def work(batches):
        for batch in batches:
            for a, b, runs, collapsed in _runs_of(batch.column(1), min_words, exponent):
                yield C.columns_batch(doc_id=batch.column(0).slice(a, b - a), runs=runs, collapsed=collapsed)

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id long, runs {RUNS}, collapsed string")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by the checksum of its id, repeats a part of its words from some word on.

    With h the checksum and g = h / 10: h divisible by 10 makes each word i >= a
    the word a + (i - a) % p, where a = g % n and p = 1 + (n - a) / (3 + g % 8).
    Rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    parted = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    parted = parted.withColumn("a", F.expr("cast(if(size(w) > 0, (h div 10) % size(w), 0) as int)"))
    parted = parted.withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + (h div 10) % 8) as int)"))
    repeated = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p])), ' ')")
    return parted.select("doc_id", F.when(F.expr("size(w) > 0"), repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark, folder: str) -> DataFrame:
    found = find_runs(repeat_tails(spark.read.parquet(f"{folder}/documents.parquet")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * -best.less div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
