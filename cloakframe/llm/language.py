"""Language identification by rank-order profiles (operator 5).

A profile lists the most frequent letter n-grams (one to three letters, words
padded with blanks) in order of frequency.  A document's own profile is
compared with each language's by the out-of-place distance: the sum of rank
differences, with a fixed penalty for n-grams that the language lacks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

PROFILE = 400  # n-grams of a profile, and the penalty of a missing one
DOCS_PER_LANGUAGE = 2000  # expected training documents per language: the bound of the sample the profiles are fitted on
MAX_LANGUAGES = 2000
UNDECIDED = "und"
LOW_SHARE, MARGIN = 0.001, 0.75  # the floor: this part of the score that all but this share of the held-out texts reach
ROWS_OUT = 1024  # rows handed back at a time
RUN_BYTES = 1 << 19  # text whose grams are counted at a time; they take about a hundred times as much
_ROWS = 1 << 15


def _fold_table() -> np.ndarray:
    """Symbol of each code point: 1 for everything that is no letter, else one more than its lower-case form."""
    out = np.ones(0x20000, np.uint64)
    for i in range(0x20000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = min(ord(low) if len(low) == 1 else i, 0xFFF0) + 1
    return out


_FOLD: list[np.ndarray] = []


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count, letters per row) of a chunk of texts, ordered by row and gram.  At most 2^15 rows."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = C.counts_between((data & 0xC0) != 0x80, offsets).cumsum()
    symbols = np.ones(len(points) + n + 1, np.uint64)  # a blank before every row and after the last
    rows = np.repeat(np.arange(n), np.diff(ends, prepend=0))
    fold = _FOLD[0]
    symbols[np.arange(len(points)) + rows + 1] = np.where(points < len(fold), fold[np.minimum(points, len(fold) - 1)], np.minimum(points, 0xFFF0) + 1)
    row_of = np.zeros(len(symbols), np.uint64)
    row_of[np.cumsum(np.diff(ends, prepend=0) + 1)[:-1]] = 1
    row_of = np.cumsum(row_of).astype(np.uint64) << np.uint64(48)
    letter = symbols > 1
    letters = np.bincount((row_of[letter] >> np.uint64(48)).astype(np.int64), minlength=n)[:n]
    a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
    s = np.uint64(16)
    mid = letter[1:-1]
    two = letter[:-1] | letter[1:]
    two_row = np.where(letter[:-1], row_of[:-1], row_of[1:])
    keys = np.concatenate([
        (row_of | symbols)[letter],
        (two_row | (symbols[:-1] << s) | symbols[1:])[two],
        (row_of[1:-1] | (a << s << s) | (b << s) | c)[mid],
    ])
    keys.sort()
    if not len(keys):
        none = np.empty(0, np.int64)
        return none, none, none, letters
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> np.uint64(48)).astype(np.int64), (keys & np.uint64((1 << 48) - 1)).astype(np.int64), counts, letters


def top_grams(rows: np.ndarray, grams: np.ndarray, counts: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, rank) of the ``size`` most frequent grams of each row; ties go to the smaller gram."""
    begin = np.searchsorted(rows, np.arange(n))
    local = np.arange(len(rows)) - begin[rows]
    few = np.uint64((1 << 24) - 1)
    keys = (rows.astype(np.uint64) << np.uint64(48)) | ((few - np.minimum(counts, int(few)).astype(np.uint64)) << np.uint64(24)) | local.astype(np.uint64)
    keys.sort()
    at = begin[rows] + (keys & few).astype(np.int64)  # the order of rows is unchanged
    keep = local < size
    return rows[keep], grams[at[keep]], local[keep]


def _small_runs(column):
    for a, b, data, offsets in C.chunked(column):
        for first, end in C.runs(offsets, RUN_BYTES):
            for i in range(first, end, _ROWS):
                o = offsets[i : min(i + _ROWS, end) + 1]
                yield a + i, a + i + len(o) - 1, data[o[0] : o[-1]], o - o[0]


@dataclass
class Profiles:
    """Languages in order of name, and the rank of each gram in each (the profile size where it is missing: -1)."""

    names: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        """Language and score of every text; NULL texts and texts without letters are undecided."""
        names, scores = [UNDECIDED] * len(column), np.zeros(len(column))
        if not self.names:
            return names, scores
        for start, end, data, offsets in _small_runs(column):
            n = end - start
            rows, grams, counts, letters = gram_counts(data, offsets)
            if not len(rows):
                continue
            rows, grams, rank = top_grams(rows, grams, counts, n, self.size)
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            found = self.grams[at] == grams
            far = np.empty((len(self.names), n))
            for k in range(len(self.names)):
                here = self.ranks[k][at]
                cost = np.where(found & (here >= 0), np.abs(rank - here), self.size)
                far[k] = np.bincount(rows, weights=cost, minlength=n)
            best = far.argmin(0)
            length = np.bincount(rows, minlength=n)
            for i in np.flatnonzero(letters):
                names[start + i] = self.names[best[i]]
                scores[start + i] = 1 - far[best[i], i] / (self.size * length[i])
        return names, scores


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _drawn(known: DataFrame, per_language: int | None, seed: str) -> DataFrame | None:
    """A bounded, hash-drawn sample of each language (None: all of it); None where there is no language."""
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    if per_language is None:
        return known
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    return known.filter(C.md5_unit(seed, F.col("doc_id")) < F.get(F.map_values(F.map_filter(shares, lambda k, _: k == F.col("lang"))), F.lit(0)))


def fit(docs: DataFrame, per_language: int | None = DOCS_PER_LANGUAGE, size: int = PROFILE, seed: str = "lid") -> Profiles:
    """Profiles from the labelled documents that are not held out: a bounded, hash-drawn sample, or all (None)."""
    C.small_batches(docs.sparkSession)
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    drawn = _drawn(known, per_language, seed)
    if drawn is None:
        return Profiles([], np.empty(0, np.int64), np.empty((0, 0)), size)

    def count(batches):
        for batch in batches:
            langs = np.asarray(batch.column(0).to_pylist(), dtype=object)
            for start, end, data, offsets in _small_runs(batch.column(1)):
                rows, grams, counts, _ = gram_counts(data, offsets)
                for name in set(langs[start:end]):
                    mine = langs[start:end][rows] == name
                    found, back = np.unique(grams[mine], return_inverse=True)
                    sums = np.bincount(back, weights=counts[mine], minlength=len(found)).astype(np.int64)
                    yield C.columns_batch(lang=pa.array([name] * len(found), pa.string()), gram=found, n=sums)

    sums = drawn.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("place", place).filter(F.col("place") <= size).collect()
    names = sorted({r["lang"] for r in top})
    grams = np.array(sorted({r["gram"] for r in top}), np.int64)
    ranks = np.full((len(names), len(grams)), -1, np.int64)
    index, row = {g: i for i, g in enumerate(grams.tolist())}, {x: i for i, x in enumerate(names)}
    for r in top:
        ranks[row[r["lang"]], index[r["gram"]]] = r["place"] - 1
    return Profiles(names, grams, ranks, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``; only the text is looked at."""
    C.small_batches(docs.sparkSession)
    name, score = C.free(docs, "lang_pred"), C.free(docs, "score")
    schema = docs.select("*", F.lit("").alias(name), F.lit(0.0).alias(score)).schema
    at = docs.columns.index("text")

    def work(batches):
        for whole in batches:
            for a in range(0, len(whole), ROWS_OUT):
                batch = whole.slice(a, ROWS_OUT)
                names, scores = profiles.predict(batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*batch.schema.names, name, score])

    return docs.mapInArrow(work, schema)


def floor(docs: DataFrame, profiles: Profiles) -> float:
    """The score below which a text is in none of the learned languages.

    Measured on all held-out documents labelled with a learned language: three
    quarters of the score that all but a thousandth of them reach.  Without such
    documents 0, which rejects nothing.
    """
    known = docs.filter(held_out() & F.col("lang").isin(profiles.names) & F.col("text").isNotNull()).select("text")
    scored = identify(known, profiles).filter(F.col("lang_pred") != UNDECIDED)
    low = scored.agg(F.percentile_approx("score", LOW_SHARE, 100_000)).first()[0]
    return MARGIN * (low or 0.0)


def op5_language(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
