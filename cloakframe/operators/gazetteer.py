"""Names from a table of phrases: people, places, groups.

A phrase runs from its first to its last word character and matches whole words,
ignoring case, with the same characters between its words.  Of all phrases that
start at a word the longest counts, and matching goes on behind it.  Texts are
looked up word by word in hash tables, so cost does not grow with the phrases.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import exploded, over_batches
from ..session import small_batches, stored
from . import spans as S
from .detect import BATCH_BYTES, MODEL_SOURCE
from .skew import lookup_join

WORD = r"[\p{L}\p{N}\p{M}_]+"
PHRASE_BYTES = 64 << 20  # a larger table is joined instead of sent to all tasks
PART_CHARS = 1 << 20  # texts are worked on in parts of about so many characters
SLOTS = 1 << 27  # of the table of hashed phrases, at most: 16 MB
SCORE = 0.85
_PIECE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("score", pa.float64()), ("source", pa.string())])


@lru_cache(maxsize=1)
def _word():
    import regex

    return regex.compile(WORD)


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _bounds(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _word().finditer(text)]


def prepared(phrases: DataFrame) -> DataFrame:
    """phrase (lower case, from first to last word character), words, label, score; one row per phrase.

    ``phrases`` has phrase and label, and a score if it likes (else ``SCORE``).  A
    phrase listed under several labels keeps the one with the best score, then
    the first by name.  Phrases without a word character are left out.
    """
    score = F.col("score").cast("double") if "score" in phrases.columns else F.lit(SCORE)

    def cut(batches):
        for batch in batches:
            made = []
            for text in batch.column(0).to_pylist():
                low = lowered(text or "")
                at = _bounds(low)
                made.append((low[at[0][0] : at[-1][1]], len(at)) if at else (None, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in made], pa.string()), pa.array([n for _, n in made], pa.int32()), *batch.columns[1:]],
                names=["phrase", "words", "label", "score"])

    rows = phrases.select("phrase", "label", score.alias("score")).mapInArrow(cut, "phrase string, words int, label string, score double")
    best = F.min_by(F.struct("label", "score"), F.struct(-F.col("score"), "label"))
    return rows.filter("phrase is not null and label is not null").groupBy("phrase", "words").agg(best.alias("b")).select("phrase", "words", "b.label", "b.score")


class Phrases:
    """Hash tables of phrases: the numbers of words that phrases with a first word have, and the phrases."""

    def __init__(self, rows):
        self.known = {r["phrase"]: (r["label"], r["score"]) for r in rows}
        counts: dict[str, set[int]] = {}
        for r in rows:
            counts.setdefault(_word().match(r["phrase"]).group(), set()).add(r["words"])
        self.counts = {first: sorted(n, reverse=True) for first, n in counts.items()}

    def find(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        """(start, end, label, score) of the phrases of a text, in order."""
        low = lowered(text)
        at = _bounds(low)
        i = 0
        while i < len(at):
            start, step = at[i][0], 1
            for n in self.counts.get(low[start : at[i][1]], ()):
                if i + n > len(at):
                    continue
                end = at[i + n - 1][1]
                hit = self.known.get(low[start:end])
                if hit:
                    yield (start, end, *hit)
                    step = n
                    break
            i += step


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``PART_CHARS`` characters; every range has a row at least."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= PART_CHARS:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _looked_up(df: DataFrame, table: DataFrame, text: str, out: str) -> DataFrame:
    """One pass over the texts with the tables in every task."""
    shared = df.sparkSession.sparkContext.broadcast(Phrases(table.collect()))
    place = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StructType.fromDDL(f"x {S.SPANS}")["x"].dataType)])

    def work(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in _parts(texts):
                found = [list(shared.value.find(t or "")) for t in texts[a:b]]
                starts, ends, labels, scores = (pa.array([p[k] for row in found for p in row], _PIECE.field(k).type) for k in range(4))
                sources = pa.array(np.full(len(starts), MODEL_SOURCE, object), pa.string())
                pieces = pa.StructArray.from_arrays([starts, ends, labels, scores, sources], fields=list(_PIECE))
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns), pa.ListArray.from_arrays(offsets, pieces)], names=[*batch.schema.names, out])

    return df.mapInArrow(work, schema)


def phrase_rows(df: DataFrame, phrases: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """(``row_id``, start, end, label, score) of the phrases of every text, by a join.

    For tables of any size: runs of words that may be a phrase are looked up, each
    once for a part of the texts.  ``row_id`` names rows.
    """
    found = _joined_rows(df, prepared(phrases), row_id, text)
    rows = exploded(found.withColumn("_p", _pieces_of("_packed")), [row_id], "_p", "_p")
    return rows.select(row_id, *[F.col(f"_p.{name}").alias(name) for name in ("start", "end", "label", "score")])


def _numbers(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def _slots(numbers: np.ndarray, words: int, bits: int) -> np.ndarray:
    """Places of all runs of so many words in a table of hashed phrases."""
    runs = max(0, len(numbers) - words + 1)
    out = np.full(runs, words, np.uint64)
    for k in range(words):
        out = (out ^ numbers[k : k + runs]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return ((out >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)


def _listed_slots(table: DataFrame) -> np.ndarray:
    """Bits of the places that the phrases of a table hash to; 16 for a phrase, up to a bound."""
    bits = min(SLOTS, 1 << max(16, (16 * table.count()).bit_length()))

    def slots(batches):
        for batch in batches:
            found = [[low[a:b] for a, b in _bounds(low)] for low in batch.column(0).to_pylist()]
            at = np.array([_slots(_numbers(words), len(words), bits)[0] for words in found], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 16), pa.array(at)], names=["page", "slot"])

    def page(found: pa.Table) -> pa.Table:
        held, at = np.zeros(1 << 16, np.uint8), np.asarray(found.column("slot").combine_chunks())
        held[at & 0xFFFF] = 1
        return pa.table({"page": pa.array([int(at[0]) >> 16], pa.int64()), "held": pa.array([np.packbits(held).tobytes()], pa.binary())})

    whole = np.zeros(bits >> 3, np.uint8)
    pages = table.select("phrase").mapInArrow(slots, "page long, slot long").groupBy("page").applyInArrow(page, "page long, held binary")
    for row in pages.collect():
        whole[row["page"] << 13 : (row["page"] + 1) << 13] = np.frombuffer(row["held"], np.uint8)
    return whole


def _small(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, which the first byte says."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if not len(numbers) or numbers.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + numbers.astype(kind).tobytes()


def _large(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"u{blob[0]}", offset=1).astype(np.int64)


def _runs(texts: list[str | None], sizes: list[int], listed: np.ndarray) -> tuple[dict[str, list[int]], np.ndarray]:
    """Runs of words that may be phrases, with their places in all texts together, and where each text begins there."""
    lows = [lowered(t or "") for t in texts]
    firsts = np.cumsum([0, *map(len, lows)])
    bounds = [_bounds(low) for low in lows]
    rows = np.repeat(np.arange(len(lows)), [len(b) for b in bounds])
    flat = [x for b in bounds for x in b]
    numbers = _numbers([lows[row][a:b] for row, (a, b) in zip(rows.tolist(), flat)])
    found: dict[str, list[int]] = {}
    for n in sizes:
        at = _slots(numbers, n, len(listed) << 3)
        hits = (listed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) & (rows[: len(at)] == rows[n - 1 : n - 1 + len(at)])
        for i in np.flatnonzero(hits).tolist():
            row, start = int(rows[i]), flat[i][0]
            found.setdefault(lows[row][start : flat[i + n - 1][1]], []).append(int(firsts[row]) + start)
    return found, firsts[:-1]


def _leftmost(items) -> list[tuple]:
    """Of (start, -end, ...) in order those that begin behind the ones before."""
    out, reach = [], 0
    for item in items:
        if item[0] >= reach:
            out.append(item)
            reach = -item[1]
    return out


_PACKED = "places binary, label array<string>, score array<double>"


def _pieces_of(packed: str):
    """Spans of a row from what was packed for the texts that bear its id."""

    def of_row(held: list[dict]) -> list[tuple]:
        items = []
        for h in held:
            starts, sizes, kinds = _large(h["places"]).reshape(3, -1)
            starts = np.cumsum(starts)
            items += [(a, -b, h["label"][k], h["score"][k]) for a, b, k in zip(starts.tolist(), (starts + sizes).tolist(), kinds.tolist())]
        items = items if len(held) == 1 else _leftmost(sorted(items))
        return [(a, -b, label, score, MODEL_SOURCE) for a, b, label, score in items]

    def work(rows: pa.Array) -> pa.Array:
        return S.listed([of_row(held or []) for held in rows.to_pylist()], S.FIELDS)

    return over_batches(work, S.SPANS, [F.col(packed)], [F.size(packed)])


def _joined_rows(df: DataFrame, table: DataFrame, row_id: str, text: str) -> DataFrame:
    """(``row_id``, _packed): the phrases of all texts with an id, by a join.

    A bounded table of hashed phrases goes to every task and leaves few runs of
    words.  Each of them is a row once for a part of the texts, with the steps
    between its places; these rows are written, joined to the phrases and brought
    together by part.
    """
    small_batches(df.sparkSession, BATCH_BYTES)
    rows = df.select(F.col(row_id).alias("row"), F.col(text).alias("text"))
    kind = rows.schema["row"].dataType
    # As many rows as phrases have numbers of words: a handful.
    sizes = sorted(r[0] for r in table.select("words").distinct().collect())
    shared = df.sparkSession.sparkContext.broadcast(_listed_slots(table))

    def runs(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _parts(texts):
                found, firsts = _runs(texts[a:b], sizes, shared.value)
                if not found:
                    continue
                part, n = uuid.uuid4().hex, len(found)
                places = [_small(np.diff(np.array(x), prepend=0)) for x in (*found.values(), firsts)]
                held = pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [b - a], pa.int32()), ids.slice(a, b - a), mask=pa.array([True] * n + [False]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * (n + 1)), pa.array([*found, None], pa.string()), pa.array(places, pa.binary()), held], names=["part", "phrase", "places", "rows"])

    fields = [T.StructField("part", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("places", T.BinaryType()), T.StructField("rows", T.ArrayType(kind))]
    made = stored(rows.mapInArrow(runs, T.StructType(fields)))
    found = lookup_join(made.filter("phrase is not null").drop("rows"), table.drop("words"), ["phrase"], "inner")
    none = F.lit(None)
    found = found.select("part", "places", F.length("phrase").alias("size"), "label", "score", none.cast(fields[3].dataType).alias("rows"))
    firsts = made.filter("phrase is null").select("part", "places", none.cast("int").alias("size"), none.cast("string").alias("label"), none.cast("double").alias("score"), "rows")

    def by_row(part: pa.Table) -> pa.Table:
        sizes = part.column("size").to_pylist()
        whose = sizes.index(None)
        ids = part.column("rows").combine_chunks()[whose].values
        places = [np.cumsum(_large(x)) for x in part.column("places").to_pylist()]
        firsts, kinds = places[whose], list(zip(part.column("label").to_pylist(), part.column("score").to_pylist()))
        known = {k: i for i, k in enumerate(dict.fromkeys(kinds))}
        which = np.repeat([known[k] for k in kinds], [0 if n is None else len(p) for n, p in zip(sizes, places)])
        size = np.repeat([n or 0 for n in sizes], [0 if n is None else len(p) for n, p in zip(sizes, places)])
        start = np.concatenate([p[:0] if n is None else p for n, p in zip(sizes, places)])
        row = np.searchsorted(firsts, start, "right") - 1
        start = start - firsts[row]
        order = np.lexsort((-size, start, row))
        edge = np.searchsorted(row[order], np.arange(len(firsts) + 1)).tolist()
        items = list(zip(start[order].tolist(), (-(start + size))[order].tolist(), which[order].tolist()))
        names, at, held, labels, scores = list(known), [], [], [], []
        for i in range(len(firsts)):
            if edge[i] < edge[i + 1]:
                kept = _leftmost(items[edge[i] : edge[i + 1]])
                used = {k: n for n, k in enumerate(dict.fromkeys(k for _, _, k in kept))}
                at.append(i)
                starts = np.array([a for a, _, _ in kept])
                sizes = np.array([-b for _, b, _ in kept]) - starts
                held.append(_small(np.concatenate([np.diff(starts, prepend=0), sizes, [used[k] for _, _, k in kept]])))
                labels.append([names[k][0] for k in used])
                scores.append([names[k][1] for k in used])
        return pa.table({"row": ids.take(pa.array(at, pa.int64())), "places": pa.array(held, pa.binary()), "label": pa.array(labels, pa.list_(pa.string())), "score": pa.array(scores, pa.list_(pa.float64()))})

    schema = T.StructType([T.StructField("row", kind), *T.StructType.fromDDL(_PACKED).fields])
    packed = found.unionByName(firsts).groupBy("part").applyInArrow(by_row, schema)
    return packed.groupBy(F.col("row").alias(row_id)).agg(F.collect_list(F.struct("places", "label", "score")).alias("_packed"))


def with_phrases(df: DataFrame, phrases: DataFrame, text: str = "text", out: str = "pieces", row_id: str | None = None, limit: int = PHRASE_BYTES) -> DataFrame:
    """Add the phrases of each text as ordered spans, the input of ``detect.with_model_spans``.

    The prepared table is measured first.  Up to ``limit`` bytes it goes to every
    task and the texts are read once, without a shuffle; above, it is joined, for
    which ``row_id`` must name rows.  NULL texts have no phrases.
    """
    table = prepared(phrases).persist()
    size = table.agg(F.sum(F.octet_length("phrase") + F.octet_length("label") + 48)).first()[0] or 0
    if size <= limit:
        made = _looked_up(df, table, text, out)
        table.unpersist()
        return made
    if row_id is None:
        raise ValueError("a phrase table of this size is joined to the texts: name a row_id")
    joined = df.join(_joined_rows(df, table, row_id, text), row_id, "left")
    return joined.withColumn(out, _pieces_of("_packed")).drop("_packed")
