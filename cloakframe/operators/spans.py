"""Span arithmetic inside one document row.

A document's spans live in one array column next to its text, so resolving,
trimming, merging and splicing never shuffle and no document is ever a group.
"""

from __future__ import annotations

import bisect
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import KEYWORD_PREFIX_LABELS
from ..functions.arrays import block_slice, folded_in_runs, last, let, over_batches, replace_last, text_blocks

SPAN = "struct<start:int,end:int,label:string,score:double,source:string>"
SPANS = f"array<{SPAN}>"


def span(start, end, label, score, source) -> Column:
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"),
        score.cast("double").alias("score"), source.alias("source"),
    )


def no_spans() -> Column:
    return F.array().cast(SPANS)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def keep_best(spans: Column) -> Column:
    """Greedy overlap resolution over spans already ordered by (start, score desc).

    Kept spans are disjoint and ordered, so only the last one can overlap the
    next candidate; a candidate replaces it when it scores higher.
    """

    def step(kept: Column, candidate: Column) -> Column:
        def choose(previous: Column) -> Column:
            return (
                F.when(previous.isNull() | ~overlaps(previous, candidate), F.concat(kept, F.array(candidate)))
                .when(candidate["score"] > previous["score"], replace_last(kept, candidate))
                .otherwise(kept)
            )

        return let(last(kept), choose)

    return folded_in_runs(spans, lambda run: F.aggregate(run, no_spans(), step), -1)


def _above(a: float | None, b: float | None) -> bool:
    """``a > b`` as columns compare: a NaN is above every number, nothing is above a NULL."""
    return a is not None and b is not None and (a > b or (a != a and b == b))


def _merged(spans: list[tuple], gap: int) -> list[tuple]:
    out = []
    for span in spans:
        if out:
            start, end, label, score, source = out[-1]
            if end is not None and span[0] is not None and span[0] <= end + gap:
                better = _above(span[3], score)
                best = span[3] if better or score is None else score
                out[-1] = (start, end if span[1] is None or span[1] <= end else span[1], span[2] if better else label, best, span[4] if better else source)
                continue
        out.append(span)
    return out


def values(column: pa.Array) -> list:
    """What ``to_pylist`` gives of numbers or of strings that repeat, many times as fast."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        coded = column.dictionary_encode()
        known = [*coded.dictionary.to_pylist(), None]
        return [known[i] for i in coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).tolist()]
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def span_lists(column: pa.Array) -> list[list[tuple] | None]:
    """The spans of each row as tuples; a NULL stays one."""
    sizes = column.value_lengths().to_pylist()
    fields = column.flatten().flatten()
    items = list(zip(*map(values, fields)))
    out, at = [], 0
    for size in sizes:
        out.append(None if size is None else items[at : at + size])
        at += size or 0
    return out


def listed(rows: list[list[tuple] | None], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """Tuples of each row as an array of structs."""
    columns = list(zip(*(item for row in rows if row for item in row))) or [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])
    offsets = list(itertools.accumulate((len(row or ()) for row in rows), initial=0))
    nulls = pa.array([row is None for row in rows] , pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, mask=nulls)


FIELDS = [("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("score", pa.float64()), ("source", pa.string())]


@lru_cache(maxsize=64)
def merger(gap: int):
    def merge(spans: pa.Array) -> pa.Array:
        return listed([row and _merged(row, gap) for row in span_lists(spans)], FIELDS)

    return merge


def merge_near(spans: Column, gap: int = 1) -> Column:
    """Join spans that overlap or lie at most ``gap`` characters apart.

    Input is ordered by start.  Label, source and score come from the best
    span, the earliest one on equal scores.  One step over a batch of rows: a
    fold of columns copies its result with every span.
    """
    return over_batches(merger(gap), SPANS, [spans.cast(SPANS)], [F.size(spans)])


def trim_prefix(blocks: Column, s: Column, may_trim: Column) -> Column:
    """Move a start past the last blank, else colon, else hyphen, if something is left; the text comes in blocks."""

    def cut(value: Column) -> Column:
        size = F.length(value)
        back = F.reverse(value)
        moved = F.lit(None).cast("int")
        for sep in ("-", ":", " "):
            tail = F.instr(back, sep) - 1
            moved = F.when(tail > 0, size - tail).otherwise(moved)
        return s["start"] + F.coalesce(moved, F.lit(0))

    start = F.when(may_trim, let(block_slice(blocks, s["start"], s["end"]), cut)).otherwise(s["start"])
    return span(start, s["end"], s["label"], s["score"], s["source"])


def is_prefix_label(label: Column) -> Column:
    return label.isin(*KEYWORD_PREFIX_LABELS)


def _joined(column: pa.Array) -> pa.Array:
    sizes = np.asarray(column.value_lengths().fill_null(0))
    start, end, label, score, source = column.flatten().flatten()
    count = len(start)
    first = np.cumsum([0, *sizes])
    known = np.ones(count, bool)
    known[first[:-1][sizes > 0]] = False  # nothing stands before the first piece of a row
    codes = np.asarray(label.dictionary_encode().indices.fill_null(-1))
    starts, ends = (np.asarray(f.fill_null(0)).astype(np.int64) for f in (start, end))
    for has in (label, end):
        known[1:] &= np.asarray(has.is_valid())[:-1]
    known &= np.asarray(label.is_valid()) & np.asarray(start.is_valid())
    known[1:] &= (codes[1:] == codes[:-1]) & (starts[1:] <= ends[:-1] + 1)
    begins = np.flatnonzero(~known)
    lasts = np.append(begins[1:], count) - 1 if count else begins
    scores = score
    if count:
        best = np.maximum.reduceat(np.asarray(score.fill_null(float("-inf"))), begins)
        scores = pa.array(best, mask=~np.logical_or.reduceat(np.asarray(score.is_valid()), begins))
    fields = [start.take(pa.array(begins)), end.take(pa.array(lasts)), label.take(pa.array(begins)), scores, source.take(pa.array(begins))]
    made = pa.StructArray.from_arrays(fields, [name for name, _ in FIELDS])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, first).astype(np.int32)), made, mask=column.is_null())


def join_pieces(spans: Column) -> Column:
    """Merge consecutive model pieces of one label that touch (start <= previous end + 1).

    The end is the newest piece's end and the score the best of the run.  Whether
    a piece goes on with a run depends on the piece before it alone, so all pieces
    of a batch of rows are looked at together.
    """
    return over_batches(_joined, SPANS, [spans.cast(SPANS)], [F.size(spans)])


def _free(spans: list[tuple], rules: list[tuple]) -> list[tuple]:
    if not spans or not rules:
        return spans
    begun = sorted((-1 if r[0] is None else r[0], -1 if r[1] is None else r[1]) for r in rules)
    starts = [start for start, _ in begun]
    reach = [-1, *itertools.accumulate((end for _, end in begun), max)]
    kept = [s for s in spans if s[0] is not None and (s[1] is None or reach[bisect.bisect_left(starts, s[1])] <= s[0])]
    return sorted(kept, key=lambda s: tuple((x is not None, x) for x in s))


def _not_covered(spans: pa.Array, rules: pa.Array) -> pa.Array:
    rows = zip(span_lists(spans), span_lists(rules))
    return listed([None if s is None or r is None else _free(s, r) for s, r in rows], FIELDS)


def not_covered(spans: Column, rules: Column) -> Column:
    """Spans that share no character with any rule span, in order.

    A span is covered if some rule that starts before its end also ends after its
    start: rules are sorted by start, with the highest end so far.
    """
    return over_batches(_not_covered, SPANS, [spans.cast(SPANS), rules.cast(SPANS)], [F.size(spans), F.size(rules)])


def splice(text: Column, spans: Column, piece) -> Column:
    """Text with every (disjoint, ordered) span replaced by ``piece(span)``."""

    def build(bound: Column) -> Column:
        body, items = bound["text"], bound["spans"]

        def part(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(items, i - 1)["end"])
            return F.concat(block_slice(body, before, s["start"]), piece(s))

        tail = block_slice(body, last(items)["end"], bound["size"])
        return F.concat(F.array_join(F.transform(items, part), ""), tail)

    return F.when(F.size(spans) == 0, text).otherwise(
        let(F.struct(text_blocks(text).alias("text"), spans.alias("spans"), F.length(text).alias("size")), build)
    )
