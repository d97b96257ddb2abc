"""Small building blocks over arrays held inside one row."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUILT: dict = {}
PART_BYTES, PART_ROWS = 1 << 18, 128  # of a batch that are worked on together


def built_once(key: tuple, build: Callable[[], Column]) -> Column:
    """Reuse an unresolved expression; building a large one costs a call to the JVM per node."""
    full = (SparkContext._gateway, *key)
    if full not in _BUILT:
        _BUILT[full] = build()
    return _BUILT[full]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a lambda variable so that the body never re-evaluates it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_parts(work: Callable[..., pa.Array], *arrays: pa.Array) -> pa.Array:
    """``work`` over a batch in parts of about ``PART_BYTES``, so that what it makes of a value in Python is soon let go."""
    rows, held = len(arrays[0]), sum(a.nbytes for a in arrays)
    step = max(1, min(PART_ROWS, rows * PART_BYTES // max(1, held)))
    if rows <= step:
        return work(*arrays)
    return pa.concat_arrays([work(*(a.slice(at, step) for a in arrays)) for at in range(0, rows, step)])


def over_batches(work: Callable, returns: str, columns: list[Column], sizes: list[Column]) -> Column:
    """``work`` over Arrow batches of columns, part by part.

    No Python function is taken out of a plan while an argument holds a lambda in a
    lambda.  ``sizes`` name the columns a second time, so that the planner leaves
    what makes them in a step of its own.  Give columns, not such expressions.
    """

    wanted = len(columns)

    def call(*arrays):
        return in_parts(work, *arrays[:wanted])

    return F.arrow_udf(call, returns)(*columns, *sizes)


def string_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def exploded(df: DataFrame, columns: list, array, name: str, position: str | None = None) -> DataFrame:
    """One row per array element.

    A plain explode makes the optimizer add a size test on the array and push it
    below the step that computes it, which would compute the array twice; the
    outer form with a test on the element does not.
    """
    rows = F.posexplode_outer(array).alias(position, name) if position else F.explode_outer(array).alias(name)
    return df.select(*columns, rows).filter(F.col(name).isNotNull())


PLACES = "array<struct<start:int,end:int,hit:string>>"
_SHORT, _BLOCK = 16, 128


def places(hits: Column, gaps: Column) -> Column:
    """Offsets of pieces from the texts between them, as ``array<struct<start,end,hit>>``.

    A fold copies its result at every step, so it runs over blocks of 16 pieces
    (128 from 2,048 pieces on); the offsets of the blocks are summed first.  Long
    texts stay linear.
    """

    def fold(items: Column, first: Column) -> Column:
        def step(acc: Column, pair: Column) -> Column:
            start = acc["pos"] + F.length(pair["gap"])
            end = start + F.length(pair["hit"])
            place = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
            return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(place)).alias("out"))

        empty = F.struct(first.alias("pos"), F.array().cast(PLACES).alias("out"))
        return F.aggregate(items, empty, step)["out"]

    def size_of(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["hit"]))

    def blocked(pairs: Column) -> Column:
        # Short blocks copy less at each step; very many pieces take longer ones, so that block sums stay few.
        size = F.when(F.size(pairs) <= _SHORT * _BLOCK, F.lit(_SHORT)).otherwise(F.lit(_BLOCK))
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / size).cast("int"))
        blocks = F.transform(numbers, lambda b: F.slice(pairs, b * size + 1, size))

        def put(bound: Column) -> Column:
            return F.flatten(F.transform(bound["blocks"], lambda block, i: fold(block, F.get(bound["firsts"], i))))

        def with_firsts(made: Column) -> Column:
            firsts = F.aggregate(
                made, F.array(F.lit(0)), lambda acc, block: F.concat(acc, F.array(last(acc) + size_of(block)))
            )
            return let(F.struct(made.alias("blocks"), firsts.alias("firsts")), put)

        return F.when(F.size(pairs) <= _SHORT, fold(pairs, F.lit(0))).otherwise(let(blocks, with_firsts))

    zipped = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    return let(zipped, blocked)


def folded_in_runs(spans: Column, fold: Callable[[Column], Column], gap: int) -> Column:
    """``fold`` applied to runs of spans that no span before them comes nearer to than ``gap`` characters.

    A fold copies its result at each step; spans that cannot touch do not need
    one fold, so many spans in one text cost about as much as they are many.
    ``gap`` -1 separates spans that merely do not overlap.
    """

    def reach_before(ends: Column, firsts: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        inside = F.array_max(F.slice(ends, block * _BLOCK + 1, i - block * _BLOCK))
        return F.greatest(F.get(firsts, block), F.coalesce(inside, F.lit(-1)))

    def with_ends(items: Column) -> Column:
        return F.struct(items.alias("items"), F.transform(items, lambda s: s["end"]).alias("ends"))

    def with_firsts(b: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(b["ends"]) - 1) / _BLOCK).cast("int"))
        highest = F.transform(numbers, lambda k: F.array_max(F.slice(b["ends"], k * _BLOCK + 1, F.lit(_BLOCK))))
        firsts = F.aggregate(highest, F.array(F.lit(-1)), lambda acc, x: F.concat(acc, F.array(F.greatest(last(acc), x))))
        return F.struct(b["items"].alias("items"), b["ends"].alias("ends"), firsts.alias("firsts"))

    def with_edges(b: Column) -> Column:
        marked = F.transform(
            b["items"],
            lambda s, i: F.when((i == 0) | (s["start"] > reach_before(b["ends"], b["firsts"], i) + gap), i),
        )
        return F.struct(b["items"].alias("items"), F.filter(marked, lambda i: i.isNotNull()).alias("edges"))

    def cut(b: Column) -> Column:
        def run(first: Column, j: Column) -> Column:
            end = F.coalesce(F.get(b["edges"], j + 1), F.size(b["items"]))
            return fold(F.slice(b["items"], first + 1, end - first))

        return F.flatten(F.transform(b["edges"], run))

    staged = let(let(let(let(spans, with_ends), with_firsts), with_edges), cut)
    return F.when(F.size(spans) <= 32, fold(spans)).otherwise(staged)


def text_slice(text: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` (inclusive) to ``end`` (exclusive), counted in code points."""
    return F.substring(text, start + F.lit(1), end - start)


SLICE = 4096


def text_blocks(text: Column) -> Column:
    """The text in blocks of 4,096 code points, found in one walk.

    ``substring`` walks from the start of a text, so many slices of one long
    text would cost the square of its length; slices of blocks do not.
    """
    return F.when(F.length(text) <= SLICE, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0)))


def block_slice(blocks: Column, start: Column, end: Column) -> Column:
    """:func:`text_slice` of a text given as its blocks."""
    first = F.floor(start / SLICE).cast("int")
    inside = start - first * SLICE
    parts = F.floor((end - 1) / SLICE).cast("int") - first + 1
    one = F.get(blocks, first)
    body = F.when(parts <= 1, one).otherwise(F.array_join(F.slice(blocks, first + 1, F.greatest(parts, F.lit(1))), ""))
    return F.when(end > start, F.substring(body, inside + 1, end - start)).when(blocks.isNotNull(), F.lit(""))


def highest_before(values: Column) -> Column:
    """For each value of an array the highest one before it (-1 for the first), over blocks, so that cost is linear."""

    def with_firsts(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int"))
        highest = F.transform(numbers, lambda k: F.array_max(F.slice(v, k * _BLOCK + 1, F.lit(_BLOCK))))
        firsts = F.aggregate(highest, F.array(F.lit(-1)), lambda acc, x: F.concat(acc, F.array(F.greatest(last(acc), x))))
        return F.struct(v.alias("v"), firsts.alias("firsts"))

    def one(b: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        inside = F.array_max(F.slice(b["v"], block * _BLOCK + 1, i - block * _BLOCK))
        return F.greatest(F.get(b["firsts"], block), F.coalesce(inside, F.lit(-1)))

    return let(let(values, with_firsts), lambda b: F.transform(b["v"], lambda _, i: one(b, i)))


def replace_last(items: Column, item: Column) -> Column:
    return F.concat(F.slice(items, F.lit(1), F.size(items) - F.lit(1)), F.array(item))


def last(items: Column) -> Column:
    """Last element, NULL for an empty array."""
    return F.get(items, F.size(items) - F.lit(1))


def lines(text: Column) -> Column:
    """Lines of a text as ``str.splitlines`` gives them."""
    whole = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)
    return let(
        whole,
        lambda a: F.when(last(a) == F.lit(""), F.slice(a, F.lit(1), F.size(a) - F.lit(1))).otherwise(a),
    )


def strip(text: Column) -> Column:
    """Both ends without any white space (``trim`` alone removes only blanks)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
