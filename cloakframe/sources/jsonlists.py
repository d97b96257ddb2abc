"""JSON files read in parallel, also inside one large list.

The scan cuts files at commas, wherever its splits begin; most commas separate
nothing that matters.  A first pass sums up every split for both cases, that it
begins inside a string or outside: quotes, change of depth, and commas by depth.
From these few numbers follows in which state each split really begins, so a
second pass knows the commas between items of a list.  Items that lie in one
split are whole at once; only those that cross into the next are put together.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_name

_ESCAPE = re.compile(r"\\.", re.DOTALL)
_COUNTS = pa.map_(pa.int32(), pa.int64())


def _pieces(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file_path, block (where the split begins), row (rising within it) and the text up to the next comma."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return spark.read.text(path, lineSep=",", pathGlobFilter=pattern).select(
        decoded.alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
        F.make_valid_utf8("value").alias("piece"))


def _parts(piece: str) -> list[str]:
    """A piece cut at the quotes that open or close strings."""
    return (_ESCAPE.sub("", piece) if "\\" in piece else piece).split('"')


def _rise(parts: list[str]) -> int:
    text = "".join(parts)
    return text.count("[") + text.count("{") - text.count("]") - text.count("}")


def _summaries(pieces: DataFrame) -> DataFrame:
    """Per split: its first sign, whether quotes are odd, and, begun outside (0) or inside (1) a string, rise and commas by depth."""

    def work(batches):
        current, state, rise, commas, head = None, 0, [0, 0], [{}, {}], ""

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([current[0]], pa.string()), pa.array([current[1]], pa.int64()), pa.array([head[:1]], pa.string()), pa.array([state], pa.int32()),
                 *[pa.array([n], pa.int64()) for n in rise], *[pa.array([list(c.items())], _COUNTS) for c in commas]],
                names=["file_path", "block", "head", "odd", "rise0", "rise1", "commas0", "commas1"])

        for batch in batches:
            for path, block, piece in zip(*(batch.column(c).to_pylist() for c in ("file_path", "block", "piece"))):
                if (path, block) != current:
                    if current:
                        yield row()
                    current, state, rise, commas, head = (path, block), 0, [0, 0], [{}, {}], ""
                head = head or piece.lstrip()[:1]
                parts = _parts(piece)
                for begun in (0, 1):
                    rise[begun] += _rise(parts[state ^ begun :: 2])
                state ^= (len(parts) - 1) & 1
                outside = state  # the case that stands outside a string now
                commas[outside][rise[outside]] = commas[outside].get(rise[outside], 0) + 1
        if current:
            yield row()

    counts = "map<int,bigint>"
    return pieces.select("file_path", "block", "piece").mapInArrow(
        work, f"file_path string, block long, head string, odd int, rise0 long, rise1 long, commas0 {counts}, commas1 {counts}")


def _starts(pieces: DataFrame) -> DataFrame:
    """Per split: the state it begins in, commas between items before it, whether it is the last; per file: is it a list, how many such commas, is it closed."""
    by_file = Window.partitionBy("file_path")
    before = by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(name):
        return F.coalesce(F.sum(name).over(before), F.lit(0))

    rows = _summaries(pieces).withColumn("state", (earlier("odd") % 2).cast("int"))
    chosen = lambda name: F.when(F.col("state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    rows = rows.withColumn("rise", chosen("rise")).withColumn("depth", earlier("rise"))
    rows = rows.withColumn("is_list", F.coalesce(F.first(F.when(F.col("head") != "", F.col("head")), True).over(by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == "[", F.lit(False)))
    between = F.coalesce(F.try_element_at(chosen("commas"), (1 - F.col("depth")).cast("int")), F.lit(0))
    rows = rows.withColumn("between", F.when(F.col("is_list"), between).otherwise(F.lit(0)))
    return rows.select(
        "file_path", "block", "state", "depth", "is_list", earlier("between").alias("first_item"), F.sum("between").over(by_file).alias("last_item"),
        F.lead("block").over(by_file.orderBy("block")).isNull().alias("last"),
        ((F.sum("odd").over(by_file) % 2 == 0) & (F.sum("rise").over(by_file) == 0)).alias("closed"))


def json_items(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """file_path, item (from 0), is_list, closed and text of the items of lists; a file that is no list is one item.

    ``text`` is the JSON of an item; ``closed`` is false for files whose quotes or
    brackets do not close.  An empty list gives no row, an empty file none either.
    A file is read by as many tasks as the scan makes splits of it, twice; only
    items that lie in two splits, and files that are no lists, are shuffled.
    """
    pieces = _pieces(spark, path, pattern)
    placed = pieces.join(_starts(pieces), ["file_path", "block"]).sortWithinPartitions("file_path", "block", "row")

    def work(batches):
        names = ["file_path", "block", "state", "depth", "is_list", "first_item", "last_item", "last", "closed", "piece"]
        current, state, depth, item, parts, fresh, about = None, 0, 0, 0, [], True, None

        def fragment(whole):
            path, block, is_list, last_item, closed = about
            return path, block, item, is_list, last_item, closed, whole, ",".join(parts)

        def made(rows):
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
            columns = zip(*rows) if rows else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["file_path", "block", "item", "is_list", "last_item", "closed", "whole", "text"])

        ends = False
        for batch in batches:
            out = []
            for path, block, begin, deep, is_list, first, last_item, last, closed, piece in zip(*(batch.column(n).to_pylist() for n in names)):
                if (path, block) != current:
                    if parts:
                        out.append(fragment(fresh and ends))
                    current, state, depth, item, parts = (path, block), begin, deep, first, []
                    fresh, ends, about = block == 0, last, (path, block, is_list, last_item, closed)
                cut = _parts(piece)
                depth += _rise(cut[state::2])
                state ^= (len(cut) - 1) & 1
                parts.append(piece)
                if is_list and depth == 1 and not state:
                    out.append(fragment(fresh))
                    item, parts, fresh = item + 1, [], True
            yield made(out)
        if parts:
            yield made([fragment(fresh and ends)])

    found = placed.mapInArrow(
        work, "file_path string, block long, item long, is_list boolean, last_item long, closed boolean, whole boolean, text string")
    columns = ["file_path", "item", "is_list", "last_item", "closed"]
    ordered = F.sort_array(F.collect_list(F.struct("block", "text")))
    crossing = found.filter("not whole").groupBy(*columns).agg(ordered.alias("t"))
    items = found.filter("whole").select(*columns, "text").unionByName(
        crossing.select(*columns, F.array_join(F.transform("t", lambda t: t["text"]), ",").alias("text")))
    bare = F.when(F.col("is_list") & (F.col("item") == 0), F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text"))
    bare = F.when(F.col("is_list") & (F.col("item") == F.col("last_item")), F.regexp_replace(bare, r"\]\s*$", "")).otherwise(bare)
    items = items.withColumn("text", bare)
    empty = F.col("is_list") & F.col("closed") & (F.col("last_item") == 0) & F.col("text").rlike(r"^\s*$")
    return items.filter(~empty).select("file_path", base_name(F.col("file_path")).alias("file_name"), "item", "is_list", "closed", "text")


def rejected_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Paths of files that hold no valid JSON; files without a byte are not seen by any scan."""
    return files_with_bad_items(json_items(spark, path, pattern))


def files_with_bad_items(items: DataFrame) -> DataFrame:
    """Paths of the files among ``json_items`` that hold no valid JSON."""
    bad = ~F.col("closed") | F.try_parse_json("text").isNull()
    return items.filter(bad).select("file_path").distinct()


def file_texts(spark: SparkSession, path: str, pattern: str, wanted: DataFrame) -> DataFrame:
    """file_path and whole text of some files (``wanted``: file_path)."""
    rows = _pieces(spark, path, pattern).join(wanted, "file_path", "left_semi")
    whole = rows.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("block", "row", "piece"))).alias("p"))
    return whole.select("file_path", F.array_join(F.transform("p", lambda p: p["piece"]), ",").alias("text"))
