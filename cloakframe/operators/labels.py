"""Word labels for tagging and their evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.arrays import highest_before, let, over_batches
from ..functions.choice import hash_number

TAGS: list[str] = ["O"] + [f"{side}-{label}" for label in C.TAG_LABELS for side in ("B", "I")]
CHUNKS = "array<struct<label:string,first:int,last:int>>"


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _words(texts: pa.Array) -> pa.Array:
    """Words of a batch of texts, found in their UTF-8 bytes by whole-array steps."""
    filled = texts.fill_null("").cast(pa.large_string())
    first = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    held = filled.buffers()[2]
    data = np.frombuffer(held or b"", np.uint8)[first[0] : first[-1]]
    first = first - first[0]
    inside = ~_WHITE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled_rows = first[:-1] < first[1:]
    for edges, at in ((begins, first[:-1][filled_rows]), (ends, first[1:][filled_rows] - 1)):
        edges[at] = inside[at]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    places = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=places[1:])
    counts = np.searchsorted(begins, first)
    shift = np.repeat(places[first[:-1]], np.diff(counts))
    size = np.zeros(len(begins) + 1, np.int32)
    np.cumsum(ends - begins, out=size[1:])
    found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(size.tobytes()), pa.py_buffer(data[inside].tobytes()))
    made = pa.StructArray.from_arrays([pa.array(places[begins] - shift, pa.int32()), pa.array(places[ends] - shift, pa.int32()), found], ["start", "end", "word"])
    return pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), made, mask=texts.is_null())


def words(text: Column) -> Column:
    """Words (runs without white space) with offsets, as ``array<struct<start,end,word>>``."""
    return over_batches(_words, "array<struct<start:int,end:int,word:string>>", [text.cast("string")], [F.octet_length(text.cast("string"))])


def bio_tags(word_spans: Column, entities: Column) -> Column:
    """A tag per word: the first listed entity that overlaps it, B- when the word starts at or before it.

    Entities are sorted and cut into islands that do not overlap.  The ends of
    islands sorted among the starts of words, and their starts among the ends of
    words, tell which islands a word meets; it is compared with their entities
    only.  Words must be in order and apart, as :func:`words` gives them.
    """

    def numbered(e: Column, i: Column) -> Column:
        return F.struct(e["start"].alias("start"), e["end"].alias("end"), i.alias("no"), e["label"].alias("label"))

    def with_reach(e: Column) -> Column:
        return F.struct(e.alias("e"), highest_before(F.transform(e, lambda x: x["end"])).alias("reach"))

    def with_edges(b: Column) -> Column:
        edges = F.filter(F.transform(b["e"], lambda x, i: F.when(F.get(b["reach"], i) <= x["start"], i)), lambda i: i.isNotNull())
        return F.struct(b["e"].alias("e"), b["reach"].alias("reach"), edges.alias("edges"))

    def islands(b: Column) -> Column:
        def island(first: Column, j: Column) -> Column:
            after = F.get(b["edges"], j + 1)
            part = F.slice(b["e"], first + 1, F.coalesce(after, F.size(b["e"])) - first)
            listed = F.sort_array(F.transform(part, lambda x: F.struct(x["no"].alias("no"), x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"))))
            end = F.coalesce(F.get(b["reach"], after), F.array_max(F.transform(part, lambda x: x["end"])))
            return F.struct(F.get(b["e"], first)["start"].alias("start"), end.alias("end"), listed.alias("listed"))

        return F.transform(b["edges"], island)

    def ranks(words: Column, others: Column, word_first: bool) -> Column:
        """Where each of the words stands when sorted among others; less its own number, how many of these come before."""
        kind = F.lit(0 if word_first else 2)
        points = F.concat(
            F.transform(others, lambda x: F.struct(x.alias("at"), F.lit(1).alias("kind"))),
            F.transform(words, lambda x: F.struct(x.alias("at"), kind.alias("kind"))))
        return F.filter(F.transform(F.sort_array(points), lambda p, k: F.when(p["kind"] != 1, k)), lambda k: k.isNotNull())

    def with_ranks(b: Column) -> Column:
        first = ranks(F.transform(b["w"], lambda w: w["start"]), F.transform(b["i"], lambda x: x["end"]), False)
        after = ranks(F.transform(b["w"], lambda w: w["end"]), F.transform(b["i"], lambda x: x["start"]), True)
        return F.struct(b["w"].alias("w"), b["i"].alias("i"), first.alias("first"), after.alias("after"))

    def tagged(b: Column) -> Column:
        def tag(w: Column, k: Column) -> Column:
            first, after = F.get(b["first"], k) - k, F.get(b["after"], k) - k
            near = F.flatten(F.transform(F.slice(b["i"], first + 1, F.greatest(after - first, F.lit(0))), lambda x: x["listed"]))
            hit = F.array_min(F.filter(near, lambda e: F.greatest(w["start"], e["start"]) < F.least(w["end"], e["end"])))
            return let(
                hit,
                lambda e: F.when(e.isNull(), F.lit("O"))
                .when(w["start"] <= e["start"], F.concat(F.lit("B-"), e["label"]))
                .otherwise(F.concat(F.lit("I-"), e["label"])),
            )

        return F.transform(b["w"], tag)

    known = F.sort_array(F.filter(F.transform(entities, numbered), lambda x: x["start"] < x["end"]))
    found = let(let(let(known, with_reach), with_edges), islands)
    with_islands = F.struct(word_spans.alias("w"), found.alias("i"))
    some = let(let(with_islands, with_ranks), tagged)
    return F.when(F.size(entities) > 0, some).otherwise(F.transform(word_spans, lambda w: F.lit("O")))


def _tag_table() -> Column:
    return F.expr("map(" + ", ".join(f"'{t}', {i}" for i, t in enumerate(TAGS)) + ")")


def tag_ids(tags: Column) -> Column:
    """Vocabulary ids; a tag outside the vocabulary counts as O."""
    return F.transform(tags, lambda t: F.coalesce(F.try_element_at(_tag_table(), t), F.lit(0)))


def tag_names(ids: Column) -> Column:
    names = F.expr("array(" + ", ".join(f"'{t}'" for t in TAGS) + ")")
    return F.transform(ids, lambda i: F.get(names, i))


def bio_rows(df: DataFrame, row_id: str, text: str = "text", entities: str = "entities") -> DataFrame:
    """Rows (id, tokens, tags, ner_tags) of annotated samples."""
    staged = df.withColumn("_words", words(F.col(text)))
    tagged = staged.withColumn("tags", bio_tags(F.col("_words"), F.col(entities)))
    return tagged.select(
        F.col(row_id).cast("string").alias("id"), F.transform("_words", lambda w: w["word"]).alias("tokens"),
        "tags", tag_ids(F.col("tags")).alias("ner_tags"),
    )


def split_samples(df: DataFrame, row_id: str, test_share: float = 0.2, seed=42) -> DataFrame:
    """Mark each row train or test by a hash of its id: repeatable, no shuffle."""
    bucket = hash_number(seed, F.col(row_id), "split") % 1000
    return df.withColumn("split", F.when(bucket < int(round(test_share * 1000)), "test").otherwise("train"))


def aligned_labels(word_ids: Column, labels: Column) -> Column:
    """Label of the first piece of each word; later pieces and specials are ignored."""
    ignored = F.lit(C.IGNORED_LABEL_ID)

    def build(b: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(b["w"], i - 1))
            return F.when(w.isNull() | w.eqNullSafe(before), ignored).otherwise(F.get(b["l"], w))

        return F.transform(b["w"], one)

    return let(F.struct(word_ids.alias("w"), labels.alias("l")), build)


def best_labels(scores: Column, labels: Column) -> Column:
    """Highest-scoring label id and true id of every position that is not ignored."""
    pairs = F.arrays_zip(
        F.transform(scores, lambda s: F.array_position(s, F.array_max(s)).cast("int") - 1).alias("predicted"),
        labels.alias("actual"),
    )
    return F.filter(pairs, lambda p: p["actual"] != C.IGNORED_LABEL_ID)


def chunks(tags: Column) -> Column:
    """Entity chunks of a tag sequence: B-, a new label, or I- after O opens one."""

    def label_of(tag: Column) -> Column:
        return F.substring(tag, F.lit(3), F.length(tag))

    def edges(t: Column) -> Column:
        """Where a chunk opens or an O stands, in order."""

        def edge(tag: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(t, i - 1)).otherwise(F.lit("O"))
            opens = F.startswith(tag, F.lit("B-")) | (before == "O") | (label_of(before) != label_of(tag))
            return F.when((tag == "O") | opens, F.struct(i.alias("i"), F.when(tag != "O", label_of(tag)).alias("label")))

        return F.struct(F.filter(F.transform(t, edge), lambda e: e.isNotNull()).alias("e"), F.size(t).alias("n"))

    def closed(b: Column) -> Column:
        def one(e: Column, j: Column) -> Column:
            end = F.coalesce(F.get(b["e"], j + 1)["i"], b["n"]) - 1
            return F.when(e["label"].isNotNull(), F.struct(e["label"].alias("label"), e["i"].alias("first"), end.alias("last")))

        return F.filter(F.transform(b["e"], one), lambda c: c.isNotNull())

    return let(let(tags, edges), closed).cast(CHUNKS)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def evaluate(df: DataFrame, predicted: str, actual: str, by: list[str] | None = None) -> DataFrame:
    """Entity precision, recall and F1 (exact chunks) and tag accuracy, from per-row counts."""
    # As strings they are matched by hash; structs would be compared each with each.
    text = lambda c: F.transform(chunks(F.col(c)), lambda x: F.concat_ws("|", x["first"], x["last"], x["label"]))
    staged = df.withColumns({"_p": text(predicted), "_a": text(actual)})
    counted = staged.select(
        *(by or []),
        F.size("_p").alias("n_p"), F.size("_a").alias("n_a"), F.size(F.array_intersect("_p", "_a")).alias("n_hit"),
        F.size(actual).alias("n_tags"),
        F.size(F.filter(F.arrays_zip(F.col(predicted).alias("p"), F.col(actual).alias("a")), lambda z: z["p"] == z["a"])).alias("n_same"),
    )
    sums = counted.groupBy(*(by or [])).agg(
        *[F.sum(c).alias(c) for c in ("n_p", "n_a", "n_hit", "n_tags", "n_same")]
    )
    precision, recall = _ratio(F.col("n_hit"), F.col("n_p")), _ratio(F.col("n_hit"), F.col("n_a"))
    return sums.select(
        *(by or []), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
        F.round(_ratio(precision * recall * 2, precision + recall), 6).alias("f1"),
        F.round(_ratio(F.col("n_same"), F.col("n_tags")), 6).alias("accuracy"),
    )
