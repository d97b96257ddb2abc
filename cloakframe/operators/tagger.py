"""A linear word tagger from Spark ML, standing in for the contextual model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import exploded, let
from ..session import stored
from . import gazetteer
from . import spans as S
from .detect import MODEL_SOURCE
from .labels import TAGS, bio_tags, tag_ids, words

FEATURES = ["word", "shape", "before", "after", "tail"]


def _shape(word: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.regexp_replace(word, r"[A-Z]+", "X"), r"[a-z]+", "x"), r"[0-9]+", "9"
    )


def word_features(word_spans: Column, tags: Column) -> Column:
    """Per word its place, label and features; neighbours are read inside the row's word array."""

    def build(b: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            near = lambda j: F.lower(F.coalesce(F.get(b["w"], j)["word"], F.lit("")))
            return F.struct(
                w["start"].alias("start"), w["end"].alias("end"), F.get(b["t"], i).cast("double").alias("label"),
                F.lower(w["word"]).alias("word"), _shape(w["word"]).alias("shape"),
                F.when(i > 0, near(i - 1)).otherwise(F.lit("")).alias("before"), near(i + 1).alias("after"),
                F.lower(F.substring(w["word"], -3, 3)).alias("tail"),
            )

        return F.transform(b["w"], one)

    return let(F.struct(word_spans.alias("w"), tags.alias("t")), build)


def word_rows(df: DataFrame, row_id: str, text: str = "text", entities: str | None = None) -> DataFrame:
    """One row per word with its neighbours."""
    staged = df.withColumn("_w", words(F.col(text)))
    tags = tag_ids(bio_tags(F.col("_w"), F.col(entities))) if entities else F.transform("_w", lambda w: F.lit(0))
    staged = staged.withColumn("_t", tags)
    return exploded(staged, [row_id], word_features(F.col("_w"), F.col("_t")), "w").select(row_id, "w.*")


def fit(samples: DataFrame, row_id: str, features: int = 4096, iterations: int = 20) -> PipelineModel:
    """Train on annotated samples; their features are written once, as training passes over them many times."""
    rows = stored(word_rows(samples, row_id, entities="entities"))
    stages = [
        FeatureHasher(inputCols=FEATURES, outputCol="features", numFeatures=features, categoricalCols=FEATURES),
        LogisticRegression(maxIter=iterations, regParam=1e-4, family="multinomial"),
    ]
    return Pipeline(stages=stages).fit(rows)


def tag_words(model: PipelineModel, df: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """Best tag and its probability for every word."""
    scored = model.transform(word_rows(df, row_id, text))
    names = F.expr("array(" + ", ".join(f"'{t}'" for t in TAGS) + ")")
    return scored.select(
        row_id, "start", "end", F.get(names, F.col("prediction").cast("int")).alias("tag"),
        F.array_max(vector_to_array("probability")).alias("score"),
    )


def with_pieces(model: PipelineModel, df: DataFrame, row_id: str, text: str = "text", out: str = "pieces") -> DataFrame:
    """Model output per text as ordered spans, the input of ``detect.with_model_spans``."""
    tagged = tag_words(model, df, row_id, text).filter(F.col("tag") != "O")
    piece = S.span(F.col("start"), F.col("end"), F.substring("tag", F.lit(3), F.length("tag")), F.col("score"), F.lit(MODEL_SOURCE))
    pieces = tagged.groupBy(row_id).agg(F.sort_array(F.collect_list(piece)).alias(out))
    return df.join(pieces, row_id, "left").withColumn(out, F.coalesce(F.col(out), S.no_spans()))


# --- whole sequences ---------------------------------------------------------------------------------------------

WORDS_OF_A_PART = 1 << 14  # words scored at a time
NEVER = -1e30


def murmur(data: bytes, seed: int = 42) -> int:
    """32-bit Murmur3, signed: what the feature hasher does with a string."""

    def scramble(k: int) -> int:
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        return (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF

    h, whole = seed, len(data) & ~3
    for i in range(0, whole, 4):
        h ^= scramble(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    if len(data) > whole:
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def best_paths(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Most probable tag of every word, text by text (log scores, one row per word), all texts side by side."""
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, lengths = first[order], lengths[order]
    back = np.zeros(scores.shape, np.int16)
    reached = np.full((len(lengths), scores.shape[1]), NEVER)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -t))  # texts that have a word t
        at = first[:live] + t
        if t == 0:
            reached[:live] = start + scores[at]
            continue
        ways = reached[:live, :, None] + moves
        back[at] = ways.argmax(axis=1)
        reached[:live] = ways.max(axis=1) + scores[at]
    out = np.zeros(len(scores), np.int64)
    some = int(np.searchsorted(-lengths, 0))
    tag = reached[:some].argmax(axis=1)
    for t in range(int(lengths[0]) - 1 if len(lengths) else -1, -1, -1):
        live = int(np.searchsorted(-lengths, -t))
        at = first[:live] + t
        out[at] = tag[:live]
        if t:
            tag[:live] = back[at, tag[:live]]
    return out


@dataclass(frozen=True)
class SequenceTagger:
    """A word model with the probabilities of one tag after another: everything a task needs to tag whole texts."""

    weights: np.ndarray  # features x tags
    intercept: np.ndarray
    start: np.ndarray
    moves: np.ndarray

    def log_scores(self, columns: dict) -> np.ndarray:
        """Log probabilities of tags of words, from their features as Arrow columns by name."""
        total = np.broadcast_to(self.intercept, (len(columns[FEATURES[0]]), len(self.intercept))).copy()
        for name in FEATURES:
            coded = columns[name].dictionary_encode()
            places = np.array([murmur(f"{name}={v}".encode()) % len(self.weights) for v in coded.dictionary.to_pylist()], np.int64)
            total += self.weights[places[np.asarray(coded.indices)]]
        total -= total.max(axis=1, keepdims=True)
        return total - np.log(np.exp(total).sum(axis=1, keepdims=True))


def fit_sequences(samples: DataFrame, row_id: str, features: int = 4096, iterations: int = 20) -> SequenceTagger:
    """Train the word model and count which tags follow each other (I- only after B- or I- of its label)."""
    fitted = fit(samples, row_id, features, iterations).stages[-1]
    known = fitted.coefficientMatrix.numRows
    weights, intercept = np.zeros((features, len(TAGS))), np.full(len(TAGS), NEVER)
    weights[:, :known] = fitted.coefficientMatrix.toArray().T
    intercept[:known] = np.maximum(np.nan_to_num(fitted.interceptVector.toArray(), neginf=NEVER), NEVER)
    tags = samples.select(tag_ids(bio_tags(words(F.col("text")), F.col("entities"))).alias("t")).filter(F.size("t") > 0)
    after = F.concat(F.array(F.lit(-1)), F.slice("t", F.lit(1), F.size("t") - 1))
    pairs = tags.select(F.explode(F.arrays_zip(after.alias("a"), F.col("t").alias("b"))).alias("p")).groupBy("p.a", "p.b").count()
    counts = np.ones((len(TAGS) + 1, len(TAGS)))  # at most that many rows come back
    for a, b, n in pairs.collect():
        counts[a, b] += n
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    inside = np.array([t.startswith("I-") for t in TAGS])
    allowed = np.array([[not i or (a != "O" and a[2:] == b[2:]) for b, i in zip(TAGS, inside)] for a in TAGS])
    return SequenceTagger(weights, intercept, np.where(inside, NEVER, logs[-1]), np.where(allowed, logs[:-1], NEVER))


def _counted_parts(lengths: np.ndarray):
    row = 0
    sums = np.append(0, np.cumsum(lengths))
    while row < len(lengths):
        end = max(row + 1, int(np.searchsorted(sums, sums[row] + WORDS_OF_A_PART, "right")) - 1)
        yield row, end, int(sums[row]), int(sums[end])
        row = end


def tag_texts(model: SequenceTagger, df: DataFrame, text: str = "text", out: str = "pieces") -> DataFrame:
    """Add ``tags`` (one per word) and the entities they make as ordered spans (``out``).

    The tags of a text are its most probable sequence.  A span's score is the mean
    probability of its words.  Features are made by the engine, scores by batches
    of words, and a text stays one row: nothing is exploded or shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    none = F.transform("_w", lambda w: F.lit(0))
    staged = df.withColumn("_w", words(F.col(text))).withColumn("_f", word_features(F.col("_w"), none)).drop("_w")
    kept = [f for f in staged.schema.fields if f.name != "_f"]
    piece = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("score", pa.float64()), ("source", pa.string())])
    spans = T.StructType.fromDDL(f"x {S.SPANS}")["x"].dataType
    schema = T.StructType([*kept, T.StructField("tags", T.ArrayType(T.StringType())), T.StructField(out, spans)])

    def entities(tags, chance, starts, ends):
        made, k = [], 0
        while k < len(tags):
            stop = k + 1
            if tags[k] != "O":
                while stop < len(tags) and tags[stop] == f"I-{tags[k][2:]}":
                    stop += 1
                made.append((starts[k], ends[stop - 1], tags[k][2:], float(np.mean(chance[k:stop])), MODEL_SOURCE))
            k = stop
        return [dict(zip(("start", "end", "label", "score", "source"), m)) for m in made]

    def work(batches):
        tagger, names = shared.value, np.array(TAGS, object)
        for batch in batches:
            lists = batch.column("_f")
            lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            words_ = lists.flatten()
            columns = dict(zip((f.name for f in words_.type), words_.flatten()))
            for a, b, first, end in _counted_parts(lengths):
                part = {n: c.slice(first, end - first) for n, c in columns.items()}
                scores = tagger.log_scores(part)
                best = best_paths(scores, lengths[a:b], tagger.start, tagger.moves)
                chance = np.exp(scores[np.arange(len(best)), best])
                found, cut = names[best], np.append(0, np.cumsum(lengths[a:b]))
                starts, ends = part["start"].to_pylist(), part["end"].to_pylist()
                rows = [entities(found[x:y].tolist(), chance[x:y], starts[x:y], ends[x:y]) for x, y in zip(cut, cut[1:])]
                tags = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(found.tolist(), pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(f.name).slice(a, b - a) for f in kept), tags, pa.array(rows, pa.list_(piece))], names=schema.names)

    return staged.select(*[f.name for f in kept], "_f").mapInArrow(work, schema)


def with_phrases(df: DataFrame, phrases: dict[str, list[str]], text: str = "text", score: float = 0.85, out: str = "pieces") -> DataFrame:
    """Spans of phrases listed per label; ``gazetteer.with_phrases`` takes a table."""
    listed = [(phrase, label, score) for label, phrases_ in phrases.items() for phrase in phrases_]
    return gazetteer.with_phrases(df, df.sparkSession.createDataFrame(listed, "phrase string, label string, score double"), text, out)
