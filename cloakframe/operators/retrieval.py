"""Chunks, vectors and cosine top-k."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.arrays import exploded, strip
from ..functions.text import record_keyword
from ..session import run_folder
from . import vectors


def chunks(df: DataFrame, source: str, text: str = "text", min_chars: int = C.MIN_CHUNK_CHARS) -> DataFrame:
    """Records of each text between separator lines, longer than ``min_chars``, numbered per text."""
    parts = F.filter(
        F.transform(F.split(F.col(text), C.RECORD_SEPARATOR, -1), strip), lambda c: F.length(c) > min_chars
    )
    rows = exploded(df, [F.col(source).cast("string").alias("source")], parts, "text", "chunk_index")
    return rows.select(
        F.concat("source", F.lit("_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "source", "chunk_index",
        record_keyword(F.col("text")).alias("record_type"), "text",
    )


def new_chunks(candidates: DataFrame, indexed: DataFrame) -> DataFrame:
    """Chunks whose id is not indexed yet."""
    return candidates.join(indexed.select("chunk_id"), "chunk_id", "left_anti")


def write_index(rows: DataFrame, path: str, reset: bool = False) -> None:
    """Append to the index, or replace it."""
    rows.write.mode("overwrite" if reset else "append").parquet(path)


def index_counts(indexed: DataFrame, added: DataFrame) -> DataFrame:
    """Chunks before and after adding."""
    marked = indexed.select(F.lit(0).alias("_new")).unionByName(added.select(F.lit(1).alias("_new")))
    return marked.agg(
        F.count_if(F.col("_new") == 0).alias("before"), F.count_if(F.col("_new") == 1).alias("added"),
        F.count(F.lit(1)).alias("after"),
    )


def fit_embedder(df: DataFrame, text: str = "text", features: int = 1024) -> PipelineModel:
    """Hashed term weights as unit vectors (a stand-in for a sentence model)."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_terms", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]).fit(df)


def embed(model: PipelineModel, df: DataFrame, out: str = "embedding") -> DataFrame:
    made = model.transform(df)
    return made.withColumn(out, vector_to_array("_unit", "float32")).drop("_terms", "_tf", "_idf", "_unit")


def top_k(
    corpus: DataFrame, queries: DataFrame, id: str, query_id: str, vector: str = "embedding", k: int = C.TOP_K,
    block: int = vectors.QUERY_BLOCK, cells: int | None = None,
) -> DataFrame:
    """Exact cosine top-k of every query over the whole corpus, in one pass over it (``vectors.exact_top_k``)."""
    return vectors.exact_top_k(corpus, queries, id, query_id, vector, k, block, cells)


def approximate_top_k(
    corpus: DataFrame, queries: DataFrame, id: str, query_id: str, vector: str = "embedding", k: int = C.TOP_K,
    lists: int = 64, probes: int = 8, rescored: int | None = None, seed: int = 42,
) -> DataFrame:
    """Approximate cosine top-k over an inverted file made for this call; ``vectors.build_index`` makes one that stays."""
    index = vectors.build_index(corpus, run_folder(corpus.sparkSession), id, vector, lists, seed)
    return vectors.search(index, queries, query_id, vector, k, probes, rescored)


def recall(exact: DataFrame, found: DataFrame, id: str) -> DataFrame:
    """Share of the exact top-k that was found."""
    hits = exact.select("query_id", id).join(
        found.select("query_id", id, F.lit(1).alias("_hit")), ["query_id", id], "left"
    )
    return hits.agg(
        F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("found"),
        F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("recall"),
    )


def relevant(ranked: DataFrame, floor: float = C.RELEVANCE_FLOOR) -> DataFrame:
    """Top-k rows that are similar enough; fewer than k may stay."""
    return ranked.filter(F.col("similarity") >= F.lit(floor))


def contexts(ranked: DataFrame, documents: DataFrame, id: str, text: str = "text", kind: str = "record_type") -> DataFrame:
    """Context text per query from its ranked documents (at most k rows each)."""
    joined = ranked.join(documents.select(id, text, kind), id)
    piece = F.format_string(
        "[Retrieved %s record (relevance %.2f)]:\n%s", F.coalesce(F.col(kind), F.lit("record")), F.col("similarity"), F.col(text)
    )
    grouped = joined.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", piece.alias("piece")))).alias("_p"))
    return grouped.select(
        "query_id", F.array_join(F.transform("_p", lambda p: p["piece"]), C.CHUNK_JOINER).alias("context")
    )


def retrieve(
    corpus: DataFrame, queries: DataFrame, id: str, query_id: str, query_text: str | None = None, k: int = C.TOP_K,
    floor: float = C.RELEVANCE_FLOOR, vector: str = "embedding",
) -> DataFrame:
    """Context per query; an empty text for blank queries or when nothing is similar enough."""
    from ..functions.text import is_filled

    asked = queries.filter(is_filled(F.col(query_text))) if query_text else queries
    best = relevant(top_k(corpus, asked, id, query_id, vector, k), floor)
    made = contexts(best, corpus, id).withColumnRenamed("query_id", query_id)
    return queries.select(query_id).join(made, query_id, "left").withColumn(
        "context", F.coalesce("context", F.lit(""))
    )
