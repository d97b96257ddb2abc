"""Exact and approximate nearest vectors by cosine, in cells that one task scores at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import let

QUERY_BLOCK = 2048
ROW_BLOCK = 4096
LIST_ROWS = 1 << 17  # rows of an inverted list that one task scores; larger lists are split
SAMPLE_OF_LIST = 64  # rows a list in the sample that centroids are fitted on
ROUNDS = 12
LEVELS = 15  # steps of a code: four bits for each number


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(column) -> np.ndarray:
    """Unit rows of a column of arrays that all have the same length."""
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return let(
        F.struct(a.alias("a"), b.alias("b")),
        lambda s: dot(s["a"], s["b"]) / F.sqrt(dot(s["a"], s["a"]) * dot(s["b"], s["b"])),
    )


def ranked(pairs: DataFrame, id: str, k: int, by: str = "similarity") -> DataFrame:
    """The ``k`` best rows of every query with their rank; ties go by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(by, 9)), F.col(id))
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# --- cells -------------------------------------------------------------------------------------------------------


def _kept(row: np.ndarray, place: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of every row; ties go by place."""
    order = np.lexsort((place, -score, row))
    row, place, score = row[order], place[order], score[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], place[keep], score[keep]


def _best(queries: np.ndarray, size: int, scores: Callable, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the ``k`` best of ``size`` rows, a block of rows at a time."""
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for a in range(0, size, ROW_BLOCK):
        found = np.round(scores(queries, a, min(a + ROW_BLOCK, size)), 9)  # as in the last ranking: ties end alike in any layout
        enough = -np.partition(-found, k - 1, axis=1)[:, k - 1 : k] if found.shape[1] > k else -np.inf
        row, place = np.nonzero(found >= enough)
        best = _kept(*(np.concatenate(x) for x in zip(best, (row, place + a, found[row, place]))), k)
    return best


def best_in_cells(
    stored: DataFrame, asked: DataFrame, id: str, prepare: Callable, k: int, cells: int, score: str = "similarity",
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` best rows of each cell for every query sent there: (query_id, ``id``, ``score``, cell).

    ``stored`` (cell, ``id``, more columns) and ``asked`` (cell, query_id, vector)
    are shuffled once, by cell.  A task keeps the stored rows of one cell, in
    order of id, and streams its queries past them; ``prepare`` makes, from the
    cell and its rows as Arrow columns by name, a function (unit queries, first
    row, end row) -> scores.
    """
    more = [c for c in stored.columns if c not in ("cell", id)]
    empty = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = stored.select("cell", F.lit(0).cast("tinyint").alias("kind"), id, *more, empty(asked, "query_id"), empty(asked, "asked"))
    rows = rows.unionByName(asked.select(
        "cell", F.lit(1).cast("tinyint").alias("kind"), empty(stored, id), *[empty(stored, c) for c in more], "query_id", "asked"))
    dealt = rows.repartition(cells, "cell").sortWithinPartitions("cell", "kind", id)
    schema = T.StructType([
        T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField(id, stored.schema[id].dataType),
        T.StructField(score, T.DoubleType()), T.StructField("cell", T.LongType()),
    ])

    def run(batches):
        current, held, ids, scores = None, [], None, None
        for batch in batches:
            cell, kind = np.asarray(batch.column("cell")), np.asarray(batch.column("kind"))
            if not len(cell):
                continue
            edge = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])]))
            for a, b in zip(edge, np.append(edge[1:], len(cell))):
                if cell[a] != current:
                    current, held, scores = cell[a], [], None
                if kind[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if not held:
                    continue
                if scores is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    ids = table.column(id).combine_chunks()
                    scores = prepare(int(current), {c: table.column(c).combine_chunks() for c in more})
                for at in range(a, b, block):
                    part = batch.slice(at, min(block, b - at))
                    row, place, found = _best(_matrix(part.column("asked")), len(ids), scores, k)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("query_id").take(pa.array(row)), ids.take(pa.array(place)), pa.array(found), pa.array(np.full(len(row), current))],
                        names=["query_id", id, score, "cell"])

    return dealt.mapInArrow(run, schema)


def _filled(df: DataFrame, id: str, vector: str, as_id: str, as_vector: str) -> DataFrame:
    return df.filter(F.col(vector).isNotNull()).select(F.col(id).alias(as_id), F.col(vector).alias(as_vector))


def exact_top_k(
    corpus: DataFrame, queries: DataFrame, id: str, query_id: str, vector: str = "embedding", k: int = 5,
    block: int = QUERY_BLOCK, cells: int | None = None,
) -> DataFrame:
    """Exact cosine top-k of every query over the whole corpus: (query_id, ``id``, similarity, rank).

    Corpus rows are dealt to ``cells`` (as many as shuffle partitions) by a hash
    of id and vector, every query goes to every cell, and a ranked window over k
    rows a cell and query finishes.  So the corpus is read and shuffled once,
    however many queries there are, and neither side passes through the driver.  A
    cell's vectors must fit in a task: raise the shuffle partitions with the
    corpus.  Rows without a vector are neither found nor asked for.
    """
    cells = cells or int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = _filled(corpus, id, vector, id, "stored").withColumn("cell", F.pmod(F.xxhash64(id, "stored"), F.lit(cells)))
    asked = _filled(queries, query_id, vector, "query_id", "asked").withColumn("cell", F.explode(F.expr(f"sequence(0L, {cells - 1}L)")))

    def prepare(cell, rows):
        matrix = _matrix(rows["stored"])
        return lambda q, a, b: q @ matrix[a:b].T

    return ranked(best_in_cells(stored, asked, id, prepare, k, cells, block=block).drop("cell"), id, k)


# --- inverted file -----------------------------------------------------------------------------------------------


def _clustered(unit: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centroids of unit rows by directions; a list that loses all rows starts again at the row worst placed."""
    rng = np.random.default_rng(seed)
    centroids = unit[rng.choice(len(unit), min(lists, len(unit)), replace=False)]
    for _ in range(ROUNDS):
        near = unit @ centroids.T
        of = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, unit)
        lost = np.flatnonzero(np.bincount(of, minlength=len(centroids)) == 0)
        sums[lost] = unit[np.argsort(near.max(axis=1), kind="stable")[: len(lost)]]
        centroids = unit_rows(sums)
    return centroids


def fit_centroids(corpus: DataFrame, vector: str = "embedding", lists: int = 64, seed: int = 42) -> np.ndarray:
    """Unit centroids of ``lists`` inverted lists, from a sample of about ``SAMPLE_OF_LIST`` rows a list.

    The sample is bounded by that number, clustered in one task, and only the
    centroids come to the driver.
    """
    rows = corpus.select(F.col(vector).alias("v")).filter("v is not null")
    share = min(1.0, lists * SAMPLE_OF_LIST / max(1, rows.count()))

    def fit(batches):
        parts = [_matrix(b.column(0)) for b in batches if len(b)]
        if parts:
            made = _clustered(np.vstack(parts), lists, seed)
            yield pa.RecordBatch.from_pydict({"list": np.arange(len(made), dtype=np.int32), "centroid": pa.array(list(made))})

    sample = rows.sample(share, seed=seed) if share < 1 else rows
    found = sample.repartition(1).mapInArrow(fit, "list int, centroid array<double>").collect()
    return np.array([r["centroid"] for r in sorted(found, key=lambda r: r["list"])])


def _coded(unit: np.ndarray, of: np.ndarray, centroids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """What a row differs from its centroid, four bits a number, and the size of a step."""
    rest = unit - centroids[of]
    most = np.abs(rest).max(axis=1)
    level = np.rint(np.divide(rest, most[:, None], out=np.zeros_like(rest), where=most[:, None] > 0) * (LEVELS / 2) + LEVELS / 2).astype(np.uint8)
    if level.shape[1] % 2:
        level = np.hstack([level, np.zeros((len(level), 1), np.uint8)])
    return [row.tobytes() for row in level[:, ::2] | (level[:, 1::2] << 4)], most.astype(np.float32)


def _levels(codes, size: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
    out = np.empty((len(packed), 2 * packed.shape[1]), np.float32)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out[:, :size]


@dataclass(frozen=True)
class VectorIndex:
    """An inverted file: ``path``/vectors has one folder per list, ``path``/lists the centroids."""

    path: str
    id: str = "id"

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")

    def centroids(self, spark: SparkSession) -> np.ndarray:
        found = spark.read.parquet(f"{self.path}/lists").select("list", "centroid").collect()
        return np.array([r["centroid"] for r in sorted(found, key=lambda r: r["list"])])

    def add(self, corpus: DataFrame, vector: str = "embedding") -> None:
        """Store more rows in the lists of their nearest centroids; rows without a vector are left out."""
        centroids = self.centroids(corpus.sparkSession)
        rows = _filled(corpus, self.id, vector, self.id, "vector").withColumn("vector", F.col("vector").cast("array<float>"))
        kind = next(f for f in rows.schema.fields if f.name == self.id).dataType

        def place(batches):
            for batch in batches:
                if not len(batch):
                    continue
                unit = _matrix(batch.column(1))
                of = (unit @ centroids.T).argmax(axis=1)
                codes, step = _coded(unit, of, centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(codes, pa.binary()), pa.array(step), pa.array(of.astype(np.int32))],
                    names=[self.id, "vector", "code", "step", "list"])

        schema = T.StructType([
            T.StructField(self.id, kind), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("code", T.BinaryType()),
            T.StructField("step", T.FloatType()), T.StructField("list", T.IntegerType()),
        ])
        # Rebalancing gives each list few files and cuts lists that hold much of the corpus.
        rows.mapInArrow(place, schema).hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{self.path}/vectors")


def build_index(corpus: DataFrame, path: str, id: str, vector: str = "embedding", lists: int = 64, seed: int = 42) -> VectorIndex:
    """An inverted file of all rows of the corpus at ``path``, with centroids fitted on a bounded sample."""
    spark = corpus.sparkSession
    centroids = fit_centroids(corpus, vector, lists, seed)
    if not len(centroids):
        raise ValueError("the corpus has no vectors")
    index = VectorIndex(path, id)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/lists")
    index.add(corpus, vector)
    return index


def candidates(
    index: VectorIndex, queries: DataFrame, query_id: str, vector: str = "embedding", probes: int = 8, rescored: int = 50,
    list_rows: int = LIST_ROWS, cells: int | None = None,
) -> DataFrame:
    """(query_id, id, list, estimate, rank) of the rows of every query whose codes promise most.

    A query goes to its ``probes`` nearest lists.  Of the index only these lists
    are read, and of them only ids and codes (half a byte a number); lists of
    more than ``list_rows`` rows are split by a hash of the id.  The ``rescored``
    best estimates of a query go on.
    """
    spark, id = queries.sparkSession, index.id
    cells = cells or int(spark.conf.get("spark.sql.shuffle.partitions"))
    centroids = index.centroids(spark)
    rows = _filled(queries, query_id, vector, "query_id", "asked")
    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])

    def probe(batches):
        for batch in batches:
            if not len(batch):
                continue
            near = np.argsort(-(_matrix(batch.column(1)) @ centroids.T), axis=1, kind="stable")[:, :probes]
            again = pa.array(np.repeat(np.arange(len(batch)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(again) for c in batch.columns), pa.array(near.ravel().astype(np.int32))], names=["query_id", "asked", "list"])

    # No more rows than lists: safe to broadcast.
    parts = index.rows(spark).groupBy("list").agg(F.expr(f"cast(ceil(count(*) / {list_rows}) as int)").alias("parts"))
    sent = rows.mapInArrow(probe, schema).join(F.broadcast(parts), "list")
    whole = F.col("list").cast("long") * (1 << 31)
    asked = sent.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select((whole + F.col("part")).alias("cell"), "query_id", "asked")
    read = index.rows(spark).select(id, "code", "step", "list").join(F.broadcast(parts), "list")
    part = F.pmod(F.xxhash64(id), F.col("parts"))
    stored = read.select((whole + part).alias("cell"), id, "code", "step")

    def prepare(cell, found):
        centroid = centroids[cell >> 31]
        levels, step = _levels(found["code"], len(centroid)), found["step"].to_numpy(zero_copy_only=False)

        def scores(q, a, b):
            return (q @ centroid)[:, None] + step[a:b] * ((q.astype(np.float32) @ levels[a:b].T) * np.float32(2 / LEVELS) - q.sum(axis=1)[:, None])

        return scores

    best = best_in_cells(stored, asked, id, prepare, rescored, cells, score="estimate")
    return ranked(best, id, rescored, "estimate").withColumn("list", F.expr("cast(shiftright(cell, 31) as int)")).drop("cell")


def rescore(index: VectorIndex, found: DataFrame, queries: DataFrame, query_id: str, vector: str = "embedding", k: int = 5) -> DataFrame:
    """The ``k`` best candidates of every query by the cosine of whole vectors: (query_id, id, similarity, rank)."""
    spark, id = queries.sparkSession, index.id
    asked = _filled(queries, query_id, vector, "query_id", "asked")
    met = found.select("query_id", id, "list").join(index.rows(spark).select(id, "list", "vector"), ["list", id]).join(asked, "query_id")
    similarity = F.coalesce(cosine(F.col("asked"), F.col("vector")), F.lit(0.0))
    return ranked(met.select("query_id", id, F.round(similarity, 9).alias("similarity")), id, k)


def search(
    index: VectorIndex, queries: DataFrame, query_id: str, vector: str = "embedding", k: int = 5, probes: int = 8,
    rescored: int | None = None, **layout,
) -> DataFrame:
    """Approximate cosine top-k from the index; ``rescored`` (10 k) candidates of a query are compared in full."""
    found = candidates(index, queries, query_id, vector, probes, rescored or 10 * k, **layout)
    return rescore(index, found, queries, query_id, vector, k)
