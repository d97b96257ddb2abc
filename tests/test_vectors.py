"""Exact top-k by cells and the inverted file against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.operators import vectors as V


def frame(spark, data, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], f"{name} long, embedding array<double>")


def plain(data, asked, k):
    unit, want = V.unit_rows(np.asarray(data, float)), V.unit_rows(np.asarray(asked, float))
    near = np.round(want @ unit.T, 9)
    return {q: [int(j) for j in np.lexsort((np.arange(len(unit)), -near[q]))[:k]] for q in range(len(want))}


def lists_of(found, id="id"):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r[id])
    return out


def clustered(n, size, groups, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, size))[rng.integers(groups, size=n)] + 0.35 * rng.normal(size=(n, size))


@pytest.mark.parametrize("cells,block", [(1, 7), (5, 2048), (40, 3)])
def test_exact_equals_brute_force_in_any_layout(spark, monkeypatch, cells, block):
    monkeypatch.setattr(V, "ROW_BLOCK", 16)
    data = np.vstack([np.random.default_rng(1).normal(size=(200, 6)), np.zeros((3, 6)), np.ones((9, 6))])
    found = V.exact_top_k(frame(spark, data).repartition(7), frame(spark, data[::9], "q"), "id", "q", k=4, cells=cells, block=block)
    assert lists_of(found) == plain(data, data[::9], 4)


def test_ids_may_be_names_and_vectors_absent(spark):
    rows = [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", None), (None, [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "id string, embedding array<float>")
    queries = spark.createDataFrame([("x", [1.0, 0.0]), ("y", None)], "q string, embedding array<double>")
    assert lists_of(V.exact_top_k(corpus, queries, "id", "q", k=2)) == {"x": ["a", "b"]}
    assert V.exact_top_k(corpus.limit(0), queries, "id", "q").collect() == []
    assert V.exact_top_k(corpus, queries.limit(0), "id", "q").collect() == []


def test_exact_reads_the_corpus_once_without_the_driver(spark, tmp_path):
    frame(spark, np.random.default_rng(2).normal(size=(50, 4))).write.parquet(str(tmp_path / "c"))
    corpus = spark.read.parquet(str(tmp_path / "c"))
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "nothing may run")
    found = V.exact_top_k(corpus, frame(spark, np.eye(4), "q"), "id", "q", block=1)
    assert status.getJobIdsForGroup("plan") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Broadcast" not in plan


def test_index_finds_nearly_all_and_compares_few(spark, tmp_path):
    data, asked = clustered(3000, 24, 40, 5), clustered(3000, 24, 40, 5)[::60]
    index = V.build_index(frame(spark, data), str(tmp_path / "index"), "id", lists=40)
    queries = frame(spark, asked, "q")
    want, got = plain(data, asked, 5), lists_of(V.search(index, queries, "q", k=5, probes=6))
    assert sum(len(set(want[q]) & set(got[q])) for q in want) / (5 * len(want)) >= 0.9
    assert V.candidates(index, queries, "q", probes=6, rescored=50).count() <= 0.2 * len(data) * len(asked)
    read = V.candidates(index, queries.limit(1), "q", probes=6, rescored=10**6).count()
    assert read < 0.5 * len(data)  # only the lists of the query's nearest centroids


def test_split_lists_and_added_rows_lose_nothing(spark, tmp_path):
    data = clustered(900, 12, 3, 7)  # a list holds a third of all rows
    index = V.build_index(frame(spark, data[:500]), str(tmp_path / "index"), "id", lists=3)
    index.add(frame(spark, data).filter(F.col("id") >= 500))
    queries = frame(spark, data[::50], "q")
    for rows in (50, 1 << 17):
        found = V.candidates(index, queries, "q", probes=3, rescored=900, list_rows=rows)
        assert found.count() == 900 * 18
        assert lists_of(V.rescore(index, found, queries, "q", k=7)) == plain(data, data[::50], 7)


def test_candidates_read_codes_not_vectors(spark, tmp_path):
    index = V.build_index(frame(spark, clustered(100, 8, 4, 1)), str(tmp_path / "index"), "id", lists=4)
    plan = V.candidates(index, frame(spark, np.eye(8), "q"), "q", probes=1)._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation [" in line]
    projected = [line for line in plan.splitlines() if "Project [" in line and "code" in line]
    assert scans and projected and not any("vector#" in line for line in projected)


def test_codes_give_back_the_cosine_closely():
    rng = np.random.default_rng(9)
    for size in (5, 64):
        unit, centroids = V.unit_rows(rng.normal(size=(300, size))), V.unit_rows(rng.normal(size=(4, size)))
        of = (unit @ centroids.T).argmax(axis=1)
        codes, step = V._coded(unit, of, centroids)
        import pyarrow as pa

        levels = V._levels(pa.array(codes, pa.binary()), size)
        made = centroids[of] + step[:, None] * (levels * (2 / V.LEVELS) - 1)
        assert np.abs(made - unit).max() <= step.max() / V.LEVELS + 1e-6
