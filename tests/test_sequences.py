"""Tag sequences: hashing as the feature hasher's, decoding against all paths, texts as rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.operators import labels as L
from cloakframe.operators import samples as SM
from cloakframe.operators import tagger as TG


@pytest.fixture(scope="module")
def trained(spark):
    parts = L.split_samples(SM.annotated_samples(spark.range(400).withColumnRenamed("id", "n"), "n"), "n").persist()
    train = parts.filter("split = 'train'")
    return parts, TG.fit(train, "n", 512, 5), TG.fit_sequences(train, "n", 512, 5)


def test_scores_are_those_of_the_word_model(spark, trained):
    parts, plain, model = trained
    test = parts.filter("split = 'test'")
    want = {(r["n"], r["start"]): r["tag"] for r in TG.tag_words(plain, test, "n").collect()}
    free = TG.SequenceTagger(model.weights, model.intercept, np.zeros(len(L.TAGS)), np.zeros((len(L.TAGS),) * 2))
    rows = TG.tag_texts(free, test.withColumn("w", L.words(F.col("text")))).select("n", "w", "tags").collect()
    got = {(r["n"], w["start"]): t for r in rows for w, t in zip(r["w"], r["tags"])}
    assert got == want and len(got) > 400


def test_paths_equal_the_best_of_all(spark):
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(0, 5, size=4)
        scores, start, moves = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=3), rng.normal(size=(3, 3))
        got, at = TG.best_paths(scores, lengths, start, moves), 0
        for n in lengths:
            part = scores[at : at + n]
            if n:
                best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: start[p[0]] + part[np.arange(n), p].sum() + sum(moves[a, b] for a, b in zip(p, p[1:])))
                assert got[at : at + n].tolist() == list(best)
            at += n


def test_sequences_are_well_formed_and_hold_out(spark, trained):
    parts, _, model = trained
    tagged = TG.tag_texts(model, parts.filter("split = 'test'").withColumn("actual", L.bio_tags(L.words(F.col("text")), F.col("entities"))))
    assert L.evaluate(tagged, "tags", "actual").first()["f1"] >= 0.8
    for r in tagged.collect():
        for before, tag in zip(["O", *r["tags"]], r["tags"]):
            assert not tag.startswith("I-") or before[2:] == tag[2:]
        spans = [(p["start"], p["end"]) for p in r["pieces"]]
        assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_odd_texts_stay_rows(spark, trained):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (4, "x " * 30_000), (5, "Ann")], "n long, text string")
    got = {r["n"]: r for r in TG.tag_texts(trained[2], rows).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and len(got[4]["tags"]) == 30_000 and not got[2]["tags"] and not got[1]["pieces"]
    assert TG.tag_texts(trained[2], rows.limit(0)).collect() == []
