"""Labels, chat examples and retrieval against hand-written or brute-force results."""

import numpy as np
from pyspark.sql import functions as F

from cloakframe.operators import chat as CH
from cloakframe.operators import labels as L
from cloakframe.operators import retrieval as RT
from cloakframe.operators import samples as SM

ENTITIES = "array<struct<start:int,end:int,label:string>>"


def test_bio_fixture(spark):
    df = spark.createDataFrame([(1, "Ann Lee lives in Oslo.", [(0, 7, "PER"), (17, 21, "LOC")])], f"id int, text string, entities {ENTITIES}")
    row = L.bio_rows(df, "id").first()
    assert row.tags == ["B-PER", "I-PER", "O", "O", "B-LOC"] and row.ner_tags == [1, 2, 0, 0, 5]


def test_chunks_and_scores(spark):
    rows = [(["B-A", "I-A", "I-B", "O", "I-A", "B-A"], ["B-A", "I-A", "B-B", "O", "O", "B-A"])]
    df = spark.createDataFrame(rows, "p array<string>, a array<string>")
    got = [tuple(c) for c in df.select(L.chunks(F.col("p")).alias("c")).first().c]
    assert got == [("A", 0, 1), ("B", 2, 2), ("A", 4, 4), ("A", 5, 5)]
    score = L.evaluate(df, "p", "a").first()
    assert (score.precision, score.recall, score.accuracy) == (0.75, 1.0, round(4 / 6, 6))


def test_samples_slice_to_their_values(spark):
    df = SM.annotated_samples(spark.range(200), "id")
    for r in df.collect():
        for e in r.entities:
            assert r.text[e.start:e.end] and e.label in SM.C.PLACEHOLDER_LABELS.values()
        assert "{" not in r.text


def test_exact_split_sizes(spark):
    for n, train in ((1, 1), (10, 9), (60, 54)):
        rows = CH.split_statistics(CH.exact_split(spark.range(n), ["id"])).collect()
        assert {r.split: r.n for r in rows} == {k: v for k, v in (("train", train), ("val", n - train)) if v}


def test_examples_per_document(spark):
    doc = "TITLE\nContact:\n- Email: [EMAIL_d249273c]\n- Phone: [PHONE_00958fd0]\nNotes:\n- none\n"
    df = spark.createDataFrame([(1, doc, "tech_startup_000001.txt"), (2, "no tokens", "x.txt")], "id int, text string, file_name string")
    rows = CH.chat_examples(df, "id").collect()
    one = [r for r in rows if r.id == 1]
    assert len(one) == 6 and one[0].kind == "generation"
    assert all(m.content for r in rows for m in r.messages)
    assert {r.kind for r in rows if r.id == 2} <= {"generation", "summary"}
    turns = CH.examples_of_kind(df, "turns", "id").collect()
    assert len(turns) == 1 and len(turns[0].messages) == 5


def test_top_k_equals_brute_force_in_blocks(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(60, 8))
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, embedding array<double>").repartition(5)
    queries = corpus.withColumnRenamed("id", "qid")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    want = {i: [int(j) for j in np.argsort(-(unit @ unit[i]))[:3]] for i in range(60)}
    got = {}
    for r in RT.top_k(corpus, queries, "id", "qid", block=17).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want


def test_names_of_records_past_a_million_differ(spark):
    rows = spark.createDataFrame([(100_000,), (1_000_000,)], "i long")
    names = [r.file_name for r in SM.allot_types(rows, "i", F.lit(10_000_000)).collect()]
    assert len(set(names)) == 2 and names[1].endswith("_1000000.txt")


def test_top_k_does_not_depend_on_the_layout(spark):
    rows = [(i, [1.0, 1e-12 * (9 - i), 0.0]) for i in range(1, 10)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "q long, embedding array<double>")
    found = {n: RT.top_k(corpus.repartition(n), queries, "vec_id", "q", k=1).first().vec_id for n in (1, 7)}
    assert set(found.values()) == {1}


def test_long_labels_stay_apart(spark):
    tags = ["B-" + "x" * 120 + "1", "I-" + "x" * 120 + "2"]
    df = spark.createDataFrame([(tags,)], "p array<string>")
    assert len(df.select(L.chunks(F.col("p")).alias("c")).first().c) == 2


def test_lines_are_those_of_splitlines(spark):
    from cloakframe.functions import arrays as A

    texts = ["a\nb\r\nc\rd", "x\x0by\x0cz\x1cw\x85v u t\n", "", "\n\n", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(A.lines(F.col("text"))).collect()] == [t.splitlines() for t in texts]


def test_audit_rows_without_a_time_are_dated(spark, tmp_path):
    from cloakframe.sources import files as FS

    FS.write_audit(spark.createDataFrame([("u", "EMAIL", "t", "decrypt")], "user_id string, entity_type string, token string, action string"), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).filter("created_at is not null and day is not null").count() == 1
