"""Merging and naming spans: one step over a batch of rows, not a fold of columns."""

from cloakframe.operators import spans as S
from cloakframe.operators import tokenize as T

ROWS = [
    (1, "ann@x.org and ann@x.org", [(0, 9, "EMAIL_ADDRESS", .5, "RULE"), (14, 23, "LOC", .9, "RULE")]),
    (2, "abcdef", [(0, 2, "A", None, "RULE"), (2, 4, "B", .5, "RULE"), (3, 6, "C", float("nan"), "RULE")]),
    (3, None, None), (4, "", []),
]


def test_merge_and_entities_run_on_batches(spark):
    df = spark.createDataFrame(ROWS, f"id int, text string, spans {S.SPANS}")
    made = T.with_entities(df)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") >= 2 and "aggregate(" not in plan
    rows = {r.id: r.entities for r in made.collect()}
    assert [(e.label, e.value) for e in rows[1]] == [("LOCATION", "ann@x.org")] * 2  # the rightmost label wins
    assert rows[1][0].token == rows[1][1].token and rows[1][0].token.startswith("[LOCATION_")
    # A missing score is below nothing and above nothing, NaN is above every number.
    assert [(e.start, e.end, e.label, e.source) for e in rows[2]] == [(0, 6, "C", "RULE")] and rows[2][0].score != rows[2][0].score
    assert rows[3] is None and rows[4] == []


def test_merge_of_many_spans_by_gap(spark):
    many = [(3 * i, 3 * i + 1, "X", .1 + (i == 7), "RULE") for i in range(1000)]
    df = spark.createDataFrame([(many,)], f"spans {S.SPANS}")
    one, all_ = df.select(
        S.merge_near(df.spans).alias("a"), S.merge_near(df.spans, 2).alias("b")).first()
    assert len(one) == 1000 and [(s.start, s.end, s.score) for s in all_] == [(0, 2998, 1.1)]


def test_words_and_model_spans_run_on_batches(spark):
    from pyspark.sql import functions as F

    from cloakframe.operators import detect as D
    from cloakframe.operators.labels import words

    texts = ["é b c\x0bd", " \n", "", None, "😀😀 x", "tail "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(1)
    rows = df.withColumn("w", words(F.col("text")))
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()
    found = {r.id: r.w and [tuple(w) for w in r.w] for r in rows.collect()}
    assert found == {0: [(0, 1, "é"), (2, 5, "b c"), (6, 7, "d")], 1: [], 2: [], 3: None, 4: [(0, 2, "😀😀"), (3, 4, "x")], 5: [(0, 4, "tail")]}

    pieces = [(0, 3, "P", .9, "M"), (4, 6, "P", None, "M"), (6, 7, "Q", None, "M"), (7, 9, None, .99, "M"), (9, 12, None, .98, "M"), (30, 31, "P", .97, "M")]
    spans = spark.createDataFrame([(1, pieces, [(5, 20, "R", .1, "RULE"), (1, 2, "R", .1, "RULE")]), (2, [], []), (3, None, [])], f"id int, p {S.SPANS}, r {S.SPANS}").repartition(1)
    joined = {r.id: r.m and [tuple(s) for s in r.m] for r in spans.select("id", S.join_pieces(F.col("p")).alias("m")).collect()}
    assert joined == {1: [(0, 6, "P", .9, "M"), *pieces[2:]], 2: [], 3: None}
    made = D.with_model_spans(spans, "p", "r", 0.5)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") >= 2
    assert [tuple(s) for s in made.filter("id = 1").first().spans] == [(1, 2, "R", .1, "RULE"), (5, 20, "R", .1, "RULE"), (30, 31, "P", .97, "M")]


def test_batches_take_columns_made_by_nested_lambdas(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS[:1], f"id int, text string, spans {S.SPANS}").repartition(1)
    kept = F.filter("spans", lambda a: F.size(F.filter("spans", lambda b: b["start"] < a["start"])) == 0)
    assert [e.value for e in T.with_entities(df.withColumn("spans", kept)).first().entities] == ["ann@x.org"]
