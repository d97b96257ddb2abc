"""The floor of the language stage is measured on all held-out documents."""

from pyspark.sql import functions as F

from cloakframe.llm import language


def test_floor_scores_every_held_out_document(spark, monkeypatch):
    docs = spark.range(14000).selectExpr("id AS doc_id", "'the quiet river runs past an old mill ' || id AS text", "'en' AS lang")
    profiles = language.fit(docs.limit(200))
    whole, seen = language.identify, []
    monkeypatch.setattr(language, "identify", lambda d, p: seen.append(d.count()) or whole(d, p))
    assert language.floor(docs, profiles) > 0
    assert seen == [docs.filter(language.held_out()).count()] and seen[0] > language.DOCS_PER_LANGUAGE


def test_profiles_may_be_learned_from_all_documents(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "if(id % 1000 = 1, 'zzzz qqqq', 'the quiet river') AS text", "'en' AS lang")
    some, every = (language.fit(docs, per_language=n) for n in (1, None))
    assert set(some.grams) < set(every.grams) and len(every.names) == 1
    assert docs.filter(~language.held_out()).filter(F.col("text").startswith("zzzz")).count() > 0
