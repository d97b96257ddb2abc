"""Queries that once did less than their whole job."""

def test_a_nation_is_one_document(spark, tmp_path):
    from cloakframe.plans import ORACLES, QUERIES

    customers = spark.range(900, 4100).selectExpr("id AS c_custkey", "CAST(id % 3 AS INT) AS c_nationkey", "'AUTO' AS c_mktsegment")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    found = {r["nation"]: r["text"] for r in QUERIES["whole_document_source"](spark, str(tmp_path)).collect()}
    assert found == {n: "".join(f"Client of AUTO, mail c{k}@example.org\n" for k in range(900, 4100) if k % 3 == n) for n in range(3)}
    assert "//" not in ORACLES["whole_document_source"]


def test_recall_is_counted(spark, tmp_path):
    from cloakframe.plans import QUERIES

    rows = [(i, [float((i * 7 + j * 13) % 11 - 5) + i / 1000 for j in range(8)], i % 4) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["approximate_recall"](spark, str(tmp_path)).first().asDict()
    assert found["wanted"] == found["found"] == 12 and found["recall"] == 1.0
