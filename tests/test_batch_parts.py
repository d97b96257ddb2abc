"""Python steps take a batch in parts: what they hold at once does not grow with the rows of a batch."""

import tracemalloc

import pyarrow as pa

from cloakframe.catalog import CATALOGUE
from cloakframe.operators import scan


def _peak(work, *arrays):
    tracemalloc.start()
    try:
        return work(*arrays), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_batch_is_that_of_its_parts(spark):
    line = "mail ann.x@example.org or call (212) 555-0199, ssn 123-45-6789, EMP-1234, host 10.0.0.7. " * 10
    texts = pa.array([line + str(i) if i % 7 else None for i in range(6000)])
    find = scan.scanner(CATALOGUE)[0].func
    make = scan.span_maker(CATALOGUE, [()] * len(CATALOGUE), "RULE", 5, 0.35, 0.4, True, None, True).func
    matches, held = _peak(find, texts)
    spans, more = _peak(make, texts, matches)
    assert held < 30 << 20 and more < 30 << 20
    assert len(matches) == len(spans) == 6000 and matches[0].as_py() == spans[0].as_py() == []
    few = [1, 127, 128, 129, 5999]
    assert [spans[i].as_py() for i in few] == [make(texts[i : i + 1], find(texts[i : i + 1])).to_pylist()[0] for i in few]


def test_parts_of_uneven_rows_and_lists():
    from cloakframe.functions.arrays import in_parts

    calls = []

    def work(a, b):
        calls.append(len(a))
        return pa.array([None if x is None else [len(x), len(y)] for x, y in zip(a.to_pylist(), b.to_pylist())], pa.list_(pa.int64()))

    texts, lists = pa.array([None, "", "x" * 50_000, "y"] * 500), pa.array([[1] * (i % 3) for i in range(2000)])
    made = in_parts(work, texts[3:], lists[3:])
    assert made.to_pylist() == [None if t is None else [len(t), len(n)] for t, n in zip(texts[3:].to_pylist(), lists[3:].to_pylist())]
    assert max(calls) < 100 and in_parts(work, texts[:0], lists[:0]).to_pylist() == []


def test_check_digits_of_values_are_those_of_columns(spark):
    from pyspark.sql import functions as F

    from cloakframe.functions.checks import CHECKS, VALUE_CHECKS

    values = ["4111 1111 1111 1111", "4111111111111112", "0", "", "GB82 WEST 1234 5698 7654 32", "gb82west12345698765433", "DE89370400440532013000",
              "943 476 5919", "9434765918", "123", "AB1234563", "ZZ1234567", "٤٣1234563"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for kind, column in CHECKS.items():
        known = rows.filter("length(regexp_replace(v, '[^0-9]', '')) > 9" if kind == "mod11" else "length(regexp_replace(v, '[^0-9]', '')) > 6" if kind == "dea" else "true")
        for r in known.select("v", F.coalesce(column(F.col("v")), F.lit(False)).alias("ok")).collect():
            assert VALUE_CHECKS[kind](r["v"]) == r["ok"], (kind, r["v"])


def test_checked_matches_carry_no_texts(spark):
    from cloakframe.operators import detect as D

    df = spark.createDataFrame([(1, "card 4111111111111111 or 4111111111111112, iban GB82WEST12345698765432"), (2, None)], "id int, text string")
    made = D.with_rule_spans(df)
    assert "hit" not in made._jdf.queryExecution().analyzed().toString()
    cards = {r["id"]: [r["text"][s.start : s.end] for s in r["spans"] if s.label in ("CREDIT_CARD", "IBAN_CODE")] for r in made.collect()}
    assert cards == {1: ["4111111111111111", "GB82WEST12345698765432"], 2: []}


def test_customer_texts_are_made_after_the_customers_are_dealt_out(spark, tmp_path):
    from cloakframe.plans.registry import customer_texts

    spark.createDataFrame([(1, 2), (None, 3), (1, 2)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    made = customer_texts(spark, str(tmp_path), "'n ' || d4", "c_nationkey as scope")
    below = made._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[1]
    assert "lpad" not in below and sorted(made.collect(), key=str) == [(1, "n 0001", 2), (1, "n 0001", 2), (None, None, 3)]
