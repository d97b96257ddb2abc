"""Sources and sinks on small hand-made files."""

import json

import pytest
from pyspark.sql import functions as F

from cloakframe.sources import files, schemas


def test_lines_keep_order_and_replace_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ntw\xff\nthree ann@x.org\n")
    rows = files.read_lines(spark, str(tmp_path)).orderBy("unit_no").collect()
    assert [(r.unit_no, r.text) for r in rows] == [(0, "one"), (1, "tw�"), (2, "three ann@x.org")]


def test_documents_whole(spark, tmp_path):
    (tmp_path / "gov_contractor_000001.txt").write_text("a\nb")
    (tmp_path / "skip.csv").write_text("x")
    rows = files.read_records(spark, str(tmp_path)).collect()
    assert [(r.file_name, r.text, r.record_title) for r in rows] == [
        ("gov_contractor_000001.txt", "a\nb", "Government Contractor")
    ]


def test_json_shapes(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"text": "mail ann@x.org", "n": 1}, "host 10.0.0.7", 5, {"k": 2}]))
    (tmp_path / "one.json").write_text(json.dumps({"text": "PROJ-1234", "keep": [1, 2]}))
    (tmp_path / "raw.json").write_text(json.dumps({"note": "ann@x.org"}))
    out = {(r.file_name, r.unit_no): json.loads(r.output) for r in files.tokenize_json(spark, str(tmp_path)).collect()}
    assert out[("list.json", 0)] == {"text": "mail [EMAIL_d249273c]", "n": 1}
    assert out[("list.json", 1)] == "host [IP_00958fd0]"
    assert out[("list.json", 2)] == 5
    assert out[("list.json", 3)] == {"k": 2}
    assert out[("one.json", 0)] == {"text": "[PROJECT_ID_77b7965b]", "keep": [1, 2]}
    assert out[("raw.json", 0)] == {"note": "[EMAIL_d249273c]"}


def test_broken_raw_json_becomes_string(spark):
    rows = spark.createDataFrame([("raw", False, '{"a": 5', '{"a": 1}')], "shape string, in_object boolean, tokenized string, j string")
    made = files.rebuilt_item(rows.withColumn("item", F.parse_json("j"))).first().output
    assert json.loads(made) == '{"a": 5'


def test_annotated_good_and_rejected(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps([{"text": "Ann Lee", "entities": [[0, 7, "PER"]]}, {"text": "x"}, {"entities": []}]))
    good, bad = files.read_annotated(spark, str(p))
    assert [(r.text, [tuple(e) for e in r.entities]) for r in good.collect()] == [("Ann Lee", [(0, 7, "PER")])]
    assert bad.count() == 2
    strict, _ = files.read_annotated(spark, str(p), fail_fast=True)
    with pytest.raises(Exception, match="item 1 needs"):
        strict.collect()


def test_examples_round_trip(spark, tmp_path):
    rows = [("train", [("user", "grüß"), ("assistant", "ok")]), ("val", [("user", "b")])]
    df = spark.createDataFrame(rows, "split string, messages array<struct<role:string,content:string>>")
    files.write_examples(df, str(tmp_path / "out"))
    back = files.read_examples(spark, str(tmp_path / "out" / "split=train")).collect()
    assert [[(m.role, m.content) for m in r.messages] for r in back] == [[("user", "grüß"), ("assistant", "ok")]]
    text = "".join(f.read_text() for f in (tmp_path / "out" / "split=train").glob("*.json"))
    assert "grüß" in text


def test_tokenized_lines_written_in_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("first ann@x.org\nsecond\nthird ann@x.org\n")
    made = files.tokenize_lines(spark, str(tmp_path / "in"))
    files.write_tokenized_lines(made, str(tmp_path / "out"))
    folder = tmp_path / "out" / "output_name=a_tokenized.txt"
    text = "".join(f.read_text() for f in sorted(folder.glob("*/part-*")))
    assert text == "first [EMAIL_d249273c]\nsecond\nthird [EMAIL_d249273c]\n"


def test_plain_map_is_gated(spark, tmp_path):
    df = spark.createDataFrame([("[A_00000000]", "x")], "token string, value string")
    with pytest.raises(PermissionError):
        files.export_plain_map(df, str(tmp_path / "m"))
    files.export_plain_map(df, str(tmp_path / "m"), i_know_this_is_plaintext=True)
    assert spark.read.json(str(tmp_path / "m")).count() == 1


def test_metadata_tables_round_trip(spark, tmp_path):
    for name, schema in schemas.TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
        assert spark.read.parquet(str(tmp_path / name)).columns == [f.split()[0] for f in schema.split(", ")]


def test_datasets_upgrade(spark):
    old = spark.createDataFrame([("d1", "a")], "dataset_id string, name string")
    row = schemas.upgrade_datasets(old).first()
    assert row.model_name is None and row.rdb_imported is False


def test_only_published_runs_are_read(spark, tmp_path):
    root = str(tmp_path)
    vault = spark.createDataFrame([("t",)], "token string")
    files.publish("r1", vault, vault, root)
    vault.write.parquet(f"{root}/output/run_id=r2")
    assert [r.run_id for r in files.read_published(spark, root).collect()] == ["r1"]


def test_paths_are_decoded_and_name_the_file(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "my 1+1 file.txt").write_bytes(b"one\r\ntwo\n")
    rows = files.read_lines(spark, str(tmp_path) + "/*").collect()
    assert sorted((r.file_path[-18:], r.file_name, r.unit_no, r.text) for r in rows) == [
        (f"/{f}/my 1+1 file.txt", "my 1+1 file.txt", n, t) for f in ("a", "b") for n, t in ((0, "one\r"), (1, "two"))]


def test_damaged_json_is_rejected_and_stops_nothing(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(["ann@x.org"]))
    (tmp_path / "bad.json").write_text("{[")
    assert [r.file_name for r in files.tokenize_json(spark, str(tmp_path)).collect()] == ["good.json"]
    assert [(r.file_name, r.text) for r in files.rejected_json(spark, str(tmp_path)).collect()] == [("bad.json", "{[")]
    assert tuple(files.json_file_counts(spark, str(tmp_path)).first()) == (1, 1)
