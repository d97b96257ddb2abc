"""Lists cut over many splits against the JSON library."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cloakframe.sources import files, jsonlists


def value(rng, deep):
    kind = rng.randrange(8 if deep else 5)
    if kind < 3:
        return "".join(rng.choice(['a', 'é', '"', "\\", ",", "[", "]", "{", "}", "\n", " ", "\\\"", '",', ":"]) for _ in range(rng.randrange(12)))
    if kind == 3:
        return rng.choice([0, -1, 2.5, True, None, 10**12])
    if kind == 4:
        return {"text": value(rng, 0), "n": 1} if deep else {}
    if kind == 5:
        return [value(rng, deep - 1) for _ in range(rng.randrange(4))]
    return {f"k{i},": value(rng, deep - 1) for i in range(rng.randrange(4))}


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)


@pytest.fixture
def splits(spark):
    yield lambda size: small_splits(spark, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [37, 400, 1 << 27])
def test_items_equal_the_json_library(spark, tmp_path, splits, size):
    rng, want = random.Random(7), {}
    for n in range(12):
        data = [value(rng, 3) for _ in range(rng.choice([0, 1, 2, 60]))]
        want[f"l {n}.json"] = data
        (tmp_path / f"l {n}.json").write_text(json.dumps(data, ensure_ascii=n % 2 == 0, indent=rng.choice([None, 2])), encoding="utf-8")
    splits(size)
    got = {name: {} for name in want}
    for r in jsonlists.json_items(spark, str(tmp_path)).collect():
        assert r["is_list"] and r["closed"]
        got[r["file_name"]][r["item"]] = json.loads(r["text"])
    assert {name: [items[i] for i in range(len(items))] for name, items in got.items()} == want
    assert jsonlists.rejected_files(spark, str(tmp_path)).count() == 0


def test_one_list_is_read_by_many_tasks(spark, tmp_path, splits):
    data = [{"text": f"item {i}, \"quoted\" [x", "n": [i, i]} for i in range(5000)]
    (tmp_path / "big.json").write_text(json.dumps(data))
    splits(16_000)
    pieces = jsonlists._pieces(spark, str(tmp_path), "*.json")
    held = pieces.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) > 10 and max(r["count"] for r in held) < 5000
    units = files.read_json_units(spark, str(tmp_path)).orderBy("unit_no").collect()
    assert [r["text"] for r in units] == [d["text"] for d in data] and {r["shape"] for r in units} == {"list"}
    found = jsonlists.json_items(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "wholetext" not in found


@pytest.mark.parametrize("size", [5, 1 << 27])
def test_damaged_and_odd_files(spark, tmp_path, splits, size):
    texts = {"ok": '[1, "a,b"]', "none": "[ ]\n", "raw": '{"a": [1, {"b": ","}]}', "one": '{"text": "x, y", "z": 1}', "string": '"just, text"', "number": " 12 ",
             "open": "[1, 2", "comma": "[1,]", "two": "[1],[2]", "after": "[1] x", "quote": '["a, 1]', "mixed": "[{]}", "empty": "", "blank": " \n", "shut": "1]", "bare": "[a, b]"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    splits(size)

    def valid(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    bad = {name for name, text in texts.items() if text and not valid(text)}
    assert {r["file_path"].rsplit("/", 1)[1][:-5] for r in jsonlists.rejected_files(spark, str(tmp_path)).collect()} == bad
    assert {r["file_name"][:-5]: r["text"] for r in files.rejected_json(spark, str(tmp_path)).collect()} == {n: texts[n] for n in bad}
    units = {(r["file_name"][:-5], r["unit_no"]): (r["shape"], r["text"]) for r in files.read_json_units(spark, str(tmp_path)).collect()}
    assert units == {("ok", 0): ("list", None), ("ok", 1): ("list", "a,b"), ("raw", 0): ("raw", '{"a":[1,{"b":","}]}'), ("one", 0): ("object", "x, y"),
                     ("string", 0): ("raw", '"just, text"'), ("number", 0): ("raw", "12")}
    assert tuple(files.json_file_counts(spark, str(tmp_path)).first()) == (len(texts) - 1 - len(bad), len(bad))


def test_json_units_read_their_files_once(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text('["x", {"text": "y"}]')
    (tmp_path / "b.json").write_text('["x", {')
    made, plain = [], jsonlists.json_items
    monkeypatch.setattr(jsonlists, "json_items", lambda *a: made.append(a) or plain(*a))
    units = files.read_json_units(spark, str(tmp_path))
    assert [(r["file_name"], r["text"]) for r in units.orderBy("unit_no").collect()] == [("a.json", "x"), ("a.json", "y")]
    assert len(made) == 1
