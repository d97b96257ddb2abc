"""The stored vault: bucket numbers, batches, expiry, and chat streams that merge into it."""

import datetime

import pytest
from pyspark.sql import functions as F
from test_streaming import chunk, write_batches

from cloakframe.functions import crypto
from cloakframe.operators import vault as V
from cloakframe.sources import schemas
from cloakframe.streaming import chat as ST

KEY = "own-test-key-016"
ROW = "scope_type string, scope_id string, token string, ciphertext binary, key_id string, filename string, written_at timestamp"


def writes(spark, rows):
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    return spark.createDataFrame([("session", s, t, b"c", "k", f"{s}.txt", day(d)) for s, t, d in rows], ROW)


def stored(spark, path):
    return sorted((r["scope_id"], r["token"]) for r in V.read_stored(spark, path).collect())


def test_bucket_number_is_stored_and_checked(spark, tmp_path):
    path = str(tmp_path / "v")
    assert V.buckets_of(spark, path) is None and V.read_stored(spark, path) is None
    assert V.stored_map(spark, path, "s1").collect() == []
    V.store(spark, writes(spark, [(f"s{i}", "[A_1]", 0) for i in range(20)]), path, 8)
    assert V.buckets_of(spark, path) == 8
    for i in range(20):  # no number is given: the stored one counts
        assert [r["token"] for r in V.stored_map(spark, path, f"s{i}").collect()] == ["[A_1]"]
    for wrong in (lambda: V.stored_map(spark, path, "s1", buckets=256), lambda: V.store(spark, writes(spark, []), path, 4)):
        with pytest.raises(ValueError):
            wrong()
    V.store(spark, writes(spark, [("s1", "[B_1]", 1)]), path)
    assert sorted(r["token"] for r in V.stored_map(spark, path, "s1").collect()) == ["[A_1]", "[B_1]"]


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    path = str(tmp_path / "v")
    V.store(spark, writes(spark, [(f"s{i}", "[A_1]", 0) for i in range(30)]), path, 8)
    files = V.stored_map(spark, path, "s3").select(F.input_file_name()).distinct().collect()
    assert len({f[0].split("bucket=")[1][0] for f in files}) == 1
    plan = V.stored_map(spark, path, "s3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    rows = V.stored_for(spark, path, spark.createDataFrame([("session", "s3")], "scope_type string, scope_id string"))
    assert {r["scope_id"] for r in rows.collect()} >= {"s3"} and rows.count() < 30


def test_sweep_removes_dead_scopes_and_touches_no_other_bucket(spark, tmp_path):
    path = str(tmp_path / "v")
    V.store(spark, writes(spark, [(f"old{i}", "[A_1]", 0) for i in range(3)] + [(f"new{i}", "[A_1]", 9) for i in range(12)]), path, 16)
    V.store(spark, writes(spark, [("old0", "[B_1]", 9)]), path)  # a write refreshes the whole scope
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "v" / "tokens").rglob("*.parquet")}
    as_of = F.lit("2024-01-09 12:00:00").cast("timestamp")
    swept = V.sweep(spark, path, as_of, ttl_days=7)
    assert {s for s, _ in stored(spark, path)} == {"old0", *(f"new{i}" for i in range(12))}
    assert ("old0", "[A_1]") in stored(spark, path)
    assert {r["scope_id"] for r in V.stored_scopes(spark, path).collect()} == {s for s, _ in stored(spark, path)}
    assert {r["filename"] for r in V.stored_files(spark, path).collect()} == {f"{s}.txt" for s, _ in stored(spark, path)}
    assert swept and all(int(f.parent.name.split("=")[1]) in swept or f.exists() for f in before)
    assert V.sweep(spark, path, as_of, ttl_days=7) == []
    assert V.sweep(spark, path, F.lit("2030-01-01").cast("timestamp")) and stored(spark, path) == []  # emptied buckets as well
    V.store(spark, writes(spark, [("again", "[A_1]", 0)]), path)
    assert stored(spark, path) == [("again", "[A_1]")]


def test_sweep_keeps_what_an_interrupted_store_wrote(spark, tmp_path):
    path = str(tmp_path / "v")
    V.store(spark, writes(spark, [("s", "[A_1]", 0)]), path, 4)
    old = spark.read.schema(V.SCOPES).parquet(f"{path}/scopes").collect()
    V.store(spark, writes(spark, [("s", "[B_1]", 20)]), path)
    spark.createDataFrame(old, V.SCOPES).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/scopes")  # as if it ended before
    V.sweep(spark, path, F.lit("2024-01-22").cast("timestamp"), ttl_days=7)
    assert stored(spark, path) == [("s", "[A_1]"), ("s", "[B_1]")]


def test_a_batch_is_merged_once_and_a_broken_one_again(spark, tmp_path):
    path = str(tmp_path / "v")
    assert V.store(spark, writes(spark, [("s", "[A_1]", 0)]), path, 4, ("chat", 0))
    assert not V.store(spark, writes(spark, [("s", "[C_1]", 5)]), path, batch=("chat", 0))
    assert V.store(spark, writes(spark, [("s", "[A_1]", 0)]), path, batch=("other", 0))
    assert V.store(spark, writes(spark, []), path, batch=("chat", 1))
    assert stored(spark, path) == [("s", "[A_1]")]
    assert sorted(map(tuple, V.merged_batches(spark, path).collect())) == [("chat", 0), ("chat", 1), ("other", 0)]


def test_stream_restart_and_chunks_share_one_vault(spark, tmp_path):
    key = F.lit(KEY).cast("binary")
    rows = [{"message_id": f"m{i}", "session_id": f"s{i % 2}", "message": f"mail ann{i // 2}@x.org", "ts": f"2024-01-01T00:0{i}:00Z"} for i in range(6)]
    path = write_batches(tmp_path / "in", [[rows[0], rows[1]], [rows[2]]])

    def once():
        stream = ST.read_stream(spark, path, schemas.CHAT_REQUESTS)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(
            ST.merge_messages(str(tmp_path / "out"), key, buckets=4)).trigger(availableNow=True).start().awaitTermination()

    once()
    more = write_batches(tmp_path / "more", [[rows[3], rows[0]], [rows[4], rows[5]]])
    for i, name in enumerate(("000", "001")):
        (tmp_path / "more" / f"{name}.json").rename(tmp_path / "in" / f"1{name}.json")
    once()  # a new run goes on behind the last batch
    assert more
    vault = str(tmp_path / "out" / "vault")
    assert V.merged_batches(spark, vault).count() == 4
    merged = V.read_stored(spark, vault).select("scope_id", crypto.decrypt(F.col("ciphertext"), key).alias("v")).collect()
    assert sorted(map(tuple, merged)) == sorted({(r["session_id"], r["message"].split()[1]) for r in rows})
    assert spark.read.parquet(str(tmp_path / "out" / "messages")).filter("content like '%ann%'").count() == 0
    token = V.stored_map(spark, vault, "s0").select("token", crypto.decrypt(F.col("ciphertext"), key).alias("v")).filter("v = 'ann0@x.org'").first()["token"]
    sessions = spark.createDataFrame([("s0", "u", "d", ["*"]), ("s1", "u", "d", [])], "session_id string, user_id string, dataset_id string, allowed array<string>")
    told = write_batches(tmp_path / "chunks", [[chunk("s0", 0, f"to {token[:9]}"), chunk("s1", 0, f"to {token}", True)], [chunk("s0", 1, token[9:], True)]])
    cleaned = ST.clean_chunks(ST.read_stream(spark, told, schemas.CHAT_CHUNKS))
    cleaned.writeStream.option("checkpointLocation", str(tmp_path / "ck2")).foreachBatch(
        ST.resolve_chunks(str(tmp_path / "done"), vault, sessions, key)).trigger(availableNow=True).start().awaitTermination()
    shown = {}
    for r in spark.read.parquet(str(tmp_path / "done" / "chunks")).orderBy("seq").collect():
        shown[r["session_id"]] = shown.get(r["session_id"], "") + r["content"]
    assert shown == {"s0": "to ann0@x.org", "s1": f"to {token}"}
