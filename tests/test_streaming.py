"""Streams over file sources, compared with the batch form or hand-written rows."""

import json
import time

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import crypto
from cloakframe.sources import schemas
from cloakframe.streaming import chat as ST


def write_batches(folder, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))
        import os
        os.utime(folder / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def chunk(session, seq, content, done=False):
    return {"session_id": session, "seq": seq, "content": content, "done": done, "ts": "2024-01-01T00:00:00Z"}


def run(stream, tmp_path, mode="append"):
    out = {}

    def keep(batch, batch_id):
        out.setdefault("rows", []).extend(batch.collect())

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return out.get("rows", [])


@pytest.mark.parametrize("chunks,expected", [
    (["a<think>x", "y</think>b", "c"], "abc"), (["a<thi", "nk>x</think>b"], "ab"), (["a<think>x"], "a"),
    (["a<b", " c<think></thi", "nk>d"], "a<b cd"), (["x <", "y"], "x <y"), (["<think>a</think><think>b</think>z<t"], "z<t"),
])
def test_strip_thinking(chunks, expected):
    inside, tail, shown = False, "", ""
    for c in chunks:
        part, inside, tail = ST.strip_thinking(tail + c, inside)
        shown += part
    assert shown + ("" if inside else tail) == expected


def test_clean_resolve_and_audit(spark, tmp_path):
    path = write_batches(tmp_path / "in", [
        [chunk("s", 0, "Hi <thi"), chunk("t", 0, "plain")],
        [chunk("s", 1, "nk>no [EMAIL_00000000]</think>[EMAIL_d24")],
        [chunk("s", 2, "9273c]!"), chunk("s", 3, "", True), chunk("t", 1, " [x", True)],
    ])
    cleaned = ST.clean_chunks(ST.read_stream(spark, path, schemas.CHAT_CHUNKS))
    key = F.lit("own-test-key-016").cast("binary")
    vault = spark.createDataFrame([("session", "s", "[EMAIL_d249273c]", "ann@x.org")], "scope_type string, scope_id string, token string, v string").withColumn(
        "ciphertext", crypto.encrypt(F.col("v"), key)).drop("v")
    sessions = spark.createDataFrame([("s", "u", "d", ["EMAIL"]), ("t", "u", "d", [])], "session_id string, user_id string, dataset_id string, allowed array<string>")
    q = cleaned.writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(
        ST.resolve_chunks(str(tmp_path / "out"), vault, sessions, key)).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out" / "chunks")).orderBy("session_id", "seq").collect()
    assert "".join(r.content for r in rows if r.session_id == "s") == "Hi ann@x.org!"
    assert "".join(r.content for r in rows if r.session_id == "t") == "plain [x"
    audit = spark.read.parquet(str(tmp_path / "out" / "audit")).collect()
    assert [(r.session_id, r.entity_type, r.token) for r in audit] == [("s", "EMAIL", "[EMAIL_d249273c]")]


def test_requests_are_tokenized_before_they_are_stored(spark, tmp_path):
    rows = [{"message_id": "m1", "session_id": "s", "message": " mail ann@x.org [IP_00958fd0] ", "ts": "2024-01-01T00:00:00Z"},
            {"message_id": "m2", "session_id": "s", "message": "plain", "ts": "2024-01-01T00:01:00Z"}]
    path = write_batches(tmp_path / "in", [[rows[0]], [rows[1]]])
    key = F.lit("own-test-key-016").cast("binary")
    stream = ST.read_stream(spark, path, schemas.CHAT_REQUESTS)
    writer = ST.store_messages(str(tmp_path / "out"), key)
    for _ in range(2):  # the second run finds nothing new
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(writer).trigger(availableNow=True).start()
        q.awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out" / "messages")).orderBy("message_id").collect()
    assert [r.content for r in stored] == ["mail [EMAIL_d249273c] IP_00958fd0", "plain"]
    vault = spark.read.parquet(str(tmp_path / "out" / "vault")).select("token", crypto.decrypt(F.col("ciphertext"), key).alias("v")).collect()
    assert [(r.token, r.v) for r in vault] == [("[EMAIL_d249273c]", "ann@x.org")]


def test_assembly_equals_batch_form(spark, tmp_path):
    batches = [[chunk("a", 0, "x"), chunk("b", 0, "1")], [chunk("a", 1, "y", True), chunk("a", 2, "z")],
               [chunk("b", 1, "2", True), chunk("a", 3, "w", True), chunk("c", 0, "open")]]
    path = write_batches(tmp_path / "in", batches)
    got = run(ST.assemble_messages(ST.read_stream(spark, path, schemas.CHAT_CHUNKS)), tmp_path)
    batch = ST.assembled(spark.read.schema(schemas.CHAT_CHUNKS).json(path)).collect()
    expected = {("a", 1, "xy"), ("a", 3, "zw"), ("b", 1, "12")}
    assert {tuple(r) for r in got} == expected == {tuple(r) for r in batch}


def test_live_token_counts_expire_with_the_session(spark, tmp_path):
    path = write_batches(tmp_path / "in", [[{"session_id": "s", "token": "a"}, {"session_id": "s", "token": "b"}], [{"session_id": "s", "token": "a"}]])
    stream = ST.read_stream(spark, path, "session_id string, token string")
    seen = []
    # processing-time state keeps an availableNow run going for ever, so stop it by hand
    q = ST.live_token_counts(stream, ttl_days=15 / 86_400).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(
        lambda batch, _: seen.extend(batch.collect())).trigger(processingTime="1 second").start()
    for _ in range(90):
        if any(r.token_count == 0 for r in seen) or not q.isActive:
            break
        time.sleep(1)
    q.stop()
    # the second write refreshed the whole session, and all of it goes at once
    assert [r.token_count for r in seen] == [2, 2, 0]


def test_value_stored_twice_is_resolved(spark, tmp_path):
    rows = [{"message_id": f"m{i}", "session_id": "s", "message": "mail ann@x.org", "ts": f"2024-01-01T00:0{i}:00Z"} for i in range(2)]
    key = F.lit("own-test-key-016").cast("binary")
    writer = ST.store_messages(str(tmp_path / "out"), key)
    path = write_batches(tmp_path / "in", [[rows[0]], [rows[1]]])
    q = ST.read_stream(spark, path, schemas.CHAT_REQUESTS).writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(writer).trigger(availableNow=True).start()
    q.awaitTermination()
    vault = spark.read.parquet(str(tmp_path / "out" / "vault"))
    assert vault.count() == 2
    sessions = spark.createDataFrame([("s", "u", "d", ["*"])], "session_id string, user_id string, dataset_id string, allowed array<string>")
    chunks = spark.createDataFrame([("s", 0, "to [EMAIL_d249273c]", True)], "session_id string, seq bigint, content string, done boolean")
    ST.resolve_chunks(str(tmp_path / "done"), vault, sessions, key)(chunks, 0)
    assert [r.content for r in spark.read.parquet(str(tmp_path / "done" / "chunks")).collect()] == ["to ann@x.org"]
    assert spark.read.parquet(str(tmp_path / "done" / "audit")).filter("created_at is not null").count() == 1


def test_rate_windows_and_duplicates(spark, tmp_path):
    rows = [{"id": f"m{i % 4}", "k": "u", "ts": f"2024-01-01T00:00:{i:02d}Z"} for i in range(8)]
    path = write_batches(tmp_path / "in", [rows[:4], rows[4:], [{"id": "late", "k": "u", "ts": "2024-01-01T01:00:00Z"}]])
    stream = ST.read_stream(spark, path, "id string, k string, ts timestamp")
    assert sorted(r.id for r in run(ST.once_per_message(stream, "id"), tmp_path)) == ["late", "m0", "m1", "m2", "m3"]
    (tmp_path / "second").mkdir()
    counted = run(ST.over_rate(stream, "k", "ts", 5), tmp_path / "second")
    assert [(r.n, r.over_limit) for r in counted] == [(8, True)]


def test_rows_of_a_batch_come_in_order_from_many_parts():
    import random

    import pandas as pd

    rng = random.Random(2)
    order = list(range(5000))
    rng.shuffle(order)
    frames = [pd.DataFrame({"seq": order[a : a + 700], "content": [str(i) if i % 9 else None for i in order[a : a + 700]], "done": False}) for a in range(0, 5000, 700)]
    got = list(ST.in_order(iter(frames), size=64))
    assert [g[0] for g in got] == list(range(5000)) and [g[1] for g in got[:10]] == ["", *map(str, range(1, 9)), ""]


def test_a_million_chunks_of_one_session_in_a_batch(spark, tmp_path):
    n = 1_000_000
    rows = spark.range(n).select(
        F.lit("s").alias("session_id"), F.col("id").alias("seq"), F.when(F.col("id") % 1000 == 999, "!").otherwise("x").alias("content"),
        (F.col("id") % 250_000 == 249_999).alias("done"), F.lit("2024-01-01T00:00:00Z").alias("ts"))
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    got = run(ST.assemble_messages(ST.clean_chunks(ST.read_stream(spark, str(tmp_path / "in"), schemas.CHAT_CHUNKS))), tmp_path)
    assert [(r.seq, len(r.content), r.content.count("!")) for r in sorted(got, key=lambda r: r.seq)] == [(250_000 * k - 1, 250_000, 250) for k in range(1, 5)]


def test_late_and_repeated_chunks_are_dropped(spark, tmp_path):
    path = write_batches(tmp_path / "in", [
        [chunk("s", 2, "c"), chunk("s", 0, "a")], [chunk("s", 1, "late"), chunk("s", 2, "again"), chunk("s", 3, "d", True)], [chunk("s", 3, "d", True)]])
    got = run(ST.assemble_messages(ST.clean_chunks(ST.read_stream(spark, path, schemas.CHAT_CHUNKS))), tmp_path)
    assert [tuple(r) for r in got] == [("s", 3, "acd")]


def test_answers_left_open_end_by_event_time(spark, tmp_path):
    def at(row, ts):
        return row | {"ts": ts}

    path = write_batches(tmp_path / "in", [
        [at(chunk("s", 0, "half "), "2024-01-01T00:00:00Z")], [at(chunk("s", 1, "an answer"), "2024-01-01T00:01:00Z"), at(chunk("t", 0, "done", True), "2024-01-01T00:01:00Z")],
        [at(chunk("u", 0, "x"), "2024-01-01T05:00:00Z")], [at(chunk("u", 1, "y", True), "2024-01-01T05:00:30Z")]])
    stream = ST.read_stream(spark, path, schemas.CHAT_CHUNKS).withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(ST.assemble_messages(stream, "ts", "1 minute", 60_000), tmp_path)
    assert sorted(tuple(r) for r in got) == [("s", 1, "half an answer"), ("t", 0, "done"), ("u", 1, "xy")]
