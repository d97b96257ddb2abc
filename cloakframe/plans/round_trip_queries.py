"""Queries that send the given tables through a sink, a stream or an index of the library and read what came out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import crypto
from ..operators import detect as D
from ..operators import retrieval as RT
from ..operators import tokenize as T
from ..operators import vault as V
from ..session import STATE_STORE, run_folder
from ..sources import files, schemas
from ..streaming import chat as ST
from . import sqltext as Q
from .detect_queries import _CLEAN, DOC_TOKENS, MESSAGE
from .registry import documents, query, table

DOCS_OF_A_FILE = 200


def _key():
    return F.lit("own-test-key-016").cast("binary")


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the folder ``b`` of their file: blocks of ids, so that no file holds many."""
    return table(spark, folder, "documents").withColumn("b", F.floor(F.col("doc_id") / DOCS_OF_A_FILE))


# --- sources and sinks -------------------------------------------------------------------------------------------


def _annotated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """JSON lists of samples; documents in French lack their entities."""
    path = run_folder(spark)
    end = F.length(F.regexp_extract("text", r"^\S*", 0)).cast("string")
    entities = F.when(F.coalesce("lang", F.lit("")) != "fr", F.array(F.array(F.lit("0"), end, F.lit("PER"))))
    lists = _blocks(spark, folder).filter("text is not null").groupBy("b").agg(F.collect_list(F.struct("text", entities.alias("entities"))).alias("l"))
    lists.select("b", F.to_json("l").alias("value")).write.partitionBy("b").text(path)
    return files.read_annotated(spark, path + "/*")


query("annotated_source", """SELECT md5(text) AS text_md5, 0 AS start, CAST(length(regexp_extract(text, '^\\S*', 0)) AS INTEGER) AS "end", 'PER' AS label
FROM documents WHERE text IS NOT NULL AND coalesce(lang, '') <> 'fr'""")(
    lambda s, d: _annotated(s, d)[0].select(F.md5(F.col("text").cast("binary")).alias("text_md5"), F.inline("entities")))
query("annotated_rejects", "SELECT count(*) AS rejected FROM documents WHERE text IS NOT NULL AND lang = 'fr'")(
    lambda s, d: _annotated(s, d)[1].agg(F.count(F.lit(1)).alias("rejected")))


def _raw_folder(spark: SparkSession, folder: str) -> str:
    """JSON objects without a text field: notes of a block of documents."""
    path = run_folder(spark)
    note = F.expr("'doc ' || doc_id || ' by u' || doc_id || '@example.org'")
    rows = _blocks(spark, folder).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("doc_id", note.alias("note")))).alias("l"))
    rows.select("b", F.to_json(F.struct(F.transform("l", lambda x: x["note"]).alias("notes"))).alias("value")).write.partitionBy("b").text(path)
    return path


def _raw_notes(spark: SparkSession, folder: str) -> DataFrame:
    units = files.read_json_units(spark, _raw_folder(spark, folder) + "/*", "*.txt")
    made = files.rebuilt_item(T.tokenize(units, scope=["file_path"], unit="unit_no"))
    return made.select("shape", F.explode(F.from_json("output", "notes array<string>")["notes"]).alias("note"))


query("json_raw_fallback", "SELECT 'raw' AS shape, 'doc ' || doc_id || ' by [EMAIL_' || substr(md5('u' || doc_id || '@example.org'), 1, 8) || ']' AS note FROM documents")(_raw_notes)


def _plain_map(spark: SparkSession, folder: str) -> DataFrame:
    path = run_folder(spark)
    rows = T.token_rows(T.tokenize(documents(spark, folder)), ["id"]).select("token", "value").distinct()
    files.export_plain_map(rows, path, i_know_this_is_plaintext=True)
    return spark.read.schema("token string, value string").json(path)


query("plain_map_export", f"WITH {DOC_TOKENS} SELECT DISTINCT token, value FROM tokens")(_plain_map)


def _published(spark: SparkSession, folder: str) -> DataFrame:
    """A published run beside one that ended before its marker."""
    root = run_folder(spark)
    made = T.tokenize(documents(spark, folder))
    files.publish("done", T.token_rows(made, ["id"]), made.select("id", "tokenized"), root)
    made.select("id", F.col("text").alias("tokenized")).write.parquet(f"{root}/output/run_id=broken")
    return files.read_published(spark, root).select("id", "tokenized")


query("published_output", f"WITH {DOC_TOKENS} SELECT id, tokenized FROM spliced")(_published)


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    path = run_folder(spark)
    table(spark, folder, "conversations").selectExpr(
        "conv_id || ':' || turn as message_id", "cast(conv_id as string) as session_id", "role", "text as content",
        "timestamp_seconds(turn) as created_at").write.parquet(path)
    return spark.read.schema(schemas.MESSAGES).parquet(path)


query("message_table", "SELECT conv_id || ':' || turn AS message_id, CAST(conv_id AS VARCHAR) AS session_id, role, text AS content, CAST(turn AS BIGINT) AS second FROM conversations")(
    lambda s, d: _messages(s, d).select("message_id", "session_id", "role", "content", F.unix_timestamp("created_at").alias("second")))


def _upgraded(spark: SparkSession, folder: str) -> DataFrame:
    """Sources as datasets written before two columns existed."""
    path = run_folder(spark)
    table(spark, folder, "documents").groupBy(F.col("source").alias("dataset_id")).agg(F.min("lang").alias("name")).write.parquet(path)
    return schemas.upgrade_datasets(spark.read.parquet(path))


query("datasets_upgrade", "SELECT source AS dataset_id, min(lang) AS name, CAST(NULL AS VARCHAR) AS model_name, false AS rdb_imported FROM documents GROUP BY 1")(_upgraded)


def _index_rows(spark: SparkSession, folder: str, name: str, id: str) -> DataFrame:
    return table(spark, folder, name).select(F.concat(F.lit(f"{name}_"), F.col(id).cast("string")).alias("chunk_id"))


def _reset_and_appended(spark: SparkSession, folder: str) -> DataFrame:
    """Pages are indexed, the index is reset to documents, and benchmark items are added."""
    path = run_folder(spark)
    RT.write_index(_index_rows(spark, folder, "pages", "page_id"), path, reset=True)
    RT.write_index(_index_rows(spark, folder, "documents", "doc_id"), path, reset=True)
    RT.write_index(_index_rows(spark, folder, "benchmark", "item_id"), path)
    return spark.read.parquet(path)


query("index_reset_and_append", "SELECT 'documents_' || doc_id AS chunk_id FROM documents UNION ALL SELECT 'benchmark_' || item_id FROM benchmark")(_reset_and_appended)
query("threshold_range", "SELECT event_id, value / 100 >= 0 AND value / 100 <= 1 AS valid FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", D.valid_threshold(F.col("value") / 100).alias("valid")))

# --- streams -----------------------------------------------------------------------------------------------------

FILES, FILES_OF_A_BATCH = 8, 4
EMAIL = "role || conv_id || '@example.org'"


def _stream(spark: SparkSession, rows: DataFrame, schema: str) -> DataFrame:
    """Rows as a stream of files in which every session lies in one file; a batch takes some files."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    path = run_folder(spark)
    rows.repartition(FILES, "session_id").write.json(path)
    return ST.read_stream(spark, path, schema, FILES_OF_A_BATCH)


def _run(stream: DataFrame, write) -> None:
    spark = stream.sparkSession
    stream.writeStream.option("checkpointLocation", run_folder(spark)).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def _collected(stream: DataFrame) -> DataFrame:
    """What an append stream gives, written batch by batch."""
    spark, path, schema = stream.sparkSession, run_folder(stream.sparkSession), stream.schema
    _run(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"))
    return spark.read.schema(schema).parquet(path).drop("batch")


def _merged_requests(spark: SparkSession, folder: str) -> str:
    root = run_folder(spark)
    requests = table(spark, folder, "conversations").selectExpr(
        "cast(conv_id * 1000 + turn as string) as message_id", "cast(conv_id as string) as session_id", f"{MESSAGE} as message",
        "date_format(timestamp_seconds(turn), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as ts")
    _run(_stream(spark, requests, schemas.CHAT_REQUESTS), ST.merge_messages(root, _key(), buckets=8))
    return root


MESSAGE_TOKENS = Q.tokenization(C.CATALOGUE, f"SELECT conv_id * 1000 + turn AS id, {_CLEAN} AS text FROM conversations")
query("stream_requests", f"WITH {MESSAGE_TOKENS} SELECT CAST(id AS VARCHAR) AS message_id, tokenized AS content FROM spliced")(
    lambda s, d: s.read.parquet(f"{_merged_requests(s, d)}/messages").select("message_id", "content"))
query("stream_vault", f"WITH {MESSAGE_TOKENS} SELECT DISTINCT CAST(id // 1000 AS VARCHAR) AS scope_id, token, value FROM tokens")(
    lambda s, d: V.read_stored(s, f"{_merged_requests(s, d)}/vault").select(
        "scope_id", "token", crypto.decrypt(F.col("ciphertext"), _key()).alias("value")))


def _chunks(spark: SparkSession, folder: str, content: str) -> DataFrame:
    rows = table(spark, folder, "conversations").selectExpr(
        "cast(conv_id as string) as session_id", "cast(turn as bigint) as seq", f"{content} as content", "role = 'assistant' as done")
    return _stream(spark, rows, schemas.CHAT_CHUNKS)


THOUGHT = "'<think>' || role || '</think>' || text || ' '"
query("stream_cleaned_chunks", "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS BIGINT) AS seq, text || ' ' AS content, role = 'assistant' AS done FROM conversations")(
    lambda s, d: _collected(ST.clean_chunks(_chunks(s, d, THOUGHT))))
query("stream_assembled_messages", """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS BIGINT) AS seq, text || ' ' AS content, role = 'assistant' AS done FROM conversations),
e AS (SELECT *, min(CASE WHEN done THEN seq END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM c)
SELECT session_id, stop AS seq, string_agg(content, '' ORDER BY seq) AS content FROM e WHERE stop IS NOT NULL GROUP BY 1, 2""")(
    lambda s, d: _collected(ST.assemble_messages(ST.clean_chunks(_chunks(s, d, THOUGHT)))))


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that name the address of a request, resolved from the vault that the request stream merged into."""
    root, out = _merged_requests(spark, folder), run_folder(spark)
    sessions = table(spark, folder, "conversations").select(F.col("conv_id").cast("string").alias("session_id")).distinct().select(
        "session_id", F.lit("u").alias("user_id"), F.lit("d").alias("dataset_id"), F.array(F.lit("EMAIL")).alias("allowed"))
    told = _chunks(spark, folder, f"'to [EMAIL_' || substr(md5({EMAIL}), 1, 8) || '] [SSN_00000000]'")
    _run(told, ST.resolve_chunks(out, f"{root}/vault", sessions, _key()))
    return spark.read.parquet(f"{out}/chunks").select("session_id", "seq", "content")


query("stream_resolved_chunks", f"SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS BIGINT) AS seq, 'to ' || {EMAIL} || ' [SSN_00000000]' AS content FROM conversations")(_resolved)
