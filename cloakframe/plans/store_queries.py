"""Queries that write the given tables with a sink of the library and read them back with its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto
from ..operators import vault as V
from ..operators.skew import spread
from ..session import run_folder
from ..sources import files
from .registry import query, rel, table
from .vault_queries import SESSIONS, UPSERTED, W, _day, _key, _writes

LINES = "SELECT c_nationkey, c_custkey, 'Client of ' || c_mktsegment || ', mail c' || c_custkey || '@example.org' AS value FROM {customer}"
LINE_SQL = LINES.replace("{customer}", "customer")


CUSTOMERS_OF_A_FILE = 1000  # a nation has as many files as its customers need
_FILE = f"c_nationkey, c_custkey // {CUSTOMERS_OF_A_FILE}"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the folders n (nation) and b (block of customers) of their file."""
    block = F.lpad(F.floor(F.col("c_custkey") / CUSTOMERS_OF_A_FILE).cast("string"), 9, "0")
    return rel(spark, folder, LINES).withColumnRenamed("c_nationkey", "n").withColumn("b", block)


def _nation(pattern: str = r"n=(\d+)/"):
    return F.regexp_extract("file_path", pattern, 1).cast("int").alias("nation")



def _line_folder(spark: SparkSession, folder: str) -> str:
    """Customers as lines, files of a thousand keys in one folder per nation."""
    path = run_folder(spark)
    ordered = _files(spark, folder).repartition("n", "b").sortWithinPartitions("n", "b", "c_custkey")
    ordered.drop("c_custkey").write.partitionBy("n", "b").text(path)
    return path


query("line_source", f"SELECT CAST(c_nationkey AS INTEGER) AS nation, row_number() OVER (PARTITION BY {_FILE} ORDER BY c_custkey) - 1 AS unit_no, value AS text FROM ({LINE_SQL})")(
    lambda s, d: files.read_lines(s, _line_folder(s, d)).select(_nation(), "unit_no", "text"))


def _nation_folder(spark: SparkSession, folder: str) -> str:
    """Customers as lines, one file for all customers of a nation."""
    path = run_folder(spark)
    rows = rel(spark, folder, LINES).withColumnRenamed("c_nationkey", "n")
    rows.repartition("n").sortWithinPartitions("n", "c_custkey").drop("c_custkey").write.partitionBy("n").text(path)
    return path


query("whole_document_source", f"SELECT CAST(c_nationkey AS INTEGER) AS nation, string_agg(value || chr(10), '' ORDER BY c_custkey) AS text FROM ({LINE_SQL}) GROUP BY 1")(
    lambda s, d: files.read_documents(s, _nation_folder(s, d) + "/*").select(_nation(), "text"))


def _tokenized_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines tokenized, written in order, and read again."""
    out = run_folder(spark)
    made = files.tokenize_lines(spark, _line_folder(spark, folder))
    files.write_tokenized_lines(made.withColumn("file_name", F.concat(F.lit("n"), _nation().cast("string"), F.lit(".txt"))), out)
    return files.read_lines(spark, out + "/*/*").select(_nation(r"output_name=n(\d+)_tokenized"), "unit_no", "text")


query("tokenized_line_sink", f"""SELECT CAST(c_nationkey AS INTEGER) AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS unit_no,
replace(value, 'c' || c_custkey || '@example.org', '[EMAIL_' || substr(md5('c' || c_custkey || '@example.org'), 1, 8) || ']') AS text FROM ({LINE_SQL})""")(_tokenized_lines)


def _json_folder(spark: SparkSession, folder: str) -> str:
    """JSON lists of at most a thousand customers, the files of nation 3 damaged."""
    path = run_folder(spark)
    item = F.struct(F.col("value").alias("text"), F.col("c_custkey").alias("n"))
    lists = _files(spark, folder).groupBy("n", "b").agg(
        F.sort_array(F.collect_list(F.struct(F.col("c_custkey").alias("k"), item.alias("item")))).alias("l"))
    body = F.to_json(F.transform("l", lambda x: x["item"]))
    made = lists.select("n", "b", F.when(F.col("n") == 3, F.concat(F.lit("{"), body)).otherwise(body).alias("value"))
    spread(made).write.partitionBy("n", "b").text(path)  # many small files: all cores write, however few bytes they are
    return path


query("json_source", f"""SELECT CAST(c_nationkey AS INTEGER) AS nation, row_number() OVER (PARTITION BY {_FILE} ORDER BY c_custkey) - 1 AS unit_no, 'list' AS shape, value AS text
FROM ({LINE_SQL}) WHERE c_nationkey <> 3""")(
    lambda s, d: files.read_json_units(s, _json_folder(s, d) + "/*/*", "*.txt").select(_nation(), "unit_no", "shape", "text"))
query("json_rejects", f"SELECT CAST(c_nationkey AS INTEGER) AS nation FROM customer WHERE c_nationkey = 3 GROUP BY {_FILE}")(
    lambda s, d: files.rejected_json(s, _json_folder(s, d) + "/*/*", "*.txt").select(_nation()))
query("json_file_counts", f"SELECT count(*) FILTER (WHERE c_nationkey <> 3) AS succeeded, count(*) FILTER (WHERE c_nationkey = 3) AS failed FROM (SELECT DISTINCT {_FILE} FROM customer)")(
    lambda s, d: files.json_file_counts(s, _json_folder(s, d) + "/*/*", "*.txt"))


def _examples(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as examples, written as JSON lines per split and read again."""
    out = run_folder(spark)
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("source").alias("content")),
                       F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")))
    files.write_examples(table(spark, folder, "documents").select(F.expr("if(doc_id % 10 = 0, 'val', 'train')").alias("split"), messages.alias("messages")), out)
    parts = [files.read_examples(spark, f"{out}/split={name}").select(F.lit(name).alias("split"), F.inline("messages")) for name in ("train", "val")]
    return parts[0].unionByName(parts[1])


query("example_sink", """WITH x AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, source, text FROM documents)
SELECT split, 'user' AS role, source AS content FROM x UNION ALL SELECT split, 'assistant', text FROM x""")(_examples)


def _stored_vault(spark: SparkSession, folder: str) -> str:
    """Two rounds of writes merged into a stored vault."""
    path = run_folder(spark)
    rows = _writes(spark, folder)
    V.store(spark, rows.filter("status <> 'O'").drop("status"), path, 8)
    V.store(spark, rows.filter("status = 'O'").drop("status"), path, 8)
    return path


query("stored_vault", f"WITH {UPSERTED} SELECT scope_id, token, value, key_id, strftime(written_at, '%Y-%m-%d') AS written FROM v")(
    lambda s, d: V.read_stored(s, _stored_vault(s, d)).select(
        "scope_id", "token", crypto.decrypt(F.col("ciphertext"), _key()).alias("value"), "key_id", _day("written_at").alias("written")))
query("stored_vault_sessions", f"WITH {SESSIONS} SELECT session_id, filename, key_id, token_count FROM ss")(
    lambda s, d: V.sessions(V.read_stored(s, _stored_vault(s, d))).select("session_id", "filename", "key_id", "token_count"))
query("stored_map_of_session", f"WITH {UPSERTED} SELECT token, value FROM v WHERE scope_id = '7'")(
    lambda s, d: V.stored_map(s, _stored_vault(s, d), 7, buckets=8).select("token", crypto.decrypt(F.col("ciphertext"), _key()).alias("value")))
query("stored_session_of_file", f"WITH {W} SELECT filename, first(scope_id ORDER BY written_at DESC, scope_id DESC) AS session_id FROM w GROUP BY 1")(
    lambda s, d: V.session_of_file(V.stored_files(s, _stored_vault(s, d))))
