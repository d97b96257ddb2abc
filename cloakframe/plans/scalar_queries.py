"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crypto
from ..functions import text as X
from . import sqltext as Q
from .registry import documents, query, rel, table

RAW = "'[' || role || '] ' || text || chr(7) || '  '"

query(
    "sanitize_input",
    f"SELECT conv_id, turn, regexp_replace(regexp_replace({RAW}, "
    r"'[\[\]\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM conversations",
)(lambda s, d: table(s, d, "conversations").select(
    "conv_id", "turn", X.sanitize(F.concat(F.lit("["), "role", F.lit("] "), "text", F.lit("\x07  "))).alias("clean")))

PATHS = "'in/' || lang || '.d/doc' || doc_id || '_tokenized.' || source"

query("file_names", f"""
WITH p AS (SELECT doc_id, {PATHS} AS path, {PATHS.replace(" || '.' || source", "")} AS other FROM documents)
SELECT doc_id, 'in/' || split_part(path, '/', 2) || '/' || split_part(split_part(path, '/', 3), '.', 1) AS stem,
  '.' || split_part(split_part(path, '/', 3), '.', 2) AS ext, split_part(path, '/', 3) AS base,
  replace(path, '_tokenized.', '_tokenized_tokenized.') AS tokenized,
  replace(path, '_tokenized.', '_decrypted.') AS decrypted FROM p""")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.expr(PATHS).alias("path")).select(
        "doc_id", X.stem(F.col("path")).alias("stem"), X.extension(F.col("path")).alias("ext"),
        X.base_name(F.col("path")).alias("base"), X.tokenized_name(F.col("path")).alias("tokenized"),
        X.decrypted_name(F.col("path")).alias("decrypted")))

NAMED = (
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'personal_banking_' WHEN 'MACHINERY' THEN 'intl_business_' "
    "WHEN 'HOUSEHOLD' THEN 'gov_contractor_' WHEN 'FURNITURE' THEN 'tech_startup_' ELSE 'other_' END || c_custkey || '.txt'"
)
query("record_type_of_file", f"""
SELECT c_custkey, CASE WHEN f LIKE 'personal_banking%' THEN 'Personal Banking Customer'
  WHEN f LIKE 'intl_business%' THEN 'International Business Client' WHEN f LIKE 'gov_contractor%' THEN 'Government Contractor'
  WHEN f LIKE 'healthcare_professional%' THEN 'Healthcare Professional' WHEN f LIKE 'tech_startup%' THEN 'Tech Startup Employee'
  ELSE 'customer' END AS title FROM (SELECT c_custkey, {NAMED} AS f FROM customer)""")(
    lambda s, d: table(s, d, "customer").select("c_custkey", X.record_title(F.expr(NAMED)).alias("title")))

HEAD = "'Annual ' || CASE WHEN p_size < 10 THEN 'Health' || 'care' WHEN p_size < 20 THEN 'tech banking' WHEN p_size < 30 THEN 'Government' ELSE p_name END || chr(10) || 'business' || p_type"
query("record_type_of_text", f"""
SELECT p_partkey, CASE WHEN h LIKE '%HEALTHCARE%' THEN 'healthcare' WHEN h LIKE '%BANKING%' THEN 'banking'
  WHEN h LIKE '%BUSINESS%' THEN 'business' WHEN h LIKE '%GOVERNMENT%' THEN 'government' WHEN h LIKE '%TECH%' THEN 'tech'
  ELSE 'unknown' END AS kind FROM (SELECT p_partkey, upper(split_part({HEAD}, chr(10), 1)) AS h FROM part)""")(
    lambda s, d: table(s, d, "part").select("p_partkey", X.record_keyword(F.expr(HEAD)).alias("kind")))

query("first_lines", """
SELECT doc_id, array_to_string((CASE WHEN l[-1] = '' THEN l[1:len(l)-1] ELSE l END)[1:8], chr(10)) AS head
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")(
    lambda s, d: table(s, d, "documents").select("doc_id", X.first_lines(F.col("text")).alias("head")))

query("session_title", """
SELECT conv_id, turn, coalesce(nullif(left(CASE WHEN role = 'system' THEN '' ELSE text END, 60), ''), 'New chat') AS title
FROM conversations""")(
    lambda s, d: table(s, d, "conversations").select(
        "conv_id", "turn",
        X.session_title(F.when(F.col("role") == "system", "").otherwise(F.col("text"))).alias("title")))

query("model_slug", """
SELECT p_partkey, 'model-' || left(replace(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ', '-'), 30) AS slug FROM part""")(
    lambda s, d: table(s, d, "part").select(
        "p_partkey", X.model_slug(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("slug")))

query("blank_guards", r"""
SELECT doc_id, length(regexp_replace(u, '^\s+|\s+$', '', 'g')) > 0 AS filled
FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN text WHEN lang = 'de' THEN chr(10) || '  ' WHEN lang = 'fr' THEN '' ELSE source END AS u FROM documents)""")(
    lambda s, d: table(s, d, "documents").select(
        "doc_id", X.is_filled(F.expr(
            "CASE WHEN lang = 'en' THEN text WHEN lang = 'de' THEN chr(10) || '  ' WHEN lang = 'fr' THEN '' ELSE source END"
        )).alias("filled")))

KEY_TEXT = "CASE WHEN c_nationkey < 6 THEN substr(md5(c_name), 1, 16) WHEN c_nationkey < 12 THEN md5(c_name) WHEN c_nationkey < 18 THEN substr(md5(c_name), 1, 24) ELSE c_name END"
query("key_length", f"SELECT c_custkey, octet_length(encode({KEY_TEXT})) IN (16, 24, 32) AS ok FROM customer")(
    lambda s, d: table(s, d, "customer").select(
        "c_custkey", X.key_is_valid(F.expr(KEY_TEXT).cast("binary")).alias("ok")))

HEX_TEXT = "CASE WHEN c_nationkey < 8 THEN md5(c_name) WHEN c_nationkey < 16 THEN substr(md5(c_name), 1, 31) ELSE 'x' || substr(md5(c_name), 1, 31) END"
query("key_from_hex", f"""
SELECT c_custkey, CASE WHEN length(h) % 2 = 0 AND regexp_full_match(h, '[0-9a-fA-F]*') THEN lower(h) END AS decoded
FROM (SELECT c_custkey, {HEX_TEXT} AS h FROM customer)""")(
    lambda s, d: table(s, d, "customer").select(
        "c_custkey", F.lower(F.hex(X.key_from_hex(F.expr(HEX_TEXT)))).alias("decoded")))

query("key_fingerprint", "SELECT c_custkey, substr(sha256(c_name), 1, 12) AS key_ref FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", X.key_fingerprint(F.col("c_name").cast("binary")).alias("key_ref")))

MARKED = "text || '[EMAIL_' || substr(md5(text), 1, 8) || ']' || role || '[IP_' || substr(md5(role), 1, 8) || '][BAD_xyz]'"
query("token_segments", f"""
WITH t AS (SELECT conv_id, turn, {MARKED} AS x FROM conversations),
g AS (SELECT conv_id, turn, regexp_extract_all(x, '\\[[A-Z_]{{1,30}}_[0-9a-f]{{8}}\\]') AS m,
  string_split(regexp_replace(x, '\\[[A-Z_]{{1,30}}_[0-9a-f]{{8}}\\]', chr(1), 'g'), chr(1)) AS g FROM t),
n AS (SELECT conv_id, turn, unnest(list_filter(flatten(list_transform(range(1, len(g) + 1), lambda i:
  CASE WHEN i <= len(m) THEN [g[i], m[i]] ELSE [g[i]] END)), lambda v: v <> '')) AS content,
  generate_subscripts(list_filter(flatten(list_transform(range(1, len(g) + 1), lambda i:
  CASE WHEN i <= len(m) THEN [g[i], m[i]] ELSE [g[i]] END)), lambda v: v <> ''), 1) - 1 AS node FROM g)
SELECT conv_id, turn, node, content,
  nullif(regexp_extract(content, '^\\[([A-Z_]{{1,30}})_([0-9a-f]{{8}})\\]$', 1), '') AS label,
  nullif(regexp_extract(content, '^\\[([A-Z_]{{1,30}})_([0-9a-f]{{8}})\\]$', 2), '') AS hex FROM n""")(
    lambda s, d: table(s, d, "conversations").select(
        "conv_id", "turn", F.posexplode(X.segments(F.expr(MARKED))).alias("node", "n")
    ).select("conv_id", "turn", "node", "n.content", "n.label", "n.hex"))

query("value_encryption_round_trip", "SELECT o_orderkey, o_orderpriority AS value FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", "o_orderpriority", F.md5("o_orderpriority").cast("binary").alias("k")).select(
        "o_orderkey", crypto.decrypt(crypto.encrypt(F.col("o_orderpriority"), F.col("k")), F.col("k")).alias("value")))

query("key_wrap_round_trip", """
SELECT c_custkey, substr(md5(c_name), 1, 16) AS unwrapped, 44 AS wrapped_bytes, NULL::VARCHAR AS wrong_master FROM customer""")(
    lambda s, d: table(s, d, "customer").select(
        "c_custkey", F.substring(F.md5("c_name"), 1, 16).cast("binary").alias("k")
    ).select(
        "c_custkey", crypto.unwrap_key(crypto.wrap_key(F.col("k"), F.lit("master")), F.lit("master")).cast("string").alias("unwrapped"),
        F.octet_length(crypto.wrap_key(F.col("k"), F.lit("master"))).alias("wrapped_bytes"),
        crypto.unwrap_key(crypto.wrap_key(F.col("k"), F.lit("master")), F.lit("other")).cast("string").alias("wrong_master")))
