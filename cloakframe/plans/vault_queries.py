"""Vault, restore, access and metadata queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import crypto
from ..operators import access as A
from ..operators import restore as R
from ..operators import tokenize as T
from ..operators import vault as V
from ..session import run_folder
from . import sqltext as Q
from .registry import query, rel, spread, table

KEY_TEXT = "own-test-key-016"


def _key():
    return F.lit(KEY_TEXT).cast("binary")


# Vault writes made of orders: the customer is the session, the priority the token.
WRITES = (
    "SELECT 'session' AS scope_type, cast(o_custkey AS string) AS scope_id, '[ORDER_' || substr(md5(o_orderpriority), 1, 8) || ']' AS token, "
    "cast(o_orderkey AS string) AS value, 'k' || o_orderstatus AS key_id, 'f' || lpad(cast(o_orderkey AS string), 10, '0') AS filename, "
    "o_orderdate AS written_at, o_orderstatus AS status FROM {orders}"
)
W = f"w AS ({WRITES.replace('{orders}', 'orders')})"
UPSERTED = f"{W}, v AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY scope_id, token ORDER BY written_at DESC, (status = 'O') DESC, key_id DESC, filename DESC) = 1)"


def _writes(s, d):
    rows = rel(s, d, WRITES)
    return rows.withColumn("ciphertext", crypto.encrypt(F.col("value"), _key())).drop("value")


def _vault(s, d):
    rows = _writes(s, d)
    return V.upsert(rows.filter("status <> 'O'").drop("status"), rows.filter("status = 'O'").drop("status"))


def _day(column):
    return F.date_format(column, "yyyy-MM-dd")


query("vault_upsert", f"WITH {UPSERTED} SELECT scope_id, token, value, key_id, strftime(written_at, '%Y-%m-%d') AS written FROM v")(
    lambda s, d: _vault(s, d).select("scope_id", "token", crypto.decrypt(F.col("ciphertext"), _key()).alias("value"), "key_id", _day("written_at").alias("written")))
SESSIONS = f"{UPSERTED}, ss AS (SELECT scope_id AS session_id, first(filename ORDER BY written_at DESC, filename DESC) AS filename, first(key_id ORDER BY written_at DESC, filename DESC) AS key_id, max(written_at) AS written_at, count(*) AS token_count FROM v GROUP BY 1)"
query("vault_sessions", f"WITH {SESSIONS} SELECT session_id, filename, key_id, strftime(written_at, '%Y-%m-%d') AS written, token_count FROM ss")(
    lambda s, d: V.sessions(_vault(s, d)).select("session_id", "filename", "key_id", _day("written_at").alias("written"), "token_count"))
query("vault_live", f"WITH {UPSERTED} SELECT scope_id, token FROM v JOIN (SELECT scope_id FROM v GROUP BY 1 HAVING max(written_at) + INTERVAL 30 DAY > TIMESTAMP '2001-03-01') USING (scope_id)")(
    lambda s, d: V.live(_vault(s, d), F.lit("2001-03-01").cast("timestamp")).select("scope_id", "token"))
query("session_of_file", f"WITH {W} SELECT key_id AS filename, first(scope_id ORDER BY written_at DESC, scope_id DESC) AS session_id FROM w GROUP BY 1")(
    lambda s, d: V.session_of_file(_writes(s, d).withColumn("filename", F.col("key_id"))))
query("token_map_of_session", f"WITH {UPSERTED} SELECT token, value FROM v WHERE scope_id = '7'")(
    lambda s, d: V.token_map(_vault(s, d), "7").select("token", crypto.decrypt(F.col("ciphertext"), _key()).alias("value")))
query("one_token", f"WITH {UPSERTED} SELECT token, value FROM v WHERE scope_id = '7' AND token = '[ORDER_' || substr(md5('5-LOW'), 1, 8) || ']'")(
    lambda s, d: V.one_token(_vault(s, d), "7", "[ORDER_c4f9fd21]").select("token", crypto.decrypt(F.col("ciphertext"), _key()).alias("value")))
query("session_meta", f"WITH {SESSIONS} SELECT session_id, filename, token_count FROM ss WHERE session_id = '7'")(
    lambda s, d: V.session_meta(_vault(s, d), "7").select("session_id", "filename", "token_count"))
query("sessions_newest_first", f"WITH {SESSIONS} SELECT session_id, token_count FROM ss ORDER BY written_at DESC, session_id")(
    lambda s, d: V.newest_first(V.sessions(_vault(s, d))).select("session_id", "token_count"))

DUMP = ("SELECT CASE WHEN o_orderstatus = 'O' THEN 'keyref:' ELSE 'tokenmap:' END || lpad(cast(o_orderkey AS string), 10, '0') AS hash_key, "
        "CASE WHEN o_orderstatus = 'O' THEN 'filename' ELSE '[CUST_' || substr(md5(cast(o_custkey AS string)), 1, 8) || ']' END AS field, "
        "cast(o_totalprice AS string) AS value FROM {orders}")
query("dump_import", f"SELECT field AS token, count(*) OVER () AS imported, first_key FROM (SELECT field, max(hash_key) AS first_key FROM ({DUMP.replace('{orders}', 'orders')}) WHERE field LIKE '[%' GROUP BY 1)")(
    lambda s, d: _imported(rel(s, d, DUMP)))


def _imported(dump):
    """Imported tokens with the hash key that won, and the number of imported tokens."""
    rows = dump.withColumn("value", F.col("hash_key").cast("binary"))
    made = V.import_dump(rows, "d1", F.lit("k"), F.lit("2024-01-01").cast("timestamp"))
    total = made.agg(F.count(F.lit(1))).scalar()
    return made.select("token", F.col("ciphertext").cast("string").alias("first_key"), total.alias("imported"))


query("master_map", "SELECT '[P_' || substr(md5(o_orderpriority), 1, 8) || ']' AS token, first(cast(o_custkey AS VARCHAR) ORDER BY 'f' || lpad(cast(o_orderkey AS VARCHAR), 10, '0') DESC) AS value FROM orders GROUP BY 1")(
    lambda s, d: V.master_map(rel(s, d, "SELECT '[P_' || substr(md5(o_orderpriority), 1, 8) || ']' AS token, cast(o_custkey AS string) AS value, 'f' || lpad(cast(o_orderkey AS string), 10, '0') AS file_name FROM {orders}")))

REQ = ("SELECT c_custkey AS request_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_custkey ELSE c_nationkey * 10 END AS dataset_id, "
       "CASE c_mktsegment WHEN 'BUILDING' THEN 'zz' WHEN 'FURNITURE' THEN 'abcd' ELSE md5(c_name) END AS key_hex FROM {customer}")
query("key_requests", f"""WITH r AS ({REQ.replace('{customer}', 'customer')}),
f AS (SELECT dataset_id, min(request_id) AS f FROM r WHERE length(key_hex) = 32 GROUP BY 1)
SELECT request_id, dataset_id, CASE WHEN key_hex = 'zz' THEN 'invalid_hex' WHEN key_hex = 'abcd' THEN 'bad_length'
  WHEN dataset_id NOT IN (SELECT s_suppkey FROM supplier) THEN 'dataset_not_found'
  WHEN dataset_id IN (SELECT n_nationkey FROM nation) OR request_id <> f THEN 'key_exists' ELSE 'accepted' END AS outcome
FROM r LEFT JOIN f USING (dataset_id)""")(
    lambda s, d: V.key_requests(rel(s, d, REQ), rel(s, d, "SELECT s_suppkey AS dataset_id FROM {supplier}"), rel(s, d, "SELECT cast(n_nationkey AS bigint) AS dataset_id FROM {nation}")).drop("aes_key"))

# Restoring: three entities per customer, one session per customer, addresses in dataset maps, no vault row for SSNs.
LITE = C.select_rules(["EMAIL_ADDRESS", "US_SSN", "IP_ADDRESS"])
LITE_TEXT = "'Mail c' || c_custkey || '@example.org, SSN 123-45-' || lpad(cast(1000 + c_custkey % 9000 AS string), 4, '0') || ' from 10.0.' || c_nationkey || '.9; again c' || c_custkey || '@example.org'"
LITE_SRC = f"SELECT c_custkey AS id, {LITE_TEXT} AS text FROM customer"
ROLE = "CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'viewer' ELSE 'analyst' END"
GRANTS = ("SELECT c_custkey AS user_id, c_nationkey AS dataset_id, 'EMAIL' AS entity_type FROM {customer} WHERE c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') "
          "UNION ALL SELECT c_custkey, c_nationkey, 'SSN' FROM {customer} WHERE c_mktsegment = 'FURNITURE' "
          "UNION ALL SELECT c_custkey, c_nationkey, '*' FROM {customer} WHERE c_mktsegment = 'HOUSEHOLD'")
LITE_TOKENS = Q.tokenization(LITE, LITE_SRC)
ALLOWED_SQL = f"allowed AS (SELECT c_custkey AS id, {ROLE} AS role, CASE WHEN c_mktsegment = 'BUILDING' THEN ['*'] WHEN c_mktsegment = 'AUTOMOBILE' THEN ['EMAIL'] WHEN c_mktsegment = 'FURNITURE' THEN ['EMAIL', 'SSN'] WHEN c_mktsegment = 'HOUSEHOLD' THEN ['*'] ELSE CAST([] AS VARCHAR[]) END AS types FROM customer)"
SHOWN = f"""{LITE_TOKENS}, {ALLOWED_SQL},
shown AS (SELECT t.*, (list_contains(types, '*') OR list_contains(types, label)) AS may, CASE WHEN (list_contains(types, '*') OR list_contains(types, label)) AND label <> 'SSN' THEN value ELSE token END AS piece_text
  FROM tokens t JOIN allowed USING (id)), {Q.spliced('shown', 'piece_text').replace('spliced AS', 'resolved_rows AS').replace('pieces AS', 'shown_pieces AS').replace('FROM pieces', 'FROM shown_pieces')}"""


def _lite(s, d):
    rows = table(s, d, "customer").selectExpr("c_custkey as id", "c_nationkey as dataset_id", f"{ROLE} as role", f"{LITE_TEXT} as text")
    return T.tokenize(spread(rows), rules=LITE)


def _lite_written(s, d):
    """Tokenized once and stored: requests and vault are read from it."""
    path = run_folder(s)
    _lite(s, d).write.parquet(path)
    return s.read.parquet(path)


def _stored(made):
    """Session maps without addresses and SSNs, dataset maps with the addresses."""
    stamp = F.lit("2024-01-01").cast("timestamp")
    rows = T.encrypted_map(T.token_rows(made, ["id", "dataset_id"]), _key())
    own = V.vault_rows(rows.filter("label = 'EMAIL'"), F.col("id"), F.lit("k"), F.lit("f"), stamp)
    shared = V.vault_rows(rows.filter("label = 'IP'"), F.col("dataset_id"), F.lit("k"), F.lit("f"), stamp, "dataset")
    return own.unionByName(shared.groupBy(*V.KEY).agg(*[F.min(c).alias(c) for c in V.VALUES]))


def _requests(made):
    return made.select("id", F.col("id").alias("user_id"), "role", "dataset_id", F.col("tokenized").alias("text"))


def _resolved(s, d):
    made = _lite_written(s, d)
    asked = A.allowed_types(_requests(made), rel(s, d, GRANTS))
    return R.resolve(asked, _stored(made), "id", session="id", dataset="dataset_id", allowed="allowed", key=_key())


query("token_places", f"WITH {LITE_TOKENS} SELECT id, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS position, token FROM tokens")(
    lambda s, d: R.token_places(_lite(s, d).select("id", F.col("tokenized").alias("text")), ["id"]))
query("distinct_tokens", f"WITH {LITE_TOKENS} SELECT DISTINCT id, token FROM tokens")(
    lambda s, d: R.distinct_tokens(_lite(s, d).select("id", F.col("tokenized").alias("text")), ["id"]))
query("allowed_types", f"WITH {ALLOWED_SQL} SELECT id, role, array_to_string(types, ',') AS allowed FROM allowed")(
    lambda s, d: A.allowed_types(
        table(s, d, "customer").selectExpr("c_custkey as id", "c_custkey as user_id", "c_nationkey as dataset_id", f"{ROLE} as role"),
        rel(s, d, GRANTS)).select("id", "role", F.array_join("allowed", ",").alias("allowed")))
query("resolve_under_grants", f"WITH {SHOWN} SELECT id, tokenized AS resolved FROM resolved_rows")(
    lambda s, d: _resolved(s, d).select("id", "resolved"))
query("disclosure_audit", f"WITH {SHOWN} SELECT DISTINCT id AS user_id, label AS entity_type, token, 'decrypt' AS action FROM shown WHERE piece_text <> token")(
    lambda s, d: R.audit_rows(_resolved(s, d), ["user_id"]))
query("restore_text", f"WITH {LITE_TOKENS}, shown AS (SELECT *, CASE WHEN label = 'SSN' THEN token ELSE value END AS piece_text FROM tokens), {Q.spliced('shown', 'piece_text').replace('spliced AS', 'r AS').replace('pieces AS', 'sp AS').replace('FROM pieces', 'FROM sp')} SELECT id, tokenized AS resolved FROM r")(
    lambda s, d: _restored(s, d).select("id", "resolved"))


def _restored(s, d):
    made = _lite_written(s, d)
    return R.resolve(_requests(made), _stored(made), "id", session="id", dataset="dataset_id", key=_key())


query("restore_summary", f"WITH {LITE_TOKENS} SELECT id, count(DISTINCT CASE WHEN label <> 'SSN' THEN token END) AS restored, count(DISTINCT CASE WHEN label = 'SSN' THEN token END) AS missing, 0 AS failed, max(CASE WHEN label = 'SSN' THEN token END) AS missing_list, '' AS failed_list FROM tokens GROUP BY id")(
    lambda s, d: R.restore_summary(_restored(s, d), ["id"]))
query("restore_totals", f"WITH {LITE_TOKENS} SELECT count(DISTINCT CASE WHEN label <> 'SSN' THEN token || id END) AS restored, count(DISTINCT CASE WHEN label = 'SSN' THEN token || id END) AS missing, 0 AS failed FROM tokens")(
    lambda s, d: R.restore_totals(_restored(s, d)))
query("decrypt_failures", f"WITH {UPSERTED} SELECT scope_id, token, CASE WHEN key_id = 'kO' THEN value END AS plaintext, key_id <> 'kO' AS failed FROM v")(
    lambda s, d: R.decrypt_rows(_vault(s, d), F.when(F.col("key_id") == "kO", _key()).otherwise(F.lit("AnotherSecretKey").cast("binary"))).select("scope_id", "token", "plaintext", "failed"))

USERS = ("SELECT c_custkey AS user_id, lower(c_mktsegment) || c_custkey || '@x.org' AS email, " + ROLE + " AS role, c_acctbal >= 0 AS is_active, c_acctbal AS created_at FROM {customer}")
U = f"u AS ({USERS.replace('{customer}', 'customer')})"
query("active_user", f"WITH {U} SELECT user_id, email FROM u WHERE is_active AND email = 'machinery1@x.org'")(
    lambda s, d: A.active_user(rel(s, d, USERS), email="machinery1@x.org").select("user_id", "email"))
query("users_by_age", f"WITH {U} SELECT user_id, email FROM u ORDER BY created_at, user_id")(
    lambda s, d: A.users_by_age(rel(s, d, USERS)).select("user_id", "email"))
query("role_predicate", f"WITH {U} SELECT user_id, role FROM u WHERE role IN ('admin', 'analyst')")(
    lambda s, d: rel(s, d, USERS).filter(A.has_role("admin", "analyst")).select("user_id", "role"))
NEW_USERS = "SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'F' THEN 'machinery' ELSE 'new' END || o_custkey || '@x.org' AS email, CASE WHEN o_orderpriority = '5-LOW' THEN 'owner' ELSE 'viewer' END AS role FROM {orders}"
query("insert_users", f"""WITH {U}, n AS ({NEW_USERS.replace('{orders}', 'orders')}), f AS (SELECT email, min(request_id) AS f FROM n WHERE role <> 'owner' GROUP BY 1)
SELECT request_id, email, role, CASE WHEN role = 'owner' THEN 'bad_role' WHEN email IN (SELECT email FROM u) OR request_id <> f THEN 'email_taken' ELSE 'accepted' END AS outcome FROM n LEFT JOIN f USING (email)""")(
    lambda s, d: A.insert_users(rel(s, d, NEW_USERS), rel(s, d, USERS)))
query("default_grants", "SELECT 1 AS user_id, s_suppkey AS dataset_id, unnest(['PERSON', 'EMAIL', 'PHONE', 'LOCATION', 'ORG']) AS entity_type FROM supplier")(
    lambda s, d: A.default_grants(1, "analyst", rel(s, d, "SELECT s_suppkey AS dataset_id FROM {supplier}")))
query("datasets_with_key_flag", "SELECT p_partkey AS dataset_id, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS has_key FROM part")(
    lambda s, d: A.datasets_with_key_flag(rel(s, d, "SELECT p_partkey AS dataset_id FROM {part}"), rel(s, d, "SELECT l_partkey AS dataset_id FROM {lineitem} WHERE l_returnflag = 'R'")))
NEW_GRANTS = "SELECT o_custkey AS user_id, c_nationkey AS dataset_id, CASE WHEN o_orderstatus = 'O' THEN 'EMAIL' ELSE 'PHONE' END AS entity_type FROM {orders} JOIN {customer} ON o_custkey = c_custkey"
query("insert_grants", f"SELECT * FROM ({NEW_GRANTS}) EXCEPT SELECT * FROM ({GRANTS})")(
    lambda s, d: A.insert_grants(rel(s, d, NEW_GRANTS), rel(s, d, GRANTS)))
query("revoke_grants", "SELECT o_orderkey AS grant_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")(
    lambda s, d: A.revoke_grants(rel(s, d, "SELECT o_orderkey AS grant_id FROM {orders}"), rel(s, d, "SELECT l_orderkey AS grant_id FROM {lineitem} WHERE l_returnflag = 'A'")))
query("delete_cascade", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")(
    lambda s, d: A.delete_cascade(rel(s, d, "SELECT o_orderkey, o_custkey FROM {orders}"), rel(s, d, "SELECT c_custkey AS o_custkey FROM {customer} WHERE c_acctbal < 0"), "o_custkey"))
query("delete_set_null", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")(
    lambda s, d: A.delete_set_null(rel(s, d, "SELECT o_orderkey, o_custkey FROM {orders}"), rel(s, d, "SELECT c_custkey AS o_custkey FROM {customer} WHERE c_acctbal < 0"), "o_custkey"))
query("recent_sessions", "SELECT user_id, event_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 50")(
    lambda s, d: A.recent_sessions(rel(s, d, "SELECT user_id, event_id AS session_id, ts AS updated_at FROM {events}")).select("user_id", "session_id", "rank"))
query("session_messages", "SELECT o_orderkey AS session_id, o_custkey AS user_id, o_orderpriority AS title, l_linenumber AS message_id, strftime(l_shipdate, '%Y-%m-%d') AS created FROM orders JOIN lineitem ON l_orderkey = o_orderkey")(
    lambda s, d: A.session_messages(
        rel(s, d, "SELECT o_orderkey AS session_id, o_custkey AS user_id, o_orderpriority AS title FROM {orders}"),
        rel(s, d, "SELECT l_orderkey AS session_id, l_linenumber AS message_id, l_shipdate AS created_at FROM {lineitem}")
    ).select("session_id", "user_id", "title", "message_id", _day("created_at").alias("created")))
query("session_activity", "SELECT user_id AS session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated, count(*) AS n_messages FROM events GROUP BY 1")(
    lambda s, d: A.session_activity(rel(s, d, "SELECT user_id AS session_id, ts AS created_at FROM {events}")).select(
        "session_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"), "n_messages"))
query("history_until", "SELECT e.event_id, e.user_id AS session_id FROM events e JOIN (SELECT user_id, max(ts) AS u FROM events WHERE event_type = 'purchase' GROUP BY 1) r USING (user_id) WHERE e.ts <= u")(
    lambda s, d: A.history_until(
        rel(s, d, "SELECT event_id, user_id AS session_id, ts AS created_at FROM {events}"),
        rel(s, d, "SELECT user_id AS session_id, max(ts) AS until FROM {events} WHERE event_type = 'purchase' GROUP BY 1")).select("event_id", "session_id"))
query("numbered_history", "SELECT event_id AS message_id, user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events")(
    lambda s, d: A.numbered_history(rel(s, d, "SELECT event_id AS message_id, user_id AS session_id, ts AS created_at FROM {events}")).select("message_id", "session_id", "position"))
query("history_of_messages", """WITH n AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events)
SELECT a.event_id AS asked_id, b.event_id AS message_id, b.p AS place FROM n a JOIN n b ON a.user_id = b.user_id AND b.p < a.p WHERE a.event_type = 'purchase'""")(
    lambda s, d: _history_of(s, d))


def _history_of(s, d):
    rows = rel(s, d, "SELECT event_id AS message_id, user_id AS session_id, ts AS created_at, event_type FROM {events}")
    return A.history_of(A.numbered_history(rows.drop("event_type")), rows.filter("event_type = 'purchase'")).select("asked_id", "message_id", "place")
