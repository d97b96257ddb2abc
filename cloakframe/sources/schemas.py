"""Schemas of the metadata tables, message streams and sample files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USERS = "user_id string, email string, hashed_password string, role string, is_active boolean, created_at timestamp"
DATASETS = (
    "dataset_id string, name string, description string, model_name string, rdb_imported boolean, "
    "created_by string, created_at timestamp"
)
ENCRYPTION_KEYS = (
    "key_id string, dataset_id string, encrypted_key binary, key_ref string, created_by string, created_at timestamp"
)
RBAC_GRANTS = (
    "grant_id string, user_id string, dataset_id string, entity_type string, granted_by string, created_at timestamp"
)
CHAT_SESSIONS = (
    "session_id string, user_id string, dataset_id string, title string, created_at timestamp, updated_at timestamp"
)
MESSAGES = "message_id string, session_id string, role string, content string, created_at timestamp"
AUDIT_LOG = (
    "audit_id string, user_id string, entity_type string, token string, dataset_id string, action string, "
    "created_at timestamp"
)
VAULT = (
    "scope_type string, scope_id string, token string, ciphertext binary, key_id string, filename string, "
    "written_at timestamp"
)
TABLES = {
    "users": USERS, "datasets": DATASETS, "encryption_keys": ENCRYPTION_KEYS, "rbac_grants": RBAC_GRANTS,
    "chat_sessions": CHAT_SESSIONS, "messages": MESSAGES, "audit_log": AUDIT_LOG, "vault": VAULT,
}

CHAT_REQUESTS = "message_id string, session_id string, dataset_id string, user_id string, message string, ts timestamp"
CHAT_CHUNKS = "session_id string, seq bigint, content string, done boolean, error string, ts timestamp"
CHAT_EXAMPLES = "messages array<struct<role:string,content:string>>"
ANNOTATED = "text string, entities array<array<string>>"


def upgrade_datasets(old: DataFrame) -> DataFrame:
    """Datasets written before ``model_name`` and ``rdb_imported`` existed, brought to today's columns."""
    out = old
    if "model_name" not in out.columns:
        out = out.withColumn("model_name", F.lit(None).cast("string"))
    imported = F.col("rdb_imported") if "rdb_imported" in out.columns else F.lit(None).cast("boolean")
    return out.withColumn("rdb_imported", F.coalesce(imported, F.lit(False)))
