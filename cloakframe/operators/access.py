"""Users, datasets, grants, sessions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from .skew import lookup_join, running_totals


def allowed_types(requests: DataFrame, grants: DataFrame, out: str = "allowed", **join_options) -> DataFrame:
    """Entity types a request (user_id, role, dataset_id) may see.

    Admins see everything, requests without a dataset nothing, others what was
    granted.  A (user, dataset) pair has at most one row per entity type.
    """
    per_pair = grants.groupBy("user_id", "dataset_id").agg(F.collect_set("entity_type").alias("_granted"))
    joined = lookup_join(requests, per_pair, ["user_id", "dataset_id"], "left", **join_options)
    none = F.array().cast("array<string>")
    value = (
        F.when(F.col("role") == "admin", F.array(F.lit("*")))
        .when(F.col("dataset_id").isNull(), none)
        .otherwise(F.coalesce(F.col("_granted"), none))
    )
    return joined.withColumn(out, F.array_sort(value)).drop("_granted")


def active_user(users: DataFrame, email: str | None = None, user_id=None) -> DataFrame:
    """An active user by address or id; both tests reach the scan."""
    found = users.filter(F.col("is_active"))
    if email is not None:
        found = found.filter(F.col("email") == F.lit(email))
    if user_id is not None:
        found = found.filter(F.col("user_id") == F.lit(user_id))
    return found


def users_by_age(users: DataFrame) -> DataFrame:
    return users.orderBy("created_at", "user_id")


def has_role(*roles: str) -> Column:
    return F.col("role").isin(*roles)


def insert_users(new: DataFrame, users: DataFrame) -> DataFrame:
    """Decide new users (request_id, email, role): one per address, known roles only."""
    good_role = F.col("role").isin(*C.ROLES)
    first = new.filter(good_role).groupBy("email").agg(F.min("request_id").alias("_first"))
    taken = users.select("email", F.lit(True).alias("_taken")).distinct()
    joined = lookup_join(lookup_join(new, taken, ["email"]), first, ["email"])
    outcome = (
        F.when(~good_role, "bad_role")
        .when(F.col("_taken").isNotNull() | (F.col("request_id") != F.col("_first")), "email_taken")
        .otherwise("accepted")
    )
    return joined.select("request_id", "email", "role", outcome.alias("outcome"))


def default_grants(user_id, role: str, datasets: DataFrame) -> DataFrame:
    """Grants of one new user: an analyst gets five entity types on every dataset."""
    types = C.DEFAULT_GRANT_TYPES if role == "analyst" else ()
    kinds = F.array(*[F.lit(t) for t in types]).cast("array<string>")
    return datasets.select(F.lit(user_id).alias("user_id"), "dataset_id", F.explode(kinds).alias("entity_type"))


def datasets_with_key_flag(datasets: DataFrame, keys: DataFrame) -> DataFrame:
    keyed = keys.select("dataset_id", F.lit(True).alias("_keyed")).distinct()
    return datasets.join(keyed, "dataset_id", "left").withColumn(
        "has_key", F.coalesce(F.col("_keyed"), F.lit(False))
    ).drop("_keyed")


def insert_grants(new: DataFrame, grants: DataFrame) -> DataFrame:
    """New grants that are not there yet; each triple once."""
    triple = ["user_id", "dataset_id", "entity_type"]
    return new.select(*triple).dropDuplicates().join(grants.select(*triple), triple, "left_anti")


def revoke_grants(grants: DataFrame, revoked: DataFrame) -> DataFrame:
    return grants.join(revoked.select("grant_id"), "grant_id", "left_anti")


def delete_cascade(children: DataFrame, removed: DataFrame, key: str, **join_options) -> DataFrame:
    """Child rows whose parent stays; a NULL parent is no reference."""
    gone = removed.select(key).distinct()
    return lookup_join(children, gone, [key], "left_anti", **join_options)


def delete_set_null(children: DataFrame, removed: DataFrame, key: str, **join_options) -> DataFrame:
    """Child rows with references to removed parents cleared."""
    gone = removed.select(F.col(key), F.lit(True).alias("_gone")).distinct()
    joined = lookup_join(children, gone, [key], "left", **join_options)
    kind = children.schema[key].dataType
    return joined.withColumn(key, F.when(F.col("_gone"), F.lit(None).cast(kind)).otherwise(F.col(key))).drop(
        "_gone"
    ).select(*children.columns)


def recent_sessions(sessions: DataFrame, limit: int = 50) -> DataFrame:
    """Each user's latest sessions.

    The rank limit is applied before the shuffle as well, so a user with very
    many sessions sends at most ``limit`` rows per input partition.
    """
    w = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("session_id"))
    return sessions.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def sessions_of(sessions: DataFrame, user_id, limit: int = 50) -> DataFrame:
    """One user's latest sessions."""
    return sessions.filter(F.col("user_id") == F.lit(user_id)).orderBy(
        F.desc("updated_at"), F.desc("session_id")
    ).limit(limit)


def session_messages(sessions: DataFrame, messages: DataFrame, user_id=None, **join_options) -> DataFrame:
    """Messages of sessions, with their session's owner and title, in order within each session.

    Rows stay rows: a session is a sorted run inside one partition, never one
    collected value, and no sort of all messages takes place.
    """
    owned = sessions if user_id is None else sessions.filter(F.col("user_id") == F.lit(user_id))
    joined = lookup_join(messages, owned.select("session_id", "user_id", "title"), ["session_id"], "inner", **join_options)
    return joined.repartition("session_id").sortWithinPartitions("session_id", "created_at", "message_id")


def session_activity(messages: DataFrame) -> DataFrame:
    """Creation and last-update time of each session from its messages."""
    return messages.groupBy("session_id").agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"),
        F.count(F.lit(1)).alias("n_messages"),
    )


def history_until(messages: DataFrame, requests: DataFrame, **join_options) -> DataFrame:
    """Messages a request sees: all of its session up to its own time, as rows.

    ``requests`` (session_id, until) holds one row per session.
    """
    joined = lookup_join(messages, requests, ["session_id"], "inner", **join_options)
    return joined.filter(F.col("created_at") <= F.col("until"))


def numbered_history(messages: DataFrame, id: str = "message_id") -> DataFrame:
    """Every message with ``position``, its place (from 0) in its session by time, then id.

    What a message may see are the rows of its session with a smaller position,
    in that order; :func:`history_of` gives them.  Places are two-level: counts
    per day and session first, so that one endless session stays spread out.
    """
    return running_totals(
        messages, ["session_id"], [F.col("created_at"), F.col(id)], F.to_date("created_at"), F.lit(1), "position"
    ).withColumn("position", F.col("position").cast("long"))


def history_of(numbered: DataFrame, asked: DataFrame, id: str = "message_id", **join_options) -> DataFrame:
    """Per asked message (session_id, id) everything before it in its session, with ``place`` in order.

    Several messages of one session may be asked for; equal times are told apart by position.
    """
    at = lookup_join(asked.select("session_id", id), numbered.select("session_id", id, "position"), ["session_id", id], "inner")
    at = at.select("session_id", F.col(id).alias("asked_id"), F.col("position").alias("_at"))
    seen = lookup_join(numbered, at, ["session_id"], "inner", **join_options).filter(F.col("position") < F.col("_at"))
    return seen.withColumnRenamed("position", "place").drop("_at")
