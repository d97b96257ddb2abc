"""Restoring tokens under grants, with an audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import crypto
from ..functions.arrays import exploded, let
from ..functions.text import token_label, tokens
from .skew import lookup_join


def token_places(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Every token of every text with its position among the tokens."""
    return exploded(df, keys, tokens(F.col(text)), "token", "position")


def distinct_tokens(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Distinct tokens per row."""
    return exploded(df, keys, F.array_distinct(tokens(F.col(text))), "token")


def decrypt_rows(rows: DataFrame, key: Column) -> DataFrame:
    """Add ``plaintext`` and ``failed``; a wrong key or damaged value marks the row and stops nothing."""
    opened = rows.withColumn("plaintext", crypto.decrypt(F.col("ciphertext"), key))
    return opened.withColumn("failed", F.col("ciphertext").isNotNull() & F.col("plaintext").isNull())


def replace_tokens(text: Column, value_of) -> Column:
    """Text with each token replaced by ``value_of(token)``, in one pass."""

    def build(b: Column) -> Column:
        def piece(gap: Column, i: Column) -> Column:
            return F.concat(gap, F.coalesce(value_of(F.get(b["token"], i)), F.lit("")))

        return F.array_join(F.transform(b["gap"], piece), "")

    return let(F.struct(F.split(text, C.TOKEN_REGEX, -1).alias("gap"), tokens(text).alias("token")), build)


def resolve(
    df: DataFrame,
    vault: DataFrame,
    id: str,
    text: str = "text",
    session: str | None = "session_id",
    dataset: str | None = None,
    allowed: str | None = None,
    key: Column | None = None,
    out: str = "resolved",
    **join_options,
) -> DataFrame:
    """Replace the tokens a row may see by their plain values.

    Per row: ``allowed`` is an array of labels (``*`` = all; without the column
    everything is allowed), the session map is asked first, then the dataset
    map, and ``key`` opens the value.  Adds ``out`` and the lists
    ``restored_tokens``, ``missing_tokens`` and ``failed_tokens``.

    Only allowed, distinct tokens travel: they are looked up in one join with
    hot tokens salted, and come back as one small map per row.  Rows that show no
    token stay where they are; the others alone are shuffled for the join back.
    The input is read three times: pass a stored or persisted table.
    """
    if key is None:
        raise ValueError("a key column is needed")
    wanted = F.array_distinct(tokens(F.col(text)))
    if allowed:
        wanted = let(
            F.struct(wanted.alias("t"), F.col(allowed).alias("a")),
            lambda b: F.filter(
                b["t"],
                lambda t: F.array_contains(b["a"], F.lit("*")) | F.array_contains(b["a"], token_label(t)),
            ),
        )
    scopes = []
    for rank, (kind, column) in enumerate((("session", session), ("dataset", dataset))):
        if column:
            scopes.append(
                F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("scope_type"),
                         F.col(column).cast("string").alias("scope_id"))
            )
    if not scopes:
        raise ValueError("a session or a dataset column is needed")
    every = df.withColumn("_wanted", wanted)
    staged = every.filter(F.size("_wanted") > 0)
    asked = (
        exploded(staged, [F.col(id).alias("_id"), key.alias("_key"), F.array(*scopes).alias("_scopes")], "_wanted", "token")
        .select("_id", "_key", "token", F.inline("_scopes"))
        .filter(F.col("scope_id").isNotNull())
    )
    written = F.col("written_at") if "written_at" in vault.columns else F.lit(None).cast("timestamp")
    stored = vault.select("scope_type", "scope_id", "token", "ciphertext", written.alias("_written")).filter(F.length("ciphertext") > 0)
    found = lookup_join(asked, stored, ["scope_type", "scope_id", "token"], "inner", **join_options)
    # A vault that was not merged may hold a token more than once; the row written last counts.
    found = found.groupBy("_id", "rank", "token").agg(
        F.max(F.struct("_written", "ciphertext"))["ciphertext"].alias("ciphertext"), F.first("_key").alias("_key"))
    opened = found.select("_id", "token", "rank", crypto.decrypt(F.col("ciphertext"), F.col("_key")).alias("_plain"))
    entry = F.struct("token", "_plain")
    maps = opened.groupBy("_id").agg(
        *[F.map_from_entries(F.collect_list(F.when(F.col("rank") == r, entry))).alias(f"_map{r}") for r in (0, 1)]
    )
    joined = staged.join(maps, staged[id] == maps["_id"], "left").drop("_id")

    def build(b: Column) -> Column:
        def held(t: Column) -> Column:
            return F.coalesce(F.map_contains_key(b["m0"], t) | F.map_contains_key(b["m1"], t), F.lit(False))

        def plain(t: Column) -> Column:
            first = F.coalesce(F.map_contains_key(b["m0"], t), F.lit(False))
            return F.when(first, F.try_element_at(b["m0"], t)).otherwise(F.try_element_at(b["m1"], t))

        return F.struct(
            F.when(b["m0"].isNull(), b["t"]).otherwise(
                replace_tokens(
                    b["t"],
                    lambda t: F.when(F.array_contains(b["w"], t), F.coalesce(plain(t), t)).otherwise(t),
                )
            ).alias("text"),
            F.filter(b["w"], lambda t: held(t) & plain(t).isNotNull()).alias("restored"),
            F.filter(b["w"], lambda t: ~held(t)).alias("missing"),
            F.filter(b["w"], lambda t: held(t) & plain(t).isNull()).alias("failed"),
        )

    bound = F.struct(
        F.col(text).alias("t"), F.col("_wanted").alias("w"), F.col("_map0").alias("m0"), F.col("_map1").alias("m1")
    )
    result = joined.withColumn("_r", let(bound, build)).withColumns({
        out: F.col("_r.text"), "restored_tokens": F.col("_r.restored"),
        "missing_tokens": F.col("_r.missing"), "failed_tokens": F.col("_r.failed"),
    }).drop("_r", "_wanted", "_map0", "_map1")
    nothing = every.filter(F.coalesce(F.size("_wanted"), F.lit(0)) <= 0)
    lists = {name: F.col("_wanted") for name in ("restored_tokens", "missing_tokens", "failed_tokens")}
    return result.unionByName(nothing.withColumns({out: F.col(text), **lists}).drop("_wanted"))


def restore_summary(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and lists of restored, missing and failed tokens per row."""
    kinds = ("restored", "missing", "failed")
    return resolved.select(
        *keys,
        *[F.size(f"{k}_tokens").cast("long").alias(k) for k in kinds],
        *[F.array_join(F.array_sort(f"{k}_tokens"), ",").alias(f"{k}_list") for k in kinds if k != "restored"],
    )


def restore_totals(resolved: DataFrame) -> DataFrame:
    """Totals over all rows."""
    return resolved.agg(*[F.sum(F.size(f"{k}_tokens")).alias(k) for k in ("restored", "missing", "failed")])


def audit_rows(
    resolved: DataFrame, keys: list[str], text: str = "text", out: str = "resolved", action: str = "decrypt"
) -> DataFrame:
    """One row per distinct token that is in the original and not in the resolved text."""
    shown = F.array_except(tokens(F.col(text)), tokens(F.col(out)))
    rows = exploded(resolved, keys, shown, "token")
    return rows.select(*keys, token_label(F.col("token")).alias("entity_type"), "token", F.lit(action).alias("action"))
