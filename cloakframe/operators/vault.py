"""The vault: a long table of encrypted originals keyed by (scope, token).

Columns: ``scope_type`` (session or dataset), ``scope_id``, ``token``,
``ciphertext``, ``key_id``, ``filename``, ``written_at``.  Every operator here
is a keyed aggregate with map-side combining or a filter, so a scope with a
large share of all tokens never ends up in one task.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..session import cut_lineage
from .skew import lookup_join

KEY = ["scope_type", "scope_id", "token"]
VALUES = ["ciphertext", "key_id", "filename", "written_at"]
COLUMNS = KEY + VALUES
STORED = ("scope_type string, scope_id string, token string, ciphertext binary, key_id string, filename string, "
          "written_at timestamp, bucket int")
SCOPES = "scope_type string, scope_id string, last_write timestamp, bucket int"
FILES = "scope_type string, scope_id string, filename string, written_at timestamp, bucket int"
BUCKETS = 256
TASKS_OF_A_BUCKET = 4  # a bucket is written by so many tasks, whatever a single scope in it holds


def vault_rows(
    token_map: DataFrame, scope_id: Column, key_id: Column, filename: Column, written_at: Column,
    scope_type: str = "session",
) -> DataFrame:
    """An encrypted token map as vault rows."""
    return token_map.select(
        F.lit(scope_type).alias("scope_type"), scope_id.cast("string").alias("scope_id"), "token", "ciphertext",
        key_id.alias("key_id"), filename.alias("filename"), written_at.alias("written_at"),
    )


def upsert(existing: DataFrame, writes: DataFrame) -> DataFrame:
    """Merge writes into the vault: per (scope, token) the latest write stays.

    On equal times a new write beats an old row.  An empty set of writes
    leaves the vault as it is.
    """
    both = existing.select(*COLUMNS, F.lit(0).alias("_new")).unionByName(writes.select(*COLUMNS, F.lit(1).alias("_new")))
    newest = F.struct("written_at", "_new", "key_id", "filename", "ciphertext")
    kept = both.groupBy(*KEY).agg(F.max(newest).alias("_row"))
    return kept.select(*KEY, *[F.col(f"_row.{name}").alias(name) for name in VALUES])


def file_log(writes: DataFrame) -> DataFrame:
    """Which session was written last for each file, from the writes themselves.

    Kept beside the vault: merging tokens loses the older file names of a token.
    """
    rows = writes.filter((F.col("scope_type") == "session") & F.col("filename").isNotNull())
    last = rows.groupBy("filename", "scope_type", "scope_id").agg(F.max("written_at").alias("written_at"))
    return last.select("scope_type", "scope_id", "filename", "written_at")


def bucket_of(scope_type: Column, scope_id: Column, buckets: int = BUCKETS) -> Column:
    """The folder of the stored vault that a scope lies in."""
    return F.pmod(F.xxhash64(scope_type, scope_id), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def buckets_of(spark: SparkSession, path: str, wanted: int | None = None) -> int | None:
    """How many buckets the vault at ``path`` has; None where nothing was stored.  Another wanted number is an error."""
    about = _read(spark, f"{path}/about", "buckets int")
    known = about.first() if about is not None else None
    if known and wanted not in (None, known[0]):
        raise ValueError(f"the vault has {known[0]} buckets, not {wanted}")
    return known[0] if known else None


def merged_batches(spark: SparkSession, path: str) -> DataFrame:
    """(stream, batch) of the batches merged into the vault."""
    found = _read(spark, f"{path}/batches", "batch bigint, stream string")
    return spark.createDataFrame([], "stream string, batch bigint") if found is None else found.select("stream", "batch")


def _replace(rows: DataFrame, touched: list[int], path: str, spread: Column) -> None:
    """Replace some buckets; each gets a row without a scope, so that an emptied bucket is replaced as well."""
    marks = rows.sparkSession.createDataFrame([(b,) for b in touched], "bucket int")
    whole = rows.unionByName(marks, allowMissingColumns=True).repartition("bucket", F.pmod(spread, F.lit(TASKS_OF_A_BUCKET)))
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _of_buckets(spark: SparkSession, path: str, schema: str, touched: list[int]) -> DataFrame:
    kept = _read(spark, path, schema)
    rows = spark.createDataFrame([], schema) if kept is None else kept
    return rows.filter(F.col("bucket").isin(touched) & F.col("scope_type").isNotNull())


def store(
    spark: SparkSession, writes: DataFrame, path: str, buckets: int | None = None, batch: tuple[str, int] | None = None
) -> bool:
    """Merge writes into the stored vault at ``path``; False where ``batch`` had been merged before.

    ``tokens``, ``scopes`` (last write of each) and ``files`` (which session wrote
    each file) lie in one folder per scope bucket, ``about`` has the number of
    buckets (``BUCKETS`` for a new vault).  Only the buckets that the writes touch
    are read and replaced; an interrupted run leaves the old buckets, and a
    repeated one gives the same rows.  ``batch``, a stream's name and batch
    number, is noted last.  The writes are evaluated once.  One writer at a time.
    """
    known = buckets_of(spark, path, buckets)
    count = known or buckets or BUCKETS
    if batch and not merged_batches(spark, path).filter((F.col("stream") == batch[0]) & (F.col("batch") == batch[1])).isEmpty():
        return False
    if not known:
        spark.range(1).select(F.lit(count).alias("buckets")).write.mode("overwrite").parquet(f"{path}/about")
    placed = writes.select(*COLUMNS).withColumn("bucket", bucket_of(F.col("scope_type"), F.col("scope_id"), count)).persist()
    try:
        touched = [r[0] for r in placed.select("bucket").distinct().collect()]  # at most ``count`` numbers
        if touched:
            scope = F.xxhash64("scope_type", "scope_id")
            where = bucket_of(F.col("scope_type"), F.col("scope_id"), count)
            merged = upsert(_of_buckets(spark, f"{path}/tokens", STORED, touched), placed).withColumn("bucket", where)
            _replace(merged, touched, f"{path}/tokens", F.xxhash64("token"))
            last = placed.groupBy("scope_type", "scope_id", "bucket").agg(F.max("written_at").alias("last_write"))
            last = last.unionByName(_of_buckets(spark, f"{path}/scopes", SCOPES, touched))
            last = last.groupBy("scope_type", "scope_id", "bucket").agg(F.max("last_write").alias("last_write"))
            _replace(last, touched, f"{path}/scopes", scope)
            files = file_log(placed).unionByName(_of_buckets(spark, f"{path}/files", FILES, touched).drop("bucket"))
            files = files.groupBy("scope_type", "scope_id", "filename").agg(F.max("written_at").alias("written_at"))
            _replace(files.withColumn("bucket", where), touched, f"{path}/files", F.xxhash64("filename"))
    finally:
        placed.unpersist()
    if batch:
        done = spark.createDataFrame([batch], "stream string, batch bigint")
        done.coalesce(1).write.mode("append").parquet(f"{path}/batches")
    return True


def sweep(spark: SparkSession, path: str, as_of: Column, ttl_days: int = C.VAULT_TTL_DAYS) -> list[int]:
    """Remove scopes whose last write is older than the time to live; the numbers of the buckets rewritten.

    The table of scopes names the buckets that hold a dead one.  Only these are
    read and replaced, and their tokens decide once more which scopes are dead,
    so that a run of ``store`` broken off between its tables loses nothing.
    """
    listed = _read(spark, f"{path}/scopes", SCOPES)
    if listed is None:
        return []
    dead = F.col("last_write") + F.make_interval(days=F.lit(ttl_days)) <= as_of
    touched = sorted(r[0] for r in listed.filter(F.col("scope_type").isNotNull() & dead).select("bucket").distinct().collect())
    if not touched:
        return []
    keys = ["scope_type", "scope_id", "bucket"]
    rows = _of_buckets(spark, f"{path}/tokens", STORED, touched)
    last = rows.groupBy(*keys).agg(F.max("written_at").alias("last_write"))
    alive = cut_lineage(last.filter(~dead))
    _replace(lookup_join(rows, alive.select(*keys), keys, "left_semi"), touched, f"{path}/tokens", F.xxhash64("token"))
    files = _of_buckets(spark, f"{path}/files", FILES, touched)
    _replace(lookup_join(files, alive.select(*keys), keys, "left_semi"), touched, f"{path}/files", F.xxhash64("filename"))
    _replace(alive, touched, f"{path}/scopes", F.xxhash64("scope_type", "scope_id"))
    return touched


def read_stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored vault; None where nothing was stored yet."""
    rows = _read(spark, f"{path}/tokens", STORED)
    return None if rows is None else rows.filter("scope_type is not null")


def stored_for(spark: SparkSession, path: str, scopes: DataFrame) -> DataFrame:
    """The stored rows in the buckets of some scopes (scope_type, scope_id); no other bucket is read."""
    count = buckets_of(spark, path)
    if count is None:
        return spark.createDataFrame([], STORED)
    where = scopes.select(bucket_of(F.col("scope_type"), F.col("scope_id").cast("string"), count).alias("bucket")).distinct()
    return _of_buckets(spark, f"{path}/tokens", STORED, [r[0] for r in where.collect()])  # at most ``count`` numbers


def stored_map(spark: SparkSession, path: str, scope_id, scope_type: str = "session", buckets: int | None = None) -> DataFrame:
    """Full map of one scope from the stored vault; only its bucket is read."""
    count = buckets_of(spark, path, buckets)
    bucket = bucket_of(F.lit(scope_type), F.lit(str(scope_id)), count or BUCKETS)
    rows = _read(spark, f"{path}/tokens", STORED)
    rows = spark.createDataFrame([], STORED) if rows is None else rows
    return token_map(rows.filter(F.col("bucket") == bucket), str(scope_id), scope_type)


def stored_scopes(spark: SparkSession, path: str) -> DataFrame:
    """scope_type, scope_id and last_write of the stored scopes."""
    return _read(spark, f"{path}/scopes", SCOPES).filter("scope_type is not null").drop("bucket")


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """The file log of the stored vault, for :func:`session_of_file`."""
    return _read(spark, f"{path}/files", FILES).filter("scope_type is not null").drop("bucket")


def sessions(vault: DataFrame) -> DataFrame:
    """One row per session: latest file name, key and time, and the number of tokens after merging."""
    newest = F.struct("written_at", "filename", "key_id")
    return (
        vault.filter(F.col("scope_type") == "session")
        .groupBy(F.col("scope_id").alias("session_id"))
        .agg(
            F.max_by("filename", newest).alias("filename"), F.max_by("key_id", newest).alias("key_id"),
            F.max("written_at").alias("written_at"), F.count(F.lit(1)).alias("token_count"),
        )
    )


def live_scopes(vault: DataFrame, as_of: Column, ttl_days: int = C.VAULT_TTL_DAYS) -> DataFrame:
    """Scopes whose last write is younger than the time to live."""
    last = vault.groupBy("scope_type", "scope_id").agg(F.max("written_at").alias("last_write"))
    return last.filter(F.col("last_write") + F.make_interval(days=F.lit(ttl_days)) > as_of)


def live(vault: DataFrame, as_of: Column, ttl_days: int = C.VAULT_TTL_DAYS, **join_options) -> DataFrame:
    """Vault rows of live scopes; every write had refreshed its whole scope."""
    scopes = live_scopes(vault, as_of, ttl_days).select("scope_type", "scope_id")
    return lookup_join(vault, scopes, ["scope_type", "scope_id"], "left_semi", **join_options)


def session_of_file(vault: DataFrame) -> DataFrame:
    """The session last written for each file name."""
    rows = vault.filter(F.col("scope_type") == "session")
    return rows.groupBy("filename").agg(
        F.max_by("scope_id", F.struct("written_at", "scope_id")).alias("session_id")
    )


def token_map(vault: DataFrame, scope_id, scope_type: str = "session") -> DataFrame:
    """Full map of one scope; both tests reach the scan."""
    return vault.filter((F.col("scope_type") == scope_type) & (F.col("scope_id") == F.lit(scope_id))).select(
        "token", "ciphertext"
    )


def one_token(vault: DataFrame, scope_id, token: str, scope_type: str = "session") -> DataFrame:
    return token_map(vault, scope_id, scope_type).filter(F.col("token") == F.lit(token))


def session_meta(vault: DataFrame, session_id) -> DataFrame:
    return sessions(vault.filter(F.col("scope_id") == F.lit(session_id)))


def newest_first(session_rows: DataFrame) -> DataFrame:
    """Sessions ordered by time, newest first; a missing time counts as the oldest."""
    stamp = F.coalesce(F.unix_timestamp("written_at"), F.lit(0))
    return session_rows.orderBy(stamp.desc(), F.col("session_id"))


def import_dump(hash_rows: DataFrame, dataset_id, key_id: Column, written_at: Column) -> DataFrame:
    """Exported hash rows (hash_key, field, value) as one dataset map.

    Fields that are not tokens (metadata hashes) are left out; the value of
    the last hash key wins.
    """
    is_token = F.rlike(F.col("field"), F.lit("^" + C.TOKEN_REGEX + "$"))
    merged = hash_rows.filter(is_token).groupBy(F.col("field").alias("token")).agg(
        F.max_by("value", F.struct("hash_key", "value")).alias("ciphertext")
    )
    return vault_rows(
        merged, F.lit(dataset_id), key_id, F.lit(None).cast("string"), written_at, scope_type="dataset"
    )


def mark_imported(datasets: DataFrame, vault: DataFrame) -> DataFrame:
    """Datasets with ``rdb_imported`` set where the vault holds a dataset map."""
    present = vault.filter(F.col("scope_type") == "dataset").select(
        F.col("scope_id").alias("dataset_id"), F.lit(True).alias("_present")
    ).distinct()
    return datasets.join(present, "dataset_id", "left").withColumn(
        "rdb_imported", F.coalesce(F.col("rdb_imported"), F.lit(False)) | F.coalesce(F.col("_present"), F.lit(False))
    ).drop("_present")


def master_map(file_maps: DataFrame) -> DataFrame:
    """Union of per-file plain maps; the last file name wins."""
    return file_maps.groupBy("token").agg(F.max_by("value", F.struct("file_name", "value")).alias("value"))


def key_requests(requests: DataFrame, datasets: DataFrame, keys: DataFrame) -> DataFrame:
    """Decide key uploads (request_id, dataset_id, key_hex): decoded key and an outcome.

    A dataset holds one key: a second one, stored or earlier in the batch, conflicts.
    """
    from ..functions.text import key_from_hex, key_is_valid

    decoded = requests.withColumn("aes_key", key_from_hex(F.col("key_hex")))
    valid = decoded.withColumn("_valid", F.coalesce(key_is_valid(F.col("aes_key")), F.lit(False)))
    first = valid.filter("_valid").groupBy("dataset_id").agg(F.min("request_id").alias("_first"))
    known = datasets.select("dataset_id", F.lit(True).alias("_known"))
    keyed = keys.select("dataset_id", F.lit(True).alias("_keyed")).distinct()
    joined = valid
    for facts in (known, keyed, first):
        joined = lookup_join(joined, facts, ["dataset_id"])
    outcome = (
        F.when(F.col("aes_key").isNull(), "invalid_hex").when(~F.col("_valid"), "bad_length")
        .when(F.col("_known").isNull(), "dataset_not_found")
        .when(F.col("_keyed").isNotNull() | (F.col("request_id") != F.col("_first")), "key_exists")
        .otherwise("accepted")
    )
    return joined.select("request_id", "dataset_id", "aes_key", outcome.alias("outcome"))
