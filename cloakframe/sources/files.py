"""Text, JSON and table sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, record_title, tokenized_name
from ..operators import tokenize as T
from ..operators.skew import running_totals
from ..session import stored
from . import jsonlists, schemas


FILE = ["file_path", "file_name"]  # the whole path names a file; the name alone may occur in many folders


def _file_columns() -> list[Column]:
    """Decoded path and name of the file a row came from (the scan gives percent-encoded paths)."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return [path.alias("file_path"), base_name(path).alias("file_name")]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a dense ``unit_no`` per file (``file_path``, ``file_name``).

    Files are split by the scan, so a very large file is read by many tasks;
    line numbers come from per-block counts.  Malformed bytes become U+FFFD.
    Only the line feed ends a line: a carriage return before it stays in the
    text, so that written files have the line ends of the read ones.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(
        *_file_columns(), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), F.make_valid_utf8("value").alias("text"),
    )
    numbered = running_totals(rows, FILE, [F.col("_row")], F.col("_block"), F.lit(1), "unit_no")
    return numbered.select(*FILE, F.col("unit_no").cast("long").alias("unit_no"), "text")


def read_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One row per file of a folder."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
    return rows.select(*_file_columns(), F.make_valid_utf8("value").alias("text"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path).withColumn("record_title", record_title(F.col("file_name")))


def rejected_json(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Files that hold no valid JSON, with their text; :func:`read_json_units` leaves them out."""
    bad = jsonlists.file_texts(spark, path, pattern, jsonlists.rejected_files(spark, path, pattern))
    return bad.select("file_path", base_name(F.col("file_path")).alias("file_name"), "text")


def json_file_counts(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """How many files of a run succeeded and failed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).agg(F.count(F.lit(1)).alias("all"))
    failed = jsonlists.rejected_files(spark, path, pattern).agg(F.count(F.lit(1)).alias("failed"))
    return files.join(failed).select((F.col("all") - F.col("failed")).alias("succeeded"), "failed")


def read_json_units(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """JSON files as text units.

    A list gives one unit per item: strings and objects with a ``text`` are
    units, other items pass through (``text`` is NULL).  A single object with
    ``text`` is one unit.  Anything else is one unit holding its JSON text.
    ``shape`` is ``list``, ``object`` or ``raw``; ``item`` is the item as a
    variant and ``in_object`` says whether the text is a field of it.  Files
    that do not parse end no job; they are the rows of :func:`rejected_json`.
    One large list is read by many tasks (``jsonlists.json_items``).  Items are
    written to a shared folder (``session.stored``), since the files that do not
    parse are known only behind them: listing and reading the files costs more.
    """
    items = stored(jsonlists.json_items(spark, path, pattern))
    items = items.join(jsonlists.files_with_bad_items(items), "file_path", "left_anti")
    units = items.withColumn("item_no", F.col("item")).withColumn("item", F.try_parse_json("text")).drop("text")
    item_kind = F.schema_of_variant("item")
    is_object = F.startswith(item_kind, F.lit("OBJECT"))
    in_object = is_object & (F.col("is_list") | F.try_variant_get("item", "$.text", "string").isNotNull())
    shape = F.when(F.col("is_list"), "list").when(in_object, "object").otherwise("raw")
    units = units.select(*FILE, F.col("item_no").alias("unit_no"), shape.alias("shape"), "item")
    text = (
        F.when(F.col("shape") == "raw", F.to_json("item"))
        .when(is_object, F.try_variant_get("item", "$.text", "string"))
        .when(item_kind == "STRING", F.col("item").cast("string"))
    )
    return units.withColumn("in_object", is_object & (F.col("shape") != "raw")).withColumn("text", text)


def rebuilt_item(units: DataFrame, tokenized: str = "tokenized", out: str = "output") -> DataFrame:
    """Output JSON of each unit: only the text changes, a broken raw unit becomes a JSON string."""
    fields = F.from_json(F.to_json("item"), "map<string,variant>")
    replaced = F.map_concat(
        F.map_filter(fields, lambda k, v: k != "text"),
        F.create_map(F.lit("text"), F.parse_json(F.to_json(F.struct(F.col(tokenized).alias("v"))))),
    )
    quoted = F.regexp_extract(F.to_json(F.struct(F.col(tokenized).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    with_text = F.transform_values(
        replaced, lambda k, v: F.when(k == "text", F.variant_get(v, "$.v", "variant")).otherwise(v)
    )
    result = (
        F.when(F.col(tokenized).isNull(), F.to_json("item"))
        .when(F.col("in_object"), F.to_json(with_text))
        .when(F.col("shape") == "raw", F.coalesce(F.to_json(F.try_parse_json(tokenized)), quoted))
        .otherwise(quoted)
    )
    return units.withColumn(out, result)


def tokenize_json(spark: SparkSession, path: str, **options) -> DataFrame:
    """Tokenize the units of JSON files; one token per value over all units of a file."""
    units = read_json_units(spark, path)
    filled = units.withColumn("absent", F.col("text").isNull()).withColumn("text", F.coalesce("text", F.lit("")))
    made = T.tokenize(filled, scope=["file_path"], unit="unit_no", **options)
    return rebuilt_item(made.withColumn("tokenized", F.when(~F.col("absent"), F.col("tokenized"))).drop("absent"))


def tokenize_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Tokenize text files line by line with one token per value and file."""
    return T.tokenize(read_lines(spark, path), scope=["file_path"], unit="unit_no", **options)


def read_annotated(spark: SparkSession, path: str, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Annotated samples as (good, rejected) rows.

    ``entities`` items are ``[start, end, label]``.  With ``fail_fast`` a bad
    sample stops the job and names its position instead.
    """
    fields = schemas.ANNOTATED + ", _corrupt string"
    rows = spark.read.schema(fields).json(
        path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt"
    ).withColumn("index", F.monotonically_increasing_id())
    good = F.col("text").isNotNull() & F.col("entities").isNotNull() & F.col("_corrupt").isNull()
    entities = F.transform(
        "entities",
        lambda e: F.struct(
            F.get(e, F.lit(0)).cast("int").alias("start"), F.get(e, F.lit(1)).cast("int").alias("end"),
            F.get(e, F.lit(2)).alias("label"),
        ),
    )
    if fail_fast:
        message = F.concat(F.lit("item "), F.col("index").cast("string"), F.lit(" needs a text and a list of entities"))
        rows = rows.withColumn("text", F.when(good, F.col("text")).otherwise(F.raise_error(message).cast("string")))
        return rows.select("index", "text", entities.alias("entities")), rows.filter(F.lit(False))
    rejected = rows.filter(~good).select("index", F.coalesce("_corrupt", F.to_json(F.struct("text", "entities"))).alias("row"))
    return rows.filter(good).select("index", "text", entities.alias("entities")), rejected


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Chat examples, one JSON object per line; blank lines give nothing."""
    return spark.read.schema(schemas.CHAT_EXAMPLES).json(path).filter(F.col("messages").isNotNull())


def write_examples(df: DataFrame, path: str) -> None:
    """Chat examples as JSON lines, one folder per split; text is not escaped."""
    df.select("split", "messages").write.mode("overwrite").partitionBy("split").json(path)


LINES_OF_A_PART = 1 << 20


def _write_in_order(df: DataFrame, value: str, path: str) -> None:
    """One folder ``output_name=`` per source file, and in it one folder per block of lines.

    Blocks are hashed to tasks: one large file is written by many tasks, and no
    sampling of ranges evaluates the input a second time.  Files of the same
    name in different folders come one after the other.
    """
    named = df.select(
        tokenized_name(F.col("file_name")).alias("output_name"), "file_path", "unit_no",
        F.lpad(F.floor(F.col("unit_no") / LINES_OF_A_PART).cast("string"), 12, "0").alias("lines"), F.col(value).alias("value"),
    )
    ordered = named.repartition("output_name", "lines").sortWithinPartitions("output_name", "lines", "file_path", "unit_no")
    ordered.drop("unit_no", "file_path").write.mode("overwrite").partitionBy("output_name", "lines").text(path)


def write_tokenized_lines(df: DataFrame, path: str) -> None:
    """Tokenized lines in order, one folder per source file."""
    _write_in_order(df, "tokenized", path)


def write_json_units(df: DataFrame, path: str) -> None:
    """Rebuilt JSON items as JSON lines in order, one folder per source file."""
    _write_in_order(df, "output", path)


def export_plain_map(token_rows: DataFrame, path: str, i_know_this_is_plaintext: bool = False) -> None:
    """Write a token -> plain value map; refused unless asked for explicitly."""
    if not i_know_this_is_plaintext:
        raise PermissionError("the plain map holds personal data; pass i_know_this_is_plaintext=True")
    token_rows.select("token", "value").write.mode("overwrite").json(path)


def publish(run_id: str, vault_rows: DataFrame, output: DataFrame, root: str) -> None:
    """Write the vault first, then the output, then the run marker.

    Each part goes to its own folder of the run, so a repeat overwrites and a
    failure before the marker leaves nothing that readers see.
    """
    spark = output.sparkSession
    vault_rows.write.mode("overwrite").parquet(f"{root}/vault/run_id={run_id}")
    output.write.mode("overwrite").parquet(f"{root}/output/run_id={run_id}")
    spark.range(1).select(F.current_timestamp().alias("published_at")).write.mode("overwrite").parquet(
        f"{root}/runs/run_id={run_id}"
    )


def read_published(spark: SparkSession, root: str, part: str = "output") -> DataFrame:
    """Rows of published runs only."""
    runs = spark.read.parquet(f"{root}/runs").select("run_id").distinct()
    return spark.read.parquet(f"{root}/{part}").join(runs, "run_id", "left_semi")


def write_audit(rows: DataFrame, path: str) -> None:
    """Append disclosures, partitioned by day; rows without ``created_at`` were made now."""
    if "created_at" not in rows.columns:
        rows = rows.withColumn("created_at", F.current_timestamp())
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)
