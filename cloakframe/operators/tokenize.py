"""Replacing detected values by reversible tokens."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog as C
from ..functions import crypto
from ..functions.arrays import built_once, exploded, let, over_batches
from ..functions.text import sanitize
from ..session import cut_lineage, stored
from . import detect as D
from . import gazetteer
from . import spans as S
from .skew import lookup_join

ENTITY = "struct<start:int,end:int,label:string,score:double,source:string,value:string,token:string>"


def token_label(label: Column) -> Column:
    """Short label of a detection label, at most 20 characters."""
    table = F.expr(
        "map(" + ", ".join(f"'{k}', '{v}'" for k, v in C.LABEL_NORM.items()) + ")"
    )
    return F.substring(F.coalesce(F.try_element_at(table, label), F.upper(label)), 1, C.TOKEN_LABEL_CHARS)


def make_token(short_label: Column, value: Column) -> Column:
    return F.concat(
        F.lit("["), short_label, F.lit("_"), F.substring(F.md5(value.cast("binary")), 1, C.TOKEN_ID_CHARS), F.lit("]")
    )


ENTITY_FIELDS = [*S.FIELDS, ("value", pa.string()), ("token", pa.string())]


@lru_cache(maxsize=4096)
def _short(label: str | None) -> str | None:
    """:func:`token_label` of a value."""
    return None if label is None else C.LABEL_NORM.get(label, label.upper())[: C.TOKEN_LABEL_CHARS]


def _token(short: str | None, value: str | None) -> str | None:
    """:func:`make_token` of values."""
    if short is None or value is None:
        return None
    return f"[{short}_{hashlib.md5(value.encode(), usedforsecurity=False).hexdigest()[: C.TOKEN_ID_CHARS]}]"


def _valued(text: str | None, spans: list[tuple]) -> list[tuple]:
    """Spans with their value, short label and token; the rightmost label of a value wins."""
    values = [None if text is None or s[0] is None or s[1] is None else text[s[0] : max(s[0], s[1])] for s in spans]
    labels = {v: _short(s[2]) for v, s in zip(values, spans) if v is not None}
    return [
        (s[0], s[1], short, s[3], s[4], v, _token(short, v))
        for s, v in zip(spans, values) for short in (_short(s[2]) if v is None else labels[v],)
    ]


def _entities(texts: pa.Array, merged: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), S.span_lists(merged))
    return S.listed([spans and _valued(text, spans) for text, spans in rows], ENTITY_FIELDS)


@lru_cache(maxsize=64)
def _named(gap: int):
    """:func:`_entities` of spans that are still to be merged."""

    def work(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return _entities(texts, S.merger(gap)(spans))

    return work


def with_entities(df: DataFrame, text: str = "text", spans: str = "spans", gap: int = 1, out: str = "entities") -> DataFrame:
    """Merge neighbouring spans and give each its value and token."""
    merged = df.withColumn("_merged", S.merge_near(F.col(spans), gap))
    made = over_batches(_entities, f"array<{ENTITY}>", [F.col(text), F.col("_merged")], [F.octet_length(text), F.size("_merged")])
    return merged.withColumn(out, made).drop("_merged")


FIXES_IN_MEMORY = 20_000


def _relabelled(entities: str, fix: str) -> Column:
    """Entities with the labels of a ``value -> label`` map put in, and their tokens."""

    def corrected(b: Column) -> Column:
        def one(e: Column) -> Column:
            label = F.coalesce(F.try_element_at(b["f"], e["value"]), e["label"])
            return F.struct(
                e["start"].alias("start"), e["end"].alias("end"), label.alias("label"), e["score"].alias("score"),
                e["source"].alias("source"), e["value"].alias("value"), make_token(label, e["value"]).alias("token"),
            )

        return F.transform(b["e"], one)

    return F.when(F.col(fix).isNull(), F.col(entities)).otherwise(
        let(F.struct(F.col(entities).alias("e"), F.col(fix).alias("f")), corrected).cast(f"array<{ENTITY}>")
    )


def label_conflicts(df: DataFrame, scope: list[str], unit: str, entities: str = "entities") -> DataFrame:
    """Values of a scope that were seen with more than one label, and the label they must have.

    The label of a value is the one at its rightmost place in the earliest
    unit.  Inside a unit that is already so, so conflicts only arise between
    units.  The aggregate combines before its shuffle: a value or scope that
    holds much of the data costs one row per task.
    """
    seen = exploded(df, [*scope, unit], entities, "e")
    return (
        seen.groupBy(*scope, F.col("e.value").alias("value"))
        .agg(
            F.min_by("e.label", F.struct(F.col(unit), F.col("e.label"))).alias("_label"),
            F.min("e.label").alias("_low"), F.max("e.label").alias("_high"),
        )
        .filter(F.col("_low") != F.col("_high"))
        .select(*scope, "value", "_label")
    )


def with_shared_labels(
    df: DataFrame, scope: list[str], unit: str, entities: str = "entities", in_memory: int = FIXES_IN_MEMORY,
    **join_options,
) -> DataFrame:
    """One token per value over all units of a scope.

    The rows are written once, as they are read up to three times and detection is
    dear.  Conflicts are computed first and checkpointed.  Without any the rows stay
    as they are; up to ``in_memory`` of them are broadcast as one map per scope
    and no text is shuffled; more are joined by (scope, value) with hot keys
    salted.
    """
    df = stored(df)
    fixes = cut_lineage(label_conflicts(df, scope, unit, entities))
    found = fixes.count()
    if found == 0:
        return df
    entry = F.map_from_entries(F.collect_list(F.struct("value", "_label"))).alias("_fix")
    if found <= in_memory:
        joined = df.join(F.broadcast(fixes.groupBy(*scope).agg(entry)), scope, "left")
        return joined.withColumn(entities, _relabelled(entities, "_fix")).drop("_fix")
    values = F.array_distinct(F.transform(entities, lambda e: e["value"]))
    seen = exploded(df, [*scope, unit], values, "value")
    changed = lookup_join(seen, fixes, [*scope, "value"], "inner", **join_options)
    per_unit = changed.groupBy(*scope, unit).agg(entry)
    joined = df.join(per_unit, [*scope, unit], "left")
    return joined.withColumn(entities, _relabelled(entities, "_fix")).drop("_fix")


def with_tokenized(df: DataFrame, text: str = "text", entities: str = "entities", out: str = "tokenized") -> DataFrame:
    spliced = built_once(
        ("spliced", text, entities), lambda: S.splice(F.col(text), F.col(entities), lambda e: e["token"])
    )
    return df.withColumn(out, spliced)


def with_encrypted(
    df: DataFrame, key: Column, text: str = "text", entities: str = "entities", out: str = "encrypted"
) -> DataFrame:
    """Values replaced in place by base64 ciphertext (one line each) instead of tokens."""

    def build(b: Column) -> Column:
        return S.splice(b["t"], b["e"], lambda e: crypto.sealed(e["value"], b["k"]))

    bound = F.struct(F.col(text).alias("t"), F.col(entities).alias("e"), key.alias("k"))
    return df.withColumn(out, let(bound, build))


def tokenize(
    df: DataFrame,
    text: str = "text",
    rules=None,
    entities=None,
    model_spans: str | None = None,
    threshold: float = C.MODEL_THRESHOLD,
    trim: str = "labelled",
    gap: int = 1,
    mode: str = "token",
    key: Column | None = None,
    scope: list[str] | None = None,
    unit: str | None = None,
    phrases: DataFrame | None = None,
    **detect_options,
) -> DataFrame:
    """Detect, merge and replace in one pass over the rows.

    ``phrases`` (phrase, label) is a table of names (people, places, groups) that
    count wherever no rule span lies.  A table too large for every task is joined
    by ``gazetteer.with_phrases`` beforehand and passed as ``model_spans``.

    Adds ``entities`` and ``tokenized``.  Without ``scope`` each row is its own
    token scope and the plan has no shuffle; with ``scope`` and ``unit`` values
    get one label over all units of the scope.
    """
    if mode not in ("token", "encrypt"):
        raise ValueError(f"mode must be token or encrypt, got {mode!r}")
    if mode == "encrypt" and key is None:
        raise ValueError("mode encrypt needs a key column")
    if phrases is not None:
        df = gazetteer.with_phrases(df, phrases, text, "_named")
    found = D.with_rule_spans(df, text, rules, entities, trim, out="_spans", **detect_options)
    if phrases is not None:
        found = D.with_model_spans(found, "_named", "_spans", 0.0, out="_spans").drop("_named")
    if model_spans:
        found = D.with_model_spans(found, model_spans, "_spans", threshold, out="_spans")
    # One step, where with_entities has two: a worker of Python less for every task.
    spans = F.col("_spans").cast(S.SPANS)
    known = found.withColumn("entities", over_batches(_named(gap), f"array<{ENTITY}>", [F.col(text), spans], [F.octet_length(text), F.size(spans)])).drop("_spans")
    if scope:
        if unit is None:
            raise ValueError("a scope over several rows needs a unit column")
        known = with_shared_labels(known, scope, unit)
    if mode == "encrypt":
        return with_encrypted(known, key, text, out="tokenized")
    return with_tokenized(known, text)


def text_paths(kind: T.DataType, name: str = "text", above: str = "") -> list[str]:
    """Dotted paths of the string fields of a struct that have a name, at any depth of structs."""
    out = []
    for field in kind.fields if isinstance(kind, T.StructType) else []:
        path = f"{above}`{field.name}`"
        if field.name == name and isinstance(field.dataType, T.StringType):
            out.append(path)
        out += text_paths(field.dataType, name, f"{path}.")
    return out


def tokenize_fields(df: DataFrame, column: str, name: str = "text", paths: list[str] | None = None, **options) -> DataFrame:
    """Tokenize the text fields of a struct column; its other fields stay as they are.

    ``paths`` names fields by dotted path; without it the schema is searched for
    string fields called ``name``.  ``entities`` maps each path to the entities of
    its field.  NULL fields and NULL structs stay NULL.
    """
    found = text_paths(df.schema[column].dataType, name) if paths is None else paths
    made, entities = df, []
    for path in found:
        made = tokenize(made.withColumn("_text", F.col(f"`{column}`.{path}")), "_text", **options)
        made = made.withColumn(column, F.col(f"`{column}`").withField(path, F.col("tokenized"))).withColumnRenamed("entities", f"_found{len(entities) // 2}")
        made = made.drop("_text", "tokenized")
        entities += [F.lit(path.replace("`", "")), F.col(f"_found{len(entities) // 2}")]
    kept = F.create_map(*entities) if entities else F.lit(None).cast(f"map<string,array<{ENTITY}>>")
    return made.withColumn("entities", kept).drop(*[f"_found{i}" for i in range(len(found))])


def tokenize_messages(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Sanitize, then tokenize; the sanitized text replaces the input."""
    return tokenize(df.withColumn(text, sanitize(F.col(text))), text, **options)


def token_rows(df: DataFrame, scope: list[str], entities: str = "entities") -> DataFrame:
    """Distinct (scope, token, value, label) of tokenized rows."""
    rows = exploded(df, scope, entities, "e")
    return rows.select(
        *scope, F.col("e.token").alias("token"), F.col("e.value").alias("value"), F.col("e.label").alias("label")
    ).distinct()


def encrypted_map(token_rows_df: DataFrame, key: Column) -> DataFrame:
    return token_rows_df.withColumn("ciphertext", crypto.encrypt(F.col("value"), key)).drop("value")


def run_statistics(df: DataFrame, scope: list[str], text: str = "text", entities: str = "entities") -> DataFrame:
    """Per scope and in total: units, characters, replacements and distinct values; ``is_total`` marks the total.

    The input is read and detected once: each unit becomes its values and one
    row without a value that carries its length.  Grouping by (scope, value)
    first keeps a large scope from being one task.  The total adds up the scopes.
    """
    whole = F.struct(F.lit(None).cast("string").alias("value"), F.lit(1).cast("long").alias("unit"), F.length(text).cast("long").alias("chars"))
    pieces = F.transform(
        entities,
        lambda e: F.struct(e["value"].alias("value"), F.lit(0).cast("long").alias("unit"), F.lit(0).cast("long").alias("chars")),
    )
    rows = exploded(df, scope, F.concat(F.array(whole), pieces), "p")
    values = rows.groupBy(*scope, F.col("p.value").alias("_value")).agg(
        F.sum("p.unit").alias("units"), F.sum("p.chars").alias("chars"), F.count(F.lit(1)).alias("_n"))
    found = F.col("_value").isNotNull()
    per_scope = values.groupBy(*scope).agg(
        F.sum("units").alias("units"), F.sum("chars").alias("chars"),
        F.sum(F.when(found, F.col("_n")).otherwise(F.lit(0))).alias("replacements"), F.count("_value").alias("unique_values"),
    )
    sums = [F.sum(c).alias(c) for c in ("units", "chars", "replacements", "unique_values")]
    kind = F.grouping_id()
    total = (1 << len(scope)) - 1
    return per_scope.rollup(*scope).agg(*sums, (kind == total).alias("is_total")).filter(kind.isin(0, total))


def collisions(token_rows_df: DataFrame, scope: list[str]) -> DataFrame:
    """Tokens that stand for more than one value of a scope."""
    pairs = token_rows_df.select(*scope, "token", "value").distinct()
    return (
        pairs.groupBy(*scope, "token").agg(F.count(F.lit(1)).alias("n_values"), F.min("value").alias("first_value"),
                                           F.max("value").alias("last_value"))
        .filter(F.col("n_values") > 1)
    )
