"""Scalar text, file-name, key and redaction functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog as C
from .arrays import let, lines, strip


def sanitize(text: Column) -> Column:
    """Remove characters that could forge a token, and control characters, then strip."""
    return strip(F.regexp_replace(text, C.UNSAFE_INPUT_CHARS, ""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Path without its last extension (a leading dot is no extension)."""
    return F.regexp_replace(path, r"(?<=[^/.])\.[^./]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(?<=[^/.])(\.[^./]*)$", 1)


def tokenized_name(path: Column) -> Column:
    return F.concat(stem(path), F.lit("_tokenized"), extension(path))


def decrypted_name(path: Column) -> Column:
    return F.concat(F.regexp_replace(stem(path), "_tokenized$", ""), F.lit("_decrypted"), extension(path))


def record_title(file_name: Column) -> Column:
    """Record type by the first matching file-name prefix."""
    out = None
    for prefix, title in C.RECORD_TYPES.items():
        test = F.startswith(file_name, F.lit(prefix))
        out = F.when(test, F.lit(title)) if out is None else out.when(test, F.lit(title))
    return out.otherwise(F.lit(C.RECORD_TYPE_DEFAULT))


def record_keyword(text: Column) -> Column:
    """Record type by the first keyword found in the first line."""

    def pick(head: Column) -> Column:
        out = None
        for word in C.RECORD_KEYWORDS:
            test = F.contains(head, F.lit(word))
            value = F.lit(word.lower())
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(F.lit("unknown"))

    return let(F.upper(F.get(F.split(text, r"\r\n|\n|\r", 2), F.lit(0))), pick)


def first_lines(text: Column, n: int = 8) -> Column:
    return F.array_join(F.slice(lines(text), 1, n), "\n")


def session_title(message: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(message, 1, 60), F.lit("")), F.lit("New chat"))


def model_slug(name: Column, prefix: str = "model-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.replace(F.lower(name), F.lit(" "), F.lit("-")), 1, 30))


def is_filled(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def key_is_valid(key: Column) -> Column:
    return F.octet_length(key).isin(*C.KEY_BYTES)


def checked_key(key: Column) -> Column:
    """The key itself, or an error when its length is wrong."""
    return F.when(key_is_valid(key), key).otherwise(
        F.raise_error(F.lit("key must be 16, 24 or 32 bytes")).cast("binary")
    )


def key_from_hex(text: Column) -> Column:
    """Decoded key bytes, NULL for anything that is not hexadecimal."""
    return F.when(F.length(text) % 2 == 0, F.try_to_binary(text, F.lit("hex")))


def key_fingerprint(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 12)


def tokens(text: Column) -> Column:
    """Every token of a text, in order."""
    return F.regexp_extract_all(text, F.lit(C.TOKEN_REGEX), F.lit(0))


def token_label(token: Column) -> Column:
    return F.regexp_extract(token, C.TOKEN_REGEX, 1)


def segments(text: Column) -> Column:
    """Text as alternating literal and token nodes, in order, empty literals left out."""

    def build(parts: Column) -> Column:
        literal = lambda value: F.struct(
            F.lit("text").alias("kind"), value.alias("content"),
            F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("hex"),
        )
        node = lambda value: F.struct(
            F.lit("token").alias("kind"), value.alias("content"),
            token_label(value).alias("label"), F.regexp_extract(value, C.TOKEN_REGEX, 2).alias("hex"),
        )
        pairs = F.transform(
            parts["gap"],
            lambda gap, i: F.when(
                i < F.size(parts["token"]), F.array(literal(gap), node(F.get(parts["token"], i)))
            ).otherwise(F.array(literal(gap))),
        )
        return F.filter(F.flatten(pairs), lambda n: (n["kind"] == "token") | (F.length(n["content"]) > 0))

    parts = F.struct(F.split(text, C.TOKEN_REGEX, -1).alias("gap"), tokens(text).alias("token"))
    return let(parts, build)
