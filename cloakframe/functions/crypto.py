"""Reversible encryption of values and keys with built-in AES-GCM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encrypt(value: Column, key: Column) -> Column:
    """Ciphertext (nonce, data, tag) of a string or binary value."""
    return F.aes_encrypt(value.cast("binary"), key, F.lit("GCM"))


def sealed(value: Column, key: Column) -> Column:
    """Ciphertext as base64 on one line (``base64`` alone breaks lines after 76 letters)."""
    return F.replace(F.base64(encrypt(value, key)), F.lit("\r\n"), F.lit(""))


def decrypt(ciphertext: Column, key: Column) -> Column:
    """Plain text, or NULL when key or ciphertext do not fit."""
    usable = F.octet_length(key).isin(16, 24, 32)
    return F.when(usable, F.try_aes_decrypt(ciphertext, key, F.lit("GCM")).cast("string"))


def master_key(secret: Column) -> Column:
    """A master secret as 32 bytes: cut, or padded with zero bytes."""
    raw = F.encode(secret, "UTF-8")
    return F.rpad(F.substring(raw, 1, 32), 32, F.unhex(F.lit("00")))


def wrap_key(key: Column, secret: Column) -> Column:
    return F.aes_encrypt(key, master_key(secret), F.lit("GCM"))


def unwrap_key(blob: Column, secret: Column) -> Column:
    return F.try_aes_decrypt(blob, master_key(secret), F.lit("GCM"))
