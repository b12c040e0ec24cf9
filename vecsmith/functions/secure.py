"""Key masking and AES-256-CBC as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked(key: Column) -> Column:
    """Up to 12 characters: the first 4, then stars; else the first 8, stars, and the last 4."""
    n = F.length(key)
    star = lambda k: F.repeat(F.lit("*"), F.greatest(k, F.lit(0)))
    return F.when(n <= 12, F.concat(F.left(key, F.lit(4)), star(n - 4))).otherwise(F.concat(F.left(key, F.lit(8)), star(n - 12), F.right(key, F.lit(4))))


def _key(key: str) -> Column:
    """32 bytes: padded with zeros (the digit) or cut."""
    return F.lit(key[:32].ljust(32, "0"))


def encrypted(text: Column, key: str) -> Column:
    """Base64 of a random IV and the ciphertext."""
    return F.base64(F.aes_encrypt(text, _key(key), F.lit("CBC"), F.lit("PKCS")))


def decrypted(text: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(text), _key(key), F.lit("CBC"), F.lit("PKCS")).cast("string")
