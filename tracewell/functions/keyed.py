"""Keyed hashes and pseudonyms of built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _padded(key: Column, pad: int) -> Column:
    """The key filled up to a block with zeros, each byte XOR ``pad``; four bytes at a time."""
    digits = F.rpad(F.hex(key), 2 * _BLOCK, "0")
    mask = int(f"{pad:02x}" * 4, 16)
    words = [F.lpad(F.hex(F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").bitwiseXOR(F.lit(mask).cast("long"))), 8, "0") for i in range(_BLOCK // 4)]
    return F.unhex(F.concat(*words))


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA-256 as lower-case hex; key and message are binary or text (its UTF-8). Null if either is null."""
    k = key.cast("binary")
    k = F.when(F.octet_length(k) > _BLOCK, F.unhex(F.sha2(k, 256))).otherwise(k)
    inner = F.unhex(F.sha2(F.concat(_padded(k, 0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(_padded(k, 0x5C), inner), 256)


def pseudonym(secret: Column, scope: Column, value: Column) -> Column:
    """32 hex digits for a value, equal in any case, different between scopes; null for null and empty ones."""
    return F.left(hmac_sha256(secret, F.concat(scope.cast("string"), F.lit("\x00"), F.lower(F.nullif(value, F.lit(""))))), F.lit(32))


def observation_id(secret: Column, scope: Column, message_id: Column, input_hash: Column, recipient_key: Column) -> Column:
    """One id for one message to one recipient, without its raw id."""
    key = F.coalesce(pseudonym(secret, scope, message_id), F.lit("no-message-id"))
    return F.sha2(F.concat_ws("\x00", scope, key, input_hash, F.coalesce(recipient_key, F.lit(""))).cast("binary"), 256)
