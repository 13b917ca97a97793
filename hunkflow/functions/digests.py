"""Keyed digests and hashed features, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64  # bytes of a SHA-256 block


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 in lowercase hexadecimal, by its definition: two digests,
    each of a padded key and what follows. Keys are at most 64 bytes long."""
    if len(key) > BLOCK:
        raise ValueError("keys of more than 64 bytes are digested first")
    inner, outer = (bytes(b ^ pad for b in key.ljust(BLOCK, b"\0")) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def hashed_words(text: Column, size: int) -> Column:
    """A stand-in embedding that needs no model: how many words of the text fall
    into each of ``size`` buckets of their MD5."""
    words = F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")
    bucket = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % size
    found = F.transform(words, lambda w: bucket(w).cast("int"))
    # bound to one name, so that a word is hashed once and not once per bucket
    count = lambda b: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(b, lambda x: x == k)))
    return F.get(F.transform(F.array(found), count), F.lit(0))
