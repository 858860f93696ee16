"""Seeded, order-free hashes built from md5 so that every engine agrees on them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_DIGITS = 15
HASH_SPAN = float(1 << 60)


def md5_bucket(text: Column | str, modulus: int) -> Column:
    """The md5 digest of a text, read as one 128-bit number, modulo ``modulus``."""
    digest = F.md5((F.col(text) if isinstance(text, str) else text).cast("binary"))
    shift = (1 << 32) % modulus
    out = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        out = (out * F.lit(shift) + word) % F.lit(modulus)
    return out.cast("int")


def row_hash(*parts: Column | str, seed: int = 0) -> Column:
    """A non-negative 60-bit hash of the key parts and the seed."""
    cols = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    digest = F.md5(F.concat_ws("#", *cols, F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("bigint")


def unit_hash(*parts: Column | str, seed: int = 0) -> Column:
    """``row_hash`` scaled to [0, 1)."""
    return row_hash(*parts, seed=seed) / F.lit(HASH_SPAN)
