"""Deterministic, engine-portable hashing.

``h32`` = first 8 hex digits of md5 as a non-negative integer. md5 is used (not
xxhash64) so the same value can be computed by an independent SQL engine.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h32(s: Column | str) -> Column:
    """Integer in [0, 2^32) from the md5 of the string form of ``s``."""
    col = F.col(s) if isinstance(s, str) else s
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("bigint")


def h60(s: Column | str) -> Column:
    """60-bit md5 prefix (15 hex digits) as a non-negative long: seeded order
    keys with negligible collision odds (ties are broken by id anyway)."""
    col = F.col(s) if isinstance(s, str) else s
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 15), 16, 10).cast("bigint")


def seeded_key(id_col: Column | str, seed: int) -> Column:
    """Hash order key for seeded, exact sampling/splitting: h32(id || ':' || seed)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return h32(F.concat(col.cast("string"), F.lit(f":{seed}")))
