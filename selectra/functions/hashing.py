"""Seeded pseudo-randomness that does not depend on partitioning.

A random draw is a pure function of (seed, key), so that it is the same on any
cluster, after any retry, and in any SQL engine that has MD5.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def row_hash(seed, *cols) -> Column:
    """Hex MD5 of the seed and the key columns, joined by a bar."""
    parts = [seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))]
    parts += [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def hash_int(hexed: Column, start: int = 1, digits: int = 8) -> Column:
    """An unsigned integer out of some hex digits (8 digits = 32 bits)."""
    return F.conv(F.substring(hexed, start, digits), 16, 10).cast("bigint")


def hash_unit(hexed: Column) -> Column:
    """A uniform double in [0, 1) out of the first 32 bits."""
    return hash_int(hexed) / F.lit(4294967296.0)
