"""Repeatable random numbers from row keys.

``md5(seed|key)`` depends on nothing but the row, so a draw is the same for any
partitioning, survives recomputation after a lost executor, and can be checked with
SQL in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SLOT_BITS = 60


def digest(seed: int | str | Column, *keys: Column | str) -> Column:
    parts = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    parts += [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def slot(m: Column) -> Column:
    """First fifteen hex digits of a digest as a number below 2**60: far beyond any row count,
    so that a remainder reaches every place of a long line."""
    return F.conv(F.substring(m, 1, SLOT_BITS // 4), 16, 10).cast("long")


def seeded_bucket(k: int, seed: int | str, *keys: Column | str) -> Column:
    return (slot(digest(seed, *keys)) % k).cast("int")
