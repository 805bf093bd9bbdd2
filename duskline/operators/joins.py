"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], spread: list[str], salts: int = 16, how: str = "left"
) -> DataFrame:
    """Equi-join on ``on`` with each key of ``big`` spread over ``salts`` tasks.

    ``small`` is unique on ``on`` and is repeated once per salt; ``spread`` names columns
    of ``big`` that differ within a key. Null meets null. Settle ``small``, and Spark
    broadcasts it where its size allows.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cond = null_safe(on, "_l", "_r") & (F.col("_l._salt") == F.col("_r._salt"))
    joined = big.withColumn("_salt", salt).alias("_l").join(copies.alias("_r"), cond, how)
    return joined.select(
        *[F.col(f"_l.{c}") for c in big.columns], *[F.col(f"_r.{c}") for c in small.columns if c not in on]
    )


def grown(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that Spark must not broadcast, because it grows with the entities.

    Spark goes by the size of files. Narrow columns of few values or long runs, as keys of groups
    are, may be a hundredth of their rows' size in memory, all of which a broadcast brings to the driver.
    """
    return df.hint("merge")


def null_safe(names: list[str], left: str, right: str) -> Column:
    """Equality of named columns of two aliases where null meets null."""
    cond = F.lit(True)
    for c in names:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond
