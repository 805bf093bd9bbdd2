"""Whole-entity exclusions and key filters.

All of them aggregate to keys first, which combines on the map side, and then use a
semi or anti join. ``NOT IN`` is avoided: one null key would empty the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from duskline.functions.numbers import strict_sum
from duskline.operators.joins import grown
from duskline.operators.projection import all_null, annual_rows

ENTITY_YEAR = ["id", "year"]


def distinct_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(key).distinct()


def keep_ids(df: DataFrame, ids: DataFrame, on: str | list[str] = "id") -> DataFrame:
    return df.join(ids, on, "left_semi")


def minus_ids(df: DataFrame, ids: DataFrame, on: str | list[str] = "id") -> DataFrame:
    return df.join(ids, on, "left_anti")


def id_difference(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).subtract(b.select(key))


def exempt_ids(df: DataFrame, event: Column) -> DataFrame:
    """Entities with an event and the last year of one.

    Entity-years up to ``exempt_until`` are spared by the exclusions: whoever has the
    event later must keep its earlier history.
    """
    return df.filter(event).groupBy("id").agg(F.max("year").alias("exempt_until"))


def _not_exempt(keys: DataFrame, exempt: DataFrame) -> DataFrame:
    spared = exempt.select(F.col("id").alias("_id"), F.col("exempt_until").alias("_until"))
    covered = (F.col("id") == F.col("_id")) & (F.col("year") <= F.col("_until"))
    return keys.join(spared, covered, "left_anti")


def any_keys(df: DataFrame, cond: Column, keys: list[str] = ENTITY_YEAR) -> DataFrame:
    return df.filter(cond).select(*keys).distinct()


def exclude_any(df: DataFrame, cond: Column, keys: list[str] = ENTITY_YEAR) -> DataFrame:
    """Remove every entity-year with at least one row where ``cond`` holds."""
    return minus_ids(df, any_keys(df, cond, keys), keys)


def young_keys(df: DataFrame, flag: str, periods: int = 12) -> DataFrame:
    """Entity-years that existed in fewer than ``periods`` periods.

    A single missing flag makes the sum unknown, and unknown is not young.
    """
    lived = df.groupBy(*ENTITY_YEAR).agg(strict_sum(flag).alias("_lived"))
    return lived.filter(F.col("_lived") < periods).select(*ENTITY_YEAR)


def exclude_young(
    df: DataFrame, flag: str, periods: int = 12, exempt: DataFrame | None = None
) -> DataFrame:
    keys = young_keys(df, flag, periods)
    if exempt is not None:
        keys = _not_exempt(keys, exempt)
    return minus_ids(df, keys, ENTITY_YEAR)


def no_annual_keys(df: DataFrame, cols: list[str], month: int = 12) -> DataFrame:
    """Entity-years whose statement row has the whole span empty; no such row, no key."""
    return annual_rows(df, month=month).filter(all_null(cols)).select(*ENTITY_YEAR).distinct()


def exclude_no_annual(
    df: DataFrame, cols: list[str], exempt: DataFrame | None = None, month: int = 12
) -> DataFrame:
    keys = no_annual_keys(df, cols, month)
    if exempt is not None:
        keys = _not_exempt(keys, exempt)
    return minus_ids(df, keys, ENTITY_YEAR)


def exclusion_facts(
    df: DataFrame, event: Column, unclear: Column, flag: str, annual_cols: list[str], month: int = 12
) -> DataFrame:
    """Everything the three exclusions ask, per entity-year, in one aggregation."""
    statement_missing = (F.month("period") == month) & all_null(annual_cols)
    facts = df.groupBy(*ENTITY_YEAR).agg(
        F.bool_or(F.coalesce(unclear, F.lit(False))).alias("unclear"),
        strict_sum(flag).alias("lived"),
        F.bool_or(statement_missing).alias("no_annual"),
        F.max(F.when(event, F.col("year"))).alias("_event_year"),
    )
    # One row per year of an entity, so this window stays small for every entity.
    until = F.max("_event_year").over(Window.partitionBy("id"))
    return facts.withColumn("exempt", F.coalesce(F.col("year") <= until, F.lit(False))).drop(
        "_event_year"
    )


def clean_rows(
    df: DataFrame,
    event: Column,
    unclear: Column,
    flag: str,
    annual_cols: list[str],
    periods: int = 12,
) -> DataFrame:
    """The three exclusions together.

    Each removes whole entity-years, so none changes what another sees of the years that
    remain: one pass for the facts and one anti join give what the three steps give in
    order, with exemptions known before any row is removed.
    """
    f = exclusion_facts(df, event, unclear, flag, annual_cols)
    young = F.coalesce(F.col("lived") < periods, F.lit(False))
    drop = F.col("unclear") | ((young | F.col("no_annual")) & ~F.col("exempt"))
    return minus_ids(df, f.filter(drop).select(*ENTITY_YEAR), ENTITY_YEAR)


def healthy_pool(ids: DataFrame, events: DataFrame, scope: str = "ever") -> DataFrame:
    """Entities that may serve as controls.

    ``ids`` has ``id`` and, for the narrower scopes, the ``event`` month it would stand
    for. ``ever`` removes all event entities, ``year`` those with an event in the same
    year, ``month`` those with an event in the same calendar month of any year.
    """
    if scope == "ever":
        return minus_ids(ids, grown(events.select("id")))
    part = {"year": F.year, "month": F.month}[scope]
    marked = ids.withColumn("_part", part("event"))
    taken = events.select("id", part("event").alias("_part")).distinct()
    return minus_ids(marked, taken, ["id", "_part"]).drop("_part")


def first_claim(df: DataFrame, event: Column) -> DataFrame:
    """Each event entity once, claimed by its latest event year."""
    return df.filter(event).groupBy("id").agg(F.max("year").alias("year"))
