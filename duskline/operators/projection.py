"""Column choice, repair and derivation. Columns are always addressed by name."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from duskline.functions.numbers import blank_cells, number_from_text, row_check
from duskline.operators.joins import salted_join
from duskline.sources.scratch import settle

# Fixed value: national currency units per euro before the changeover year.
EURO_RATE = 3.45
CHANGEOVER_YEAR = 2015
# Fixed value: score given where the ratios say nothing.
NEUTRAL_SCORE = 2.75


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the named columns; names that are absent are ignored."""
    return df.drop(*names)


def span(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of all columns from ``first`` to ``last``, both included."""
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def select_span(df: DataFrame, first: str, last: str, keep: list[str] = ()) -> DataFrame:
    return df.select(*keep, *[c for c in span(df, first, last) if c not in keep])


def select_matching(df: DataFrame, pattern: str, keep: list[str] = ()) -> DataFrame:
    """Columns whose name contains the pattern, in any letter case."""
    hit = re.compile(pattern, re.IGNORECASE)
    return df.select(*[c for c in df.columns if c in keep or hit.search(c)])


def annual_rows(df: DataFrame, period: str = "period", month: int = 12) -> DataFrame:
    """The row of each year that carries the annual statement."""
    return df.filter(F.month(period) == month)


def fill_column(df: DataFrame, c: str, value) -> DataFrame:
    return df.withColumn(c, F.coalesce(F.col(c), F.lit(value)))


def fill_all(df: DataFrame, value: int = 0) -> DataFrame:
    """Null becomes ``value`` in every numeric and text column."""
    return df.fillna(value).fillna(str(value))


def parse_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: number_from_text(c) for c in cols})


def convert_currency(
    df: DataFrame,
    cols: list[str],
    year: Column | str = "year",
    rate: float = EURO_RATE,
    before: int = CHANGEOVER_YEAR,
) -> DataFrame:
    """Divide money columns by ``rate`` in the years before the changeover."""
    y = F.col(year) if isinstance(year, str) else year
    return df.withColumns({c: F.when(y < before, F.col(c) / rate).otherwise(F.col(c)) for c in cols})


def null_profile(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per column (and group): rows and nulls, counted in a single pass."""
    cols = [c for c in df.columns if c not in by]
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(cols)],
    )
    entry = [
        F.struct(F.lit(c).alias("column"), F.col(f"_null_{i}").alias("nulls"))
        for i, c in enumerate(cols)
    ]
    return counts.select(
        *by, F.col("_rows").alias("rows"), F.inline(F.array(*entry)).alias("column", "nulls")
    )


def sparse_columns(df: DataFrame, limit: float = 0.98) -> list[str]:
    """Columns with at least ``limit`` of their rows null, decided once over all years.

    The driver receives one row per column.
    """
    found = null_profile(df).filter(F.col("nulls") >= F.col("rows") * F.lit(limit))
    return [r["column"] for r in found.select("column").collect()]


def drop_sparse(df: DataFrame, limit: float = 0.98, keep: list[str] = ()) -> DataFrame:
    return df.drop(*[c for c in sparse_columns(df, limit) if c not in keep])


def impute_from(df: DataFrame, target: str, source: str, when: Column) -> DataFrame:
    """Where ``target`` is missing and ``when`` holds, take ``source``."""
    return df.withColumn(
        target, F.when(F.col(target).isNull() & when, F.col(source)).otherwise(F.col(target))
    )


def indicators(df: DataFrame, c: str, values: list[str]) -> DataFrame:
    """0/1 column ``<c>_<value>`` for each listed value."""
    flag = {f"{c}_{v}": F.when(F.col(c) == v, 1).otherwise(0) for v in values}
    return df.withColumns(flag)


def map_category(
    df: DataFrame,
    c: str,
    ranks: DataFrame,
    value: str = "category",
    rank: str = "rank",
    salts: int = 32,
) -> DataFrame:
    """Replace a category by the text of its rank; a value without a rank stays as it is.

    One category may hold most rows, so the rows are never shuffled by category alone:
    the settled lookup is copied over a salt that spreads each category over ``salts``
    tasks, and broadcast where Spark sees that it is small.
    """
    dim = settle(
        ranks.filter(F.col(value).isNotNull()).select(
            F.col(value).alias(c), F.col(rank).cast("string").alias("_rank")
        ),
        "ranks",
    )
    joined = salted_join(df, dim, [c], df.columns, salts)
    mapped = F.coalesce(F.col("_rank"), F.col(c).cast("string")).alias(c)
    return joined.select(*[mapped if x == c else F.col(x) for x in df.columns])


def distinct_values(df: DataFrame, c: str) -> list:
    """Sorted distinct values for naming columns: ranks, of which ``risk_rank`` gives at most
    one more than its parts."""
    return sorted(r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().collect())


def rank_dummies(df: DataFrame, c: str, ranks: list) -> DataFrame:
    """0/1 column ``<c>_R<rank>`` for each rank; the list is given so that all years agree."""
    return df.withColumns(
        {f"{c}_R{r}": F.when(F.col(c) == str(r), 1).otherwise(0) for r in ranks}
    )


def ratio_score(
    terms: list[tuple[float, Column | str, Column | str]], neutral: float = NEUTRAL_SCORE
) -> Column:
    """Weighted sum of ratios; undefined or exactly zero becomes ``neutral``."""

    def part(weight, a, b):
        a = F.col(a) if isinstance(a, str) else a
        b = F.col(b) if isinstance(b, str) else b
        return F.lit(weight) * F.try_divide(a.cast("double"), b.cast("double"))

    total = reduce(lambda x, y: x + y, [part(*t) for t in terms])
    return F.when(total.isNull() | F.isnan(total) | (total == 0), F.lit(neutral)).otherwise(total)


def drop_empty_rows(df: DataFrame, cols: list[str], max_empty: int) -> DataFrame:
    """Drop rows with more than ``max_empty`` null-or-zero cells among ``cols``."""
    return df.filter(row_check(blank_cells(cols) <= max_empty))


def all_null(cols: list[str]) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in cols]).isNull()


def complete_cases(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows without a null; each column's rule reaches the scan if the column comes from it."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols or df.columns]))


def label(c: str, positive=1) -> Column:
    """0/1 label as an integer."""
    return F.coalesce((F.col(c) == F.lit(positive)).cast("int"), F.lit(0))
