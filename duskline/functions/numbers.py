"""Numeric expressions with the null rules of the panel."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number_from_text(c: Column | str) -> Column:
    """``1,234.50`` as a double; null where no number remains."""
    text = F.col(c) if isinstance(c, str) else c
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def strict_sum(c: Column | str) -> Column:
    """Sum that is null as soon as one value is null."""
    v = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(v) == F.count(F.lit(1)), F.sum(v))


def share(a: Column, b: Column) -> Column:
    """a / b as a double, null when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _count_cells(cols: list[str], blank: int, filled: int) -> Column:
    # One expression text instead of one call into the JVM per cell: wide rows have hundreds.
    cells = (
        f"CASE WHEN coalesce(CAST({quoted(c)} AS DOUBLE), 0D) = 0D THEN {blank} ELSE {filled} END"
        for c in cols
    )
    return F.expr(" + ".join(cells) or "0")


def blank_cells(cols: list[str]) -> Column:
    """Null or zero cells per row."""
    return _count_cells(cols, 1, 0)


def filled_cells(cols: list[str]) -> Column:
    return _count_cells(cols, 0, 1)


def row_check(pred: Column) -> Column:
    """A predicate over many computed columns, kept out of constraint propagation.

    The optimizer rewrites a deterministic predicate once for every alias it mentions and
    keeps all variants, which doubles per column: a rule over 30 lag cells never finishes
    planning. Constraints hold deterministic predicates only.
    """
    return F.when(F.monotonically_increasing_id() >= 0, pred)
