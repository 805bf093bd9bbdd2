"""Words and shingles as Spark expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything below U+0080 that is no digit and no lower-case letter separates words.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def whole(text: Column) -> Column:
    """The text; null is empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column, only_ascii: bool = False) -> Column:
    """Lower-case words of the whole text, in order; with ``only_ascii`` just A-Z are lower-cased."""
    lower = F.translate(whole(text), UPPER, UPPER.lower()) if only_ascii else F.lower(whole(text))
    return F.array_remove(F.split(lower, WORD_GAP), "")


def _runs(tokens: Column, k: int, make, kind: str) -> Column:
    starts = F.sequence(F.lit(0), F.size(tokens) - k)
    runs = F.transform(starts, lambda i: make([F.get(tokens, i + j) for j in range(k)]))
    return F.when(F.size(tokens) >= k, runs).otherwise(F.array().cast(f"array<{kind}>"))


def shingles(tokens: Column, k: int) -> Column:
    """Every run of ``k`` words, space-joined, repeats included; none if there are fewer.

    Here and below ``tokens`` must be a column of the input and not an expression over the
    text, so that the text is split once per row.
    """
    return _runs(tokens, k, lambda w: F.concat_ws(" ", *w), "string")


def shingle_hashes(tokens: Column, k: int) -> Column:
    """A 64-bit hash of every run of ``k`` words, without building the strings."""
    return _runs(tokens, k, lambda w: F.xxhash64(*w), "bigint")


def text_key(text: Column) -> Column:
    """Joins what was found in a text to every row that has this text."""
    return F.xxhash64(whole(text))


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
