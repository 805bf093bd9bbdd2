"""Benchmark items inside documents: size-partitioned MinHash containment, verified exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duskline.llm.catalog import query, table
from duskline.llm.text import shingle_hashes, shingles, spare, text_key, words
from duskline.sources.scratch import settle

SHINGLE = 5
CONTAINMENT = 0.8


def _needed(n: Column, containment: float) -> Column:
    """The fewest of ``n`` shingles that make up ``containment`` of them."""
    return F.ceil(F.round(F.lit(containment) * n, 9))


def item_shingles(items: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(item, item_text, width, n, shingle, h): the distinct shingles of every item with a word.

    An item shorter than ``k`` words is one shingle of its whole word sequence; ``width`` is the
    number of words in a shingle and ``n`` the number of distinct ones.
    """
    cut = items.select(
        F.col(key).alias("item"), text_key(F.col(text)).alias("item_text"), words(F.col(text)).alias("w")
    )
    cut = cut.filter(F.size("w") > 0).dropDuplicates(["item", "item_text"])
    pairs = F.lit(None)
    for j in range(1, k + 1):
        at_width = F.arrays_zip(
            shingles(F.col("w"), j).alias("shingle"), shingle_hashes(F.col("w"), j).alias("h")
        )
        pairs = F.when(F.least(F.size("w"), F.lit(k)) == j, F.array_distinct(at_width)).otherwise(pairs)
    cut = cut.select("item", "item_text", F.least(F.size("w"), F.lit(k)).alias("width"), pairs.alias("p"))
    return cut.select(
        "item", "item_text", "width", F.size("p").alias("n"), F.explode("p").alias("p")
    ).select("item", "item_text", "width", "n", "p.shingle", "p.h")


def _of_widths(make, tokens: Column, widths: list[int]) -> Column:
    return F.concat(*[make(tokens, j) for j in widths])


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    k: int = SHINGLE,
    containment: float = CONTAINMENT,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(text_key, item, n_shingles, n_shared): for every text, the items of which it holds at
    least ``containment`` of the distinct ``k``-word shingles.

    Items are partitioned by their number n of distinct shingles. An item's sketch holds its
    n - ceil(containment n) + 1 smallest shingle hashes (a bottom sketch, as in MinHash): a
    matching document cannot lack all of them, however long it is, so no item is missed, where
    banded signatures would meet less often the longer the document. Documents whose shingle
    hashes meet a sketch, and that have enough shingles for the item's size, are candidates;
    they are verified by counting the shared distinct shingles themselves.

    Texts are verified once for all their copies. Null and empty texts or items match nothing;
    an item of fewer than ``k`` words is one shingle of that length; rows that repeat an item's
    key and text count once, different texts under one key each give rows; empty tables give no
    rows. Other columns are not read.
    """
    parts = settle(item_shingles(items, k, item_key, item_text), "item_shingles")
    widths = sorted(r["width"] for r in parts.select("width").distinct().collect()) or [k]  # k at most
    need = _needed(F.col("n"), containment)
    sketches = parts.groupBy("item", "item_text", "n").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    probes = settle(
        sketches.select(
            "item",
            "item_text",
            need.alias("need"),
            F.explode(F.slice("hs", F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("h"),
        ),
        "sketches",
    )
    hashed = docs.select(text_key(F.col(text)).alias("text_key"), words(F.col(text)).alias("w")).select(
        "text_key", _of_widths(shingle_hashes, F.col("w"), widths).alias("hs")
    )
    # Outer, because an inner explode puts a filter on the array's size below the column of words,
    # and the text would be split again for every element.
    met = (
        hashed.select("text_key", F.size("hs").alias("n_doc"), F.explode_outer("hs").alias("h"))
        .join(probes, "h")
        .filter(F.col("n_doc") >= F.col("need"))
        .select("text_key")
        .distinct()
    )
    met = settle(met, "candidates")
    once = (
        docs.select(F.col(text).alias("t"), text_key(F.col(text)).alias("text_key"))
        .join(met, "text_key", "left_semi")
        .dropDuplicates(["text_key"])
        .select("text_key", words(F.col("t")).alias("w"))
        .select("text_key", F.array_distinct(_of_widths(shingles, F.col("w"), widths)).alias("s"))
        .select("text_key", F.explode_outer("s").alias("shingle"))
    )
    shared = once.join(parts, "shingle").groupBy("text_key", "item", "item_text", "n").agg(
        F.count("*").alias("n_shared")
    )
    return shared.filter(F.col("n_shared") >= need).select(
        "text_key", "item", F.col("n").cast("long").alias("n_shingles"), "n_shared"
    )


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(key, item_id, n_shingles, n_shared, containment): one row per row of ``docs`` and item it holds."""
    found = settle(contained_items(docs, items, **options), "contained")
    rows = docs.select(F.col(key), text_key(F.col(options.get("text", "text"))).alias("text_key"))
    return rows.join(found, "text_key").select(
        key,
        F.col("item").alias("item_id"),
        "n_shingles",
        "n_shared",
        (F.col("n_shared") / F.col("n_shingles")).alias("containment"),
    )


def without_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns and all other rows stay."""
    found = settle(contained_items(docs, items, **options).select("text_key").distinct(), "contained")
    tk = spare(docs, "_tk")
    keyed = docs.withColumn(tk, text_key(F.col(options.get("text", "text"))))
    return keyed.join(found.withColumnRenamed("text_key", tk), tk, "left_anti").drop(tk)


_SQL_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

SQL = f"""
WITH item_words AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
item_grams AS (
  SELECT item_id, unnest(list_distinct(CASE WHEN len(w) >= {SHINGLE}
    THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' '))
    ELSE [array_to_string(w, ' ')] END)) AS g, least(len(w), {SHINGLE}) AS width
  FROM item_words WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_grams GROUP BY item_id),
widths AS (SELECT DISTINCT width FROM item_grams),
doc_words AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
doc_grams AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - width + 2),
    lambda i: array_to_string(w[i:i + width - 1], ' '))) AS g
  FROM doc_words, widths WHERE len(w) >= width),
shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM doc_grams JOIN item_grams USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (item_id)
WHERE n_shared >= ceil(round({CONTAINMENT} * n_shingles, 9))
"""


@query("op6_benchmark_decontamination", SQL)
def op6(spark, sf_dir):
    """Every document with every benchmark item that it holds."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
