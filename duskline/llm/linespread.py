"""Cross-site boilerplate lines, found by how many sites a line is spread over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duskline.llm.catalog import query, table
from duskline.llm.text import spare, text_key, whole
from duskline.operators.joins import grown
from duskline.sources.scratch import settle

MIN_SITES = 6
LG_K = 12
#: The sketch's relative standard error is about 0.83 / sqrt(2 ** LG_K); this many of them on
#: either side of the threshold are counted exactly.
SIGMAS = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hash(line: Column) -> Column:
    """Lines are equal up to blanks at their ends."""
    return F.xxhash64(F.trim(line))


def spread_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", site: str = "source", text: str = "text"
) -> DataFrame:
    """(h, keeper): hashes of the non-blank lines on ``min_sites`` or more distinct sites, and the
    smallest key that has them.

    One aggregation of all line occurrences gives each line its count, its smallest key and a
    HyperLogLog sketch of its sites; tasks send partial sketches, which are merged, so a line in
    a third of all documents is a row per task. The sketch decides: lines clearly above the
    threshold are taken, lines clearly below dropped. Only lines near it get an exact distinct count,
    from a second look at their occurrences. A line is its 64-bit hash here; two lines of one hash
    would count as one.
    """
    lines = docs.select(
        F.col(key).alias("k"), F.col(site).cast("string").alias("site"), F.explode_outer(_lines(whole(F.col(text)))).alias("line")
    )
    lines = lines.filter(F.trim("line") != "").select(_hash(F.col("line")).alias("h"), "site", "k")
    sketched = lines.groupBy("h").agg(
        F.count("*").alias("n"), F.min("k").alias("keeper"), F.hll_sketch_agg("site", LG_K).alias("s")
    )
    error = SIGMAS * 0.83 / 2 ** (LG_K / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    # Fewer occurrences than sites asked for: no need to look at the sketch.
    judged = sketched.filter(F.col("n") >= min_sites).select("h", "keeper", F.hll_sketch_estimate("s").alias("sites"))
    judged = settle(judged.filter(F.col("sites") >= low), "line_spread")
    near = judged.filter(F.col("sites") <= high).select("h")
    exact = (
        lines.filter(F.col("site").isNotNull()).join(near, "h", "left_semi")
        .groupBy("h").agg(F.count_distinct("site").alias("sites"))
        .filter(F.col("sites") >= min_sites).select("h")
    )
    clear = judged.filter(F.col("sites") > high)
    return clear.unionByName(judged.join(exact, "h", "left_semi")).select("h", "keeper")


def drop_spread_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    key: str = "doc_id",
    site: str = "source",
    text: str = "text",
    count: str | None = None,
) -> DataFrame:
    """``docs`` with every cross-site line removed but in the document with the smallest key.

    The text column is replaced, all other columns and all rows stay; ``count`` names a column
    for the number of removed lines, with underscores after it if the name is taken. Blank lines are never removed, and the order of the rest
    is kept. Null text stays null, empty text empty. A null site is no site; a null key is the
    smallest only if all are null. Rows that repeat the smallest key all keep the line. Empty
    tables stay empty.

    Which lines a document loses is joined to it by key and text; only documents that lose lines
    have a partner, and only their lines are taken apart.
    """
    spread = settle(spread_lines(docs, min_sites, key, site, text), "spread")
    tk, lost, own = spare(docs, "_tk"), spare(docs, "_lost"), spare(docs, "_own")
    keyed = docs.withColumn(tk, text_key(F.col(text)))
    lines = keyed.select(
        F.col(key).alias(own), tk, F.explode_outer(F.array_distinct(F.transform(_lines(whole(F.col(text))), _hash))).alias("h")
    )
    hits = lines.join(spread, "h").filter(~F.col(own).eqNullSafe(F.col("keeper")))
    hits = settle(hits.groupBy(own, tk).agg(F.collect_set("h").alias(lost)), "lost_lines")
    joined = keyed.alias("d").join(
        grown(hits).alias("x"),
        (F.col(f"d.{tk}") == F.col(f"x.{tk}")) & F.col(f"d.{key}").eqNullSafe(F.col(f"x.{own}")),
        "left",
    )
    whole_text = F.col(f"d.{text}")
    kept = F.filter(
        _lines(whole_text),
        lambda s: (F.trim(s) == "") | ~F.array_contains(F.col(f"x.{lost}"), _hash(s)),
    )
    new = F.when(F.col(f"x.{lost}").isNull(), whole_text).otherwise(F.array_join(kept, "\n"))
    gone = F.when(F.col(f"x.{lost}").isNull(), F.lit(0)).otherwise(
        F.size(_lines(whole_text)) - F.size(kept)
    )
    out = [new.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns]
    return joined.select(*out, *([gone.cast("long").alias(spare(docs, count))] if count else []))


SQL = f"""
WITH lines AS (
  SELECT rowid_, doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
spread AS (
  SELECT trim(line, ' ') AS line, min(doc_id) AS keeper FROM lines WHERE trim(line, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT l.*, s.line IS NOT NULL AND l.doc_id IS DISTINCT FROM s.keeper AS gone
  FROM lines l LEFT JOIN spread s ON trim(l.line, ' ') = s.line)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
       count(*) FILTER (WHERE gone) AS n_removed
FROM marked GROUP BY rowid_, doc_id
"""


@query("op10_line_spread", SQL)
def op10(spark, sf_dir):
    """All documents without lines that six or more sources have, and how many each lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return drop_spread_lines(docs, count="n_removed").drop("source")
