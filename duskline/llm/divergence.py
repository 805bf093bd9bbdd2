"""How far the sources of a language are from each other in their words: a quadtree over the count matrix.

The matrix of groups by terms is cut into blocks of rows and of columns, both in classes of like
weight, so that what is rare stands together and whole blocks are zero. Blocks that hold no count
do not exist as rows; the others are joined pairwise and walked quadrant by quadrant.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from duskline.llm.catalog import query, table
from duskline.llm.text import whole
from duskline.sources.scratch import settle

#: Each byte of a text: A-Z in lower case, a-z and all beyond ASCII as they are, others blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Counts that a Python worker holds before it hands them on.
HELD = 1 << 19
MIN_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
PRIOR = 5
#: Groups and terms per block on average.
ROWS, COLUMNS = 32, 512
#: Side of a leaf of the quadtree.
LEAF = 4


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and of anything beyond ASCII, A-Z in lower case, in UTF-8.

    No byte of a longer character is an ASCII one, so the bytes are cut where the characters are.
    """
    return text.translate(LETTERS).split()


def _tallies(batches):
    """Occurrences and documents of each term of a group, summed until ``HELD`` of them are held."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("docs", pa.int64())])
    groups, held = {}, 0

    def flushed():
        for (lang, source), (count, docs) in groups.items():
            columns = [[lang] * len(count), [source] * len(count), list(count), list(count.values()), [docs[t] for t in count]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types)], schema=kind)

    for batch in batches:
        lang_source = (column.to_pylist() for column in batch.columns[:2])
        for lang, source, text in zip(*lang_source, batch.column(2).cast(pa.binary()).to_pylist()):
            found = terms(text)
            count, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(count)
            count.update(found)
            docs.update(set(found))
            held += len(count)
            if held >= HELD:
                yield from flushed()
                groups, held = {}, 0
    yield from flushed()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, c, docs): occurrences of each term in each group and the documents that hold it.

    Counts are summed in the tasks before they are shuffled, so a hot group or term is a few rows per task.
    """
    rows = docs.select(*[whole(F.col(x)).alias(y) for x, y in ((lang, "lang"), (source, "source"), (text, "text"))])
    rows = rows.mapInArrow(_tallies, "lang string, source string, term string, c bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def price(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exact; null where no term is kept."""
    wide = lambda x: x.cast("decimal(28,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + PRIOR).cast("decimal(28,0)")
    below = (wide(total) + wide(kept) * PRIOR).cast("decimal(28,0)")
    return F.when(kept > 0, F.call_function("div", above, below) + 1)


def _numbered(rows: DataFrame, item: str, weight: str, per: int, block: str, place: str) -> DataFrame:
    """``rows`` (lang, ``item``, ...) with a block of about ``per`` items of like weight and a place in it.

    Blocks are dealt by hash within a class of weights, so nothing is ranked across a whole language.
    """
    classed = rows.withColumn("_class", F.floor(F.log2(F.col(weight) + 1)).cast("long"))
    sizes = classed.groupBy("lang", "_class").agg(F.ceil(F.count("*") / per).cast("long").alias("_blocks"))
    dealt = classed.join(sizes, ["lang", "_class"]).withColumn(
        block, F.col("_class") * (1 << 40) + F.pmod(F.xxhash64(item), "_blocks")
    )
    within = Window.partitionBy("lang", block)
    return dealt.withColumn(place, F.row_number().over(within.orderBy(item)) - 1).drop("_class", "_blocks")


def _side(n: int) -> int:
    """The power of two that holds ``n``, a leaf at least."""
    return max(LEAF, 1 << (n - 1).bit_length())


def _pyramid(full: np.ndarray) -> list[np.ndarray]:
    """Where counts are, per level from leaves up: a quadrant is there if one of its four is."""
    rows, columns = full.shape
    level = full.reshape(rows // LEAF, LEAF, columns // LEAF, LEAF).any(axis=(1, 3))
    out = [level]
    while level.size > 1:
        if level.shape[0] > 1:
            level = level[0::2] | level[1::2]
        if level.shape[1] > 1:
            level = level[:, 0::2] | level[:, 1::2]
        out.append(level)
    return out


def _dense(zero: np.ndarray, width: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prices of a block padded to whole quadrants, and where they come from a count. Padding is 0."""
    shape = _side(len(zero)), _side(width)
    prices, full = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=bool)
    prices[: len(zero), :width] = zero[:, None]
    r, c, p = cells
    prices[r, c], full[r, c] = p, True
    return prices, full


def distances(zero_a: np.ndarray, cells_a: np.ndarray, zero_b: np.ndarray, cells_b: np.ndarray, width: int) -> np.ndarray:
    """Sum over ``width`` terms of |price in a - price in b| for each group of block a and of block b.

    ``zero_*`` has each group's price of a term that it lacks, ``cells_*`` rows, columns and prices of
    the others. Both trees are walked together from the root: a quadrant that is zero in both is
    width times the difference of the zero prices; only others are entered, down to leaves.
    """
    a, there_a = _dense(zero_a, width, cells_a)
    b, there_b = _dense(zero_b, width, cells_b)
    tree_a, tree_b = _pyramid(there_a), _pyramid(there_b)
    top = max(len(tree_a), len(tree_b)) - 1
    blocks = lambda m: m.reshape(m.shape[0] // LEAF, LEAF, m.shape[1] // LEAF, LEAF).swapaxes(1, 2)
    leaves_a, leaves_b = blocks(a), blocks(b)
    empty = np.zeros((len(zero_a), len(zero_b)), dtype=np.int64)
    found = np.zeros((len(leaves_a), len(leaves_b), LEAF, LEAF), dtype=np.int64)
    i = j = k = np.zeros(1, dtype=np.int64)
    for level in range(top, -1, -1):
        side = LEAF << level
        at_a, at_b = tree_a[min(level, len(tree_a) - 1)], tree_b[min(level, len(tree_b) - 1)]
        entered = at_a[i, k] | at_b[j, k]
        widths = np.clip(width - k[~entered] * side, 0, side)
        skipped = np.zeros((-(-len(zero_a) // side), -(-len(zero_b) // side)), dtype=np.int64)
        np.add.at(skipped, (i[~entered], j[~entered]), widths)
        empty += skipped.repeat(side, 0)[: len(zero_a)].repeat(side, 1)[:, : len(zero_b)]
        i, j, k = i[entered], j[entered], k[entered]
        if level:
            half = side // 2
            i, j, k = (
                np.concatenate(x)
                for x in zip(*((2 * i + p, 2 * j + q, 2 * k + r) for p in (0, 1) for q in (0, 1) for r in (0, 1)))
            )
            inside = (i * half < len(zero_a)) & (j * half < len(zero_b)) & (k * half < width)
            i, j, k = i[inside], j[inside], k[inside]
    for at in range(0, len(i), 4096):
        x, y, z = i[at : at + 4096], j[at : at + 4096], k[at : at + 4096]
        apart = np.abs(leaves_a[x, z][:, :, None, :] - leaves_b[y, z][:, None, :, :]).sum(axis=3)
        np.add.at(found, (x, y), apart)
    whole_found = found.swapaxes(1, 2).reshape(a.shape[0], b.shape[0])[: len(zero_a), : len(zero_b)]
    return whole_found + empty * np.abs(zero_a[:, None] - zero_b[None, :])


_PAIR = [("lang", pa.string()), ("lo", pa.int64()), ("i", pa.int32()), ("hi", pa.int64()), ("j", pa.int32()), ("value", pa.int64())]


def _cells(block: pa.ListScalar) -> np.ndarray:
    """Rows, columns and prices of a block; none for one that does not exist."""
    if not block.is_valid:
        return np.zeros((3, 0), dtype=np.int64)
    return np.array([block.values.field(c).to_numpy().astype(np.int64) for c in ("r", "k", "p")])


def _walk(batches):
    """Each pair of blocks of one stripe: what it adds to the distance of its groups, over all-zero."""
    kind = pa.schema(_PAIR)
    for batch in batches:
        for n in range(batch.num_rows):
            (unit,) = batch.select(["lang", "lo", "hi", "width", "zero_lo", "zero_hi"]).slice(n, 1).to_pylist()
            cells = [_cells(batch.column(side)[n]) for side in ("cells_lo", "cells_hi")]
            lo, hi = (np.array(unit[side], dtype=np.int64) for side in ("zero_lo", "zero_hi"))
            if unit["lo"] == unit["hi"]:
                cells[1] = cells[0]
            more = distances(lo, cells[0], hi, cells[1], unit["width"]) - unit["width"] * np.abs(lo[:, None] - hi[None, :])
            i, j = np.indices(more.shape).reshape(2, -1)
            if unit["lo"] == unit["hi"]:
                i, j = i[i < j], j[i < j]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([unit["lang"]] * len(i), pa.string()), pa.array(np.full(len(i), unit["lo"])),
                    pa.array(i.astype(np.int32)), pa.array(np.full(len(i), unit["hi"])), pa.array(j.astype(np.int32)),
                    pa.array(more[i, j]),
                ],
                schema=kind,
            )


def _group_pairs(matrix: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of groups of a language."""
    rows = settle(_numbered(groups, "source", "n", ROWS, "block", "r"), "divergence_rows")
    columns = _numbered(kept, "term", "docs", COLUMNS, "stripe", "k")
    columns = columns.withColumn("width", F.count("*").over(Window.partitionBy("lang", "stripe")).cast("long"))
    zeros = rows.groupBy("lang", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "zero"))), lambda x: x["zero"]).alias("zero"),
        F.first("v").alias("v"),
    )
    zeros = settle(zeros, "divergence_zeros")
    cells = matrix.join(columns.select("lang", "term", "stripe", "k", "width"), ["lang", "term"])
    cells = cells.join(rows.select("lang", "source", "block", "r"), ["lang", "source"])
    blocks = cells.groupBy("lang", "stripe", "block", "width").agg(F.collect_list(F.struct("r", "k", "p")).alias("cells"))
    sides = blocks.join(zeros.select("lang", F.col("block").alias("other")), "lang")
    low = F.col("block") <= F.col("other")
    units = sides.groupBy(
        "lang", "stripe", "width", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    ).agg(
        F.first(F.when(low, F.col("cells")), ignorenulls=True).alias("cells_lo"),
        F.first(F.when(~low, F.col("cells")), ignorenulls=True).alias("cells_hi"),
    )
    end = lambda s: zeros.select("lang", F.col("block").alias(s), F.col("zero").alias(f"zero_{s}"))
    units = units.join(end("lo"), ["lang", "lo"]).join(end("hi"), ["lang", "hi"])
    found = units.mapInArrow(_walk, "lang string, lo bigint, i int, hi bigint, j int, value bigint")
    # As if every quadrant were zero; what the walk finds is added.
    both = end("lo").join(end("hi"), "lang").filter("lo <= hi").join(zeros.select("lang", F.col("block").alias("lo"), "v"), ["lang", "lo"])
    both = both.select("lang", "lo", "hi", "v", F.posexplode("zero_lo").alias("i", "a"), "zero_hi")
    both = both.select("lang", "lo", "hi", "v", "i", "a", F.posexplode("zero_hi").alias("j", "b"))
    both = both.filter("lo < hi or i < j").select(
        "lang", "lo", "i", "hi", "j", F.coalesce(F.col("v") * F.abs(F.col("a") - F.col("b")), F.lit(0)).alias("value")
    )
    apart = both.unionByName(found).groupBy("lang", "lo", "i", "hi", "j").agg(F.sum("value").alias("value"))
    named = lambda b, r, s: rows.select("lang", F.col("block").alias(b), F.col("r").alias(r), F.col("source").alias(s))
    apart = apart.join(named("lo", "i", "x"), ["lang", "lo", "i"]).join(named("hi", "j", "y"), ["lang", "hi", "j"])
    ways = F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))
    return apart.select("lang", "value", F.inline(ways)).select("lang", "source", "item", "value")


def audit(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how each (lang, source) group differs in its words.

    A language keeps the terms that at least ``min_docs`` of its documents hold. A group's price of a
    term is ``price`` of its count among the group's counts of kept terms, all in integers. Part
    ``pair`` has every other source of the language by the summed difference of prices; part ``term``
    the ``top`` terms that the group has and prices above the language as a whole.

    Null text, lang and source are empty. Empty texts, and groups without any term, have pairs all
    the same, with the prices of counts of zero, or 0 where the language keeps no term. Equal
    values are ranked by the item's bytes. Repeated rows count each; an empty table gives no rows;
    other columns are not read. Very long texts are split whole.

    The pairs of a language's sources are the result, so it grows with the square of their number,
    but not with the documents. Tasks hold pairs of blocks of some ``ROWS`` groups and ``COLUMNS`` terms.
    """
    counts = settle(term_counts(docs, lang, source, text), "divergence_counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("c").alias("whole"))
    kept = settle(kept.filter(F.col("docs") >= min_docs), "divergence_kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("all"))
    matrix = counts.select("lang", "source", "term", "c").join(kept.select("lang", "term", "whole"), ["lang", "term"])
    sums = matrix.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = docs.select(whole(F.col(lang)).alias("lang"), whole(F.col(source)).alias("source")).distinct()
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "all")])
    groups = groups.withColumn("zero", F.coalesce(price(F.lit(0), F.col("n"), F.col("v")), F.lit(0)))
    groups = settle(groups, "divergence_groups")
    matrix = matrix.join(groups.select("lang", "source", "n", "v", "all"), ["lang", "source"])
    matrix = matrix.select(
        "lang", "source", "term", price(F.col("c"), F.col("n"), F.col("v")).alias("p"),
        price(F.col("whole"), F.col("all"), F.col("v")).alias("q"),
    )
    matrix = settle(matrix, "divergence_matrix")
    pairs = _group_pairs(matrix.drop("q"), groups, kept)
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(ordered))
    own = matrix.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).filter("value > 0")
    out = ranked(pairs).withColumn("part", F.lit("pair")).unionByName(
        ranked(own).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    )
    return out.select("lang", "source", "part", "item", "value", "rank")


OP12_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= 30),
counts AS (
  SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(t) AS term FROM docs)
  JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(n, 0)::HUGEINT AS n, coalesce(v, 0)::HUGEINT AS v FROM groups
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)),
p AS (
  SELECT g.lang, g.source, term, coalesce(c, 0) AS c, 1 + 1000000000 * (coalesce(c, 0) + 5)::HUGEINT // (n + 5 * v) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + 1000000000 * (sum(c) + 5)::HUGEINT // (any_value(n) + 5 * any_value(v)) AS q
  FROM counts JOIN v USING (lang) JOIN (SELECT lang, sum(c)::HUGEINT AS n FROM counts GROUP BY lang) USING (lang)
  GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(d.f), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) d
  ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  GROUP BY ALL),
own AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query("op12_source_divergence", OP12_SQL)
def op12(spark, sf_dir):
    """The sources of each language in documents, against each other and against all of it."""
    return audit(table(spark, sf_dir, "documents"))
