"""A Merkle manifest of a table: hash trees in blocks of van Emde Boas layout, paths and their check.

Leaves are placed in order, cut into aligned blocks of ``2 ** HEIGHT`` and hashed block by block; the
roots of the blocks are the leaves of the next level. A block is one row whose nodes lie in van
Emde Boas order: the tree is split at half its height, the upper subtree is stored first and
then each lower one, and so on within them, so that any path through a block stays in few
stretches of it, whatever the size of a page. The same addresses serve building and reading paths.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from duskline.llm.catalog import query, table
from duskline.sources.scratch import settle

HEIGHT = 10
DIGEST = 32
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value as text."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def digest(values: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the values, each encoded, in this order."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


@functools.cache
def addresses(levels: int) -> list[np.ndarray]:
    """For each depth of a tree of ``levels`` levels, the place of each of its nodes from left to right."""
    if levels == 1:
        return [np.zeros(1, dtype=np.int64)]
    upper = levels // 2
    head, tail = addresses(upper), addresses(levels - upper)
    starts = (1 << upper) - 1 + ((1 << (levels - upper)) - 1) * np.arange(1 << upper)
    return head + [(starts[:, None] + within[None, :]).ravel() for within in tail]


def height_of(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    return (n - 1).bit_length()


def build(leaves: list[bytes], height: int) -> bytes:
    """The nodes of the tree over at most ``2 ** height`` leaves, in van Emde Boas order.

    Two neighbours become the hash of their hex digests, a last single one the hash of its own. Places
    of nodes that do not exist hold zeros.
    """
    places = addresses(height + 1)
    out = bytearray(DIGEST * ((1 << (height + 1)) - 1))
    row = leaves
    for depth in range(height, -1, -1):
        for node, at in zip(row, places[depth].tolist()):
            out[at * DIGEST : at * DIGEST + DIGEST] = node
        texts = [node.hex() for node in row]
        row = [hashlib.sha256("".join(texts[i : i + 2]).encode()).digest() for i in range(0, len(texts), 2)]
    return bytes(out)


def path(nodes: bytes, height: int, n: int, i: int) -> tuple[str, str]:
    """Leaf ``i`` of ``n``: the side of each sibling on the way to the block's root, and their digests in hex.

    Sides are ``L``, ``R`` and, where a node has no sibling, ``-``.
    """
    places = addresses(height + 1)
    sides, siblings = [], []
    for depth in range(height, 0, -1):
        other = i ^ 1
        if other < n:
            at = int(places[depth][other]) * DIGEST
            siblings.append(nodes[at : at + DIGEST].hex())
            sides.append("L" if other < i else "R")
        else:
            sides.append("-")
        i, n = i >> 1, (n + 1) >> 1
    return "".join(sides), "".join(siblings)


def fold(leaf: str, sides: str, siblings: str) -> str:
    """The root that a leaf and its path give."""
    at = 0
    for side in sides:
        if side != "-":
            sibling, at = siblings[at : at + 2 * DIGEST], at + 2 * DIGEST
            leaf = sibling + leaf if side == "L" else leaf + sibling
        leaf = hashlib.sha256(leaf.encode()).hexdigest()
    return leaf


def _mapped(rows: DataFrame, fn: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn`` over each row, within the tasks that hold them; a few rows of bounded size at a time."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    kind = pa.schema([(c.strip().split(" ")[0], kinds[c.strip().split(" ")[1]]) for c in schema.split(",")])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                found = [x for row in batch.slice(i, 16).to_pylist() for x in fn(row)]
                columns = zip(*found) if found else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types)], schema=kind)

    return rows.mapInArrow(run, schema)


def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (part, key, leaf, ...) with ``i``, the place within the part by key and leaf, and the part's ``n``.

    One sort by range over the whole table, so that a part with most rows is spread like any other;
    places follow from the counts of the sorted pieces. It is written, so that they stay.
    """
    order = [F.col("part"), F.col("key").asc_nulls_first(), F.col("leaf")]
    spread = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settle(spread.withColumn("at", F.monotonically_increasing_id()), "merkle_leaves")
    rows = rows.withColumn("piece", F.shiftright("at", 33))
    pieces = rows.groupBy("part", "piece").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    before = Window.partitionBy("part").orderBy("piece")
    pieces = pieces.select(
        "part", "piece", "first",
        (F.sum("c").over(before) - F.col("c")).alias("ahead"),
        F.sum("c").over(Window.partitionBy("part")).alias("n"),
    )
    return rows.join(pieces, ["part", "piece"]).withColumn("i", F.col("ahead") + F.col("at") - F.col("first")).drop(
        "piece", "first", "ahead", "at"
    )


_BLOCK = "part string, block bigint, n bigint, height int, size int, root string, nodes binary"


def _blocks(rows: DataFrame, height: int) -> DataFrame:
    """Rows (part, i, n, leaf) as blocks, one row each, of at most ``2 ** height`` leaves."""
    rows = rows.groupBy("part", F.shiftright("i", height).alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "leaf"))).alias("x")
    )

    def one(row):
        leaves = [bytes.fromhex(x["leaf"]) for x in row["x"]]
        levels = min(height, height_of(row["n"]))
        nodes = build(leaves, levels)
        yield row["part"], row["block"], row["n"], levels, len(leaves), nodes[:DIGEST].hex(), nodes

    return _mapped(rows, one, _BLOCK)


def _forest(rows: DataFrame, height: int) -> list[DataFrame]:
    """The blocks of all levels over placed rows; in the last one each part has one block."""
    levels = []
    while True:
        blocks = settle(_blocks(rows, height), "merkle_blocks")
        levels.append(blocks)
        most = blocks.agg(F.max("block")).first()[0]
        if not most:
            return levels
        up = F.expr(f"(n + {(1 << height) - 1}) div {1 << height}")
        # A part that is done has one block, which goes up unchanged: a tree of height 0.
        rows = blocks.select("part", F.col("block").alias("i"), up.alias("n"), F.col("root").alias("leaf"))


def _descend(levels: list[DataFrame], start: DataFrame, height: int) -> DataFrame:
    """(part, block, sides, siblings, ...) below ``levels``: the path of each of their leaves to the top.

    ``start`` has one row per part, the path of its own root and any other text columns to hand
    down. The leaves of a level are the blocks of the one below it.
    """
    extra = [c for c in start.columns if c not in ("part", "sides", "siblings")]
    way = start.withColumn("block", F.lit(0).cast("long"))

    def one(row):
        for i in range(row["size"]):
            sides, siblings = path(row["nodes"], row["height"], row["size"], i)
            yield (
                row["part"], (row["block"] << height) + i, sides + row["sides"], siblings + row["siblings"],
                *[row[c] for c in extra],
            )

    kind = "part string, block bigint, sides string, siblings string" + "".join(f", {c} string" for c in extra)
    for blocks in reversed(levels):
        way = _mapped(blocks.select("part", "block", "height", "size", "nodes").join(way, ["part", "block"]), one, kind)
    return way


@dataclass(frozen=True)
class Manifest:
    """Placed leaves and the blocks of the parts' trees by level; the same of the tree over the parts."""

    leaves: DataFrame
    levels: list[DataFrame]
    parts: DataFrame
    top: list[DataFrame]
    height: int

    def root(self) -> DataFrame:
        """One row with ``root``; none for an empty table."""
        return self.top[-1].select("root")

    def blocks(self) -> DataFrame:
        """The manifest to keep: every block, by level; the tree over the parts has levels -1 and below."""
        kept = [b.withColumn("level", F.lit(k)) for k, b in enumerate(self.levels)]
        kept += [b.withColumn("level", F.lit(-1 - k)) for k, b in enumerate(self.top)]
        return functools.reduce(DataFrame.unionByName, kept)


def part_name(part: Column) -> Column:
    """Null before any name, names in the order of their bytes."""
    return F.coalesce(F.concat(F.lit("="), part.cast("string")), F.lit("-"))


def manifest(leaves: DataFrame, height: int = HEIGHT) -> Manifest:
    """The trees over ``leaves`` (part, key, leaf, ...): one per part by key, and one over the parts' roots.

    ``part`` is a non-null string, see ``part_name``; ``key`` an integer. Null keys come first; equal
    keys follow their digests, so repeated rows are leaves of their own and the result is the
    same for any order of the input. No leaves give no blocks. Rows are moved by one sort by range
    and one grouping into blocks of ``2 ** height`` leaves, digests and keys only, so a part with most
    rows is many blocks; every level has that many times fewer rows. Each level is written.
    """
    placed = _placed(leaves)
    levels = _forest(placed.select("part", "i", "n", "leaf"), height)
    parts = _placed(levels[-1].select(F.lit("").alias("part"), F.col("part").alias("key"), F.col("root").alias("leaf")))
    return Manifest(placed, levels, parts, _forest(parts.select("part", "i", "n", "leaf"), height), height)


def checked(made: Manifest, now: str) -> DataFrame:
    """One row per leaf: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    The proof is the leaf's siblings on the way to its part's root and on to the root, in hex;
    ``folded_root`` is what they give with the digest in column ``now``, or the leaf where that is null.
    """
    height = made.height
    start = made.top[-1].select("part", F.lit("").alias("sides"), F.lit("").alias("siblings"), "root")
    tops = _descend(made.top, start, height).select("part", F.col("block").alias("i"), "sides", "siblings", "root")
    tops = tops.join(made.parts, ["part", "i"]).select(
        F.col("key").alias("part"), "sides", "siblings", F.col("leaf").alias("subroot"), "root"
    )
    way = _descend(made.levels[1:], tops, height)
    rows = made.leaves.groupBy("part", F.shiftright("i", height).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("i", "key", F.col(now).alias("now")))).alias("x")
    )
    low = made.levels[0].select("part", "block", "height", "size", "nodes").join(rows, ["part", "block"])

    def one(row):
        above = {}
        bottom = addresses(row["height"] + 1)[row["height"]].tolist()
        for i, x in enumerate(row["x"]):
            sides, siblings = path(row["nodes"], row["height"], row["size"], i)
            leaf = row["nodes"][bottom[i] * DIGEST : bottom[i] * DIGEST + DIGEST].hex()
            block_root = fold(x["now"] or leaf, sides, siblings)
            if block_root not in above:
                above[block_root] = fold(block_root, row["sides"], row["siblings"])
            folded = above[block_root]
            proof = hashlib.sha256((siblings + row["siblings"]).encode()).hexdigest()
            yield x["key"], leaf, row["subroot"], row["root"], proof, folded, folded == row["root"]

    return _mapped(
        low.join(way, ["part", "block"]), one,
        "key bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )


def tampered_check(
    docs: DataFrame, key: str = "doc_id", part: str = "lang", count: str = "n_chars", every: int = 7, height: int = HEIGHT
) -> DataFrame:
    """The manifest of a table by ``part``, checked against a copy in which some rows were changed.

    A leaf is the digest of ``FIELDS``. The copy adds 1 to ``count`` where ``every`` divides the CRC-32
    of the decimal key; null counts and rows with a null key stay as they are. Columns: key,
    leaf, subroot, root, proof_sha256, folded_root, verified.

    Nulls are values of their own and differ from empty text; a null part is a part. One row
    per row, repeated rows included; an empty table gives no rows; other columns are not read.
    Texts are hashed whole where they lie and are not moved.
    """
    changed = F.col(count).isNotNull() & (F.crc32(F.col(key).cast("string").cast("binary")) % every == 0)
    fields = {c: F.col(c) for c in FIELDS}
    more = fields | {count: F.col(count).cast("decimal(38,0)") + 1}
    leaves = docs.select(
        part_name(F.col(part)).alias("part"), F.col(key).cast("long").alias("key"),
        digest(list(fields.values())).alias("leaf"), F.when(changed, digest(list(more.values()))).alias("now"),
    )
    return checked(manifest(leaves, height), "now").withColumnRenamed("key", key)


OP13_SQL = """
WITH RECURSIVE rows AS (
  SELECT *, list_transform(['' || doc_id, source, lang, '' || n_chars, text], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS f,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(array_to_string(f, '')) AS leaf,
    CASE WHEN n_chars IS NOT NULL AND xor(crc, 4294967295) % 7 = 0 THEN sha256(array_to_string(
      f[1:3] || [strlen('' || (n_chars + 1)) || ':' || (n_chars + 1)] || f[5:], '')) END AS now
  FROM rows),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS r
  FROM leaves),
nodes AS (
  SELECT lang, 0 AS lv, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, lv + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM nodes WHERE n > 1 GROUP BY lang, lv, i // 2),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lv, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lv + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lv, i // 2),
above AS (
  SELECT s.lang, any_value(s.subroot) AS subroot,
    coalesce(list(CASE WHEN t.i IS NULL THEN '-' WHEN t.i < s.i >> l.lv THEN 'L' || t.h ELSE 'R' || t.h END ORDER BY l.lv)
      FILTER (l.lv IS NOT NULL), []) AS steps
  FROM subroots s LEFT JOIN (SELECT DISTINCT lv FROM tops WHERE n > 1) l ON true
  LEFT JOIN tops t ON t.lv = l.lv AND t.i = xor(s.i >> l.lv, 1)
  GROUP BY s.lang),
below AS (
  SELECT p.r, any_value(p.doc_id) AS doc_id, any_value(p.lang) AS lang, any_value(p.leaf) AS leaf, any_value(p.now) AS now,
    coalesce(list(CASE WHEN t.i IS NULL THEN '-' WHEN t.i < p.i >> l.lv THEN 'L' || t.h ELSE 'R' || t.h END ORDER BY l.lv)
      FILTER (l.lv IS NOT NULL), []) AS steps
  FROM placed p LEFT JOIN (SELECT DISTINCT lang, lv FROM nodes WHERE n > 1) l ON l.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN nodes t ON t.lang IS NOT DISTINCT FROM p.lang AND t.lv = l.lv AND t.i = xor(p.i >> l.lv, 1)
  GROUP BY p.r),
folded AS (
  SELECT b.doc_id, b.leaf, a.subroot, (SELECT h FROM tops WHERE n = 1) AS root,
    sha256(array_to_string(list_transform(b.steps || a.steps, lambda s: s[2:]), '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(b.now, b.leaf), b.steps || a.steps), lambda h, s:
      CASE s[1] WHEN 'L' THEN sha256(s[2:] || h) WHEN 'R' THEN sha256(h || s[2:]) ELSE sha256(h) END) AS folded_root
  FROM below b JOIN above a ON a.lang IS NOT DISTINCT FROM b.lang)
SELECT *, folded_root = root AS verified FROM folded
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark, sf_dir):
    """The manifest of documents by lang, checked against a tampered copy."""
    return tampered_check(table(spark, sf_dir, "documents"))
