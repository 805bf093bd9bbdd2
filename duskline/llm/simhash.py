"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from duskline.llm.catalog import query, table
from duskline.llm.components import components
from duskline.llm.text import spare, text_key, whole
from duskline.operators.joins import grown
from duskline.sources.scratch import settle

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Distinct fingerprints that share a segment before they are searched by whole-value balls.
#: Beyond it, listing a fingerprint's 1,040 upper neighbours is less work than the bucket's pairs.
BUCKET = 512
_BLOCK = 1 << 20
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def _blocks(text: str) -> Iterator[list[bytes]]:
    """The words of a text in bounded blocks."""
    data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    at = 0
    while at < len(data):
        end = at + _BLOCK
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, as a signed number."""
    ones, n, tail = np.zeros(64, dtype=np.int64), 0, []
    for block in _blocks(text):
        tokens = tail + block
        runs = [b" ".join(tokens[i : i + k]) for i in range(len(tokens) - k + 1)]
        for at in range(0, len(runs), 1 << 15):
            part = runs[at : at + (1 << 15)]
            hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in part], dtype="<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            n += len(part)
        tail = tokens[-(k - 1) :] if len(tokens) >= k - 1 else tokens
        if k == 1:
            tail = []
    if n == 0:  # fewer than k words: the whole sequence, or nothing
        if not tail:
            return 0
        value = xxhash.xxh64_intdigest(b" ".join(tail), SEED)
    else:
        value = int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(text: Column, k: int = SHINGLE) -> Column:
    """SimHash of every text; null counts as empty, and empty gives zero."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, k) for t in texts], dtype="int64")

    return run(whole(text))


def _masks(bits: int, radius: int) -> list[int]:
    """Numbers with at most ``radius`` of ``bits`` bits set."""
    found = [0]
    for r in range(radius):
        found += [m | 1 << j for m in found if m.bit_count() == r for j in range(m.bit_length(), bits)]
    return found


def _signed(m: int) -> int:
    return m - (1 << 64) if m >= 1 << 63 else m


def _neighbours(value: Column, masks: list[int]) -> Column:
    """``value`` changed by every mask."""
    return F.transform(F.lit([_signed(m) for m in masks]).cast("array<long>"), lambda m: value.bitwiseXOR(m))


def hamming_links(values: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct longs ``values.f`` within ``max_bits`` bits.

    The value is cut into a high and a low segment of 32 bits. Two values within r bits differ
    by at most r // 2 in the high one, or else by at most r - r // 2 - 1 in the low one. Each
    value looks up, in a table of the high segments, every segment in a ball of radius r // 2,
    and in a table of the low segments a ball of radius r - r // 2 - 1; matches are verified on
    all 64 bits. For r = 2 that is 33 and 1 lookups.

    Segments that more than ``bucket`` values share are left out of the tables: their pairs
    would grow with the square of the bucket. The values in them enumerate the whole ball of
    radius r instead and look it up in the table of all values, which is linear in their number
    and finds the same pairs.

    Neither side of a lookup is broadcast: Spark takes the rows of an explode to be as large as what
    was exploded, so a ball of some thousand neighbours per value would look small.
    """
    high_r, low_r = max_bits // 2, max_bits - max_bits // 2 - 1
    high, low = F.shiftrightunsigned("f", 32), F.col("f").bitwiseAND(F.lit(0xFFFFFFFF))
    segments = [("high", high, high_r)] + ([("low", low, low_r)] if low_r >= 0 else [])
    found, crowded = [], []
    for name, segment, radius in segments:
        cut = values.withColumn("s", segment)
        sizes = cut.groupBy("s").agg(F.count("*").alias("n"))
        full = settle(sizes.filter(F.col("n") > bucket).select("s"), f"{name}_full")
        held = cut.join(full, "s", "left_anti")
        asked = values.select(
            F.col("f").alias("g"), F.explode(_neighbours(segment, _masks(32, radius))).alias("s")
        )
        found.append(asked.join(grown(held), "s").select("f", "g"))
        crowded.append(cut.join(full, "s", "left_semi").select("f"))
    every = crowded[0]
    for more in crowded[1:]:
        every = every.unionByName(more)
    # Both ends of a pair that only the ball finds are crowded: the smaller one asks for the larger.
    larger = F.filter(_neighbours(F.col("f"), _masks(64, max_bits)[1:]), lambda v: v > F.col("f"))
    ball = every.distinct().select(F.col("f").alias("g"), F.explode(larger).alias("f"))
    found.append(ball.join(grown(values), "f").select("f", "g"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    near = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= max_bits
    return (
        pairs.filter((F.col("f") != F.col("g")) & near)
        .select(F.least("f", "g").alias("a"), F.greatest("f", "g").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: key, text_key, fingerprint (long), group (long), component_id.

    Rows with the same fingerprint are one node; nodes link at ``max_bits`` or fewer differing
    bits. ``group`` is the component's smallest fingerprint, ``component_id`` the smallest key in
    it. Null text is empty; empty texts have fingerprint zero and link like any other. A null key
    takes part but is never the smallest one unless the component has no other. Repeated rows
    each give a row; an empty table gives none; other columns are not read.

    Fingerprints are computed once and written, narrow, to the shared folder. Copies meet as one
    node before anything is compared, so a group of equal texts costs one lookup.
    """
    rows = settle(
        docs.select(
            F.col(key).alias("_key"),
            text_key(F.col(text)).alias("text_key"),
            fingerprints(F.col(text), k).alias("fingerprint"),
        ),
        "fingerprints",
    )
    nodes = settle(rows.groupBy(F.col("fingerprint").alias("f")).agg(F.min("_key").alias("low")), "nodes")
    reached = components(hamming_links(nodes.select("f"), max_bits))
    placed = nodes.join(grown(reached.withColumnRenamed("node", "f")), "f", "left").select(
        "f", "low", F.coalesce("component", "f").alias("group")
    )
    smallest = placed.groupBy("group").agg(F.min("low").alias("component_id"))
    labels = settle(placed.join(grown(smallest), "group").select("f", "group", "component_id"), "labels")
    return rows.join(grown(labels), rows["fingerprint"] == labels["f"]).select(
        F.col("_key").alias(key), "text_key", "fingerprint", "group", "component_id"
    )


def one_of_each(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, all columns kept.

    The one with the smallest doc_id stays; null ids come last, then the text decides. Rows that
    agree in doc_id and text are copies of one document, and one row of them stays.
    """
    marked = near_duplicates(docs, k, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_key")
    first = marked.groupBy("group").agg(F.min(order).alias("o"))
    first = settle(first.select(F.col("o.doc_id").alias("_id"), F.col("o.text_key").alias("_tk")), "kept")
    tk = spare(docs, "_tk")
    kept = docs.withColumn(tk, text_key(F.col("text"))).alias("d").join(
        first.alias("k"),
        (F.col(f"d.{tk}") == F.col("k._tk")) & F.col("d.doc_id").eqNullSafe(F.col("k._id")),
        "left_semi",
    )
    return kept.dropDuplicates(["doc_id", tk]).drop(tk)


@query("op8_simhash")
def op8(spark, sf_dir):
    """SimHash near-duplicates of all documents: three-word shingles, at most two bits apart."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
