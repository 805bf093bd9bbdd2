"""SpotSigs fingerprints: chains of content words that follow common words."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from duskline.llm.catalog import query, table
from duskline.llm.text import whole
from duskline.sources.scratch import settle

CHAIN = 2
NEAR = 0.8
#: Common words of English, French, German and Spanish, the anchors.
ANCHORS = frozenset(
    """
    a an the is are was be of and to in that it for on with
    le la les un une est de des et en que dans pour par du
    der die das ein eine ist und den von zu mit nicht auf im
    el los las una es y por con para del se no
    """.split()
)
_WORD = re.compile(r"[^\W_]+")


def signatures(text: str) -> np.ndarray:
    """The sorted distinct signatures of a text, 32 bits each.

    Each anchor starts a chain of the next two words that are no anchors (one, at the end). In
    a text without a chain every word is taken for an anchor and the next words for its chain.
    """
    tokens = _WORD.findall(text.lower())
    content = [w for w in tokens if w not in ANCHORS]
    spots, seen = set(), 0
    for w in tokens:
        if w not in ANCHORS:
            seen += 1
        elif seen < len(content):
            spots.add((w, seen))
    chains = [(w, *content[i : i + CHAIN]) for w, i in spots]
    if not chains:
        chains = [tuple(tokens[i : i + 1 + CHAIN]) for i in range(max(1, len(tokens) - CHAIN))] if tokens else []
    return np.unique(np.array([zlib.crc32(" ".join(c).encode("utf-8", "surrogatepass")) for c in chains], dtype="<u4"))


def encoded(found: np.ndarray) -> str:
    return base64.b64encode(found.tobytes()).decode("ascii")


def length_partition(n: int, near: float = NEAR) -> int:
    """Sets with a Jaccard likeness of ``near`` or more are in one or in neighbouring partitions."""
    return 0 if n == 0 else 1 + int(math.floor(round(math.log(n) / -math.log(near), 9)))


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 without comparing them if their lengths allow less
    than ``least``. Two empty sets are alike, an empty and another one are not."""
    small, large = sorted((len(a), len(b)))
    if large == 0:
        return 1.0
    if small / large < least or small == 0:
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (small + large - shared)


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted, each partition ended by the row that follows its last one."""
    held = None  # key, text, signatures of the row that waits for its next one
    for batch in batches:
        out = []
        for key, text, ahead in zip(batch["key"], batch["text"], batch["ahead"]):
            if ahead and held is None:
                continue  # further rows that share the following key
            own = signatures(text)
            if held is not None:
                last, before, sigs = held
                n = len(before)
                edited = before[: n - n // 2] + text[: n // 2]
                changed = signatures(edited)
                out.append(
                    (last, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encoded(sigs),
                     encoded(changed), pruned_jaccard(sigs, changed), pruned_jaccard(sigs, own), len(sigs))
                )
            held = None if ahead else (key, text, own)
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"key": "Int64"})


_COLUMNS = [
    "key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures",
]


def fingerprints_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_signatures.

    The edited text replaces the last floor(n_chars / 2) code points by as many first ones of
    the next document in descending key order; the first document follows the last. Keys are
    whole numbers. Null keys come last; rows with one key are ordered by text. Null text is
    empty: no signature, an empty fingerprint. An empty table gives no rows; a single document
    follows itself. Other columns are not read.

    Keys are cut into ranges at their quantiles, each range is one partition, sorted, and the
    row that starts the next range is added at its end. So texts are shuffled once, a row meets
    its next one without a global window, and a task holds two texts at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), whole(F.col(text)).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = sorted(set(rows.agg(F.percentile_approx("key", shares, 10 * parts)).first()[0] or []))
    above = F.filter(F.lit(cuts).cast("array<long>"), lambda c: c > F.col("key")) if cuts else F.array()
    part = F.when(F.col("key").isNull(), len(cuts)).otherwise(F.size(above)) if cuts else F.lit(0)
    rows = rows.withColumn("part", part.cast("int"))
    # One key per partition: the first of each, and the partition before it.
    heads = {r["part"]: r["head"] for r in rows.groupBy("part").agg(F.max("key").alias("head")).collect()}
    full = sorted(heads)
    follows = [(heads[p], full[i - 1], p) for i, p in enumerate(full)]
    ahead = spark.createDataFrame(follows, "head long, before int, own int")
    first = rows.join(
        F.broadcast(ahead), (F.col("part") == F.col("own")) & F.col("key").eqNullSafe(F.col("head"))
    ).select("key", "text", F.col("before").alias("part"), F.lit(True).alias("ahead"))
    dealt = rows.withColumn("ahead", F.lit(False)).unionByName(first)
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(
        "part", "ahead", F.col("key").desc_nulls_last(), "text"
    )
    found = dealt.select("key", "text", "ahead").mapInPandas(
        _compared,
        "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, n_signatures long",
    )
    return found.withColumnRenamed("key", key)


def near_pairs(docs: DataFrame, near: float = NEAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, likeness): pairs of different signature sets of at least ``near`` Jaccard likeness,
    named by the smallest key that has the set.

    Equal sets are one row. Sets are partitioned by length; each asks its own partition and the
    next one, through its rarest signatures: of n, sets that are near share one of the
    n - ceil(near n) + 1 rarest. Pairs are verified by counting shared signatures. Texts without
    signatures and null keys take no part; an empty table gives no rows.
    """

    @F.pandas_udf("array<long>")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series([signatures(t).astype(np.int64) for t in texts])

    sets = docs.select(F.col(key).alias("key"), signed(whole(F.col(text))).alias("s")).filter(F.col("key").isNotNull())
    sets = settle(sets.filter(F.size("s") > 0).groupBy("s").agg(F.min("key").alias("key")), "signature_sets")
    step = -math.log(near)
    sized = sets.withColumn("n", F.size("s")).withColumn("part", F.floor(F.round(F.log("n") / F.lit(step), 9)))
    each = sized.select("key", "n", "part", F.explode("s").alias("g"))
    common = each.groupBy("g").agg(F.count("*").alias("df"))
    rare = each.join(common, "g").groupBy("key", "n", "part").agg(
        F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o")
    )
    taken = (F.col("n") - F.ceil(F.round(F.lit(near) * F.col("n"), 9)) + 1).cast("int")
    index = settle(rare.select("key", "part", F.explode(F.slice("o", F.lit(1), taken)).alias("o")), "signature_index")
    index = index.select("key", "part", F.col("o.g").alias("g"))
    asked = index.select(F.col("key").alias("a"), "g", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    pairs = asked.join(index.withColumnRenamed("key", "b"), ["g", "part"]).filter("a != b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda name: sets.select(F.col("key").alias(name), F.col("s").alias(f"s_{name}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    likeness = shared / (F.size("s_a") + F.size("s_b") - shared)
    return both.select("a", "b", likeness.alias("likeness")).filter(F.col("likeness") >= near)


@query("op9_spotsigs")
def op9(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints_with_edits(table(spark, sf_dir, "documents"))
