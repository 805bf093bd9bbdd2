"""URL verdicts: rules first, then a ratio of character language models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from duskline.llm.catalog import query, table
from duskline.llm.text import UPPER

#: Fixed values: (verdict, host, path) of each rule.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Contexts of 0 to ORDER bytes; each order has so many buckets, which bounds the model.
ORDER = 4
BUCKETS = 1 << 18
#: Weight of the shorter context against what was counted in the longer one.
BACKOFF = 4.0
FOLDS = 5
_START, _END = 2, 3
_FACTOR = np.uint32(0x9E3779B1)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and all that follows the first ``://``; empty if it has none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path, rest


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. The rules are a short fixed list."""
    rule = verdict = F.lit(None).cast("string")
    for said, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all texts with start and end marks, the places to predict, and where each text's begin."""
    rows = [bytes([_START]) * ORDER + t.encode("utf-8", "surrogatepass") + bytes([_END]) for t in texts]
    codes = np.frombuffer(b"".join(rows), dtype=np.uint8).astype(np.uint32)
    lengths = np.array([len(r) for r in rows])
    starts = np.cumsum(lengths) - lengths
    asked = np.ones(len(codes), dtype=bool)
    for j in range(ORDER):
        asked[starts + j] = False
    return codes, np.flatnonzero(asked), np.cumsum(lengths - ORDER) - (lengths - ORDER)


def _buckets(codes: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: the buckets of the context before each place, and of context and symbol."""
    h = np.zeros(len(places), dtype=np.uint32)
    for n in range(ORDER + 1):
        if n:
            h = (h ^ codes[places - n]) * _FACTOR
            h ^= h >> np.uint32(15)
        gram = (h ^ (codes[places] + np.uint32(257))) * _FACTOR
        gram ^= gram >> np.uint32(13)
        yield n, h & np.uint32(BUCKETS - 1), gram & np.uint32(BUCKETS - 1)


class Ratio:
    """Counts of contexts and of contexts with their next symbol, for accepted and rejected URLs.

    The probability of a symbol mixes what followed its context with the next shorter context's
    probability, so the order varies with how often a context was seen.
    """

    def __init__(self, counts: pd.DataFrame):
        shape = (2, 2, ORDER + 1, BUCKETS)  # accepted, gram or context, order, bucket
        self.counts = np.zeros(shape, dtype=np.float32)
        self.counts.reshape(-1)[counts["cell"].to_numpy()] = counts["n"].to_numpy()

    def scores(self, texts: list[str]) -> np.ndarray:
        """Mean log-likelihood difference per symbol, accepted less rejected."""
        if not texts:
            return np.zeros(0)
        codes, places, starts = _symbols(texts)
        p = np.full((2, len(places)), 1 / 256)
        for n, context, gram in _buckets(codes, places):
            for side in (0, 1):
                after, of = self.counts[side, 0, n][gram], self.counts[side, 1, n][context]
                p[side] = (after + BACKOFF * p[side]) / (of + BACKOFF)
        lengths = np.diff(np.append(starts, len(places)))
        return np.add.reduceat(np.log(p[1]) - np.log(p[0]), starts) / lengths


def _fold(text: Column) -> Column:
    return F.crc32(text) % FOLDS


def learn(labelled: DataFrame) -> Ratio:
    """Count over all of ``labelled`` (text, accepted). Tasks add up their URLs before the shuffle;
    the sums are bounded by the size of the model."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 2, ORDER + 1, BUCKETS), dtype=np.int64)
        for batch in batches:
            for side in (0, 1):
                texts = list(batch["text"][batch["accepted"] == bool(side)])
                for at in range(0, len(texts), 1000):
                    codes, places, _ = _symbols(texts[at : at + 1000])
                    for n, context, gram in _buckets(codes, places):
                        sums[side, 0, n] += np.bincount(gram, minlength=BUCKETS)
                        sums[side, 1, n] += np.bincount(context, minlength=BUCKETS)
        flat = sums.reshape(-1)
        used = np.flatnonzero(flat)
        yield pd.DataFrame({"cell": used, "n": flat[used]})

    sums = labelled.select("text", "accepted").mapInPandas(count, "cell long, n long")
    return Ratio(sums.groupBy("cell").agg(F.sum("n").alias("n")).toPandas())


def judge_urls(
    pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES
) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict, score.

    The URLs that a rule decides train two character models, of accepted and of rejected URLs;
    every fifth (by CRC-32 of the URL) is left out and calibrates: the threshold lies between
    the two classes' mean scores, in proportion to their spreads. ``score`` is the mean
    log-likelihood difference per byte, so long URLs are not favoured. URLs without a rule are
    allowed from the threshold on.

    A URL without ``://`` has an empty host and path and no rule; it, and one with nothing after
    that, is scored as it stands. A null or empty URL has score 0 and is blocked. If the rules
    decide no URL of one class, there is no model: score 0, allowed.
    Repeated rows each count and each give a row; an empty table gives none; long URLs are scored
    whole; other columns are not read.
    """
    host, path, rest = url_parts(F.col(url))
    text = F.when(rest != "", rest).otherwise(F.coalesce(F.col(url), F.lit("")))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), text.alias("text"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    labelled = rows.filter(F.col("ruled").isNotNull()).select("text", (F.col("ruled") == "allow").alias("accepted"))
    model = learn(labelled.filter(_fold(F.col("text")) != 0))
    held = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        found = [held.value.scores(list(texts[at : at + 1000])) for at in range(0, len(texts), 1000)]
        return pd.Series(np.concatenate(found) if found else [], dtype="float64")

    side = labelled.filter(_fold(F.col("text")) == 0).select("accepted", score("text").alias("s"))
    spread = {
        r["accepted"]: (r["m"], r["d"] or 0.0)
        for r in side.groupBy("accepted").agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).collect()
    }
    if len(spread) == 2:
        (a, da), (b, db) = spread[True], spread[False]
        threshold = (a * db + b * da) / (da + db) if da + db > 0 else (a + b) / 2
        found = score("text")
    else:
        threshold, found = 0.0, F.lit(0.0)
    given = F.col("text") != ""
    rows = rows.withColumn("score", F.when(given, found).otherwise(0.0))
    by_model = F.when(given & (F.col("score") >= threshold), "allow").otherwise("block")
    return rows.select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score"
    )


@query("op7_url_filter")
def op7(spark, sf_dir):
    """Verdicts on the URLs of all pages."""
    return judge_urls(table(spark, sf_dir, "pages"))
