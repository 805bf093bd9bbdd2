"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from duskline.llm.catalog import query, table
from duskline.llm.text import spare
from duskline.sources.scratch import settle

#: Orders of the character n-grams, and the buckets that they share.
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Documents whose key has CRC-32 0 modulo this are never learned from.
FOLDS = 5
UNKNOWN = "und"
#: A best language with less than this posterior is a rejection.
MIN_SCORE = 0.5
#: Languages scored at a time: a block is this many times BUCKETS numbers on the driver and in each
#: executor. More languages are more blocks, one pass over the texts each.
WIDTH = 200
_BLOCK = 1 << 18
#: Numbers in one product of counts and weights.
_PRODUCT = 1 << 22
_GAP = re.compile(r"[\W\d_]+")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def _tallied(held: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows, columns and counts of a sparse matrix of texts by n-gram buckets."""
    codes = np.frombuffer("".join(piece for _, piece in held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(held)), [len(piece) for _, piece in held])
    keys = []
    for n in ORDERS:
        many = max(0, len(codes) - n + 1)
        h = np.full(many, n, dtype=np.uint32)
        for j in range(n):
            h = (h ^ codes[j : many + j]) * _FACTORS[j]
            h ^= h >> np.uint32(15)
        inside = owner[:many] == owner[len(owner) - many :]
        keys.append(owner[:many][inside] * BUCKETS + (h & np.uint32(BUCKETS - 1))[inside])
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    return np.array([i for i, _ in held])[found // BUCKETS], found % BUCKETS, counts


def _sparse(texts, lettered: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse matrices of whole texts, of bounded size each; marks in ``lettered`` who has a letter.

    A text longer than a block gives several rows, which add up; n-grams do not cross its blocks,
    and a block without a letter tells nothing.
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), _BLOCK) if isinstance(text, str) else ():
            piece = _GAP.sub(" ", text[at : at + _BLOCK].lower())
            if not any(c.isalpha() for c in piece):
                continue
            lettered[i] = True
            held.append((i, f" {piece} "))
            size += len(piece) + 2
            if size >= _BLOCK:
                yield _tallied(held)
                held, size = [], 0
    if held:
        yield _tallied(held)


def _held_out(key: str, folds: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))


class Block:
    """Some languages in order: their log-priors, and for each bucket the log-probability in each."""

    def __init__(self, languages: list[str], prior: np.ndarray, counts: pd.DataFrame):
        self.languages, self.prior = languages, prior
        at = {name: i for i, name in enumerate(languages)}
        grams = np.full((BUCKETS, len(languages)), SMOOTHING)
        grams[counts["bucket"].to_numpy(), counts["lang"].map(at).to_numpy(dtype=int)] += counts["n"]
        self.weights = np.log(grams / grams.sum(axis=0))

    def score(self, texts) -> pd.DataFrame:
        """lang, top, total: the best language of each text, the log of its joint probability and of the sum of all.

        Each sparse matrix of counts is multiplied by the weights. No language without a letter.
        """
        lettered = np.zeros(len(texts), dtype=bool)
        joint = np.zeros((len(texts), len(self.languages)))
        for doc, bucket, n in _sparse(texts, lettered):
            rows = max(1, _PRODUCT // len(self.languages))
            for at in range(0, len(doc), rows):
                part = doc[at : at + rows]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                terms = n[at : at + rows, None] * self.weights[bucket[at : at + rows]]
                joint[part[starts]] += np.add.reduceat(terms, starts, axis=0)
        # Every character is in as many n-grams as there are orders; count its evidence once.
        joint = self.prior + joint / len(ORDERS)
        top = joint.max(axis=1)
        total = top + np.log(np.exp(joint - top[:, None]).sum(axis=1))
        best = np.array(self.languages, dtype=object)[joint.argmax(axis=1)]
        return pd.DataFrame({"lang": np.where(lettered, best, None), "top": top, "total": total})


class Model:
    """The counts of all learned languages, read as blocks of ``width`` languages."""

    def __init__(self, counts: DataFrame, width: int = WIDTH):
        self.counts, self.width = counts, width
        docs = counts.filter(F.col("bucket") == BUCKETS).select("lang", "n").toPandas().sort_values("lang")
        self.languages = docs["lang"].tolist()
        self.prior = np.log(docs["n"].to_numpy(dtype=float) / max(1, docs["n"].sum()))

    def blocks(self) -> Iterator[Block]:
        for at in range(0, len(self.languages), self.width):
            names = self.languages[at : at + self.width]
            within = F.col("lang").between(names[0], names[-1]) & (F.col("bucket") < BUCKETS)
            yield Block(names, self.prior[at : at + self.width], self.counts.filter(within).toPandas())


def learn(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = FOLDS, width: int = WIDTH
) -> Model:
    """Count n-grams by language over all labelled documents outside the held-out fold.

    Each task adds up its documents to one count per language and bucket and Spark adds those.
    The sums are at most languages times buckets and stay in a table; blocks of ``width``
    languages of them are read to score.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def added() -> Iterator[pd.DataFrame]:
            for name, total in sums.items():
                used = np.flatnonzero(total)
                yield pd.DataFrame({"lang": name, "bucket": used, "n": total[used]})
            sums.clear()

        for batch in batches:
            lettered = np.zeros(len(batch), dtype=bool)
            codes, names = pd.factorize(batch["lang"])
            for doc, bucket, n in _sparse(batch["text"], lettered):
                of = codes[doc]
                for c in np.unique(of):
                    total = sums.setdefault(names[c], np.zeros(BUCKETS + 1, dtype=np.int64))
                    np.add.at(total, bucket[of == c], n[of == c])
                if len(sums) > width:
                    yield from added()
            for c, many in zip(*np.unique(codes[lettered], return_counts=True)):
                sums.setdefault(names[c], np.zeros(BUCKETS + 1, dtype=np.int64))[-1] += many
            if len(sums) > width:
                yield from added()
        yield from added()

    rows = docs.filter(~_held_out(key, folds) & F.col(key).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket")
    return Model(settle(sums.agg(F.sum("n").alias("n")), "language_counts"), width)


def _scored(docs: DataFrame, block: Block, text: str) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf("lang string, top double, total double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return held.value.score(texts)

    return run(F.col(text))


def _text_id(text: str) -> Column:
    return F.sha2(F.col(text), 256)


def predicted(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``name`` of (lang_pred, score) of every text.

    One block of languages is one expression over the texts. Several are scored one after the
    other, each written by text, and the best language and the sums are combined by text, so no
    task holds more than one block.
    """

    def judged(p: Column) -> Column:
        told = p["lang"].isNotNull()
        return F.struct(
            F.when(told, p["lang"]).otherwise(UNKNOWN).alias("lang_pred"),
            F.when(told, F.exp(p["top"] - p["total"])).otherwise(0.0).alias("score"),
        )

    if not model.languages:
        return docs.withColumn(name, F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")))
    if len(model.languages) <= model.width:
        scored = docs.withColumn(name, _scored(docs, next(model.blocks()), text))
        return scored.withColumn(name, judged(F.col(name)))
    found = None
    for block in model.blocks():
        one = docs.select(_text_id(text).alias("text_id"), _scored(docs, block, text).alias("p")).filter("p.lang IS NOT NULL")
        one = settle(one.dropDuplicates(["text_id"]).select("text_id", "p.*"), "language_block")
        found = one if found is None else found.unionByName(one)
    highest = F.array_max("totals")
    added = F.aggregate(F.sort_array("totals"), F.lit(0.0), lambda s, t: s + F.exp(t - highest))
    best = found.groupBy("text_id").agg(
        F.min(F.struct((-F.col("top")).alias("low"), "lang")).alias("best"), F.collect_list("total").alias("totals")
    )
    tid = spare(docs, "_text_id")
    whole = F.struct(F.col("best.lang").alias("lang"), (-F.col("best.low")).alias("top"), (highest + F.log(added)).alias("total"))
    best = settle(best.select(F.col("text_id").alias(tid), whole.alias(name)), "languages_told")
    joined = docs.withColumn(tid, _text_id(text)).join(best, tid, "left").drop(tid)
    return joined.withColumn(name, judged(F.col(name)))


def identify(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = FOLDS, width: int = WIDTH
) -> DataFrame:
    """One row per row of ``docs``: key, held_out, lang_pred, score.

    ``score`` is the posterior of the predicted language. Null text, text without a letter, and
    every text if nothing was learned are ``und`` with score 0; a null language is not learned; a
    null key is neither held out nor learned from. Equal posteriors go to the first language in
    alphabetical order; any number of languages can be learned. Repeated rows each count and each give a row; an empty table gives none.
    Other columns are not read, and language, source and key take no part in a prediction.
    """
    model = learn(docs, key, text, lang, folds, width)
    rows = docs.select(F.col(key), F.col(text).alias("_text"), _held_out(key, folds).alias("held_out"))
    return predicted(rows, model, "_p", "_text").select(key, "held_out", "_p.lang_pred", "_p.score")


def with_known_language(docs: DataFrame, min_score: float = MIN_SCORE, **options) -> DataFrame:
    """``docs`` without the rows whose language is unknown or uncertain; all columns stay.

    Null text and text without a letter have no language and go. Where no document has a label to
    learn from, no language can be told and every row stays. Ties are as in ``identify``; repeated
    rows are judged alike and all stay or go; an empty table stays empty.
    """
    model = learn(docs, **options)
    if not model.languages:
        return docs
    p = spare(docs, "_p")
    judged = predicted(docs, model, p, options.get("text", "text"))
    return judged.filter((F.col(f"{p}.lang_pred") != UNKNOWN) & (F.col(f"{p}.score") >= min_score)).drop(p)


@query("op3_language_id")
def op3(spark, sf_dir):
    """The language of every document, learned from the documents outside the held-out fold."""
    return identify(table(spark, sf_dir, "documents"))
