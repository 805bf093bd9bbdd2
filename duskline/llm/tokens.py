"""Token counts of whole texts: pre-tokens that are one token are looked up, only the rest is merged."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from duskline.llm.catalog import query, table
from duskline.llm.text import spare, whole

LIMIT = 2048
#: Fixed value: a pre-tokenizer with this pattern keeps its matches and drops what is between them.
#: No match holds white space or looks beyond itself, so white space may be cut at anywhere.
BLANK_FREE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Remembered per Python worker: this many chunks of at most this many characters.
REMEMBERED, REMEMBERED_LENGTH = 1 << 19, 64
#: Characters that are cut into chunks at a time.
BLOCK = 1 << 20


def whole_tokens(spec: str) -> frozenset[str]:
    """The pre-tokens that the tokenizer in ``spec`` (JSON) makes one token of, each proven.

    A vocabulary string, less the suffix that ends a word, is offered to the merges alone. It counts
    only if they end in that very string: a string whose parts merge in another order first, or
    one that only ever stands inside a word, is left to be merged. At most as many as the
    vocabulary has.
    """
    tokenizer, model = Tokenizer.from_str(spec), json.loads(spec)["model"]
    suffix = model.get("end_of_word_suffix") or ""
    proven = set()
    for string, number in model["vocab"].items():
        if string.endswith(suffix):
            piece = string[: len(string) - len(suffix)]
            if [t.id for t in tokenizer.model.tokenize(piece)] == [number]:
                proven.add(piece)
    return frozenset(proven)


def _checked(spec: str) -> None:
    """ValueError for a tokenizer whose counts this module does not claim to give."""
    content = json.loads(spec)
    if content["model"].get("type") != "BPE" or content["model"].get("dropout"):
        raise ValueError("only byte-pair merges without dropout are counted")
    for added in content["added_tokens"]:
        if added["single_word"] or added["lstrip"] or added["rstrip"] or added["normalized"]:
            raise ValueError(f"added token {added['content']!r} is not plain text of the input")


class Counter:
    """Counts tokens as the tokenizer in ``spec`` does, without special tokens of its own."""

    def __init__(self, spec: str, proven: frozenset[str]):
        _checked(spec)
        self.tokenizer, self.proven, self.seen = Tokenizer.from_str(spec), proven, {}
        content = json.loads(spec)
        special = sorted((a["content"] for a in content["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        first = ((content["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.blank_free = first == {
            "type": "Split", "pattern": {"Regex": BLANK_FREE}, "behavior": "Removed", "invert": True,
        }

    def _pieces(self, text: str) -> int:
        """Tokens of normalised text: one for a proven pre-token, else what the merges leave."""
        if self.tokenizer.pre_tokenizer is None:
            return len(self.tokenizer.model.tokenize(text))
        return sum(
            1 if piece in self.proven else len(self.tokenizer.model.tokenize(piece))
            for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        )

    def _segment(self, text: str) -> int:
        """Tokens of a text that holds no special string."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        if not self.blank_free:
            return self._pieces(text) if text else 0
        total = at = 0
        while at < len(text):
            end = text.find(" ", at + BLOCK)
            end = len(text) if end < 0 else end
            total += self._chunks(text[at:end].split(" "))
            at = end
        return total

    def _chunks(self, chunks: list[str]) -> int:
        known = list(map(self.seen.get, chunks))
        total = sum(filter(None, known))
        if None in known:
            for chunk, n in zip(chunks, known, strict=True):
                if n is None:
                    total += self._chunk(chunk)
        return total

    def _chunk(self, chunk: str) -> int:
        n = self.seen.get(chunk)
        if n is None:
            n = self._pieces(chunk)
            if len(chunk) <= REMEMBERED_LENGTH:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[chunk] = n
        return n

    def count(self, text: str) -> int:
        if self.special is None:
            return self._segment(text)
        total = at = 0
        for match in self.special.finditer(text):
            total += 1 + self._segment(text[at : match.start()])
            at = match.end()
        return total + self._segment(text[at:] if at else text)


@functools.lru_cache(maxsize=2)
def _counter(spec: str, proven: frozenset[str]) -> Counter:
    return Counter(spec, proven)


def token_counts(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, count: str = "n_tokens"
) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, ``count``, over_limit (more than ``limit`` tokens).

    ``tokenizer`` is the path of a byte-pair tokenizer's JSON file. The driver reads it and proves
    once which pre-tokens are whole tokens; the file and this set, no larger than the vocabulary,
    are broadcast, so executors need no file. Texts are normalised and cut into pre-tokens in Arrow
    batches where they lie, nothing is shuffled. Special strings in a text are one token each;
    nothing is added, truncated or padded. A tokenizer of another kind is a ValueError.

    Null text is empty: no bytes, no tokens. Repeated rows and equal texts are counted row by row
    and alike; an empty table gives no rows; other columns are not read. Very long texts are read
    whole, chunk after chunk; a long run without white space is one chunk, and merging it takes
    n log n steps. What a worker remembers of earlier chunks is bounded.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    _checked(spec)
    shared = docs.sparkSession.sparkContext.broadcast((spec, whole_tokens(spec)))

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(*shared.value)
        for batch in batches:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    hidden = spare(docs, "_tokens")
    rows = docs.select(F.col(key).alias(key), whole(F.col(text)).alias(hidden))
    return rows.select(
        F.col(key),
        F.octet_length(hidden).cast("long").alias("n_bytes"),
        counted(hidden).alias(count),
    ).withColumn("over_limit", F.col(count) > limit)


@query("op11_token_counts")
def op11(spark, sf_dir):
    """Tokens of every document; no SQL has the merges, tests compare with the library."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
