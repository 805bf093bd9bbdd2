"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from duskline.llm import (
    decontaminate, divergence, language, licenses, linespread, merkle, mixing, secrets, simhash, spotsigs, surrogates, tokens, urls,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = """
    key h row _tk _s t w n g k site text_key item part lines d x r i c f a b s p u v m o own group label gram pos at votes
    span kind entity attempt hit hits tries copy shuffle_key n_entities kinds lines_removed n_removed score lang_pred
    held_out fingerprint component_id n_bytes n_tokens over_limit leaf now root block zero cells price need hs shingle head ahead before rate weight size rank value owner repo line
""".split()
LONG = "under the mit license " * 20_000 + "\nend"
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1),
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1),
    (2, None, None, None, None),
    (None, "", "fr", "b", 0),
    (None, "12 34 !!", None, "b", 8),
    (3, "same line\n\nown words here", "de", "c", 25),
    (4, "same line\r\n\u00e9t\u00e9 \U0001f600 \x00 x", "fr", None, 9),
    (5, LONG, "en", "a", len(LONG)),
]
OPERATORS = {
    "mix": mixing.mix,
    "licenses": licenses.license_marks,
    "language": language.identify,
    "known_language": language.with_known_language,
    "secrets": secrets.secret_spans,
    "surrogates": surrogates.with_surrogates,
    "leaks": lambda d: decontaminate.leaks(d, items(d.sparkSession)),
    "without_items": lambda d: decontaminate.without_items(d, items(d.sparkSession)),
    "urls": lambda d: urls.judge_urls(d, key="doc_id", url="text"),
    "simhash": simhash.near_duplicates,
    "one_of_each": simhash.one_of_each,
    "spotsigs": spotsigs.fingerprints_with_edits,
    "spotsig_pairs": spotsigs.near_pairs,
    "tokens": lambda d: tokens.token_counts(d, public_tokenizers.path("word_bpe_49k.json")),
    "divergence": lambda d: divergence.audit(d, min_docs=1),
    "merkle": merkle.tampered_check,
    "lines": lambda d: linespread.drop_spread_lines(d, min_sites=2, count="n_removed"),
}
ROW_BY_ROW = ["licenses", "language", "secrets", "surrogates", "urls", "simhash", "spotsigs", "lines", "tokens", "merkle"]


def items(spark):
    rows = [(1, "Same line, own words here"), (1, "Same line, own words here"), (2, None), (3, ""), (None, "own words")]
    return spark.createDataFrame(rows, "item_id long, text string")


def docs(spark, rows=ROWS):
    extra = [F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASH)]
    return spark.createDataFrame(rows, SCHEMA).select("*", *extra)


@pytest.mark.parametrize("name", OPERATORS)
def test_messy_rows(spark, name):
    found = OPERATORS[name](docs(spark)).collect()
    if name in ROW_BY_ROW:
        assert len(found) == len(ROWS)
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["mix", "known_language", "surrogates", "without_items", "one_of_each", "lines"])
def test_extra_columns_pass_through(spark, name):
    table = docs(spark)
    out = OPERATORS[name](table)
    assert out.columns[: len(table.columns)] == table.columns
    for r in out.select(*CLASH).collect():
        assert list(r) == [f"x{i}" for i in range(len(CLASH))]


def test_defined_results(spark):
    lang = {(r["doc_id"], r["lang_pred"] == "und") for r in language.identify(docs(spark)).collect()}
    assert {(2, True), (1, False), (5, False)} <= lang
    marks = {r["doc_id"]: r for r in licenses.license_marks(docs(spark)).collect()}
    assert (marks[5]["n_base"], marks[5]["first_word"], marks[5]["last_word"]) == (20_000, 0, 4 * 19_999)
    assert (marks[2]["n_words"], marks[2]["labels"], marks[2]["first_word"]) == (0, "", None)
    spots = {r["doc_id"]: r for r in spotsigs.fingerprints_with_edits(docs(spark)).collect() if r["doc_id"]}
    assert (spots[2]["fingerprint"], spots[2]["n_chars"]) == ("", 0)
    kept = [r["doc_id"] for r in simhash.one_of_each(docs(spark)).collect()]
    assert sorted(map(str, kept)) == ["1", "2", "3", "4", "5", "None"]  # empty texts are one group
    kept = {r["doc_id"]: r["text"] for r in linespread.drop_spread_lines(docs(spark), min_sites=2).collect()}
    assert kept[2] is None and kept[3] == "same line\n\nown words here"


def test_nothing_to_learn_keeps_every_document(spark):
    rows = [(i, t, None, "a", 1) for i, t in enumerate(["some words here", None, "12", "some words here"])]
    assert language.with_known_language(docs(spark, rows)).count() == 4
    assert {r["lang_pred"] for r in language.identify(docs(spark, rows)).collect()} == {"und"}


@pytest.mark.parametrize("sigmas", [0, 5, 1000])
def test_line_spread_is_exact_whatever_the_sketch_decides(spark, monkeypatch, sigmas):
    """Lines on 1 to 40 sites, several times each; with a wide margin every line is counted exactly."""
    monkeypatch.setattr(linespread, "SIGMAS", sigmas)
    rows = []
    for n in range(1, 41):
        for i in range(max(n, 8)):
            rows.append((n * 100 + i, f"line of {n} sites \nown {n} {i}", "en", f"s{i % n}" if i % n or n % 2 else None, 1))
    found = {(r["h"], r["keeper"]) for r in linespread.spread_lines(docs(spark, rows), 6).collect()}
    want = {n * 100 for n in range(1, 41) if len({f"s{i % n}" for i in range(max(n, 8)) if i % n or n % 2}) >= 6}
    assert {k for _, k in found} == want and len(found) == len(want)
