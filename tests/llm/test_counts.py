"""Token counts, source divergence and the Merkle manifest against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duskline.llm import divergence, merkle, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = """<|endoftext|> <|startoftext|> <|ENDOFTEXT|> < <| |> 's 'LL 12 ½ Ⅻ 中 é É é ́ İ Σ ς ﬁ ß 힣 a the ing
    https://x.y/z?a=1 ​ ﻿""".split() + [" ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", " ", "\x00"]


def strange(n=2000):
    rnd = random.Random(7)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(30))) for _ in range(n)]
    anywhere = lambda: chr(rnd.choice([rnd.randrange(0x20, 0xD800), rnd.randrange(0xE000, 0x110000)]))
    return made + ["".join(anywhere() for _ in range(40)) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_as_the_library(name):
    path = public_tokenizers.path(name)
    spec = open(path, encoding="utf-8").read()
    texts = strange() + ["a" * 200_000, "x " * 100_000, "b" * 70 + " " + "b" * 70, "", " "]
    counter = tokens.Counter(spec, tokens.whole_tokens(spec))
    library = Tokenizer.from_file(path)
    assert [counter.count(t) for t in texts] == [
        len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)
    ]


def test_tokens_beyond_a_block_and_what_is_remembered(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    spec = open(path, encoding="utf-8").read()
    monkeypatch.setattr(tokens, "BLOCK", 7)
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    counter, library = tokens.Counter(spec, tokens.whole_tokens(spec)), Tokenizer.from_file(path)
    for t in strange(300):
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids)
    assert len(counter.seen) <= 5


def test_whole_tokens_are_one_token_alone():
    path = public_tokenizers.path("word_bpe_49k.json")
    proven = tokens.whole_tokens(open(path, encoding="utf-8").read())
    model = Tokenizer.from_file(path).model
    assert all(len(model.tokenize(p)) == 1 for p in proven) and len(proven) > 30_000


def test_tokens_of_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r for r in tokens.token_counts(docs, path).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_other_tokenizers_are_refused(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('{"model": {"type": "WordLevel"}, "added_tokens": []}')
    with pytest.raises(ValueError):
        tokens.token_counts(spark.createDataFrame([], SCHEMA), str(path))


@pytest.mark.parametrize("rows,columns", [(1, 1), (3, 5), (4, 4), (9, 70), (33, 129)])
def test_walk_equals_plain_distances(rows, columns):
    rng = np.random.default_rng(rows)
    for other, share in ((rows, 0.1), (2 * rows + 1, 0.5), (1, 0.0), (rows, 1.0)):
        sides = []
        for n in (rows, other):
            zero = rng.integers(1, 10**9, n)
            dense = np.repeat(zero[:, None], columns, 1)
            full = rng.random((n, columns)) < share
            full[:, columns // 2 :] &= rng.random((n, columns - columns // 2)) < 0.1
            r, c = np.nonzero(full)
            p = rng.integers(1, 10**9, len(r))
            dense[r, c] = p
            sides.append((zero, np.array([r, c, p]), dense))
        (za, ca, a), (zb, cb, b) = sides
        want = np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2)
        assert (divergence.distances(za, ca, zb, cb, columns) == want).all()


def plain_audit(rows, least, top):
    seen, held, count = set(), Counter(), Counter()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        seen.add((lang, source))
        found = divergence_words(text or "")
        held.update((lang, t) for t in set(found))
        count.update((lang, source, t) for t in found)
    kept = {}
    for (lang, t), n in held.items():
        if n >= least:
            kept.setdefault(lang, []).append(t)
    prices = lambda c, ts: {
        t: 1 + 10**9 * (c(t) + 5) // (sum(map(c, ts)) + 5 * len(ts)) for t in ts
    }
    out = []
    for lang, source in seen:
        ts = kept.get(lang, [])
        own = prices(lambda t: count[lang, source, t], ts)
        others = sorted(s for x, s in seen if x == lang)
        all_of = prices(lambda t: sum(count[lang, s, t] for s in others), ts)
        pairs = []
        for s in others:
            if s != source:
                q = prices(lambda t: count[lang, s, t], ts)
                pairs.append((-sum(abs(own[t] - q[t]) for t in ts), s.encode(), s))
        words = [(all_of[t] - own[t], t.encode(), t) for t in ts if count[lang, source, t] and own[t] > all_of[t]]
        for part, found, most in (("pair", pairs, None), ("term", words, top)):
            out += [(lang, source, part, x, -v, i + 1) for i, (v, _, x) in enumerate(sorted(found)[:most])]
    return sorted(out)


def divergence_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in "".join(c if "a" <= c <= "z" or c >= "\x80" else "\n" for c in low).split("\n") if w]


@pytest.mark.parametrize("blocks", [(32, 512), (2, 3)])
def test_audit_equals_plain(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "ROWS", blocks[0])
    monkeypatch.setattr(divergence, "COLUMNS", blocks[1])
    rnd = random.Random(3)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["Été", "ÉTÉ", "İx", "a\x00b", "don't"]
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "12 !!", "xx", "lonely", 0), (3, None, "xx", "alone", 0)]
    for i in range(400):
        lang, source = rnd.choice(["en", "en", "de", None]), f"s{min(rnd.randrange(12), 9)}"
        first = 0 if source < "s5" else 30
        text = " ".join(rnd.choice(vocabulary[first:]) for _ in range(rnd.randrange(40)))
        rows.append((i, text, lang, source, 1))
    rows += [rows[10]] * 40
    got = sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA), min_docs=9, top=7).collect())
    assert got == plain_audit(rows, 9, 7)


def test_terms_of_bytes_are_the_terms_of_characters():
    odd = "a\x85b c\xa0d \u2028x\u3000Y ÀÉ\U0001f600z it's A1b2\tZ\x1c_q\x7fw [K] İI\x00end"
    for text in ("", " ", "ABC", odd, odd[::-1]):
        assert [t.decode() for t in divergence.terms(text.encode())] == divergence_words(text)


def test_prices_stay_exact(spark):
    big = 7 * 10**17
    row = spark.range(1).select(divergence.price(F.lit(big), F.lit(9 * 10**17), F.lit(12_345)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (big + 5) // (9 * 10**17 + 5 * 12_345)


def test_addresses_are_a_layout():
    for levels in range(1, 12):
        places = np.concatenate(merkle.addresses(levels))
        assert sorted(places.tolist()) == list(range(2**levels - 1))
    # Seven levels: the upper three first, then each subtree of four in one stretch.
    low = merkle.addresses(7)
    assert max(int(x.max()) for x in low[:3]) == 6
    assert [low[3][s] for s in range(8)] == [7 + 15 * s for s in range(8)]


def plain_hash(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_check(rows):
    """Whole levels of digests at a time, without blocks."""
    shown = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, t, la, s, n: plain_hash(*map(shown, (d, s, la, n, t)))
    parts = {}
    for d, t, la, s, n in rows:
        now = n is not None and d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        parts.setdefault(la, []).append((d is not None, d or 0, leaf(d, t, la, s, n), leaf(d, t, la, s, n + 1) if now else None))

    def climb(level):
        levels = [level]
        while len(level) > 1:
            level = [plain_hash(*level[i : i + 2]) for i in range(0, len(level), 2)]
            levels.append(level)
        return levels

    def siblings(levels, i):
        for level in levels[:-1]:
            yield (level[i ^ 1] if i ^ 1 < len(level) else "", i & 1)
            i >>= 1

    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {la: climb([x[2] for x in sorted(parts[la], key=lambda x: x[:3])]) for la in order}
    top = climb([trees[la][-1][0] for la in order])
    out = []
    for k, la in enumerate(order):
        for i, (there, d, own, now) in enumerate(sorted(parts[la], key=lambda x: x[:3])):
            way = [*siblings(trees[la], i), *siblings(top, k)]
            h = now or own
            for s, right in way:
                h = plain_hash(s, h) if right else plain_hash(h, s)
            root = top[-1][0]
            out.append((d if there else None, own, trees[la][-1][0], root, plain_hash(*[s for s, _ in way]), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,height", [(0, 10), (1, 10), (3, 1), (70, 2), (70, 10)])
def test_manifest_equals_plain(spark, n, height):
    rnd = random.Random(n)
    rows = [(i * 3, f"text {i} é", rnd.choice(["en", "en", "de", None, ""]), None if i % 5 == 0 else "s", i if i % 4 else None) for i in range(n)]
    rows += rows[:3] + ([(None, None, None, None, None), (rows[0][0], "other", rows[0][2], "", 7)] if n > 2 else [])
    got = merkle.tampered_check(spark.createDataFrame(rows, SCHEMA), height=height).collect()
    assert sorted(map(tuple, got), key=repr) == (plain_check(rows) if rows else [])


def test_manifest_does_not_depend_on_partitions(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    root = lambda d: merkle.tampered_check(d).select("root").distinct().collect()
    assert root(docs.repartition(7)) == root(docs.coalesce(1))


def test_kept_blocks_hold_every_node(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    leaves = docs.select(merkle.part_name(F.col("lang")).alias("part"), F.col("doc_id").alias("key"), merkle.digest([F.col("text")]).alias("leaf"))
    made = merkle.manifest(leaves, height=3)
    rows = made.blocks().collect()
    low = [r for r in rows if r["level"] == 0]
    assert sum(r["size"] for r in low) == docs.count()
    for r in low:
        leaf = [bytes(r["nodes"])[a * 32 : a * 32 + 32].hex() for a in merkle.addresses(r["height"] + 1)[-1][: r["size"]]]
        for i in range(r["size"]):
            assert merkle.fold(leaf[i], *merkle.path(bytes(r["nodes"]), r["height"], r["size"], i)) == r["root"]
