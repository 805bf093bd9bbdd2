"""SpotSigs, surrogates, decontamination and the pipeline against plain versions."""

import hashlib
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from duskline.llm import decontaminate, language, linespread, mixing, simhash, spotsigs, surrogates
from tests.llm.test_simhash import plain, union


def test_edits_and_likeness(spark, tiny):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()), reverse=True)
    found = {r["doc_id"]: r for r in spotsigs.op9(spark, tiny).collect()}
    assert len(found) == len(docs)
    prints = {}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        n, r = len(text), found[i]
        edited = text[: n - n // 2] + after[: n // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        own, changed, other = (set(spotsigs.signatures(t).tolist()) for t in (text, edited, after))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r["near_edited"] - like(own, changed)) < 1e-12 and abs(r["near_next"] - like(own, other)) < 1e-12
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert np.mean([r["near_edited"] for r in found.values()]) > np.mean([r["near_next"] for r in found.values()])


def test_near_pairs(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    sets = {}
    for r in docs.orderBy("doc_id").collect():
        sets.setdefault(tuple(spotsigs.signatures(r["text"]).tolist()), r["doc_id"])
    named = [(i, set(s)) for s, i in sets.items() if s]
    want = {(min(a, b), max(a, b)) for a, x in named for b, y in named if a < b and len(x & y) >= 0.8 * len(x | y) - 1e-12}
    found = spotsigs.near_pairs(docs).collect()
    assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want) > 0
    for r in found:
        parts = [spotsigs.length_partition(len(s)) for i, s in named if i in (r["a"], r["b"])]
        assert abs(parts[0] - parts[1]) <= 1


def surrogate_map(spark, texts, key="k"):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in surrogates.with_surrogates(table, key=key).collect()}


def test_surrogates_keep_type_and_identity(spark):
    texts = [
        "Write to Jo.Doe+x@Mail.Example.org or +1 (988) 555-2485, card 4111 1111 1111 1111.",
        "jo.doe+x@mail.example.org; +1 988 555 2485; 10.0.0.7 and 300.1.1.1; Maria Garcia; Анна Иванова",
        "Maria Garcia, Maria Gomez, Mr. Garcia; nothing else: 2024-01-02, 3.14, v1.2.3",
        "clean text without any of it",
    ]
    r = surrogate_map(spark, texts)
    assert r[3]["text"] == texts[3] and r[3]["n_entities"] == 0
    a, b, c = (r[i]["text"] for i in range(3))
    mail = re.search(r"\S+@\S+", a).group()
    assert mail.lower() == re.search(r"\S+@[^;]+", b).group() and re.fullmatch(r"[A-Z]\w\.[A-Z]\w\w\+\w@[A-Z]\w{3}\.[A-Z]\w{6}\.org", mail)
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", a).group()
    assert re.sub(r"\D", "", phone) == re.sub(r"\D", "", re.search(r"\+1 \d{3} \d{3} \d{4}", b).group())
    card = re.search(r"4\d{3} \d{4} \d{4} \d{4}", a).group()
    digits = [int(x) for x in card.replace(" ", "")][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0
    assert "300.1.1.1" in b and "10.0.0.7" not in b and "2024-01-02, 3.14, v1.2.3" in c
    given, surname = re.search(r"; (\w+) (\w+); \w+ \w+$", b).groups()
    assert given in surrogates.GIVEN["latin female"] and given != "Maria"
    first, second, third = c.split(";")[0].split(", ")
    assert first == f"{given} {surname}" and third == f"Mr. {surname}" and second.split()[0] == given and second != first
    assert re.search(r"[А-Я][а-я]+ [А-Я][а-я]+$", b)
    assert surrogate_map(spark, texts, key="other")[0]["text"] != a


def test_surrogates_stay_distinct_in_a_crowded_space(spark):
    texts = [f"{c}{d}@x.org" for c in "abcdefghij" for d in "bcdfghjklmnp"]
    found = surrogate_map(spark, texts)
    new = [found[i]["text"] for i in range(len(texts))]
    assert len(set(new)) == len(texts) and not {t.split("@")[0] for t in new} & {t.split("@")[0] for t in texts if t in new}
    assert not set(new) & set(texts)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def grams(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain_leaks(docs, items):
    found = set()
    for item, it in items:
        k = min(5, len(words(it)))
        need = grams(it, k) if k else set()
        found |= {(d, item) for d, t in docs if need and len(need & grams(t, k)) >= 0.8 * len(need) - 1e-9}
    return found


def test_containment_of_short_items_and_borders(spark):
    item = " ".join(f"w{i}" for i in range(24))  # 20 shingles
    cut = lambda n: " ".join(f"w{i}" for i in range(n))
    docs = [(1, "x " * 50_000 + item.upper()), (2, cut(20)), (3, cut(19)), (4, "a b"), (5, "so: A, b! c"), (6, None)]
    items = [(10, item), (11, "a b"), (12, "q"), (13, None), (14, "")]
    found = decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 10), (2, 10), (4, 11), (5, 11)} == plain_leaks(docs, items)


def test_poisson_counts_have_the_right_mean_and_spread(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'abcd' AS text", "IF(id < 3000, 'big', 'small') AS source")
    weights = spark.createDataFrame([("big", 0.1), ("small", 0.9), ("none", 1.0)], "source string, weight double")
    weights = weights.filter("source <> 'none'")
    out = mixing.mix(docs, weights=weights, budget=16_000.0 * 20)
    n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["big"] - 8000) < 400 and abs(n["small"] - 72_000) < 1500  # rates 2.7 and 72
    assert out.select("doc_id", "copy").distinct().count() == sum(n.values())
    per = out.filter("source = 'small'").groupBy("doc_id").count().agg(F.var_pop("count")).first()[0]
    assert 60 < per < 85


def test_pipeline_equals_plain_stages(spark, tiny):
    rows = [r.asDict() for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    model = language.learn(spark.read.parquet(f"{tiny}/documents.parquet"))
    told = next(model.blocks()).score([r["text"] for r in rows])
    sure = told["lang"].notna() & (np.exp(told["top"] - told["total"]) >= language.MIN_SCORE)
    rows = [r for r, keep in zip(rows, sure) if keep]
    sites, first = {}, {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if s := line.strip(" "):
                sites.setdefault(s, set()).add(r["source"])
                first[s] = min(first.get(s, r["doc_id"]), r["doc_id"])
    kept = []
    for r in rows:
        lines = r["text"].split("\n")
        left = [x for x in lines if not (s := x.strip(" ")) or len(sites[s]) < linespread.MIN_SITES or first[s] == r["doc_id"]]
        if len(left) == len(lines) or "".join(left).strip(" "):
            kept.append(r | {"text": "\n".join(left)})
    prints = {r["doc_id"]: plain(r["text"]) for r in kept}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= simhash.MAX_BITS]
    groups = union(pairs, prints)
    kept = [r for r in kept if groups[r["doc_id"]] == r["doc_id"]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    leaked = {d for d, _ in plain_leaks([(r["doc_id"], r["text"]) for r in kept], items)}
    kept = {r["doc_id"]: r["text"] for r in kept if r["doc_id"] not in leaked}
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept and len(kept) < 200
    mixed = corpus_pipeline.run(spark, tiny).collect()
    assert {r["doc_id"] for r in mixed} <= set(kept) and all(r["text"] == kept[r["doc_id"]] for r in mixed)
    assert len({(r["doc_id"], r["copy"]) for r in mixed}) == len(mixed) > 0.6 * len(kept)


def test_the_lists_of_lost_lines_are_not_broadcast(spark):
    """The lists repeat few hashes, so their file is far smaller than their rows."""
    docs = spark.range(12).selectExpr("id AS doc_id", "'s' || id AS source", "'one line\nown ' || id AS text")
    out = linespread.drop_spread_lines(docs)
    assert sorted(r["text"] for r in out.collect())[:2] == ["one line\nown 0", "own 1"]
    assert "LeftOuter, BuildRight" not in out._jdf.queryExecution().executedPlan().toString()
