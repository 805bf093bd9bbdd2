"""SimHash against a plain version: bit counts in Python, all pairs, union-find."""

import random

import xxhash
from duskline.llm import simhash
from duskline.llm.components import components
from duskline.sources.scratch import settle


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_query_equals_all_pairs(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    prints = {i: plain(t) for i, t in texts.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    groups = union(near, prints)
    found = simhash.op8(spark, tiny).collect()
    assert len(near) > 5
    assert sorted(map(tuple, found)) == sorted((i, f"{prints[i]:016x}", groups[i]) for i in texts)


def test_spark_hash_is_the_same(spark):
    text = spark.createDataFrame([("one two three",)], "s string").selectExpr("s", "xxhash64(s) AS h").first()
    assert simhash.fingerprint(text["s"]) == text["h"]


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice(["ab", "c", "déf", "Gh"]) for _ in range(3000))
    want = simhash.fingerprint(text)
    for size in (1, 7, 64):
        monkeypatch.setattr(simhash, "_BLOCK", size)
        assert simhash.fingerprint(text) == want


def test_links_with_and_without_crowded_segments(spark):
    rng = random.Random(7)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            v = centre
            for _ in range(rng.randrange(4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    table = spark.createDataFrame([(v,) for v in signed], "f long")
    for bucket in (1, 5, 512):
        got = [tuple(r) for r in simhash.hamming_links(table, 2, bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    for bits in (0, 1, 3):
        want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
        assert {tuple(r) for r in simhash.hamming_links(table, bits).collect()} == want


def test_lookups_are_not_broadcast(spark):
    """700 values of one segment list 700,000 neighbours, which Spark takes to be as small as the values."""
    values = settle(spark.range(1400).selectExpr("if(id < 700, id * 4097, xxhash64(id)) AS f"), "values")
    links = simhash.hamming_links(values)
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Inner, Build" not in plan


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    edges += [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(40)]
    rng.shuffle(edges)
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = union(real, {n for e in real for n in e})
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == want and len(found) == len(want)
