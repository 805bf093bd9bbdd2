"""License notices in whole texts: diagonal voting of word k-grams, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from duskline.llm.catalog import query, table
from duskline.llm.text import shingle_hashes, words
from duskline.sources.scratch import settle

K = 3
#: An occurrence may be this many words longer than its template's words over ``COVERAGE``.
BAND = 4
#: Share of a template's words that an occurrence must have, in their order.
COVERAGE = 0.8
#: A matched word is worth this many words put in between.
WORTH = 8

#: Phrases whose words must stand consecutively.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Wordings of public licenses and notices, found in spite of small edits.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files the software to deal in the software without restriction": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in "
    "compliance with the license": "apache-2",
    "unless required by applicable law or agreed to in writing software distributed under the "
    "license is distributed on an as is basis without warranties or conditions of any kind": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the "
    "gnu lesser general public license as published by the free software foundation": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without "
    "fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


def templates() -> list[tuple[int, str, str, bool]]:
    """(template, words, label, base) of every phrase and notice."""
    return [(i, text, label, text in PHRASES) for i, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()])]


def template_grams(spark: SparkSession, k: int = K) -> DataFrame:
    """(template, label, base, t, n_grams, at, gram): the hash of every k-gram of every template, with its words."""
    cut = spark.createDataFrame(templates(), "template int, text string, label string, base boolean")
    cut = cut.withColumn("t", F.split("text", " ")).withColumn("g", shingle_hashes(F.col("t"), k))
    return cut.select("template", "label", "base", "t", F.size("g").alias("n_grams"), F.posexplode("g").alias("at", "gram"))


def _aligned(text: Column, first: Column, template: Column) -> Column:
    """struct(u, matched, start, last): the best run of template words that the text has in order.

    A matched word adds ``WORTH``, a text word put in between costs one, a template word left out
    nothing but the match. One cell per template word holds the best alignment that ends there;
    ``q`` is its value plus the place of its last word, so cells need no update while text passes.
    """
    cell = "struct<q:int,start:int,best:struct<u:int,matched:int,start:int,last:int>>"
    gain = WORTH + 1
    none = F.transform(template, lambda _: F.lit(None).cast(cell))
    placed = F.transform(text, lambda word, i: F.struct((first + i).cast("int").alias("p"), word.alias("word")))

    def reached(cells, c, j, p):
        before = F.array_max(F.transform(F.slice(cells, 1, j), lambda b: F.when(b.isNotNull(), F.struct(b["q"], b["start"]))))
        from_ = F.greatest(before, F.struct(p.alias("q"), p.alias("start")))

        def extended(f):
            q = f["q"] + gain
            found = F.struct(
                (q - p).alias("u"), ((q - f["start"]) / gain).cast("int").alias("matched"), f["start"].alias("start"), p.alias("last")
            )
            better = c.isNull() | (q > c["q"])
            return F.struct(
                F.when(better, q).otherwise(c["q"]).alias("q"),
                F.when(better, f["start"]).otherwise(c["start"]).alias("start"),
                F.greatest(c["best"], found).alias("best"),
            ).cast(cell)

        return F.element_at(F.transform(F.array(from_), extended), 1)

    def step(cells, x):
        update = lambda c, j: F.when(F.get(template, j) == x["word"], reached(cells, c, j, x["p"])).otherwise(c)
        return F.when(F.array_contains(template, x["word"]), F.transform(cells, update)).otherwise(cells)

    return F.aggregate(placed, none, step, lambda cells: F.array_max(F.transform(cells, lambda c: c["best"])))


_SPAN = "struct<share:double,matched:int,start:int,last:int,label:string>"


def _best_of_overlapping(spans: Column) -> Column:
    """The spans, best-covered first, that do not share half of the shorter one's words with a better one."""

    def clash(a, b):
        shared = F.least(a["last"], b["last"]) - F.greatest(a["start"], b["start"]) + 1
        return 2 * shared > F.least(a["last"] - a["start"], b["last"] - b["start"]) + 1

    def step(kept, s):
        return F.when(F.exists(kept, lambda a: clash(a, s)), kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(F.sort_array(spans, asc=False), F.array().cast(f"array<{_SPAN}>"), step)


def license_marks(
    docs: DataFrame, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE, band: int = BAND, k: int = K
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_base, first_word, last_word, base_labels,
    labels, score, n_spans.

    Every k-gram hash of the text that a template has votes for its diagonal, text position minus
    template position. A phrase that stands there word for word fills its diagonal, which gives
    the exact places of the base phrases once their words are compared. For a notice of n words,
    up to e = n - ceil(coverage n) words may be changed, left out or put in; each costs k votes
    at most and moves the rest by one diagonal, so the diagonals of an occurrence, taken
    together, keep n - k + 1 - k e votes. Diagonals whose following neighbours bring them to
    that many are merged into candidate spans, the rest is dropped. Each candidate is verified
    once against the words of the text: template words are matched in order, each once, so one
    edit costs one word. A span counts if it has ``coverage`` of the template's words within a
    length that fits. With more than e edits a notice may be found or not. Where spans overlap the best-covered one stays, of equals the longer: an
    LGPL notice is no GPL notice. A CC notice whose one distinguishing word was changed has all
    words of CC BY and is that. ``score`` is the largest share of a template that was found, by votes for
    phrases and by verified words for notices,
    ``n_spans`` the number of base phrases and notices.

    Null or empty text has no words and no labels; labels that are missing are an empty string,
    places null. A null or repeated key is kept row by row; an empty table gives no rows; other
    columns are not read. Only the surroundings of known k-grams leave the scan and are written
    once, a row per document if nothing matched; the join's build side is the fixed list above.
    """
    spark = docs.sparkSession
    grams_of = template_grams(spark, k)
    known = sorted(r["gram"] for r in grams_of.select("gram").distinct().collect())  # as many as the list above has
    sizes = [len(t.split()) for _, t, _, _ in templates()]
    longest = max(sizes)
    merge = max(band, *(n - math.ceil(round(coverage * n, 9)) for n in sizes))
    reach = math.ceil(longest / coverage) + band + longest
    row = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words(F.col(text), only_ascii=True).alias("w")
    )
    grams = row.withColumn("g", shingle_hashes(F.col("w"), k))
    number = F.sequence(F.lit(0), F.size("g") - 1)
    held = F.filter(number, lambda i: F.get(F.col("g"), i).isin(known))
    hits = grams.select("row", "key", "w", F.when(F.size("g") > 0, held).otherwise(F.array().cast("array<int>")).alias("hits"))
    at = F.col("hits")
    opens = F.filter(at, lambda x, i: (i == 0) | (x - F.get(at, i - 1) > reach))
    closes = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) - x > reach))
    ends = hits.select("row", "key", "w", F.arrays_zip(opens.alias("low"), closes.alias("high")).alias("ends"))

    def around(e):
        first = F.greatest(e["low"] - reach, F.lit(0))
        part = F.slice(F.col("w"), first + 1, e["high"] + (k + reach) - first)
        return F.struct(first.alias("first"), e["low"].alias("low"), e["high"].alias("high"), part.alias("part"))

    parts = ends.select(
        "row", "key", F.size("w").cast("long").alias("n_words"), F.explode_outer(F.transform("ends", around)).alias("r")
    ).select("row", "key", "n_words", "r.*")
    parts = settle(parts, "license_parts")
    found = parts.filter("low IS NOT NULL").select(
        "row", "first", "low", "high", F.posexplode(shingle_hashes(F.col("part"), k)).alias("pos", "gram")
    )
    found = found.withColumn("pos", F.col("pos") + F.col("first")).filter("pos BETWEEN low AND high")
    template = ["template", "label", "base", "n_grams"]
    votes = found.join(F.broadcast(grams_of), "gram").groupBy(
        "row", "first", *template, "t", (F.col("pos") - F.col("at")).alias("diagonal")
    ).agg(F.count("*").alias("votes"))
    votes = settle(votes, "license_votes")
    texts = parts.select("row", "first", "part")

    there = F.slice("part", F.col("diagonal") - F.col("first") + 1, F.size("t"))
    full = votes.filter(F.col("base") & (F.col("votes") == F.col("n_grams"))).join(texts, ["row", "first"])
    full = full.filter(there == F.col("t")).groupBy("row").agg(
        F.count("*").alias("n_base"),
        F.min("diagonal").cast("long").alias("first_word"),
        F.max("diagonal").cast("long").alias("last_word"),
        F.collect_set("label").alias("base"),
    )
    partly = votes.filter("base").groupBy("row").agg(F.max(F.col("votes") / F.col("n_grams")).alias("base_share"))
    phrases = partly.join(full, "row", "left")

    n = F.size("t")
    edits = n - F.ceil(F.round(F.lit(coverage) * n, 9)).cast("int")
    enough = F.greatest(F.col("n_grams") - k * edits, F.lit(1))
    place = Window.partitionBy("row", "first", "template").orderBy("diagonal")
    merged = votes.filter("NOT base").withColumn("sum", F.sum("votes").over(place.rangeBetween(0, merge)))
    merged = merged.filter(F.col("sum") >= enough)
    # Runs of neighbours, cut into stretches of ``merge`` so that a candidate's window is bounded.
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(place) > merge, F.lit(True))
    upto = place.rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn("opens", opens).withColumn("run", F.max(F.when(F.col("opens"), F.col("diagonal"))).over(upto))
    stretch = F.floor((F.col("diagonal") - F.col("run")) / (merge + 1))
    candidates = merged.groupBy("row", "first", "template", "label", "t", "run", stretch.alias("stretch")).agg(
        F.min("diagonal").alias("low")
    )

    # From the words that may be left out before the lowest diagonal to the longest length that
    # fits. That holds n + e words from every diagonal of the stretch on, but no second occurrence.
    fits = F.floor(n / F.lit(coverage)).cast("int") + band
    begin = F.greatest(F.col("low") - F.ceil(n * F.lit(1 - coverage)).cast("int") - band, F.col("first"))
    window = F.slice("part", begin - F.col("first") + 1, F.col("low") + fits + band - begin)
    asked = candidates.join(texts, ["row", "first"])
    asked = asked.select("row", "template", "label", "t", begin.alias("begin"), window.alias("window"))
    asked = asked.withColumn("s", _aligned(F.col("window"), F.col("begin"), F.col("t")))
    share = F.when(F.col("s.last") - F.col("s.start") + 1 <= fits, F.col("s.matched") / n).otherwise(F.lit(0.0))
    spans = asked.select("row", "label", "template", "s.matched", "s.start", "s.last", share.alias("share")).distinct()
    # Spans that overlap, also through others, are one cluster.
    before = Window.partitionBy("row").orderBy("start", "last", "template").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "last", "template").rowsBetween(Window.unboundedPreceding, 0)
    good = spans.filter(F.col("share") >= coverage)
    good = good.withColumn("new", F.when(F.col("start") > F.max("last").over(before), 1).otherwise(0))
    good = good.withColumn("cluster", F.sum("new").over(upto))
    one = F.struct("share", "matched", "start", "last", "label")
    kept = good.groupBy("row", "cluster").agg(_best_of_overlapping(F.collect_list(one)).alias("kept"))
    kept = kept.select("row", F.explode("kept.label").alias("label")).groupBy("row").agg(
        F.collect_set("label").alias("notices"), F.count("*").alias("n_notices")
    )
    best = spans.groupBy("row").agg(F.max("share").alias("share"))
    rows = parts.groupBy("row", "key", "n_words").agg(F.lit(1).alias("one"))
    none = F.array().cast("array<string>")
    base = F.coalesce("base", none)
    n_base = F.coalesce("n_base", F.lit(0))
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    return rows.join(phrases, "row", "left").join(kept, "row", "left").join(best, "row", "left").select(
        F.col("key").alias(key),
        "n_words",
        n_base.alias("n_base"),
        "first_word",
        "last_word",
        joined(base).alias("base_labels"),
        joined(F.array_union(base, F.coalesce("notices", none))).alias("labels"),
        F.greatest(F.coalesce("base_share", F.lit(0.0)), F.coalesce("share", F.lit(0.0))).alias("score"),
        (n_base + F.coalesce("n_notices", F.lit(0))).alias("n_spans"),
    )


@query("op2_license_scan")
def op2(spark, sf_dir):
    """License labels of every document."""
    return license_marks(table(spark, sf_dir, "documents"))
