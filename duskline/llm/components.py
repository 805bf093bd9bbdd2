"""Connected components of a graph that stays in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from duskline.operators.joins import grown
from duskline.sources.scratch import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node each node can reach, for nodes with an edge.

    Alternates two rewritings of the edges until nothing changes: the first ties the larger
    neighbours of a node to its smallest neighbour, the second its smaller ones. A minimum is
    pre-aggregated and comes back by an equi-join with one row per node, so a node with very
    many neighbours is split by the adaptive skew join. Rounds grow with the logarithm of the
    longest path. Every round is written to the shared folder, so a lost executor costs one
    round at most. Nulls and self-loops are no edges; no edges give no rows.
    """
    links = settle(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "links",
    )
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        larger = both.join(grown(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(larger.distinct(), "large")
        # Every row of `large` points down, so u's smaller neighbours are its own rows.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        smaller = large.join(grown(low), "u")
        links = settle(
            smaller.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct(),
            "links",
        )
        now = links.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
        ).first()
        if now == state:
            break
        state = now
    # Stars: every node but the centres has one row.
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
