"""Secrets in whole texts, told from copied examples by who owns them; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duskline.llm.catalog import query, table
from duskline.llm.text import whole
from duskline.sources.scratch import settle

#: The base patterns, in the order in which spans with one start are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
#: Further shapes of credentials, taken only if few own them. Starts are bounded or
#: kept to the start of a run, so a very long run of letters is read once and not from each place.
#: Only single characters are repeated without bound: the engine recurses on every round of a group.
EXTRA = {
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "forge": r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})",
    "pem": r"-----BEGIN (?:[A-Z0-9]{1,20}+ ){0,4}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END (?:[A-Z0-9]{1,20}+ ){0,4}PRIVATE KEY-----",
    "url": r"[a-z][a-z0-9+.-]{1,30}://[^\s:/@]++:[^\s:/@]{6,}+@[A-Za-z0-9.-]+",
    "mixed": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}",
}
MIN_VALUE = 8
PIECE = 256
#: A value that more owners have in more repositories, or that two more owners have, is a copied
#: example.
MAX_OWNERS = 1
MAX_REPOSITORIES = 4
#: So is one in more repositories than these, whoever owns them.
MAX_OWN = 20
_SPAN = "struct<kind:string,rank:int,start:bigint,end:bigint,value:bigint>"


def _spans(text: Column, kind: str, rank: int, pattern: str) -> Column:
    """array(struct(kind, rank, start, end, value)) of all matches, leftmost and not overlapping.

    The text between the matches and the matches themselves have the lengths that give the places.
    They are added up within pieces of ``PIECE`` matches and then over the pieces, as a list that
    is appended to is copied each time.
    """
    parts = F.arrays_zip(
        F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    pieces = lambda x: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PIECE).cast("int")), lambda k: F.slice(x, k * PIECE + 1, PIECE)
    )

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        secret = F.regexp_extract(x["hit"], pattern, 2) if kind == "assign" else x["hit"]
        span = F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.cast("bigint").alias("start"),
            end.cast("bigint").alias("end"), F.xxhash64(secret).alias("value"),
        )
        good = x["hit"].isNotNull()
        if kind == "assign":
            good = good & (F.length(secret) >= MIN_VALUE)
        return F.struct(
            F.coalesce(end, acc["at"]).cast("bigint").alias("at"),
            F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    none = F.array().cast(f"array<{_SPAN}>")
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), none.alias("spans"))
    found = F.transform(F.flatten(F.transform(F.array(parts), pieces)), lambda piece: F.aggregate(piece, start, step))

    def after(acc, piece):
        moved = F.struct(acc["at"].alias("by"), piece["spans"].alias("spans"))
        return F.struct(
            (acc["at"] + piece["at"]).alias("at"), F.concat(acc["pieces"], F.array(moved)).alias("pieces")
        )

    empty = F.array().cast(f"array<struct<by:bigint,spans:array<{_SPAN}>>>")
    placed = F.aggregate(found, F.struct(zero.alias("at"), empty.alias("pieces")), after, lambda acc: acc["pieces"])
    shifted = lambda s, by: F.struct(
        s["kind"].alias("kind"), s["rank"].alias("rank"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"),
        s["value"].alias("value"),
    )
    spans = F.flatten(F.transform(placed, lambda x: F.transform(x["spans"], lambda s: shifted(s, x["by"]))))
    return F.when(F.regexp(text, F.lit(pattern)), spans).otherwise(none)


def _listed(spans: Column) -> Column:
    """kind:start:end by start and then kind as listed, comma-joined."""
    by_place = lambda a, b: (
        F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        .when(a["rank"] != b["rank"], F.when(a["rank"] < b["rank"], -1).otherwise(1))
        .otherwise(0)
    )
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans, by_place), shown), ",")


def secret_spans(
    docs: DataFrame,
    key: str = "doc_id",
    repository: str = "doc_id",
    owner: str = "source",
    text: str = "text",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
    max_own: int = MAX_OWN,
) -> DataFrame:
    """One row per row of ``docs``: key, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    Base spans always stay. Candidates of further shapes, and the values of the base spans, are
    hashed and counted over the whole corpus by distinct repositories and owners, where copies of
    one text are in one repository, the least of theirs. A value is an example that was copied
    around if more than ``max_owners`` owners have it in more than ``max_repositories``
    repositories, if more than ``max_owners`` + 1 owners have it, or if it is in more than
    ``max_own`` repositories. Any other looks live, so also one whose document was copied to a
    second owner. Only live further candidates are added. ``n_live`` and ``n_copied`` count
    a document's spans, of all kinds, by that verdict.

    Null text is empty and has no spans; the digest is then that of an empty string. A null owner
    or repository is one of its own. Rows that repeat a key are kept row by row but are one
    repository; an empty table gives no rows; other columns are not read.

    Spans, without texts, are written once. Counting pre-aggregates by value, text,
    owner and repository, so a value that a third of all documents share is a few rows per task; the
    verdicts are one row per value and are joined with the spans only.
    """
    body = whole(F.col("t"))
    found = [_spans(body, kind, i, p) for i, (kind, p) in enumerate((BASE | EXTRA).items())]
    rows = settle(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
            F.col(repository).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"),
            F.col(text).alias("t"),
        ).select("row", "key", "repo", "owner", F.xxhash64(body).alias("copy"), F.concat(*found).alias("spans")),
        "secret_spans",
    )
    spotted = rows.filter(F.size("spans") > 0).select("row", "repo", "owner", "copy", F.explode("spans").alias("s"))
    valued = spotted.withColumn("value", F.col("s.value"))
    owners = valued.groupBy("value", "owner").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("*").alias("owners"))
    texts = valued.groupBy("value", "copy").agg(F.min(F.struct("owner", "repo")).alias("place"))
    places = texts.groupBy("value", "place").agg(F.lit(1).alias("one"))
    repos = places.groupBy("value").agg(F.count("*").alias("repos"))
    shared = (F.col("owners") > max_owners) & (F.col("repos") > max_repositories)
    copied = shared | (F.col("owners") > max_owners + 1) | (F.col("repos") > max_own)
    owned = settle(owners.join(repos, "value").select("value", (~copied).alias("live")), "ownership")
    judged = valued.select("row", "s", "value").join(owned, "value")
    judged = judged.groupBy("row").agg(F.collect_list(F.struct("s.*", "live")).alias("judged"))
    is_base = lambda s: s["rank"] < len(BASE)
    base = F.filter("spans", is_base)
    several = F.coalesce(F.col("judged"), F.array())
    kept = F.filter(several, lambda s: is_base(s) | s["live"])
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.join(judged, "row", "left").select(
        F.col("key").alias(key),
        *[number(kind) for kind in BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(kept).alias("spans"),
        F.size(F.filter(several, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(several, lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


@query("op4_secret_scan")
def op4(spark, sf_dir):
    """Secrets of every document."""
    return secret_spans(table(spark, sf_dir, "documents"))
