"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duskline.llm.catalog import query, table
from duskline.llm.text import spare, whole
from duskline.sources.scratch import settle

SEED = 11
#: Target weight of a source: its share of the characters to this power.
TEMPERATURE = 0.5
#: A rate above this is drawn as a sum of independent Poisson numbers, so that no inversion table
#: and no array of copies grows with the rate.
STEP = 32.0
#: Entries of an inversion table: P(Poisson(32) > 127) is below 1e-30.
TABLE = 128
_BITS = 52


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the keys alone."""
    text = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *text))
    return (F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double") + 0.5) / F.lit(2.0**_BITS)


def _cumulative(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson number with mean ``rate``."""
    start = F.struct(
        F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"), F.exp(-rate).alias("t")
    )
    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(acc["t"] + p)).alias("c"), (acc["t"] + p).alias("t"))

    steps = F.sequence(F.lit(1), F.lit(TABLE - 1))
    return F.aggregate(steps, start, step, lambda acc: acc["c"])


def repetition_rates(
    docs: DataFrame,
    weights: DataFrame | None = None,
    budget: float | None = None,
    temperature: float = TEMPERATURE,
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """(source, rate): how often the documents of each source are to be repeated on average.

    ``weights`` (source, weight) are the shares of characters wanted of each source in a result of
    ``budget`` characters (as many as there are now if not given); they need not sum to one, and
    a source without a weight gets none. Without ``weights`` a source's weight is its share of
    the characters to the power ``temperature``. Null is a source of its own. Sources without a
    character have rate zero.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.length(whole(F.col(text))).cast("long")).alias("size")
    )
    sizes = settle(sizes.filter(F.col("size") > 0), "source_sizes")  # one row per source
    total = sizes.agg(F.sum("size")).first()[0] or 0
    wanted = float(total if budget is None else budget)
    if weights is None:
        rated = sizes.withColumn("weight", F.pow(F.col("size") / F.lit(float(total or 1)), F.lit(temperature)))
    else:
        named = weights.select(F.col("source").alias("s"), F.col("weight").cast("double"))
        rated = sizes.join(named, sizes["source"].eqNullSafe(named["s"]), "left").drop("s").fillna(0.0, ["weight"])
    norm = rated.agg(F.sum("weight")).first()[0] or 1.0
    return rated.select("source", (F.col("weight") / F.lit(norm) * F.lit(wanted) / F.col("size")).alias("rate"))


def mix(
    docs: DataFrame,
    seed: int = SEED,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    copy: str = "copy",
    order: str = "shuffle_key",
    **options,
) -> DataFrame:
    """Every document as often as a Poisson number with its source's rate says, in random order.

    The number inverts the Poisson distribution at a uniform hash of seed, key and part, so it
    does not depend on partitions, order or reruns. A rate above ``STEP`` is split into parts
    that are drawn on their own. ``copy`` numbers the copies of a row from zero (each part on from
    a multiple of ``TABLE``); ``order`` is a uniform number by which the whole result is dealt to
    partitions and sorted, so partitions in their order are one global shuffle.

    Texts are not inspected beyond their length: long ones are copied like any other, null and
    empty ones weigh nothing but are drawn by their source's rate. Rows that repeat a key get the
    same number of copies. Rows of a source of rate zero go; an empty table stays empty. All
    columns are kept; where one is already called ``copy`` or ``order``, the new one gets
    underscores after its name.

    The rates are one row per source, settled, so Spark knows their size; each is repeated over
    ``salts`` so that a source with a third of all rows is not one task should they not be
    small enough to broadcast.
    """
    copy, order = spare(docs, copy), spare(docs, order)
    rate = settle(repetition_rates(docs, source=source, text=text, **options).filter("rate > 0"), "rates")
    parts = F.ceil(F.col("rate") / STEP)
    salts = 16
    table_of = rate.select(
        F.col("source").alias("_s"), parts.alias("_parts"), (F.col("rate") / parts).alias("_r")
    )
    table_of = settle(table_of.select("_s", "_parts", _cumulative(F.col("_r")).alias("_cdf")), "inversion")
    table_of = table_of.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    part, n, i = spare(docs, "_part"), spare(docs, "_n"), spare(docs, "_i")
    salted = F.pmod(F.xxhash64(F.col(f"d.{key}")), F.lit(salts)).cast("int")
    drawn = docs.alias("d").join(
        table_of.alias("r"), F.col(f"d.{source}").eqNullSafe(F.col("r._s")) & (salted == F.col("r._salt"))
    )
    cols = [F.col(f"d.`{c}`") for c in docs.columns]
    drawn = drawn.select(*cols, F.col("r._cdf").alias(n), F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("r._parts") - 1)).alias(part))
    u = uniform(seed, F.col(key), F.col(part))
    count = F.transform(F.array(u), lambda x: F.size(F.filter(F.col(n), lambda c: c < x)))[0]
    drawn = drawn.withColumn(n, count).filter(F.col(n) > 0)
    copies = drawn.withColumn(i, F.explode_outer(F.sequence(F.lit(0), F.col(n) - 1)))
    numbered = copies.withColumn(copy, F.col(part) * TABLE + F.col(i)).drop(part, n, i)
    keyed = numbered.withColumn(order, uniform(seed + 1, F.col(key), F.col(copy)))
    spread = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keyed.repartitionById(spread, F.floor(F.col(order) * spread).cast("int")).sortWithinPartitions(order, key)


_U = "(('0x' || substr(md5(concat_ws('|', '{seed}', coalesce(doc_id::VARCHAR, ''), {part}::VARCHAR)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"

SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
weights AS (SELECT source, size, pow(size / sum(size) OVER (), {TEMPERATURE}) AS w, sum(size) OVER () AS total
  FROM sizes WHERE size > 0),
rates AS (SELECT source, w / sum(w) OVER () * total / size AS rate FROM weights),
split AS (SELECT source, ceil(rate / {STEP})::BIGINT AS parts, rate / ceil(rate / {STEP}) AS r FROM rates),
pmf AS (
  SELECT source, 0 AS k, exp(-r) AS p, exp(-r) AS c, r FROM split
  UNION ALL
  SELECT source, k + 1, p * r / (k + 1), c + p * r / (k + 1), r FROM pmf WHERE k + 1 < {TABLE}),
cdf AS (SELECT source, list(c ORDER BY k) AS cs FROM pmf GROUP BY source),
drawn AS (
  SELECT d.*, part, {_U.format(seed=SEED, part='part')} AS u, cs
  FROM (SELECT d.*, unnest(range(0, parts)) AS part FROM documents d JOIN split s ON d.source IS NOT DISTINCT FROM s.source) d
  JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
copies AS (
  SELECT doc_id, text, lang, source, n_chars,
         part * {TABLE} + unnest(range(0, len(list_filter(cs, lambda x: x < u)))) AS copy FROM drawn)
SELECT *, {_U.format(seed=SEED + 1, part='copy')} AS shuffle_key FROM copies
"""


@query("op1_mixing", SQL)
def op1(spark, sf_dir):
    """All documents, sources weighted by the square root of their share of the characters."""
    return mix(table(spark, sf_dir, "documents"))
