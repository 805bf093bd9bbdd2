"""Seeded draws: anchors, matched controls, samples, folds.

Every draw is a function of ``md5(seed|key)``. Exact sizes come from a histogram over the
leading digest bits, never from one global or per-class sort: a class, date or set may
hold most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from duskline.functions.dates import compose_period
from duskline.functions.seeds import SLOT_BITS, digest, seeded_bucket, slot
from duskline.operators.joins import grown, null_safe, salted_join
from duskline.sources.scratch import settle

CELL_BITS = 12


def take_seeded(
    df: DataFrame,
    key: list[str],
    n: Column | int,
    seed: int,
    by: list[str] = (),
    cell_bits: int = CELL_BITS,
) -> DataFrame:
    """Exactly the first ``n`` rows of each group in seeded order.

    ``n`` may be a column that is constant within the group. Digests are uniform, so a
    group falls into 2**cell_bits even cells. Counting the cells finds the one where the
    quota runs out: rows of the cells before it pass by a filter, without being shuffled for
    it, and only the rows of that one cell are ranked. ``df`` is read three times: settle it
    if it is costly.
    """
    limit = F.lit(n) if isinstance(n, int) else n
    by = list(by)
    marked = (
        df.withColumn("_m", digest(seed, *key))
        .withColumn("_cell", F.shiftright(slot(F.col("_m")), SLOT_BITS - cell_bits))
        .withColumn("_quota", limit.cast("long"))
    )
    cells = marked.groupBy(*by, "_cell").agg(
        F.count(F.lit(1)).alias("_n"), F.first("_quota").alias("_limit")
    )
    # At most 2**cell_bits rows per group.
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_left", F.col("_limit") - F.coalesce(F.sum("_n").over(before), F.lit(0)))
    last = F.max(F.struct("_cell", "_left"))
    edge = cells.filter(F.col("_left") > 0).groupBy(*by).agg(last.alias("_e"))
    edge = settle(edge.select(*by, F.col("_e._cell").alias("_edge"), F.col("_e._left").alias("_left")), "edges")
    if by:
        # A group without a name is still a group: null must meet null. One row per group.
        met = marked.alias("_l").join(edge.alias("_r"), null_safe(by, "_l", "_r"))
    else:
        one = edge.select(F.struct("_edge", "_left").alias("e")).scalar()
        met = marked.withColumn("_e", one).select("*", "_e._edge", "_e._left").alias("_l")
    out = [F.col(f"_l.{c}").alias(c) for c in df.columns]
    full = met.filter(F.col("_cell") < F.col("_edge")).select(*out)
    rank = Window.partitionBy(*by).orderBy("_m", *key)
    ranked = met.filter(F.col("_cell") == F.col("_edge")).select(*out, "_m", "_left")
    ranked = ranked.withColumn("_rn", F.row_number().over(rank)).filter(F.col("_rn") <= F.col("_left"))
    return full.unionByName(ranked.select(*df.columns))


def sample_n(ids: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n entities without replacement."""
    return take_seeded(ids, [key], n, seed)


def shuffle_rows(df: DataFrame, seed: int, key: list[str], name: str = "shuffle_key") -> DataFrame:
    """A seeded order as a column; nothing downstream reads physical row order."""
    return df.withColumn(name, digest(seed, *key))


def first_fraction(df: DataFrame, fraction: float, seed: int, key: list[str]) -> DataFrame:
    """Exactly floor(``fraction`` n) of the n rows, the first in seeded order.

    The rows are counted, then taken as ``take_seeded`` does, so ``df`` is read four times:
    settle it if it is costly. Null keys are values; of rows with one key any may be taken; an
    empty table gives no rows.
    """
    share = F.floor(F.round(F.lit(fraction) * F.count(F.lit(1)), 9)).cast("long")
    return take_seeded(df, key, df.select(share.alias("n")).scalar(), seed)


def head_fraction(df: DataFrame, fraction: float, seed: int, key: list[str]) -> DataFrame:
    """About a fraction of the rows, by digest, without counting or sorting."""
    bound = int(fraction * 2**SLOT_BITS)
    return df.filter(slot(digest(seed, *key)) < bound)


def one_per_id(df: DataFrame, seed: int, keys: list[str], tie: list[str]) -> DataFrame:
    """One random row per key."""
    w = Window.partitionBy(*keys).orderBy(digest(seed, *keys, *tie), *tie)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def assign_folds(
    df: DataFrame,
    k: int,
    seed: int,
    key: list[str],
    name: str = "fold",
    label: str | None = None,
    cell_bits: int = CELL_BITS,
) -> DataFrame:
    """Fold 0..k-1 of each row.

    With ``label`` the folds are stratified: a row's fold is its seeded rank within its class
    modulo k, so a class's rows differ by one at most between folds. The rank is the rows of the
    class in earlier digest cells, at most 2**cell_bits counts, and the rank within the cell, so
    no class is sorted whole. Without it the fold follows from the key alone, without a shuffle,
    and classes are even only on average.
    """
    if label is None:
        return df.withColumn(name, seeded_bucket(k, seed, *key))
    marked = df.withColumn("_m", digest(seed, *key)).withColumn(
        "_cell", F.shiftright(slot(F.col("_m")), SLOT_BITS - cell_bits)
    )
    on = [label, "_cell"]
    before = Window.partitionBy(label).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = marked.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.select(*on, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*[F.col(f"_l.{c}") for c in on]).orderBy("_m", *[F.col(f"_l.{c}") for c in key])
    rank = F.row_number().over(inside) - 1 + F.col("_before")
    joined = marked.alias("_l").join(cells.alias("_r"), null_safe(on, "_l", "_r"))
    return joined.select(*[F.col(f"_l.{c}").alias(c) for c in df.columns], (rank % k).cast("int").alias(name))


def fold_split(df: DataFrame, fold: int, name: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, validate) for one fold."""
    return df.filter(F.col(name) != fold), df.filter(F.col(name) == fold)


def downsample(
    df: DataFrame, label: str, ratio: int, seed: int, key: list[str], by: list[str] = ()
) -> DataFrame:
    """All positive rows and ``ratio`` times as many negative ones, per group if given."""
    by = list(by)
    positives = df.filter(F.col(label) == 1)
    negatives = df.filter(F.col(label) == 0)
    if by:
        wanted = positives.groupBy(*by).agg((F.count(F.lit(1)) * ratio).alias("_want"))
        # Few groups, many rows: spread each group before it meets its count.
        counted = salted_join(negatives, wanted, by, key, how="inner")
        kept = take_seeded(counted, key, F.col("_want"), seed, by).drop("_want")
    else:
        want = positives.agg((F.count(F.lit(1)) * ratio).alias("w")).scalar()
        kept = take_seeded(negatives, key, want, seed)
    return positives.unionByName(kept)


def anchors_fixed(ids: DataFrame, years: list[int], month: int | list[int]) -> DataFrame:
    """Each entity at a fixed calendar month of every year."""
    months = [month] if isinstance(month, int) else month
    dates = F.array(*[F.make_date(F.lit(y), F.lit(m), F.lit(1)) for y in years for m in months])
    return ids.select("*", F.explode(dates).alias("event"))


def anchors_random(ids: DataFrame, year: int, seed: int) -> DataFrame:
    """Each entity at a random month of one year."""
    return ids.withColumn(
        "event", compose_period(F.lit(year), seeded_bucket(12, seed, "id") + F.lit(1))
    )


def control_quotas(events: DataFrame, ratio: Column | int, by: list[str] = ()) -> DataFrame:
    """Controls wanted per event month: ``ratio`` times its events."""
    r = F.lit(ratio) if isinstance(ratio, int) else ratio
    return events.groupBy(*by, "event").agg(F.count(F.lit(1)).alias("_events")).select(
        *by, "event", (F.col("_events") * r).alias("quota")
    )


def deal_controls(
    pool: DataFrame, quotas: DataFrame, seed: int, by: list[str] = ()
) -> DataFrame:
    """Give every pool entity one event month, in proportion to the quotas.

    The months of a group lie end to end on a line of length Q = sum of quotas; an entity
    falls on ``slot % Q``. The line is an array of at most one entry per calendar month,
    which is what bounds the broadcast below. ``by`` names the groups that are dealt
    separately (a ratio, a year); the pool carries them as columns.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy("event")
    line = (
        quotas.withColumn("_hi", F.sum("quota").over(w))
        .groupBy(*by)
        .agg(
            F.sum("quota").alias("_total"),
            F.array_sort(F.collect_list(F.struct("_hi", "event", "quota"))).alias("_line"),
        )
    )
    if by:
        placed = pool.join(F.broadcast(line), by)
    else:
        one = line.agg(F.first(F.struct("_total", "_line")).alias("s")).scalar()
        placed = pool.withColumn("_s", one).select("*", "_s._total", "_s._line").drop("_s")
    spot = slot(digest(f"{seed} deal", *by, "id")) % F.col("_total")
    # The spot is bound to a lambda variable so that it is hashed once per entity and not
    # once per month of the line.
    hit = F.transform(F.array(spot), lambda s: F.filter("_line", lambda x: x["_hi"] > s)[0])[0]
    return placed.withColumn("_hit", hit).select(
        *pool.columns, F.col("_hit.event").alias("event"), F.col("_hit.quota").alias("quota")
    )


def match_controls(
    pool: DataFrame,
    quotas: DataFrame,
    seed: int,
    filled=None,
    min_filled: int = 1,
    by: list[str] = (),
    fill: bool = False,
) -> DataFrame:
    """Controls matched to the event calendar, each pool row used once.

    Deal, drop entities whose row at the dealt month would be too empty, then keep the
    quota of each month in seeded order. ``filled`` maps (id, event) anchors to a table
    with a ``filled`` count of non-zero cells; it never builds the wide row, so only
    accepted controls are widened later. A month that falls short in the deal stays short
    (see ``control_shortfall``) unless ``fill`` asks for ``fill_open``.

    Counting the cells is the one pass over the panel. The dealt pool before it and its
    narrow result are settled, because both are read more than once.
    """
    by = list(by)
    dealt = deal_controls(pool, quotas, seed, by)
    if filled is not None:
        dealt = settle(
            filled(settle(dealt, "dealt")).filter(F.col("filled") >= min_filled).drop("filled"), "accepted"
        )
    kept = take_seeded(dealt, [*by, "id"], F.col("quota"), seed, [*by, "event"]).drop("quota")
    return fill_open(pool, quotas, kept, seed, filled, min_filled, by) if fill else kept


def fill_open(
    pool: DataFrame,
    quotas: DataFrame,
    kept: DataFrame,
    seed: int,
    filled=None,
    min_filled: int = 1,
    by: list[str] = (),
    slack: int = 4,
) -> DataFrame:
    """``kept`` with more controls, until no month is short while an unused entity could serve it.

    The first round takes of every short group's unused entities about ``slack`` times its largest gap,
    asks them for every open month of the group, and only their windows are checked; an entity that
    could serve several months serves one of them. Each further round takes four times as many per
    missing control, so where few fit, the rounds grow with the logarithm of the pool and not with
    the gap. A group is done when all its unused entities were asked and
    none was accepted, and filling ends when no group is left that is short and not done.
    """
    by = list(by)
    kept, turn, done = settle(kept, "controls"), 0, None
    while True:
        turn += 1
        short = control_shortfall(kept, quotas, by).filter("missing > 0").select(*by, "event", "missing")
        # At most one entry per calendar month.
        months = short.groupBy(*by).agg(
            F.max("missing").alias("_gap"), F.collect_list(F.struct("event", "missing")).alias("_open")
        )
        if done is not None:
            months = months.alias("_l").join(done.alias("_r"), null_safe(by, "_l", "_r"), "left_anti")
        unused = pool.alias("_l").join(grown(kept).alias("_r"), null_safe([*by, "id"], "_l", "_r"), "left_anti")
        unused = settle(unused, "unused")
        n = unused.groupBy(*by).agg(F.count(F.lit(1)).alias("_unused"))
        months = months.alias("_l").join(n.filter("_unused > 0").alias("_r"), null_safe(by, "_l", "_r"))
        share = F.least(F.lit(1.0), F.lit(float(slack)) * F.col("_gap") / F.col("_unused"))
        months = settle(months.select(*[F.col(f"_l.{c}") for c in by], "_open", share.alias("_share")), "open_months")
        if months.isEmpty():
            return kept
        if by:
            some = salted_join(unused, months, by, ["id"], how="inner")
        else:
            one = months.select(F.struct("_open", "_share").alias("s")).scalar()
            some = unused.withColumn("_s", one).select(*pool.columns, "_s._open", "_s._share")
        name = f"{seed} fill {turn}"
        drawn = slot(digest(name, *by, "id")) < F.col("_share") * F.lit(float(2**SLOT_BITS))
        asked = some.filter(drawn).select(*pool.columns, F.inline("_open"))
        if filled is not None:
            asked = filled(settle(asked, "asked")).filter(F.col("filled") >= min_filled).drop("filled")
        once = settle(one_per_id(asked, name, [*by, "id"], ["event"]), "fitting")
        taken = take_seeded(once, [*by, "id"], F.col("missing"), name, [*by, "event"])
        taken = settle(taken.drop("missing"), "filled")
        if by:
            over = months.filter("_share = 1").select(*by).alias("_l")
            over = over.join(taken.select(*by).distinct().alias("_r"), null_safe(by, "_l", "_r"), "left_anti")
            done = settle(over if done is None else over.unionByName(done), "done_groups")
        if taken.isEmpty():
            if months.filter("_share < 1").isEmpty():
                return kept
        else:
            kept = settle(kept.unionByName(taken), "controls")
        slack = 4 * slack


def control_shortfall(controls: DataFrame, quotas: DataFrame, by: list[str] = ()) -> DataFrame:
    """Wanted, kept and missing controls per event month."""
    on = [*by, "event"]
    kept = controls.groupBy(*on).agg(F.count(F.lit(1)).alias("kept"))
    joined = quotas.join(kept, on, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return joined.withColumn("missing", F.col("quota") - F.col("kept"))
