"""Exchange rounds against a maximum flow by brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duskline.operators import exchange as xc, sampling as sp
from duskline.sources.scratch import settle
from tests.conftest import rows

MONTHS = [dt.date(2018, m, 1) for m in range(1, 9)]


def largest(quota, able):
    """The most entities that months can take, by augmenting one at a time."""
    held = {m: [] for m in quota}
    serves = {}
    for i, m in able:
        serves.setdefault(i, []).append(m)

    def place(i, seen):
        for m in serves[i]:
            if m in seen:
                continue
            seen.add(m)
            if len(held[m]) < quota[m]:
                held[m].append(i)
                return True
            for n, other in enumerate(held[m]):
                if place(other, seen):
                    held[m][n] = i
                    return True
        return False

    return sum(place(i, set()) for i in sorted(serves))


def checker(spark, able, schema):
    fits = spark.createDataFrame(able, schema).withColumn("filled", F.lit(1))
    on = [c for c in fits.columns if c != "filled"]
    return lambda a: a.join(fits, on, "left").fillna(0, ["filled"]).select(*a.columns, "filled")


def test_path_runs_over_full_months():
    a, b, c = MONTHS[:3]
    assert xc._path({a: 1}, {c: 1}, {a: {b: 1}, b: {c: 2}}, set()) == [a, b, c]
    assert xc._path({a: 1}, {c: 1}, {a: {b: 1}, b: {c: 2}}, {b}) is None
    assert xc._path({a: 1}, {a: 1}, {}, set()) == [a]


def test_a_chain_of_swaps(spark):
    """Entity i can serve months i and i + 1; all stand one month late, so the first is open."""
    able = spark.createDataFrame([(i, MONTHS[i + d]) for i in range(6) for d in (0, 1)], "id long, event date")
    quotas = spark.createDataFrame([(m, 1) for m in MONTHS[:6]], "event date, quota long")
    kept = spark.createDataFrame([(i, MONTHS[i + 1]) for i in range(5)], "id long, event date")
    got = xc.exchange_open(kept, quotas, able, 1)
    assert rows(got, "id", "event") == [(i, MONTHS[i]) for i in range(6)]


def test_groups_equal_the_largest_flow(spark):
    rng = random.Random(7)
    able, quota = [], {}
    for g in ["a", "b", None]:
        for m in MONTHS:
            quota[g, m] = rng.randint(0, 9)
        for i in range(30):
            able += [(g, i, m) for m in rng.sample(MONTHS, rng.choice([0, 1, 1, 2, 2, 3]))]
    quotas = spark.createDataFrame([(g, m, n) for (g, m), n in quota.items()], "g string, event date, quota long")
    fits = spark.createDataFrame(able, "g string, id long, event date")
    for kept in (fits.limit(0), fits.filter("g = 'a' AND event = '2018-03-01'").limit(quota["a", MONTHS[2]])):
        got = xc.exchange_open(kept, quotas, fits, 3, ["g"])
        assert got.exceptAll(fits).isEmpty() and got.count() == got.select("g", "id").distinct().count()
        assert sp.control_shortfall(got, quotas, ["g"]).filter("missing < 0").isEmpty()
        found = {r["g"]: r["count"] for r in got.groupBy("g").count().collect()}
        for g in ["a", "b", None]:
            want = largest({m: n for (h, m), n in quota.items() if h == g}, [(i, m) for h, i, m in able if h == g])
            assert found.get(g, 0) == want


@pytest.mark.parametrize("n", [0, 20])
def test_matching_then_exchange(spark, n):
    rng = random.Random(n)
    able = [(i, m) for i in range(n) for m in rng.sample(MONTHS, 2)]
    quotas = spark.createDataFrame([(m, 3) for m in MONTHS], "event date, quota long")
    check = checker(spark, able, "id long, event date")
    got = xc.match_exchanged(spark.range(n), quotas, 5, check)
    assert got.count() == largest({m: 3 for m in MONTHS}, able)
    assert {(r["id"], r["event"]) for r in got.collect()} <= set(able)


def test_nulls_and_empty_tables(spark):
    quotas = spark.createDataFrame([(MONTHS[0], 1), (MONTHS[1], 1)], "event date, quota long")
    schema = "id long, event date"
    able = spark.createDataFrame([(None, MONTHS[0]), (None, MONTHS[1]), (1, MONTHS[1])], schema)
    kept = spark.createDataFrame([(None, MONTHS[1])], schema)
    got = xc.exchange_open(kept, quotas, able, 1).collect()
    assert {(r["id"], r["event"]) for r in got} == {(None, MONTHS[0]), (1, MONTHS[1])} and len(got) == 2
    assert xc.exchange_open(kept, quotas, able.limit(0), 1).count() == 1
    assert xc.exchange_open(kept.limit(0), quotas.limit(0), able, 1).count() == 0


def test_filling_ends_soon_where_few_fit(spark, monkeypatch):
    """One in fifty of the pool fits: each round asks more, and all that fit are found."""
    rounds, once = [], sp.one_per_id
    monkeypatch.setattr(sp, "one_per_id", lambda *a: rounds.append(1) or once(*a))
    pool = spark.range(3000)
    quotas = spark.createDataFrame([("2000-01", 40), ("2000-02", 30)], "event string, quota long")
    fits = lambda a: a.withColumn("filled", (F.col("id") % 50 == 0).cast("int"))
    kept = sp.fill_open(pool, quotas, quotas.selectExpr("0L AS id", "event").limit(0), 7, fits)
    assert sorted(r["id"] for r in kept.collect()) == list(range(0, 3000, 50))
    assert len(rounds) <= 6


def test_the_controls_are_not_broadcast(spark, monkeypatch):
    """A file of 300,000 controls is below Spark's bound for a broadcast, their rows are far above it."""
    plans = []

    def record(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return settle(df, name)

    monkeypatch.setattr(sp, "settle", record)
    pool = settle(spark.range(300_000).withColumn("g", F.lit(1)))
    quotas = spark.createDataFrame([(1, m, 40_000) for m in MONTHS], "g int, event date, quota long")
    fits = lambda a: a.withColumn("filled", F.lit(1))
    kept = pool.filter("id > 0").withColumn("event", F.element_at(F.array(*map(F.lit, MONTHS)), (F.col("id") % 8 + 1).cast("int")))
    got = sp.fill_open(pool, quotas, kept, 5, fits, by=["g"])
    assert got.count() == 300_000
    unused = [p for name, p in plans if name == "unused"]
    assert unused and not any("BroadcastHashJoin" in p for p in unused)
