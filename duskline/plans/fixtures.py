"""A stand-in panel on the order tables: customers are the entities.

An order month is a panel row, an unusually large finished order is the rare event. Every
table here is an aggregate over the whole input and is grouped on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duskline.functions.dates import month_start
from duskline.operators.joins import grown
from duskline.sources.scratch import settle

EVENT_PRICE = 480_000
SEED = 101
METRICS = ["n", "sales", "max_price"]
ANNUAL = ["sales", "qty", "disc", "acctbal"]
YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
TEST_YEAR = 2000


# Declared schemas: no job runs just to look at file footers.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def is_event() -> Column:
    return F.col("status") == 5


def cents(c: str) -> Column:
    """Two decimals as a whole number: sums are exact in any order, and cheaper than
    decimals."""
    return F.rint(F.col(c) * 100).cast("long")


def money_sum(c: str) -> Column:
    return F.sum(cents(c)) / F.lit(100.0)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and month with orders."""
    orders = table(spark, sf_dir, "orders")
    big = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= EVENT_PRICE)
    sales = money_sum("o_totalprice")
    return (
        orders.groupBy(
            F.col("o_custkey").alias("id"), month_start("o_orderdate").alias("period")
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            sales.alias("sales"),
            (sales / F.count(F.lit(1))).alias("avg_price"),
            F.max("o_totalprice").alias("max_price"),
            F.max(F.when(big, 5)).alias("status"),
            F.max(F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "X").otherwise("A")).alias(
                "sector"
            ),
        )
        .select("id", "period", F.year("period").alias("year"), "n", "sales", "avg_price",
                "max_price", "status", "sector")
    )


def line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line figures per customer and month, summed per order before the join."""
    per_order = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(cents("l_quantity")).alias("qty"),
            F.sum(cents("l_discount")).alias("disc"),
            F.count_if(F.col("l_returnflag") == "R").alias("returns"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("id"),
        month_start("o_orderdate").alias("period"),
    )
    return (
        per_order.join(orders, "l_orderkey")
        .groupBy("id", "period")
        .agg(
            (F.sum("qty") / F.lit(100.0)).alias("qty"),
            (F.sum("disc") / F.lit(100.0)).alias("disc"),
            F.sum("returns").alias("returns"),
        )
    )


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).join(line_metrics(spark, sf_dir), ["id", "period"], "left")


def dense_panel(
    spark: SparkSession, sf_dir: str, parts: int | None = None, carry: list[str] = ()
) -> DataFrame:
    """Every customer in every month; metrics are null without orders.

    A customer's months travel as one list, at most one entry per calendar month, and the calendar
    is laid out after the join on the customer: the dense rows are neither shuffled nor broadcast.
    The lists are a small part of the rows that come of them: with ``parts`` they are dealt to so
    many tasks, where Spark would leave them in as few as their own size asks for. Columns of the
    customer that are to ``carry`` come with the key: a join with the laid out rows would broadcast
    all customers.
    """
    p = panel(spark, sf_dir).drop("year").filter(F.col("period").isNotNull())
    first, last = F.min("o_orderdate"), F.max("o_orderdate")
    span = table(spark, sf_dir, "orders").agg(
        F.struct(month_start(first).alias("a"), month_start(last).alias("b"))
    ).scalar()
    cells = [f for f in p.schema.fields if f.name != "id"]
    kept = p.groupBy("id").agg(F.collect_list(F.struct(*[f.name for f in cells])).alias("_kept"))
    months = F.sequence(span["a"], span["b"], F.expr("interval 1 month"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *carry)
    met = ids.join(grown(kept), "id", "left").withColumn("_kept", F.coalesce("_kept", F.array()))
    if parts:
        met = met.repartition(parts, "id")
    met = met.withColumn("_missing", F.array_except(months, F.col("_kept.period")))

    def empty(month: Column) -> Column:
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in cells if f.name != "period"]
        return F.struct(month.alias("period"), *rest)

    rows = met.select("id", *carry, F.inline(F.concat("_kept", F.transform("_missing", empty))))
    return rows.select(
        "id", "period", F.year("period").alias("year"), "n", "sales", "avg_price", "max_price",
        "status", "sector", F.when(F.col("n").isNull(), 0).otherwise(1).alias("active"), *carry,
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event per customer; equals ``event_dates`` of the panel but reads only the
    orders that are events."""
    orders = table(spark, sf_dir, "orders")
    big = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= EVENT_PRICE)
    return (
        orders.filter(big)
        .groupBy(F.col("o_custkey").alias("id"))
        .agg(month_start(F.min("o_orderdate")).alias("event"))
    )


def settled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full panel written once, for queries that read it several times."""
    return settle(full_panel(spark, sf_dir), "panel")


def annual(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    """Sums per customer and year with the account balance."""
    balance = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal")
    )
    p = full_panel(spark, sf_dir) if p is None else p
    sums = p.groupBy("id", "year").agg(
        *[money_sum(c).alias(c) for c in ["sales", "qty", "disc"]]
    )
    return sums.join(balance, "id")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def healthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).join(events(spark, sf_dir), "id", "left_anti")


def score_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores per customer with the class and the month of the last order."""
    last = panel(spark, sf_dir).groupBy("id").agg(
        F.max("max_price").alias("top"), F.max("status").alias("top_status"),
        F.max("period").alias("last"),
    )
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return c.join(last, "id", "left").select(
        "id",
        F.coalesce(F.month("last"), F.lit(1)).alias("month"),
        ((F.col("c_acctbal") + 1000) / 11000).alias("bal"),
        (F.coalesce("top", F.lit(0.0)) / 500000).alias("price"),
        F.when(F.col("top_status") == 5, 1).otherwise(0).alias("target"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long score set: id, month, model, score, target."""
    model = F.array(
        F.struct(F.lit("bal").alias("model"), F.col("bal").alias("score")),
        F.struct(F.lit("price").alias("model"), F.col("price").alias("score")),
    )
    return score_wide(spark, sf_dir).select("id", "month", F.inline(model), "target")
