"""Scans, projections, repairs, exclusions."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from duskline.functions import dates as d
from duskline.functions.numbers import blank_cells, number_from_text, strict_sum
from duskline.operators import exclusion as ex, profiles as pr, projection as pj, timeline as tl
from duskline.plans import fixtures as fx
from duskline.plans.catalog import query
from duskline.sources import panel_io as io, parts
from duskline.sources.scratch import scratch_path, settle

ORDER_SCHEMA = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("DATE", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
    ]
)


def _order_text(spark, sf):
    """Orders with the month as text, as the raw files carry it."""
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        d.format_period(d.month_start("o_orderdate")).alias("DATE"),
        "o_totalprice",
        F.year("o_orderdate").alias("year"),
    )


def _scan_counts(df):
    return df.groupBy(F.year(d.parse_period("DATE")).alias("year")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("id").alias("ids"),
        fx.money_sum("o_totalprice").alias("total"),
    )


_SCAN_SQL = """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS rows,
       count(DISTINCT o_orderkey) AS ids,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY 1
"""


@query("scan_panel", _SCAN_SQL)
def scan_panel(spark, sf):
    path = scratch_path(spark, "panel")
    io.write_panel(_order_text(spark, sf).drop("year"), path, fmt="csv")
    return _scan_counts(io.read_panel(spark, path, ORDER_SCHEMA))


@query("scan_years", _SCAN_SQL.replace("GROUP BY", "WHERE year(o_orderdate) <> 1995 GROUP BY"))
def scan_years(spark, sf):
    path = scratch_path(spark, "years")
    io.write_panel(_order_text(spark, sf), path, by=["year"], fmt="csv")
    return _scan_counts(io.read_years(spark, path, ORDER_SCHEMA, fx.YEARS[1:]))


@query("scan_parts", _SCAN_SQL)
def scan_parts(spark, sf):
    path = scratch_path(spark, "parts")
    io.write_panel(_order_text(spark, sf).drop("year"), path, fmt="csv", max_records=5000)
    return _scan_counts(io.read_parts(spark, path, ORDER_SCHEMA))


def _year_files(spark, sf, root):
    """One CSV folder per year; the years differ in the order, the number and the first name of their columns."""
    orders = _order_text(spark, sf).withColumn("note", F.lit("x, y"))
    for y in fx.YEARS:
        names = ["o_orderkey", "o_custkey", "DATE", "o_totalprice"]
        if y % 2:
            names = ["o_orderkey", "o_totalprice", "DATE", "note", "o_custkey"]
        if y % 3 == 0:
            names.remove("o_custkey")
        rows = orders.filter(F.col("year") == y).select(*names)
        if y % 4 == 0:
            rows = rows.withColumnRenamed("o_orderkey", "WHATEVER")
        io.write_panel(rows, f"{root}/im{y}_utf8.csv", fmt="csv")
    return root + "/im{year}_utf8.csv"


@query(
    "scan_year_headers",
    """
SELECT o_orderkey AS id, CAST(CASE WHEN year(o_orderdate) % 3 <> 0 THEN o_custkey END AS BIGINT) AS o_custkey,
       upper(strftime(date_trunc('month', o_orderdate), '%d%b%Y')) AS "DATE", o_totalprice,
       CASE WHEN year(o_orderdate) % 2 = 1 THEN 'x, y' END AS note, CAST(year(o_orderdate) AS INTEGER) AS year
FROM orders
""",
)
def scan_year_headers(spark, sf):
    """Every cell of files per year whose columns stand in another order, lack or add one."""
    pattern = _year_files(spark, sf, scratch_path(spark, "year_headers"))
    return io.read_year_files(spark, pattern, ORDER_SCHEMA, fx.YEARS, extra=True)


@query("write_parts", """SELECT CAST(year(o_orderdate) AS VARCHAR) AS part, count(*) AS rows,
CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1""")
def write_parts(spark, sf):
    """A part per year by a run that was repeated, after one that left rows without an entry."""
    root = scratch_path(spark, "orders_by_year")
    orders = settle(_order_text(spark, sf), "order_text")
    for y in fx.YEARS:
        rows = orders.filter(F.col("year") == y)
        if y % 2:
            rows.limit(10).write.parquet(f"{root}/data/part={y}/run=broken")
        if y % 3:
            parts.write_part(rows.limit(5), root, str(y), "first")
        for _ in range(2):
            parts.write_part(rows, root, str(y), "second")
    kept = parts.read_committed(spark, root)
    return kept.groupBy("part").agg(F.count("*").alias("rows"), fx.money_sum("o_totalprice").alias("total"))


@query(
    "date_helpers",
    """
SELECT o_orderkey, upper(strftime(m, '%d%b%Y')) AS text, m AS period,
       upper(strftime(m - INTERVAL 1 MONTH, '%d%b%Y')) AS previous_text,
       CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month,
       CAST(m - INTERVAL 3 MONTH AS DATE) AS anchor,
       CAST(year(m) - CASE WHEN month(m) < 7 THEN 2 ELSE 1 END AS INTEGER) AS known_year,
       make_date(year(m) - CASE WHEN month(m) < 7 THEN 2 ELSE 1 END, 12, 1) AS statement
FROM (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)
""",
)
def date_helpers(spark, sf):
    df = _order_text(spark, sf).select("o_orderkey", F.col("DATE").alias("text"))
    df = df.withColumn("period", d.parse_period("text"))
    return df.select(
        "o_orderkey",
        "text",
        "period",
        d.format_period(d.previous_month("period")).alias("previous_text"),
        F.year("period").alias("year"),
        F.month("period").alias("month"),
        d.anchor_month("period").alias("anchor"),
        d.known_year("period").alias("known_year"),
        d.compose_period(d.known_year("period"), 12).alias("statement"),
    )


@query(
    "drop_columns",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag
FROM lineitem""",
)
def drop_columns(spark, sf):
    return pj.drop_columns(
        fx.table(spark, sf, "lineitem"),
        ["l_partkey", "l_suppkey", "l_tax", "l_linestatus", "l_shipdate", "not_there"],
    )


@query(
    "select_span",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem""",
)
def select_span(spark, sf):
    return pj.select_span(fx.table(spark, sf, "lineitem"), "l_linenumber", "l_tax", ["l_orderkey"])


@query("select_matching", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def select_matching(spark, sf):
    return pj.select_matching(fx.table(spark, sf, "customer"), "KEY|SEGMENT")


@query("annual_rows", "SELECT id, period, n, sales, active FROM D WHERE month(period) = 12")
def annual_rows(spark, sf):
    return pj.annual_rows(fx.dense_panel(spark, sf)).select("id", "period", "n", "sales", "active")


@query(
    "fill_status", "SELECT id, period, CAST(coalesce(status, 0) AS INTEGER) AS status FROM D"
)
def fill_status(spark, sf):
    return pj.fill_column(fx.dense_panel(spark, sf), "status", 0).select("id", "period", "status")


@query(
    "fill_all",
    """SELECT id, period, coalesce(n, 0) AS n, coalesce(sales, 0) AS sales,
coalesce(max_price, 0) AS max_price, coalesce(sector, '0') AS sector FROM D""",
)
def fill_all(spark, sf):
    return pj.fill_all(
        fx.dense_panel(spark, sf).select("id", "period", "n", "sales", "max_price", "sector")
    )


@query(
    "parse_number",
    """SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS text,
CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS value,
CAST(NULL AS DOUBLE) AS not_a_number FROM orders""",
)
def parse_number(spark, sf):
    text = F.format_number("o_totalprice", 2)
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        text.alias("text"),
        number_from_text(text).alias("value"),
        number_from_text("o_orderpriority").alias("not_a_number"),
    )


@query(
    "convert_currency",
    """SELECT id, period, CASE WHEN year < 1998 THEN sales / 3.45::DOUBLE ELSE sales END AS sales,
CASE WHEN year < 1998 THEN max_price / 3.45::DOUBLE ELSE max_price END AS max_price FROM P""",
)
def convert_currency(spark, sf):
    df = pj.convert_currency(fx.panel(spark, sf), ["sales", "max_price"], before=1998)
    return df.select("id", "period", "sales", "max_price")


_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT count(*) AS rows, '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls"
    " FROM D"
    for c in ["id", "period", "n", "sales", "max_price", "status", "sector"]
)


@query("null_profile", _PROFILE_SQL)
def null_profile(spark, sf):
    return pj.null_profile(
        fx.dense_panel(spark, sf).select(
            "id", "period", "n", "sales", "max_price", "status", "sector"
        )
    )


@query("drop_sparse", "SELECT id, period, n, sales FROM D")
def drop_sparse(spark, sf):
    df = fx.dense_panel(spark, sf).select("id", "period", "n", "sales", "status")
    return pj.drop_sparse(df, 0.98)


@query(
    "impute_from",
    """SELECT id, period, n, CASE WHEN sales IS NULL AND active <= 0 THEN active
ELSE sales END AS sales FROM D""",
)
def impute_from(spark, sf):
    df = fx.dense_panel(spark, sf).withColumn("active", F.col("active").cast("double"))
    return pj.impute_from(df, "sales", "active", F.col("active") <= 0).select(
        "id", "period", "n", "sales"
    )


@query(
    "indicators",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS c_mktsegment_BUILDING,
CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS c_mktsegment_MACHINERY FROM customer""",
)
def indicators(spark, sf):
    df = fx.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return pj.indicators(df, "c_mktsegment", ["BUILDING", "MACHINERY"]).drop("c_mktsegment")


_RISK_STEPS = """
CN AS (SELECT c_custkey AS id, n_name AS category FROM customer JOIN nation ON n_nationkey = c_nationkey),
PN AS (SELECT P.id, category, status FROM P JOIN CN USING (id)),
BAD AS (SELECT DISTINCT id, category FROM PN WHERE status = 5),
GOOD AS (SELECT DISTINCT id, category FROM PN WHERE id NOT IN (SELECT id FROM BAD)),
R AS (
  SELECT category, sum(g) AS healthy, sum(b) AS events,
         round(sum(b) / CAST(sum(b) + sum(g) AS DOUBLE), 4) AS ratio
  FROM (SELECT category, 1 AS g, 0 AS b FROM GOOD UNION ALL SELECT category, 0, 1 FROM BAD)
  GROUP BY category),
K AS (
  SELECT category, CAST(healthy AS BIGINT) AS healthy, CAST(events AS BIGINT) AS events, ratio,
         CAST(floor(ratio / nullif((SELECT (max(ratio) - min(ratio)) / 50 FROM R), 0)) + 1
              AS INTEGER) AS rank
  FROM R)
"""


def _panel_with_nation(spark, sf):
    c = fx.table(spark, sf, "customer").join(
        fx.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    c = c.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("nation"))
    return fx.panel(spark, sf).join(c, "id")


def _risk(spark, sf):
    return pr.category_risk(_panel_with_nation(spark, sf), "nation", fx.is_event())


@query("category_risk", "SELECT category, healthy, events, ratio FROM K", _RISK_STEPS)
def category_risk(spark, sf):
    return _risk(spark, sf)


@query("risk_rank", "SELECT * FROM K", _RISK_STEPS)
def risk_rank(spark, sf):
    return pr.risk_rank(_risk(spark, sf))


@query(
    "map_category",
    """SELECT P.id, period, coalesce(CAST(rank AS VARCHAR), CN.category) AS nation
FROM P JOIN CN USING (id) LEFT JOIN K ON K.category = CN.category AND K.events >= 2""",
    _RISK_STEPS,
)
def map_category(spark, sf):
    ranks = pr.risk_rank(_risk(spark, sf)).filter(F.col("events") >= 2)
    df = _panel_with_nation(spark, sf).select("id", "period", "nation")
    return pj.map_category(df, "nation", ranks)


@query(
    "rank_dummies",
    """SELECT P.id, period, CAST(rank AS VARCHAR) AS nation, 'nation_R' || rank AS dummy, 1 AS ones,
(SELECT CAST(count(DISTINCT rank) AS INTEGER) FROM K) AS dummies
FROM P JOIN CN USING (id) JOIN K ON K.category = CN.category""",
    _RISK_STEPS,
)
def rank_dummies(spark, sf):
    """The set dummy of each row, out of one dummy per rank that occurs."""
    ranks = pr.risk_rank(_risk(spark, sf))
    df = _panel_with_nation(spark, sf).select("id", "period", "nation")
    names = pj.distinct_values(ranks, "rank")
    wide = pj.rank_dummies(pj.map_category(df, "nation", ranks), "nation", names)
    cols = [f"nation_R{r}" for r in names]
    which = F.coalesce(*[F.when(F.col(c) == 1, F.lit(c)) for c in cols])
    ones = sum((F.col(c) for c in cols), F.lit(0))
    return wide.select(
        "id", "period", "nation", which.alias("dummy"), ones.alias("ones"),
        F.lit(len(cols)).alias("dummies"),
    )


@query(
    "ratio_score",
    """SELECT id, period, round(CASE WHEN s IS NULL OR s = 0 THEN 2.75 ELSE s END, 6) AS score FROM (
  SELECT id, period, 1.2::DOUBLE * (max_price / nullif(sales, 0)) + 1.4::DOUBLE * (c_acctbal / nullif(sales, 0))
    + 3.3::DOUBLE * (avg_price / nullif(sales, 0)) + 0.6::DOUBLE * (c_acctbal / nullif(max_price, 0))
    + 0.99::DOUBLE * (n / nullif(sales, 0)) AS s
  FROM (SELECT id, period, coalesce(n, 0) AS n, coalesce(sales, 0) AS sales,
               coalesce(avg_price, 0) AS avg_price, coalesce(max_price, 0) AS max_price FROM D)
  JOIN customer ON c_custkey = id)""",
)
def ratio_score(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    df = pj.fill_all(fx.dense_panel(spark, sf)).join(c, "id")
    terms = [
        (1.2, "max_price", "sales"),
        (1.4, "c_acctbal", "sales"),
        (3.3, "avg_price", "sales"),
        (0.6, "c_acctbal", "max_price"),
        (0.99, "n", "sales"),
    ]
    return df.select("id", "period", F.round(pj.ratio_score(terms), 6).alias("score"))


@query(
    "annual_missing",
    """SELECT id, year, CAST((n IS NULL)::INT + (sales IS NULL)::INT + (max_price IS NULL)::INT AS INTEGER) AS nulls,
n IS NULL AND sales IS NULL AND max_price IS NULL AS all_missing FROM D WHERE month(period) = 12""",
)
def annual_missing(spark, sf):
    df = pj.annual_rows(fx.dense_panel(spark, sf))
    nulls = sum((F.col(c).isNull().cast("int") for c in fx.METRICS), F.lit(0))
    return df.select("id", "year", nulls.alias("nulls"), pj.all_null(fx.METRICS).alias("all_missing"))


@query("complete_cases", "SELECT id, period, n, sales, max_price FROM D WHERE n IS NOT NULL")
def complete_cases(spark, sf):
    return pj.complete_cases(
        fx.dense_panel(spark, sf).select("id", "period", "n", "sales", "max_price")
    )


@query(
    "strict_sum",
    """SELECT id, year, CASE WHEN count(n) = count(*) THEN CAST(sum(n) AS BIGINT) END AS n_all,
CAST(sum(n) AS BIGINT) AS n_any FROM D GROUP BY 1, 2""",
)
def strict_sum_query(spark, sf):
    return fx.dense_panel(spark, sf).groupBy("id", "year").agg(
        strict_sum("n").alias("n_all"), F.sum("n").alias("n_any")
    )


_EXEMPT = "EX AS (SELECT id, max(year) AS exempt_until FROM P WHERE status = 5 GROUP BY id)"


@query("exempt_ids", "SELECT id, exempt_until FROM EX", _EXEMPT)
def exempt_ids(spark, sf):
    return ex.exempt_ids(fx.panel(spark, sf), fx.is_event())


_NOT_X = """
X AS (SELECT DISTINCT id, year FROM P WHERE sector = 'X')"""


@query(
    "exclude_any",
    """SELECT id, period, n FROM P
WHERE NOT EXISTS (SELECT 1 FROM X WHERE X.id = P.id AND X.year = P.year)""",
    _NOT_X,
)
def exclude_any(spark, sf):
    return ex.exclude_any(fx.panel(spark, sf), F.col("sector") == "X").select("id", "period", "n")


_YOUNG = f"""
{_EXEMPT},
Y AS (SELECT id, year FROM P GROUP BY 1, 2 HAVING count(*) < 2),
YX AS (SELECT * FROM Y WHERE NOT EXISTS (
  SELECT 1 FROM EX WHERE EX.id = Y.id AND EX.exempt_until >= Y.year))"""


@query(
    "exclude_young",
    """SELECT id, period, n FROM P
WHERE NOT EXISTS (SELECT 1 FROM YX WHERE YX.id = P.id AND YX.year = P.year)""",
    _YOUNG,
)
def exclude_young(spark, sf):
    p = fx.panel(spark, sf).withColumn("existed", F.lit(1))
    exempt = ex.exempt_ids(p, fx.is_event())
    return ex.exclude_young(p, "existed", 2, exempt).select("id", "period", "n")


_NO_ANNUAL = f"""
{_EXEMPT},
N AS (SELECT DISTINCT id, year FROM D WHERE month(period) = 12
      AND n IS NULL AND sales IS NULL AND max_price IS NULL),
NX AS (SELECT * FROM N WHERE NOT EXISTS (
  SELECT 1 FROM EX WHERE EX.id = N.id AND EX.exempt_until >= N.year))"""


@query(
    "exclude_no_annual",
    """SELECT id, period, n FROM D
WHERE NOT EXISTS (SELECT 1 FROM NX WHERE NX.id = D.id AND NX.year = D.year)""",
    _NO_ANNUAL,
)
def exclude_no_annual(spark, sf):
    p = fx.dense_panel(spark, sf)
    exempt = ex.exempt_ids(p, fx.is_event())
    return ex.exclude_no_annual(p, fx.METRICS, exempt).select("id", "period", "n")


@query(
    "clean_rows",
    """SELECT id, period, n FROM D1 WHERE NOT EXISTS (
  SELECT 1 FROM N1 WHERE N1.id = D1.id AND N1.year = D1.year)""",
    f"""
{_EXEMPT},
X AS (SELECT DISTINCT id, year FROM D WHERE sector = 'X'),
D0 AS (SELECT * FROM D WHERE NOT EXISTS (SELECT 1 FROM X WHERE X.id = D.id AND X.year = D.year)),
Y AS (SELECT id, year FROM D0 GROUP BY 1, 2 HAVING sum(active) < 2),
D1 AS (SELECT * FROM D0 WHERE NOT EXISTS (SELECT 1 FROM Y WHERE Y.id = D0.id AND Y.year = D0.year
       AND NOT EXISTS (SELECT 1 FROM EX WHERE EX.id = Y.id AND EX.exempt_until >= Y.year))),
N1 AS (SELECT id, year FROM D1 WHERE month(period) = 12
       AND n IS NULL AND sales IS NULL AND max_price IS NULL
       AND NOT EXISTS (SELECT 1 FROM EX WHERE EX.id = D1.id AND EX.exempt_until >= D1.year))""",
)
def clean_rows(spark, sf):
    return ex.clean_rows(
        fx.dense_panel(spark, sf),
        fx.is_event(),
        F.col("sector") == "X",
        "active",
        fx.METRICS,
        periods=2,
    ).select("id", "period", "n")


@query("keep_ids", "SELECT id, period, n FROM P WHERE id IN (SELECT id FROM E)")
def keep_ids(spark, sf):
    return ex.keep_ids(fx.panel(spark, sf), fx.events(spark, sf)).select("id", "period", "n")


@query("minus_ids", "SELECT id, period, n FROM P WHERE id NOT IN (SELECT id FROM E)")
def minus_ids(spark, sf):
    return ex.minus_ids(fx.panel(spark, sf), fx.events(spark, sf)).select("id", "period", "n")


@query(
    "healthy_pool",
    """SELECT 'ever' AS scope, id, CAST(NULL AS DATE) AS event FROM H
UNION ALL SELECT 'year', id, event FROM W WHERE NOT EXISTS (
  SELECT 1 FROM E WHERE E.id = W.id AND year(E.event) = year(W.event))
UNION ALL SELECT 'month', id, event FROM W WHERE NOT EXISTS (
  SELECT 1 FROM E WHERE E.id = W.id AND month(E.event) = month(W.event))""",
    """W AS (SELECT c_custkey AS id, make_date(y, 3, 1) AS event
FROM customer CROSS JOIN (SELECT unnest([1998, 1999, 2000]) AS y))""",
)
def healthy_pool(spark, sf):
    from duskline.operators.sampling import anchors_fixed

    ids, e = fx.customers(spark, sf), fx.events(spark, sf)
    wanted = anchors_fixed(ids, [1998, 1999, 2000], 3)
    ever = ex.healthy_pool(ids, e, "ever").withColumn("event", F.lit(None).cast("date"))
    parts = [ever.withColumn("scope", F.lit("ever"))]
    parts += [
        ex.healthy_pool(wanted, e, s).withColumn("scope", F.lit(s)) for s in ["year", "month"]
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("id_difference", "SELECT id FROM H")
def id_difference(spark, sf):
    return ex.id_difference(fx.customers(spark, sf), fx.events(spark, sf))


@query("distinct_ids", "SELECT DISTINCT id FROM P")
def distinct_ids(spark, sf):
    return ex.distinct_ids(fx.panel(spark, sf))


@query("first_claim", "SELECT id, max(year) AS year FROM P WHERE status = 5 GROUP BY id")
def first_claim(spark, sf):
    return ex.first_claim(fx.panel(spark, sf), fx.is_event())


@query(
    "drop_empty_rows",
    """SELECT id, period, CAST(blank AS INTEGER) AS blank FROM (
  SELECT id, period, (coalesce(n, 0) = 0)::INT + (coalesce(qty, 0) = 0)::INT
    + (coalesce(disc, 0) = 0)::INT + (coalesce(returns, 0) = 0)::INT AS blank FROM F)
WHERE blank <= 1""",
)
def drop_empty_rows(spark, sf):
    cols = ["n", "qty", "disc", "returns"]
    df = pj.drop_empty_rows(fx.full_panel(spark, sf), cols, 1)
    return df.select("id", "period", blank_cells(cols).alias("blank"))


@query(
    "dedupe_period",
    """SELECT id, period, o_orderkey, o_totalprice FROM (
  SELECT o_custkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderkey,
         o_totalprice, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate)
                                          ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
WHERE rn = 1""",
)
def dedupe_period(spark, sf):
    rows = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), d.month_start("o_orderdate").alias("period"),
        "o_orderdate", "o_orderkey", "o_totalprice",
    )
    first = tl.dedupe(rows, ["id", "period"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return first.drop("o_orderdate")
