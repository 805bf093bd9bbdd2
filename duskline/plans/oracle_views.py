"""The stand-in panel of ``fixtures`` once more, as named SQL subqueries."""

VIEWS = """
P AS (
  SELECT o_custkey AS id,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
         CAST(year(min(o_orderdate)) AS INTEGER) AS year,
         count(*) AS n,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sales,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_price,
         max(o_totalprice) AS max_price,
         max(CASE WHEN o_orderstatus = 'F' AND o_totalprice >= 480000 THEN 5 END) AS status,
         max(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'X' ELSE 'A' END) AS sector
  FROM orders GROUP BY 1, 2),
L AS (
  SELECT o.o_custkey AS id,
         CAST(date_trunc('month', o.o_orderdate) AS DATE) AS period,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
         CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS disc,
         count(*) FILTER (WHERE l_returnflag = 'R') AS returns
  FROM lineitem JOIN orders o ON l_orderkey = o_orderkey GROUP BY 1, 2),
F AS (SELECT P.*, L.qty, L.disc, L.returns FROM P LEFT JOIN L USING (id, period)),
M AS (
  SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period
  FROM P),
D AS (
  SELECT c_custkey AS id, M.period, CAST(year(M.period) AS INTEGER) AS year,
         n, sales, avg_price, max_price, status, sector,
         CASE WHEN n IS NULL THEN 0 ELSE 1 END AS active
  FROM customer CROSS JOIN M LEFT JOIN P ON P.id = c_custkey AND P.period = M.period),
E AS (SELECT id, min(period) AS event FROM P WHERE status = 5 GROUP BY id),
A AS (
  SELECT F.id, F.year,
         CAST(sum(CAST(sales AS DECIMAL(18,2))) AS DOUBLE) AS sales,
         CAST(sum(CAST(qty AS DECIMAL(18,2))) AS DOUBLE) AS qty,
         CAST(sum(CAST(disc AS DECIMAL(18,2))) AS DOUBLE) AS disc,
         max(c_acctbal) AS acctbal
  FROM F JOIN customer ON c_custkey = F.id GROUP BY 1, 2),
H AS (SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM E)),
T AS (
  SELECT c_custkey AS id, (c_acctbal + 1000) / 11000 AS bal,
         coalesce(max(max_price), 0) / 500000 AS price,
         max(CASE WHEN status = 5 THEN 1 ELSE 0 END) AS target,
         CAST(coalesce(month(max(period)), 1) AS INTEGER) AS month
  FROM customer LEFT JOIN P ON P.id = c_custkey GROUP BY c_custkey, c_acctbal),
S AS (
  SELECT id, month, 'bal' AS model, bal AS score, target FROM T
  UNION ALL SELECT id, month, 'price', price, target FROM T)
"""


def with_views(select: str, steps: str = "") -> str:
    tail = f",\n{steps.strip()}" if steps else ""
    return f"WITH {VIEWS.strip()}{tail}\n{select.strip()}"


def seeded(*parts: str) -> str:
    """SQL for the digest of ``functions.seeds``."""
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


def slot_of(m: str) -> str:
    return f"CAST(('0x' || substr({m}, 1, 15)) AS BIGINT)"
