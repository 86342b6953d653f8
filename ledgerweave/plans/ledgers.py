"""Ledgers made from the star-schema tables; the SQL text runs in Spark and, as it stands, elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Customers under nations under regions, as class 1, by grouping sets over one scan; five ledgers of two periods for each 5000 customers; nations divisible by 7 declare 1.00 too much.
GEO = """
WITH c AS (SELECT 'L' || CAST(c_custkey % 5 AS STRING) || CASE WHEN c_custkey >= 5000 THEN 'x' || CAST(CAST(floor(c_custkey / 5000) AS INT) AS STRING) ELSE '' END AS ledger_id, CAST(2020 + c_custkey % 2 AS INT) AS period, n_regionkey AS r, n_nationkey AS n, c_custkey AS k, c_name, n_name, r_name, CAST(c_acctbal AS DECIMAL(20,4)) AS v
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey),
g AS (SELECT ledger_id, period, r, n, k, c_name, n_name, r_name, sum(v) AS v, grouping(k) AS gk, grouping(n) AS gn, grouping(r) AS gr FROM c GROUP BY GROUPING SETS ((ledger_id, period, r, r_name, n, n_name, k, c_name), (ledger_id, period, r, r_name, n, n_name), (ledger_id, period, r, r_name), (ledger_id, period)))
SELECT ledger_id, period, CAST(CASE WHEN gk = 0 THEN 4000000000 + k WHEN gn = 0 THEN 3000000000 + n WHEN gr = 0 THEN 2000000000 + r ELSE 1000000000 END AS BIGINT) AS row_no,
  '1' || CASE WHEN gr = 0 THEN '.' || CAST(r + 1 AS STRING) ELSE '' END || CASE WHEN gn = 0 THEN '.' || CAST(n + 1 AS STRING) ELSE '' END || CASE WHEN gk = 0 THEN '.' || CAST(k + 1 AS STRING) ELSE '' END AS codigo,
  CASE WHEN gk = 0 THEN c_name WHEN gn = 0 THEN n_name WHEN gr = 0 THEN CASE WHEN r % 2 = 0 THEN 'Ativo Circulante ' ELSE 'Ativo não circulante ' END || r_name ELSE 'ATIVO' END AS descricao,
  CAST(v + CASE WHEN gk = 1 AND gn = 0 AND n % 7 = 0 THEN 1 ELSE 0 END AS DECIMAL(20,4)) AS saldo FROM g
"""

#: Suppliers under nations, as class 2, with the sign of a liability.
EQUITY = """
WITH s AS (SELECT 'L' || CAST(s_suppkey % 5 AS STRING) AS ledger_id, CAST(2020 + s_suppkey % 2 AS INT) AS period, s_nationkey AS n, s_suppkey AS k, s_name, n_name, CAST(-s_acctbal AS DECIMAL(20,4)) AS v FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey),
h AS (SELECT ledger_id, period, n, k, s_name, n_name, sum(v) AS v, grouping(k) AS gk, grouping(n) AS gn FROM s GROUP BY GROUPING SETS ((ledger_id, period, n, n_name, k, s_name), (ledger_id, period, n, n_name), (ledger_id, period)))
SELECT ledger_id, period, CAST(CASE WHEN gk = 0 THEN 7000000000 + k WHEN gn = 0 THEN 6000000000 + n ELSE 5000000000 END AS BIGINT) AS row_no,
  '2' || CASE WHEN gn = 0 THEN '.' || CAST(n + 1 AS STRING) ELSE '' END || CASE WHEN gk = 0 THEN '.' || CAST(k + 1 AS STRING) ELSE '' END AS codigo,
  CASE WHEN gk = 0 THEN s_name WHEN gn = 0 THEN n_name ELSE 'PASSIVO' END AS descricao, CAST(v AS DECIMAL(20,4)) AS saldo FROM h
"""

#: Line items as costs (class 3) and revenues (class 4), by flag and status.
RESULT = """
WITH i AS (SELECT l_suppkey % 5 AS a, l_suppkey % 2 AS y, l_returnflag, l_linestatus, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT)) AS taxed FROM {lineitem} GROUP BY l_suppkey % 5, l_suppkey % 2, l_returnflag, l_linestatus),
l AS (SELECT 'L' || CAST(a AS STRING) AS ledger_id, CAST(2020 + y AS INT) AS period, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS f, CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS s, CAST(CAST(cents AS DECIMAL(20,0)) * 0.01 AS DECIMAL(20,4)) AS v, CAST(CAST(taxed AS DECIMAL(22,0)) * 0.0001 AS DECIMAL(20,4)) AS t FROM i),
q AS (SELECT ledger_id, period, f, s, CAST(sum(v) AS DECIMAL(20,4)) AS revenue, CAST(sum(t) AS DECIMAL(20,4)) AS cost, grouping(f) AS gf, grouping(s) AS gs FROM l GROUP BY GROUPING SETS ((ledger_id, period, f, s), (ledger_id, period, f), (ledger_id, period))),
b AS (SELECT *, 4 AS class, revenue AS saldo FROM q UNION ALL SELECT *, 3 AS class, cost AS saldo FROM q)
SELECT ledger_id, period, CAST(CASE class WHEN 4 THEN 9000000000 ELSE 8000000000 END + CASE WHEN gs = 0 THEN 500000000 + f * 10 + s WHEN gf = 0 THEN 400000000 + f ELSE 300000000 END AS BIGINT) AS row_no,
  CAST(class AS STRING) || CASE WHEN gf = 0 THEN '.' || CAST(f AS STRING) ELSE '' END || CASE WHEN gs = 0 THEN '.' || CAST(s AS STRING) ELSE '' END AS codigo,
  CASE WHEN gs = 0 THEN 'Linha ' || CAST(f AS STRING) || CASE WHEN class = 4 THEN CASE s WHEN 1 THEN ' mercado interno' ELSE ' mercado externo' END ELSE CASE s WHEN 1 THEN ' pessoal' ELSE ' (-) perdas' END END
    WHEN gf = 0 THEN CASE WHEN class = 4 THEN CASE f WHEN 1 THEN 'Vendas' WHEN 2 THEN '(-) Deduções da receita' ELSE 'Outras' END ELSE 'Grupo ' || CAST(f AS STRING) END
    ELSE CASE class WHEN 4 THEN 'RECEITAS' ELSE 'CUSTOS E DESPESAS' END END AS descricao, saldo FROM b
"""

#: The first without its nation rows: levels are missing.
SPARSE = "SELECT * FROM ({geo}) g WHERE row_no < 3000000000 OR row_no >= 4000000000"

#: Orders by customer and priority: repeated codes, some of which are the sum of the others.
REPEATED = """
WITH o AS (SELECT 'L' || CAST(o_custkey % 5 AS STRING) AS ledger_id, CAST(2020 AS INT) AS period, o_orderkey AS row_no, '1.' || CAST(o_custkey % 97 + 1 AS STRING) || '.' || substr(o_orderpriority, 1, 1) AS codigo, o_orderpriority AS descricao, CAST(o_totalprice AS DECIMAL(20,4)) AS saldo FROM {orders})
SELECT * FROM o
UNION ALL SELECT ledger_id, period, CAST(0 AS BIGINT), codigo, 'Soma ' || descricao, CAST(sum(saldo) AS DECIMAL(20,4)) FROM o WHERE descricao LIKE '1%' GROUP BY ledger_id, period, codigo, descricao
"""

FULL = "SELECT * FROM ({geo}) g UNION ALL SELECT * FROM ({equity}) e UNION ALL SELECT * FROM ({result}) r"

#: Assets by nation, some wrongly summed, against one account of the same total.
BALANCED = """
WITH c AS (SELECT 'L' || CAST(c_custkey % 5 AS STRING) AS ledger_id, CAST(2020 + c_custkey % 2 AS INT) AS period, c_nationkey AS n, CAST(c_acctbal AS DECIMAL(20,4)) AS v FROM {customer}),
g AS (SELECT ledger_id, period, n, sum(v) AS v, grouping(n) AS gn FROM c GROUP BY GROUPING SETS ((ledger_id, period, n), (ledger_id, period)))
SELECT ledger_id, period, CAST(CASE WHEN gn = 0 THEN n + 1 ELSE 0 END AS BIGINT) AS row_no, '1' || CASE WHEN gn = 0 THEN '.' || CAST(n + 1 AS STRING) ELSE '' END AS codigo, CASE WHEN gn = 0 THEN 'Conta da nação ' || CAST(n AS STRING) ELSE 'ATIVO' END AS descricao,
  CAST(v + CASE WHEN gn = 0 AND n = 7 AND ledger_id = 'L0' THEN 5 ELSE 0 END AS DECIMAL(20,4)) AS saldo FROM g
UNION ALL SELECT ledger_id, period, CAST(100 AS BIGINT), '2', 'PASSIVO', CAST(-v + CASE WHEN ledger_id IN ('L1', 'L3') THEN 70 ELSE 0 END AS DECIMAL(20,4)) FROM g WHERE gn = 1
"""

TABLES = ("customer", "nation", "region", "supplier", "lineitem", "orders", "part", "events", "documents", "pages")


def _filled(name: str) -> str:
    text = {"geo": GEO, "equity": EQUITY, "result": RESULT, "sparse": SPARSE, "repeated": REPEATED, "full": FULL, "balanced": BALANCED}[name]
    for part, sql in (("geo", GEO), ("equity", EQUITY), ("result", RESULT)):
        text = text.replace("{" + part + "}", sql)
    return text


def ledger_sql(name: str) -> str:
    """The ledger as SQL over the tables' own names."""
    return _filled(name).format(**{t: t for t in TABLES})


def ledger(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """ledger_id, period, row_no, codigo, descricao, saldo."""
    text = _filled(name)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text})
