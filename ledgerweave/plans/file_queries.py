"""Queries over files that Spark writes from the tables, in several charsets."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ledgerweave.sources import files, text_scan
from ledgerweave.sources.stage import saved, shared_place

QUERIES, SQL = {}, {}


def query(name, sql):
    def add(f):
        QUERIES[name], SQL[name] = f, "WITH RECURSIVE " + sql
        return f

    return add


#: Parts of orders, and the charset of each part's file.
CHARSETS = ["UTF-8", "UTF-16", "ISO-8859-1", "UTF-32"]
#: Bytes of a range in these queries, so that the files of the smallest tables have several.
RANGE = 1 << 18
#: A file: a title, a rule, the header, then a line an order, some of which have a cell too many or no readable amount.
LINES = """
SELECT CAST(o_custkey % 4 AS INT) AS part, o_orderkey + 3 AS place, concat_ws(';', concat('1.', CAST(o_custkey AS STRING), '.', CAST(o_orderkey AS STRING)), concat('Pedido nº ', CAST(o_orderkey AS STRING)),
  CASE WHEN o_orderkey % 97 = 5 THEN 'ilegível' ELSE CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS STRING) END, CASE WHEN o_orderkey % 89 = 7 THEN 'a mais' END) AS line FROM {orders}
"""


def written(spark, d) -> str:
    """The folder of the four files, each in its part's charset; Java writes no byte order mark for UTF-32."""
    body = spark.sql(LINES, orders=spark.read.parquet(f"{d}/orders.parquet"))
    heads = spark.createDataFrame([(p, i, x) for p in range(4) for i, x in enumerate(["\ufeff" * (p == 3) + "Balancete da empresa", "====", "Código;Descrição;Saldo"])], "part int, place long, line string")
    at = shared_place(spark, "files")

    def write(part: int, charset: str) -> None:
        own = body.filter(F.col("part") == part).unionByName(heads.filter(F.col("part") == part)).repartition(1).sortWithinPartitions("place")
        own.select("line").write.option("encoding", charset).option("lineSep", "\n").option("emptyValue", "").option("nullValue", "").option("quote", "").option("delimiter", "\x01").csv(f"{at}/part={part}")

    with ThreadPoolExecutor(len(CHARSETS)) as pool:  # a file is written by one task, the files beside each other
        list(pool.map(write, range(len(CHARSETS)), CHARSETS))
    return at


def lines(spark, at):
    """The lines of the files, written once for all that read them."""
    return saved(files.lines(spark, at, RANGE), "lines")


def part_of(df):
    return df.withColumn("part", F.regexp_extract("file_id", r"part=(\d)", 1).cast("int")).drop("file_id")


WROTE = """o AS (SELECT CAST(o_custkey % 4 AS INT) AS part, o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) + 2 AS row_no FROM orders),
b AS (SELECT part, row_no, '1.' || CAST(o_custkey AS VARCHAR) || '.' || CAST(o_orderkey AS VARCHAR) AS codigo, 'Pedido nº ' || CAST(o_orderkey AS VARCHAR) AS descricao, o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) AS price FROM o),
l AS (SELECT *, codigo || ';' || descricao || ';' || CASE WHEN o_orderkey % 97 = 5 THEN 'ilegível' ELSE price END || CASE WHEN o_orderkey % 89 = 7 THEN ';a mais' ELSE '' END AS line FROM b)"""


@query("s2_text_lines", WROTE + " SELECT part, row_no, line FROM l UNION ALL SELECT p, 0, 'Balancete da empresa' FROM (SELECT unnest([0, 1, 2, 3]) AS p) UNION ALL SELECT p, 1, '====' FROM (SELECT unnest([0, 1, 2, 3]) AS p) UNION ALL SELECT p, 2, 'Código;Descrição;Saldo' FROM (SELECT unnest([0, 1, 2, 3]) AS p)")
def s2(spark, d):
    return part_of(files.lines(spark, written(spark, d), RANGE))


@query("s3_charsets", "o AS (SELECT CAST(o_custkey % 4 AS INT) AS part, count(*) AS n FROM orders GROUP BY ALL) SELECT p AS part, ['utf-8', 'utf-16-be', 'iso-8859-1', 'utf-32-be'][p + 1] AS charset, CAST(coalesce(n, 0) + 3 AS BIGINT) AS lines FROM (SELECT unnest([0, 1, 2, 3]) AS p) LEFT JOIN o ON part = p")
def s3(spark, d):
    return part_of(text_scan.charsets(spark, written(spark, d), RANGE))


REASONS = WROTE + """, m AS (SELECT *, CASE WHEN o_orderkey % 89 = 7 THEN 'too many fields: 4 for 3' WHEN o_orderkey % 97 = 5 THEN 'unreadable amount: ilegível' END AS reason FROM l)"""


def parsed(spark, d):
    table = lines(spark, written(spark, d))
    return files.parsed(table, files.delimiter(table), files.header_rows(table))


@query("s8_first_rejected", REASONS + " SELECT part, row_no + 1 AS line, reason, line AS data, CAST(row_number() OVER (PARTITION BY part ORDER BY row_no) AS INT) AS nth FROM m WHERE reason IS NOT NULL QUALIFY nth <= 10")
def s8(spark, d):
    return part_of(files.first_rejected(parsed(spark, d)[1]))


@query("s10_parsed_rows", REASONS + " SELECT part, row_no, codigo, descricao, CAST(price AS DOUBLE) AS saldo FROM m WHERE reason IS NULL")
def s10(spark, d):
    rows = part_of(parsed(spark, d)[0])
    return rows.withColumn("saldo", F.col("saldo").cast("double"))
