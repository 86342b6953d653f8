"""Queries of pages by words, of reports and audits, and of what else is read from files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.operators import chart, matching, pages
from ledgerweave.operators.tree import KEY, money
from ledgerweave.plans import file_queries as fq
from ledgerweave.plans.ledgers import ledger, ledger_sql
from ledgerweave.plans.tree_queries import K
from ledgerweave.sources import files, sinks
from ledgerweave.sources.stage import shared_place
from ledgerweave.streaming import learning

QUERIES, SQL = {}, {}


def query(name, sql):
    def add(f):
        QUERIES[name], SQL[name] = f, "WITH RECURSIVE " + sql
        return f

    return add


#: Words of a page a nation: two a line on the left, and on two pages of three two more on the right.
WORDS = """WITH s AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM {supplier})
SELECT s_nationkey AS doc_id, CAST(1 AS INT) AS page_no, concat(w, CAST(s_suppkey AS STRING)) AS text, CAST(x AS DOUBLE) AS x0, CAST(x + 20 AS DOUBLE) AS x1, n * 3 + 0.4D AS top, 600 AS width
FROM s CROSS JOIN (SELECT * FROM VALUES ('a', 10), ('b', 40), ('c', 400), ('d', 450) v(w, x)) WHERE x < 100 OR s_nationkey % 3 > 0"""
LINED = "s AS (SELECT s_nationkey AS doc_id, CAST(s_suppkey AS VARCHAR) AS k, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS line_no, count(*) OVER (PARTITION BY s_nationkey) AS lines, s_nationkey % 3 > 0 AS wide FROM supplier)"


def words(spark, d):
    return spark.sql(WORDS, supplier=spark.read.parquet(f"{d}/supplier.parquet"))


@query("t17_page_lines", LINED + """ SELECT doc_id, wide AND lines >= 3 AS two_columns, line_no, 0 AS side, 'a' || k || ' b' || k || CASE WHEN wide AND lines < 3 THEN ' c' || k || ' d' || k ELSE '' END AS line FROM s
UNION ALL SELECT doc_id, TRUE, line_no, 1, 'c' || k || ' d' || k FROM s WHERE wide AND lines >= 3""")
def t17(spark, d):
    return pages.page_lines(words(spark, d)).drop("page_no")


@query("t17_word_cells", LINED + " SELECT doc_id, line_no, 0 AS column_no, 'a' || k || ' b' || k AS value FROM s UNION ALL SELECT doc_id, line_no, 1, 'c' || k FROM s WHERE wide UNION ALL SELECT doc_id, line_no, 2, 'd' || k FROM s WHERE wide")
def t17c(spark, d):
    return pages.word_cells(words(spark, d)).drop("page_no")


#: Lines of statements, and the cells that they have.
CELLS = [("Caixa e equivalentes {k} 5.176 922", "Caixa e equivalentes|{k}|5.176|922"), ("Conta {k}   1.234,56   789", "Conta {k}|1.234,56|789"), ("Só texto", "Só texto"), ("Nota 5 2 .533.136,00", "Nota|2.533.136,00"), ("  (1.000,00) ", "(1.000,00)"), ("Total 7", "Total|7")]


@query("t10_row_tokens", "s AS (SELECT CAST(s_suppkey + 100 AS VARCHAR) AS k, s_suppkey % 6 AS i, s_suppkey FROM supplier) SELECT s_suppkey, replace([" + ", ".join(f"'{cells}'" for _, cells in CELLS) + "][i + 1], '{k}', k) AS cells FROM s")
def t10(spark, d):
    lines = F.array(*[F.lit(line) for line, _ in CELLS])
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.replace(F.get(lines, (F.col("s_suppkey") % 6).cast("int")), F.lit("{k}"), (F.col("s_suppkey") + 100).cast("string")).alias("line"))
    return s.select("s_suppkey", F.array_join(pages.row_tokens(F.col("line")), "|").alias("cells"))


#: Lines of income statements with their categories.
KINDS = [("Receita líquida", "receita"), ("Custo das VENDAS", "receita"), ("CPV", "custo"), ("Despesas gerais", "despesa"), ("Prejuízo do período", "resultado"), ("Outros", None)]


@query("t14_income_categories", "p AS (SELECT p_partkey % 6 AS i FROM part) SELECT [" + ", ".join(f"'{k}'" if k else "NULL" for _, k in KINDS) + "][i + 1] AS category, count(*) AS n FROM p GROUP BY i")
def t14(spark, d):
    lines = F.array(*[F.lit(line) for line, _ in KINDS])
    p = spark.read.parquet(f"{d}/part.parquet").select(F.get(lines, (F.col("p_partkey") % 6).cast("int")).alias("line"))
    return p.groupBy("line").agg(pages.income_category(F.first("line")).alias("category"), F.count(F.lit(1)).alias("n")).drop("line")


#: Pages with what they tell: company, period, currency, scale.
HEADS = [("Relatório\\nCOMERCIAL ÁGUIA LTDA\\nExercício de 2019\\nValores em milhares de reais", "COMERCIAL ÁGUIA LTDA", "2019", "BRL", "thousands"), ("Empresa {k} S.A.\\nBalanço em 31/12/2020\\nUS$", "Empresa {k} S.A.", "31/12/2020", "USD", None), ("em 30 de junho de 2018\\nEuros", None, "30 de junho de 2018", "EUR", None), ("", None, None, None, None)]


@query("t9_page_metadata", "s AS (SELECT s_suppkey AS doc_id, CAST(s_suppkey AS VARCHAR) AS k, s_suppkey % 4 + 1 AS i FROM supplier) SELECT doc_id, " + ", ".join(("replace(" if n == "company" else "") + "[" + ", ".join("NULL" if h[j] is None else f"'{h[j]}'" for h in HEADS) + "][i]" + (", '{k}', k)" if n == "company" else "") + f" AS {n}" for j, n in enumerate(("company", "period", "currency", "scale"), 1)) + " FROM s")
def t9(spark, d):
    texts = F.array(*[F.lit(h[0].replace("\\n", "\n")) for h in HEADS])
    p = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("doc_id"), F.lit(1).alias("page_no"), F.replace(F.get(texts, (F.col("s_suppkey") % 4).cast("int")), F.lit("{k}"), F.col("s_suppkey").cast("string")).alias("text"))
    return pages.page_metadata(p).select("doc_id", "company", "period", "currency", "scale")


@query("s7_densest_header", "o AS (SELECT CAST(o_custkey % 4 AS INT) AS part, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) + 2 AS row_no FROM orders), f AS (SELECT part, min(row_no) FILTER (o_orderkey % 89 = 7 AND row_no < 50) AS wide FROM o GROUP BY part) SELECT p AS part, CAST(coalesce(wide, 2) AS BIGINT) AS header, ';' AS delimiter FROM (SELECT unnest([0, 1, 2, 3]) AS p) LEFT JOIN f ON part = p")
def s7(spark, d):
    return fq.part_of(files.densest_header(files.lines(spark, fq.written(spark, d), fq.RANGE)))


@query("s9_required_columns", "p AS (SELECT unnest([0, 1, 2, 3]) AS part) SELECT part, TRUE AS found, FALSE AS more FROM p")
def s9(spark, d):
    table = fq.lines(spark, fq.written(spark, d))
    heads = table.join(files.header_rows(table), "file_id").filter("row_no = header").withColumn("labels", F.transform(F.split("line", ";"), lambda x: F.lower(x)))
    return fq.part_of(heads.select("file_id", files.has_columns(F.col("labels"), ["código", "saldo"]).alias("found"), files.has_columns(F.col("labels"), ["código", "natureza"]).alias("more")))


@query("s23_parse_report", fq.REASONS + ", c AS (SELECT part, count(*) FILTER (reason IS NULL) AS rows, count(*) FILTER (reason IS NOT NULL) AS errors, CAST(sum(CASE part WHEN 2 THEN length(line) + 1 WHEN 0 THEN strlen(line) + 1 WHEN 1 THEN 2 * length(line) + 2 ELSE 4 * length(line) + 4 END) AS BIGINT) AS size FROM m GROUP BY part), h AS (SELECT 'Balancete da empresa' || chr(10) || '====' || chr(10) || 'Código;Descrição;Saldo' || chr(10) AS head) SELECT part, rows, errors, rows > 0 AS success, CAST(size + CASE part WHEN 0 THEN strlen(head) WHEN 1 THEN 2 * length(head) + 2 WHEN 2 THEN length(head) ELSE 4 * length(head) + 4 END AS BIGINT) AS length, TRUE AS dated, TRUE AS timed, 64 AS digest FROM c, h")
def s23(spark, d):
    at = fq.written(spark, d)
    table = fq.lines(spark, at)
    rows, rejected = files.parsed(table, files.delimiter(table), files.header_rows(table))
    to = shared_place(spark, "parsed")
    seconds = sum(sinks.observed(df, f"{to}/{name}")["seconds"] for name, df in (("rows", rows), ("rejected", rejected)))
    kept, lost = spark.read.schema(rows.schema).parquet(f"{to}/rows"), spark.read.schema(rejected.schema).parquet(f"{to}/rejected")
    report = sinks.parse_report(kept, lost, files.catalogue(spark, at).filter("accepted"), seconds)
    return fq.part_of(report.select("file_id", "rows", "errors", "success", "length", F.col("modified").isNotNull().alias("dated"), (F.col("seconds") > 0).alias("timed"), F.length("sha256").alias("digest")))


@query("s27_sources", fq.REASONS + " SELECT part, count(*) AS rows, 'csv' AS extension, TRUE AS sized FROM m WHERE reason IS NULL GROUP BY part")
def s27(spark, d):
    at = fq.written(spark, d)
    table = fq.lines(spark, at)
    rows = sinks.with_source(files.parsed(table, files.delimiter(table), files.header_rows(table))[0], files.catalogue(spark, at))
    told = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.regexp_extract("source", r"\.(\w+)$", 1)).alias("extension"), F.min(F.col("source_length") > 0).alias("sized"))
    return fq.part_of(told)


AUDITED = f"t AS ({ledger_sql('full')}), a AS (SELECT {K}, saldo AS valor, CASE WHEN codigo LIKE '3%' THEN 'compensation' WHEN codigo LIKE '1%' THEN 'treated' ELSE 'unidentified' END AS part FROM t)"


@query("s20_audit_summary", AUDITED + f" SELECT {K}, part, count(*) AS n, round(CAST(sum(valor) AS DOUBLE), 2) AS total FROM a GROUP BY ALL")
def s20(spark, d):
    rows = ledger(spark, d, "full").select(*KEY, "codigo", money(F.col("saldo")).alias("valor"), F.when(F.col("codigo").rlike("^[13]"), "1.01").alias("alvo"), F.lit(None).cast("string").alias("motivo"))
    return sinks.write_audit_parts(rows, shared_place(spark, "audit"), bank=True).withColumn("total", F.round(F.col("total").cast("double"), 2))


FORMS = "f AS (SELECT p_brand AS codigo, list_sort(list(DISTINCT 'F' || CAST(p_size % 7 AS VARCHAR) || CAST(p_partkey % 3 AS VARCHAR))) AS forms FROM part WHERE p_partkey % 50 < 3 GROUP BY ALL)"


def forms(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").filter("p_partkey % 50 < 3").select(F.col("p_brand").alias("codigo"), F.concat(F.lit("F"), F.col("p_size") % 7, F.col("p_partkey") % 3).alias("f"))
    return rows.groupBy("codigo").agg(F.array_sort(F.collect_set("f")).alias("forms"))


@query("f8_of_forms", FORMS + " SELECT codigo, array_to_string(forms, ',') AS forms FROM f WHERE list_contains(forms, 'F11') OR list_contains(forms, 'F62')")
def f8(spark, d):
    return chart.of_forms(forms(spark, d), ["F11", "F62"]).withColumn("forms", F.array_join("forms", ","))


@query("j6_cached_decisions", "p AS (SELECT DISTINCT lower(p_name) AS query FROM part), k AS (SELECT lower(p_name) AS query, max(p_brand) AS codigo FROM part WHERE p_size % 2 = 0 GROUP BY ALL) SELECT query, codigo FROM p JOIN k USING (query)")
def j6(spark, d):
    from ledgerweave.plans.match_queries import index

    rows = spark.read.parquet(f"{d}/part.parquet")
    none = F.lit(None).cast("string")
    asked = rows.select(F.lower("p_name").alias("query")).distinct().withColumns({c: none for c in ("q_classe", "q_natureza", "q_prazo", "q_tipo", "q_hint")})
    known = rows.filter("p_size % 2 = 0").groupBy(F.lower("p_name").alias("key")).agg(F.max("p_brand").alias("codigo"))
    return matching.match(asked, index(spark, d), known).filter("source = 'cache'").select("query", "codigo")


@query("g11_reset", "e AS (SELECT count(DISTINCT event_type) AS n FROM events) SELECT n AS before, 0 AS after FROM e")
def g11(spark, d):
    at = shared_place(spark, "state")
    state = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    state.write.parquet(at)
    before = spark.read.parquet(at).count()
    learning.reset(state, at)
    after = spark.read.schema(state.schema).parquet(at).agg(F.count(F.lit(1)).alias("after"))
    return after.select(F.lit(before).cast("long").alias("before"), F.col("after").cast("int").alias("after"))
