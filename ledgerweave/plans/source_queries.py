"""Queries of file, layout, page and learning operators, with SQL beside each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerweave.functions import codes, numbers
from ledgerweave.operators import delivery, matching, projection, tree
from ledgerweave.operators import pages as pg
from ledgerweave.operators import statement_tables as st
from ledgerweave.plans.ledgers import ledger, ledger_sql
from ledgerweave.plans.tree_queries import K, double, nodes
from ledgerweave.sources import files, layout, names, sinks
from ledgerweave.sources.stage import saved
from ledgerweave.streaming import learning

QUERIES, SQL = {}, {}


def query(name, sql):
    def add(f):
        QUERIES[name], SQL[name] = f, "WITH RECURSIVE " + sql
        return f

    return add


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Tables of four rows a nation: a title, a header, a rule, then suppliers.
GRID = """SELECT CAST(s_nationkey AS STRING) AS file_id, '' AS sheet, CAST(3 + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS row_no, s_suppkey, s_name, s_acctbal FROM {supplier}"""


def grid(spark, d):
    body = spark.sql(GRID, supplier=read(spark, d, "supplier"))
    rows = body.select("file_id", "sheet", "row_no", F.array(F.concat(F.lit("1."), "s_suppkey"), "s_name", F.col("s_acctbal").cast("decimal(20,2)").cast("string")).alias("v"))
    heads = body.select("file_id", "sheet").distinct()
    at = lambda n, *cells: heads.withColumn("row_no", F.lit(n)).withColumn("v", F.array(*map(F.lit, cells)))
    whole = at(0, "Empresa", "", "31/12/2020").unionByName(at(1, "Código da conta", "Descrição", "Saldo atual")).unionByName(at(2, "====", "____", "")).unionByName(rows)
    return whole.select("file_id", "sheet", "row_no", F.posexplode("v").alias("col_no", "value"))


NATIONS = "s AS (SELECT CAST(s_nationkey AS VARCHAR) AS file_id, count(*) AS n FROM supplier GROUP BY ALL)"


@query("s6_header_candidates", NATIONS + " SELECT file_id, '' AS sheet, CAST(1 AS INT) AS header FROM s")
def s6(spark, d):
    return layout.header_candidates(grid(spark, d), ["código", "descri", "saldo"])


@query("s7_densest_rows", NATIONS + " SELECT file_id, '' AS sheet, CAST(1 AS INT) AS header FROM s")
def s7(spark, d):
    return layout.densest_rows(grid(spark, d))


@query("l14_without_rules", NATIONS + " SELECT file_id, (n + 2) * 3 AS cells FROM s")
def l14(spark, d):
    return layout.without_rules(grid(spark, d)).groupBy("file_id").agg(F.count(F.lit(1)).alias("cells"))


@query("l3_find_column", NATIONS + " SELECT file_id, '' AS sheet, CAST(CASE CAST(file_id AS INT) % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS INT) AS col_no FROM s")
def l3(spark, d):
    other = F.when((F.col("file_id").cast("int") % 3 == 1) & (F.col("col_no") == 0), " CONTA ").when((F.col("file_id").cast("int") % 3 == 2) & (F.col("col_no") == 1), "Valor em reais").otherwise(F.col("value"))
    return layout.find_column(grid(spark, d).filter("row_no = 1").withColumn("label", other), ["valor", "saldo", "conta"])


@query("l1_keyword_hits", NATIONS + " SELECT file_id, CAST(CASE CAST(file_id AS INT) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 0 END AS INT) AS hits, CAST(file_id AS INT) % 3 < 2 AS header FROM s")
def l1(spark, d):
    at = F.col("file_id").cast("int") % 3
    rows = grid(spark, d).filter("row_no = 1").groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list("value")), " ").alias("line"))
    hits = files.keyword_hits(F.when(at == 0, F.col("line")).when(at == 1, "Débito do mês; CRÉDITO").otherwise("Relatório"))
    return rows.select("file_id", hits.alias("hits"), (hits >= 2).alias("header"))


@query("t18_header_accounts", "s AS (SELECT CAST(s_nationkey AS VARCHAR) AS file_id, '1.' || CAST(s_suppkey AS VARCHAR) AS codigo, s_name AS descricao, round(CAST(s_acctbal AS DOUBLE), 2) AS saldo FROM supplier) SELECT * FROM s")
def t18(spark, d):
    table = grid(spark, d).filter("row_no = 1 or row_no > 2").withColumn("row_no", F.when(F.col("row_no") == 1, 0).otherwise(F.col("row_no")))
    return double(st.header_accounts(table).select("file_id", "codigo", "descricao", "saldo"), "saldo")


#: Headers of statement tables: entity, period and window by nation.
HEADS = """SELECT CAST(n_nationkey AS STRING) AS file_id, '' AS sheet, CAST(0 AS INT) AS row_no, array('Descrição', CASE n_nationkey % 3 WHEN 0 THEN 'Controladora' WHEN 1 THEN 'Consolidado' ELSE '' END, CASE n_nationkey % 2 WHEN 0 THEN '31/12/2020' ELSE '30/09/2021' END, CASE n_nationkey % 4 WHEN 0 THEN '31/12/2019 nove meses' WHEN 1 THEN '30/09/2022 três meses' WHEN 2 THEN 'Anterior' ELSE '' END) AS v FROM {nation}"""


def heads(spark, d):
    return spark.sql(HEADS, nation=read(spark, d, "nation")).select("file_id", "sheet", "row_no", F.posexplode("v").alias("col_no", "value"))


@query("t19_table_headers", "n AS (SELECT n_nationkey AS k FROM nation) SELECT CAST(k AS VARCHAR) AS file_id, CASE k % 3 WHEN 0 THEN 'controladora' WHEN 1 THEN 'consolidado' ELSE '' END AS entities, CASE k % 4 WHEN 0 THEN '31/12/2019,31/12/2020' WHEN 1 THEN '30/09/2021,30/09/2022' WHEN 2 THEN '31/12/2020' ELSE '30/09/2021' END AS periods, CASE k % 4 WHEN 0 THEN '9M' WHEN 1 THEN '3M' ELSE '' END AS windows FROM n")
def t19(spark, d):
    return st.table_headers(heads(spark, d)).select("file_id", *[F.array_join(c, ",").alias(c) for c in ("entities", "periods", "windows")])


@query("t11_value_columns", "n AS (SELECT n_nationkey AS k FROM nation) SELECT CAST(k AS VARCHAR) AS file_id, CAST(CASE k % 4 WHEN 1 THEN 3 ELSE 2 END AS INT) AS current_col, CAST(CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE -1 END AS INT) AS previous_col FROM n")
def t11(spark, d):
    return st.value_columns(heads(spark, d).withColumnRenamed("value", "label")).select("file_id", "current_col", F.coalesce("previous_col", F.lit(-1)).alias("previous_col"))


#: Pages of conversations as statements: the class by turn, with entities and windows put in.
PAGES = "SELECT conv_id AS doc_id, turn AS page_no, concat(CASE turn % 3 WHEN 0 THEN 'Controladora nove meses ' WHEN 1 THEN 'Consolidado 31/12/2020 ' ELSE '30/09/2021 controladora ' END, coalesce(text, '')) AS text, CASE turn % 3 WHEN 0 THEN 'dre' WHEN 1 THEN 'bp' ELSE 'other' END AS type FROM {conversations}"


@query("t21_page_headers", """p AS (SELECT conv_id AS doc_id, turn % 3 AS t, lower(CASE turn % 3 WHEN 0 THEN 'Controladora nove meses ' WHEN 1 THEN 'Consolidado 31/12/2020 ' ELSE '30/09/2021 controladora ' END || coalesce(text, '')) AS low FROM conversations WHERE turn IS NOT NULL),
f AS (SELECT doc_id, 'e' AS kind, unnest(list_filter([CASE WHEN contains(low, 'controladora') THEN 'controladora' END, CASE WHEN contains(low, 'consolidad') THEN 'consolidado' END], lambda x: x IS NOT NULL)) AS v FROM p WHERE t < 2
UNION ALL SELECT doc_id, 'w', unnest(list_filter([CASE WHEN regexp_matches(low, '(nove|9) meses') THEN '9M' END, CASE WHEN regexp_matches(low, '(tr[eê]s|3) meses') THEN '3M' END], lambda x: x IS NOT NULL)) FROM p WHERE t = 0
UNION ALL SELECT doc_id, 'p', unnest(regexp_extract_all(low, '\\b\\d{2}/\\d{2}/\\d{4}\\b')) FROM p),
g AS (SELECT doc_id, kind, string_agg(DISTINCT v, ',' ORDER BY v) AS v FROM f GROUP BY ALL), d AS (SELECT DISTINCT doc_id FROM p)
SELECT doc_id, coalesce(max(v) FILTER (kind = 'e'), '') AS entities, coalesce(max(v) FILTER (kind = 'p'), '') AS periods, coalesce(max(v) FILTER (kind = 'w'), '') AS windows FROM d LEFT JOIN g USING (doc_id) GROUP BY doc_id""")
def t21(spark, d):
    pages = spark.sql(PAGES, conversations=read(spark, d, "conversations")).filter("page_no is not null")
    out = st.page_headers(pages, pages, ["bp"], ["dre"])
    return out.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("entities", "periods", "windows")])


@query("t15_quality", "o AS (SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'bp' ELSE 'dre' END AS statement, o_orderkey % 3 <> 0 AS v FROM orders) SELECT doc_id, statement, count(*) AS accounts, count(*) FILTER (v) AS valued FROM o GROUP BY ALL")
def t15(spark, d):
    o = read(spark, d, "orders")
    value = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    return st.quality(o.select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, "bp").otherwise("dre").alias("statement"), value.alias("current"), F.lit(None).cast("double").alias("previous")))


LINES = "SELECT conv_id AS doc_id, turn AS page_no, text FROM {conversations} WHERE turn IS NOT NULL AND text IS NOT NULL"
LINES_SQL = "p AS (SELECT conv_id AS doc_id, turn AS page_no, text FROM conversations WHERE turn IS NOT NULL AND text IS NOT NULL), z AS (SELECT doc_id, page_no, string_split(text, chr(10)) AS a FROM p), l AS (SELECT doc_id, page_no, i - 1 AS line_no, trim(a[i]) AS line FROM z, unnest(generate_series(1, len(a))) g(i) WHERE trim(a[i]) <> '')"


def page_lines(spark, d):
    return pg.lines(spark.sql(LINES, conversations=read(spark, d, "conversations")))


@query("t8_sections", LINES_SQL + ", s AS (SELECT *, arg_max(CASE WHEN regexp_matches(lower(line), 'th') THEN 1 WHEN regexp_matches(lower(line), 'de') THEN 0 END, line_no) FILTER (regexp_matches(lower(line), 'th|de')) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS o FROM l) SELECT doc_id, page_no, count(*) AS n FROM s WHERE o = 1 GROUP BY ALL")
def t8(spark, d):
    return pg.sections(page_lines(spark, d), "th", "de").groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n"))


@query("t2_pages_of_type", "p AS (SELECT conv_id AS doc_id, turn AS page_no, (turn % 5) / 10.0 AS score, CASE turn % 4 WHEN 0 THEN 'bp' WHEN 1 THEN 'dre' WHEN 2 THEN 'other' ELSE 'unknown' END AS type FROM conversations WHERE turn IS NOT NULL) SELECT doc_id, type, count(DISTINCT page_no) AS pages, CAST(min(page_no) AS BIGINT) AS first FROM p WHERE score >= 0.2 AND type IN ('bp', 'dre') GROUP BY ALL")
def t2(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("bp", "dre", "other", "unknown"))), (F.col("turn") % 4 + 1).cast("int"))
    classes = read(spark, d, "conversations").filter("turn is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), (F.col("turn") % 5 / 10).alias("score"), kind.alias("type"))
    return pg.pages_of_type(classes).select("doc_id", "type", F.size("pages").cast("long").alias("pages"), F.array_min("pages").cast("long").alias("first"))


@query("t14_balance_sections", "s AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, CASE o_orderpriority WHEN '1-URGENT' THEN 'assets' WHEN '2-HIGH' THEN 'liabilities' END AS hit FROM orders), f AS (SELECT doc_id, line_no, arg_max(hit, line_no) FILTER (hit IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM s) SELECT doc_id, coalesce(section, '-') AS section, count(*) AS n FROM f GROUP BY ALL")
def t14(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("page_no"), F.col("o_orderkey").alias("line_no"), F.col("o_orderpriority").alias("description"))
    return pg.balance_sections(rows, {"urgent": "assets", "high": "liabilities"}).groupBy("doc_id", F.coalesce("section", F.lit("-")).alias("section")).agg(F.count(F.lit(1)).alias("n"))


@query("t22_document_report", "o AS (SELECT o_custkey AS doc_id, o_orderkey, o_orderpriority AS p FROM orders) SELECT doc_id, count(*) AS pages, count(*) FILTER (o_orderkey % 3 = 0) AS statement_pages, count(*) AS rows, count(*) FILTER (p = '1-URGENT') AS totals FROM o GROUP BY doc_id")
def t22(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 3 == 0, "bp").otherwise("other").alias("type"), F.when(F.col("o_orderpriority") == "1-URGENT", "Total do ativo").otherwise("Caixa").alias("description"))
    return pg.document_report(o, o)


@query("g6_ignored", "e AS (SELECT DISTINCT event_type || CAST(user_id % 20 AS VARCHAR) AS text FROM events) SELECT text FROM e")
def g6(spark, d):
    text = read(spark, d, "events").select(F.concat("event_type", F.col("user_id") % 20).alias("text"), "event_id")
    return learning.ignored(text.filter("event_id % 2 = 0").select("text"), text.filter("event_id % 2 = 1").select("text"))


@query("g8_manual_decisions", "e AS (SELECT event_type AS codigo, CAST(user_id % 20 AS VARCHAR) AS text FROM events) SELECT codigo, count(DISTINCT text) AS texts, count(*) AS frequency FROM e GROUP BY codigo")
def g8(spark, d):
    rows = read(spark, d, "events").select(F.col("event_id").alias("key"), (F.col("user_id") % 20).cast("string").alias("text"), F.col("event_type").alias("codigo"), "ts")
    return learning.manual_decisions(rows)[1].select("codigo", F.size("variations").cast("long").alias("texts"), "frequency")


@query("s25_training_report", "e AS (SELECT p_brand AS codigo, count(*) AS frequency, count(DISTINCT p_type) AS variations FROM part GROUP BY ALL) SELECT codigo, frequency, CAST(variations AS INT) AS variations FROM e ORDER BY frequency DESC, codigo LIMIT 20")
def s25(spark, d):
    learned = learning.variations(read(spark, d, "part").select(F.col("p_brand").alias("codigo"), F.col("p_type").alias("text")))
    return sinks.training_report(learned)


@query("s21_accounts", f"t AS ({ledger_sql('geo')}), g AS (SELECT {K}, codigo, row_no, saldo FROM t) SELECT {K}, row_no, codigo, round(CAST(saldo * 2 AS DOUBLE), 2) AS saldo_calculado, row_no % 2 = 0 AS ok FROM g")
def s21(spark, d):
    rows = ledger(spark, d, "geo")
    roll = rows.select(*tree.KEY, "codigo", (F.col("saldo") * 2).alias("saldo_calculado"), F.lit(0).alias("diff"), (F.col("row_no") % 2 == 0).alias("ok"))
    return double(sinks.accounts_table(rows, roll).select(*tree.KEY, "row_no", "codigo", "saldo_calculado", "ok"), "saldo_calculado")


@query("s22_verbatim", "o AS (SELECT o_custkey AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_no FROM orders) SELECT file_id, count(*) AS rows, FALSE AS truncated FROM o GROUP BY file_id")
def s22(spark, d):
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    table = read(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), at.alias("row_no"))
    return files.verbatim(table).groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"), F.max("truncated").alias("truncated"))


@query("l11_unique_labels", "o AS (SELECT o_custkey AS k, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS c, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS nth FROM orders) SELECT CAST(k AS VARCHAR) AS file_id, c AS col_no, CASE WHEN nth = 0 THEN p ELSE p || '.' || CAST(nth AS VARCHAR) END AS label FROM o")
def l11(spark, d):
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    header = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("file_id"), F.lit("").alias("sheet"), at.alias("col_no"), F.col("o_orderpriority").alias("label"))
    return layout.unique_labels(header).select("file_id", "col_no", "label")


@query("l15_filled_down", "e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS v FROM events) SELECT event_id, coalesce(arg_max(v, event_id) FILTER (v IS NOT NULL) OVER (PARTITION BY user_id ORDER BY event_id), '-') AS value FROM e")
def l15(spark, d):
    cells = read(spark, d, "events").select(F.col("user_id").alias("file_id"), F.lit("").alias("sheet"), F.col("event_id").alias("row_no"), F.lit(0).alias("col_no"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("value"))
    return layout.filled_down(cells).select(F.col("row_no").alias("event_id"), F.coalesce("value", F.lit("-")).alias("value"))


@query("l17_indented", "o AS (SELECT o_custkey AS k, o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN '1.' || CAST(o_orderkey AS VARCHAR) END AS dotted FROM orders), a AS (SELECT *, arg_max(dotted, n) FILTER (dotted IS NOT NULL) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM o) SELECT k, n AS row_no, coalesce(dotted, CASE WHEN up IS NULL THEN CAST(n AS VARCHAR) ELSE up || '.' || CAST(n AS VARCHAR) END) AS codigo FROM a")
def l17(spark, d):
    n = F.col("o_orderkey").cast("string")
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("row_no"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("1."), n)).otherwise(F.concat(F.lit("  "), n)).alias("codigo"))
    return layout.indented(rows, ["k"])


@query("x9_scaled", "o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 10 AS v FROM orders) SELECT o_orderkey, round(CAST(v AS DOUBLE) / 1000, 2) AS v FROM o WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 0 FROM o WHERE o_orderkey % 2 <> 0")
def x9(spark, d):
    value = F.when(F.col("o_orderkey") % 2 == 0, (F.floor("o_totalprice") * 10).cast("decimal(20,2)"))
    return double(read(spark, d, "orders").select("o_orderkey", numbers.scaled(value).alias("v")), "v")


@query("x24_humanized", "p AS (SELECT p_partkey AS id, lower(p_type) AS w FROM part), r AS (SELECT id, CASE WHEN contains(w, 'steel') THEN 'metal' WHEN contains(w, 'an') THEN 'other' END AS phrase FROM p) SELECT id, phrase AS phrases FROM r WHERE phrase IS NOT NULL")
def x24(spark, d):
    rules = spark.createDataFrame([(1, "steel", "metal"), (2, "an", "other")], "rule_no int, pattern string, phrase string")
    found = matching.humanized(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("warning")), rules)
    return found.select("id", F.array_join("phrases", ",").alias("phrases"))


@query("p18_income_check", f"t AS ({ledger_sql('geo')}), s AS (SELECT {K}, sum(saldo) AS s FROM t GROUP BY ALL) SELECT {K}, round(CAST(CASE WHEN ledger_id = 'L1' THEN 3 WHEN ledger_id = 'L2' THEN -s ELSE 0 END AS DOUBLE), 2) AS diff, ledger_id NOT IN ('L1', 'L2') AS ok FROM s")
def p18(spark, d):
    source = ledger(spark, d, "geo").groupBy(*tree.KEY).agg(tree.money(F.sum("saldo")).alias("total"))
    delivered = source.filter("ledger_id <> 'L2'").withColumn("total", tree.money(F.col("total") - 10 + F.when(F.col("ledger_id") == "L1", 3).otherwise(0)))
    uncovered = source.filter("ledger_id <> 'L2'").withColumn("total", tree.money(F.lit(10)))
    return double(projection.income_check(delivered, uncovered, source), "diff")


@query("p24_validate_matches", f"t AS ({ledger_sql('geo')}), m AS (SELECT {K}, row_no % 120 AS score, CASE WHEN row_no % 3 = 0 THEN NULL ELSE 'x' END AS alvo, CASE WHEN row_no % 6 = 0 THEN 'd' WHEN row_no % 3 = 0 THEN NULL ELSE 'y' END AS ad, row_no % 4 <> 0 AS syn FROM t) SELECT {K}, count(*) FILTER (score > 100) AS bad_score, count(*) FILTER ((alvo IS NULL) <> (ad IS NULL)) AS half_pairs, count(*) FILTER (alvo IS NOT NULL AND NOT syn) AS analytical, round(count(*) FILTER (alvo IS NOT NULL AND syn) / count(*) FILTER (syn), 6) AS rate FROM m GROUP BY ALL")
def p24(spark, d):
    no = F.col("row_no")
    rows = ledger(spark, d, "geo").select(*tree.KEY, (no % 120).alias("score"), F.when(no % 3 != 0, "x").alias("alvo"), F.when(no % 6 == 0, "d").when(no % 3 != 0, "y").alias("alvo_descricao"), (no % 4 != 0).alias("synthetic"))
    return projection.validate_matches(rows)


#: Nodes of four levels as JSON, each level's texts joined into the one above.
NESTED = f"""t AS ({ledger_sql('geo')}), n AS (SELECT {K}, codigo, any_value(descricao) AS descricao, len(string_split(codigo, '.')) AS d, list_transform(string_split(codigo, '.'), lambda s: CAST(s AS INT)) AS o FROM t GROUP BY ALL),
m AS (SELECT *, regexp_replace(codigo, '\\.[^.]+$', '') AS parent, '{{"codigo":"' || codigo || '","descricao":"' || descricao || '","nivel":' || d || ',"children":[' AS own FROM n),
l4 AS (SELECT {K}, parent AS codigo, string_agg(own || ']}}', ',' ORDER BY o) AS c FROM m WHERE d = 4 GROUP BY ALL),
l3 AS (SELECT {K}, parent AS codigo, string_agg(own || coalesce(c, '') || ']}}', ',' ORDER BY o) AS c FROM (SELECT m.*, c FROM m LEFT JOIN l4 USING (ledger_id, period, codigo)) WHERE d = 3 GROUP BY ALL),
l2 AS (SELECT {K}, parent AS codigo, string_agg(own || coalesce(c, '') || ']}}', ',' ORDER BY o) AS c FROM (SELECT m.*, c FROM m LEFT JOIN l3 USING (ledger_id, period, codigo)) WHERE d = 2 GROUP BY ALL)"""


@query("h22_nested_tree", NESTED + f" SELECT {K}, '[' || own || coalesce(c, '') || ']}}]' AS tree FROM (SELECT m.*, c FROM m LEFT JOIN l2 USING (ledger_id, period, codigo)) WHERE d = 1")
def h22(spark, d):
    rows = ledger(spark, d, "geo").groupBy(*tree.KEY, "codigo").agg(F.first("descricao").alias("descricao"))
    parents = tree.edges(rows).withColumnRenamed("child", "codigo")
    whole = rows.join(parents, [*tree.KEY, "codigo"], "left").withColumn("nivel", codes.level(F.col("codigo")))
    return sinks.nested_tree(whole, tree.KEY, ["descricao", "nivel"])


DECIDED = "e AS (SELECT event_type || '|' || CAST(user_id % 50 AS VARCHAR) AS key, max(event_id) AS m FROM events GROUP BY ALL), x AS (SELECT key, 'C' || CAST(m % 7 AS VARCHAR) AS codigo, m % 3 = 0 AS manual FROM e)"


def decided(spark, d):
    e = read(spark, d, "events").groupBy(F.concat_ws("|", "event_type", F.col("user_id") % 50).alias("key")).agg(F.max("event_id").alias("m"))
    return e.select("key", F.concat(F.lit("C"), F.col("m") % 7).alias("codigo"), (F.col("m") % 3 == 0).alias("manual"))


@query("m17_kept_decisions", DECIDED + " SELECT key, codigo FROM x WHERE NOT manual")
def m17k(spark, d):
    every = decided(spark, d)
    return matching.without_decisions(every, every.filter("manual")).select("key", "codigo")


@query("m17_decision_statistics", DECIDED + " SELECT count(*) AS decisions, count(*) FILTER (manual) AS manual, count(DISTINCT codigo) AS codes FROM x")
def m17s(spark, d):
    return matching.decision_statistics(decided(spark, d))


@query("s24_decision_lines", DECIDED + " SELECT key, '| ' || key || ' | ' || codigo || ' | ' || CASE WHEN manual THEN 'manual' ELSE 'auto' END || ' |' AS line FROM x")
def s24(spark, d):
    return sinks.decision_lines(decided(spark, d))


@query("f7_low_confidence", "p AS (SELECT p_brand AS b, p_partkey % 101 AS score, CASE WHEN p_partkey % 5 <> 0 THEN 'x' END AS codigo FROM part) SELECT b, count(*) FILTER (codigo IS NOT NULL AND score < 85) AS low, count(codigo) AS matched FROM p GROUP BY b")
def f7(spark, d):
    rows = read(spark, d, "part").select(F.col("p_brand").alias("b"), (F.col("p_partkey") % 101).alias("score"), F.when(F.col("p_partkey") % 5 != 0, "x").alias("codigo"))
    return matching.low_confidence(rows, ["b"])


@query("g10_top_codes", "e AS (SELECT p_type AS codigo, count(*) AS frequency FROM part GROUP BY ALL) SELECT codigo, frequency FROM e ORDER BY frequency DESC, codigo LIMIT 15")
def g10(spark, d):
    return learning.top_codes(learning.variations(read(spark, d, "part").select(F.col("p_type").alias("codigo"), F.col("p_name").alias("text"))))


@query("g7_applied_mappings", "c AS (SELECT DISTINCT p_brand AS codigo, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS classe, p_type AS text FROM part), k AS (SELECT p_brand AS codigo, min(CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END) AS cc FROM part GROUP BY ALL) SELECT DISTINCT text || '|' || classe AS key, c.codigo FROM c JOIN k ON k.codigo = c.codigo AND cc = classe")
def g7(spark, d):
    kind = F.when(F.col("p_size") % 2 == 0, "A").otherwise("B")
    part = read(spark, d, "part")
    curated = part.select(F.col("p_type").alias("text"), kind.alias("classe"), F.col("p_brand").alias("codigo")).distinct()
    chart = part.groupBy(F.col("p_brand").alias("codigo")).agg(F.min(kind).alias("classe"))
    return learning.applied_mappings(learning.checked_mappings(curated, chart)).select("key", "codigo")


@query("l4_l7_named_roles", NATIONS + " SELECT file_id, '' AS sheet, CAST(1 AS INT) AS description_col, CAST(2 AS INT) AS balance_col FROM s WHERE n >= 3")
def l4(spark, d):
    g = grid(spark, d)
    body, header = g.filter("row_no > 2"), g.filter("row_no = 1").withColumnRenamed("value", "label")
    many = read(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("file_id")).count().filter("count >= 3").select("file_id")
    return layout.named_roles(body.join(many, "file_id", "left_semi"), header).select("file_id", "sheet", "description_col", "balance_col")


@query("s13_named_table", "t AS (SELECT CAST(s_nationkey % 3 AS VARCHAR) AS file_id, CASE s_nationkey % 4 WHEN 0 THEN 'Resumo' WHEN 1 THEN 'Balancete' ELSE 'Outra' || CAST(s_nationkey % 4 AS VARCHAR) END AS sheet FROM supplier), c AS (SELECT file_id, sheet, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sheet = 'Resumo' DESC, sheet = 'Balancete' DESC, n DESC, sheet) AS k FROM c) SELECT file_id, sheet FROM r WHERE k = 1")
def s13(spark, d):
    kind = F.col("s_nationkey") % 4
    rows = read(spark, d, "supplier").select((F.col("s_nationkey") % 3).cast("string").alias("file_id"), F.when(kind == 0, "Resumo").when(kind == 1, "Balancete").otherwise(F.concat(F.lit("Outra"), kind)).alias("sheet"), F.col("s_suppkey").cast("string").alias("codigo"))
    return layout.table_catalogue(rows, "resumo").filter("chosen").select("file_id", "sheet")


PADDED = "SELECT c_custkey % 5 AS k, c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '1.' || CAST(c_custkey AS STRING) || '.00.000' WHEN c_custkey % 5 = 1 THEN '1.' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN '.00' ELSE '' END WHEN c_custkey % 5 = 2 THEN '2.' || CAST(floor(c_custkey / 10) AS INT) || CASE WHEN c_custkey % 10 = 2 THEN '.00.00' ELSE '.00.000' END ELSE '3.1.' || CAST(c_custkey AS STRING) END AS codigo FROM {customer}"


@query("l22_trimmed", f"q AS ({PADDED.format(customer='customer')}) SELECT k, id, CASE WHEN k = 0 THEN regexp_replace(codigo, '(\\.0+)+$', '') ELSE codigo END AS codigo FROM q")
def l22(spark, d):
    return layout.trimmed(spark.sql(PADDED, customer=read(spark, d, "customer")), ["k"]).select("k", "id", "codigo")


@query("f2_set_aside", f"t AS ({ledger_sql('full')}) SELECT {K}, CASE WHEN codigo LIKE '3%' THEN 'aside' ELSE 'balance' END AS part, count(*) AS n FROM t GROUP BY ALL")
def f2(spark, d):
    balance, aside = delivery.set_aside(saved(ledger(spark, d, "full"), "ledger"))
    count = lambda df, part: df.groupBy(*tree.KEY, F.lit(part).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return count(balance, "balance").unionByName(count(aside, "aside"))


@query("c6_distinct_lines", "o AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS description, o_orderkey % 3 AS value FROM orders) SELECT doc_id, min(line_no) AS line_no, arg_min(description, line_no) AS description, value FROM o GROUP BY doc_id, lower(description), value")
def c6(spark, d):
    o = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("page_no"), o.alias("line_no"), F.when(o % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority")).alias("description"), (o % 3).alias("value"))
    return pg.distinct_lines(rows).select("doc_id", "line_no", "description", "value")


@query("x23_output_names", "s AS (SELECT s_suppkey AS id, s_suppkey % 4 AS m FROM supplier) SELECT id, CASE m WHEN 0 THEN 'Casa A B' WHEN 1 THEN 'Cliente' WHEN 2 THEN 'RBM' ELSE 'a.b' END || '_' || CASE WHEN id % 3 = 0 THEN '2020' ELSE '2020-' || CAST(2020 + id % 3 AS VARCHAR) END AS name FROM s")
def x23(spark, d):
    m = F.col("s_suppkey") % 4
    customer = F.when(m == 0, 'Casa:  A/ "B"').when(m == 1, " .. ").when(m == 2, "RBM.").otherwise("a.b")
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), names.output_name(customer, F.lit(2020), 2020 + F.col("s_suppkey") % 3).alias("name"))
