"""Queries of layout inference, page text and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.functions import codes
from ledgerweave.operators import pages as pg
from ledgerweave.plans.ledgers import ledger, ledger_sql
from ledgerweave.plans.tree_queries import K, double
from ledgerweave.sources import files, layout
from ledgerweave.sources.stage import saved
from ledgerweave.streaming import learning

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = "WITH " + sql
        return f

    return add


def pages(spark, d):
    """Turns of conversations as pages of a document."""
    return spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")


P = "p AS (SELECT conv_id AS doc_id, turn AS page_no, text FROM conversations), z AS (SELECT doc_id, page_no, string_split(text, chr(10)) AS a FROM p), l AS (SELECT doc_id, page_no, i - 1 AS line_no, trim(a[i]) AS line FROM z, unnest(generate_series(1, len(a))) g(i) WHERE trim(a[i]) <> '') "
DOCS = "z AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), l AS (SELECT doc_id, 0 AS page_no, i - 1 AS line_no, trim(a[i]) AS line FROM z, unnest(generate_series(1, len(a))) g(i) WHERE trim(a[i]) <> '') "


def doc_lines(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lit(0).alias("page_no"), "text")
    return pg.lines(docs)


@query("t3_lines", DOCS + "SELECT doc_id, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM l GROUP BY doc_id")
def t3(spark, d):
    return doc_lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("line")).alias("chars"))


@query("t4_unwrapped", DOCS + ", b AS (SELECT *, lag(line) OVER w AS q FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), s AS (SELECT *, count(*) FILTER (q IS NULL OR regexp_matches(line, '[0-9]') OR regexp_matches(q, '[0-9]') OR q LIKE '%:') OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM b) SELECT doc_id, min(line_no) AS line_no, md5(string_agg(line, ' ' ORDER BY line_no)) AS digest FROM s GROUP BY doc_id, g")
def t4(spark, d):
    return pg.unwrapped(doc_lines(spark, d)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("digest"))


NOISE = "copyright|licen[sc]e|https?://"


@query("t5_noise_score", DOCS + f", r AS (SELECT *, length(line) < 3 OR regexp_matches(lower(line), '{NOISE}') OR row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY line_no) > 1 AS gone FROM l) SELECT doc_id, page_no, count(*) AS lines, count(*) FILTER (gone) AS removed, round(avg(CASE WHEN gone THEN 1 ELSE 0 END), 6) AS score FROM r GROUP BY ALL")
def t5(spark, d):
    return pg.noise_score(doc_lines(spark, d), NOISE)


@query("t6_before_signature", DOCS + ", s AS (SELECT *, max(CASE WHEN regexp_matches(lower(line), 'copyright|licen[sc]e') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seen FROM l) SELECT doc_id, line_no, line FROM s WHERE seen = 0")
def t6(spark, d):
    return pg.before_signature(doc_lines(spark, d), "copyright|licen[sc]e").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("t7_repeated_lines", "z AS (SELECT source AS doc_id, doc_id AS page_no, string_split(text, chr(10)) AS a FROM documents), l AS (SELECT doc_id, page_no, trim(a[i]) AS line FROM z, unnest(generate_series(1, len(a))) g(i) WHERE trim(a[i]) <> '') SELECT doc_id, line, count(DISTINCT page_no) AS pages FROM l GROUP BY ALL HAVING count(DISTINCT page_no) >= 2")
def t7(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), "text")
    return pg.repeated_lines(pg.lines(docs))


@query("t1_page_classes")
def t1(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lit(0).alias("page_no"), "text")
    return pg.page_classes(docs, {"english": [r"\bthe\b", r"\band\b"], "german": [r"\bder\b", r"\bund\b"]}, {"english": [r"\bof\b"], "german": [r"\bsich\b"]}, ["copyright", "http"])


@query("t20_text_share", "s AS (SELECT conv_id AS doc_id, avg(CASE WHEN length(trim(coalesce(text, ''))) > 50 THEN 1 ELSE 0 END) AS share FROM conversations GROUP BY ALL) SELECT doc_id, share, CASE WHEN share >= 0.8 THEN 'native' WHEN share > 0.1 THEN 'hybrid' ELSE 'scanned' END AS kind FROM s")
def t20(spark, d):
    return pg.text_share(pages(spark, d))


#: Orders as statement lines: description, current and previous amount; every fifth line sums the four before it.
STATEMENT = "o AS (SELECT o_custkey AS doc_id, CAST(0 AS INT) AS page_no, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS line_no, CAST(o_totalprice AS DECIMAL(20,2)) AS v, o_orderpriority FROM orders)"


def statement_lines(spark, d):
    return spark.sql("WITH " + STATEMENT.replace("FROM orders", "FROM {orders}") + " SELECT doc_id, page_no, line_no, 'Order ' || substr(o_orderpriority, 3) || '  ' || replace(CAST(v AS STRING), '.', ',') || ' ' || replace(CAST(CAST(v / 2 AS DECIMAL(20,2)) AS STRING), '.', ',') AS line FROM o", orders=spark.read.parquet(f"{d}/orders.parquet"))


@query("t12_structured", STATEMENT + " SELECT doc_id, line_no, 'Order ' || substr(o_orderpriority, 3) AS description, round(CAST(v AS DOUBLE), 2) AS current FROM o")
def t12(spark, d):
    return double(pg.structured(statement_lines(spark, d)).select("doc_id", "line_no", "description", "current"), "current")


@query("t13_block_totals", STATEMENT + " SELECT doc_id, round(CAST(sum(v) AS DOUBLE), 2) AS parts, round(CAST(sum(v) + CASE doc_id % 4 WHEN 0 THEN 0.01 WHEN 1 THEN 0.02 WHEN 2 THEN -500 ELSE 0 END AS DOUBLE), 2) AS total, doc_id % 4 IN (0, 3) AS ok FROM o GROUP BY doc_id")
def t13(spark, d):
    rows = pg.structured(statement_lines(spark, d))
    off = F.element_at(F.array(*map(F.lit, (0.01, 0.02, -500.0, 0.0))), (F.col("doc_id") % 4 + 1).cast("int")).cast("decimal(20,2)")
    total = rows.groupBy("doc_id", "page_no").agg(F.max("line_no").alias("m"), F.sum("current").alias("current")).select("doc_id", "page_no", (F.col("m") + 1).alias("line_no"), F.lit("Total").alias("description"), (F.col("current") + off).cast("decimal(20,4)").alias("current"), F.lit(None).cast("decimal(20,4)").alias("previous"))
    return double(pg.block_totals(rows.unionByName(total)).select("doc_id", "parts", "total", "ok"), "parts", "total")


@query("t9_mentions", "m AS (SELECT doc_id, regexp_extract_all(text, '\\b((?:19|20)\\d\\d)\\b', 1) AS y FROM documents), u AS (SELECT doc_id, unnest(y) AS y FROM m), g AS (SELECT doc_id, string_agg(DISTINCT y, ',' ORDER BY y) AS years FROM u GROUP BY doc_id) SELECT doc_id, coalesce(years, '') AS years FROM documents LEFT JOIN g USING (doc_id)")
def t9(spark, d):
    return pg.mentions(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lit(0).alias("page_no"), "text")).select("doc_id", F.array_join("years", ",").alias("years"))


def cells(spark, d, varied=False):
    """The ledger as a cell table: a counter, the code, the description, a constant and the balance; varied: without codes in L4, without amounts in L3."""
    no, code, balance = F.col("row_no").cast("string"), F.col("codigo"), F.col("saldo").cast("string")
    if varied:
        no, code, balance = F.when(F.col("ledger_id") == "L4", F.concat(F.lit("linha "), no)).otherwise(no), F.when(F.col("ledger_id") == "L4", "Conta").otherwise(code), F.when(F.col("ledger_id") == "L3", "sem valor").otherwise(F.replace(F.col("saldo").cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(",")))
    t = ledger(spark, d, "full").select("ledger_id", "period", F.col("row_no"), F.array(no, code, F.concat(F.lit("Conta "), F.col("descricao")), F.lit("x"), balance).alias("v"))
    return saved(t.select(F.col("ledger_id").alias("file_id"), F.col("period").cast("string").alias("sheet"), "row_no", F.posexplode("v").alias("col_no", "value")), "cells")


@query("l10_column_roles", f"t AS ({ledger_sql('full')}) SELECT DISTINCT ledger_id AS file_id, CAST(period AS VARCHAR) AS sheet, CASE WHEN ledger_id = 'L3' THEN -1 ELSE 4 END AS balance_col, CASE WHEN ledger_id = 'L4' THEN 0 ELSE 2 END AS description_col, CASE WHEN ledger_id = 'L4' THEN -1 ELSE 0 END AS code_col FROM t")
def l10(spark, d):
    return layout.roles(cells(spark, d, True)).select("file_id", "sheet", F.coalesce("balance_col", F.lit(-1)).alias("balance_col"), "description_col", F.coalesce("code_col", F.lit(-1)).alias("code_col"))


@query("l2_looks_like_ledger", f"t AS ({ledger_sql('full')}) SELECT DISTINCT ledger_id AS file_id, CAST(period AS VARCHAR) AS sheet, ledger_id <> 'L4' AS ledger FROM t")
def l2(spark, d):
    return layout.looks_like_ledger(cells(spark, d, True))


@query("l12_records", f"t AS ({ledger_sql('full')}) SELECT ledger_id AS file_id, CAST(period AS VARCHAR) AS sheet, row_no, CAST(row_no AS VARCHAR) AS codigo, 'Conta ' || descricao AS descricao, round(CAST(saldo AS DOUBLE), 2) AS saldo FROM t")
def l12(spark, d):
    return double(layout.records(cells(spark, d)).select("file_id", "sheet", "row_no", "codigo", "descricao", "saldo"), "saldo")


@query("l16_compacted", "e AS (SELECT event_id, list_filter([event_type, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END, CAST(user_id AS VARCHAR)], lambda v: v <> '') AS v FROM events) SELECT CAST(event_id AS BIGINT) AS row_no, CAST(i - 1 AS INT) AS col_no, v[i] AS value FROM e, unnest(generate_series(1, len(v))) g(i)")
def l16(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.lit("f").alias("file_id"), F.lit("s").alias("sheet"), F.col("event_id").alias("row_no"), F.posexplode(F.array(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "x").otherwise(""), F.col("user_id").cast("string"))).alias("col_no", "value"))
    return layout.compacted(e).select("row_no", "col_no", "value")


@query("l21_pointed_codes", f"t AS (WITH g AS ({ledger_sql('geo')}) SELECT ledger_id, period, codigo FROM g UNION ALL SELECT ledger_id, period, '2' || substr(codigo, 2) FROM g) SELECT DISTINCT {K}, string_split(codigo, '.')[1] || CASE WHEN codigo LIKE '%.%' THEN lpad(string_split(codigo, '.')[2], 2, '0') ELSE '' END || CASE WHEN codigo LIKE '%.%.%' THEN lpad(string_split(codigo, '.')[3], 2, '0') ELSE '' END || CASE WHEN codigo LIKE '%.%.%.%' THEN lpad(string_split(codigo, '.')[4], 8, '0') ELSE '' END AS original, CAST(len(string_split(codigo, '.')) AS INT) AS nivel FROM t")
def l21(spark, d):
    part = lambda i, n: F.coalesce(F.lpad(F.try_element_at(F.split("codigo", "[.]"), F.lit(i)), n, "0"), F.lit(""))
    flat = ledger(spark, d, "geo").withColumn("codigo", F.concat(F.substring("codigo", 1, 1), part(2, 2), part(3, 2), part(4, 8)))
    flat = flat.unionByName(flat.withColumn("codigo", F.concat(F.lit("2"), F.expr("substring(codigo, 2)"))))  # a length that one code has is no level
    return layout.pointed(flat, ["ledger_id", "period"]).select("ledger_id", "period", F.col("codigo_original").alias("original"), codes.level(F.col("codigo")).alias("nivel")).distinct()


@query("s4_delimiter_vote", "d AS (SELECT event_type AS file_id, CASE length(event_type) % 4 WHEN 0 THEN ';' WHEN 1 THEN ',' WHEN 2 THEN chr(9) ELSE '|' END AS delimiter, min(event_id % 50) AS low FROM events GROUP BY ALL) SELECT file_id, delimiter FROM d WHERE low < 50")
def s4(spark, d):
    mark = F.element_at(F.array(*map(F.lit, (";", ",", "\t", "|"))), F.char_length("event_type") % 4 + 1)
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("file_id"), (F.col("event_id") % 50).alias("row_no"), F.concat("event_id", mark, "user_id", mark, F.when(F.col("event_id") % 3 == 0, "a;b,c").otherwise("a"), mark, F.lit("z")).alias("line"))
    return files.delimiter(e)


@query("g1_new_inputs", "s AS (SELECT DISTINCT user_id FROM events WHERE event_id < 100) SELECT event_id FROM events WHERE user_id NOT IN (FROM s)")
def g1(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return learning.new_inputs(e, e.filter("event_id < 100"), "user_id").select("event_id")


@query("g3_variations", "e AS (SELECT event_type AS codigo, CAST(user_id AS VARCHAR) AS text FROM events) SELECT codigo, array_to_string(list_sort(list(DISTINCT text)), ',') AS variations, count(*) AS frequency FROM e GROUP BY codigo")
def g3(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("codigo"), F.col("user_id").cast("string").alias("text"), "event_id")
    old, new = (learning.variations(e.filter(F.col("event_id") % 2 == i)) for i in (0, 1))
    return learning.merged_variations(old, new).withColumn("variations", F.array_join("variations", ","))


@query("g2_metrics", "e AS (SELECT event_type, event_id % 2 = 0 AS s, event_id % 5 = 0 AS g, event_id % 3 = 0 AS a FROM events) SELECT event_type, count(*) AS total, count(*) FILTER (s) AS synthetic, count(*) FILTER (s AND g) AS filtered, count(*) FILTER (s AND NOT g) AS attempted, count(*) FILTER (s AND NOT g AND a) AS matched, count(*) FILTER (s AND NOT g AND NOT a) AS review FROM e GROUP BY ALL")
def g2(spark, d):
    i = F.col("event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", (i % 2 == 0).alias("synthetic"), (i % 5 == 0).alias("garbage"), (i % 3 == 0).alias("accepted"))
    return learning.input_metrics(e, "event_type")


@query("g7_curated_mappings", "c AS (SELECT DISTINCT p_brand AS codigo, CASE WHEN p_brand < 'Brand#3' THEN 'ATIVO' ELSE 'PASSIVO' END AS classe FROM part), m AS (SELECT p_partkey AS text, CASE WHEN p_partkey % 7 = 0 THEN 'none' ELSE p_brand END AS codigo, 'ATIVO' AS classe FROM part) SELECT CASE WHEN c.codigo IS NULL THEN 'unknown code' WHEN c.classe <> m.classe THEN 'class clash' END AS reason, count(*) AS n FROM m LEFT JOIN c USING (codigo) GROUP BY ALL")
def g7(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    chart = part.select(F.col("p_brand").alias("codigo"), F.when(F.col("p_brand") < "Brand#3", "ATIVO").otherwise("PASSIVO").alias("classe")).distinct()
    curated = part.select(F.col("p_partkey").alias("text"), F.when(F.col("p_partkey") % 7 == 0, "none").otherwise(F.col("p_brand")).alias("codigo"), F.lit("ATIVO").alias("classe"))
    return learning.checked_mappings(curated, chart).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("l27_series", "s AS (SELECT o_custkey AS file_id, year(o_orderdate) AS period FROM orders) SELECT file_id, count(period) = count(*) AND count(DISTINCT period) = count(*) AS is_series FROM s GROUP BY ALL")
def l27(spark, d):
    return layout.series(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("file_id"), F.year("o_orderdate").alias("period")))


@query("l28_source_problems", "s AS (SELECT o_custkey AS file_id, year(o_orderdate) AS period FROM orders), n AS (SELECT file_id, count(*) AS n, count(DISTINCT period) AS k FROM s GROUP BY ALL) SELECT file_id, 'repeated period' AS problem FROM n WHERE k < n UNION ALL SELECT file_id, 'too many periods' FROM n WHERE k > 5")
def l28(spark, d):
    return layout.source_problems(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("file_id"), F.year("o_orderdate").alias("period")))


@query("s15_table_catalogue", f"t AS (SELECT ledger_id, period, codigo FROM ({ledger_sql('full')}) q UNION ALL SELECT 'F0', 2020, CAST(s_suppkey AS STRING) FROM supplier), c AS (SELECT ledger_id AS file_id, CAST(period AS VARCHAR) AS sheet, count(*) AS rows, bool_or(codigo LIKE '%.%') AS has_tree FROM t GROUP BY ALL) SELECT file_id, sheet, rows, has_tree, CASE WHEN has_tree THEN 'ledger' ELSE 'other' END AS kind, row_number() OVER (PARTITION BY file_id ORDER BY has_tree DESC, rows DESC, sheet) = 1 AS chosen FROM c")
def s15(spark, d):
    flat = spark.read.parquet(f"{d}/supplier.parquet").select(F.lit("F0").alias("file_id"), F.lit("2020").alias("sheet"), F.col("s_suppkey").cast("string").alias("codigo"))
    t = ledger(spark, d, "full").select(F.col("ledger_id").alias("file_id"), F.col("period").cast("string").alias("sheet"), "codigo")
    return layout.table_catalogue(t.unionByName(flat))


@query("t16_account_lines", STATEMENT + " SELECT doc_id, line_no, 'Order ' || substr(o_orderpriority, 3) AS description, round(CAST(v AS DOUBLE), 2) AS value FROM o")
def t16(spark, d):
    return double(pg.account_lines(statement_lines(spark, d)).select("doc_id", "line_no", "description", "value"), "value")


@query("g5_sessions", "m AS (SELECT CAST(event_id % 20 AS BIGINT) AS session, count(*) AS attempted, count(*) FILTER (event_type = 'click') AS matched FROM events GROUP BY ALL) SELECT session, attempted, matched, CAST(sum(attempted) OVER w AS BIGINT) AS all_attempted, CAST(sum(matched) OVER w AS BIGINT) AS all_matched, round((sum(matched) OVER w) / (sum(attempted) OVER w), 6) AS rate FROM m WINDOW w AS (ORDER BY session)")
def g5(spark, d):
    m = spark.read.parquet(f"{d}/events.parquet").groupBy((F.col("event_id") % 20).alias("session")).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("event_type") == "click").alias("matched"))
    return learning.sessions(m.withColumn("ts", F.col("session")), F.floor(F.col("ts") / 4)).drop("ts")


@query("g10_dictionary_summary", "e AS (SELECT event_type AS codigo, count(DISTINCT user_id) AS v, count(*) AS f FROM events GROUP BY ALL) SELECT count(*) AS codes, CAST(sum(v) AS BIGINT) AS variations, CAST(sum(f) AS BIGINT) AS frequency FROM e")
def g10(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("codigo"), F.col("user_id").cast("string").alias("text"))
    return learning.dictionary_summary(learning.variations(e))


@query("g9_review_items", "m AS (SELECT DISTINCT event_type AS file_id, user_id AS text FROM events WHERE event_id % 3 <> 0) SELECT file_id, text FROM m WHERE text % 5 <> 0")
def g9(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("event_type").alias("file_id"), F.col("user_id").alias("text"), (F.col("event_id") % 3 == 0).alias("accepted"))
    return learning.review_items(rows, e.select(F.col("user_id").alias("text")).filter("text % 5 = 0").distinct())


#: Chains of sizes, circles of three brands, a brand's way into a circle; in other languages, and some in capitals.
SYNONYMS = """SELECT 'phrase' AS kind, CAST(NULL AS STRING) AS lang, CAST(p_size AS INT) AS place, concat('Tamanho ', CAST(p_size AS STRING)) AS key, concat('tamanho ', CAST(least(p_size + 1, 51) AS STRING)) AS value FROM {part}
UNION ALL SELECT 'phrase', 'en', CAST(p_size AS INT), concat('size  ', CAST(p_size AS STRING)), concat('tamanho ', CAST(p_size AS STRING)) FROM {part}
UNION ALL SELECT 'phrase', 'es', CAST(100 + p_size AS INT), concat('TAMANHO ', CAST(p_size AS STRING)), 'nunca' FROM {part}
UNION ALL SELECT 'phrase', CAST(NULL AS STRING), 0, concat('roda ', CAST(p_size % 30 AS STRING)), concat('roda ', CAST(CASE WHEN p_size % 3 = 2 THEN p_size % 30 - 2 ELSE p_size % 30 + 1 END AS STRING)) FROM {part}
UNION ALL SELECT 'phrase', 'en', 0, concat('entra ', CAST(p_size % 30 AS STRING)), concat('roda ', CAST(p_size % 30 AS STRING)) FROM {part}
UNION ALL SELECT 'token', CAST(NULL AS STRING), CAST(p_partkey AS INT), p_brand, p_type FROM {part}"""


@query("x19_chains", f"""RECURSIVE e AS (SELECT DISTINCT * FROM ({SYNONYMS.replace('STRING', 'VARCHAR').format(part='part')})),
m AS (SELECT kind, trim(regexp_replace(lower(key), '\\s+', ' ', 'g')) AS key, arg_min(value, (lang IS NOT NULL, CASE WHEN lang IS NULL THEN -place ELSE place END)) AS value FROM e GROUP BY ALL),
w(key, way) AS (SELECT key, [value] FROM m WHERE kind = 'phrase' UNION ALL SELECT w.key, list_append(way, m.value) FROM w JOIN m ON m.kind = 'phrase' AND m.key = way[-1] WHERE len(way) < 6 AND way[-1] <> w.key AND NOT list_contains(way[:-2], way[-1]))
SELECT kind, key, value FROM m WHERE kind = 'token' UNION ALL SELECT 'phrase', key, arg_max(way[-1], len(way)) FROM w GROUP BY key""")
def x19(spark, d):
    from ledgerweave.operators.matching import synonym_map

    return synonym_map(spark.sql(SYNONYMS, part=spark.read.parquet(f"{d}/part.parquet")))
