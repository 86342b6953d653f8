"""Queries of scalar functions, matching and the chart, on parts, orders and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.functions import codes, numbers, text
from ledgerweave.operators import chart as ch
from ledgerweave.operators import matching as m
from ledgerweave.operators import projection
from ledgerweave.plans.ledgers import ledger, ledger_sql
from ledgerweave.plans.tree_queries import double
from ledgerweave.sources import layout, names

QUERIES, SQL = {}, {}

#: Order totals printed in six ways.
PRINTED = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN p WHEN 1 THEN replace(p, '.', ',') WHEN 2 THEN '(' || replace(p, '.', ',') || ')' WHEN 3 THEN 'R$ ' || p || ' C' WHEN 4 THEN '-' || p ELSE 'abc' END AS raw FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS STRING) AS p FROM {orders}) q"""
#: Part types and names as a chart: synthetic types, analytical parts.
CHART = """SELECT '1.' || CAST(t AS STRING) || '.' || CAST(p_partkey AS STRING) AS codigo, p_name || ' ' || p_brand AS descricao, 'A' AS tipo, '1.' || CAST(t AS STRING) AS parent_id, p_brand AS brand, p_size, p_partkey AS row_no FROM (SELECT *, length(p_type) AS t FROM {part}) q
UNION ALL SELECT DISTINCT '1.' || CAST(length(p_type) AS STRING), 'Tipo ' || CAST(length(p_type) AS STRING), 'S', '1', '', 0, CAST(0 AS BIGINT) FROM {part}
UNION ALL SELECT DISTINCT '1', 'Ativo', 'S', CAST(NULL AS STRING), '', 0, CAST(0 AS BIGINT) FROM {part}"""


def from_sql(spark, d, sql, *tables):
    return spark.sql(sql, **{t: spark.read.parquet(f"{d}/{t}.parquet") for t in tables})


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = "WITH RECURSIVE " + sql
        return f

    return add


PR = "w AS (" + PRINTED.replace("{orders}", "orders") + ") "
CT = "c AS (" + CHART.replace("{part}", "part") + ") "


@query("x3_parse_amount", PR + "SELECT o_orderkey, CASE WHEN raw = 'abc' THEN NULL ELSE CAST(replace(regexp_replace(raw, '[^0-9.,]', '', 'g'), ',', '.') AS DOUBLE) * CASE WHEN raw LIKE '-%' OR raw LIKE '(%' THEN -1 ELSE 1 END END AS valor FROM w")
def x3(spark, d):
    return double(from_sql(spark, d, PRINTED, "orders").select("o_orderkey", numbers.parse_amount(F.col("raw")).alias("valor")), "valor")


@query("x4_amount_or_zero", PR + "SELECT count(*) AS n, count(*) FILTER (raw = 'abc') AS zero, round(sum(CASE WHEN raw = 'abc' THEN 0 ELSE CAST(CAST(replace(regexp_replace(raw, '[^0-9.,]', '', 'g'), ',', '.') AS DECIMAL(20,2)) AS DECIMAL(38,2)) END)::DOUBLE, 2) AS total FROM w")
def x4(spark, d):
    v = F.abs(numbers.parse_amount_or(F.col("raw")))
    return double(from_sql(spark, d, PRINTED, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_if(v == 0).alias("zero"), F.sum(v).alias("total")), "total")


@query("x5_statement_number", PR + "SELECT o_orderkey, CASE WHEN regexp_matches(regexp_replace(raw, '[Rr]\\$', ''), '[A-Za-z]') THEN NULL ELSE CAST(replace(regexp_replace(raw, '[^0-9.,]', '', 'g'), ',', '.') AS DOUBLE) * CASE WHEN raw LIKE '-%' OR raw LIKE '(%' THEN -1 ELSE 1 END END AS valor FROM w")
def x5(spark, d):
    return double(from_sql(spark, d, PRINTED, "orders").select("o_orderkey", numbers.parse_statement_number(F.col("raw")).alias("valor")), "valor")


@query("x6_simple_number", PR + "SELECT o_orderkey, TRY_CAST(replace(replace(replace(regexp_replace(raw, '[R$ ]', '', 'g'), ',', '.'), '(', ''), ')', '') AS DOUBLE) * CASE WHEN raw LIKE '(%' THEN -1 ELSE 1 END AS valor FROM w")
def x6(spark, d):
    return double(from_sql(spark, d, PRINTED, "orders").select("o_orderkey", numbers.parse_simple_number(F.col("raw")).alias("valor")), "valor")


@query("x7_token_number", PR + "SELECT o_orderkey, CASE WHEN raw = 'abc' THEN NULL ELSE CAST(replace(regexp_replace(raw, '[^0-9.,]', '', 'g'), ',', '.') AS DOUBLE) * CASE WHEN raw LIKE '-%' OR raw LIKE '(%' THEN -1 ELSE 1 END END AS valor FROM w")
def x7(spark, d):
    return double(from_sql(spark, d, PRINTED, "orders").select("o_orderkey", numbers.parse_token(F.col("raw")).alias("valor")), "valor")


@query("x8_unreadable", PR + "SELECT count(*) AS n, count(*) FILTER (raw = 'abc') AS unreadable FROM w")
def x8(spark, d):
    raw = F.col("raw")
    return from_sql(spark, d, PRINTED, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_if(numbers.unreadable([raw], [numbers.parse_amount(raw)])).alias("unreadable"))


LEDGER = f"t AS ({ledger_sql('full')}) "


@query("x1_normalized", "t AS (" + ledger_sql("full") + ") SELECT DISTINCT descricao, trim(regexp_replace(lower(strip_accents(descricao)), '\\s+', ' ', 'g')) AS texto FROM t")
def x1(spark, d):
    return ledger(spark, d, "full").select("descricao", text.normalized(F.col("descricao")).alias("texto")).distinct()


@query("x10_code_parts", "t AS (" + ledger_sql("full") + ") SELECT DISTINCT codigo, CAST(len(string_split(codigo, '.')) AS INT) AS nivel, CASE left(codigo, 1) WHEN '1' THEN 'ATIVO' WHEN '2' THEN 'PASSIVO' ELSE 'RESULTADO' END AS classe, CASE left(codigo, 1) WHEN '3' THEN 'COMPENSACAO' WHEN '4' THEN 'PASSIVO' ELSE 'ATIVO' END AS papel, left(codigo, 1) = '3' AS fora FROM t")
def x10(spark, d):
    c = F.col("codigo")
    return ledger(spark, d, "full").select("codigo", codes.level(c).alias("nivel"), codes.account_class(c).alias("classe"), codes.bank_role(c).alias("papel"), codes.is_off_balance(c).alias("fora")).distinct()


@query("x15_row_kinds", "t AS (" + ledger_sql("full") + ") SELECT ledger_id, period, count(*) AS n, count(*) FILTER (length(regexp_replace(descricao, '[^\\p{L}]', '', 'g')) < 2) AS garbage, count(*) FILTER (regexp_matches(lower(descricao), '^total (do )?(ativo|passivo)$')) AS totals FROM t GROUP BY ALL")
def x15(spark, d):
    e = F.col("descricao")
    return ledger(spark, d, "full").groupBy("ledger_id", "period").agg(F.count(F.lit(1)).alias("n"), F.count_if(text.is_garbage(e)).alias("garbage"), F.count_if(text.is_grand_total(e)).alias("totals"))


@query("x18_expansion", "t AS (SELECT DISTINCT p_type FROM part) SELECT p_type, array_to_string(list_transform(string_split(replace(lower(p_type), 'small plated', 'chapeado pequeno'), ' '), lambda w: CASE w WHEN 'tin' THEN 'estanho' WHEN 'brass' THEN 'latao' ELSE w END), ' ') AS texto FROM t")
def x18(spark, d):
    empty = F.create_map().cast("map<string,string>")
    tokens = F.create_map(*map(F.lit, ("tin", "estanho", "brass", "latao")))
    phrases = F.array(F.struct(F.lit("small plated").alias("key"), F.lit("chapeado pequeno").alias("value")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_type").distinct().select("p_type", text.expanded(F.col("p_type"), empty, phrases, tokens).alias("texto"))


@query("l22_unpadded", "t AS (" + ledger_sql("geo") + "), p AS (SELECT DISTINCT codigo, codigo || '.00.000' AS padded FROM t) SELECT codigo, padded, codigo AS trimmed FROM p")
def l22(spark, d):
    rows = ledger(spark, d, "geo").select("codigo").distinct().withColumn("padded", F.concat("codigo", F.lit(".00.000")))
    return rows.withColumn("trimmed", codes.unpadded(F.col("padded")))


@query("m1_index", CT + "SELECT trim(lower(descricao)) AS text, count(*) AS n, min(codigo) AS codigo FROM c GROUP BY ALL")
def m1(spark, d):
    return m.build_index(from_sql(spark, d, CHART, "part")).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("codigo").alias("codigo"))


def asked(spark, d):
    """Part names with a letter lost, once per distinct text."""
    rows = spark.read.parquet(f"{d}/part.parquet").select(text.normalized(F.concat(F.substring("p_name", 1, 4), F.substring("p_name", 6, 200))).alias("query"), F.when(F.col("p_size") % 2 == 0, "ATIVO").otherwise(F.lit(None)).alias("q_classe"))
    none = F.lit(None).cast("string")
    return rows.distinct().withColumns({"q_natureza": none, "q_prazo": none, "q_tipo": F.lit("A"), "q_hint": none})


def index(spark, d):
    return m.build_index(from_sql(spark, d, CHART, "part"))


@query("m3_similar_texts")
def m3(spark, d):
    return m.similar_texts(asked(spark, d), index(spark, d), limit=40)


@query("m12_match")
def m12(spark, d):
    return m.match(asked(spark, d), index(spark, d)).withColumn("candidates", F.array_join("candidates", ","))


@query("m13_statistics")
def m13(spark, d):
    return m.statistics(m.match(asked(spark, d), index(spark, d)), ["q_classe"])


@query("m14_search")
def m14(spark, d):
    return m.search(index(spark, d), asked(spark, d).select("query").distinct())


@query("m16_cache_keys", "t AS (" + ledger_sql("full") + ") SELECT DISTINCT lower(strip_accents(descricao)) || '|' || CASE left(codigo, 1) WHEN '1' THEN 'ATIVO' WHEN '2' THEN 'PASSIVO' ELSE 'RESULTADO' END AS key FROM t")
def m16(spark, d):
    none = F.lit(None).cast("string")
    return ledger(spark, d, "full").select(m.cache_key(text.normalized(F.col("descricao")), codes.account_class(F.col("codigo")), none, none).alias("key")).distinct()


@query("m17_decisions", "e AS (SELECT event_type || '|' || CAST(user_id AS STRING) AS key, CAST(event_id AS STRING) AS codigo, event_type = 'click' AS manual, ts FROM events) SELECT key, arg_max(codigo, (manual, ts, codigo)) AS codigo FROM e GROUP BY key")
def m17(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat_ws("|", "event_type", "user_id").alias("key"), F.col("event_id").cast("string").alias("codigo"), (F.col("event_type") == "click").alias("manual"), "ts", "event_id")
    old, new = e.filter("event_id % 2 = 0").drop("event_id"), e.filter("event_id % 2 = 1").drop("event_id")
    return m.merged_decisions(old, new).select("key", "codigo")


@query("m8_keywords", CT + ", k AS (SELECT unnest(['part', 'tipo', 'brand', 'ativo']) AS keyword), q AS (SELECT DISTINCT lower(p_type) || ' brand tipo' AS query FROM part) SELECT query, keyword, count(*) AS n FROM q JOIN k ON list_contains(string_split(query, ' '), keyword) JOIN c ON contains(lower(descricao), keyword) GROUP BY ALL")
def m8(spark, d):
    q = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lower("p_type"), F.lit(" brand tipo")).alias("query"))
    return m.keyword_candidates(q, from_sql(spark, d, CHART, "part"), ["part", "tipo", "brand", "ativo"]).groupBy("query", "keyword").agg(F.count(F.lit(1)).alias("n"))


FORMS = "f AS (SELECT DISTINCT p_brand AS codigo, p_name AS descricao, p_type AS tipo, p_partkey AS row_no, p_size FROM part) "


@query("c1_merged", FORMS + "SELECT codigo, arg_max(descricao, length(descricao) * 1000000000 - row_no) AS descricao, arg_min(tipo, row_no) AS tipo, array_to_string(list_sort(list(DISTINCT 'F' || CAST(p_size % 4 AS STRING))), ',') AS forms FROM f GROUP BY codigo")
def c1(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("codigo"), F.col("p_name").alias("descricao"), F.col("p_type").alias("tipo"), F.col("p_partkey").alias("row_no"), F.array(F.concat(F.lit("F"), F.col("p_size") % 4)).alias("forms"))
    return ch.merged(rows, ["tipo"]).withColumn("forms", F.array_join("forms", ","))


@query("c2_with_parents", CT + ", s AS (SELECT codigo FROM c WHERE p_size > 40), u(codigo) AS (SELECT codigo FROM s UNION SELECT c.parent_id FROM u JOIN c USING (codigo) WHERE c.parent_id IS NOT NULL) SELECT DISTINCT codigo FROM u")
def c2(spark, d):
    chart = from_sql(spark, d, CHART, "part")
    return ch.with_parents(chart, chart.filter("p_size > 40"))


@query("c3_with_extras", CT + "SELECT codigo FROM c UNION ALL SELECT DISTINCT '1.' || CAST(p_size AS STRING) FROM part WHERE '1.' || CAST(p_size AS STRING) NOT IN (SELECT codigo FROM c)")
def c3(spark, d):
    extra = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("1."), F.col("p_size")).alias("codigo")).distinct()
    return ch.with_extras(from_sql(spark, d, CHART, "part"), extra).select("codigo")


@query("c4_chart_statistics", CT + ", s AS (SELECT 'nivel' AS field, CAST(len(string_split(codigo, '.')) AS STRING) AS value FROM c UNION ALL SELECT 'raiz', left(codigo, 1) FROM c UNION ALL SELECT 'tipo', tipo FROM c) SELECT field, value, count(*) AS n FROM s GROUP BY ALL")
def c4(spark, d):
    return ch.statistics(from_sql(spark, d, CHART, "part"))


@query("c5_new_terms", "x AS (SELECT DISTINCT lower(p_type) AS s, lower(p_name) AS t FROM part), y AS (SELECT list_filter(string_split(s, ' '), lambda w: length(w) >= 4 AND NOT list_contains(string_split(t, ' '), w)) AS a, list_filter(string_split(t, ' '), lambda w: length(w) >= 4 AND NOT list_contains(string_split(s, ' '), w)) AS b FROM x), z AS (SELECT unnest(a) AS term, b FROM y), v AS (SELECT term, unnest(b) AS w FROM z) SELECT term, array_to_string(list_sort(list(DISTINCT w)), ',') AS mapped FROM v GROUP BY term")
def c5(spark, d):
    pairs = spark.read.parquet(f"{d}/part.parquet").select(F.lower("p_type").alias("source"), F.lower("p_name").alias("target")).distinct()
    return ch.new_terms(pairs).withColumn("mapped", F.array_join("mapped", ","))


@query("m15_lookups", FORMS + ", g AS (SELECT codigo, list_sort(list(DISTINCT 'F' || CAST(p_size % 4 AS STRING))) AS forms FROM f GROUP BY codigo) SELECT form, count(*) AS n, min(codigo) AS low FROM (SELECT unnest(forms) AS form, codigo FROM g) GROUP BY form")
def m15(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("codigo"), F.concat(F.lit("F"), F.col("p_size") % 4).alias("f")).groupBy("codigo").agg(F.collect_set("f").alias("forms"))
    return ch.by_form(rows).select("form", F.size("codigos").cast("long").alias("n"), F.array_min("codigos").alias("low"))


@query("s19_facts_by_year", "o AS (SELECT o_orderpriority AS codigo, CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(o_totalprice AS DECIMAL(20,4)) AS v FROM orders) SELECT codigo, year, round(CAST(sum(v) AS DOUBLE), 2) AS valor FROM o GROUP BY ALL")
def s19(spark, d):
    facts = spark.read.parquet(f"{d}/orders.parquet").select(F.lit("all").alias("ledger_id"), F.col("o_orderpriority").alias("codigo"), F.year("o_orderdate").alias("period"), F.col("o_totalprice").cast(numbers.MONEY).alias("valor"))
    wide = projection.by_period(facts)  # a column a year, of all years that occur
    years = [c for c in wide.columns if c not in ("ledger_id", "codigo")]
    return double(wide.unpivot(["codigo"], years, "year", "valor").filter("valor is not null"), "valor")


@query("l26_years", "e AS (SELECT event_type, CAST(year(ts) AS INT) AS y FROM events), n AS (SELECT event_type, y, count(*) AS n FROM e GROUP BY ALL) SELECT event_type, arg_max(y, n * 10000 - y) AS ano FROM n GROUP BY event_type")
def l26(spark, d):
    named = spark.read.parquet(f"{d}/events.parquet").select("event_type", names.year_of(F.concat(F.lit("dir/2001/Balancete "), F.year("ts"), F.lit(" x.csv")), 2100).alias("y"))
    votes = named.groupBy("event_type", "y").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("event_type").agg(F.max_by("y", F.struct("n", -F.col("y"))).alias("ano"))


@query("l15_forward_fill", "e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS v FROM events) SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM e")
def l15(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("file_id"), F.lit("").alias("sheet"), F.col("event_id").alias("row_no"), F.lit(0).alias("col_no"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(" ").alias("value"))
    return layout.filled_down(e).select(F.col("row_no").alias("event_id"), F.col("value").alias("v"))
