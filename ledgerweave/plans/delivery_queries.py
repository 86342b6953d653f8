"""Queries of deliveries, names, text ledgers and descriptions, with SQL beside each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.functions import codes, text
from ledgerweave.operators import delivery as dv
from ledgerweave.operators import tree
from ledgerweave.plans.ledgers import ledger, ledger_sql
from ledgerweave.plans.tree_queries import CUT, NODES, D, K, double, nodes, whole
from ledgerweave.sources import layout, names, text_ledgers

QUERIES, SQL = {}, {}


def query(name, sql):
    def add(f):
        QUERIES[name], SQL[name] = f, "WITH RECURSIVE " + sql
        return f

    return add


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


#: The whole ledger, and ledgers of plain numbers without a tree.
FLAT = "SELECT 'F' || CAST(s_suppkey % 3 AS STRING) AS ledger_id, CAST(2020 AS INT) AS period, CAST(s_suppkey AS BIGINT) AS row_no, CAST(s_suppkey + 10000 AS STRING) AS codigo, s_name AS descricao, CAST(s_acctbal AS DECIMAL(20,4)) AS saldo FROM {supplier}"
MIXED = f"{ledger_sql('full')} UNION ALL {FLAT.format(supplier='supplier')}"


@query("p11_selection", f"t AS ({MIXED}), {NODES}, {CUT}, w AS (SELECT DISTINCT {K} FROM e), fl AS (SELECT n.ledger_id, n.period, n.codigo FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.ledger_id = n.ledger_id AND w.period = n.period)) SELECT DISTINCT {K}, stop AS codigo, 'emitted' AS part FROM z JOIN w USING ({K}) UNION ALL SELECT f.ledger_id, f.period, f.codigo, 'uncovered' FROM f JOIN w USING ({K}) WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.ledger_id = f.ledger_id AND z.period = f.period AND z.codigo = f.codigo) UNION ALL SELECT {K}, codigo, CASE WHEN CAST(codigo AS BIGINT) % 3 <> 0 THEN 'emitted' ELSE 'uncovered' END FROM fl")
def p11(spark, d):
    rows = whole(spark, d).unionByName(spark.sql(FLAT, supplier=read(spark, d, "supplier")))
    mapped = rows.filter(F.replace("codigo", F.lit("."), F.lit("")).cast("long") % 3 != 0)
    emitted, uncovered = dv.selection(rows, mapped)
    return emitted.withColumn("part", F.lit("emitted")).unionByName(uncovered.withColumn("part", F.lit("uncovered")))


@query("f4_analytical", f"t AS ({ledger_sql('full')}), {NODES}, y AS (SELECT n.ledger_id, n.period, n.codigo, len(string_split(n.codigo, '.')) AS lv, EXISTS (SELECT 1 FROM e WHERE e.ledger_id = n.ledger_id AND e.period = n.period AND e.parent = n.codigo) AS inn FROM n), g AS (SELECT {K}, max(lv) AS al FROM (SELECT {K}, lv FROM y GROUP BY ALL HAVING count(*) > 5 AND NOT bool_or(inn)) GROUP BY ALL) SELECT y.ledger_id, y.period, y.codigo, NOT inn AND (coalesce(lv >= al, FALSE) OR lv > 6) AS analytical FROM y LEFT JOIN g USING ({K})")
def f4(spark, d):
    rows = whole(spark, d)
    return dv.analytical(tree.nodes(tree.in_tree(rows)), tree.first_descriptions(rows))


DAMAGED = "SELECT ledger_id, period, row_no, codigo, CASE WHEN row_no % 11 = 0 THEN '' WHEN row_no % 13 = 0 THEN '12.5' WHEN row_no % 17 = 0 THEN ' Bank  of ' || descricao ELSE descricao END AS descricao, saldo FROM ({t}) q"
IGNORED = ["brazil", "canada", "bank of china"]


@query("f5_skipped", f"t AS ({DAMAGED.format(t=ledger_sql('full'))}), j AS (SELECT {K}, row_no, CASE WHEN descricao = '' THEN 'empty' WHEN length(regexp_replace(descricao, '[^a-zA-ZÀ-ÿ]', '', 'g')) < 2 THEN 'garbage' WHEN trim(regexp_replace(lower(strip_accents(descricao)), '\\s+', ' ', 'g')) IN ('brazil', 'canada', 'bank of china') THEN 'ignored' END AS reason FROM t) SELECT {K}, coalesce(reason, 'kept') AS reason, count(*) AS n, CASE WHEN reason IS NULL THEN CAST(sum(row_no) AS BIGINT) END AS rows FROM j GROUP BY {K}, reason")
def f5(spark, d):
    rows = spark.sql(DAMAGED.format(t="{t}"), t=ledger(spark, d, "full"))
    kept, counts = dv.skipped(rows, spark.createDataFrame([(x,) for x in IGNORED], "texto string"))
    one = kept.groupBy(*tree.KEY).agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n"), F.sum("row_no").alias("rows"))
    return one.unionByName(counts.withColumn("rows", F.lit(None).cast("long")))


@query("f6_review", f"t AS ({ledger_sql('full')}), {NODES}, m AS (SELECT n.*, CAST(replace(codigo, '.', '') AS BIGINT) % 4 = 0 AS needs, EXISTS (SELECT 1 FROM e WHERE e.ledger_id = n.ledger_id AND e.period = n.period AND e.parent = n.codigo) AS syn FROM n), cw AS (SELECT {K}, count(*) FILTER (needs AND syn) AS waiting, count(*) FILTER (needs AND NOT syn) AS detail FROM m GROUP BY ALL) SELECT {K}, codigo, waiting, detail FROM cw LEFT JOIN (SELECT {K}, codigo FROM m WHERE needs AND syn) USING ({K})")
def f6(spark, d):
    n = nodes(spark, d)
    inner = tree.edges(n).select(*tree.KEY, F.col("parent").alias("codigo")).distinct().withColumn("synthetic", F.lit(True))
    matched = n.join(inner, [*tree.KEY, "codigo"], "left").withColumns({"synthetic": F.coalesce("synthetic", F.lit(False)), "needs_review": F.replace("codigo", F.lit("."), F.lit("")).cast("long") % 4 == 0})
    queue, counts = dv.review_queue(matched)
    return counts.join(queue.select(*tree.KEY, "codigo"), tree.KEY, "left").select(*tree.KEY, "codigo", "waiting", "detail")


@query("f9_warnings", f"""t AS ({ledger_sql('geo')}), f AS (SELECT {K}, CASE WHEN row_no % 17 = 0 THEN 'x' || codigo WHEN row_no % 29 = 0 THEN NULL ELSE codigo END AS alvo, CASE WHEN row_no % 19 = 0 THEN NULL ELSE saldo END AS valor FROM t WHERE ledger_id <> 'L3'),
w AS (SELECT {K}, 'code format' AS warning, count(*) AS n FROM f WHERE alvo IS NULL OR NOT regexp_full_match(alvo, '\\d+(\\.\\d+)*') GROUP BY {K} UNION ALL SELECT {K}, 'not numeric', count(*) FROM f WHERE valor IS NULL GROUP BY {K} UNION ALL SELECT DISTINCT {K}, 'no rows', 1 FROM t WHERE ledger_id = 'L3') SELECT * FROM w""")
def f9(spark, d):
    rows = ledger(spark, d, "geo")
    no = F.col("row_no")
    facts = rows.filter("ledger_id <> 'L3'").select(*tree.KEY, F.when(no % 17 == 0, F.concat(F.lit("x"), "codigo")).when(no % 29 != 0, F.col("codigo")).alias("alvo"), F.when(no % 19 != 0, F.col("saldo")).alias("valor"))
    return dv.delivery_warnings(facts, rows)


@query("p20_match_rate", f"t AS ({ledger_sql('geo')}) SELECT {K}, round(avg(CASE WHEN row_no % 3 = 0 THEN 0 ELSE 1 END), 6) AS rate FROM t GROUP BY ALL")
def p20m(spark, d):
    return dv.match_rates(ledger(spark, d, "geo").withColumn("alvo", F.when(F.col("row_no") % 3 != 0, F.col("codigo"))))


BANK = "SELECT * FROM (VALUES ('1', 'A'), ('1.1', 'B'), ('4.3', 'C'), ('7', 'D'), ('7.2', 'E'), ('8', 'F'), ('8.1', 'G'), ('8.1.2', 'A')) v(rule, alvo)"
#: The ledger under a bank's root digits: costs are negative in one period, the regions stand among compensation too, and group 6.1 has no value.
BANKED = """SELECT ledger_id, period, row_no, concat(CASE substr(codigo, 1, 1) WHEN '2' THEN '4' WHEN '3' THEN '8' WHEN '4' THEN '7' ELSE '1' END, substr(codigo, 2)) AS codigo, descricao, CAST(CASE WHEN period = 2021 AND codigo LIKE '3%' THEN -saldo ELSE saldo END AS DECIMAL(20,4)) AS saldo FROM {t}
UNION ALL SELECT ledger_id, period, row_no + 20000000000, concat('9', substr(codigo, 2)), descricao, saldo FROM {t} WHERE codigo LIKE '1%' AND codigo NOT LIKE '1.%.%'
UNION ALL SELECT ledger_id, period, row_no + 30000000000, '6.1', 'Grupo vazio', CAST(0 AS DECIMAL(20,4)) FROM {t} WHERE codigo = '1'
UNION ALL SELECT ledger_id, period, row_no + 40000000000, '6.2', 'Grupo sem regra', saldo FROM {t} WHERE codigo = '1'"""


@query("p13_bank_facts", f"""t0 AS ({ledger_sql('full')}), t AS ({BANKED.format(t='t0')}), {NODES}, rl AS ({BANK}), v AS (SELECT n.ledger_id, n.period, rule, alvo, saldo FROM n JOIN rl ON n.codigo = rule),
b AS (SELECT c.ledger_id, c.period, arg_max(p.rule, len(p.rule)) AS rule, any_value(c.saldo) AS s FROM v c JOIN v p ON c.ledger_id = p.ledger_id AND c.period = p.period AND starts_with(c.rule, p.rule || '.') GROUP BY c.ledger_id, c.period, c.rule),
w AS (SELECT v.ledger_id, v.period, rule, alvo, saldo - coalesce(s, 0) AS net FROM v LEFT JOIN (SELECT {K}, rule, sum(s) AS s FROM b GROUP BY ALL) q USING (ledger_id, period, rule)),
f AS (SELECT {K}, alvo, CASE WHEN rule LIKE '8%' THEN 0 - net ELSE net END AS valor FROM w UNION ALL SELECT {K}, '2.03.04.01', sum(CASE WHEN rule LIKE '7%' THEN net WHEN rule LIKE '8%' THEN 0 - net END) FROM w GROUP BY {K} HAVING abs(sum(CASE WHEN rule LIKE '7%' THEN net WHEN rule LIKE '8%' THEN 0 - net END)) > 0.005)
SELECT {K}, alvo AS codigo, 'fact' AS part, round(CAST(sum(valor) AS DOUBLE), 2) AS valor FROM f GROUP BY {K}, alvo
UNION ALL SELECT {K}, codigo, 'uncovered', round(CAST(saldo AS DOUBLE), 2) FROM n WHERE len(string_split(codigo, '.')) = 2 AND codigo NOT LIKE '9%' AND abs(saldo) > 0.005 AND NOT EXISTS (SELECT 1 FROM rl WHERE codigo = rule OR starts_with(codigo, rule || '.') OR starts_with(rule, codigo || '.'))""")
def p13b(spark, d):
    facts, uncovered = dv.bank_facts(spark.sql(BANKED, t=whole(spark, d)), spark.sql(BANK))
    both = facts.select(*tree.KEY, F.col("alvo").alias("codigo"), F.lit("fact").alias("part"), "valor").unionByName(uncovered.select(*tree.KEY, "codigo", F.lit("uncovered").alias("part"), "valor"))
    return double(both, "valor")


#: Names of files as people write them.
NAMES = """SELECT s_suppkey AS id, CAST(s_suppkey % 7 AS INT) AS grp, CASE s_suppkey % 6 WHEN 0 THEN 'Balancete ' || CAST(1985 + s_suppkey % 60 AS STRING) || ' - Casa N' || CAST(100 + s_nationkey AS STRING) || '.xlsx' WHEN 1 THEN 'dir/BP_Dez' || CAST(10 + s_suppkey % 15 AS STRING) || ' RBM.pdf'
  WHEN 2 THEN '072022 122022 ' || CAST(2000 + s_suppkey % 20 AS STRING) || ' Trindade.csv' WHEN 3 THEN '3T' || CAST(10 + s_suppkey % 14 AS STRING) || ' Consolidado BR.xls' WHEN 4 THEN '2012-12.TXT' ELSE 'Parecer Março final.pdf' END AS name FROM {supplier}"""


@query("l26_names", f"""q AS ({NAMES.format(supplier='supplier')}), s AS (SELECT *, regexp_replace(regexp_replace(name, '^.*/', ''), '\\.[^.]*$', '') AS st FROM q),
y AS (SELECT id, CAST(u.y AS INT) AS y, u.i FROM s, (SELECT unnest(regexp_extract_all(st, '(?:19|20)\\d{{2}}')) AS y, generate_subscripts(regexp_extract_all(st, '(?:19|20)\\d{{2}}'), 1) AS i) u),
b AS (SELECT id, arg_max(y, n * 100 - first) AS year FROM (SELECT id, y, count(*) AS n, min(i) AS first FROM y WHERE y BETWEEN 1990 AND 2030 GROUP BY ALL) GROUP BY id)
SELECT s.id, coalesce(b.year, CASE WHEN regexp_matches(st, '(?i)\\bdez[a-z]*[ ._-]?\\d{{2}}\\b') THEN 2000 + CAST(regexp_extract(st, '(?i)\\bdez[a-z]*[ ._-]?(\\d{{2}})\\b', 1) AS INT) WHEN regexp_matches(st, '(?i)\\b[1-4]T\\d{{2}}\\b') THEN 2000 + CAST(regexp_extract(st, '(?i)\\b[1-4]T(\\d{{2}})\\b', 1) AS INT) ELSE 0 END) AS year,
CAST(CASE WHEN regexp_matches(lower(replace(name, '_', ' ')), '\\bmar') THEN 3 WHEN regexp_matches(lower(replace(name, '_', ' ')), '\\bdez') THEN 12 ELSE 0 END AS INT) AS month,
trim(regexp_replace(regexp_replace(regexp_replace(st, '(?i)\\b(balancete|bp|dez\\d\\d|consolidado|parecer|final|[1-4]T\\d\\d)\\b', '', 'g'), '\\b\\d+\\b|[-_]|(?i)bp_dez\\d\\d', '', 'g'), ' +', ' ', 'g')) AS customer FROM s LEFT JOIN b USING (id)""")
def l26(spark, d):
    q = spark.sql(NAMES, supplier=read(spark, d, "supplier"))
    return q.select("id", F.coalesce(names.year_of(F.col("name"), 2030), F.lit(0)).alias("year"), F.coalesce(names.month_of(F.regexp_replace("name", "_", " ")), F.lit(0)).alias("month"), names.customer_of(F.col("name")).alias("customer"))


@query("l26_customers", f"q AS ({NAMES.format(supplier='supplier')}), c AS (SELECT grp, id, CASE id % 6 WHEN 0 THEN 'Casa ' || regexp_extract(name, 'N\\d+') WHEN 1 THEN 'RBM' WHEN 2 THEN 'Trindade' WHEN 3 THEN 'BR' WHEN 5 THEN 'Março' END AS c FROM q), n AS (SELECT grp, c, count(*) AS n, min(id) AS first FROM c WHERE c IS NOT NULL GROUP BY ALL) SELECT grp, coalesce(m.c, '') AS customer FROM (SELECT DISTINCT grp FROM q) LEFT JOIN (SELECT grp, arg_max(c, n * 1000000 - first) AS c FROM n GROUP BY grp) m USING (grp)")
def l26c(spark, d):
    return names.customers(spark.sql(NAMES, supplier=read(spark, d, "supplier")).withColumn("position", F.col("id")), ["grp"])


COLUMNS = "SELECT c_custkey % 8 AS file, CASE WHEN c_custkey % 8 IN (0, 5) THEN c_acctbal END AS saldo_atual_ctrl, CASE WHEN c_custkey % 8 = 1 THEN c_acctbal END AS saldo_anterior_controlada, CASE WHEN c_custkey % 8 IN (2, 5) AND c_custkey % 3 = 0 THEN c_acctbal END AS credito, CASE WHEN c_custkey % 8 = 3 THEN c_acctbal END AS debito, c_acctbal AS saldo FROM {customer}"


@query("l25_types", f"q AS ({COLUMNS.format(customer='customer')}) SELECT file, CASE WHEN count(saldo_atual_ctrl) > 0 THEN 'parent' WHEN count(saldo_anterior_controlada) > 0 THEN 'subsidiary' WHEN count(credito) + count(debito) > 0 THEN 'movement' ELSE 'single' END AS type FROM q GROUP BY file")
def l25(spark, d):
    return layout.ledger_type(spark.sql(COLUMNS, customer=read(spark, d, "customer")), ["file"])


#: Codes of fixed width: nodes with zero levels and a row number, leaves without; every other file has none.
WIDE = "SELECT c_custkey % 6 AS file, c_custkey AS id, CASE WHEN c_custkey % 2 = 1 THEN '1.' || CAST(c_nationkey + 1 AS STRING) || '.' || CAST(c_custkey AS STRING) WHEN c_custkey % 4 = 0 THEN '1.' || CAST(c_nationkey % 3 + 1 AS STRING) || '.' || CAST(c_nationkey + 1 AS STRING) || '.00.00.' || CAST(10000 + c_custkey AS STRING) ELSE '1.' || CAST(c_nationkey % 3 + 1 AS STRING) || '.' || CAST(c_nationkey + 1 AS STRING) || '.10.20.' || CAST(10000 + c_custkey AS STRING) END AS codigo FROM {customer}"


@query("l23_canonical", f"q AS ({WIDE.format(customer='customer')}), z AS (SELECT *, string_split(codigo, '.') AS s FROM q), w AS (SELECT file, CASE WHEN count(*) >= 10 AND avg(CASE WHEN regexp_matches(codigo, '\\.0+(\\.0+)*\\.\\d*[1-9]') THEN 1.0 ELSE 0.0 END) >= 0.15 AND max(len(s)) >= 5 THEN max(len(s)) END AS wd FROM z GROUP BY file) SELECT file, id, CASE WHEN wd IS NULL THEN codigo WHEN len(s) >= wd AND s[4] = '00' THEN s[1] || '.' || s[2] || '.' || s[3] ELSE codigo END AS codigo FROM z JOIN w USING (file)")
def l23(spark, d):
    return layout.canonical(spark.sql(WIDE, customer=read(spark, d, "customer")), ["file"]).select("file", "id", "codigo")


#: Printed ledgers, one a nation: a title, a header, a rule, then a line for each supplier, with the nation's separator.
PRINTED = """SELECT CAST(s_nationkey AS STRING) AS file_id, CAST(s_suppkey + 10 AS INT) AS row_no, array_join(array('1.' || CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'T' END, CAST(s_suppkey AS STRING) || ' ' || s_name, '0,00', '10,50', '1.000,00', replace(CAST(CAST(s_acctbal AS DECIMAL(20,2)) AS STRING), '.', ',')), sep) AS line
FROM (SELECT *, element_at(array('\t', '|', ';', '   '), CAST(s_nationkey % 4 + 1 AS INT)) AS sep FROM {supplier}) q
UNION ALL SELECT DISTINCT CAST(s_nationkey AS STRING), 1, array_join(array('Classificação', 'Tp', 'Código', 'Anterior', 'Débitos', 'Créditos', 'Atual'), element_at(array('\t', '|', ';', '   '), CAST(s_nationkey % 4 + 1 AS INT))) FROM {supplier}
UNION ALL SELECT DISTINCT CAST(s_nationkey AS STRING), 0, 'BALANCETE DE VERIFICAÇÃO' FROM {supplier} UNION ALL SELECT DISTINCT CAST(s_nationkey AS STRING), 2, '---- ====' FROM {supplier}"""


def printed(spark, d):
    return spark.sql(PRINTED, supplier=read(spark, d, "supplier"))


@query("s11_separators", "s AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT CAST(k AS VARCHAR) AS file_id, ['tab', 'pipe', 'semicolon', 'spaces'][CAST(k % 4 + 1 AS INT)] AS separator FROM s")
def s11(spark, d):
    return text_ledgers.separators(printed(spark, d), first=1 << 30)


@query("s12_text_rows", "s AS (SELECT * FROM supplier) SELECT CAST(s_nationkey AS VARCHAR) AS file_id, '1.' || CAST(s_suppkey AS VARCHAR) AS classificacao, CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'T' END AS tipo, CAST(s_suppkey AS VARCHAR) AS codigo, s_name AS descricao, 0.0::DOUBLE AS saldo_anterior, 10.5::DOUBLE AS debitos, 1000.0::DOUBLE AS creditos, round(CAST(s_acctbal AS DOUBLE), 2) AS saldo_atual FROM s")
def s12(spark, d):
    return double(text_ledgers.text_rows(printed(spark, d)).drop("row_no"), "saldo_anterior", "debitos", "creditos", "saldo_atual")


@query("s14_header_slices", "c AS (SELECT CAST(c_nationkey AS VARCHAR) AS file_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS row_no FROM customer), n AS (SELECT file_id, count(*) AS n FROM c GROUP BY ALL) SELECT c.file_id, row_no AS header, (n - 1 - row_no) * 2 AS cells FROM c JOIN n USING (file_id) WHERE row_no <= 15 AND row_no < n - 1")
def s14(spark, d):
    from pyspark.sql import Window

    at = (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("int")
    rows = read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("file_id"), F.lit("").alias("sheet"), at.alias("row_no"), F.array(F.col("c_custkey").cast("string"), "c_name").alias("v"))
    cells = rows.select("file_id", "sheet", "row_no", F.posexplode("v").alias("col_no", "value"))
    return layout.header_slices(cells).groupBy("file_id", "header").agg(F.count(F.lit(1)).alias("cells"))


#: Descriptions with company and account terms, and with analytical detail.
TOLD = "SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'TFS SOLUCOES EM SOFTWARE' WHEN 1 THEN p_name || ' Tecnologia digital' WHEN 2 THEN 'Digital ' || CAST(p_partkey AS STRING) WHEN 3 THEN 'SISTEMA DE CAIXA ' || p_name WHEN 4 THEN 'ACME EPP' WHEN 5 THEN 'banco ' || CAST(100 + p_partkey % 900 AS STRING) WHEN 6 THEN 'CONTA ' || CAST(p_partkey AS STRING) WHEN 7 THEN 'c/c ' || CAST(p_partkey AS STRING) ELSE p_name END AS d FROM {part}"


@query("x20_x21_descriptions", f"q AS ({TOLD.format(part='part')}) SELECT id, regexp_matches(upper(d), 'SOLUCA|SOLUÇ[ÃÕ]|SOFTWARE|SISTEMA|TECNOLOGIA|SERVI[CÇ]OS|DIGITAL|PLATA?FORM') AND NOT regexp_matches(upper(d), 'CAIXA|BANCO|IMPOSTO|RECEITA|DESPESA|ATIVO|PASSIVO|CLIENTES|FORNECEDORES|PATRIM[OÔ]NIO|ESTOQUES|SAL[AÁ]RIOS') AND (length(trim(d)) > 18 OR len(list_filter(string_split(d, ' '), lambda w: w = upper(w) AND w <> lower(w))) >= 3) AS noise, regexp_matches(upper(d), '\\d{{2}}\\.\\d{{3}}\\.\\d{{3}}/\\d{{4}}-\\d{{2}}|LTDA|S/A|S\\.A\\.|EIRELI|ME\\b|EPP\\b|AG[ÊE]NCIA\\s*\\d|C/C\\s*\\d|CONTA\\s*CORRENTE\\s*\\d|CPF\\s*\\d{{3}}\\.\\d{{3}}|BANCO\\s+\\d{{3}}') AS detail FROM q")
def x20(spark, d):
    q = spark.sql(TOLD, part=read(spark, d, "part"))
    return q.select("id", text.is_noise(F.col("d")).alias("noise"), text.is_analytical_detail(F.col("d")).alias("detail"))


@query("f3_synthetic", f"t AS ({ledger_sql('full')}), {NODES} SELECT t.ledger_id, t.period, t.row_no, EXISTS (SELECT 1 FROM e WHERE e.ledger_id = t.ledger_id AND e.period = t.period AND e.parent = t.codigo) OR len(string_split(t.codigo, '.')) <= 5 AS synthetic FROM t")
def f3(spark, d):
    return tree.synthetic(whole(spark, d)).select(*tree.KEY, "row_no", "synthetic")


@query("h23_existing_parents", f"t AS ({MIXED}), {NODES}, fx AS (SELECT n.ledger_id, n.period, n.codigo, k FROM n, unnest([3, 1]) g(k) WHERE n.codigo NOT LIKE '%.%' AND len(n.codigo) = 5), fp AS (SELECT fx.ledger_id, fx.period, fx.codigo, m.codigo AS parent, k FROM fx JOIN n m ON m.ledger_id = fx.ledger_id AND m.period = fx.period AND m.codigo = left(fx.codigo, k)) SELECT {K}, child AS codigo, parent FROM e UNION ALL SELECT {K}, codigo, arg_max(parent, k) FROM fp GROUP BY {K}, codigo")
def h23e(spark, d):
    rows = whole(spark, d).unionByName(spark.sql(FLAT, supplier=read(spark, d, "supplier")))
    return tree.existing_parents(tree.nodes(tree.in_tree(rows)))


@query("c7_entities", f"t AS ({ledger_sql('geo')}), u AS ({ledger_sql('equity')}) SELECT 'assets' AS entity, count(*) AS n, {D('sum(saldo)').replace('AS sum(saldo)', 'AS total')} FROM t UNION ALL SELECT 'equity', count(*), round(CAST(sum(saldo) AS DOUBLE), 2) FROM u")
def c7(spark, d):
    both = dv.by_entity({"assets": ledger(spark, d, "geo"), "equity": ledger(spark, d, "equity")})
    return double(both.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("saldo").alias("total")), "total")


@query("l24_contract", f"t AS ({ledger_sql('geo')}) SELECT {K}, row_no, codigo, codigo AS codigo_original, round(CAST(saldo AS DOUBLE), 2) AS saldo, round(CAST(saldo * 2 AS DOUBLE), 2) AS credito, CAST(len(string_split(codigo, '.')) AS INT) AS nivel FROM t")
def l24(spark, d):
    rows = ledger(spark, d, "geo").select(*tree.KEY, "row_no", "codigo", F.col("saldo").alias("saldo_atual"), (F.col("saldo") * 2).alias("creditos"))
    return double(layout.contract(rows).select(*tree.KEY, "row_no", "codigo", "codigo_original", "saldo", "credito", F.col("nivel").cast("int").alias("nivel")), "saldo", "credito")


@query("l18_outline", f"t AS ({ledger_sql('geo')}), g AS (SELECT {K}, list_transform(string_split(codigo, '.'), lambda s: CAST(s AS INT)) AS s FROM t), k AS (SELECT {K}, s, row_number() OVER (PARTITION BY {K} ORDER BY s) AS place, {', '.join(f'dense_rank() OVER (PARTITION BY {K}, {", ".join(f"s[{j}]" for j in range(1, i))} ORDER BY s[{i}] NULLS FIRST) - 1 AS k{i}' for i in (2, 3, 4))} FROM g) SELECT {K}, place, '1' || CASE WHEN len(s) > 1 THEN '.' || k2 ELSE '' END || CASE WHEN len(s) > 2 THEN '.' || k3 ELSE '' END || CASE WHEN len(s) > 3 THEN '.' || k4 ELSE '' END AS codigo FROM k")
def l18(spark, d):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(*tree.KEY).orderBy(codes.sort_key(F.col("codigo"))))
    rows = ledger(spark, d, "geo").select(*tree.KEY, at.alias("place"), (codes.level(F.col("codigo")) - 1).alias("depth"))
    return layout.outline(rows.withColumn("row_no", F.col("place")), tree.KEY).select(*tree.KEY, F.col("place").cast("long").alias("place"), "codigo")
