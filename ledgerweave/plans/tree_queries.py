"""Queries of the tree operators, with SQL beside each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.functions import codes
from ledgerweave.operators import chart, tree
from ledgerweave.plans.ledgers import ledger, ledger_sql
from ledgerweave.sources.stage import saved

K = "ledger_id, period"
#: SQL for the same nodes and paths: n(K, codigo, saldo, n), a(K, codigo, ancestor, d).
NODES = """n AS (SELECT ledger_id, period, codigo, CAST(sum(saldo) AS DECIMAL(20,4)) AS saldo, count(*) AS n FROM t GROUP BY ALL),
x AS (SELECT DISTINCT ledger_id, period, codigo, array_to_string(string_split(codigo, '.')[1:i], '.') AS ancestor, i AS d FROM n, unnest(generate_series(1, len(string_split(codigo, '.')))) AS g(i)),
a AS (SELECT x.* FROM x JOIN n ON x.ledger_id = n.ledger_id AND x.period = n.period AND x.ancestor = n.codigo),
e AS (SELECT ledger_id, period, codigo AS child, arg_max(ancestor, d) AS parent FROM a WHERE ancestor <> codigo GROUP BY ALL),
k AS (SELECT e.ledger_id, e.period, e.parent AS codigo, CAST(sum(n.saldo) AS DECIMAL(20,4)) AS children, count(*) AS n_children FROM e JOIN n ON e.ledger_id = n.ledger_id AND e.period = n.period AND e.child = n.codigo GROUP BY ALL),
c AS (SELECT k.ledger_id, k.period, k.codigo, n.saldo AS declared, k.children, k.n_children, n.saldo - k.children AS diff, abs(n.saldo - k.children) <= 0.01 AS ok FROM k JOIN n USING (ledger_id, period, codigo)),
r AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.ledger_id = n.ledger_id AND e.period = n.period AND e.child = n.codigo))"""

QUERIES, SQL = {}, {}


def double(df, *names):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 2) for c in names})


def rows(spark, sf_dir, name="full"):
    return tree.in_tree(ledger(spark, sf_dir, name))


def whole(spark, sf_dir, name="full"):
    """The ledger, made once."""
    return saved(ledger(spark, sf_dir, name), "ledger")


def nodes(spark, sf_dir, name="full"):
    """The ledger's tree, made once."""
    return saved(tree.nodes(rows(spark, sf_dir, name)), "nodes")


def query(name, sql, on="full"):
    def add(f):
        QUERIES[name] = f
        SQL[name] = f"WITH RECURSIVE t AS ({ledger_sql(on)}),\n{NODES}\n{sql}"
        return f

    return add


D = lambda c: f"round(CAST({c} AS DOUBLE), 2) AS {c}"


@query("h1_nodes", f"SELECT {K}, codigo, {D('saldo')}, n FROM n", "repeated")
def h1(spark, d):
    return double(tree.nodes(rows(spark, d, "repeated")).drop("unreadable"), "saldo")


@query("h2_node_values", f"""SELECT {K}, codigo, round(CAST(coalesce(max(CASE WHEN m > 1 AND abs(2 * s - total) <= 0.01 THEN s END), max(total)) AS DOUBLE), 2) AS valor
FROM (SELECT *, saldo AS s, sum(saldo) OVER w AS total, count(*) OVER w AS m FROM t WINDOW w AS (PARTITION BY ledger_id, period, codigo)) GROUP BY ALL""", "repeated")  # fmt: skip
def h2(spark, d):
    return double(tree.node_values(rows(spark, d, "repeated")), "valor")


@query("h3_edges", f"SELECT {K}, child, parent FROM e", "sparse")
def h3(spark, d):
    return tree.edges(nodes(spark, d, "sparse"))


@query("h4_roots", f"SELECT {K}, codigo, {D('saldo')} FROM r")
def h4(spark, d):
    return double(tree.roots(nodes(spark, d)).select(*tree.KEY, "codigo", "saldo"), "saldo")


PLACED = f"pl AS (SELECT {K}, codigo, row_number() OVER (PARTITION BY {K} ORDER BY list_transform(string_split(codigo, '.'), lambda s: CAST(s AS INT))) AS first FROM n)"


@query("h5_descendants", f", {PLACED}, b AS (SELECT {K}, ancestor AS codigo, count(*) AS n FROM a WHERE ancestor <> codigo GROUP BY ALL) SELECT {K}, codigo, first, first + n AS last, n FROM pl JOIN b USING (ledger_id, period, codigo)")
def h5(spark, d):
    return tree.descendants(nodes(spark, d))


@query("h6_rollup", f"SELECT {K}, codigo, {D('declared')}, {D('children')}, n_children, {D('diff')}, ok FROM c")
def h6(spark, d):
    return double(tree.rollup_check(nodes(spark, d)), "declared", "children", "diff")


@query("h6_divergences", f"SELECT {K}, codigo, {D('diff')}, CAST(row_number() OVER (PARTITION BY {K} ORDER BY abs(diff) DESC, codigo) AS INT) AS rank FROM c WHERE NOT ok")
def h6d(spark, d):
    return double(tree.divergences(nodes(spark, d)).select(*tree.KEY, "codigo", "diff", "rank"), "diff")


@query("h7_report", f"""SELECT {K}, m AS rows, CAST(i AS BIGINT) AS in_tree, CAST(ch AS BIGINT) AS checked, CAST(dv AS BIGINT) AS divergent, CAST(du AS BIGINT) AS duplicates, CAST(su AS BIGINT) AS surplus, TRUE AS readable, ch > 0 AS has_tree, ch > 0 AND dv = 0 AS sound
FROM (SELECT {K}, count(*) AS m FROM t GROUP BY ALL) JOIN (SELECT {K}, sum(n) AS i, count_if(n > 1) AS du, sum(n - 1) AS su FROM n GROUP BY ALL) USING ({K}) JOIN (SELECT {K}, count(*) AS ch, count_if(NOT ok) AS dv FROM c GROUP BY ALL) USING ({K})""")  # fmt: skip
def h7(spark, d):
    return tree.report(whole(spark, d))


@query("h8_duplicates", f"SELECT {K}, codigo, n, n - 1 AS surplus FROM n WHERE n > 1", "repeated")
def h8(spark, d):
    return tree.duplicate_codes(rows(spark, d, "repeated"))


CLASS = "CASE WHEN substr(codigo, 1, 1) = '1' THEN 'ATIVO' WHEN substr(codigo, 1, 1) = '2' THEN 'PASSIVO' ELSE 'RESULTADO' END"


@query("h9_root_totals", f"SELECT {K}, substr(codigo, 1, 1) AS root, {CLASS} AS class, round(CAST(sum(saldo) AS DOUBLE), 2) AS total FROM r GROUP BY ALL")
def h9(spark, d):
    return double(tree.root_totals(nodes(spark, d)), "total")


@query("h10_equation", f"""SELECT {K}, round(CAST(min(abs(t1 + s2 * t2 + s3 * t3 + s4 * t4)) AS DOUBLE), 2) AS residue, min(abs(t1 + s2 * t2 + s3 * t3 + s4 * t4)) <= greatest(0.01, 1e-6 * max(greatest(abs(t1), abs(t2), abs(t3), abs(t4)))) AS closes
FROM (SELECT {K}, {", ".join(f"coalesce(sum(CASE WHEN substr(codigo, 1, 1) = '{i}' THEN saldo END), 0) AS t{i}" for i in range(1, 5))} FROM r GROUP BY ALL), (VALUES (1), (-1)) a(s2), (VALUES (1), (-1)) b(s3), (VALUES (1), (-1)) z(s4) GROUP BY {K}""")  # fmt: skip
def h10(spark, d):
    return double(tree.equation(nodes(spark, d)), "residue")


NATURE = """CASE WHEN regexp_matches(descricao, '^\\s*\\(\\s*-\\s*\\)') THEN 'DESPESA' WHEN regexp_matches(lower(strip_accents(descricao)), 'custo|despesa|deducao|abatimento|perda') THEN 'DESPESA' WHEN regexp_matches(lower(strip_accents(descricao)), 'receita|faturamento|venda|rendimento|ganho') THEN 'RECEITA' END"""
NATURES = f"""w AS (SELECT {K}, codigo AS ancestor, {NATURE} AS natureza FROM t WHERE codigo >= '3'), h AS (SELECT a.ledger_id, a.period, a.codigo, arg_max(natureza, d) AS natureza FROM a JOIN w USING (ledger_id, period, ancestor) WHERE natureza IS NOT NULL GROUP BY ALL)"""


@query("h12_natures", f", {NATURES} SELECT * FROM h")
def h12(spark, d):
    return tree.natures(whole(spark, d))


TERM = "CASE WHEN regexp_matches(lower(descricao), 'n[ãa]o[ -]*circulante|longo *prazo|permanente|imobilizado|intang[íi]vel') THEN 'NAO_CIRCULANTE' WHEN regexp_matches(lower(descricao), 'circulante|curto *prazo') THEN 'CIRCULANTE' END"


@query("h13_terms", f", w AS (SELECT {K}, codigo AS ancestor, {TERM} AS prazo FROM t WHERE codigo < '3') SELECT a.ledger_id, a.period, a.codigo, arg_max(prazo, d) AS prazo FROM a JOIN w USING (ledger_id, period, ancestor) WHERE prazo IS NOT NULL GROUP BY ALL")
def h13(spark, d):
    return tree.terms(whole(spark, d))


TOTALS = f"{NATURES}, q AS (SELECT ledger_id, period, natureza, sum(saldo) AS total FROM h JOIN n USING (ledger_id, period, codigo) WHERE NOT EXISTS (SELECT 1 FROM a JOIN h g ON a.ledger_id = g.ledger_id AND a.period = g.period AND a.ancestor = g.codigo WHERE a.ledger_id = h.ledger_id AND a.period = h.period AND a.codigo = h.codigo AND a.ancestor <> h.codigo) GROUP BY ALL)"


@query("h14_nature_totals", f", {TOTALS} SELECT {K}, natureza, {D('total')} FROM q")
def h14(spark, d):
    full = whole(spark, d)
    return double(tree.nature_totals(tree.nodes(tree.in_tree(full)), tree.natures(full)), "total")


@query("h15_period_result", f", {TOTALS} SELECT {K}, round(CAST(abs(coalesce(sum(CASE natureza WHEN 'RECEITA' THEN total END), 0)) - abs(coalesce(sum(CASE natureza WHEN 'DESPESA' THEN total END), 0)) AS DOUBLE), 2) AS resultado FROM q GROUP BY {K}")
def h15(spark, d):
    full = whole(spark, d)
    return double(tree.period_result(tree.nature_totals(tree.nodes(tree.in_tree(full)), tree.natures(full))), "resultado")


#: Mapped: nodes whose code, as digits, is no multiple of 3.
CUT = f"""p AS (SELECT {K}, codigo FROM n WHERE CAST(replace(codigo, '.', '') AS BIGINT) % 3 <> 0 AND codigo LIKE '%.%'),
f AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.ledger_id = n.ledger_id AND e.period = n.period AND e.parent = n.codigo)),
m AS (SELECT ledger_id, period, f.codigo, coalesce(max(a.d) FILTER (p.codigo IS NOT NULL), 0) AS dm FROM f JOIN a USING (ledger_id, period, codigo) LEFT JOIN p ON p.ledger_id = a.ledger_id AND p.period = a.period AND p.codigo = a.ancestor GROUP BY ALL),
y AS (SELECT a.ledger_id, a.period, a.ancestor, min(dm) AS least FROM a JOIN m USING (ledger_id, period, codigo) GROUP BY ALL),
z AS (SELECT a.ledger_id, a.period, a.codigo, arg_min(a.ancestor, a.d) AS stop FROM a JOIN m USING (ledger_id, period, codigo) JOIN p ON p.ledger_id = a.ledger_id AND p.period = a.period AND p.codigo = a.ancestor JOIN y ON y.ledger_id = a.ledger_id AND y.period = a.period AND y.ancestor = a.ancestor WHERE y.least <= a.d GROUP BY ALL)"""


def cut(spark, d):
    n = nodes(spark, d)
    mapped = n.filter(F.replace("codigo", F.lit("."), F.lit("")).cast("long") % 3 != 0)
    return n, *tree.tree_cut(n, mapped)


@query("h16_tree_cut", f", {CUT} SELECT DISTINCT {K}, stop AS codigo, 'emitted' AS part FROM z UNION ALL SELECT {K}, codigo, 'uncovered' FROM f WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.ledger_id = f.ledger_id AND z.period = f.period AND z.codigo = f.codigo)")
def h16(spark, d):
    _, emitted, uncovered = cut(spark, d)
    return emitted.withColumn("part", F.lit("emitted")).unionByName(uncovered.withColumn("part", F.lit("uncovered")))


@query("h17_absorbed", f", {CUT}, {PLACED}, b AS (SELECT a.ledger_id, a.period, a.ancestor AS codigo, count(*) AS n FROM a JOIN (SELECT DISTINCT {K}, stop AS ancestor FROM z) USING (ledger_id, period, ancestor) WHERE a.codigo <> a.ancestor GROUP BY ALL) SELECT {K}, codigo, first, first + n AS last, n FROM pl JOIN b USING (ledger_id, period, codigo)")
def h17(spark, d):
    n, emitted, _ = cut(spark, d)
    return tree.absorbed(n, emitted)


@query("h18_export_rollup", f"SELECT {K}, codigo, {D('saldo')}, round(CAST(coalesce(children, saldo) AS DOUBLE), 2) AS saldo_calculado, round(CAST(coalesce(diff, 0) AS DOUBLE), 2) AS diff, coalesce(ok OR abs(diff) <= abs(saldo) * 0.0005, TRUE) AS ok FROM n LEFT JOIN c USING (ledger_id, period, codigo)")
def h18(spark, d):
    return double(tree.export_rollup(nodes(spark, d)), "saldo", "saldo_calculado", "diff")


@query("h19_relative_difference", f"SELECT {K}, codigo, {D('diff')}, round(CASE WHEN declared <> 0 THEN abs(CAST(diff AS DOUBLE) / CAST(declared AS DOUBLE)) ELSE 0 END, 6) AS relative FROM c")
def h19(spark, d):
    c = tree.rollup_check(nodes(spark, d))
    share = F.coalesce(F.abs(F.try_divide(F.col("diff").cast("double"), F.col("declared").cast("double"))), F.lit(0.0))
    return double(c.select(*tree.KEY, "codigo", "diff", F.round(share, 6).alias("relative")), "diff")


@query("h20_diagnosis", f"""SELECT {K}, roots, roots > 5 AS exploded, wd AS without_dots, wd > 3 AS mixed, CAST(surplus AS BIGINT) AS surplus, CAST(deepest AS INT) AS deepest FROM (SELECT {K}, count(*) AS roots FROM r GROUP BY ALL)
JOIN (SELECT {K}, CAST(count(*) FILTER (codigo NOT LIKE '%.%') AS BIGINT) AS wd, sum(n - 1) AS surplus, max(len(string_split(codigo, '.'))) AS deepest FROM n GROUP BY ALL) USING ({K})""")  # fmt: skip
def h20(spark, d):
    return tree.diagnosis(whole(spark, d))


@query("h20_levels", f"SELECT {K}, CAST(len(string_split(codigo, '.')) AS INT) AS nivel, count(*) AS n FROM n GROUP BY ALL")
def h20l(spark, d):
    return tree.level_histogram(nodes(spark, d))


@query("h20_top_roots", f"SELECT * FROM (SELECT {K}, codigo, {D('saldo')}, CAST(row_number() OVER (PARTITION BY {K} ORDER BY abs(saldo) DESC, codigo) AS INT) AS rank FROM r) WHERE rank <= 15", "repeated")
def h20t(spark, d):
    return double(tree.top_roots(nodes(spark, d, "repeated")), "saldo")


@query("h21_paths", f"SELECT {K}, codigo, string_agg(ancestor, '>' ORDER BY d) AS path FROM a GROUP BY ALL")
def h21(spark, d):
    pairs = tree.ancestors(nodes(spark, d), itself=True)
    return pairs.groupBy(*tree.KEY, "codigo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(codes.level(F.col("ancestor")).alias("d"), "ancestor"))), lambda x: x["ancestor"]), ">").alias("path"))


@query("h23_inferred_parents", f"SELECT DISTINCT {K}, codigo, CASE WHEN codigo LIKE '%.%' THEN regexp_replace(codigo, '\\.[^.]+$', '') END AS dotted, CASE WHEN len(replace(codigo, '.', '')) > 2 THEN left(replace(codigo, '.', ''), len(replace(codigo, '.', '')) - 2) WHEN len(replace(codigo, '.', '')) = 2 THEN left(codigo, 1) END AS flat FROM n")
def h23(spark, d):
    flat = F.replace("codigo", F.lit("."), F.lit(""))
    return nodes(spark, d).select(*tree.KEY, "codigo", F.when(F.col("codigo").contains("."), chart.parent_of(F.col("codigo"))).alias("dotted"), chart.parent_of(flat).alias("flat"))


@query("h24_parent_codes", f"SELECT DISTINCT {K}, array_to_string(string_split(codigo, '.')[1:i], '.') AS codigo FROM n, unnest(generate_series(1, len(string_split(codigo, '.')) - 1)) AS g(i)", "sparse")
def h24(spark, d):
    return rows(spark, d, "sparse").select(*tree.KEY, F.explode(codes.prefixes(F.col("codigo"), itself=False)).alias("codigo")).distinct()


@query("j3_has_children", f"SELECT {K}, codigo, EXISTS (SELECT 1 FROM e WHERE e.ledger_id = n.ledger_id AND e.period = n.period AND e.parent = n.codigo) AS synthetic FROM n")
def j3(spark, d):
    n = nodes(spark, d)
    parents = tree.edges(n).select(*tree.KEY, F.col("parent").alias("codigo")).distinct().withColumn("synthetic", F.lit(True))
    return n.join(parents, [*tree.KEY, "codigo"], "left").select(*tree.KEY, "codigo", F.coalesce("synthetic", F.lit(False)).alias("synthetic"))


@query("x22_code_order", f"SELECT {K}, codigo, CAST(row_number() OVER (PARTITION BY {K} ORDER BY list_transform(string_split(codigo, '.'), lambda s: CAST(s AS INT))) AS INT) AS place FROM n")
def x22(spark, d):
    from pyspark.sql import Window

    return nodes(spark, d).select(*tree.KEY, "codigo", F.row_number().over(Window.partitionBy(*tree.KEY).orderBy(codes.sort_key(F.col("codigo")))).alias("place"))
