"""Deliveries, text ledgers, plans of fixed width, and outlines, against values worked out by hand."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerweave.operators import delivery, projection, tree
from ledgerweave.sources import layout, names, text_ledgers

LEDGER = "ledger_id string, period int, row_no long, codigo string, descricao string, saldo decimal(20,4)"


def ledger(spark, rows):
    return spark.createDataFrame([(x, 2020, n, c, d, Decimal(v)) for n, (x, c, d, v) in enumerate(rows)], LEDGER)


def test_without_a_tree_every_mapped_code_emits(spark):
    rows = ledger(spark, [("T", "1", "Ativo", 3), ("T", "1.1", "Caixa", 1), ("T", "1.2", "Bancos", 2), ("F", "100", "Caixa", 1), ("F", "200", "Bancos", 2), ("F", "200", "Bancos", 3)])
    mapped = spark.createDataFrame([("T", 2020, "1.1"), ("F", 2020, "200")], "ledger_id string, period int, codigo string")
    emitted, uncovered = (sorted((r.ledger_id, r.codigo) for r in x.collect()) for x in delivery.selection(rows, mapped))
    assert emitted == [("F", "200"), ("T", "1.1")] and uncovered == [("F", "100"), ("T", "1.2")]


def test_outline_of_any_depth(spark):
    rows = spark.createDataFrame([("a", n, n) for n in range(14)] + [("a", 14, 13), ("a", 15, 12)], "k string, row_no int, depth int")
    got = {r.row_no: r.codigo for r in layout.outline(rows, ["k"]).collect()}
    assert got[13] == ".".join(["1"] * 14) and got[14] == ".".join(["1"] * 13 + ["2"]) and got[15] == ".".join(["1"] * 12 + ["2"])
    assert len(set(got.values())) == 16
    assert layout.outline(rows.limit(0), ["k"]).count() == 0


def test_renamed_codes_climb_under_their_new_name(spark):
    codes_ = spark.createDataFrame([("3.11.5.1",), ("3.11.7.2",), ("3.11.9",), ("2.1",)], "codigo string")
    lines = spark.createDataFrame([("DRE", 1, "a", "3.01.5"), ("DRE", 2, "b", "3.01")], "stmt string, line_no int, label string, codes string")
    mapping, blocked = spark.createDataFrame([("3.01.9", "9.9")], "codigo string, alvo string"), spark.createDataFrame([("3.01.7",)], "codigo string")
    got = {r.codigo: (r.alvo, r.metodo) for r in projection.project(codes_, projection.line_prefixes(lines), mapping, blocked).collect()}
    assert got == {"3.11.5.1": ("3.01.5.1", "rename"), "3.11.7.2": ("3.01.7.2", "rename"), "3.11.9": ("9.9", "rename map"), "2.1": (None, "failed")}


def test_totals_of_two_statements_do_not_mix(spark):
    facts = spark.createDataFrame([("L", 2020, "1", Decimal(5)), ("L", 2020, "2", Decimal(7))], "ledger_id string, period int, codigo string, valor decimal(20,4)")
    lines = spark.createDataFrame([("A", 1, "x", "1"), ("B", 1, "y", "2")], "stmt string, line_no int, label string, codes string")
    terms = spark.createDataFrame([("A", 9, 1, 1), ("B", 9, 1, -1), ("B", 10, 9, 2)], "stmt string, total_line int, term_line int, coef int")
    got = {(r.stmt, r.line_no): int(r.valor) for r in projection.statement(facts, projection.line_prefixes(lines), terms).collect()}
    assert got == {("A", 1): 5, ("B", 1): 7, ("A", 9): 5, ("B", 9): -7, ("B", 10): -14}


def test_existing_parents(spark):
    nodes = ledger(spark, [("L", c, c, 1) for c in ("1", "12", "1234", "123456", "1.1", "1.1.5.7", "99")])
    got = {r.codigo: r.parent for r in tree.existing_parents(nodes).collect()}
    assert got == {"12": "1", "1234": "12", "123456": "1234", "1.1": "1", "1.1.5.7": "1.1"}


def test_plans_of_fixed_width(spark):
    codes_ = ["1.1.2.30.00.00003", "1.0.0.00.00.00007", "1.2.2.10.20.00004", "1.2.2.10.20.00035", *[f"1.1.2.30.02.{n:05}" for n in range(8)]]
    rows = spark.createDataFrame([("B", c) for c in codes_] + [("P", f"1.{n}") for n in range(12)], "k string, codigo string")
    got = {r.codigo_original: r.codigo for r in layout.canonical(rows, ["k"]).collect()}
    assert got["1.1.2.30.00.00003"] == "1.1.2.30" and got["1.0.0.00.00.00007"] == "1" and got["1.2.2.10.20.00004"] == "1.2.2.10.20.00004" and got["1.3"] == "1.3"


def test_names(spark):
    given = ["Balancete 2024.xlsx", "202404_2024.xls", "1222024.csv", "2012-12.TXT", "Balanc dez 25.xls", "x Dez24 - Parecer.pdf", "3T25 BR.pdf", "Balancete 072022 122022 - RBM", "Balancete 042025 em excel"]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(given)], "n int, name string").orderBy("n")
    rows = df.select(names.year_of(F.col("name"), 2030), names.month_of(F.col("name")), names.customer_of(F.col("name"))).collect()
    assert [r[0] for r in rows] == [2024, 2024, 2024, 2012, 2025, 2024, 2025, 2022, 2025]
    assert rows[4][1] == 12 and rows[0][1] is None
    assert [r[2] for r in rows[6:]] == ["BR", "RBM", ""]


def test_text_ledgers(spark):
    lines = ["BALANCETE", "Classificação;Tp;Código;Anterior;Débitos;Créditos;Atual", "-----;===", "1.1;T;10 CAIXA GERAL;1,00;2,00;3,00;4,50", "1.2;A;BANCOS", "short;line"]
    df = spark.createDataFrame([("f", n, x) for n, x in enumerate(lines)] + [("g", 0, "Codigo\tDescricao\tSaldo"), ("g", 1, "7\tCaixa\t1,50")], "file_id string, row_no int, line string")
    got = [(r.classificacao, r.tipo, r.codigo, r.descricao, None if r.saldo_atual is None else float(r.saldo_atual)) for r in text_ledgers.text_rows(df).orderBy("row_no").collect()]
    assert got == [("1.1", "T", "10", "CAIXA GERAL", 4.5), ("1.2", "A", None, "BANCOS", None)]
    assert [(r.codigo, r.descricao, float(r.saldo)) for r in text_ledgers.simple_rows(df).collect()] == [("7", "Caixa", 1.5)]
