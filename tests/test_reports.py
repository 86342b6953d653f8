import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import pages, projection
from ledgerweave.sources import files, sinks
from ledgerweave.streaming import learning


def test_pages_in_two_columns(spark):
    lines = [("Ativo", 10, "Passivo", 340), ("Caixa 1,00", 10, "Contas 2,00", 340), ("Bancos", 10, "Capital", 340)]
    rows = [("d", 1, w, float(x + 8 * i), float(x + 8 * i + 7), 30.0 * n + 0.5, 600) for n, (a, xa, b, xb) in enumerate(lines) for t, x in ((a, xa), (b, xb)) for i, w in enumerate(t.split())]
    rows += [("d", 2, "uma", 10.0, 20.0, 10.0, 600), ("d", 2, "linha", 400.0, 420.0, 10.0, 600)]
    words = spark.createDataFrame(rows, "doc_id string, page_no int, text string, x0 double, x1 double, top double, width int")
    got = {(r.page_no, r.line_no, r.side): r.line for r in pages.page_lines(words).collect()}
    assert got == {(1, 10 * n, s): t[2 * s] for n, t in enumerate(lines) for s in (0, 1)} | {(2, 3, 0): "uma linha"}
    columns = [(r.column_no, r.low, r.high) for r in pages.word_columns(words.filter("page_no = 1")).orderBy("column_no").collect()]
    assert columns == [(0, 10.0, 25.0), (1, 340.0, 355.0)]
    assert pages.page_lines(words.limit(0)).count() == 0


@pytest.mark.parametrize("line, cells", [("Caixa 10", ["Caixa", "10"]), ("a\tb  c", ["a", "b", "c"]), ("Contas a pagar (1.000,00) -2,5", ["Contas a pagar", "(1.000,00)", "-2,5"]), ("", []), ("12", ["12"]), ("Nota 3 45,00", ["Nota", "45,00"])])
def test_row_tokens(spark, line, cells):
    assert spark.createDataFrame([(line,)], "l string").select(pages.row_tokens(F.col("l"))).first()[0] == cells


def test_reports_of_a_run(spark, tmp_path):
    rows = spark.range(10).withColumn("bad", F.col("id") > 6)
    told = sinks.observed(rows, str(tmp_path / "t"), errors=F.count_if("bad"))
    assert told["rows"] == 10 and told["errors"] == 3 and told["seconds"] > 0
    report = {r.name: r.rows for r in sinks.run_report({"a": rows, "b": rows.filter("bad")}, str(tmp_path / "run")).collect()}
    assert report == {"a": 10, "b": 3} and spark.read.parquet(str(tmp_path / "run/b")).count() == 3


def test_audit_parts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "1.1", "1.01", None, 5.0), ("a", 1, "3.1", None, None, 7.0), ("a", 2, "2.1", None, "class", 1.0), ("b", 1, "2.2", None, None, 2.5)], "ledger_id string, period int, codigo string, alvo string, motivo string, valor double")
    summary = {(r.ledger_id, r.period, r.part): (r.n, float(r.total)) for r in sinks.write_audit_parts(rows, str(tmp_path), bank=True).collect()}
    assert summary == {("a", 1, "treated"): (1, 5.0), ("a", 1, "compensation"): (1, 7.0), ("a", 2, "unidentified"): (1, 1.0), ("b", 1, "unidentified"): (1, 2.5)}
    assert {r.motivo for r in sinks.audited(rows).collect()} == {None, "class", "no reliable match in the chart"}
    assert spark.read.parquet(str(tmp_path / "rows")).filter("part = 'treated'").count() == 1


def test_lost_accounts_by_size(spark):
    rows = spark.createDataFrame([("a", 1, 1, "1.1", "Caixa", 5.0), ("a", 1, 2, "1.1", "Outra", None), ("a", 1, 3, "4.1", "Receita", -9.0), ("a", 1, 4, "9", "fora", 3.0)], "ledger_id string, period int, row_no int, codigo string, descricao string, saldo double")
    lost = projection.uncovered_rows(rows.filter("codigo <> '9'"), rows, spark.createDataFrame([("a", 1, "4.1", "term")], "ledger_id string, period int, codigo string, motivo string"))
    got = [(r.codigo, r.descricao, float(r.valor), r.motivo, r.rank, float(r.total)) for r in projection.by_size(lost).orderBy("rank").collect()]
    assert got == [("4.1", "Receita", -9.0, "term", 1, -9.0), ("1.1", "Caixa", 5.0, "no reliable match in the chart", 2, -4.0)]
    natures = spark.createDataFrame([("a", 1, "4.1", "RECEITA")], "ledger_id string, period int, codigo string, natureza string")
    assert {(r.kind, r.name, float(r.total)) for r in projection.lost_totals(lost, natures).collect()} == {("class", "ATIVO", 5.0), ("class", "RESULTADO", -9.0), ("nature", "RECEITA", -9.0)}


def test_periods(spark):
    rows = spark.createDataFrame([("a", y) for y in range(2018, 2024)] + [("b", 2020), ("b", 2020)], "ledger_id string, period int")
    counts = {(r.ledger_id, r.period): (r.rows, r.facts) for r in projection.period_counts(rows, rows.filter("ledger_id = 'b'")).collect()}
    assert counts[("a", None)] == (6, 0) and counts[("b", 2020)] == (2, 2) and counts[("b", None)] == (2, 2)
    assert [(r.ledger_id, r.periods) for r in projection.too_many_periods(rows).collect()] == [("a", list(range(2018, 2024)))]


def test_locks_in_their_order(spark):
    none = None
    rows = [("1", "A", "A", none, none, none, none), ("2", "A", "B", "R", "D", none, none), ("3", none, "B", "R", "D", "C", "N"), ("4", none, none, none, none, "C", "N"), (none,) * 7, ("6",) + (none,) * 6, ("7",) + (none,) * 6]
    matched = spark.createDataFrame(rows, "codigo string, classe string, alvo_classe string, natureza string, alvo_natureza string, prazo string, alvo_prazo string")
    projected = spark.createDataFrame([(c, "t" if c != "6" else None, "blocked") for c in "123456"], "codigo string, alvo string, metodo string")
    got = {r.codigo: (r.motivo, r.codigo_template) for r in projection.resolved(matched, projected).collect()}
    assert got == {"1": (None, "t"), "2": ("class", None), "3": ("nature", None), "4": ("term", None), None: ("no match", None), "6": ("blocked", None), "7": ("no line", None)}


def test_densest_header(spark):
    rows = [("f", 0, "a;b"), ("f", 1, "x,y,z;"), ("f", 2, "1;2;3"), ("f", 3, "1|2|3"), ("g", 0, ";;;"), ("g", 60, "1;2;3")]
    table = spark.createDataFrame(rows, "file_id string, row_no int, line string")
    assert {r.file_id: (r.header, r.delimiter) for r in files.densest_header(table).collect()} == {"f": (2, ";"), "g": (0, ",")}


def test_required_columns(spark):
    df = spark.createDataFrame([(["código", "saldo atual"],), (["nome"],)], "h array<string>")
    assert [r[0] for r in df.select(files.has_columns(F.col("h"), ["código", "saldo"])).collect()] == [True, False]


def test_reset(spark, tmp_path):
    state = spark.createDataFrame([("a", 1)], "k string, n int")
    state.write.parquet(str(tmp_path / "s"))
    learning.reset(state, str(tmp_path / "s"))
    assert spark.read.schema(state.schema).parquet(str(tmp_path / "s")).count() == 0


def test_metadata_of_pages(spark):
    texts = ["x\nEMPRESA ÁGUA S/A\n em 31/12/2019 e 30/06/2018\nR$ milhares", "Minha casa nova", None, "período de 01/02/2003 em dólar"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, page_no int, text string")
    got = [tuple(r)[2:] for r in pages.page_metadata(df).orderBy("page_no").collect()]
    assert got == [("EMPRESA ÁGUA S/A", "31/12/2019", "BRL", "thousands", 1000), ("Minha casa", None, None, None, None), (None,) * 5, (None, "01/02/2003", "USD", None, None)]
