import pytest
from pyspark.sql import functions as F

from ledgerweave.functions.text import normalized
from ledgerweave.operators import chart, matching
from ledgerweave.sources import files, layout
from ledgerweave.streaming import learning


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    text = "Empresa X\nCodigo;Descrição;Saldo;Natureza\n1;Ativo;1.000,00;D\n1.1;Caixa;1.000,00;D\n"
    (at / "a.csv").write_text(text, encoding="utf-8")
    (at / "b.csv").write_text(text, encoding="latin-1")
    (at / "c.csv").write_text(text, encoding="utf-16")
    (at / "d.csv").write_text(text, encoding="utf-8-sig")
    (at / "e.bin").write_bytes(b"\x00\x01")
    return str(at)


def test_files_become_cells(spark, folder):
    listed = {r.name: (r.extension, r.accepted) for r in files.catalogue(spark, folder).collect()}
    assert listed["a.csv"] == ("csv", True) and listed["e.bin"] == ("bin", False)
    table = files.lines(spark, folder + "/*.csv")
    assert {r.line for r in table.filter("row_no = 1").collect()} == {"Codigo;Descrição;Saldo;Natureza"}
    by = files.delimiter(table)
    assert {r.delimiter for r in by.collect()} == {";"}
    assert {r.header for r in files.header_rows(table).collect()} == {1}
    grid = files.cells(table.filter("row_no > 1"), by).withColumn("sheet", F.lit("s"))
    assert grid.filter("row_no = 3 and col_no = 1").select("value").distinct().collect()[0][0] == "Caixa"


def test_rejected_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,2\nbad,3\n4,5\n")
    rows, rejected = files.read_csv(spark, str(tmp_path), "a int, b int")
    assert rows.count() == 2 and [tuple(r)[1:] for r in files.first_rejected(rejected).collect()] == [(2, "not of the schema", "bad,3", 1)]


def test_records_from_a_grid(spark):
    rows = [(i, ["", f"1.1.{i}", f"Conta de número {chr(65 + i)}", f"{i}.000,50"]) for i in range(12)]
    grid = spark.createDataFrame([("f", "s", i, j, v) for i, vs in rows for j, v in enumerate(vs)], "file_id string, sheet string, row_no int, col_no int, value string")
    got = {r.codigo: float(r.saldo) for r in layout.records(grid).collect()}
    assert got == {f"1.1.{i}": i * 1000 + 0.5 for i in range(12)}


def test_indented_codes(spark):
    df = spark.createDataFrame([("f", 0, "1.1"), ("f", 1, "  0005"), ("f", 2, "  0006"), ("f", 3, "1.2"), ("f", 4, " 7 ")], "file_id string, row_no int, codigo string")
    assert [r.codigo for r in layout.indented(df, ["file_id"]).orderBy("row_no").collect()] == ["1.1", "1.1.0005", "1.1.0006", "1.2", "1.2.7"]


def test_learning_stream_is_idempotent(spark, tmp_path):
    for name, rows in (("a", "1.1,Caixa\n1.2,Bancos\n"), ("b", "1.1,Caixa geral\n")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.csv").write_text(rows)
    def run():
        inputs = files.stream_csv(spark, f"{tmp_path}/in", "codigo string, texto string", 1)
        learning.learn_stream(inputs, lambda b: b.select("codigo", normalized(F.col("texto")).alias("text")), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
        return {r.codigo: (r.variations, r.frequency) for r in learning.variations(spark.read.parquet(f"{tmp_path}/log")).collect()}

    first = run()
    assert first == {"1.1": (["caixa", "caixa geral"], 2), "1.2": (["bancos"], 1)} and run() == first


def test_matching_respects_class_and_cache(spark):
    plan = spark.createDataFrame([("1.1.02.01", "Clientes", "A"), ("2.1.05.01", "Clientes", "A"), ("1.1.01.01", "Caixa Geral", "A")], "codigo string, descricao string, tipo string")
    index = matching.build_index(plan, spark.createDataFrame([("1.1.01.01", ["cofre"], 3)], "codigo string, variations array<string>, frequency long"))
    none = [None, None, None, None]
    asked = spark.createDataFrame([("clientes", "ATIVO", *none), ("clientes", "PASSIVO", *none), ("cofre", None, *none), ("zzz", None, *none)], "query string, q_classe string, q_natureza string, q_prazo string, q_tipo string, q_hint string")
    got = {(r.query, r.q_classe): r for r in matching.match(asked, index).collect()}
    assert got["clientes", "ATIVO"].codigo == "1.1.02.01" and got["clientes", "PASSIVO"].codigo == "2.1.05.01"
    assert got["cofre", None].codigo == "1.1.01.01" and got["cofre", None].accepted and not got["zzz", None].accepted
    known = spark.createDataFrame([("zzz", "9.9")], "key string, codigo string")
    assert {r.query: r.source for r in matching.match(asked, index, known).collect()}["zzz"] == "cache"


def test_chart(spark):
    rows = spark.createDataFrame([("1", "Caixa", "", ["a"], 1), ("1", "Caixa geral", "A", ["b", "a"], 2)], "codigo string, descricao string, tipo string, forms array<string>, row_no long")
    r = chart.merged(rows, ["tipo"]).first()
    assert (r.descricao, r.tipo, r.forms) == ("Caixa geral", "A", ["a", "b"])
