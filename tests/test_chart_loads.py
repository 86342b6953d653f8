import json

from ledgerweave.operators import chart, matching


def test_chart_from_tables(spark):
    one = spark.createDataFrame([("1.01", "Caixa", "2", "A"), (" 1.02 ", None, "x", None), (None, "Total", None, None)], "`Código` string, `Descrição` string, `Nível` string, Tipo string")
    two = spark.createDataFrame([("1.01", "Caixa geral"), ("1234", "Bancos"), ("12", "Outros"), ("  ", "nada")], "A string, `B.1` string")
    got = {r.codigo: r for r in chart.from_tables({"S1": one, "S2": two}).collect()}
    assert set(got) == {"1.01", "1.02", "1234", "12"}
    a = got["1.01"]
    assert (a.descricao, a.nivel, a.tipo, a.parent_id, a.forms) == ("Caixa geral", 2, "A", "1", ["S1", "S2"])
    assert (got["1.02"].descricao, got["1.02"].nivel, got["1234"].parent_id, got["12"].parent_id) == ("", None, "12", "1")


def test_chart_from_json(spark, tmp_path):
    (tmp_path / "plan.json").write_text(json.dumps({"forms": {"S": ["1"]}, "contas_flat": [{"codigo": "1", "descricao": "Ativo", "tipo": "S", "nivel": 1, "forms": ["S"]}, {"codigo": "1.1", "descricao": "Caixa", "parent_id": "1", "natureza": "Devedora"}]}, indent=1))
    plan = chart.from_json(spark, str(tmp_path / "plan.json"))
    got = {r.codigo: r for r in plan.collect()}
    assert got["1"].forms == ["S"] and got["1"].nivel == 1 and (got["1.1"].parent_id, got["1.1"].natureza) == ("1", "Devedora")
    assert {r.lado for r in matching.build_index(plan).collect()} == {None, "Devedora"}
