import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import codes, numbers, text


def values(spark, rows, *columns, schema="s string"):
    return [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], schema).select(*columns).collect()]


@pytest.mark.parametrize("raw, want", [("1.234,56", 1234.56), ("1.234", 1234), ("1234.56", 1234.56), ("1,234.56", 1234.56), ("(1.234,56)", -1234.56), ("1.234,56 C", 1234.56), ("R$ 1.234,56", 1234.56), ("-", None), ("", None), ("abc", None), (None, None), ("1,234", 1.234), ("0.123", 123), ("1234.567", 1234.567), ("1.23.4", None), ("1.234,56-", 1234.56), ("(5,00) C", 5), ("BS2 X", 2), ("-7", -7), ("12.345.678", 12345678)])
def test_amounts(spark, raw, want):
    got = values(spark, [raw], numbers.parse_amount(F.col("s")))[0][0]
    assert got is None if want is None else float(got) == pytest.approx(want)


@pytest.mark.parametrize("raw, want", [("1.234,5", 1234.5), ("(10)", -10), ("dez/24", None), ("1,234", 1234), ("1.234", 1234), ("–", None), ("R$ 3,50", 3.5), ("", None)])
def test_statement_numbers(spark, raw, want):
    got = values(spark, [raw], numbers.parse_statement_number(F.col("s")))[0][0]
    assert got is None if want is None else float(got) == pytest.approx(want)


def test_other_numbers(spark):
    assert [float(x[0]) if x[0] is not None else None for x in values(spark, ["1.234", "1.234,5", "(2,5)", "x"], numbers.parse_simple_number(F.col("s")))] == [1.234, 1234.5, -2.5, None]
    assert [float(x[0]) if x[0] is not None else None for x in values(spark, ["(1.234", "-5,5", "abc"], numbers.parse_token(F.col("s")))] == [-1234, -5.5, None]
    assert values(spark, [float("nan"), float("inf"), 1.5], numbers.finite_amount(F.col("s")).cast("double"), schema="s double") == [(None,), (None,), (1.5,)]


def test_texts(spark):
    assert values(spark, ["  São  PAULO ", "Ação\tX"], text.normalized(F.col("s"))) == [("sao paulo",), ("acao x",)]
    assert values(spark, ["", None, "199687591.84", "A1", "Caixa"], text.is_garbage(F.col("s"))) == [(True,), (True,), (True,), (True,), (False,)]
    assert values(spark, ["TOTAL DO ATIVO", "Total do Ativo Circulante", "Total do Passivo e Patrimônio Líquido"], text.is_grand_total(F.col("s"))) == [(True,), (False,), (True,)]
    assert values(spark, ["(-) Outras receitas", "Custo das vendas", "Vendas", "Aluguéis", None], text.result_nature(F.col("s"))) == [("DESPESA",), ("DESPESA",), ("RECEITA",), (None,), (None,)]
    assert values(spark, ["Ativo não circulante", "Circulante", "Imobilizado", "x"], text.term(F.col("s"))) == [("NAO_CIRCULANTE",), ("CIRCULANTE",), ("NAO_CIRCULANTE",), (None,)]


def test_expansion(spark):
    maps = [F.create_map(F.lit(a), F.lit(b)) for a, b in (("lp", "longo prazo"), ("forn", "fornecedores"))]
    phrases = F.array(F.struct(F.lit("contas a receber").alias("key"), F.lit("clientes").alias("value")))
    assert values(spark, ["Forn. LP", "banco c/aplicações", "Contas a Receber"], text.expanded(F.col("s"), maps[0], phrases, maps[1])) == [("fornecedores longo prazo",), ("banco com aplicacoes",), ("clientes",)]


def test_codes(spark):
    assert values(spark, ["1.1", "(-) 2.01", "7", "x"], codes.account_class(F.col("s"))) == [("ATIVO",), ("PASSIVO",), ("RESULTADO",), (None,)]
    assert values(spark, ["1.00.00.00.00000000", "1.01.01.02.00000000", "1.1.1.01.001", "texto"], codes.unpadded(F.col("s"))) == [("1",), ("1.01.01.02",), ("1.1.1.01.001",), ("texto",)]
    keys = codes.fixed_width_key(F.col("s"), F.lit(6))
    assert values(spark, ["1.0.0.00.00.00007", "1.1.2.30.00.00003", "1.1.2.30.02.00007", "1.1.0"], keys) == [("1",), ("1.1.2.30",), ("1.1.2.30.02.00007",), ("1.1",)]
    assert values(spark, ["1", "11201", "1120100015"], codes.dotted(F.col("s"), F.array(*map(F.lit, (1, 3, 5, 10))))) == [("1",), ("1.12.01",), ("1.12.01.00015",)]
    assert values(spark, ["1.10", "1.9", "1.a", "1"], codes.prefixes(F.col("s")))[0] == (["1", "1.10"],)


def test_accents_of_all_latin_letters(spark):
    from ledgerweave.functions import text

    words = ["Škoda", "Őrség", "ﬁnança", "Żółć", "Ação à vista", "e\u0301tat", "Ångström"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(text.unaccented(F.col("w"))).collect()] == ["skoda", "orseg", "financa", "zołc", "acao a vista", "etat", "angstrom"]


def test_noise_and_detail_of_descriptions(spark):
    from ledgerweave.functions import text

    words = ["TFS SOLUCOES EM SOFTWARE", "CAIXA DO SISTEMA GERAL", "ACME EPP", "BANCO 341", "CONTA 12", "Conta corrente 77", "Digital"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.is_noise(F.col("w")), text.is_analytical_detail(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True), (False, True), (False, False), (False, True), (False, False)]
