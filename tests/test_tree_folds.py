import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import delivery, matching, projection, tree
from ledgerweave.operators.chart import parent_of
from ledgerweave.sources import layout, sinks

CODES = ["1", "1.1", "1.1.1", "1.1.2.5", "1.2", "1.10", "1.10.1", "2", "2.1", "10", "10.1", "3.1"]


def a_tree(spark, codes=CODES):
    rows = [(k, 2020, c, 1.0, 1, False) for k in ("a", "b") for c in codes]
    return spark.createDataFrame(rows, "ledger_id string, period int, codigo string, saldo double, n long, unreadable boolean")


def test_intervals_hold_what_is_below(spark):
    t = a_tree(spark)
    places = {(r.ledger_id, r.codigo): (r.first, r.last) for r in tree.intervals(t).collect()}
    assert len(places) == 2 * len(CODES)
    for k in ("a", "b"):
        assert sorted(places[k, c][0] for c in CODES) == list(range(1, len(CODES) + 1))
        for c in CODES:
            below = {x for x in CODES if x.startswith(c + ".")}
            first, last = places[k, c]
            assert {x for x in CODES if first < places[k, x][0] <= last} == below
    few = tree.listed(t, t.filter("codigo in ('1', '2.1')"))
    assert {(r.ledger_id, r.codigo): r.descendants for r in few.collect()} == {(k, "1"): sorted(c for c in CODES if c.startswith("1.")) for k in ("a", "b")}
    taken = tree.absorbed(t, t.filter("codigo in ('1.10', '2.1')"))
    assert {(r.ledger_id, r.codigo, r.n) for r in taken.collect()} == {("a", "1.10", 1), ("b", "1.10", 1)}


def test_nested_tree_of_any_depth(spark):
    deep = [".".join(["1"] * k) for k in range(1, 13)]
    for codes in (CODES, deep, ["5"]):
        known = set(codes)

        def parent(c, known=known):
            while "." in c:
                c = c.rpartition(".")[0]
                if c in known:
                    return c
            return None

        rows = spark.createDataFrame([("k", c, parent(c), f'nome "{c}"', None) for c in codes], "key string, codigo string, parent string, descricao string, tipo string")
        got = sinks.nested_tree(rows, ["key"], ["descricao", "tipo"], save_each=3).collect()

        def built(up, codes=codes, parent=parent):
            own = sorted((c for c in codes if parent(c) == up), key=lambda c: [int(x) for x in c.split(".")])
            return [{"codigo": c, "descricao": f'nome "{c}"', "tipo": None, "children": built(c)} for c in own]

        assert len(got) == 1 and json.loads(got[0].tree) == built(None)
    assert sinks.nested_tree(rows.limit(0), ["key"], ["descricao"]).count() == 0


def test_chart_export(spark, tmp_path):
    chart = [("1", "Ativo", None, ["L100"]), ("1.01", "Circulante", "1", ["L100", "L300"]), ("1.01.02.03", "Caixa", "1.01.02", ["L300"]), ("9.1", "Solta", "9", [])]
    df = spark.createDataFrame([(c, d, "A", None, len(c), p, f) for c, d, p, f in chart], "codigo string, descricao string, tipo string, natureza string, nivel int, parent_id string, forms array<string>")
    out = sinks.chart_export(df)
    assert {r.form: r.codigos for r in out["forms"].collect()} == {"L100": ["1", "1.01"], "L300": ["1.01", "1.01.02.03"]}
    assert {r.codigo: r.parent_id for r in out["contas_flat"].collect()} == {"1": None, "1.01": "1", "1.01.02.03": "1.01", "9.1": "9"}
    roots = json.loads(out["contas_tree"].first().tree)
    assert [r["codigo"] for r in roots] == ["1", "9.1"] and roots[0]["children"][0]["children"][0]["codigo"] == "1.01.02.03"
    assert json.loads({r.codigo: r.conta for r in out["contas_index"].collect()}["1.01"])["forms"] == ["L100", "L300"]
    sinks.write_chart(df, str(tmp_path / "chart"))
    assert spark.read.json(str(tmp_path / "chart/contas_index")).count() == 4


def windows(depths):
    """Segments as counts since the last shallower row; a level that is left out counts as 1."""
    out = []
    for i, d in enumerate(depths):
        code = []
        for k in range(d + 1):
            start = max([j + 1 for j in range(i + 1) if depths[j] < k], default=0)
            code.append(sum(depths[j] == k for j in range(start, i + 1)) + (depths[start] > k))
        out.append(".".join(map(str, code)))
    return out


@pytest.mark.parametrize("part_rows", [1, 3, 7, 1000])
def test_outline_over_parts(spark, part_rows):
    rng = random.Random(part_rows)
    ledgers = {f"k{i}": [rng.randint(0, rng.choice([1, 4, 9])) for _ in range(rng.randint(1, 60))] for i in range(5)} | {"deep": list(range(200)) + [199, 0, 3]}
    rows = [(k, i, d, "x") for k, depths in ledgers.items() for i, d in enumerate(depths)]
    rng.shuffle(rows)
    got = layout.outline(spark.createDataFrame(rows, "k string, row_no int, depth int, other string"), ["k"], part_rows)
    assert got.columns == ["k", "row_no", "depth", "other", "codigo"]
    found = {}
    for r in got.collect():
        found.setdefault(r.k, {})[r.row_no] = r.codigo
    assert {k: [v[i] for i in sorted(v)] for k, v in found.items()} == {k: windows(v) for k, v in ledgers.items()}


def test_flat_levels_of_many_lengths(spark):
    codes = ["1" * n for n in range(1, 23)] + ["1" * (n - 1) + "2" for n in range(1, 23)] + ["11"]
    df = spark.createDataFrame([("f", c) for c in codes] + [("g", c) for c in ("1", "2", "11", "12", "21", "111", "112", "211", "1111", "11111", "11112", "21111")], "k string, codigo string")
    got = {r.k: r.levels for r in layout.flat_levels(df, ["k"]).collect()}
    assert got == {"f": list(range(1, 23)), "g": [1, 2, 3, 5]}


def chains(pairs, hops=5):
    out = {}
    for key in pairs:
        value, seen, n = pairs[key], {key}, 0
        while value in pairs and value not in seen and n < hops:
            seen.add(value)
            value, n = pairs[value], n + 1
        out[key] = value
    return out


def test_chains_of_synonyms(spark):
    rng = random.Random(8)
    for n in (5, 12, 40):
        pairs = {f"k{i}": f"k{rng.randint(0, n + 3)}" for i in range(n)} | {f"c{i}": f"c{i + 1}" for i in range(20)}
        for hops in (1, 4, 5, 8):
            got = matching.resolved_chains(spark.createDataFrame([(k, v, 0) for k, v in pairs.items()], "key string, value string, priority int"), hops)
            assert dict(map(tuple, got.collect())) == chains(pairs, hops)


def test_synonyms_of_languages(spark):
    rows = [("phrase", None, 0, "Caixa  Geral", "caixa"), ("phrase", "en", 1, "CASH", "caixa geral"), ("phrase", "es", 2, "cash", "efectivo"), ("phrase", "en", 3, "caixa geral", "nunca"), ("token", None, 0, "A", "x"), ("token", None, 1, "á", "y"), ("abbrev", "es", 5, "cta", "conta"), ("token", "en", 9, " ", "z")]
    got = matching.synonym_map(spark.createDataFrame(rows, "kind string, lang string, place int, key string, value string"))
    assert {tuple(r) for r in got.collect()} == {("phrase", "caixa geral", "caixa"), ("phrase", "cash", "caixa"), ("token", "a", "y"), ("abbrev", "cta", "conta")}


def test_tie_breaker_whose_failure_changes_nothing(spark):
    rows = [(f"q{i}", ["a", "b"], i % 4 == 0, "a") for i in range(40)]
    matches = spark.createDataFrame(rows, "query string, candidates array<string>, accepted boolean, codigo string")

    def choose(queries, candidates):
        if any(q.endswith("7") for q in queries):
            raise ValueError("no answer")
        return [c[1] if q.endswith("1") else None for q, c in zip(queries, candidates, strict=True)]

    failures = spark.sparkContext.accumulator(0)
    got = {r.query: r.codigo for r in matching.tie_broken(matches, choose, failures).collect()}
    assert got == {q: "b" if q.endswith("1") and not done else "a" for q, _, done, _ in rows}
    assert failures.value == sum(q.endswith("7") and not done for q, _, done, _ in rows)
    assert {r.codigo for r in matching.tie_broken(matches, lambda q, c: 1 / 0).collect()} == {"a"}
    assert {r.codigo for r in matching.tie_broken(matches, lambda q, c: []).collect()} == {"a"}


def test_result_of_open_ledgers(spark):
    rows = [("closed", 10.0, 10.0, 5.0, 5.0), ("open", 100.0, 60.0, -70.0, 30.0), ("lost", 100.0, 60.0, 70.0, 20.0), ("none", 100.0, 60.0, None, None), ("large", 3e9 + 1000, 3e9, 2000.0, 1000.0005)]
    totals = spark.createDataFrame([(k, 1, *v) for k, *v in rows], "ledger_id string, period int, assets double, liabilities double, revenues double, expenses double")
    totals = totals.select("ledger_id", "period", *[F.col(c).cast("decimal(20,4)").alias(c) for c in totals.columns[2:]])
    moved = projection.result_to_equity(totals)
    assert {r.ledger_id: (float(r.transfer), r.warning) for r in moved.collect()} == {"closed": (0, None), "open": (40, None), "lost": (0, "gap of 40.00, result of 50.00"), "none": (0, None), "large": (1000, None)}
    assert {(r.ledger_id, r.alvo, float(r.valor)) for r in projection.equity_facts(moved).collect()} == {("open", "2.03.04.01", 40.0), ("large", "2.03.04.01", 1000.0)}


def test_bank_facts(spark):
    rows = [("1", "Ativo", 100), ("1.1", "Caixa", 60), ("7", "Receitas", 80), ("8", "Despesas", -50), ("8.1", "Pessoal", 20), ("9", "Compensação", 7), ("9.1", "Nada", 7), ("6.1", "Sem regra", 5), ("6.2", "Zero", 0)]
    df = spark.createDataFrame([("b", 1, i, c, d, float(v)) for i, (c, d, v) in enumerate(rows)], "ledger_id string, period int, row_no int, codigo string, descricao string, saldo double")
    facts, uncovered = delivery.bank_facts(df, spark.createDataFrame([("1", "A"), ("7", "R"), ("8", "D"), ("8.1", "P")], "rule string, alvo string"))
    assert {r.alvo: float(r.valor) for r in facts.collect()} == {"A": 100, "R": 80, "D": 70, "P": -20, "2.03.04.01": 80 + 70 - 20}
    assert [(r.codigo, float(r.valor)) for r in uncovered.collect()] == [("6.1", 5.0)]


def test_parent_of_a_code(spark):
    df = spark.createDataFrame([("1.2.3",), ("12345",), ("12",), ("1",)], "c string")
    assert [r[0] for r in df.select(parent_of(F.col("c"))).collect()] == ["1.2", "123", "1", None]
