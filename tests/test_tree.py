import random
from decimal import Decimal

import pytest

from ledgerweave.operators import projection, tree
from ledgerweave.sources import layout

SCHEMA = "ledger_id string, period int, row_no long, codigo string, descricao string, saldo decimal(20,4)"


def rows_of(spark, items, ledger="L"):
    return spark.createDataFrame([(ledger, 2024, i, c, d, None if v is None else Decimal(str(v))) for i, (c, d, v) in enumerate(items)], SCHEMA)


OWN = [("1", "Ativo", 1000), ("1.1", "Circulante", 1000), ("1.1.1", "Disponível", 1000), ("1.1.1.02", "BANCOS", 1000), ("1.1.1.02.0005", "Banco A", 600), ("1.1.1.02.0006", "Banco B", 250), ("1.1.1.02.0007", "Banco C", 150)]


def cut(spark, items, mapped):
    n = tree.nodes(tree.in_tree(rows_of(spark, items)))
    chosen = n.filter(n.codigo.isin(*mapped))
    return ({r.codigo for r in x.collect()} for x in tree.tree_cut(n, chosen))


def test_checks_and_missing_leaf(spark):
    good = tree.nodes(tree.in_tree(rows_of(spark, OWN)))
    assert all(r.ok for r in tree.rollup_check(good).collect())
    bad = tree.nodes(tree.in_tree(rows_of(spark, OWN[:-1])))
    assert [(r.codigo, float(r["diff"])) for r in tree.divergences(bad).collect()] == [("1.1.1.02", 150.0)]


def test_leaves_are_absorbed_by_the_mapped_node(spark):
    emitted, uncovered = cut(spark, OWN, ["1.1.1.02"])
    assert emitted == {"1.1.1.02"} and uncovered == set()


def test_a_class_root_never_absorbs(spark):
    items = [("1", "Ativo", 300), ("1.1", "a conta", 100), ("1.1.01", "b conta", 100), ("1.5", "c conta", 200), ("1.5.01", "d conta", 200)]
    emitted, uncovered = cut(spark, items, ["1", "1.1.01"])
    assert emitted == {"1.1.01"} and uncovered == {"1.5.01"}


def test_equation(spark):
    closes = lambda items: [(float(r.residue), r.closes) for r in tree.equation(tree.nodes(rows_of(spark, items))).collect()]
    assert closes([("1", "Ativo", 1000), ("2", "Passivo", -800), ("3", "PL", -200)]) == [(0.0, True)]
    assert closes([("1", "Ativo", 1000), ("2", "Passivo", -500), ("3", "PL", -200)]) == [(300.0, False)]


def test_repeated_codes_gaps_totals_and_no_codes(spark):
    n = tree.nodes(rows_of(spark, [("2.1", "x conta", -300), ("2.1.1", "y conta", -200), ("2.1.1", "z conta", -100)]))
    assert {r.codigo: float(r.saldo) for r in n.collect()} == {"2.1": -300.0, "2.1.1": -300.0}
    e = tree.edges(tree.nodes(rows_of(spark, [("1", "Ativo", 50), ("1.1.1.02", "Banco", 50)])))
    assert [(r.child, r.parent) for r in e.collect()] == [("1.1.1.02", "1")]
    assert tree.in_tree(rows_of(spark, [("2187555.9", "4389425.29", 1), ("3.9", "TOTAL DO ATIVO", 1), ("Caixa", "Caixa", 1)])).count() == 0
    assert [(r.has_tree, r.sound) for r in tree.report(rows_of(spark, [("Caixa", "Caixa", 1)])).collect()] == [(False, False)]


def test_unreadable_balances_are_not_green(spark):
    r = tree.report(rows_of(spark, [(c, d, None) for c, d, _ in OWN])).first()
    assert not r.readable and not r.sound


def naive_cut(codes, mapped):
    """Recursion from the roots: go below a mapped node only if every leaf below it has a deeper mapped one."""
    have = set(codes)
    parent = lambda c: next((p for n in range(c.count("."), 0, -1) if (p := ".".join(c.split(".")[:n])) in have), None)
    children = {}
    for c in have:
        children.setdefault(parent(c), []).append(c)
    stops = {c for c in mapped if "." in c}

    def full(c):  # every leaf below c ends in a stop strictly below c
        return all((k in stops) or (k in children and full(k)) for k in children.get(c, [])) and c in children

    emitted, lost = set(), set()

    def walk(c):
        if c in stops and not full(c):
            emitted.add(c)
        elif c in children:
            for k in children[c]:
                walk(k)
        else:
            lost.add(c)

    for c in children.get(None, []):
        walk(c)
    return emitted, lost


def test_cut_against_recursion_on_random_trees(spark):
    rng = random.Random(4)
    rows, mapped, want = [], [], {}
    for t in range(60):
        codes = {"1"}
        for _ in range(rng.randint(3, 14)):
            base = rng.choice(sorted(codes))
            if base.count(".") < 4:
                codes.add(f"{base}.{rng.randint(1, 3)}")
        chosen = [c for c in sorted(codes) if rng.random() < 0.5]
        want[f"T{t}"] = naive_cut(codes, chosen)
        rows += [(f"T{t}", 1, i, c, "conta", Decimal(1)) for i, c in enumerate(sorted(codes))]
        mapped += [(f"T{t}", 1, c) for c in chosen]
    n = tree.nodes(spark.createDataFrame(rows, SCHEMA))
    emitted, lost = tree.tree_cut(n, spark.createDataFrame(mapped, "ledger_id string, period int, codigo string"))
    got = {k: (set(), set()) for k in want}
    for i, part in enumerate((emitted, lost)):
        for r in part.collect():
            got[r.ledger_id][i].add(r.codigo)
    assert got == want


def test_natures_by_branch(spark):
    items = [("3", "CUSTOS E DESPESAS", 400), ("3.2.2.01.004", "Alugueis", 400), ("4", "RECEITAS", 1000), ("4.1.1.01.002", "Servicos prestados", 1000)]
    got = {r.codigo: r.natureza for r in tree.natures(rows_of(spark, items)).collect()}
    assert got == {"3": "DESPESA", "3.2.2.01.004": "DESPESA", "4": "RECEITA", "4.1.1.01.002": "RECEITA"}


def test_capture(spark):
    facts = spark.createDataFrame([("L", 1, "1.01.05", Decimal(100)), ("L", 1, "9.99.99", Decimal("42.5")), ("L", 1, "1.01.05.02", Decimal(80))], "ledger_id string, period int, codigo string, valor decimal(20,4)")
    lines = projection.line_prefixes(spark.createDataFrame([("BP", 1, "Caixa", "1.01"), ("BP", 2, "Parte", "1.01.05.02|2.01")], "stmt string, line_no int, label string, codes string"))
    r = projection.capture_check(facts, lines).first()
    assert (float(r.lost), float(r.doubled), r.n_lost, r.n_doubled) == (42.5, 80.0, 1, 1)


def test_bank_plan(spark):
    bank = rows_of(spark, [("7", "Contas de Resultado Credoras", 1), ("8", "Contas de Resultado Devedoras", 1)], "B").unionByName(rows_of(spark, [("1", "Ativo", 1), ("4", "Receitas", 1)], "A"))
    assert {r.ledger_id: r.is_bank for r in projection.bank_plan(bank).collect()} == {"A": False, "B": True}


def test_outline_numbers(spark):
    depths = [0, 1, 1, 2, 0, 2, 2, 1]
    df = spark.createDataFrame([("f", i, d) for i, d in enumerate(depths)], "file_id string, row_no int, depth int")
    got = [r.codigo for r in layout.outline(df, ["file_id"]).orderBy("row_no").collect()]
    assert got[:5] == ["1", "1.1", "1.2", "1.2.1", "2"]


@pytest.mark.parametrize("codes, kept", [([str(i) for i in range(1, 669)], True), (["1", "2"], True)])
def test_counters_and_few_codes_have_no_levels(spark, codes, kept):
    df = spark.createDataFrame([("f", c) for c in codes], "file_id string, codigo string")
    assert layout.flat_levels(df, ["file_id"]).count() == 0
