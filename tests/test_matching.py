import random

from ledgerweave.operators import matching
from tests.test_similarity import set_ratio, sort_ratio

WORDS = ["caixa", "bancos", "conta", "movimento", "clientes", "estoque", "receita", "despesa", "outros", "creditos", "geral", "aplicacoes"]


def some_texts(n):
    rng = random.Random(3)
    return sorted({" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))) for _ in range(n)})


def some_queries():
    """Common words, misspelt words, words that no text holds, and none."""
    return ["caixa", "conta movimento outros creditos geral", "bancs cnta", "xyzzy", "estqoue", ""]


def brute(queries, texts, limit):
    out = set()
    for q in queries:
        ranked = sorted((-set_ratio(q, t), t) for t in texts)[:limit]
        out |= {(q, t, -s, sort_ratio(q, t)) for s, t in ranked}
    return out


def test_similar_texts_in_blocks_are_exact(spark):
    texts = some_texts(400)
    queries = spark.createDataFrame([(q,) for q in [*some_queries(), "caixa", None]], "query string")
    known = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "text string")
    got = matching.similar_texts(queries, known, 15, query_block=2, text_block=50).collect()
    assert len(got) == 15 * len(some_queries()) and set(map(tuple, got)) == brute(some_queries(), texts, 15)


def test_similar_texts_beyond_the_former_broadcast(spark):
    many = [f"w{i} v{i % 50}" for i in range(20_100)]
    queries, texts = ["w7x v49x", "w20050 v0"], [*many, "zzz"]
    got = matching.similar_texts(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(t,) for t in texts], "text string"), 10).collect()
    assert set(map(tuple, got)) == brute(queries, texts, 10)


def test_no_texts(spark):
    one, none = spark.createDataFrame([("caixa",)], "query string"), spark.createDataFrame([], "text string")
    assert matching.similar_texts(one, none).collect() == []


def test_search_ranks_all_texts_by_sorted_words(spark):
    texts = [f"caixa a{i:03}" for i in range(60)] + ["caixa", "caixas", "banco"]
    found = matching.search(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([("caixa",), ("banco",)], "query string")).collect()
    got = {(r.query, r["rank"]): (r.text, r.sort_ratio) for r in found}
    assert got["caixa", 1] == ("caixa", 100.0) and got["caixa", 2][0] == "caixas" and got["banco", 1] == ("banco", 100.0)
    for q in ("caixa", "banco"):
        scored = sorted((-sort_ratio(q, t), t) for t in texts)
        assert [got[k] for k in sorted(got) if k[0] == q] == [(t, -s) for s, t in scored[:10] if -s >= 60]


ASKED = "query string, q_classe string, q_natureza string, q_prazo string, q_tipo string, q_hint string"


def matched(spark, chart, asked, vocabulary=None):
    index = matching.build_index(spark.createDataFrame(chart, "codigo string, descricao string, tipo string, natureza string"))
    queries = spark.createDataFrame(asked, ASKED + ", q_saldo double")
    return {(r.query, r.q_classe, r.q_prazo, r.q_saldo): r for r in matching.match(queries, index, vocabulary=vocabulary).collect()}


CHART = [("1.02", "Abcdefgh xyzw qrst", "S", None), ("1.01", "Caixa forte central", "A", "Devedora"), ("2.01.01", "Caixa forte alheio", "A", "Devedora"), ("2.01.02", "Lucro caixa", "A", "Credora"), ("1.02.01", "Caixa restrita central", "A", "Devedora")]


def by_hand(q, hints, saldo, chart):
    """What the match with heuristics makes of chart accounts that lack a term of their own: (score, codigo), best first."""
    classe, prazo, tipo, side = hints
    of = lambda c: "ATIVO" if c[0] == "1" else "PASSIVO"
    term = lambda c: {"1.01": "CIRCULANTE", "1.02": "NAO_CIRCULANTE", "2.01": "CIRCULANTE"}[c[:4]]
    fuzzy, words = [], []
    for code, name, kind, lado in chart:
        s = set_ratio(q, name.lower()) + 5 * (kind == tipo) + 3 * (lado is not None and lado == side)
        s = s * 0.5 if classe and of(code) != classe else s
        s = s * 0.3 if prazo and term(code) != prazo else s + 5 if prazo else s
        fuzzy.append((min(s, 100.0) / 100, code, lado))
        if "caixa" in name.lower():
            s = 0.70 + (0.10 if kind == tipo else 0) + (0.05 if lado is not None and lado == side else 0)
            s = s * 0.5 if classe and of(code) != classe else s
            words.append((s * 0.3 if prazo and term(code) != prazo else s, code, lado))
    best = max(fuzzy)
    if best[0] >= 0.85:
        return [best[:2]]
    fits = lambda x: x is None or (saldo > 0 and x == "Devedora") or (saldo < 0 and x == "Credora")
    return sorted(((min(s + 0.05, 1.0) if saldo and fits(x) else s, c) for s, c, x in [best, *(w for w in words if w[1] != best[1])]), key=lambda x: (-x[0], x[1]))


def test_match_accepts_by_keyword(spark):
    q = "caixa abcdefgh ijklmnop"
    kinds = [(classe, prazo, saldo) for classe in (None, "ATIVO", "PASSIVO") for prazo in (None, "CIRCULANTE") for saldo in (None, 10.0, -10.0)]
    got = matched(spark, CHART, [(q, classe, None, prazo, "A", "Devedora", saldo) for classe, prazo, saldo in kinds])
    assert len(got) == len(kinds)
    for classe, prazo, saldo in kinds:
        r, want = got[q, classe, prazo, saldo], by_hand(q, (classe, prazo, "A", "Devedora"), saldo, CHART)
        assert abs(r.score / 100 - want[0][0]) < 1e-9 and r.codigo == want[0][1], (r, want)
        assert r.accepted == (want[0][0] >= 0.85) and r.candidates[: len(want)] == [c for _, c in want][:10]
    r = got[q, "ATIVO", None, 10.0]
    assert (r.codigo, r.accepted, r.source) == ("1.01", True, "heuristic")


def test_match_expands_the_query_and_breaks_ties_on_the_core(spark):
    from pyspark.sql import functions as F

    chart = [("1.1", "Clientes", "A", None), ("1.2", "Bancos - conta movimento no pais e no exterior", "A", None), ("1.3", "Bancos outros", "A", None)]
    tokens = F.create_map(*map(F.lit, ("fregueses", "clientes")))
    vocabulary = (F.create_map().cast("map<string,string>"), F.array().cast("array<struct<key:string,value:string>>"), tokens)
    got = {k[0]: r for k, r in matched(spark, chart, [(q, None, None, None, None, None, None) for q in ("fregueses", "bancos")], vocabulary).items()}
    assert (got["fregueses"].codigo, got["fregueses"].accepted, got["fregueses"].source) == ("1.1", True, "match")
    assert got["bancos"].codigo == "1.2" and got["bancos"].score == 100.0


def test_accounts_that_no_query_tells_apart(spark, monkeypatch):
    rng = random.Random(11)
    chart = [(f"{rng.choice('12')}.01.{i}", rng.choice(["Caixa", "Caixa geral", "Bancos conta", "Receita de vendas"]), rng.choice("AS"), rng.choice(["Devedora", None])) for i in range(600)]
    index = matching.build_index(spark.createDataFrame(chart, "codigo string, descricao string, tipo string, natureza string"))
    assert matching.foremost(index, 3).count() < 200  # the join with the queries meets no more, whatever the accounts under a text are
    asked = spark.createDataFrame([("caixa", "ATIVO", None, "A", "Devedora"), ("caixa geral", None, "CIRCULANTE", None, None), ("bancs conta", "PASSIVO", None, "S", None), ("receita", None, None, None, "Credora")], "query string, q_classe string, q_prazo string, q_tipo string, q_hint string").selectExpr("*", "cast(null as string) as q_natureza")
    found = [sorted(matching.match(asked, index).collect(), key=str)]
    monkeypatch.setattr(matching, "foremost", lambda index: index)
    found.append(sorted(matching.match(asked, index).collect(), key=str))
    assert found[0] == found[1] and len(found[0]) == 4
