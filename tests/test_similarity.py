import random

import numpy as np

from ledgerweave.functions.similarity import Block, Index, Matrix, pair_ratios

WORDS = ["caixa", "bancos", "conta", "a", "é", "a-b", "movimento", "clientes", "ccc", "ação", "日本", "x" * 70]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return 100.0 * 2 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def sort_ratio(a, b):
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(ratio(one, two), ratio(both, one), ratio(both, two)) if both else ratio(one, two)


def some(rng, n):
    return list(dict.fromkeys(" ".join(rng.choice(WORDS)[: rng.randint(1, 70)] for _ in range(rng.randint(0, 6))) for _ in range(n)))


def test_common_lengths():
    rng = random.Random(1)
    rows = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 150))) for _ in range(60)]
    for n in (0, 1, 63, 64, 65, 128, 140):
        text = "".join(rng.choice("abcdez ") for _ in range(n))
        assert Matrix(rows).common(text).tolist() == [common(text, r) for r in rows]


def test_ratios_of_blocks_and_pairs():
    rng = random.Random(2)
    texts, queries = some(rng, 80) + ["", "caixa caixa"], some(rng, 25) + ["", "caixa", "caixa caixa conta"]
    block = Block(texts)
    for q in queries:
        assert np.allclose(block.set_ratios(q), [set_ratio(q, t) for t in texts], rtol=0, atol=1e-12)
        assert np.allclose(block.sort_ratios(q), [sort_ratio(q, t) for t in texts], rtol=0, atol=1e-12)
    a, b = [rng.choice(queries) for _ in range(200)], [rng.choice(texts) for _ in range(200)]
    assert pair_ratios(a, b, "set_ratio").tolist() == [set_ratio(x, y) for x, y in zip(a, b, strict=True)]
    assert pair_ratios(a, b, "sort_ratio").tolist() == [sort_ratio(x, y) for x, y in zip(a, b, strict=True)]


def test_best_of_an_index_are_those_of_all_pairs():
    rng = random.Random(3)
    texts = some(rng, 400) + [""]
    texts = list(dict.fromkeys(texts))
    for by, rate in (("set_ratio", set_ratio), ("sort_ratio", sort_ratio)):
        index = Index(texts, by, rows=16)
        for q in [*some(rng, 15), "", "zzz", "caixa", "ção çaã"]:
            for k in (1, 10, 1000):
                assert index.best(q, k) == [(t, -s) for s, t in sorted((-rate(q, t), t) for t in texts)[:k]]


def test_most_pairs_are_left_out():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 40))) for _ in range(4000)]
    index = Index(texts, "set_ratio")
    for t in texts[:20]:
        index.best(t[:-1], 5)
    assert index.scored < 0.5 * index.asked


def test_no_texts():
    assert Index([], "set_ratio").best("a", 3) == [] and pair_ratios([], [], "set_ratio").tolist() == []
