import random
import re

import numpy as np

from ledgerweave.llm.components import components
from ledgerweave.llm import minhash
from ledgerweave.llm.base import Scratch
from ledgerweave.llm.minhash import BANDS, ROWS, minima, near_duplicates, one_of_each
from ledgerweave.llm.words import U, mix


def brute(rows, size):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(comp[find(i)]), d == min(comp[find(i)])) for i, (d, _) in enumerate(rows))


def check(spark, rows, size):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class int")
    assert sorted(map(tuple, near_duplicates(docs, size).collect())) == brute(rows, size)


def test_groups_of_near_copies(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 2, 5, 20])):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 16)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
        base = base[: len(base) // 2]
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "One two"), (906, "one\ttwo"), (907, "É"), (908, "é"), (905, "One two"), (909, "long text " * 40000)]
    check(spark, rows, 2)
    check(spark, rows, 5)


def test_empty_table(spark):
    check(spark, [], 5)


def test_minima_do_not_depend_on_parts():
    h = mix(np.arange(1000, dtype=U))
    at = np.array([0, 3, 500, 501, 1000])
    m = minima(h, at, step=64)
    assert m.shape == (4, BANDS * ROWS) and (m == minima(h, at)).all()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1200)] + [(2000 + i, 2001 + i) for i in range(40)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"), "c")
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in linked)


def test_one_row_of_each_group(spark):
    a, b = "one two three four five six seven", "quite another text of eight words or so"
    rows = [(1, a, "x"), (1, a, "y"), (1, a, "x"), (2, a, "z"), (None, a, "z"), (None, b, "n"), (None, b + " ", "m"), (3, None, "e"), (3, None, "e"), (4, "", "f"), (5, b + " too", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class string")
    got = sorted(map(str, map(tuple, one_of_each(docs, size=5, percent=60).collect())))
    assert got == sorted(map(str, [(1, a, "x"), (5, b + " too", "k"), (3, None, "e"), (3, None, "e"), (4, "", "f")]))
    assert one_of_each(docs.limit(0)).count() == 0


def test_repeated_ids_and_null_ids(spark):
    a, b = "one two three four five six seven", "quite another text of eight words or so"
    rows = [(1, a), (1, b), (2, a), (3, b), (None, a), (None, b + " x"), (None, "only here with no other id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs, 2).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, 1, False), (None, None, True)]))


def large_group(seed, n):
    """Copies of one text: most are linked to it, a fifth lies just below, and some of these have copies of their own."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]

    def edited(words, k):
        words = list(words)
        for _ in range(k):
            at = rng.randrange(len(words))
            how = rng.random()
            words[at : at + 1] = [] if how < 0.2 else [words[at], rng.choice(vocabulary)] if how < 0.4 else [rng.choice(vocabulary)]
        return words

    texts = [base]
    for i in range(n):
        copy = edited(base, rng.randint(8, 14) if i % 5 == 0 else rng.randint(1, 5))
        texts += [copy] + ([edited(copy, rng.randint(1, 6))] if i % 50 == 0 else [])
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_candidates_in_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    counts, confirmed = [], minhash.confirmed

    def counted(pairs, *rest):
        if rest[-1] == "cross":
            counts.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(minhash, "confirmed", counted)
    for n in (150, 450):
        check(spark, large_group(n, n), 2)
    assert counts[1] < 5 * max(counts[0], 300), counts


def test_differences_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "DIRECT", 1)
    test_groups_of_near_copies(spark)
    rows = large_group(7, 100)
    check(spark, rows, 2)
