import math
import random
import re
from collections import Counter

import pytest

from ledgerweave.llm.lexical_search import lexical_search, scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in held if c)
    n_terms = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, []).extend(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in wanted if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(map(str, out))


def run(spark, docs, items, k=5, **more):
    documents = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, id string, terms int")
    asked = spark.createDataFrame([(i, t, 2, 3) for i, t in items], "item_id long, text string, item int, score int")
    return sorted(map(str, map(tuple, lexical_search(documents, asked, k, **more).collect())))


@pytest.mark.parametrize("slice_bytes", [4 << 20, 60])
def test_against_brute_force(spark, slice_bytes):
    rng = random.Random(1)
    vocabulary = ["the", "of", "a", "Été", "ÉTÉ", "x1", "x", "1x", "straße", "日本", "_", "It", "it's", "e-mail", "\x7f", "\u0085"]
    text = lambda n: rng.choice([" ", "  ", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randint(0, 30))) for i in range(80)] + [(200, None), (201, ""), (202, " .\n"), (None, "x1 it"), (None, "x1 it"), (5, "the of x1"), (5, "the of x1"), (203, text(50000)), (204, "thethe theof"), (205, "it")]
    rng.shuffle(docs)
    items = [(i, text(rng.randint(1, 6))) for i in range(12)] + [(50, None), (51, "unheard"), (None, "x1 x1 it"), (60, "the"), (60, "the"), (60, "the x"), (61, "")]
    assert run(spark, docs, items, slice_bytes=slice_bytes) == brute(docs, items, 5)


def test_equal_scores_go_by_id(spark):
    docs = [(i, "same words") for i in range(30, 0, -1)] + [(99, "other")] * 40
    assert run(spark, docs, [(1, "words")], 7) == brute(docs, [(1, "words")], 7)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [], []) == []


def test_ids_that_are_strings(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "two"), (3, "three"), (4, "four")], "doc_id int, text string")
    items = spark.createDataFrame([("a", "two")], "item_id string, text string")
    assert [(r.item_id, r.rank, r.doc_id) for r in lexical_search(docs, items).orderBy("rank").collect()] == [("a", 1, 2), ("a", 2, 1)]


def test_terms_are_found_between_borders_only():
    sizes, doc, term, count = scan([b"ab a-ab abab AB", b"", b"b"], (b"ab", b"b"))
    assert sizes.tolist() == [5, 0, 1]
    assert list(zip(doc.tolist(), term.tolist(), count.tolist(), strict=True)) == [(0, 0, 3), (2, 1, 1)]
