import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerweave.llm.collocations import collocations, multikey_sort

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, longest=4, covered=80):
    langs = {}
    for lang, text in rows:
        n, f = langs.setdefault(lang or "und", [0, Counter()])
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            langs[lang or "und"][0] += len(w)
            f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, (n, f) in langs.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            if 100 * longer[p] < covered * a:
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, x, y, n, -s) for rank, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(map(str, out))


def run(spark, rows, *args, **more):
    docs = spark.createDataFrame([(i, lang, text, "x", 1) for i, (lang, text) in enumerate(rows)], "id long, lang string, text string, p string, word int")
    return sorted(map(str, map(tuple, collocations(docs, *args, **more).collect())))


def texts(rng, n, vocabulary):
    sep = lambda: rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", "\x0c", "! "])
    return ["".join(rng.choice(vocabulary) + sep() for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("least, top, longest", [(5, 2000, 4), (2, 20, 4), (3, 100, 3)])
def test_against_brute_force(spark, least, top, longest):
    rng = random.Random(least)
    vocabulary = ["the", "The", "of", "of the", "of the cat", "cat", "Été", "été", "日本", "x-y", "\x00", "\u0085", "it's", *"abcdefgh"]
    rows = [(rng.choice(["en", "fr", None, "und"]), t) for t in texts(rng, 150, vocabulary)]
    rows += [("en", None), ("en", ""), (None, None), ("de", "one two"), ("en", "again and again " * 300), ("en", " ".join(rng.choice(vocabulary) for _ in range(3000)))] + [("fr", "a passage that all of them share")] * 9
    rng.shuffle(rows)
    assert run(spark, rows, least, top, longest) == brute(rows, least, top, longest)


def test_one_pair_everywhere(spark):
    """A third of all words is one pair, which goes to routes by all its words."""
    rng = random.Random(9)
    rows = [("en", " ".join(f"hot pair w{rng.randint(0, 30)} w{rng.randint(0, 30)} w{rng.randint(0, 9)}" for _ in range(200))) for _ in range(20)]
    assert run(spark, rows, 4, 50) == brute(rows, 4, 50)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_sort_reports_what_counting_does():
    rng = np.random.default_rng(1)
    for least in (1, 3, 30):
        keys = rng.integers(0, 7, (4000, 4))
        keys[rng.random((4000, 4)) < 0.1] = -1
        for k in range(1, 4):
            keys[keys[:, k - 1] < 0, k] = -1
        keys = keys[(keys[:, 0] >= 0) & (keys[:, 1] >= 0)]
        weight = rng.integers(1, 4, len(keys))
        expected = Counter()
        for row, n in zip(keys.tolist(), weight.tolist(), strict=True):
            for k in range(2, 5):
                if row[k - 1] >= 0:
                    expected[(*row[:k], *[-1] * (4 - k))] += n
        found, count = multikey_sort(keys, weight, least, np.array([1 << 60, 1 << 60, least, least, least]))
        assert Counter(dict(zip(map(tuple, found.tolist()), count.tolist(), strict=True))) == Counter({p: n for p, n in expected.items() if n >= least})
        assert len(found) == len(set(map(tuple, found.tolist())))
