import hashlib
import random
import re

import numpy as np
import pytest

from ledgerweave.llm.substring_dedup import REACH, high_symbols, inward, least_in, rounds, substring_dedup, window_names, window_symbols
from ledgerweave.llm.words import U, mix


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    rank = [1 << 63 if i is None else i for i, _ in rows]
    least = {}
    for d, w in zip(rank, words, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, d), d)
    out = []
    for (i, _), d, w in zip(rows, rank, words, strict=True):
        gone = set()
        for j in range(len(w) - window + 1):
            if least[tuple(w[j : j + window])] < d:
                gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


def check(spark, rows, window):
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, id int, q int, names int")
    assert sorted(map(str, map(tuple, substring_dedup(docs, window).collect()))) == brute(rows, window)


def texts(rng, n):
    vocabulary = ["w%d" % i for i in range(60)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 120))] for _ in range(5)]
    shared += [["a"] * 80, ["a", "b"] * 40, ["x", "y", "z", "x"] * 25, ["a"] * 30 + ["c"] + ["b"] * 35, ["a", "a", "b"] * 30]
    out = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(0, 4)):
            piece = rng.choice(shared) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
            at = rng.randint(0, max(0, len(piece) // 3))
            text += piece[at : len(piece) - rng.randint(0, len(piece) // 3)]
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("window", [50, 12])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    rows = list(enumerate(texts(rng, 60)))
    rng.shuffle(rows)
    long = " ".join(str(i % 997) for i in range(60000))
    rows += [(900, None), (901, ""), (902, " \n\x85"), (5, rows[5][1]), (5, rows[5][1] + " more"), (None, rows[3][1]), (None, rows[3][1]), (None, rows[7][1] + " end"), (903, long), (904, "\t" + long), (905, "É é " * 40)]
    check(spark, rows, window)


def test_empty_table(spark):
    check(spark, [], 50)


def test_windows_have_the_same_symbols_wherever_they_are():
    """Whatever surrounds a window, its symbol and name are the same; other windows have other names."""
    rng = np.random.default_rng(4)
    for kind in range(4):
        words = mix(rng.integers(0, [40, 2, 3, 5000][kind], 90).astype(U))
        seen = {}
        for _ in range(30):
            before, after = (mix(rng.integers(0, [40, 2, 3, 5000][kind], int(rng.integers(0, 30))).astype(U)) for _ in range(2))
            text = np.concatenate([before, words, after])
            starts, symbol, steps = window_symbols(text, np.array([0, len(text)]), 50)
            w1, w2 = window_names(text, steps, starts, 50)
            for s, x, a, b in zip(starts, symbol, w1, w2, strict=True):
                assert seen.setdefault(text[s : s + 50].tobytes(), (x, a, b)) == (x, a, b)
        names = [v[1:] for v in seen.values()]
        assert len(set(names)) == len(names)


def test_rounds_shorten_and_runs_are_named():
    words = mix(np.array([1] * 40 + [2, 3] * 20 + [1] * 40 + [4], U))
    steps, _ = rounds(words, np.array([0, len(words)]))
    assert len(steps[-1].names) < 12
    assert steps[0].run[39] == 0 and steps[0].run[40] == 1
    low, high = inward(steps[0], np.array([3]), np.array([30]))
    assert low[0] >= high[0]  # all of it is one run, which the window cuts


def test_high_symbols_and_least_in():
    rng = np.random.default_rng(2)
    words, at = mix(rng.integers(0, 9, 300).astype(U)), np.array([0, 120, 120, 125, 300])
    steps, doc = rounds(words, at)
    name, end = high_symbols(steps[-1], doc, len(words))
    starts = np.r_[steps[-1].start, len(words)]
    assert (np.diff(end) >= 0).all()
    for i, (e, d) in enumerate(zip(end, doc, strict=True)):
        stop = int(np.searchsorted(doc, d, "right"))
        if e <= stop:
            assert starts[e] - starts[i] >= REACH > starts[e - 1] - starts[i]
        else:
            assert at[d + 1] - starts[i] < REACH
    low = rng.integers(0, len(name), 200)
    high = np.minimum(low + rng.integers(1, 40, 200), len(name))
    assert (least_in(name, low, high) == [name[a:b].min() for a, b in zip(low, high, strict=True)]).all()
