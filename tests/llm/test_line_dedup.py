import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerweave.llm.base import Scratch
from ledgerweave.llm.line_dedup import edit_distance, line_report, probes, similar_lines


def distance(a, b):
    row = list(range(len(a) + 1))
    for y in b:
        last, row[0] = row[0], row[0] + 1
        for i, x in enumerate(a):
            last, row[i + 1] = row[i + 1], min(last + (x != y), row[i] + 1, row[i + 1] + 1)
    return row[-1]


def brute(rows, t, least):
    blank = lambda s: not re.search(r"[^\x20\x09-\x0D]", s)
    order = sorted({(1 << 63 if i is None else i, n, x) for i, text in rows if text is not None for n, x in enumerate(text.split("\n")) if not blank(x)})
    lines = list(dict.fromkeys(x for _, _, x in order))
    root = {x: x for x in lines}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, x in enumerate(lines):
        for y in lines[:i]:
            if min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= t and distance(x, y) <= t:
                root[find(x)] = find(y)
    first = {}
    for i, n, x in order:
        first.setdefault(find(x), (i, n))
    out = []
    for i, text in rows:
        parts = [] if text is None else text.split("\n")
        kept = [x for n, x in enumerate(parts) if blank(x) or first[find(x)] == (1 << 63 if i is None else i, n)]
        out.append((i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("t", [1, 2, 3])
def test_edit_distance(spark, t):
    rng = random.Random(t)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("kitten", "sitting"), ("é😀", "e😀")]
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 30)))
        b = list(a)
        for _ in range(rng.randint(0, t + 1)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        pairs.append((a, "".join(b)))
    chars = lambda c: F.when(F.col(c) == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(c, ""))
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"ca": chars("a"), "cb": chars("b")})
    for r in df.select("a", "b", edit_distance("ca", "cb", t).alias("d")).collect():
        n = distance(r.a, r.b)
        assert r.d == (n if n <= t else None), (r.a, r.b)


def test_number_of_probes():
    assert [sum(d == i for d, _, _ in probes(2)) for i in range(3)] == [5, 4, 3]


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde é") for _ in range(rng.randint(8, 60))) for _ in range(60)]

    def line():
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randint(0, len(x))
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "z"])
        return "".join(x)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (5, rows[5][1]), (None, base[0] + "\n" + "only here, and long enough"), (203, "short\nshort\nshorT"), (204, "x" * 900), (205, "x" * 899)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, id int, line int")
    got = line_report(docs).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 2, 20)
    assert line_report(docs.limit(0)).count() == 0


def test_all_lines_alike(spark):
    """With least 0, short lines are linked within the threshold, too."""
    rows = [(1, "a\nab\nxyz\nq"), (2, "abcdefgh\nabcdxxgh\nabcdxxyh"), (3, "\nabcdefghi\nabcdefgh"), (4, "hello there\nhxllo thxre\nhelo ther\nanother one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_report(docs, least=0).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 2, 0)


def test_large_groups_make_few_pairs(spark, tmp_path):
    """Of many lines that share a segment and are not near, no pairs come out of the joins; all links of those that are near are found."""
    rng = random.Random(9)
    head = "the same beginning of all these lines, so that they share a segment of it "
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    tails = [" ".join(word() for _ in range(9)) for _ in range(150)]
    rows = [(i, head + x) for i, x in enumerate(tails)] + [(200 + i, head + x[:40] + "#" + x[41:]) for i, x in enumerate(tails[:30])]
    lines = spark.createDataFrame([(i, x, len(x)) for i, x in rows], "lid long, line string, length int")
    scratch = Scratch(spark, "pairs")
    _, links = similar_lines(lines, 2, scratch)
    assert sorted((r.a, r.b) for r in links.collect()) == [(i, 200 + i) for i in range(30)]
    assert spark.read.parquet(f"{scratch.at}/stars").count() < 200
