import hashlib
import re

from ledgerweave.llm.exact_dedup import exact_dedup


def brute(rows):
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((i, t or ""))
    out = []
    for key, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0]))[0]
        out += [(i, best, len(members), i == best, hashlib.sha256(key.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, __gid string")
    assert sorted(map(tuple, exact_dedup(docs).collect()), key=str) == brute(rows)


def test_groups(spark):
    long = "abcd " * 5000
    check(spark, [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (7, long), (8, long + "x"), (9, long + "y"), (10, long.replace(" ", "")), (11, "é"), (12, "e"), (2, "ab"), (None, "q"), (None, "a  b")])


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_same_start_and_length(spark):
    check(spark, [(i, "p" * 70 + f"{i % 7}" + "s" * 1500 + f"{i % 3}") for i in range(60)])
