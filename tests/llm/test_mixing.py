import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerweave.llm.mixing import mix_sources, schedule, source_targets


def by_rounds(sizes, weights, share=1.5, most=2.0):
    """Share, cap, share the excess again, until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, fixed, left = set(names), {}, share * sum(sizes.values())
    while True:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s] + 1e-9}
        if not over:
            return fixed | {s: level * w[s] for s in open_}
        fixed |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, taken int")


def test_targets_and_takings(spark):
    rows = [(i, "w " * (i % 50), ["a", "b", "c", None, "d"][i * i % 5]) for i in range(400)] + [(900, None, "a"), (901, "", "z"), (901, "", "z"), (None, "x y", "b"), (902, "long " * 3000, "c")]
    got = mix_sources(docs_of(spark, rows), block=64).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = by_rounds(sizes, (5, 2, 1))
    of = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = of[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    again = mix_sources(docs_of(spark, rows[::-1]), block=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_is_even(spark):
    sizes = spark.createDataFrame([("a", 50000, 1), ("b", 50000, 1), ("c", 50000, 1)], "source string, source_size long, n long")
    targets = source_targets(sizes, (5, 2, 1), 1.0, 2.0)
    slots = schedule(targets, 100).orderBy("slot").collect()
    assert sum(s.words for s in slots) == pytest.approx(150000, abs=2)
    first = [s.rank for s in slots[:300]]
    assert abs(first.count(1) - 300 * 5 / 8) < 8


def test_nothing_to_mix(spark):
    assert mix_sources(docs_of(spark, [])).count() == 0
    assert [r.taken for r in mix_sources(docs_of(spark, [(1, None, None), (2, " ", "a")])).collect()] == [0, 0]


def test_reruns_agree_with_repeated_ids(spark):
    rows = [(i % 7, f"w{i} " * (i % 13), "ab"[i % 2]) for i in range(120)] + [(None, "x y z", "a"), (None, "x y", "a")]
    results = {str(sorted(map(str, mix_sources(docs_of(spark, order), block=8, text_key="key").collect()))) for order in (rows, rows[::-1], sorted(rows, key=str))}
    assert len(results) == 1


def test_a_tiny_source_beside_a_large_one(spark):
    sizes = spark.createDataFrame([("large", 200_000_000, 1), ("tiny", 10, 1)], "source string, source_size long, n long")
    slots = schedule(source_targets(sizes, (5, 2, 1), 1.5, 2.0), 1024)
    got = {r["rank"]: (r.n, r.w) for r in slots.groupBy("rank").agg(F.count("slot").alias("n"), F.sum("words").alias("w")).collect()}
    assert got[2][1] == 20 and got[1][1] == 300_000_010 - 25 + 0 or abs(got[1][1] - 300_000_000) <= 20
    assert got[1][0] + got[2][0] < 300_000_000 / 1024 + 5
    assert slots.agg(F.count_distinct("slot") == F.count("slot")).first()[0]


def test_first_slots_follow_the_schedule(spark):
    rows = [(i, "w " * 100, "abc"[i % 3]) for i in range(90)]
    docs = docs_of(spark, rows)
    got = mix_sources(docs, block=50).collect()
    at = {(s.rank, s.block): s.slot for s in reversed(schedule(source_targets(spark.createDataFrame([(x, 3000, 30) for x in "abc"], "source string, source_size long, n long"), (5, 2, 1), 1.5, 2.0), 50).orderBy("slot").collect())}
    order = sorted(range(90), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    start = {}
    for i in order:
        start[i] = sum(1 for j in start if j % 3 == i % 3) * 2
    for r in got:
        slots = [at[(r.doc_id % 3 + 1, start[r.doc_id] + k)] for k in (0, 1) if (r.doc_id % 3 + 1, start[r.doc_id] + k) in at]
        assert r.first_slot == (min(slots) if slots else None)
