import math

import numpy as np

from ledgerweave.llm.topk import top_k


def brute(rows, queries, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q in queries:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)  # noqa: B905
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, chosen="vec_id % 50 = 0", k=5, kind="float"):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, score int")
    queries = df.filter(chosen)
    got = top_k(df, queries, k, block=16, shard=3, slice_=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, {r.vec_id for r in queries.collect()}, k)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(600)]
    rows += [(1000 + i, rows[50][1]) for i in range(70)]  # one very common vector
    rows += [(None, rows[0][1]), (2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2101, [float("inf")] * 8), (2150, [0.0] * 8), (2151, []), (2200, [1.0, -2.0])]
    check(spark, rows)


def test_few_and_no_rows(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [3.0, -1.0])])
    check(spark, [(0, [1.0])])
    check(spark, [])


def test_large_components_are_exact(spark):
    rows = [(0, [300000.0, -1e6]), (1, [2.0, 0.0]), (2, [2e6, 0.5]), (3, [-5.0, 0.0])]
    check(spark, rows, "true", 2, "double")
    best = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")).collect()}
    assert best == {(0, 1): (1, 39321600000)}


def test_groups_of_similar_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16)) * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=16) * 0.1).tolist()) for i in range(640)]
    check(spark, rows)
