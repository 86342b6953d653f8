"""Queries on tables whose sums or groups are larger than those of the given ones."""

from pyspark.sql import functions as F

from ledgerweave.plans import registry
from ledgerweave.sources import layout


def test_verdict_is_to_the_cent_at_any_total(spark, tmp_path):
    # 70 too much against 900 million is within a millionth, but not within a cent.
    spark.createDataFrame([(k, k % 3, 9e8) for k in range(20)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    found = {(r.ledger_id, r.period): r.verdict for r in registry.queries()["p21_verdict"](spark, str(tmp_path)).collect()}
    assert found[("L1", 2021)] == "draft" and found[("L1", 2020)] == found[("L3", 2020)] == found[("L3", 2021)] == "caveat"
    assert found[("L0", 2020)] == found[("L2", 2021)] == "ok" and found[("L4", 2020)] == "empty"


def test_verbatim_keeps_every_row(spark, tmp_path):
    spark.range(40).selectExpr("id as o_orderkey", "id % 2 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in registry.queries()["s22_verbatim"](spark, str(tmp_path)).orderBy("file_id").collect()] == [(0, 20, False), (1, 20, False)]


def test_pointed_codes_make_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def code(i: int) -> str:
        made.add(1)
        return {0: "1", 1: "2"}.get(i) or (f"{i % 2 + 1}0{i % 4 + 1}" if i < 12 else f"{i % 2 + 1}0{i % 4 + 1}{i:05}")

    rows = spark.range(200).select(F.lit("a").alias("k"), F.udf(code)("id").alias("codigo")).unionByName(spark.createDataFrame([("b", "1.1"), ("b", None), ("b", "7")], "k string, codigo string"))
    got = {(r.k, r.codigo_original): r.codigo for r in layout.pointed(rows, ["k"]).collect()}
    assert made.value == 200
    assert got[("a", "10100012")] == "1.01.00012" and got[("a", "1")] == "1" and got[("a", "204")] == "2.04"
    assert got[("b", "1.1")] == "1.1" and got[("b", "7")] == "7" and got[("b", None)] is None
