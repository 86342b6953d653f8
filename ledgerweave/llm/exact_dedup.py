"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by their length and leading bytes, then each group that
still has two members by the next bytes, until a group is a singleton or its
texts have ended. Members of an ended group agree in every byte, so no digest
takes part in equality. Digits grow from round to round, so the number of
rounds grows with the logarithm of the longest text that has a twin so far.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.base import SPACE, Scratch


def radix_groups(rows: DataFrame, key: str, scratch: Scratch, first: int = 64, factor: int = 16) -> DataFrame:
    """rows without the binary column key, plus __round and __gid: the same for rows whose keys are equal, null __gid for a row whose key no other row has.

    key must not be null. Every round reads only rows that are not settled,
    and carries only the bytes that no round has compared.
    """
    others = [c for c in rows.columns if c != key]
    state = rows.select(*others, F.col(key).alias("__rest"), F.octet_length(key).cast("long").alias("__gid"))
    tables, pos = [], first
    while True:
        n, width = len(tables), first * factor ** len(tables)
        dealt = state.withColumn("__digit", F.expr(f"substring(__rest, 1, {width})"))
        groups = dealt.groupBy("__gid", "__digit").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
        named = scratch.save(groups.select("__gid", "__digit", F.monotonically_increasing_id().alias("__next")), f"groups{n}")
        # Sort-merge at every size: it spills, and splits the partitions of very large groups.
        joined = dealt.join(named.hint("merge"), ["__gid", "__digit"], "left")
        rest = F.when(F.col("__next").isNotNull() & (F.octet_length("__rest") > width), F.expr(f"substring(__rest, {width + 1})"))
        table = scratch.save(joined.select(*others, rest.alias("__rest"), F.col("__next").alias("__gid")), f"state{n}")
        tables.append(table.filter("__rest is null").select(*others, F.lit(n).alias("__round"), "__gid"))
        state = table.filter("__rest is not null")
        pos += width
        if state.isEmpty():
            return reduce(DataFrame.unionByName, tables)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after deleting ASCII white space; null
    counts as empty, so empty, blank and null texts form one group. Of a
    group the longest original text (code points) stays, then the smallest
    id; null ids come last. Rows that repeat the id that stays are all marked
    kept. Very long texts are read whole, by their digits; an empty table
    gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.regexp_replace(text, f"{SPACE}+", "")
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("points"), F.sha2(bare, 256).alias("sha"), bare.cast("binary").alias("__key"))
    found = radix_groups(rows, "__key", scratch)
    order = F.struct("points", -F.col("id").cast("decimal(38,0)"))
    best = found.filter("__gid is not null").groupBy("__round", "__gid").agg(F.max_by("id", order).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    twins = found.filter("__gid is not null").join(best.hint("merge"), ["__round", "__gid"])
    alone = found.filter("__gid is null").withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("long")})
    out = ["id", "keep_id", "group_size", "sha"]
    return twins.select(*out).unionByName(alone.select(*out)).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )
