"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the mix is the golden-ratio point frac(k * phi). Cumulative weights
map it to a source; its rank among that source's slots names the block that it
takes: the source's documents, shuffled by a digest of their id, are one long
run of words, cut into blocks of equal length, read again from the start after
the last. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.base import WORD, Scratch

GOLDEN = (math.sqrt(5) - 1) / 2
CELLS = 4096


def running(df: DataFrame, group: Sequence[str], part: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Sum of value over the rows of a group that come before this one.

    part is a bucket number that ascends with the order; sums of whole
    buckets come first, so that no task needs all rows of a group.
    """
    df = df.withColumn("__v", value)
    sums = df.groupBy(*group, part).agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, part, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return df.join(sums, [*group, part]).withColumn(name, F.col("__base") + F.col("__in")).drop("__v", "__in", "__base")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, rank, source_size, n, target for a table of (source, source_size, n), one row per source.

    Sources by code point, null last, take the weights in turn. They share
    share times the total; targets above most times a source's size stop
    there, and the excess is shared by weight among the others. The table has
    a row per source, so one task may order it.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w)
    everything = Window.partitionBy(F.lit(1))
    by_ratio = Window.partitionBy(F.lit(1)).orderBy("ratio", "rank")
    capped = (
        ranked.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w")).withColumn("total", F.sum("source_size").over(everything) * float(share))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank"))).over(everything))
    )
    return capped.select("source", "rank", "source_size", "n", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """The mix in order: slot, rank (of the source), pass, block, words taken from the block's start.

    As many slots as the targets fill are mapped to sources. A source gets no
    more of them than its target asks for; the few blocks that the points,
    by their discrepancy, leave a source short of follow in slots at the end.
    """
    spark = targets.sparkSession
    total = targets.agg(F.sum("target")).first()[0]
    if not total:
        return spark.createDataFrame([], "slot long, rank int, pass long, block long, words long")
    slots = math.ceil(total / block)
    goal = F.round("target").cast("long")
    blocks, need = F.ceil(F.col("source_size") / block), F.floor(F.col("goal") / F.col("source_size")) * F.ceil(F.col("source_size") / block) + F.ceil((F.col("goal") % F.col("source_size")) / block)
    wanted = targets.filter("target > 0 and source_size > 0").withColumn("goal", goal).withColumn("blocks", blocks).withColumn("need", need).select("rank", "target", "source_size", "goal", "blocks", "need")
    run = Window.partitionBy(F.lit(1)).orderBy("rank")
    ranges = wanted.withColumn("high", F.sum("target").over(run) / F.lit(float(total))).withColumn("low", F.coalesce(F.lag("high").over(run), F.lit(0.0)))
    ranges = ranges.withColumn("high", F.when(F.lead("rank").over(run).isNull(), 1.0).otherwise(F.col("high")))
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    point = F.col("slot") * GOLDEN
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * CELLS))
    mapped = points.join(cells, "cell").filter("u >= low and u < high").select("slot", "rank", "need", "source_size", "goal", "blocks", F.floor(F.col("slot") / 8192).alias("part"))
    placed = running(mapped, ["rank"], "part", ["slot"], F.lit(1), "nth").filter("nth < need").drop("part")
    had = mapped.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    short = wanted.join(had, "rank", "left").withColumn("n", F.least(F.coalesce("n", F.lit(0)), "need")).filter("n < need").withColumn("nth", F.explode(F.sequence("n", F.col("need") - 1)))
    late = short.withColumn("slot", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("nth", "rank")) + F.lit(slots - 1).cast("long"))
    placed = placed.unionByName(late.select(*placed.columns)).withColumn("pass", F.floor(F.col("nth") / F.col("blocks"))).withColumn("block", F.col("nth") % F.col("blocks"))
    before = F.col("pass") * F.col("source_size") + F.col("block") * block
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    return placed.withColumn("words", F.least(length, F.col("goal") - before)).select("slot", "rank", F.col("pass").cast("long"), F.col("block").cast("long"), F.col("words").cast("long"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", text_key: str | None = None) -> DataFrame:
    """A row per document: id, size, source_size, target (its source's), taken (words the mix takes), first_slot.

    size counts words; null texts have 0 and are never taken. Null sources
    are one source, the last. No document gives more than most times its
    words. first_slot is the first slot of the mix that takes words of the
    document, null where none does. Repeated rows count as documents of their
    own. A source's documents lie in the order of md5(id), then id, size and
    a hash of the text, so reruns agree; null ids come first, rows alike in
    all of these can stand for each other. Very long texts span many blocks;
    an empty table gives no rows; columns not named are not read. text_key
    names another column, with the hash of the text.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    size = F.expr(f"regexp_count(coalesce(`{text_col}`, ''), r'{WORD}')").cast("long")
    rows = docs.select(F.col(id_col).alias("row"), F.col(source_col).alias("source"), size.alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("digest"), F.xxhash64(text_col).alias("key"))
    rows = scratch.save(rows, "sizes")
    targets = scratch.save(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, most), "targets")
    parts = max(1, math.ceil((targets.agg(F.max("n")).first()[0] or 0) / 1000))
    part = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * parts / 2**32)
    placed = rows.withColumn("part", part).join(targets.select(F.col("source").alias("s"), "rank", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    keep = ["row", "key", "size", "source_size", "target"]
    full = running(placed.filter("size > 0").select(*keep, "digest", "part", "rank"), ["rank"], "part", ["digest", "row", "size", "key"], F.col("size"), "start")
    taken = schedule(targets, block).groupBy("rank", "block").agg(F.collect_list(F.struct("slot", "words")).alias("uses"))
    spans = full.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    joined = spans.join(taken, ["rank", "block"], "left").withColumn("low", low).withColumn("high", high).withColumn("uses", F.expr("filter(coalesce(uses, array()), x -> least(high, x.words) > low)"))
    joined = joined.withColumn("part_taken", F.expr("aggregate(uses, 0L, (a, x) -> a + least(high, x.words) - low)")).withColumn("slot", F.expr("array_min(transform(uses, x -> x.slot))"))
    found = joined.groupBy("rank", "start", *keep).agg(F.sum("part_taken").alias("taken"), F.min("slot").alias("first_slot"))
    none = placed.filter("size = 0").select(*keep, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    out = found.select(*none.columns).unionByName(none)
    return out.select(F.col("row").alias(id_col), "size", "source_size", "target", "taken", "first_slot", *([F.col("key").alias(text_key)] if text_key else []))
