"""Incremental learning: new inputs only, and a dictionary that is a commutative merge of what was accepted.

State is an append-only log of matches by batch, from which variations are
counted anew; a batch that is written twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_inputs(inputs: DataFrame, seen: DataFrame, key: str = "file_id") -> DataFrame:
    return inputs.join(seen.select(key).distinct(), key, "left_anti")


def variations(matches: DataFrame) -> DataFrame:
    """codigo, variations (sorted texts), frequency of accepted matches (codigo, text)."""
    return matches.groupBy("codigo").agg(F.array_sort(F.collect_set("text")).alias("variations"), F.count(F.lit(1)).alias("frequency"))


def merged_variations(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.unionByName(new)
    return both.groupBy("codigo").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("variations")))).alias("variations"), F.sum("frequency").alias("frequency"))


def input_metrics(rows: DataFrame, by: str) -> DataFrame:
    """by, total, synthetic, filtered, attempted, matched, review of rows (synthetic, garbage, accepted)."""
    tried = F.col("synthetic") & ~F.col("garbage")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if("synthetic").alias("synthetic"), F.count_if(F.col("synthetic") & F.col("garbage")).alias("filtered"), F.count_if(tried).alias("attempted"), F.count_if(tried & F.col("accepted")).alias("matched"), F.count_if(tried & ~F.col("accepted")).alias("review"))


def match_rate(metrics: DataFrame) -> DataFrame:
    """One row: attempted, matched, rate (matched of attempted)."""
    return metrics.agg(F.sum("attempted").alias("attempted"), F.sum("matched").alias("matched")).withColumn("rate", F.round(F.coalesce(F.try_divide("matched", "attempted"), F.lit(0.0)), 6))


def checked_mappings(curated: DataFrame, chart: DataFrame) -> DataFrame:
    """curated (text, classe, codigo) with reason: unknown code, class clash, or NULL if it may be used."""
    known = chart.select("codigo", F.col("classe").alias("chart_class"))
    return curated.join(known, "codigo", "left").withColumn("reason", F.when(F.col("chart_class").isNull(), "unknown code").when(F.col("chart_class") != F.col("classe"), "class clash")).drop("chart_class")


def learn_stream(inputs: DataFrame, match: Callable[[DataFrame], DataFrame], log_path: str, checkpoint: str) -> StreamingQuery:
    """Match each micro-batch of a file stream and log what was accepted (codigo, text) under the batch's number."""

    def step(batch: DataFrame, number: int) -> None:
        match(batch).select("codigo", "text").write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    return inputs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ignored(old: DataFrame, new: DataFrame) -> DataFrame:
    """The list of texts to leave out, each once."""
    return old.unionByName(new).distinct()


def review_items(matches: DataFrame, ignore: DataFrame) -> DataFrame:
    """file_id, text of what was not accepted and is not to be ignored, each once a file."""
    return matches.filter(~F.col("accepted")).select("file_id", "text").distinct().join(ignore.select("text"), "text", "left_anti").select("file_id", "text")


def manual_decisions(reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, variations) from reviewed rows (key, text, codigo, ts)."""
    return reviewed.select("key", "codigo", F.lit(True).alias("manual"), "ts"), variations(reviewed)


def dictionary_summary(learned: DataFrame) -> DataFrame:
    return learned.agg(F.count(F.lit(1)).alias("codes"), F.sum(F.size("variations")).alias("variations"), F.sum("frequency").alias("frequency"))


def sessions(metrics: DataFrame, part: Column | None = None) -> DataFrame:
    """metrics (session, ts, attempted, matched) with running totals and rate.

    part, the day of ts if not given, grows with ts. Totals of whole parts run
    over a row each, then over the sessions of a part, so that no task orders
    all sessions.
    """
    part = F.to_date("ts") if part is None else part
    both = ["attempted", "matched"]
    days = metrics.withColumn("__day", part)
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    base = days.groupBy("__day").agg(*[F.sum(c).alias(f"__{c}") for c in both]).select("__day", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in both])
    run = Window.partitionBy("__day").orderBy("ts", "session").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = base.withColumnRenamed("__day", "__of")
    out = days.join(base, F.col("__day").eqNullSafe(F.col("__of"))).withColumns({f"all_{c}": F.sum(c).over(run) + F.col(f"__{c}") for c in both}).drop("__day", "__of", *[f"__{c}" for c in both])
    return out.withColumn("rate", F.round(F.coalesce(F.try_divide("all_matched", "all_attempted"), F.lit(0.0)), 6))


def top_codes(learned: DataFrame, n: int = 15) -> DataFrame:
    """The n codes with the highest frequency, for a summary."""
    return learned.orderBy(F.col("frequency").desc(), "codigo").limit(n).select("codigo", "frequency")


def applied_mappings(checked: DataFrame) -> DataFrame:
    """key, codigo of checked mappings (text, classe, codigo, reason) that may be used, as decisions by hand."""
    return checked.filter("reason is null").select(F.concat_ws("|", "text", "classe").alias("key"), "codigo", F.lit(True).alias("manual")).distinct()


def reset(state: DataFrame, path: str) -> None:
    """Overwrite a state table by an empty one."""
    state.limit(0).write.mode("overwrite").parquet(path)
