"""Tables for delivery and audit, written by ledger and period."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerweave.functions import codes
from ledgerweave.operators.chart import parent_of
from ledgerweave.operators.tree import KEY, money
from ledgerweave.sources.stage import saved


def write_audit(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table each, partitioned by KEY and sorted inside."""
    for name, df in tables.items():
        df.repartition(*KEY).sortWithinPartitions(*KEY).write.mode("overwrite").partitionBy(*KEY).parquet(f"{path}/{name}")


def observed(df: DataFrame, path: str, **metrics: Column) -> dict:
    """Write df as Parquet; its rows, the metrics and the seconds it took, all from the one pass that writes."""
    seen = Observation(path)
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in metrics.items()])
    start = time.perf_counter()
    watched.write.mode("overwrite").parquet(path)
    return {**seen.get, "seconds": time.perf_counter() - start}


def run_report(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write the tables below path; name, rows, seconds of each."""
    spark = next(iter(tables.values())).sparkSession
    told = [(name, *(observed(df, f"{path}/{name}")[k] for k in ("rows", "seconds"))) for name, df in tables.items()]
    return spark.createDataFrame(told, "name string, rows long, seconds double")


def parse_report(rows: DataFrame, rejected: DataFrame, catalogue: DataFrame, seconds: float | None = None) -> DataFrame:
    """Every column of the catalogue (file_id, name, length, modified, sha256), rows, errors, success, seconds (of the run) for each of its files."""
    count = lambda df, c: df.groupBy("file_id").agg(F.count(F.lit(1)).alias(c))
    out = catalogue.join(count(rows, "rows"), "file_id", "left").join(count(rejected, "errors"), "file_id", "left").fillna(0, ["rows", "errors"])
    return out.withColumn("success", F.col("rows") > 0).withColumn("seconds", F.lit(seconds).cast("double"))


def with_source(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """rows (file_id) with source, source_length and source_modified: the name, size and time of the file that they are from."""
    return rows.join(catalogue.select("file_id", F.col("name").alias("source"), F.col("length").alias("source_length"), F.col("modified").alias("source_modified")), "file_id", "left")


#: Parts of an audit, in the order in which a row is judged.
AUDIT = ["compensation", "treated", "unidentified"]


def audited(rows: DataFrame, bank: bool = False) -> DataFrame:
    """rows (KEY, codigo, alvo, motivo) with part: compensation (of a bank's plan), treated (with a destination), else unidentified, where motivo says why."""
    off = codes.is_off_balance(F.col("codigo")) if bank else F.lit(False)
    part = F.when(off, AUDIT[0]).when(F.col("alvo").isNotNull(), AUDIT[1]).otherwise(AUDIT[2])
    return rows.withColumn("part", part).withColumn("motivo", F.when(F.col("part") == AUDIT[2], F.coalesce("motivo", F.lit("no reliable match in the chart"))))


def write_audit_parts(rows: DataFrame, path: str, bank: bool = False) -> DataFrame:
    """Write the audited rows once, a folder each for part and KEY; the summary (KEY, part, n, total) is read from what was written."""
    audited(rows, bank).repartition("part", *KEY).sortWithinPartitions("codigo").write.mode("overwrite").partitionBy("part", *KEY).parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(audited(rows, bank).schema).parquet(f"{path}/rows")
    summary = written.groupBy(*KEY, "part").agg(F.count(F.lit(1)).alias("n"), money(F.sum("valor")).alias("total"))
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    return rows.sparkSession.read.schema(summary.schema).parquet(f"{path}/summary")


def accounts_table(matched: DataFrame, rollup: DataFrame) -> DataFrame:
    """Each row with its code's rollup joined back."""
    return matched.join(rollup.select(*KEY, "codigo", "saldo_calculado", "diff", "ok"), [*KEY, "codigo"], "left")


def nested_tree(nodes: DataFrame, key: list[str], fields: list[str], save_each: int = 8) -> DataFrame:
    """key, tree: for each key the JSON array of its roots, nodes within nodes as children, sorted by code.

    nodes: key, codigo, parent (null or a code that isn't there makes a root)
    and the fields that a node shows. The fold goes up from the deepest level;
    each round joins finished children to their parents only. A circle of
    parents has no root and is left out. A key's tree is one value.
    """
    order = codes.sort_key(F.col("codigo"))
    shown = F.to_json(F.struct("codigo", *fields), {"ignoreNullFields": "false"})
    own = saved(nodes.select(*key, "codigo", "parent", order.alias("order"), shown.alias("own")), "nested")
    there = own.select(*key, F.col("codigo").alias("parent"), F.lit(True).alias("has"))
    level = own.join(there, [*key, "parent"], "left").filter("has IS NULL").select(*key, "codigo", F.lit(None).cast("string").alias("parent"), "order", "own")
    levels = []
    while True:
        level = saved(level, "level")
        if level.isEmpty():
            break
        levels.append(level)
        above = level.select(*key, F.col("codigo").alias("parent"))
        level = own.join(above, [*key, "parent"]).select(*key, "codigo", "parent", "order", "own")
    done = None
    for i, level in enumerate(reversed(levels)):
        if done is None:
            children = level.select(*key, "codigo", F.lit("").alias("children"))
        else:
            sorted_ = F.array_sort(F.collect_list(F.struct("order", "codigo", "text")))
            children = done.groupBy(*key, F.col("parent").alias("codigo")).agg(F.array_join(F.transform(sorted_, lambda x: x["text"]), ",").alias("children"))
        text = F.concat(F.expr("substring(own, 1, length(own) - 1)"), F.lit(',"children":['), F.coalesce("children", F.lit("")), F.lit("]}"))
        done = level.join(children, [*key, "codigo"], "left").select(*key, "codigo", "parent", "order", text.alias("text"))
        if i % save_each == save_each - 1:
            done = saved(done, "folded")
    if done is None:
        return own.select(*key, F.lit("").alias("tree"))
    roots = F.array_sort(F.collect_list(F.struct("order", "codigo", "text")))
    return done.groupBy(*key).agg(F.concat(F.lit("["), F.array_join(F.transform(roots, lambda x: x["text"]), ","), F.lit("]")).alias("tree"))


#: Fields of an account in an exported chart.
CHART_FIELDS = ["descricao", "tipo", "natureza", "nivel", "parent_id", "forms"]


def chart_export(chart: DataFrame) -> dict[str, DataFrame]:
    """A chart (codigo, CHART_FIELDS) as its four tables: forms (form, codigos), contas_flat, contas_tree (one JSON value), contas_index (codigo, conta).

    A parent that isn't there gives way to the nearest one above it that is.
    """
    ways = chart.select("codigo", F.col("parent_id").alias("at"), F.lit(0).alias("step")).filter("at is not null")
    known = chart.select(F.col("codigo").alias("at"), F.lit(True).alias("has"))
    found = None
    while not (ways := saved(ways, "ways")).isEmpty():
        met = ways.join(known, "at", "left")
        here = met.filter("has").select("codigo", F.col("at").alias("parent"))
        found = here if found is None else found.unionByName(here)
        ways = met.filter("has IS NULL").select("codigo", parent_of(F.col("at")).alias("at"), (F.col("step") + 1).alias("step")).filter("at is not null and at <> ''")
    tied = chart.withColumn("parent", F.lit(None).cast("string")) if found is None else chart.join(found, "codigo", "left")
    tied = tied.withColumn("parent_id", F.coalesce("parent", "parent_id"))
    account = F.struct("codigo", *CHART_FIELDS)
    forms = chart.select(F.explode("forms").alias("form"), "codigo").groupBy("form").agg(F.array_sort(F.collect_set("codigo")).alias("codigos"))
    return {"forms": forms, "contas_flat": tied.select("codigo", *CHART_FIELDS), "contas_tree": nested_tree(tied, [], CHART_FIELDS), "contas_index": tied.select("codigo", F.to_json(account, {"ignoreNullFields": "false"}).alias("conta"))}


def write_chart(chart: DataFrame, path: str) -> None:
    """The four tables of chart_export, as JSON lines."""
    for name, df in chart_export(chart).items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def training_report(variations: DataFrame, n: int = 20) -> DataFrame:
    """The n codes with most accepted matches."""
    return variations.orderBy(F.col("frequency").desc(), "codigo").limit(n).select("codigo", "frequency", F.size("variations").alias("variations"))


def decision_lines(decisions: DataFrame) -> DataFrame:
    """key, line: decisions (key, codigo, manual) as rows of a Markdown table."""
    return decisions.select("key", F.concat(F.lit("| "), F.concat_ws(" | ", "key", "codigo", F.when(F.col("manual"), "manual").otherwise("auto")), F.lit(" |")).alias("line"))


def export_decisions(decisions: DataFrame, path: str) -> None:
    """Decisions for review, as JSON lines in the order of their keys."""
    decisions.orderBy("key").write.mode("overwrite").json(path)
