"""What goes into a delivery, what is left for review, and checks of what was delivered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import codes, text
from ledgerweave.operators import projection, tree
from ledgerweave.operators.tree import KEY, money
from ledgerweave.sources.stage import saved


def selection(rows: DataFrame, mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(emitted, uncovered): KEY, codigo; by the cut of the tree where a ledger has one, else every mapped code and every other."""
    nodes = saved(tree.nodes(tree.in_tree(rows)), "nodes")
    treed = saved(tree.ancestors(nodes).select(*KEY).distinct(), "treed")
    emitted, uncovered = tree.tree_cut(nodes.join(treed, KEY, "left_semi"), mapped)
    flat, known = rows.join(treed, KEY, "left_anti").filter("codigo is not null").select(*KEY, "codigo").distinct(), mapped.select(*KEY, "codigo").distinct()
    return emitted.unionByName(flat.join(known, [*KEY, "codigo"], "left_semi")), uncovered.unionByName(flat.join(known, [*KEY, "codigo"], "left_anti"))


def analytical_levels(nodes: DataFrame, more_than: int = 5) -> DataFrame:
    """KEY, level: the deepest with more than so many codes of which none has codes below it."""
    inner = tree.ancestors(nodes).select(*KEY, F.col("ancestor").alias("codigo")).distinct().withColumn("inner", F.lit(1))
    levels = nodes.join(inner, [*KEY, "codigo"], "left").groupBy(*KEY, codes.level(F.col("codigo")).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count("inner").alias("inner"))
    return levels.filter((F.col("n") > more_than) & (F.col("inner") == 0)).groupBy(*KEY).agg(F.max("level").alias("level"))


def analytical(nodes: DataFrame, described: DataFrame) -> DataFrame:
    """KEY, codigo, analytical for nodes and descriptions (KEY, codigo, descricao): without codes below, and on the analytical level, detailed by description or of more than six segments."""
    inner = tree.ancestors(nodes).select(*KEY, F.col("ancestor").alias("codigo")).distinct().withColumn("inner", F.lit(True))
    joined = nodes.select(*KEY, "codigo").join(described, [*KEY, "codigo"], "left").join(inner, [*KEY, "codigo"], "left").join(analytical_levels(nodes), KEY, "left")
    depth = codes.level(F.col("codigo"))
    detailed = F.coalesce(depth >= F.col("level"), F.lit(False)) | text.is_analytical_detail(F.col("descricao")) | (depth > 6)
    return joined.select(*KEY, "codigo", (F.col("inner").isNull() & detailed).alias("analytical"))


def skip_reason(descricao: Column) -> Column:
    """empty or garbage, else null."""
    return F.when(F.coalesce(descricao, F.lit("")) == "", "empty").when(text.is_garbage(descricao), "garbage")


def skipped(rows: DataFrame, ignored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): rows to match, and KEY, reason, n of those that are not: empty, garbage or with an ignored description (texto, in normal form)."""
    known = ignored.select(F.col("texto").alias("__t")).distinct().withColumn("__ignored", F.lit(True))
    judged = rows.withColumn("__t", text.normalized(F.col("descricao"))).join(known, "__t", "left")
    judged = judged.withColumn("__reason", F.coalesce(skip_reason(F.col("descricao")), F.when(F.col("__ignored"), "ignored"))).drop("__t", "__ignored")
    return judged.filter("__reason is null").drop("__reason"), judged.filter("__reason is not null").groupBy(*KEY, F.col("__reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def review_queue(matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue, counts): rows (needs_review, synthetic) that a person has to see, and KEY, waiting, detail (left out as analytical)."""
    counts = matched.groupBy(*KEY).agg(F.count_if(F.col("needs_review") & F.col("synthetic")).alias("waiting"), F.count_if(F.col("needs_review") & ~F.col("synthetic")).alias("detail"))
    return matched.filter("needs_review and synthetic"), counts


def delivery_warnings(facts: DataFrame, ledgers: DataFrame) -> DataFrame:
    """KEY, warning, n for each ledger (KEY) and its facts (KEY, alvo, valor): nothing written, codes that are none, values that are no numbers."""
    bad = {"no rows": F.when(F.count("alvo") + F.count("valor") == 0, 1).otherwise(0), "code format": F.count_if(F.col("present") & ~codes.is_hierarchical(F.col("alvo"))), "not numeric": F.count_if(F.col("present") & F.col("valor").isNull())}
    counted = ledgers.select(*KEY).distinct().join(facts.withColumn("present", F.lit(True)), KEY, "left").withColumn("present", F.coalesce("present", F.lit(False))).groupBy(*KEY).agg(*[v.cast("long").alias(k) for k, v in bad.items()])
    return counted.unpivot(KEY, list(bad), "warning", "n").filter("n > 0")


def match_rates(matched: DataFrame) -> DataFrame:
    """KEY, rate: matched of all rows."""
    return matched.groupBy(*KEY).agg(F.round(F.avg(F.col("alvo").isNotNull().cast("int")), 6).alias("rate"))


def bank_facts(rows: DataFrame, rules: DataFrame, equity: str = projection.EQUITY_CODE, least: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """(facts, uncovered) of a bank's ledgers by rules (rule, alvo).

    facts: KEY, alvo, valor: values net of the rules below, those of expenses
    with the other sign, and the period's result, revenues less expenses, on
    the line of equity. uncovered: KEY, codigo, valor of groups of two levels
    that no rule meets, without those of compensation and those of no value.
    """
    values = saved(tree.node_values(tree.in_tree(rows)), "values")
    role = codes.bank_role(F.col("rule"))
    net = saved(projection.net_by_rule(values, rules.select("rule", "alvo")).withColumn("role", role), "net")
    lines = net.groupBy(*KEY, "alvo").agg(money(F.sum(F.when(F.col("role") == "DESPESA", -F.col("valor")).otherwise(F.col("valor")))).alias("valor"))
    part = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("valor"))), F.lit(0))
    result = net.groupBy(*KEY).agg(money(part("RECEITA") - part("DESPESA")).alias("valor")).filter(F.abs("valor") > least)
    facts = lines.unionByName(result.select(*KEY, F.lit(equity).alias("alvo"), "valor")).groupBy(*KEY, "alvo").agg(money(F.sum("valor")).alias("valor"))
    groups = values.filter((codes.level(F.col("codigo")) == 2) & ~codes.is_off_balance(F.col("codigo")) & (F.abs("valor") > least))
    above = groups.withColumn("rule", F.explode(codes.prefixes(F.col("codigo")))).join(rules.select("rule"), "rule", "left_semi").select(*KEY, "codigo")
    parts = rules.select(F.array_join(F.slice(F.split("rule", "[.]"), 1, 2), ".").alias("codigo")).distinct()
    return facts, groups.join(above, [*KEY, "codigo"], "left_anti").join(parts, "codigo", "left_anti").select(*KEY, "codigo", "valor")


def by_entity(results: dict[str, DataFrame]) -> DataFrame:
    """One table of the results of several entities, with entity."""
    return reduce(DataFrame.unionByName, [df.withColumn("entity", F.lit(name)) for name, df in results.items()])


def set_aside(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(balance, aside): a bank's rows without those of compensation, and these."""
    off = F.coalesce(codes.bank_role(F.substring("codigo", 1, 1)) == "COMPENSACAO", F.lit(False))
    return rows.filter(~off), rows.filter(off)
