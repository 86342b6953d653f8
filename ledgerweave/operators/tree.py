"""Hierarchy analytics over dotted account codes.

Every operator takes rows of many ledgers and works by KEY. A node's ancestors
are found by exploding its dotted prefixes and an equi-join, never by a prefix
predicate, so plans stay hash or merge joins at any number of ledgers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import codes, text
from ledgerweave.functions.numbers import MONEY
from ledgerweave.sources.stage import saved

KEY = ["ledger_id", "period"]
TOLERANCE = 0.01


def money(c: Column) -> Column:
    return c.cast(MONEY)


def in_tree(rows: DataFrame) -> DataFrame:
    """Rows with a hierarchical code and a real description that is no grand total."""
    return rows.filter(codes.is_hierarchical(F.col("codigo")) & ~text.is_garbage(F.col("descricao")) & ~text.is_grand_total(F.col("descricao")))


def nodes(rows: DataFrame) -> DataFrame:
    """KEY, codigo, saldo (sum of repeated codes), n, unreadable (some balance is NULL)."""
    return rows.groupBy(*KEY, "codigo").agg(money(F.sum("saldo")).alias("saldo"), F.count(F.lit(1)).alias("n"), F.max(F.col("saldo").isNull()).alias("unreadable"))


def node_values(rows: DataFrame) -> DataFrame:
    """KEY, codigo, valor: of repeated codes, the first entry that equals the sum of the others is the subtotal; else their sum.

    Two aggregations, so that no group of rows has to be held in one place.
    """
    totals = rows.groupBy(*KEY, "codigo").agg(money(F.sum("saldo")).alias("total"), F.count(F.lit(1)).alias("n"))
    repeated = rows.join(totals.filter("n > 1"), [*KEY, "codigo"]).filter(F.abs(2 * F.col("saldo") - F.col("total")) <= TOLERANCE)
    subtotal = repeated.groupBy(*KEY, "codigo").agg(F.min_by("saldo", "row_no").alias("subtotal"))
    return totals.join(subtotal, [*KEY, "codigo"], "left").select(*KEY, "codigo", money(F.coalesce("subtotal", "total")).alias("valor"))


def ancestors(tree: DataFrame, itself: bool = False) -> DataFrame:
    """KEY, codigo, ancestor: pairs of a node and a node of the same ledger on its path; tree has each node once."""
    have = tree.select(*KEY, F.col("codigo").alias("ancestor"))
    return tree.select(*KEY, "codigo", F.explode(codes.prefixes(F.col("codigo"), itself)).alias("ancestor")).join(have, [*KEY, "ancestor"])


def edges(tree: DataFrame) -> DataFrame:
    """KEY, parent, child: each node under its nearest ancestor that exists."""
    return ancestors(tree).groupBy(*KEY, F.col("codigo").alias("child")).agg(F.max_by("ancestor", codes.level(F.col("ancestor"))).alias("parent"))


def roots(tree: DataFrame) -> DataFrame:
    """Nodes of which no node of the same ledger is above."""
    return tree.join(ancestors(tree).select(*KEY, "codigo").distinct(), [*KEY, "codigo"], "left_anti")


def leaves(tree: DataFrame) -> DataFrame:
    """Nodes of which no node of the same ledger is below."""
    return tree.join(ancestors(tree).select(*KEY, F.col("ancestor").alias("codigo")).distinct(), [*KEY, "codigo"], "left_anti")


def intervals(tree: DataFrame) -> DataFrame:
    """KEY, codigo, first, last: places in preorder; the codes below a node have the places first + 1 to last.

    One sort of a ledger's codes: each node comes a second time, behind all
    that is below it, where the nodes met so far are counted.
    """
    key = codes.sort_key(F.col("codigo"))
    behind = F.array_append(key, F.struct(F.lit(True).alias("text"), F.lit(2**31 - 1).alias("n"), F.lit("").alias("s")))
    events = tree.select(*KEY, "codigo", F.explode(F.array(F.struct(key.alias("key"), F.lit(1).alias("opens")), F.struct(behind.alias("key"), F.lit(0).alias("opens")))).alias("e"))
    met = F.sum("e.opens").over(Window.partitionBy(*KEY).orderBy("e.key", "codigo").rowsBetween(Window.unboundedPreceding, 0))
    placed = events.select(*KEY, "codigo", "e.opens", met.alias("met"))
    place = lambda opens: F.max(F.when(F.col("opens") == opens, F.col("met")))
    return placed.groupBy(*KEY, "codigo").agg(place(1).alias("first"), place(0).alias("last"))


def descendants(tree: DataFrame) -> DataFrame:
    """KEY, codigo, first, last, n: nodes that have some below them, with the places in preorder and how many there are."""
    return intervals(tree).filter("last > first").withColumn("n", F.col("last") - F.col("first"))


def listed(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """KEY, codigo, descendants: the sorted codes below the asked nodes (KEY, codigo), as one array each."""
    wanted = ancestors(tree).join(asked.select(*KEY, F.col("codigo").alias("ancestor")).distinct(), [*KEY, "ancestor"])
    return wanted.groupBy(*KEY, F.col("ancestor").alias("codigo")).agg(F.array_sort(F.collect_set("codigo")).alias("descendants"))


def rollup_check(tree: DataFrame) -> DataFrame:
    """KEY, codigo, declared, children, diff, ok for each node that has children; a NULL balance below makes ok false."""
    child = edges(tree).join(tree.select(*KEY, F.col("codigo").alias("child"), F.col("saldo").alias("below"), F.col("unreadable")), [*KEY, "child"])
    sums = child.groupBy(*KEY, F.col("parent").alias("codigo")).agg(money(F.sum("below")).alias("children"), F.max("unreadable").alias("hidden"), F.count(F.lit(1)).alias("n_children"))
    joined = sums.join(tree.select(*KEY, "codigo", F.col("saldo").alias("declared"), F.col("unreadable")), [*KEY, "codigo"])
    diff = money(F.col("declared") - F.col("children"))
    return joined.select(*KEY, "codigo", "declared", "children", "n_children", diff.alias("diff"), (F.coalesce(F.abs(diff) <= TOLERANCE, F.lit(False)) & ~F.col("hidden") & ~F.col("unreadable")).alias("ok"))


def divergences(tree: DataFrame) -> DataFrame:
    """Failed checks with their rank by size."""
    by_size = Window.partitionBy(*KEY).orderBy(F.abs("diff").desc(), "codigo")
    return rollup_check(tree).filter(~F.col("ok")).withColumn("rank", F.row_number().over(by_size))


def report(rows: DataFrame) -> DataFrame:
    """A row per ledger: rows, in_tree, checked, divergent, duplicates, surplus, readable, has_tree, sound."""
    counts = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("saldo").isNotNull().cast("int")).alias("share"))
    tree = nodes(in_tree(rows))
    inside = tree.groupBy(*KEY).agg(F.sum("n").alias("in_tree"), F.count_if(F.col("n") > 1).alias("duplicates"), F.sum(F.col("n") - 1).alias("surplus"))
    checks = rollup_check(tree).groupBy(*KEY).agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("ok")).alias("divergent"))
    out = counts.join(inside, KEY, "left").join(checks, KEY, "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("in_tree", "duplicates", "surplus", "checked", "divergent")}
    readable = F.col("share") >= 0.5
    return out.select(*KEY, "rows", *[v.cast("long").alias(c) for c, v in n.items()], readable.alias("readable"), (n["checked"] > 0).alias("has_tree"), (readable & (n["checked"] > 0) & (n["divergent"] == 0)).alias("sound"))


def duplicate_codes(rows: DataFrame) -> DataFrame:
    return nodes(rows).filter("n > 1").select(*KEY, "codigo", "n", (F.col("n") - 1).alias("surplus"))


def root_totals(tree: DataFrame) -> DataFrame:
    """KEY, root digit, class and total of the roots."""
    top = roots(tree).withColumn("root", F.substring("codigo", 1, 1)).withColumn("class", codes.account_class(F.col("codigo")))
    return top.groupBy(*KEY, "root", "class").agg(money(F.sum("saldo")).alias("total"))


def equation(tree: DataFrame) -> DataFrame:
    """KEY, residue, closes: totals of root digits under the signs (the first +) that leave least; more than five are summed."""
    totals = root_totals(tree).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("root", "total"))), lambda x: x["total"]).alias("t"))
    sums = []
    for bits in range(16):
        sign = F.array(*[F.lit(1 if i == 0 or not bits >> (i - 1) & 1 else -1) for i in range(5)])
        zipped = F.zip_with("t", F.slice(sign, F.lit(1), F.greatest(F.size("t"), F.lit(1))), lambda x, s: x * s)
        sums.append(F.aggregate(zipped, F.lit(0).cast("decimal(38,4)"), lambda a, x: (a + F.coalesce(x, F.lit(0))).cast("decimal(38,4)")))
    plain = F.aggregate("t", F.lit(0).cast("decimal(38,4)"), lambda a, x: (a + x).cast("decimal(38,4)"))
    least = F.array_min(F.array(*[F.abs(s) for s in sums]))
    largest = F.array_max(F.transform("t", F.abs))
    residue = F.when(F.size("t") > 5, F.abs(plain)).otherwise(least)
    return totals.select(*KEY, money(residue).alias("residue"), (residue <= F.greatest(F.lit(0.01), largest.cast("double") * 1e-6)).alias("closes"))


def inherited(tree: DataFrame, declared: DataFrame, attribute: str) -> DataFrame:
    """KEY, codigo, attribute: that of the nearest node on the path, the node itself included, that declares one (KEY, codigo, attribute)."""
    known = declared.filter(F.col(attribute).isNotNull()).select(*KEY, F.col("codigo").alias("ancestor"), attribute)
    return ancestors(tree, itself=True).join(known, [*KEY, "ancestor"]).groupBy(*KEY, "codigo").agg(F.max_by(attribute, codes.level(F.col("ancestor"))).alias(attribute))


def first_descriptions(rows: DataFrame) -> DataFrame:
    """KEY, codigo, descricao: the first that is not blank."""
    return rows.filter(F.trim("descricao") != "").groupBy(*KEY, "codigo").agg(F.min_by("descricao", "row_no").alias("descricao"))


def natures(rows: DataFrame) -> DataFrame:
    """Nature of result accounts by branch."""
    result = in_tree(rows).filter(codes.account_class(F.col("codigo")) == "RESULTADO")
    return inherited(nodes(result), first_descriptions(result).withColumn("natureza", text.result_nature(F.col("descricao"))), "natureza")


def terms(rows: DataFrame) -> DataFrame:
    """Term of asset and liability accounts by branch."""
    balance = in_tree(rows).filter(codes.account_class(F.col("codigo")).isin("ATIVO", "PASSIVO"))
    return inherited(nodes(balance), first_descriptions(balance).withColumn("prazo", text.term(F.col("descricao"))), "prazo")


def nature_totals(tree: DataFrame, natureza: DataFrame) -> DataFrame:
    """KEY, natureza, total over the top codes that have a nature."""
    known = tree.join(natureza, [*KEY, "codigo"])
    above = ancestors(known).select(*KEY, "codigo").distinct()
    return known.join(above, [*KEY, "codigo"], "left_anti").groupBy(*KEY, "natureza").agg(money(F.sum("saldo")).alias("total"))


def period_result(totals: DataFrame) -> DataFrame:
    """KEY, resultado: |revenue| - |expense|."""
    one = lambda n: F.abs(F.coalesce(F.sum(F.when(F.col("natureza") == n, F.col("total"))), F.lit(0)))
    return totals.groupBy(*KEY).agg(money(one("RECEITA") - one("DESPESA")).alias("resultado"))


def tree_cut(tree: DataFrame, mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(emitted, uncovered): KEY, codigo of the most detailed antichain of mapped nodes that loses no value, and of leaves without one.

    A mapped node that is no class root stops the cut when it is a leaf, or no
    leaf below it has a mapped node deeper than it on every path; per leaf the
    deepest candidate, per candidate the least of those, per leaf the
    shallowest stop. Paths are made once and written; three groupings over
    them, no recursion.
    """
    candidates = mapped.select(*KEY, F.col("codigo").alias("ancestor"), (~codes.is_class_root(F.col("codigo"))).alias("candidate")).distinct()
    path = ancestors(tree, itself=True).join(candidates, [*KEY, "ancestor"], "left").withColumn("d", codes.level(F.col("ancestor")))
    path = saved(path.withColumn("candidate", F.coalesce("candidate", F.lit(False))), "paths")
    inner = path.filter("codigo <> ancestor").select(*KEY, F.col("ancestor").alias("codigo")).distinct()
    own = path.join(inner, [*KEY, "codigo"], "left_anti")
    deepest = own.groupBy(*KEY, "codigo").agg(F.coalesce(F.max(F.when(F.col("candidate"), F.col("d"))), F.lit(0)).alias("dm"))
    own = saved(own.join(deepest, [*KEY, "codigo"]), "leaf-paths")
    least = own.groupBy(*KEY, "ancestor").agg(F.min("dm").alias("least"))
    stop = F.min_by("ancestor", F.when(F.col("candidate") & (F.col("least") <= F.col("d")), F.col("d")))
    stops = saved(own.join(least, [*KEY, "ancestor"]).groupBy(*KEY, "codigo").agg(stop.alias("stop")), "stops")
    return stops.filter("stop is not null").select(*KEY, F.col("stop").alias("codigo")).distinct(), stops.filter("stop is null").select(*KEY, "codigo")


def absorbed(tree: DataFrame, emitted: DataFrame) -> DataFrame:
    """KEY, codigo, first, last, n: emitted nodes that have codes below them, whose places are first + 1 to last."""
    return descendants(tree).join(emitted.select(*KEY, "codigo").distinct(), [*KEY, "codigo"])


def export_rollup(tree: DataFrame) -> DataFrame:
    """KEY, codigo, saldo, saldo_calculado, diff, ok: within 0.01 or 0.05 %; an unreadable child poisons its parent."""
    c = rollup_check(tree)
    bad = c.select(*KEY, "codigo", "children", "diff", "ok")
    joined = tree.join(bad, [*KEY, "codigo"], "left")
    relative = F.abs(F.col("diff")) <= F.abs(F.col("saldo")) * 0.0005
    return joined.select(*KEY, "codigo", "saldo", F.coalesce("children", "saldo").alias("saldo_calculado"), F.coalesce("diff", F.lit(0)).cast(MONEY).alias("diff"), F.coalesce(F.col("ok") | relative, ~F.col("unreadable")).alias("ok"))


def diagnosis(rows: DataFrame) -> DataFrame:
    """KEY, roots, exploded (more than five), without_dots, mixed (more than three), surplus, deepest."""
    tree = nodes(in_tree(rows))
    r = roots(tree).groupBy(*KEY).agg(F.count(F.lit(1)).alias("roots"))
    t = tree.groupBy(*KEY).agg(F.count_if(~F.col("codigo").contains(".")).alias("without_dots"), F.sum(F.col("n") - 1).alias("surplus"), F.max(codes.level(F.col("codigo"))).alias("deepest"))
    return r.join(t, KEY).select(*KEY, "roots", (F.col("roots") > 5).alias("exploded"), "without_dots", (F.col("without_dots") > 3).alias("mixed"), "surplus", "deepest")


def level_histogram(tree: DataFrame) -> DataFrame:
    return tree.groupBy(*KEY, codes.level(F.col("codigo")).alias("nivel")).agg(F.count(F.lit(1)).alias("n"))


def top_roots(tree: DataFrame, n: int = 15) -> DataFrame:
    by_size = Window.partitionBy(*KEY).orderBy(F.abs("saldo").desc(), "codigo")
    return roots(tree).withColumn("rank", F.row_number().over(by_size)).filter(F.col("rank") <= n).select(*KEY, "codigo", "saldo", "rank")


def existing_parents(tree: DataFrame) -> DataFrame:
    """KEY, codigo, parent: the nearest code above that exists, by segments, and for flat codes by two digits, then one."""
    up = F.when(F.col("codigo").contains("."), F.reverse(codes.prefixes(F.col("codigo"), itself=False))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.char_length("codigo") / 2).cast("int") + 1)), lambda n: F.col("codigo").substr(F.lit(1), F.when(F.char_length("codigo") > 2 * n, F.char_length("codigo") - 2 * n).when(F.char_length("codigo") == 2 * n, F.lit(1)).otherwise(F.lit(0))))
    )
    tried = tree.select(*KEY, "codigo", F.posexplode(up).alias("step", "parent")).filter("parent <> '' and parent <> codigo")
    found = tried.join(tree.select(*KEY, F.col("codigo").alias("parent")), [*KEY, "parent"])
    return found.groupBy(*KEY, "codigo").agg(F.min_by("parent", "step").alias("parent"))


def synthetic(rows: DataFrame) -> DataFrame:
    """rows with synthetic: the account has children; without, detail in the description, a level over 5 or six dots make it analytical."""
    parents = edges(nodes(in_tree(rows))).select(*KEY, F.col("parent").alias("codigo")).distinct().withColumn("is_parent", F.lit(True))
    detail = text.is_analytical_detail(F.col("descricao")) | (codes.level(F.col("codigo")) > 5)
    return rows.join(parents, [*KEY, "codigo"], "left").withColumn("synthetic", F.coalesce("is_parent", ~detail, F.lit(True))).drop("is_parent")
