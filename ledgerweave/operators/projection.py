"""Routing of accounts into statement lines, and proofs that nothing was lost.

Facts are summed by code before string prefixes are exploded, so the number of
rows that meet a line does not grow with the number of facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import codes, text
from ledgerweave.functions.numbers import MONEY
from ledgerweave.operators.tree import KEY, ancestors, money


def line_prefixes(lines: DataFrame) -> DataFrame:
    """stmt, line_no, sign, prefix of lines (stmt, line_no, label, codes); codes part at |, a label in (-) is negative."""
    sign = F.when(F.col("label").rlike(r"^\s*\(-\)"), -1).otherwise(1)
    return lines.select("stmt", "line_no", sign.alias("sign"), F.explode(F.split("codes", r"\|")).alias("prefix")).withColumn("prefix", F.trim("prefix")).filter("prefix <> ''")


def captured(accounts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """codigo, stmt, line_no, sign, prefix: every line whose prefix the code's characters begin with."""
    distinct = accounts.select("codigo").distinct()
    return distinct.withColumn("prefix", F.explode(codes.string_prefixes(F.col("codigo")))).join(prefixes, "prefix").select("codigo", "stmt", "line_no", "sign", "prefix")


def longest_rule(accounts: DataFrame, rules: DataFrame) -> DataFrame:
    """codigo and the columns of the rule (rule, ...) with the longest dotted prefix of it."""
    distinct = accounts.select("codigo").distinct()
    other = [c for c in rules.columns if c != "rule"]
    met = distinct.withColumn("rule", F.explode(codes.prefixes(F.col("codigo")))).join(rules, "rule")
    best = met.groupBy("codigo").agg(F.max_by(F.struct("rule", *other), codes.level(F.col("rule"))).alias("b"))
    return best.select("codigo", "b.*")


def project(accounts: DataFrame, prefixes: DataFrame, mapping: DataFrame, blocked: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """codigo, alvo, metodo: where each code is booked.

    In this order: blocked; mapped (codigo, alvo); for a code renamed by
    prefix, mapped under its new name; captured by a line, under the new name
    if there is one; the deepest ancestor of that name that a line captures,
    if none that is blocked lies between.
    """
    renames = {"3.11.": "3.01."} if renames is None else renames
    renamed = F.lit(None).cast("string")
    for old, new in renames.items():
        renamed = F.coalesce(renamed, F.when(F.col("codigo").startswith(old), F.concat(F.lit(new), F.substring("codigo", len(old) + 1, 1 << 20))))
    own = accounts.select("codigo").distinct().withColumn("renamed", renamed).withColumn("base", F.coalesce("renamed", "codigo"))
    stop = blocked.select(F.col("codigo").alias("ancestor")).distinct().withColumn("stop", F.lit(True))
    path = own.select("base").distinct().withColumn("ancestor", F.explode(codes.prefixes(F.col("base"))))
    hit = captured(path.select(F.col("ancestor").alias("codigo")), prefixes).select(F.col("codigo").alias("ancestor")).distinct().withColumn("hit", F.lit(True))
    walked = path.join(hit, "ancestor", "left").join(stop, "ancestor", "left")
    d, above = codes.level(F.col("ancestor")), F.col("ancestor") != F.col("base")
    climb = walked.groupBy("base").agg(
        F.max_by("ancestor", F.when(F.col("hit") & above, d)).alias("up"), F.max(F.when(F.col("hit") & above, d)).alias("up_d"),
        F.max(F.when(F.col("stop") & above, d)).alias("stop_d"), F.max(F.col("hit").isNotNull() & ~above).alias("direct"),
    )
    one, two = mapping.select("codigo", F.col("alvo").alias("m1")), mapping.select(F.col("codigo").alias("renamed"), F.col("alvo").alias("m2"))
    joined = own.join(climb, "base").join(one, "codigo", "left").join(two, "renamed", "left").join(stop.select(F.col("ancestor").alias("codigo"), F.col("stop").alias("is_blocked")), "codigo", "left")
    climbs = F.col("up").isNotNull() & (F.col("up_d") > F.coalesce("stop_d", F.lit(0)))
    new = F.col("renamed").isNotNull()
    steps = [(F.col("is_blocked").isNotNull(), F.lit(None), F.lit("blocked")), (F.col("m1").isNotNull(), F.col("m1"), F.lit("map")), (F.col("m2").isNotNull(), F.col("m2"), F.lit("rename map")), (F.col("direct"), F.col("base"), F.when(new, "rename").otherwise("captured")), (climbs, F.col("up"), F.when(new, "rename climb").otherwise("climb"))]
    target, method = F.lit(None).cast("string"), F.lit("failed")
    for cond, value, name in reversed(steps):
        target, method = F.when(cond, value).otherwise(target), F.when(cond, name).otherwise(method)
    return joined.select("codigo", target.alias("alvo"), method.alias("metodo"))


def method_counts(projected: DataFrame) -> DataFrame:
    return projected.groupBy("metodo").agg(F.count(F.lit(1)).alias("n"))


def signs(accounts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """codigo, sign: that of the longest prefix, +1 without one."""
    best = captured(accounts, prefixes).groupBy("codigo").agg(F.max_by("sign", F.struct(F.char_length("prefix"), -F.col("line_no"))).alias("sign"))
    return accounts.select("codigo").distinct().join(best, "codigo", "left").select("codigo", F.coalesce("sign", F.lit(1)).alias("sign"))


def nested_prefixes(prefixes: DataFrame) -> DataFrame:
    """outer, inner, of prefixes of which one begins with the other."""
    inner = prefixes.select("stmt", F.col("prefix").alias("inner"), F.col("line_no").alias("inner_line"))
    outer = prefixes.select("stmt", F.col("prefix").alias("outer"), F.col("line_no").alias("outer_line"))
    met = inner.withColumn("outer", F.explode(codes.string_prefixes(F.col("inner")))).join(outer, ["stmt", "outer"])
    return met.filter("inner <> outer or inner_line <> outer_line").select("stmt", "outer", "outer_line", "inner", "inner_line")


def capture_check(facts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """KEY, lost (value no line takes), doubled (value taken again), n_lost, n_doubled of facts (KEY, codigo, valor)."""
    taken = captured(facts, prefixes).groupBy("codigo").agg(F.count_distinct("stmt", "line_no").alias("lines"))
    by_code = facts.groupBy(*KEY, "codigo").agg(money(F.sum("valor")).alias("valor")).join(taken, "codigo", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    zero = F.lit(0).cast(MONEY)
    return by_code.groupBy(*KEY).agg(
        money(F.sum(F.when(F.col("lines") == 0, F.col("valor")).otherwise(zero))).alias("lost"), money(F.sum(F.when(F.col("lines") > 1, F.col("valor") * (F.col("lines") - 1)).otherwise(zero))).alias("doubled"),
        F.count_if(F.col("lines") == 0).alias("n_lost"), F.count_if(F.col("lines") > 1).alias("n_doubled"),
    )


def orientation(root_totals: DataFrame) -> DataFrame:
    """KEY, class, turn: -1 for liabilities declared as negative, +1 for what is declared as positive."""
    return root_totals.groupBy(*KEY, "class").agg(F.when(F.sum("total") < 0, -1).otherwise(1).alias("turn"))


def oriented(facts: DataFrame, turns: DataFrame, sign: DataFrame) -> DataFrame:
    """facts with valor as delivered: balance accounts keep their sign times their class's turn, results take the line's."""
    joined = facts.withColumn("class", codes.account_class(F.col("codigo"))).join(turns, [*KEY, "class"], "left").join(sign, "codigo", "left")
    value = F.when(F.col("class") == "RESULTADO", F.abs("valor") * F.coalesce("sign", F.lit(1))).otherwise(F.col("valor") * F.coalesce("turn", F.lit(1)))
    return joined.select(*KEY, "codigo", money(value).alias("valor"))


def emit(emitted: DataFrame, nodes: DataFrame, projected: DataFrame) -> DataFrame:
    """KEY, codigo, alvo, valor: a fact for each node of the cut that has somewhere to go."""
    return emitted.join(nodes.select(*KEY, "codigo", F.col("saldo").alias("valor")), [*KEY, "codigo"]).join(projected.filter("alvo is not null").select("codigo", "alvo"), "codigo").select(*KEY, "codigo", "alvo", "valor")


def uncovered_totals(uncovered: DataFrame, nodes: DataFrame) -> DataFrame:
    """KEY, class (NULL: all), total and number of leaves without a destination."""
    lost = uncovered.join(nodes.select(*KEY, "codigo", "saldo"), [*KEY, "codigo"]).withColumn("class", codes.account_class(F.col("codigo")))
    return lost.groupingSets([[*map(F.col, KEY), F.col("class")], [*map(F.col, KEY)]], *KEY, "class").agg(money(F.sum("saldo")).alias("total"), F.count(F.lit(1)).alias("n"))


def uncovered_rows(uncovered: DataFrame, rows: DataFrame, reasons: DataFrame) -> DataFrame:
    """KEY, codigo, descricao, valor, motivo: each code without a destination, all its rows summed, and why, by reasons (KEY, codigo, motivo)."""
    first = rows.join(uncovered.select(*KEY, "codigo").distinct(), [*KEY, "codigo"]).groupBy(*KEY, "codigo").agg(F.min_by("descricao", "row_no").alias("descricao"), money(F.coalesce(F.sum("saldo"), F.lit(0))).alias("valor"))
    why = reasons.groupBy(*KEY, "codigo").agg(F.min("motivo").alias("motivo"))
    return first.join(why, [*KEY, "codigo"], "left").withColumn("motivo", F.coalesce("motivo", F.lit("no reliable match in the chart")))


def lost_totals(lost: DataFrame, natures: DataFrame) -> DataFrame:
    """KEY, kind (class or nature), name, total, n of uncovered rows, with natures (KEY, codigo, natureza)."""
    told = lost.join(natures.select(*KEY, "codigo", "natureza"), [*KEY, "codigo"], "left")
    parts = F.explode(F.array(F.struct(F.lit("class").alias("kind"), codes.account_class(F.col("codigo")).alias("name")), F.struct(F.lit("nature").alias("kind"), F.col("natureza").alias("name"))))
    return told.select(*KEY, "valor", parts.alias("p")).filter("p.name is not null").groupBy(*KEY, "p.kind", "p.name").agg(money(F.sum("valor")).alias("total"), F.count(F.lit(1)).alias("n"))


def by_size(lost: DataFrame) -> DataFrame:
    """lost with rank by absolute value and total, what the accounts up to each sum to: how the gap of a ledger comes about."""
    order = Window.partitionBy(*KEY).orderBy(F.abs("valor").desc(), "codigo")
    return lost.withColumn("rank", F.row_number().over(order)).withColumn("total", money(F.sum("valor").over(order.rowsBetween(Window.unboundedPreceding, 0))))


def period_counts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """ledger_id, period (null: all), rows, facts: what each period was read from and delivered."""
    count = lambda df, name: df.groupBy("ledger_id", "period").agg(F.count(F.lit(1)).alias(name))
    both = count(rows, "rows").join(count(facts, "facts"), ["ledger_id", "period"], "full_outer").fillna(0, ["rows", "facts"])
    return both.groupingSets([[F.col("ledger_id"), F.col("period")], [F.col("ledger_id")]], "ledger_id", "period").agg(F.sum("rows").alias("rows"), F.sum("facts").alias("facts"))


def too_many_periods(rows: DataFrame, most: int = 5) -> DataFrame:
    """ledger_id, periods of ledgers that have more of them than a delivery takes."""
    return rows.groupBy("ledger_id").agg(F.array_sort(F.collect_set("period")).alias("periods")).filter(F.size("periods") > most)


def method_failures(projected: DataFrame) -> DataFrame:
    """codigo, metodo of codes that no method has taken to a line."""
    return projected.filter("alvo is null").select("codigo", "metodo").distinct()


def emitted_counts(emitted: DataFrame, rows: DataFrame) -> DataFrame:
    """KEY, facts, repeated (rows beyond the first of an emitted code), unreadable (rows of them without a balance)."""
    of = rows.join(emitted.select(*KEY, "codigo").distinct(), [*KEY, "codigo"]).groupBy(*KEY, "codigo").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("saldo").isNull()).alias("bad"))
    return of.groupBy(*KEY).agg(F.count(F.lit(1)).alias("facts"), F.sum(F.col("n") - 1).alias("repeated"), F.sum("bad").alias("unreadable"))


def result_to_equity(totals: DataFrame) -> DataFrame:
    """KEY, gap, result, transfer, warning of totals (KEY, assets, liabilities, revenues, expenses).

    A ledger whose balance has a gap is open where the gap is its result,
    revenues less expenses by size; then the gap is to be moved to equity.
    Where the two differ by more than a cent and a millionth, an account is
    missing or counted twice: nothing is moved, and warning says so.
    """
    size = lambda c: F.abs(F.coalesce(c, F.lit(0)))
    gap, result = F.col("assets") - F.col("liabilities"), size("revenues") - size("expenses")
    asked = (F.abs(gap) > 0.01) & ((size("revenues") > 0) | (size("expenses") > 0))
    same = F.abs(gap - result) <= F.greatest(F.lit(0.01), F.abs(gap).cast("double") * 1e-6)
    out = totals.select(*KEY, money(gap).alias("gap"), money(result).alias("result"), asked.alias("asked"), same.alias("same"))
    warning = F.format_string("gap of %s, result of %s", F.col("gap").cast("decimal(20,2)").cast("string"), F.col("result").cast("decimal(20,2)").cast("string"))
    return out.select(*KEY, "gap", "result", money(F.when(F.col("asked") & F.col("same"), F.col("gap")).otherwise(0)).alias("transfer"), F.when(F.col("asked") & ~F.col("same"), warning).alias("warning"))


#: Fixed value: the line of the chart that takes a period's result.
EQUITY_CODE = "2.03.04.01"


def equity_facts(transfers: DataFrame, target: str = EQUITY_CODE) -> DataFrame:
    """KEY, codigo (generated), alvo, valor: a fact for each ledger with a transfer."""
    return transfers.filter("transfer <> 0").select(*KEY, F.lit("(generated)").alias("codigo"), F.lit(target).alias("alvo"), F.col("transfer").alias("valor"))


def statement(facts: DataFrame, prefixes: DataFrame, line_terms: DataFrame | None = None) -> DataFrame:
    """KEY, stmt, line_no, valor: sums of the facts that each line captures, and totals over lines.

    line_terms (stmt, total_line, term_line, coef) may be nested to any depth;
    its closure is taken over that small table alone.
    """
    by_code = facts.groupBy(*KEY, "codigo").agg(money(F.sum("valor")).alias("valor"))
    plain = by_code.join(captured(facts, prefixes).select("codigo", "stmt", "line_no").distinct(), "codigo").groupBy(*KEY, "stmt", "line_no").agg(money(F.sum("valor")).alias("valor"))
    if line_terms is None:
        return plain
    spark = facts.sparkSession
    closure = spark.sql(
        """WITH RECURSIVE r(stmt, total_line, term_line, coef) AS (SELECT stmt, total_line, term_line, coef FROM {terms}
        UNION ALL SELECT r.stmt, r.total_line, t.term_line, r.coef * t.coef FROM r JOIN {terms} t ON r.stmt = t.stmt AND r.term_line = t.total_line)
        SELECT r.* FROM r LEFT ANTI JOIN {terms} t ON r.stmt = t.stmt AND r.term_line = t.total_line""", terms=line_terms,
    )
    totals = plain.join(closure.withColumnRenamed("term_line", "line_no"), ["stmt", "line_no"]).groupBy(*KEY, "stmt", F.col("total_line").alias("line_no")).agg(money(F.sum(F.col("valor") * F.col("coef"))).alias("valor"))
    return plain.unionByName(totals)


def totals_check(delivered: DataFrame, source: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """KEY, class, delivered, source, diff, ok: full outer comparison of (KEY, class, total) in absolute value."""
    d, s = delivered.select(*KEY, "class", F.col("total").alias("delivered")), source.select(*KEY, "class", F.col("total").alias("source"))
    joined = d.join(s, [*KEY, "class"], "full_outer")
    diff = money(F.abs(F.coalesce("delivered", F.lit(0))) - F.abs(F.coalesce("source", F.lit(0))))
    return joined.select(*KEY, "class", "delivered", "source", diff.alias("diff"), (F.abs(diff) <= F.greatest(F.lit(tolerance), F.abs(F.coalesce("source", F.lit(0))).cast("double") * 1e-6)).alias("ok"))


def reconciliation(emitted_total: DataFrame, source_total: DataFrame, uncovered: DataFrame) -> DataFrame:
    """KEY, imbalance, unexplained: source less emitted, and what the accounts without destination leave of it."""
    lost = uncovered.filter("class is null").select(*KEY, F.col("total").alias("lost"))
    joined = source_total.select(*KEY, F.col("total").alias("s")).join(emitted_total.select(*KEY, F.col("total").alias("e")), KEY, "left").join(lost, KEY, "left")
    gap = F.col("s") - F.coalesce("e", F.lit(0))
    return joined.select(*KEY, money(gap).alias("imbalance"), money(gap - F.coalesce("lost", F.lit(0))).alias("unexplained"))


def coverage(emitted: DataFrame, nodes: DataFrame, uncovered: DataFrame) -> DataFrame:
    """KEY, coverage: share of absolute leaf value that has a destination."""
    value = nodes.select(*KEY, "codigo", F.abs("saldo").alias("v"))
    one = emitted.join(value, [*KEY, "codigo"]).groupBy(*KEY).agg(F.sum("v").alias("kept"))
    two = uncovered.join(value, [*KEY, "codigo"]).groupBy(*KEY).agg(F.sum("v").alias("lost"))
    kept, lost = F.coalesce("kept", F.lit(0)).cast("double"), F.coalesce("lost", F.lit(0)).cast("double")
    return one.join(two, KEY, "full_outer").select(*KEY, F.coalesce(F.try_divide(kept, kept + lost), F.lit(0.0)).alias("coverage"))


def value_coverage(source: DataFrame, uncovered: DataFrame) -> DataFrame:
    """KEY, coverage: 1 less the uncovered value over the source's absolute class totals (KEY, class, total); 1 where these are 0."""
    lost = uncovered.filter("class is null").select(*KEY, F.col("total").alias("lost"))
    whole = source.groupBy(*KEY).agg(F.sum(F.abs("total")).cast("double").alias("whole")).join(lost, KEY, "left")
    share = 1 - F.try_divide(F.abs(F.coalesce("lost", F.lit(0))).cast("double"), F.col("whole"))
    return whole.select(*KEY, F.coalesce(share, F.lit(1.0)).alias("coverage"))


def completeness(source: DataFrame, emitted: DataFrame, uncovered: DataFrame) -> DataFrame:
    """KEY, class, source, rebuilt, complete: emitted plus uncovered totals (KEY, class, total each) make the source's, class by class."""
    one = lambda df, c: df.filter("class is not null").groupBy(*KEY, "class").agg(F.sum("total").alias(c))
    joined = one(source, "source").join(one(emitted, "e"), [*KEY, "class"], "left").join(one(uncovered, "u"), [*KEY, "class"], "left")
    rebuilt = money(F.coalesce("e", F.lit(0)) + F.coalesce("u", F.lit(0)))
    gap = F.abs(rebuilt - F.col("source")).cast("double")
    return joined.select(*KEY, "class", money(F.col("source")).alias("source"), rebuilt.alias("rebuilt"), (gap <= F.greatest(F.lit(0.01), F.abs("source").cast("double") * 1e-6)).alias("complete"))


def verdict(treated: Column, closes: Column, checkable: Column) -> Column:
    """empty (nothing treated), ok (the delivery closes), draft (nothing to check it by) or caveat."""
    return F.when(treated == 0, "empty").when(closes, "ok").when(~checkable, "draft").otherwise("caveat")


def by_period(facts: DataFrame, periods: list[int] | None = None) -> DataFrame:
    """One column per period: those given, or all that occur."""
    return facts.groupBy("ledger_id", "codigo").pivot("period", periods).agg(money(F.sum("valor")))


def bank_plan(rows: DataFrame) -> DataFrame:
    """KEY, is_bank: the names of the one-digit roots are those of a bank's plan."""
    root = rows.filter(F.col("codigo").rlike(r"^\d$")).groupBy(*KEY, "codigo").agg(text.unaccented(F.min_by("descricao", "row_no")).alias("d"))
    has = lambda digits, *words: F.max(F.col("codigo").isin(*digits) & F.forall(F.array(*map(F.lit, words)), lambda w: F.contains("d", w)))
    found = root.groupBy(*KEY).agg(has("7", "resultado", "cred").alias("c"), has("8", "resultado", "deved").alias("e"), has(("3", "9"), "compensacao").alias("o"))
    return rows.select(*KEY).distinct().join(found, KEY, "left").select(*KEY, F.coalesce(F.col("c") & (F.col("e") | F.col("o")), F.lit(False)).alias("is_bank"))


def totals_by_role(root_totals: DataFrame) -> DataFrame:
    return root_totals.groupBy(*KEY, codes.bank_role(F.col("root")).alias("role")).agg(money(F.sum("total")).alias("total"))


def net_by_rule(values: DataFrame, rules: DataFrame) -> DataFrame:
    """KEY, rule, alvo, valor for node values (KEY, codigo, valor) and rules (rule, alvo): a rule's node less the nodes of the rules nearest below it."""
    present = values.join(rules.withColumnRenamed("rule", "codigo"), "codigo")
    near = ancestors(present).groupBy(*KEY, F.col("codigo").alias("below")).agg(F.max_by("ancestor", codes.level(F.col("ancestor"))).alias("codigo"))
    below = near.join(values.select(*KEY, F.col("codigo").alias("below"), F.col("valor").alias("v")), [*KEY, "below"]).groupBy(*KEY, "codigo").agg(F.sum("v").alias("v"))
    return present.join(below, [*KEY, "codigo"], "left").select(*KEY, F.col("codigo").alias("rule"), "alvo", money(F.col("valor") - F.coalesce("v", F.lit(0))).alias("valor"))


def validate_rows(rows: DataFrame) -> DataFrame:
    """KEY, n, no_description, no_balance, no_code, bad_code, blocking, and the first row without a balance."""
    blank = F.coalesce(F.trim("descricao"), F.lit("")) == ""
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("no_description"), F.count_if(F.col("saldo").isNull()).alias("no_balance"), F.count_if(F.col("codigo").isNull()).alias("no_code"),
        F.count_if(~codes.is_hierarchical(F.col("codigo"))).alias("bad_code"), F.max(blank | F.col("saldo").isNull()).alias("blocking"),
        F.min(F.when(F.col("saldo").isNull(), F.col("row_no"))).alias("first_row"),
    )


def income_check(delivered: DataFrame, uncovered: DataFrame, source: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """KEY, diff, ok: net income plus uncovered results (each KEY, total) against the source's result."""
    one = lambda df, c: df.select(*KEY, F.col("total").alias(c))
    joined = one(source, "s").join(one(delivered, "d"), KEY, "left").join(one(uncovered, "u"), KEY, "left").fillna(0, ["d", "u"])
    diff = money(F.col("d") + F.col("u") - F.col("s"))
    return joined.select(*KEY, diff.alias("diff"), (F.abs(diff) <= tolerance).alias("ok"))


def validate_matches(matched: DataFrame) -> DataFrame:
    """KEY, bad_score, half_pairs, analytical, rate (matched of synthetic) of rows (score, alvo, alvo_descricao, synthetic)."""
    hit = F.col("alvo").isNotNull()
    return matched.groupBy(*KEY).agg(
        F.count_if(~F.col("score").between(0, 100)).alias("bad_score"), F.count_if(hit != F.col("alvo_descricao").isNotNull()).alias("half_pairs"), F.count_if(hit & ~F.col("synthetic")).alias("analytical"),
        F.round(F.coalesce(F.try_divide(F.count_if(hit & F.col("synthetic")), F.count_if("synthetic")), F.lit(0.0)), 6).alias("rate"),
    )


def resolved(matched: DataFrame, projected: DataFrame) -> DataFrame:
    """matched (codigo, own and target class, nature, term) with codigo_template and motivo: the first lock that does not hold, or none."""
    joined = matched.join(projected.select("codigo", "alvo", "metodo"), "codigo", "left")
    clash = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    reason = F.when(F.col("codigo").isNull(), "no match").when(F.col("alvo").isNull(), F.coalesce("metodo", F.lit("no line"))).when(clash("classe", "alvo_classe"), "class").when(clash("natureza", "alvo_natureza"), "nature").when(clash("prazo", "alvo_prazo"), "term")
    return joined.withColumn("motivo", reason).withColumn("codigo_template", F.when(reason.isNull(), F.col("alvo")))
